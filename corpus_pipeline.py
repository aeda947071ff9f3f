"""The corpus pipeline: documents judged, deduplicated, freed of personal data and packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs.  All but the last return the columns of documents.  Stages decide about rows, not ids: of rows that
share a doc_id, or have none, each is judged by what it says.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import kneser_ney, ngram_join, packing, pii, quality_rules
from tidemark.llm.shared import bounded, cut, remove, row_hash, salt_of, scope, small_batches, table, written

#: SQL cannot express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def _told_apart(docs: DataFrame, key: str) -> DataFrame:
    """docs with a hash of all their columns, maps aside: with doc_id it tells rows apart, and equal rows are one."""
    return docs.withColumn(key, row_hash(*(f.name for f in docs.schema if "map<" not in f.dataType.simpleString())))


def _only(docs: DataFrame, rows: DataFrame, key: str, how: str) -> DataFrame:
    """docs joined (left_semi or left_anti) with rows(doc_id, key); where those are few, texts aren't shuffled."""
    rows = cut(rows.select(F.col("doc_id").alias("of"), F.col(key).alias("found")).distinct())
    return docs.join(F.broadcast(rows) if bounded(rows) else rows, docs["doc_id"].cast("long").eqNullSafe(rows["of"]) & (docs[key] == rows["found"]), how)


def _kept(docs: DataFrame, judge: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """docs without the rows that judge(docs, key) rejects."""
    key = f"key_{uuid.uuid4().hex}"
    rows = _told_apart(docs, key)
    return _only(rows, judge(rows, key).where("not kept"), key, "left_anti").select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return _kept(docs, lambda rows, key: quality_rules.apply_rules(rows, (key,)))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within the limit of their language."""
    with small_batches(spark):
        return _kept(docs, lambda rows, key: kneser_ney.classify(rows, table(spark, sf_dir, "labels"), (key,)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of least doc_id, of those the one of least hash; rows
    without doc_id stay only where no row of the group has one.  Of rows that are equal in all columns one stays."""
    key = f"key_{uuid.uuid4().hex}"
    rows = _told_apart(docs, key)
    with small_batches(spark):
        found = cut(ngram_join.near_duplicates(rows, (key,)).select("doc_id", key, "class_key"))
    one = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", key)).alias("one")
    salted = found.withColumn("salt", salt_of(key, 64)).groupBy("class_key", "salt").agg(one, F.count("*").alias("n"))
    first = cut(salted.groupBy("class_key").agg(F.min("one").alias("one"), F.sum("n").alias("n")).select("one.*", "n"))
    gone = found.groupBy("doc_id", key).agg(F.count("*").alias("n")).join(first.drop("n").withColumnsRenamed({"doc_id": "of", key: "least"}), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col(key) == F.col("least")), "left")
    gone = cut(gone.select("doc_id", key, "n", F.col("least").isNotNull().alias("first")))
    kept = _only(rows, gone.where("not first"), key, "left_anti")
    twice = gone.where("first and n > 1")
    if not twice.isEmpty():  # equal rows, of which it doesn't matter which stays
        kept = _only(kept, twice, key, "left_anti").union(_only(kept, twice, key, "left_semi").dropDuplicates(["doc_id", key]))
    return kept.select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data generalised and disclosing terms removed."""
    return pii.sanitise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality), ("quality_classifier", classifier), ("near_duplicates", near_duplicates), ("pii", personal_data), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        with scope(spark):
            docs, path = written(stage(spark, docs, sf_dir))
        if last:
            remove(spark, last)
        last = path
    return docs
