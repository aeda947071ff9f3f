"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kneser_ney, media, ngram_join, packing, pieces, pii, quality_rules, secrets, sharding, url_filters
from .shared import scope, table, written

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(f):
    """Register f, whose result is written as a table of its own, so that those it cuts on the way can go."""

    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with scope(spark):
            return written(f(spark, sf_dir))[0]

    QUERIES[f.__name__] = run
    return run


def plain(f):
    """Register f, which cuts no tables."""
    QUERIES[f.__name__] = f
    return f


@query
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


@plain
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


@query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


@plain
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"), "doc_id")


ORACLE_SQL["op2_sharding"] = """
WITH RECURSIVE names AS (SELECT i, 'shard-' || lpad(i::VARCHAR, 2, '0') AS shard FROM range(64) t(i)),
shards AS (
    SELECT i, shard, ('0x' || substr(md5(shard || '/offset'), 1, 12))::BIGINT % 8191 AS o,
        ('0x' || substr(md5(shard || '/skip'), 1, 12))::BIGINT % 8190 + 1 AS s
    FROM names),
fill(turn, slot, bits) AS (
    SELECT -1::BIGINT, -1::BIGINT, repeat('0', 8191)::BIT
    UNION ALL
    SELECT turn + 1, pick, set_bit(bits, pick::INT, 1) FROM (
        SELECT f.turn, f.bits,
            list_filter(list_transform(range(8191), lambda j: (o + j * s) % 8191), lambda x: get_bit(f.bits, x::INT) = 0)[1] AS pick
        FROM fill f JOIN shards ON i = (f.turn + 1) % 64 WHERE f.turn < 8190)),
placed AS (SELECT doc_id, (('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT % 8191)::INT AS slot FROM documents)
SELECT doc_id, p.slot, shard FROM placed p LEFT JOIN fill f ON f.slot = p.slot LEFT JOIN shards ON i = f.turn % 64
"""


@query
def op4_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, sf_dir, "pages"))


@plain
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and a checksum of what they decode to."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    done = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), path), path)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_crc32", F.crc32(F.encode("text", "UTF-8")).alias("decoded_crc32"), "ids")


@query
def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector drawn as a picture; those whose id 50 divides are the queries."""
    found = media.find_copies(media.render(table(spark, sf_dir, "embeddings")), F.col("image_id") % 50 == 0)
    return found.withColumnRenamed("image_id", "vec_id")
