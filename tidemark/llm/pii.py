"""Personal data: fixed patterns, then information-theoretic sanitisation.

The values that the patterns find, and what such values share, are the protected entities.  Terms are counted over
whole documents: in how many a term occurs with an entity, and in how many of the whole corpus.  A term discloses an
entity when its pointwise mutual information with it comes to a given share of the entity's information content,
PMI(e; t) >= DISCLOSURE * -log p(e), with mentions in enough different contexts that copies of one passage don't tell.
Such terms are removed wherever they stand in a document that mentions the entity, and the values are generalised to
their kind.  Only DataFrame expressions; texts are read for spans, for term frequencies, and those with entities again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded, cut, let, salt_of, small
from .spans import count, disjoint, listed, matches, paragraphs, piece, replaced

KINDS = ["email", "ip", "card", "phone", "term"]
LABELS = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]"]
#: Share of an entity's information content that a term may not give away.
DISCLOSURE = 0.9
#: Different contexts of mentions in whose documents a term must occur.
LEAST_CONTEXTS = 3
#: Code points before and after a mention by which contexts are told apart.
AROUND = 60
TERM = r"[\p{L}\p{N}]{2,}"
#: Entities of a document that its terms meet at once.
PART = 256
#: Parts over which the rows of one entity and term are spread.
SALTS = 64

_LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def _luhn(value: Column) -> Column:
    def check(d: Column) -> Column:
        n = F.char_length(d)

        def add(total: Column, i: Column) -> Column:
            digit = F.substring(d, i, F.lit(1)).cast("int")
            return let(F.when((n - i) % 2 == 1, digit * 2).otherwise(digit), lambda v: total + F.when(v > 9, v - 9).otherwise(v))

        return F.when(n.between(13, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))

    return let(_digits(value), check)


def base_spans(text: Column) -> Column:
    """Spans of e-mail addresses, IP addresses, card numbers and phone numbers, by kind, then start."""
    email = matches(text, EMAIL, 0, "@")
    ip = F.filter(matches(text, IP, 1, r"[0-9]\.[0-9]"), lambda s: s["value"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))
    card = F.filter(matches(text, CARD, 2, r"[0-9](?:[\x20-]?[0-9]){12}"), lambda s: _luhn(s["value"]))
    phone = F.filter(matches(text, PHONE, 3, r"\+[0-9]"), lambda s: F.char_length(_digits(s["value"])).between(9, 15))
    return F.concat(email, ip, card, phone)


def _entities(spans: Column, text: Column) -> Column:
    """The entities that spans mention, each with a hash of the text around its mention: the value; and what values
    share, so that rare ones have statistics too: person and host of an address, the first three parts of an IP, the
    first six digits of a card or phone."""

    def named(s: Column, held: Column) -> Column:
        value = F.lower(s["value"])
        six = F.substring(_digits(value), 1, 6)
        shared = F.when(s["kind"] == 0, F.array(F.concat(F.lit("person "), F.substring_index(value, "@", 1)), F.concat(F.lit("host "), F.substring_index(value, "@", -1))))
        shared = shared.when(s["kind"] == 1, F.array(F.concat(F.lit("net "), F.substring_index(value, ".", 3)))).otherwise(F.array(F.concat(F.get(F.array(*map(F.lit, KINDS)), s["kind"]), F.lit(" "), six)))
        around = F.xxhash64(piece(held, F.greatest(s["start"] - AROUND, F.lit(0)), s["start"]), piece(held, s["end"], s["end"] + AROUND))
        return F.transform(F.concat(F.array(F.concat(F.lit("value "), value)), shared), lambda e: F.struct(F.xxhash64(e).alias("entity"), around.alias("context")))

    empty = F.array().cast("array<struct<entity:bigint,context:bigint>>")
    every = let(paragraphs(text), lambda held: F.flatten(F.transform(spans, lambda s: named(s, held))))
    return F.when(F.size(spans) > 0, every).otherwise(empty)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and a key that tells rows apart even where doc_id is missing or repeated."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("doc"), text.alias("text"))


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _found(docs: DataFrame, base: Column) -> DataFrame:
    """doc_id, doc, spans and entities of each row."""
    both = let(base, lambda s: F.struct(_plain(s).alias("spans"), _entities(s, F.col("text")).alias("entities")))
    return cut(_keyed(docs).select("doc_id", "doc", both.alias("f")).select("doc_id", "doc", "f.spans", "f.entities"))


def _only(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of _keyed(docs) whose doc is in keys; where those are few, texts aren't shuffled."""
    return _keyed(docs).join(small(keys), "doc", "left_semi")


def _outside(text: Column, base: Column) -> Column:
    """Terms of a text, with places, that lie in no span of base, those of the fixed patterns."""
    masked = let(base, lambda s: F.when(F.size(s) > 0, replaced(text, disjoint(s))).otherwise(text))
    return let(masked, lambda m: matches(m, TERM, 4))


def disclosing(docs: DataFrame, found: DataFrame, outside: Column) -> tuple[DataFrame, DataFrame]:
    """entity, term, pmi, information: the terms that give entities away; and doc, entity: who mentions which.
    outside: what _outside() makes of a text.

    Co-occurrence is of whole documents.  Entities with too few contexts have no such terms.  Of the others' documents
    all terms are taken whose count over the corpus could do for any entity; those meet the entities of their document,
    a document with many of them in parts, and are counted before they are shuffled.
    """
    n = docs.count()
    mentions = found.where(F.size("entities") > 0).select("doc", F.explode("entities").alias("e")).select("doc", "e.entity", "e.context")
    held = mentions.groupBy("doc", "entity").agg(F.min("context").alias("context"))
    told_by = held.groupBy("entity", "context").agg(F.count("*").alias("n")).groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count("*").alias("contexts"))
    information = F.log(F.lit(float(n)) / F.col("n_entity"))
    entities = cut(told_by.where((F.col("contexts") >= LEAST_CONTEXTS) & (F.col("n_entity") < n)).select("entity", "n_entity", information.alias("information")))
    known = entities.select("entity")
    if bounded(known):
        held = held.join(F.broadcast(known), "entity", "left_semi")
    else:  # an entity that many documents mention is spread
        dealt = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        held = held.withColumn("salt", salt_of("doc", SALTS)).join(dealt, ["entity", "salt"], "left_semi").drop("salt")
    held = cut(held)
    keys = cut(held.groupBy("doc").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")))
    lower = F.transform(outside, lambda t: F.lower(t["value"]))
    terms = cut(_only(docs, keys.select("doc")).select("doc", F.explode(F.array_distinct(lower)).alias("term")).distinct())
    wanted = cut(terms.groupBy("term").agg(F.count("*").alias("n_near")).where(F.col("n_near") >= LEAST_CONTEXTS))
    each = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(TERM), F.lit(0)))).alias("term"))
    if bounded(wanted):
        each = each.join(F.broadcast(wanted.select("term")), "term", "left_semi")
    counted = each.groupBy("term").agg(F.count("*").alias("n_term")).join(wanted, "term")
    # p(e | t) >= p(e) ** (1 - DISCLOSURE), and an entity is in LEAST_CONTEXTS documents at least
    counted = cut(counted.where(F.col("n_near") / F.col("n_term") >= (LEAST_CONTEXTS / max(n, LEAST_CONTEXTS)) ** (1 - DISCLOSURE)).select("term", "n_term"))
    few = bounded(counted)
    terms = terms.join(F.broadcast(counted) if few else counted, "term", "left_semi").join(keys, "doc")
    dealt = terms.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("doc", "term", "part")
    parts = held.join(keys, "doc").withColumn("part", F.pmod(F.xxhash64("entity"), F.col("parts")).cast("int")).select("doc", "entity", "context", "part")
    pairs = dealt.join(parts, ["doc", "part"]).groupBy("entity", "term", "context").agg(F.count("*").alias("n"))
    pairs = pairs.groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("contexts")).where(F.col("contexts") >= LEAST_CONTEXTS)
    pmi = F.log(F.least("n_both", "n_term") * F.lit(float(n)) / (F.col("n_entity") * F.col("n_term")))
    told = pairs.join(entities, "entity").join(counted, "term").select("entity", "term", pmi.alias("pmi"), "information")
    return told.where((F.col("information") > 0) & (F.col("pmi") >= DISCLOSURE * F.col("information"))), held


def added_spans(docs: DataFrame, base: Column) -> tuple[DataFrame, DataFrame]:
    """What _found() gives; and doc and the spans of disclosing terms, wherever they stand in a document that mentions
    the entity.  base is base_spans(F.col("text")), which callers build once: each time takes thousands of calls
    and tens of megabytes of the driver."""
    found, outside = _found(docs, base), _outside(F.col("text"), base)
    told, held = disclosing(docs, found, outside)
    told = cut(told.select("entity", "term"))
    if bounded(told):
        hits = held.join(F.broadcast(told), "entity")
    else:
        dealt = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = held.withColumn("salt", salt_of("doc", SALTS)).join(dealt, ["entity", "salt"])
    hits = cut(hits.select("doc", "term").distinct())
    places = _only(docs, hits.select("doc").distinct()).select("doc", F.explode(outside).alias("t")).select("doc", F.lower("t.value").alias("term"), "t.start", "t.end")
    span = F.struct(F.lit(4).alias("kind"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    hits = F.broadcast(hits) if bounded(hits) else hits
    return found, cut(places.join(hits, ["doc", "term"], "left_semi").select("doc", span.alias("span")).distinct().groupBy("doc").agg(F.array_sort(F.collect_list("span")).alias("added")))


def find(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, spans (of the fixed patterns) and added (of disclosing terms).

    A null text is empty.  Rows without doc_id, or with one that others have, are judged by their own text; repeated
    rows get the same spans.  Other columns are ignored.
    """
    found, added = added_spans(docs, base_spans(F.col("text")))
    empty = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return found.join(small(added, elements=F.size("added")), "doc", "left").select("doc_id", "spans", F.coalesce("added", empty).alias("added"))


def report(docs: DataFrame) -> DataFrame:
    """find() as counts by kind, a digest of the base spans, and all spans as text."""
    counts = [count(F.col("spans"), k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return find(docs).select("doc_id", *counts, F.sha2(listed(F.col("spans"), KINDS), 256).alias("base_sha256"), listed(F.concat("spans", "added"), KINDS).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with personal data in text generalised to its kind and disclosing terms to [TERM]; n_chars follows
    where there is one.  All other columns stay as they are; a null text stays null."""
    key, at, extra = (f"_{name}_{uuid.uuid4().hex}" for name in ("key", "at", "extra"))
    base = base_spans(F.col("text"))
    added = added_spans(docs, base)[1].select(F.col("doc").alias(at), F.col("added").alias(extra))
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    joined = keyed.join(small(added, elements=F.size(extra)), F.col(key) == F.col(at), "left")
    plain = _plain(base)
    every = F.concat(plain, F.coalesce(extra, F.array().cast("array<struct<kind:int,start:int,end:int>>")))
    clean = let(every, lambda s: F.when(F.size(s) == 0, F.col("text")).otherwise(replaced(F.col("text"), disjoint(s), LABELS)))
    out = joined.withColumn("text", F.when(F.col("text").isNotNull(), clean))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
