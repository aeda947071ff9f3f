"""Secrets in text: fixed patterns, then random strings told from identifiers by two character Markov models.

Both models are trained from labelled samples: first-order transition probabilities, smoothed by the frequency of
the following character.  A long run of key characters is a secret when it is sufficiently more likely under the
model of random strings.  The ratio of the models is a table of fixed size (pairs of characters), folded into the
plan as a constant.  Only DataFrame expressions; the text is read once and nothing is shuffled.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import let
from .spans import count, listed, matches, scan

KINDS = ["assign", "access", "hex", "random"]
#: Characters of keys; anything else, and the border of a string, counts as one more.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIZE = len(ALPHABET) + 1
#: A run of key characters is looked at from this length on.
LEAST_RUN = 20
#: Log-likelihood ratio from which a run is a secret: e^10 to one.
LEAST_RATIO = 10.0
#: Weight of the following character's own frequency in a transition.
SMOOTHING = 8.0
#: Samples of each label that default_samples makes.
SAMPLES = 4_000

_KEY = r"(?i:password|passwd|secret|token|api_?key)"
ASSIGN = _KEY + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
VALUE = "^" + _KEY + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS, HEX = "AKIA[A-Z0-9]+", "[0-9a-f]{24,}"
RUN = rf"[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}"

#: Words that identifiers are made of.
WORDS = """account action active address admin amount answer array article author backup balance batch before block
body branch buffer build button cache callback category center change channel child client close cloud cluster code
color column command comment commit config connection container content context control count country create current
customer data date default delete detail device direction display document domain download driver element email enable
entry error event example export factory feature field file filter first folder format frame function gateway global
group handler hash header height history host image import index input install instance integer invoice item journal
kernel label language last layer layout length level library limit line link list local location login manager mapping
master member memory message method metric minute model module monitor month name network node note number object
offset option order output owner package page panel parameter parent partition path payment picture platform player
point policy position post price process product profile project property protocol provider query queue range record
region register release remote report request resource response result return role root router sample schedule schema
screen script search section select sequence server service session setting shape source stack start state status
storage store stream string style summary support system table target task template text theme thread time title
""".split()


def default_samples(spark: SparkSession) -> DataFrame:
    """text, secret: random strings cut from digests in four alphabets, and identifiers of two to five words."""
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 512)
    b64 = F.regexp_replace(F.base64(F.unhex(digest)), r"[\s=]", "")
    plain = F.regexp_replace(b64, "[+/]", "")
    texts = [F.substring(b64, 1, 40), F.substring(plain, 1, 36), F.substring(digest, 1, 40), F.substring(F.upper(plain), 1, 24)]
    random = F.when(F.col("id") % 4 == 0, texts[0]).when(F.col("id") % 4 == 1, texts[1]).when(F.col("id") % 4 == 2, texts[2]).otherwise(texts[3])
    words = F.array(*map(F.lit, WORDS))
    chosen = F.transform(F.sequence(F.lit(1), F.col("id") % 4 + 2), lambda k: F.get(words, F.pmod(F.xxhash64("id", k), F.lit(len(WORDS))).cast("int")))
    kind = F.col("id") % 5
    camel = F.array_join(F.transform(chosen, lambda w, i: F.when(i > 0, F.initcap(w)).otherwise(w)), "")
    name = F.when(kind == 0, F.array_join(chosen, "_")).when(kind == 1, F.array_join(chosen, "-")).when(kind == 2, camel).when(kind == 3, F.upper(F.array_join(chosen, "_"))).otherwise(F.array_join(chosen, "/"))
    name = F.when(F.col("id") % 7 == 0, F.concat(name, F.lit("-"), (F.col("id") % 1000).cast("string"))).otherwise(name)
    ids = spark.range(SAMPLES)
    return ids.select(random.alias("text"), F.lit(True).alias("secret")).union(ids.select(name.alias("text"), F.lit(False).alias("secret")))


def _places(text: Column) -> Column:
    """The characters' places in the alphabet, 0 for any other, with a border on both sides."""
    inner = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return F.concat(F.array(F.lit(0)), inner, F.array(F.lit(0)))


def train(samples: DataFrame) -> list[float]:
    """The log of how much likelier each transition is in secrets, as a table of SIZE * SIZE entries.

    samples: text and secret (boolean); null texts or labels don't count.
    """
    placed = samples.where("text is not null and secret is not null").select("secret", _places(F.col("text")).alias("p"))
    pairs = placed.select("secret", F.explode(F.expr("transform(sequence(1, size(p) - 1), i -> struct(get(p, i - 1) AS a, get(p, i) AS b))")).alias("x"))
    counts = pairs.groupBy("secret", F.col("x.a").alias("a"), F.col("x.b").alias("b")).agg(F.count("*").alias("n"))
    grid = samples.sparkSession.range(2 * SIZE * SIZE).select(
        (F.col("id") % 2 == 1).alias("secret"), F.expr(f"cast(id div 2 div {SIZE} as int)").alias("a"), F.expr(f"cast((id div 2) % {SIZE} as int)").alias("b")
    )
    full = grid.join(counts, ["secret", "a", "b"], "left").fillna(0, ["n"])
    own = full.groupBy("secret", "b").agg((F.sum("n") + 0.5).alias("nb"))
    total = own.groupBy("secret").agg(F.sum("nb").alias("all"))
    before = full.groupBy("secret", "a").agg(F.sum("n").alias("na"))
    share = full.join(own, ["secret", "b"]).join(total, "secret").join(before, ["secret", "a"])
    share = share.select("secret", "a", "b", F.log((F.col("n") + SMOOTHING * F.col("nb") / F.col("all")) / (F.col("na") + SMOOTHING)).alias("log"))
    ratio = share.groupBy("a", "b").agg(F.sum(F.when(F.col("secret"), F.col("log")).otherwise(-F.col("log"))).alias("ratio"))
    return [r["ratio"] for r in ratio.orderBy("a", "b").collect()]  # SIZE * SIZE rows


def ratio(text: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of text: random string against identifier."""
    logs = F.from_json(F.lit(json.dumps([round(x, 6) for x in table])), "array<double>")

    def total(p: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(0.0), lambda a, i: a + F.get(logs, F.get(p, i - 1) * SIZE + F.get(p, i)))

    return let(_places(text), total)


def base_spans(text: Column) -> Column:
    """Spans of assignments of secrets, access keys and long hexadecimal strings, by start, then kind."""
    assign = F.filter(matches(text, ASSIGN, 0, _KEY), lambda s: F.char_length(F.regexp_extract(s["value"], VALUE, 1)) >= 6)
    access = F.filter(matches(text, ACCESS, 1, "AKIA"), lambda s: F.char_length(s["value"]) >= 20)
    return F.concat(assign, access, matches(text, HEX, 2))


def _ordered(spans: Column) -> Column:
    return F.transform(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )


def _clear(runs: Column, base: Column) -> Column:
    """The runs that overlap no span of base: both in one order, no base span before reaches into a run and none after
    begins in it."""

    def told(both: Column) -> Column:
        ends = scan(both, F.lit(-1), lambda at, x: F.when(x["run"] < 0, F.greatest(at, x["end"])).otherwise(at))
        starts = F.reverse(scan(F.reverse(both), F.lit(2**31 - 1), lambda at, x: F.when(x["run"] < 0, x["start"]).otherwise(at)))
        clear = let(ends, lambda e: let(starts, lambda s: F.filter(both, lambda x, j: (x["run"] >= 0) & (F.get(e, j) <= x["start"]) & (F.get(s, j) >= x["end"]))))
        return F.transform(clear, lambda x: F.get(runs, x["run"]))

    places = F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(-1).alias("run"), b["end"].alias("end")))
    places = F.concat(places, F.transform(runs, lambda r, i: F.struct(r["start"].alias("start"), i.alias("run"), r["end"].alias("end"))))
    return F.when((F.size(runs) == 0) | (F.size(base) == 0), runs).otherwise(let(F.array_sort(places), told))


def find(docs: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, spans (of the fixed patterns) and added (random strings beside them).

    samples: labelled strings as for train(); by default those of default_samples().  A null text is empty.
    Repeated rows get the same spans; other columns are ignored.
    """
    table = train(samples if samples is not None else default_samples(docs.sparkSession))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def both(base: Column) -> Column:
        runs = let(matches(F.col("text"), RUN, 3), lambda found: _clear(found, base))
        return F.struct(_ordered(base).alias("spans"), _ordered(F.filter(runs, lambda r: ratio(r["value"], table) >= LEAST_RATIO)).alias("added"))

    return rows.select("doc_id", let(base_spans(F.col("text")), both).alias("f")).select("doc_id", "f.spans", "f.added")


def report(docs: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """find() as counts by kind, a digest of the base spans, and all spans as text."""
    counts = [count(F.col("spans"), k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])]
    every = _ordered(F.concat("spans", "added"))
    return find(docs, samples).select("doc_id", *counts, F.sha2(listed(F.col("spans"), KINDS), 256).alias("base_sha256"), listed(every, KINDS).alias("spans"))
