"""Quality by the perplexity under an interpolated modified Kneser-Ney n-gram model of trusted text.

N-grams are ORDER bytes of UTF-8, packed into one number, so that a key is the n-gram itself.  They are counted over
all documents, with how often trusted ones have them.  Counts are sharded by n-gram and joined level by level with
those of their contexts and of the next shorter n-grams, which gives the probability of every n-gram that occurs; what
is gathered grows with the corpus.  The most frequent n-grams fill a look-up table of fixed size that every worker
gets; the others of each document, counted once for a stretch of text, are joined with the sharded probabilities.
A model finds its own training text too fluent.  So one of FOLDS parts of the trusted documents is held out of the
counts, and limits on perplexity are quantiles over that part, by language.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded, cut, salt_of, small

ORDER = 6
#: The look-up table: buckets, by a prime, and places in each; 13 MB.
BUCKETS, WAYS = 262_139, 4
#: One in so many trusted documents sets the limits.
FOLDS = 5
#: A document goes when its perplexity is beyond this quantile of its language's held-out documents, times MARGIN.
QUANTILE, MARGIN = 0.99, 1.15
#: and only if the whole text is so many nats less likely than it would be at that limit: a few odd words don't tell.
EVIDENCE = 20.0
#: A language's limit leans on the limit of all languages as if that were so many documents more.
WEIGHT = 10.0
#: Bytes of text that are looked up at once, and whose n-grams are counted before they leave a worker.
STRETCH, COUNTED = 1_000_000, 1_250_000
#: Joins by shuffle spread the rows of one language over so many parts.
SALTS = 64

TAIL = pa.list_(pa.struct([("gram", pa.int64()), ("n", pa.int64())]))


def stretches(texts: Iterable[str | None], size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The n-gram that ends at each byte of the texts, and the place of its text, for about size bytes at a time
    (STRETCH if none is given).

    A text begins after zeros.  A long one goes on in the next stretch with the bytes before it, so that its n-grams
    are the same however it is cut.
    """
    most = size or STRETCH
    gram = owner = None
    end = 0
    for k, text in enumerate(texts):
        data = np.frombuffer(b"\0" * (ORDER - 1) + (text or "").encode("utf-8", "replace"), np.uint8)
        for at in range(0, len(data) - ORDER + 1, most):
            part = data[at : at + most + ORDER - 1]
            n = len(part) - ORDER + 1
            if gram is None:  # a part fits in whatever is held; memory that isn't written to costs nothing
                gram, owner = np.empty(2 * most, np.int64), np.empty(2 * most, np.int32)
            mine = gram[end : end + n]
            mine[:] = part[:n]
            for j in range(1, ORDER):
                mine <<= 8
                mine |= part[j : j + n]
            owner[end : end + n] = k
            end += n
            if end >= most:
                out, gram, owner, mine, end = (gram[:end], owner[:end]), None, None, None, 0
                yield out
                del out
    if end:
        yield gram[:end], owner[:end]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        told = batch.column("counted").to_numpy(zero_copy_only=False)
        texts = (t for i in range(0, len(batch), 500) for t in batch.column("text")[i : i + 500].to_pylist())
        for gram, owner in stretches(texts, COUNTED):
            np.bitwise_or(gram, 1 << 8 * ORDER, out=gram, where=told[owner])
            gram.sort()
            first = np.append(0, np.flatnonzero(gram[1:] != gram[:-1]) + 1)
            u, n = gram[first], np.diff(first, append=len(gram))
            del gram, owner, first  # a worker holds little beside what it sends
            yield pa.RecordBatch.from_arrays([pa.array(u & (1 << 8 * ORDER) - 1), pa.array(n * (u >> 8 * ORDER)), pa.array(n)], names=["gram", "n_trusted", "n"])
            del u, n


def counts(docs: DataFrame) -> DataFrame:
    """gram, n_trusted (in documents that are counted), n (in all) of docs(text, counted)."""
    found = docs.select("text", "counted").mapInArrow(_count, "gram long, n_trusted long, n long")
    return found.groupBy("gram").agg(F.sum("n_trusted").alias("n_trusted"), F.sum("n").alias("n"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts of counts 1, 2, and 3 or more from the counts of counts; 0.5, 0.75, 0.9 where those don't tell."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1))


def _last(column: str, m: int) -> Column:
    """The last m bytes of a gram."""
    return F.col(column).bitwiseAND((1 << 8 * m) - 1)


def log_probabilities(grams: DataFrame) -> DataFrame:
    """gram, logp of each row of grams(gram, n_trusted): the log probability of its last byte after the others.

    A level's probability is the discounted share of the gram in its context, and the context's back-off weight times
    the probability of the gram without its first byte.  A context that was never counted leaves all to the next level.
    """
    seen, wanted = [None] * (ORDER + 1), [None] * (ORDER + 1)
    seen[ORDER] = grams.where("n_trusted > 0").select("gram", F.col("n_trusted").alias("n"))
    wanted[ORDER] = grams.select("gram")
    for m in range(ORDER - 1, 0, -1):  # a shorter gram counts by how many different bytes precede it
        seen[m] = cut(seen[m + 1].groupBy(_last("gram", m).alias("gram")).agg(F.count("*").alias("n")))
        wanted[m] = cut(wanted[m + 1].select(_last("gram", m).alias("gram")).distinct())
    below = None
    for m in range(1, ORDER + 1):
        of = seen[m].agg(*(F.coalesce(F.sum((F.col("n") == k).cast("long")), F.lit(0)) for k in (1, 2, 3, 4))).first()
        d1, d2, d3 = discounts(*of)
        off = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        mine = seen[m].select("gram", (F.col("n") - off).alias("left"))
        context = seen[m].groupBy(F.shiftright("gram", 8).alias("context")).agg(F.sum("n").alias("total"), F.sum(off).alias("off"))
        rows = wanted[m].join(mine, "gram", "left").withColumn("context", F.shiftright("gram", 8)).join(context, "context", "left")
        if below is None:
            rows, p = rows.withColumn("below", F.lit(1 / 256)), F.col("below")
        else:
            rows, p = rows.withColumn("suffix", _last("gram", m - 1)).join(below, "suffix"), F.col("below")
        p = F.when(F.col("total").isNull(), p).otherwise((F.coalesce("left", F.lit(0.0)) + F.col("off") * p) / F.col("total"))
        rows = cut(rows.select("gram", p.alias("p")))
        below = rows.select(F.col("gram").alias("suffix"), F.col("p").alias("below"))
    return rows.select("gram", F.log(F.greatest("p", F.lit(1e-300))).alias("logp"))


def look_up_table(grams: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Grams and log probabilities by place and bucket, of grams(gram, n, logp): in each bucket the most frequent."""
    order = Window.partitionBy("bucket").orderBy(F.desc("n"), "gram")
    top = grams.select("gram", "n", "logp", (F.col("gram") % BUCKETS).cast("int").alias("bucket")).withColumn("way", F.row_number().over(order) - 1).where(F.col("way") < WAYS)
    got = top.select("gram", "bucket", "way", F.col("logp").cast("float").alias("logp")).toArrow()  # BUCKETS * WAYS rows at most
    keys, logs = np.full((WAYS, BUCKETS), -1, np.int64), np.zeros((WAYS, BUCKETS), np.float32)
    at = got.column("way").to_numpy(), got.column("bucket").to_numpy()
    keys[at], logs[at] = got.column("gram").to_numpy(), got.column("logp").to_numpy()
    return keys, logs


def _score(held: Broadcast) -> Callable:
    """For each text, or stretch of it, its bytes, the log probability of n-grams in the table, and the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logs = held.value
        first = TaskContext.get().partitionId() << 40  # rows of the task so far
        for batch in batches:
            for i in range(0, len(batch), 1000):
                part = batch.slice(i, 1000)
                part = part.append_column("row", pa.array(np.arange(first, first + len(part))))
                first += len(part)
                rest, texts = [n for n in part.schema.names if n != "text"], part.column("text").to_pylist()
                none = part.take(pa.array([k for k, t in enumerate(texts) if not t], pa.int64()))
                numbers = pa.array(np.zeros(len(none), np.int64)), pa.array(np.zeros(len(none)))
                yield pa.RecordBatch.from_arrays([*(none.column(c) for c in rest), *numbers, pa.array([[]] * len(none), TAIL)], names=[*rest, "n_bytes", "total", "tail"])
                for gram, owner in stretches(texts):
                    docs, mine, size = np.unique(owner, return_inverse=True, return_counts=True)
                    total, bucket = np.zeros(len(docs)), gram % BUCKETS
                    for way in range(WAYS):
                        hit = keys[way][bucket] == gram
                        total += np.bincount(mine[hit], logs[way][bucket[hit]], len(docs))
                        gram, bucket, mine = gram[~hit], bucket[~hit], mine[~hit]
                    u, n = np.unique(mine.astype(np.int64) << 8 * ORDER | gram, return_counts=True)
                    ends = np.searchsorted(u >> 8 * ORDER, np.arange(len(docs) + 1))
                    tail = pa.StructArray.from_arrays([pa.array(u & (1 << 8 * ORDER) - 1), pa.array(n)], names=["gram", "n"])
                    tail = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), tail)
                    yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(docs)) for c in rest), pa.array(size), pa.array(total), tail], names=[*rest, "n_bytes", "total", "tail"])

    return run


def perplexities(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """One row for each row of docs(text, ...): its columns but for text, n_bytes, and perplexity for each byte, null
    for texts without bytes.  grams(gram, n, logp) are those of all docs."""
    held = docs.sparkSession.sparkContext.broadcast(look_up_table(grams))
    rest = [c for c in docs.columns if c != "text"]
    types = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest]
    parts = cut(docs.select(*rest, "text").mapInArrow(_score(held), ", ".join([*types, "row long, n_bytes long, total double, tail array<struct<gram:bigint,n:bigint>>"])))
    tail = parts.select("row", F.explode("tail").alias("t")).select("row", "t.gram", "t.n").join(grams.select("gram", "logp"), "gram")
    tail = tail.groupBy("row").agg(F.sum(F.col("n") * F.col("logp")).alias("more"))
    whole = parts.groupBy("row").agg(*(F.first(c).alias(c) for c in rest), F.sum("n_bytes").alias("n_bytes"), F.sum("total").alias("total"))
    total = F.col("total") + F.coalesce("more", F.lit(0.0))
    each = F.when(F.col("n_bytes") > 0, F.exp(-total / F.col("n_bytes")))
    return whole.join(tail, "row", "left").select(*rest, "n_bytes", each.alias("perplexity"))


def classify(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: doc_id, lang, perplexity, most (the limit of its language), trusted, kept.

    Trusted text is that of all documents labelled quality 1, with or without the fold that is held out by a hash of
    doc_id.  An empty or null text is kept (other rules judge length), as is everything where no trusted document is
    held out.  A null language is a language of its own.  Repeated labels of a document count once, trusted if any of
    them says so.  A row without doc_id is scored, never trusted; repeated rows are scored alike.  Columns named in
    carry are passed on, others ignored.
    """
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("good_id")).distinct()
    good = small(cut(good))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), *carry)
    base = base.join(good, F.col("doc_id") == F.col("good_id"), "left").withColumn("trusted", F.col("good_id").isNotNull()).drop("good_id")
    out_of = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)) == 0
    found = cut(counts(base.withColumn("counted", F.col("trusted") & ~out_of)))
    grams = cut(found.join(log_probabilities(found), "gram").select("gram", "n", "logp"))
    scored = cut(perplexities(base, grams))
    told = F.when(F.col("trusted") & out_of, F.log("perplexity"))
    quantile = F.percentile_approx(told, QUANTILE, 10_000)
    overall = scored.agg(quantile.alias("q")).first()["q"]
    limits = scored.groupBy("lang").agg(F.count(told).alias("n"), F.coalesce(quantile, F.lit(0.0)).alias("q"))
    most = F.exp((F.col("n") * F.col("q") + WEIGHT * F.lit(overall).cast("double")) / (F.col("n") + WEIGHT)) * MARGIN
    limits = cut(limits.select("lang", most.alias("most")))
    if bounded(limits):
        out = scored.join(F.broadcast(limits.withColumnRenamed("lang", "l")), F.col("lang").eqNullSafe(F.col("l")), "left")
    else:
        dealt = limits.withColumnRenamed("lang", "l").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = scored.withColumn("salt", salt_of("doc_id", SALTS)).join(dealt, F.col("lang").eqNullSafe(F.col("l")) & (F.col("salt") == F.col("s")), "left")
    kept = F.col("perplexity").isNull() | F.col("most").isNull() | (F.log("perplexity") - F.log("most") <= F.lit(EVIDENCE) / F.col("n_bytes"))
    return out.select("doc_id", "lang", *carry, "perplexity", "most", "trusted", kept.alias("kept"))
