"""Near duplicates by Jaccard similarity of word n-grams.

Documents with the same set of n-grams form a class of copies, which gets a number and is compared once, whatever
doc_ids its rows have.  Classes meet in bands of MinHash values.  A bucket of k members is dealt into cells of at most
2 * BLOCK members, so that no group is ever in one task whole and nothing is capped.  In a cell, MinHash values
are compared step by step; a pair is dropped once the posterior probability that it reaches the threshold is
below the tolerance.  A pair that agrees in several bands belongs to the first of them alone.  What remains is
verified with the exact n-gram sets.  Cells pass pairs on as one bit each, and return counts and spanning edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded, cut, row_hash, salt_of

WORDS, THRESHOLD = 5, 0.8
#: MinHash values in BANDS bands of ROWS; a pair at 0.8 misses all bands with probability (1 - 0.8^5)^40 < 2e-7.
BANDS, ROWS = 40, 5
#: A pair is dropped when it reaches the threshold with less than this posterior probability.
TOLERANCE = 1e-6
#: MinHash values known at each step of the comparison.
STEPS = (40, 80, 120, 200)
#: Most members of one side of a cell.
BLOCK = 512
SALTS = 64
#: Word hashes that a worker keeps.
CACHE_WORDS = 200_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


class Grams:
    """Sets of hashed word n-grams (64 bits, sorted) of texts."""

    def __init__(self, n: int = WORDS):
        self.n, self.known = n, {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Words are what white space separates.  A text of fewer than n words is one n-gram; none: empty."""
        words = (text or "").split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        each = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = max(1, len(each) - self.n + 1)
        out = np.zeros(k, np.uint64)
        for i in range(min(self.n, len(each))):
            out = (out ^ each[i : i + k]) * _MIX
            out ^= out >> np.uint64(31)
        return np.unique(out)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    n = BANDS * ROWS
    return r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, n, dtype=np.uint64)


def minhash(grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    """The low 16 bits of each MinHash value, of 48-bit hashes."""
    best = np.full(len(a), np.uint64(2**64 - 1))
    for i in range(0, len(grams), 512):
        h = grams[i : i + 512, None] * a
        h += b
        np.minimum(best, h.min(axis=0), out=best)
    best ^= best >> np.uint64(29)  # the top bits of a minimum are all but constant
    best *= _MIX
    return (best >> np.uint64(48)).astype(np.uint16).tobytes()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams, (a, b) = Grams(), _permutations()
    for batch in batches:
        keys, sizes, sigs = [], [], []
        for i in range(0, len(batch), 500):
            for text in batch.column("text")[i : i + 500].to_pylist():
                g = grams(text)
                keys.append(xxhash.xxh3_128_digest(g.tobytes()))
                sizes.append(len(g))
                sigs.append(minhash(g, a, b))
        made = {"copy_key": pa.array(keys, pa.binary()), "size": pa.array(sizes, pa.int32()), "sig": pa.array(sigs, pa.binary())}
        rest = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), *made.values()], names=[*rest, *made])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams = Grams()
    for batch in batches:
        for i in range(0, len(batch), 500):
            part = batch.slice(i, 500)
            yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array([grams(t).tobytes() for t in part.column("text").to_pylist()], pa.binary())], names=["doc", "grams"])


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For each step of n values, the fewest matches with which P(similarity >= threshold | matches) is not below
    tolerance, under a uniform prior."""
    s = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in STEPS:
        for m in range(n + 1):
            like = m * np.log(s) + (n - m) * np.log1p(-s)
            like = np.exp(like - like.max())
            if like[s >= threshold].sum() >= tolerance * like.sum():
                break
        out.append(m)
    return out


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a cell follow each other, over batches too."""
    rest = None
    for pdf in batches:
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        cell = pdf["cell"].to_numpy()
        cuts = np.flatnonzero(cell[1:] != cell[:-1]) + 1
        starts = [0, *cuts]
        for i, j in zip(starts, cuts):
            if j - i > 1:
                yield pdf.iloc[i:j]
        rest = pdf.iloc[starts[-1] :].reset_index(drop=True)
    if rest is not None and len(rest) > 1:
        yield rest


def _prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each cell and member with a partner its place among those, and a bit for each of them that comes later and
    may be similar to it."""
    least = least_matches()
    found: list[tuple] = []

    def out():
        frame = pd.DataFrame(found, columns=["cell", "doc", "place", "partners"])
        found.clear()
        return frame

    for cell in _cells(batches):
        ids, size, side = cell["doc"].to_numpy(), cell["size"].to_numpy(), cell["side"].to_numpy()
        band = int(cell["band"].iloc[0])
        sig = np.frombuffer(b"".join(cell["sig"]), np.uint16).reshape(len(ids), BANDS * ROWS)
        crossed = bool((side != side[0]).any())
        partners: dict[int, np.ndarray] = {}
        paired = np.zeros(len(ids), bool)
        for i in range(len(ids) - 1):
            j = np.arange(i + 1, len(ids))
            ok = (np.minimum(size[i], size[j]) >= THRESHOLD * np.maximum(size[i], size[j])) & (ids[j] != ids[i])
            if crossed:
                ok &= side[j] != side[i]
            j, known, m = j[ok], 0, 0
            for step, enough in zip(STEPS, least):
                if not len(j):
                    break
                m = m + (sig[j, known:step] == sig[i, known:step]).sum(axis=1)
                j, m, known = j[m >= enough], m[m >= enough], step
            if band and len(j):
                before = (sig[j, : band * ROWS] == sig[i, : band * ROWS]).reshape(len(j), band, ROWS).all(axis=2).any(axis=1)
                j = j[~before]
            if len(j):
                partners[i] = j
                paired[i] = paired[j] = True
        key, place = int(cell["cell"].iloc[0]), np.cumsum(paired) - 1
        for i in np.flatnonzero(paired).tolist():
            bits = np.zeros(paired.sum() if i in partners else 0, bool)
            bits[place[partners.get(i, [])]] = True
            found.append((key, ids[i], int(place[i]), np.packbits(bits).tobytes()))
        if len(found) > 5_000:
            yield out()
    if found:
        yield out()


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Exact similarities of the pairs of a cell: links of each member, and a spanning edge of each."""
    found: list[tuple] = []
    for cell in _cells(batches):
        ids = cell["doc"].tolist()
        sets = [np.frombuffer(g, np.uint64) for g in cell["grams"]]
        links, root = [0] * len(ids), list(range(len(ids)))

        def top(x, root=root):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, partners in enumerate(cell["partners"]):
            if not partners:
                continue
            a = sets[i]
            js = np.flatnonzero(np.unpackbits(np.frombuffer(partners, np.uint8))).tolist()
            both = np.concatenate([sets[j] for j in js])
            where = np.minimum(np.searchsorted(a, both), len(a) - 1)
            ends = np.cumsum([0, *(len(sets[j]) for j in js)])
            common = np.concatenate([[0], np.cumsum(a[where] == both)])
            common = common[ends[1:]] - common[ends[:-1]]
            for j, c in zip(js, common):
                if c >= THRESHOLD * (len(a) + len(sets[j]) - c) - 1e-9:
                    links[i] += 1
                    links[j] += 1
                    x, y = top(i), top(j)
                    if x != y:
                        if ids[x] > ids[y]:
                            x, y = y, x
                        root[y] = x
        found += [(ids[k], links[k], ids[top(k)]) for k in range(len(ids)) if links[k]]
        if len(found) > 20_000:
            yield pd.DataFrame(found, columns=["doc", "links", "root"])
            found = []
    if found:
        yield pd.DataFrame(found, columns=["doc", "links", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component of edges(a, b), by alternating large and small
    stars.  The neighbours of a node meet in salted parts first, so that no hub is read by one task whole."""

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
        back = pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))
        n = (both.union(back) if large else both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))).withColumn("s", salt_of("v", SALTS))
        parts = n.groupBy("u", "s").agg(F.min("v").alias("p"))
        least = parts.groupBy("u").agg(F.least(F.min("p"), F.first("u")).alias("m"))
        met = n.join(parts.select("u", "s").join(least, "u"), ["u", "s"])
        if large:
            out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    now = cut(edges.select("a", "b").where("a <> b").distinct())
    state = None
    while True:
        now = cut(star(star(now, True), False))
        then, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == then:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: doc_id, class_id, copy_id, n_copies, n_links, class_key.

    copy_id is the least doc_id with the same n-gram set, n_copies how many rows have it, n_links how many other
    n-gram sets are similar to it, class_id the least doc_id that is connected by links.  Rows are told apart by what
    they say: one doc_id with several texts is in several classes, which class_key (a number for each) tells apart
    even where their least doc_id is the same.  Texts that are null or without words are copies of each other and have
    no links.  A row without doc_id counts as any other; ids are null where no row of the class has one.  Repeated
    rows count as copies.  Columns named in carry are passed on; others are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry).withColumn("text_key", row_hash("text"))
    kept = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry]
    signed = cut(docs.select("doc_id", "text", *carry, "text_key").mapInArrow(_sign, ", ".join(["doc_id long", *kept, "text_key long, copy_key binary, size int, sig binary"])))
    signed = signed.withColumn("salt", salt_of(F.xxhash64("doc_id", "text_key"), SALTS))
    one = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_key"))  # the row whose text stands for the class
    parts = signed.groupBy("copy_key", "salt").agg(one.alias("one"), F.max("size").alias("size"), F.count("*").alias("n_copies"), F.min("sig").alias("sig"))
    classes = parts.groupBy("copy_key").agg(F.min("one").alias("one"), F.max("size").alias("size"), F.sum("n_copies").alias("n_copies"), F.min("sig").alias("sig"))
    classes = cut(classes.select("*", F.monotonically_increasing_id().alias("doc")))  # numbers hold once they are written
    reps = classes.where("size > 0").select("doc", "size", "sig")

    keys = F.expr(f"transform(sequence(0, {BANDS - 1}), b -> xxhash64(b, substring(sig, b * {2 * ROWS} + 1, {2 * ROWS})))")
    banded = reps.select("doc", F.posexplode(keys).alias("band", "bucket"))
    sizes = banded.withColumn("s", salt_of("doc", SALTS)).groupBy("bucket", "s").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.sum("n").alias("n")).where("n > 1")
    members = cut(banded.join(sizes, "bucket").select("doc", "band", "bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    dealt = members.withColumn("side", F.pmod(F.xxhash64("doc", F.lit(7)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.xxhash64("bucket", F.least("side", "other"), F.greatest("side", "other"))
    cells = dealt.select(cell.alias("cell"), "doc", "band", "side").join(reps, "doc")
    pruned = cut(cells.repartition("cell").sortWithinPartitions("cell").mapInPandas(_prune, "cell long, doc long, place int, partners binary"))

    wanted = cut(pruned.select("doc").distinct().join(classes.select("doc", "one"), "doc").select("doc", F.col("one.doc_id").alias("of"), F.col("one.text_key").alias("key")))
    met = docs.join(F.broadcast(wanted) if bounded(wanted) else wanted, docs["doc_id"].eqNullSafe(wanted["of"]) & (docs["text_key"] == wanted["key"]))
    sets = met.select("doc", "text").mapInArrow(_sets, "doc long, grams binary")
    if signed.groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count():
        sets = sets.dropDuplicates(["doc"])  # only where rows are repeated
    met = pruned.join(sets, "doc").select("cell", "doc", "place", "partners", "grams").repartition("cell").sortWithinPartitions("cell", "place")
    checked = cut(met.select("cell", "doc", "partners", "grams").mapInPandas(_verify, "doc long, links long, root long"))
    links = checked.groupBy("doc").agg(F.sum("links").alias("n_links"))
    roots = components(checked.select(F.col("doc").alias("a"), F.col("root").alias("b")))

    classes = classes.select("copy_key", "doc", F.col("one.doc_id").alias("copy_id"), "n_copies")
    classes = classes.join(links, "doc", "left").join(roots, F.col("doc") == F.col("node"), "left").withColumn("class_key", F.coalesce("root", "doc")).withColumn("s", salt_of("doc", SALTS))
    named = classes.groupBy("class_key", "s").agg(F.min("copy_id").alias("class_id")).groupBy("class_key").agg(F.min("class_id").alias("class_id"))
    dealt = named.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))) if not bounded(named) else F.broadcast(named)
    classes = classes.join(dealt, ["class_key", "s"] if "s" in dealt.columns else ["class_key"])
    classes = classes.select("copy_key", "class_id", "copy_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "class_key")
    named = cut(parts.select("copy_key", "salt").join(classes, "copy_key"))
    out = signed.select("doc_id", *carry, "copy_key", "salt").join(named, ["copy_key", "salt"])
    return out.select("doc_id", *carry, "class_id", "copy_id", "n_copies", "n_links", "class_key")
