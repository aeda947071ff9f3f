"""Copies of images, cropped or edited ones too, by local descriptors.

Corners are found at several scales.  Each gets a direction, from its neighbourhood's centre of brightness, and 256
binary tests turned into that direction.  Tables of key bits, probed with each bit turned, bring descriptors within a
small Hamming distance together: the queries' in blocks of bounded size, each against all images where they lie, so
that no image is shuffled and one that many share is work for all tasks.  Matches vote for the similarity transform
that they imply, and a pair of images stands when enough corners agree on one.  Images of the same bytes are one;
queries are searched against all images.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded, cut

#: Scales of the image; at each, every corner above this response is kept.
SCALES, RESPONSE = (1.0, 0.7, 0.5), 1e-3
#: Half width of the patch of the binary tests, and of the neighbourhood of the direction.
REACH, DISC = 13, 9
#: Each table's key is a word of so many tests, and words that differ in one test meet too: within distance 19 two
#: descriptors always meet; of those whose tests differ at random, 97 of 100 do at 28 and 77 of 100 at 36.
TABLES, BITS = 10, 24
#: Hamming distance of matching descriptors; corners that must agree on a transform.
DISTANCE, VOTES = 36, 5
#: How far transforms may be apart that agree: radians, logarithm of scale, pixels.
TURN, ZOOM, SHIFT = 0.5, 0.4, 20.0
#: How many pixels corners may then be off the transforms that are fitted in turn.
SLIPS = (8.0, 4.0, 3.0)
#: Corners of queries that are searched at once, and meetings that are compared at once.
BLOCK, MEETINGS = 20_000, 500_000
SALTS = 32
#: Side of the grid of random numbers that a texture of render() is drawn from.
GRAIN = 32


def read_image(data: bytes | None) -> np.ndarray | None:
    """Brightness of a binary PGM or PPM image of 8 bits; None for anything else."""
    if not data or data[:2] not in (b"P5", b"P6"):
        return None
    try:
        head, at = [], 2
        while len(head) < 3:
            while data[at : at + 1].isspace():
                at += 1
            end = at
            while not data[end : end + 1].isspace():
                end += 1
                if end > len(data):
                    return None
            if data[at : at + 1] == b"#":
                at = data.index(b"\n", at) + 1
                continue
            head.append(int(data[at:end]))
            at = end
        width, height, _ = head
        depth = 3 if data[1:2] == b"6" else 1
        pixels = np.frombuffer(data, np.uint8, width * height * depth, at + 1).reshape(height, width, depth)
    except ValueError:
        return None
    return pixels.astype(np.float32).mean(axis=2) if width and height else None


def write_image(pixels: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + np.clip(np.rint(pixels), 0, 255).astype(np.uint8).tobytes()


def resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear."""
    y, x = (np.arange(height) + 0.5) * a.shape[0] / height - 0.5, (np.arange(width) + 0.5) * a.shape[1] / width - 0.5
    y, x = np.clip(y, 0, a.shape[0] - 1), np.clip(x, 0, a.shape[1] - 1)
    i, j = np.minimum(y.astype(int), max(a.shape[0] - 2, 0)), np.minimum(x.astype(int), max(a.shape[1] - 2, 0))
    i2, j2 = np.minimum(i + 1, a.shape[0] - 1), np.minimum(j + 1, a.shape[1] - 1)
    v, u = (y - i)[:, None], (x - j)[None, :]
    return (a[i][:, j] * (1 - v) + a[i2][:, j] * v) * (1 - u) + (a[i][:, j2] * (1 - v) + a[i2][:, j2] * v) * u


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Mean over squares of side 2 r + 1, edges repeated."""
    p = np.pad(a, ((r + 1, r), (r + 1, r)), mode="edge").cumsum(0, dtype=np.float64).cumsum(1)
    n = 2 * r + 1
    return (p[n:, n:] - p[:-n, n:] - p[n:, :-n] + p[:-n, :-n]) / n**2


def _pattern() -> np.ndarray:
    """Pairs of points of the binary tests, as (256, 2, 2) of x and y."""
    r = np.random.default_rng(41)
    points = r.normal(0, REACH / 2.2, (4000, 2, 2))
    return points[(np.hypot(points[..., 0], points[..., 1]) < REACH - 1).all(axis=1)][:256]


PATTERN = _pattern()
_Y, _X = np.nonzero((np.mgrid[-DISC : DISC + 1, -DISC : DISC + 1] ** 2).sum(axis=0) <= DISC**2)
_Y, _X = _Y - DISC, _X - DISC


def describe(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x, y, angle, scale of corners, and their tests as (n, 256) of booleans."""
    places, tests = [np.empty((0, 4))], [np.empty((0, 256), bool)]
    for scale in SCALES:
        h, w = round(image.shape[0] * scale), round(image.shape[1] * scale)
        if min(h, w) < 2 * REACH + 3:
            continue
        a = image if scale == 1 else resize(image, h, w)
        s = _box(a, 1)
        gy, gx = np.gradient(s)
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        corner = xx * yy - xy * xy - 0.04 * (xx + yy) ** 2
        peak = corner.copy()
        for axis in (0, 1):
            line = peak.copy()
            for d in (-2, -1, 1, 2):
                np.maximum(peak, np.roll(line, d, axis), out=peak)
        inside = np.zeros_like(corner, bool)
        inside[REACH : h - REACH, REACH : w - REACH] = True
        y, x = np.nonzero((corner == peak) & inside & (corner > RESPONSE))
        if not len(y):
            continue
        disc = a[y[:, None] + _Y, x[:, None] + _X]
        disc = disc - disc.mean(axis=1, keepdims=True)
        angle = np.arctan2((disc * _Y).sum(axis=1), (disc * _X).sum(axis=1))
        c, sn = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
        px = np.rint(x[:, None, None] + PATTERN[..., 0] * c - PATTERN[..., 1] * sn).astype(int)
        py = np.rint(y[:, None, None] + PATTERN[..., 0] * sn + PATTERN[..., 1] * c).astype(int)
        smooth = _box(a, 2)
        seen = smooth[py, px]
        tests.append(seen[..., 0] < seen[..., 1])
        places.append(np.stack([(x + 0.5) / scale, (y + 0.5) / scale, angle, np.full(len(x), 1 / scale)], axis=1))
    return np.concatenate(places), np.concatenate(tests)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row its number, a digest of the image, the corners as 4 floats each, and their tests as 4 words of 64
    bits.  Of rows with the same bytes the first of a batch is described."""
    first = TaskContext.get().partitionId() << 40
    for batch in batches:
        seen: set[bytes] = set()
        for i in range(0, len(batch), 250):
            part = batch.slice(i, 250)
            keys, places, words = [], [], []
            for data in part.column("image").to_pylist():
                key = None if data is None else hashlib.sha256(data).digest()
                image = read_image(data) if key not in seen else None
                p, t = describe(image) if image is not None else ((), ())
                seen.add(key)
                keys.append(key)
                places.append(p.astype(np.float32).tobytes() if len(p) else None)
                words.append(np.packbits(t, axis=1).tobytes() if len(p) else None)
            made = [pa.array(np.arange(first, first + len(part))), *(pa.array(x, pa.binary()) for x in (keys, places, words))]
            first += len(part)
            yield pa.RecordBatch.from_arrays([part.column("image_id"), part.column("asked"), *made], names=["image_id", "asked", "row", "image_key", "places", "words"])


def _keys(words: np.ndarray) -> list[np.ndarray]:
    """The word of each table."""
    b = words.view(np.uint8).reshape(len(words), 32).astype(np.int32)
    return [b[:, 3 * t] << 16 | b[:, 3 * t + 1] << 8 | b[:, 3 * t + 2] for t in range(TABLES)]


def _tables(words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each table which keys are there, all keys in order, and the descriptor of each."""
    turned = np.array([0, *(1 << i for i in range(BITS))], np.int32)
    out = []
    for key in _keys(words):
        every = (key[:, None] ^ turned).reshape(-1)
        order = np.argsort(every, kind="stable")
        there = np.zeros(1 << BITS, bool)
        there[every] = True
        out.append((np.packbits(there), every[order], (order // len(turned)).astype(np.int32)))
    return out


def matches(tables: list, wanted: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of descriptors of wanted, whose tables are given, and of words that meet within DISTANCE, each once."""
    found = [np.empty(0, np.int64)]
    for (there, keys, which), key in zip(tables, _keys(words)):
        row = np.flatnonzero(there[key >> 3] >> (7 - (key & 7)).astype(np.uint8) & 1)
        low = np.searchsorted(keys, key[row])
        n = np.searchsorted(keys, key[row], "right") - low
        ends = np.cumsum(n)
        at = 0
        while at < len(row):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MEETINGS, "right")))
            m = n[at:to]
            place = np.repeat(low[at:to] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            q, r = which[place], np.repeat(row[at:to], m)
            near = np.bitwise_count(wanted[q] ^ words[r]).sum(axis=1, dtype=np.int32) <= DISTANCE
            found.append(q[near].astype(np.int64) * len(words) + r[near])
            at = to
    pairs = np.unique(np.concatenate(found))
    return pairs // max(1, len(words)), pairs % max(1, len(words))


def least_votes(q: np.ndarray) -> float:
    """VOTES, or where very many corners match, eight times the matches that chance puts where a transform does."""
    area = max(1.0, float(np.prod(q[:, :2].max(axis=0) - q[:, :2].min(axis=0))))
    return max(VOTES, 3 + 8 * len(q) * np.pi * SLIPS[-1] ** 2 / area)


def agreeing(q: np.ndarray, p: np.ndarray, mine: np.ndarray, theirs: np.ndarray) -> int:
    """The most corners, different ones on both sides, whose matches agree with one transform.

    Matches, places q and p, that are about the transform of one match are fitted by least squares, and so again are
    those that the fit puts right, ever more closely.  0 if they are too few to tell from chance.
    """
    turn, zoom = q[:, 2] - p[:, 2], np.log(q[:, 3] / p[:, 3])
    x, y = p[:, 0] + 1j * p[:, 1], q[:, 0] + 1j * q[:, 1]
    right, down = (lambda z: (z.real, z.imag))(y - np.exp(zoom + 1j * turn) * x)
    order = np.argsort(right)  # a match is compared with those whose shift is near
    x, y, turn, zoom, mine, theirs, right, down = (v[order] for v in (x, y, turn, zoom, mine, theirs, right, down))
    by_mine, by_theirs = np.argsort(mine, kind="stable"), np.argsort(theirs, kind="stable")
    of_mine, of_theirs = np.flatnonzero(np.diff(mine[by_mine], prepend=-1)), np.flatnonzero(np.diff(theirs[by_theirs], prepend=-1))
    step, most, need, enough = max(1, 1_000_000 // len(q)), 0, least_votes(q), []
    for i in range(0, len(q), 100):
        one = slice(i, i + 100)
        c = slice(np.searchsorted(right, right[i] - SHIFT), np.searchsorted(right, right[one][-1] + SHIFT, "right"))
        near = np.hypot(right[one, None] - right[c], down[one, None] - down[c]) <= SHIFT
        near &= np.abs((turn[one, None] - turn[c] + np.pi) % (2 * np.pi) - np.pi) <= TURN
        near &= np.abs(zoom[one, None] - zoom[c]) <= ZOOM
        enough.append(i + np.flatnonzero(near.sum(axis=1) >= need))
    anchors = np.concatenate(enough)
    for i in range(0, len(anchors), step):
        one = anchors[i : i + step]
        by = np.exp(zoom[one] + 1j * turn[one])
        shift = y[one] - by * x[one]
        for slip in (SHIFT, *SLIPS):
            apart = np.abs((turn - np.angle(by)[:, None] + np.pi) % (2 * np.pi) - np.pi)
            near = (apart <= TURN) & (np.abs(zoom - np.log(np.maximum(np.abs(by), 1e-9))[:, None]) <= ZOOM)
            near &= np.abs(y - by[:, None] * x - shift[:, None]) <= slip
            enough = near.sum(axis=1) >= need
            near, by, shift = near[enough], by[enough], shift[enough]
            if not len(by):
                break
            w = near.astype(float)
            n = np.maximum(w.sum(axis=1), 1)
            mx, my = w @ x / n, w @ y / n
            spread = w @ np.abs(x) ** 2 / n - np.abs(mx) ** 2
            fit = (w @ (x.conj() * y) / n - mx.conj() * my) / np.maximum(spread, 1e-9)
            by = np.where(spread > 1, fit, by)
            shift = my - by * mx
        votes = np.minimum(np.logical_or.reduceat(near[:, by_mine], of_mine, axis=1).sum(axis=1), np.logical_or.reduceat(near[:, by_theirs], of_theirs, axis=1).sum(axis=1))
        most = max(most, int(votes.max(initial=0)))
    return most if most >= need else 0


_HELD: dict[str, list] = {}


def _search(block: Broadcast, name: str) -> Callable:
    """Pairs of a query of the block and an image, with the corners that agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reps, named, sizes, places, words = block.value
        if name not in _HELD:  # a worker's tasks share the tables
            _HELD.clear()
            _HELD[name] = _tables(words)
        query = np.repeat(np.arange(len(reps)), sizes)
        for batch in (b.slice(i, 250) for b in batches for i in range(0, len(b), 250)):
            data = batch.column("words").to_pylist()
            theirs = np.frombuffer(b"".join(data), np.uint64).reshape(-1, 4)
            spots = np.frombuffer(b"".join(batch.column("places").to_pylist()), np.float32).reshape(-1, 4)
            image = np.repeat(np.arange(len(data)), [len(d) // 32 for d in data])
            q, r = matches(_HELD[name], words, theirs)
            pair = query[q] * len(data) + image[r]
            order = np.argsort(pair, kind="stable")
            q, r, pair = q[order], r[order], pair[order]
            starts = np.flatnonzero(np.diff(pair, prepend=-1))
            ids, out = batch.column("row").to_pylist(), []
            for a, b in zip(starts, [*starts[1:], len(pair)]):
                mine, other = query[q[a]], ids[image[r[a]]]
                if b - a >= VOTES and reps[mine] != other:
                    votes = agreeing(places[q[a:b]].astype(float), spots[r[a:b]].astype(float), q[a:b], r[a:b])
                    if votes:
                        out.append((int(named[mine]), other, votes))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], names=["copy_id", "row", "votes"])

    return run


def _pairs(described: DataFrame) -> DataFrame:
    """copy_id of a query, row of an image like it, votes, from described(row, copy_id, asked, places, words).

    The queries' descriptors go out by blocks, whose number grows with them, not their size.
    """
    spark = described.sparkSession
    wanted = described.where("asked").select("row", "copy_id", "places", "words")
    corners = wanted.agg(F.sum(F.expr("length(words) div 32"))).first()[0] or 0
    blocks = -(-corners // BLOCK)
    found = None
    for k in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == k).collect()
        words = [np.frombuffer(bytes(r.words), np.uint64).reshape(-1, 4) for r in rows]
        if not rows:
            continue
        places = np.concatenate([np.frombuffer(bytes(r.places), np.float32).reshape(-1, 4) for r in rows])
        block = spark.sparkContext.broadcast((np.array([r.row for r in rows]), np.array([r.copy_id for r in rows]), np.array([len(w) for w in words]), places, np.concatenate(words)))
        more = cut(described.select("row", "places", "words").mapInArrow(_search(block, uuid.uuid4().hex), PAIR))
        block.unpersist()
        found = more if found is None else found.union(more)
    return spark.createDataFrame([], PAIR) if found is None else found


PAIR = "copy_id long, row long, votes long"


def find_copies(images: DataFrame, is_query: Column) -> DataFrame:
    """One row for each row of images(image_id, image): image_id, copy_id, n_copies, matches.

    copy_id is the least image_id with the same bytes, n_copies how many rows with an id have them.  matches lists,
    for each query image (is_query, a condition on image_id) that shows the same picture, the copy_id of the query and
    the corners that agree; the picture itself is not listed.  Rows are told apart by their bytes: of one image_id with
    several images each has matches of its own.  Rows without id or image, or whose bytes are no image, have no
    matches; without id or image no copy_id either.  Repeated rows count as copies.
    """
    rows = images.select(F.col("image_id").cast("long").alias("image_id"), F.col("image").cast("binary").alias("image"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    every = cut(rows.mapInArrow(_describe, "image_id long, asked boolean, row long, image_key binary, places binary, words binary"))
    marks = every.select("image_id", "asked", "row", "image_key", F.pmod(F.col("row"), F.lit(SALTS)).cast("int").alias("salt")).where("image_key is not null")
    parts = marks.groupBy("image_key", "salt").agg(F.min("image_id").alias("copy_id"), F.count("image_id").alias("n"), F.max("asked").alias("asked"), F.min("row").alias("row"))
    groups = cut(parts.groupBy("image_key").agg(F.min("copy_id").alias("copy_id"), F.sum("n").alias("n_copies"), F.max("asked").alias("asked"), F.min("row").alias("row")))
    reps = groups.where("copy_id is not null").select("row", "copy_id", "asked")
    described = every.where("words is not null").select("row", "places", "words").join(F.broadcast(reps) if bounded(reps) else reps, "row")
    pairs = _pairs(described)
    lists = cut(pairs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("copy_id", "votes"))).alias("matches")))
    few = bounded(lists, elements=F.size("matches"))
    named = groups.join(F.broadcast(lists) if few else lists, "row", "left").select("image_key", "copy_id", "n_copies", "matches")
    named = cut(parts.select("image_key", "salt").join(named, "image_key"))
    out = every.select("image_id", F.when(F.col("image_id").isNotNull(), F.col("image_key")).alias("key"), F.pmod(F.col("row"), F.lit(SALTS)).cast("int").alias("s"))
    few = bounded(named, elements=1 + F.coalesce(F.size("matches"), F.lit(0)))
    out = out.join(F.broadcast(named) if few else named, (F.col("key") == F.col("image_key")) & (F.col("s") == F.col("salt")), "left")
    empty = F.array().cast("array<struct<copy_id:bigint,votes:bigint>>")
    return out.select("image_id", "copy_id", "n_copies", F.coalesce("matches", empty).alias("matches"))


def _motifs(numbers: int, side: int) -> np.ndarray:
    """For each number of a vector the texture that it weighs, each one the same whatever the vectors' length."""
    return np.stack([resize(np.random.default_rng(i).normal(size=(GRAIN, GRAIN)), side, side) for i in range(numbers)])


def render(vectors: DataFrame, side: int = 96) -> DataFrame:
    """image_id and a PGM image of each row of vectors(vec_id, embedding): the sum of fixed textures weighted by its
    numbers, so that near vectors give near pictures, and equal ones equal pictures.  Tables here hold no pictures;
    these stand for them.  A missing or undefined number is 0; a null or empty vector has no picture."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}

        def draw(v: list | None) -> bytes | None:
            if not v:
                return None
            if len(v) not in held:
                held[len(v)] = _motifs(len(v), side)
            numbers = np.nan_to_num(np.array([0.0 if x is None else x for x in v]), posinf=0.0, neginf=0.0)
            size = np.sqrt((numbers**2).sum()) or 1.0
            return write_image(np.tensordot(numbers / size, held[len(v)], 1) * 50 + 128)

        for batch in batches:
            for i in range(0, len(batch), 1000):
                part = batch.slice(i, 1000)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array([draw(v) for v in part.column("embedding").to_pylist()], pa.binary())], names=["image_id", "image"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "image_id long, image binary")
