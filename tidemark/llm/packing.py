"""Hierarchical best-fit packing of tokenised documents into sequences of bounded length.

Partitions tokenise and pack their own pieces best-fit, longest first.  Nearly full bins are final.  Underfull
bins go up a tree as items: at each level the bins of FAN_IN nodes meet in one node and are packed best-fit
again, until one node is left.

Within a node any two bins hold more than the capacity together, since the item that opened the later one did not
fit the earlier one.  So a node has one bin at most that is half empty, and bins can only be joined where one of the
two is: at most FAN_IN joins in a node, whatever the input.  A node sends up its CARRY emptiest bins, many more than
all nodes above it can join, so that memory is bounded and no join is lost for want of a bin with room; carry=None
sends all, for the tightest fit among them too.
"""

from __future__ import annotations

import ctypes
import gc
import itertools
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, small_batches

CAPACITY = 2048
#: A bin with at most so many places left is final at once.
SLACK = 8
FAN_IN, CARRY = 16, 4096
#: Encoded units that a worker keeps.
CACHE_UNITS = 150_000
#: Texts tokenised at a time, by bytes.
CHUNK = 600_000

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Words of Latin letters, with marks behind them or not: one or two units of the tokenizer, which no case of its
#: pattern splits otherwise.
LETTERS = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
MARKS = ".,!?;:%*#$&|"
PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of flat that begin at starts, one after the other."""
    return flat[np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())]


class WordTokens:
    """Token ids of whole texts as little-endian 32-bit integers.

    No token of this vocabulary spans white space, so that the ids of a text are those of its words; each different
    word of some megabytes of text is encoded once.  Of plain words only the lower-case letters and the marks are
    encoded, many in one call; the last token of each such unit has the suffix for word ends, which parts them.
    Units are kept in a table of bounded size: their texts in one array, their ids in another, and where each begins.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")

    def _forget(self) -> None:
        self.units, self.ids, self.starts = pa.array([""]), np.zeros(0, "<u4"), np.zeros(2, np.int64)

    def _ids(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, units: pa.Array) -> None:
        ids, ends, at = [self.ids], [self.starts], len(self.ids)
        for i in range(0, len(units), 20_000):
            words = units[i : i + 20_000].to_pylist()
            lines = [words[j : j + 200] for j in range(0, len(words), 200)]
            for line, found in zip(lines, self._ids([" ".join(x) for x in lines])):
                found = np.asarray(found, "<u4")
                cuts = np.flatnonzero(self.ends[found]) + 1
                if len(cuts) != len(line):
                    raise ValueError(f"a unit is not one word of {self.tokenizer!r}")
                ids.append(found)
                ends.append(cuts + at)
                at += len(found)
        self.units, self.ids, self.starts = pa.concat_arrays([self.units, units]), np.concatenate(ids), np.concatenate(ends)

    def _numbers(self, units: pa.Array) -> np.ndarray:
        """Where each of the units stands in the table, after those that weren't there are."""
        coded = units.dictionary_encode()
        known = pc.index_in(coded.dictionary, value_set=self.units)
        if known.null_count:
            new = coded.dictionary.filter(known.is_null())
            if len(self.units) + len(new) > CACHE_UNITS and len(self.units) > 1:
                self._forget()
                return self._numbers(units)
            self._learn(new)
            known = pc.index_in(coded.dictionary, value_set=self.units)
        return known.to_numpy(zero_copy_only=False)[coded.indices.to_numpy()]

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and of each of the different words the first stretch of them, the second, and how long these are."""
        letters = pc.utf8_rtrim(words, characters=MARKS)
        marks = pc.subtract(pc.binary_length(words), pc.binary_length(letters))
        plain = pc.and_(pc.match_substring_regex(letters, PLAIN), pc.and_(pc.less_equal(pc.utf8_length(letters), 48), pc.less_equal(marks, 8)))
        plain = pc.or_(plain, pc.equal(words, ""))
        marked = pc.and_(plain, pc.greater(marks, 0))
        number = np.zeros((len(words), 2), np.int64)
        plain, marked = (x.to_numpy(zero_copy_only=False) for x in (plain, marked))
        first, second = pc.utf8_lower(letters.filter(plain)), pc.utf8_ltrim(words.filter(marked), characters=LETTERS)
        found = self._numbers(pa.concat_arrays([first, second]))
        number[plain, 0], number[marked, 1] = found[: len(first)], found[len(first) :]
        starts, lengths = self.starts[number], np.diff(self.starts)[number]
        other, ids = np.flatnonzero(~plain), [self.ids]
        at = len(self.ids)
        for i in range(0, len(other), 10_000):
            part = other[i : i + 10_000]
            for w, found in zip(part.tolist(), self._ids(words.take(pa.array(part)).to_pylist())):
                ids.append(np.asarray(found, "<u4"))
                starts[w, 0], lengths[w, 0] = at, len(found)
                at += len(found)
        return np.concatenate(ids) if len(ids) > 1 else self.ids, starts, lengths

    def __call__(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        if not isinstance(texts, pa.Array):
            texts = pa.array([(t or "").encode("utf-8", "replace").decode() for t in texts], pa.string())
        split = pc.ascii_split_whitespace(texts.cast(pa.string()).fill_null(""))
        coded = split.flatten().dictionary_encode()
        ids, starts, lengths = self._encoded(coded.dictionary)
        word = coded.indices.to_numpy()
        lengths = lengths[word]
        ends = np.concatenate([[0], np.cumsum(lengths.sum(1))])[np.cumsum([0, *pc.list_value_length(split).to_pylist()])] * 4
        data = ragged(ids, starts[word].ravel(), lengths.ravel()).tobytes()
        return [data[a:b] for a, b in itertools.pairwise(ends.tolist())]


_LOADED: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One for each worker process, until it is released."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _LOADED[path] = WordTokens(path)
    return _LOADED[path]


def release() -> None:
    """Give the memory of tokenizers back: workers go on to tasks of other operators, and loading takes a tenth of a
    second."""
    _LOADED.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of texts of about CHUNK bytes, whole texts only."""
    start = total = 0
    for i, n in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        total += n
        if total > CHUNK:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, longest first: bin and offset of each item, and what each bin holds.

    Open bins are kept by the room they have; a bit mask over rooms finds the tightest in constant time.
    """
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    held: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = mask >> n
        if fits:
            room = n + ((fits & -fits).bit_length() - 1)
            b = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(held)
            held.append(0)
        where[i], offset[i] = b, held[b]
        held[b] += n
        room -= n
        if room:
            by_room[room].append(b)
            mask |= 1 << room
    return where, offset, np.asarray(held, np.int64)


def pack_partition(path: str, capacity: int = CAPACITY) -> Callable:
    """Tokenise and pack the documents of a partition: pieces with their bin, their place in it and what it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(path)
        cols: list[list[np.ndarray]] = [[], [], [], [], []]
        nulls: list[np.ndarray] = []
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id")
            for i, j in chunks(texts):
                size, crcs = [], []
                for data in tokens(texts[i:j]):
                    data += b"\0\0\0\0"
                    size.append(len(data) // 4)
                    crcs += [zlib.crc32(data[at : at + 4 * capacity]) for at in range(0, len(data), 4 * capacity)]
                size = np.array(size, np.int64)
                n = -(-size // capacity)  # pieces of each document
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                cols[0].append(np.repeat(ids[i:j].fill_null(0).to_numpy(), n))
                cols[1].append(piece.astype(np.int32))
                cols[2].append(piece * capacity)
                cols[3].append(np.minimum(np.repeat(size, n) - piece * capacity, capacity).astype(np.int32))
                cols[4].append(np.array(crcs, np.uint32))
                nulls.append(np.repeat(ids[i:j].is_null().to_numpy(zero_copy_only=False), n))
        del tokens
        release()
        if not nulls:
            return
        doc, piece, start, length, crc = (np.concatenate(cols.pop(0)) for _ in range(5))
        where, offset, held = best_fit(length, capacity)
        base = TaskContext.get().partitionId() << 36
        nulls = np.concatenate(nulls)
        for i in range(0, len(doc), 50_000):
            s = slice(i, i + 50_000)
            numbers = (x.astype(np.int64) for x in (start[s], length[s], crc[s], where[s] + base, offset[s], held[where[s]]))
            yield pa.RecordBatch.from_arrays([pa.array(doc[s], mask=nulls[s]), pa.array(piece[s]), *map(pa.array, numbers)], names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "held"])

    return run


def merge_node(capacity: int, slack: int, carry: int | None, last: bool) -> Callable:
    """Pack the bins of a node best-fit: each one's new bin and place there, and whether that bin goes up."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        every = pd.concat(parts, ignore_index=True)
        for node, pdf in every.groupby("node"):
            pdf = pdf.sort_values(["held", "bin"])
            bins, lengths = pdf["bin"].to_numpy(), pdf["held"].to_numpy()
            where, offset, held = best_fit(lengths, capacity)
            up = held < capacity - slack
            if last:
                up[:] = False
            elif carry is not None and up.sum() > carry:
                up &= held <= np.sort(held[up])[carry - 1]
            first = np.full(len(held), np.iinfo(np.int64).max)
            np.minimum.at(first, where, bins)
            yield pd.DataFrame({"bin": bins, "into": first[where], "shift": offset, "node": node, "sum": held[where], "up": up[where]})

    return run


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, slack: int = SLACK, carry: int | None = CARRY) -> DataFrame:
    """One row for each piece of each row of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and the id 0; only a longer one than capacity is cut.  A null or empty text is the
    id 0 alone.  Rows with the same doc_id, or none, are documents of their own.  Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with small_batches(docs.sparkSession):
        pieces = cut(docs.mapInArrow(pack_partition(path, capacity), PIECE + ", bin long, offset long, held long"))
    moved = None
    open_bins = cut(pieces.where(F.col("held") < capacity - slack).groupBy(F.col("bin").alias("bin")).agg(F.first("held").alias("held")).withColumn("node", F.shiftright("bin", 36)))
    nodes = (open_bins.agg(F.max("node")).first()[0] or 0) + 1
    while True:
        nodes = -(-nodes // FAN_IN)
        up = open_bins.withColumn("node", F.expr(f"node div {FAN_IN}"))
        level = cut(
            up.repartition("node").mapInPandas(merge_node(capacity, slack, carry, nodes == 1), "bin long, into long, shift long, node long, sum long, up boolean")
        )
        step = level.select("bin", "into", "shift")
        if moved is None:
            moved = step
        else:
            later = step.select(F.col("bin").alias("at"), F.col("into").alias("next"), F.col("shift").alias("more"))
            moved = moved.join(later, moved["into"] == later["at"], "left").select(
                "bin", F.coalesce("next", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")
            )
        if nodes == 1:
            break
        open_bins = level.where("up").groupBy(F.col("into").alias("bin")).agg(F.first("sum").alias("held"), F.first("node").alias("node"))
    moved = moved.withColumnRenamed("bin", "from")
    out = pieces.join(moved, pieces["bin"] == moved["from"], "left")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("into", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
