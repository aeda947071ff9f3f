"""SentencePiece encoding and decoding by an Aho-Corasick automaton and a single pass over positions.

The automaton over all pieces is fed a text once.  At each position it yields, along its output links, every piece
that ends there, and each relaxes the best way to reach that position.  For a unigram model best is the greatest sum
of scores.  A BPE model has no sum that its merges maximise; there the one way to reach a position is the piece that
its merges would not have joined differently with the piece before, which is a property of adjacent pairs alone.
Characters without a piece become bytes.  Words are encoded once and kept, in a table of bounded size.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Encoded words and checked pairs that a worker keeps, and the longest word kept, in characters.
CACHE_WORDS, CACHE_PAIRS, CACHE_CHARS = 300_000, 400_000, 40
#: Score of a character without a piece, in sums.
UNKNOWN_SCORE = -1e9


class Pieces:
    """A model's pieces and what encoding and decoding need of them.  kind: bpe or unigram."""

    def __init__(self, path: str, kind: str = "bpe"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kind, self.n = kind, model.get_piece_size()
        self.texts = [model.id_to_piece(i) for i in range(self.n)]
        self.lengths = [len(t) for t in self.texts]
        self.scores = [model.get_score(i) for i in range(self.n)]
        self.bytes = {int(self.texts[i][3:5], 16): i for i in range(self.n) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = model.unk_id()
        special = {i for i in range(self.n) if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.special = special - set(self.byte_of)
        self.ids = {t: i for i, t in enumerate(self.texts) if i not in special}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        joined = {a + b for t in self.ids for a, b in zip(t, t[1:])}
        # where a word may begin without any piece reaching over its border
        self.apart = all(not (b == SPACE and a != SPACE) for a, b in joined)
        self.lines = "\n" not in "".join(self.ids)
        self.words: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """What merging adjacent parts gives, best score first, then leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stays(self, a: int, b: int) -> bool:
        """Whether merging the text of both pieces ends in these two."""
        if len(self.pairs) > CACHE_PAIRS:
            self.pairs.clear()
        x, y = self.texts[a], self.texts[b]
        got = self.pairs[a << 20 | b] = self.merged(x + y) == [x, y]
        return got

    def best_path(self, text: str) -> list[int]:
        """Ids of the pieces of text; -1 for a character without a piece."""
        last = (self._greatest_sum if self.kind == "unigram" else self._merge_path)(text)
        out, k, lengths = [], len(text), self.lengths
        while k > 0:
            i = last[k]
            out.append(i)
            k -= lengths[i] if i >= 0 else 1
        return out[::-1]

    def _merge_path(self, text: str) -> list[int]:
        """The piece that reaches each position by merges; a place that none reaches ends an unknown character."""
        last, known = [-1] * (len(text) + 1), self.pairs
        for end, (i, length) in self.automaton.iter(text):
            if last[end + 1] < 0:
                before = last[end + 1 - length]
                if before >= 0:
                    ok = known.get(before << 20 | i)
                    if not (self.stays(before, i) if ok is None else ok):
                        continue
                last[end + 1] = i
        return last

    def _greatest_sum(self, text: str) -> list[int]:
        """The last piece of the greatest sum of scores up to each position."""
        last, total, at = [-1] * (len(text) + 1), [0.0] + [float("-inf")] * len(text), 1
        for end, (i, length) in self.automaton.iter(text):
            while at <= end:  # places that no piece ends at
                total[at] = max(total[at], total[at - 1] + UNKNOWN_SCORE)
                at += 1
            score = total[end + 1 - length] + self.scores[i]
            if score > total[end + 1]:
                total[end + 1], last[end + 1] = score, i
        return last

    def word(self, text: str) -> bytes:
        """Ids of a stretch of normalised text, as little-endian 32-bit integers."""
        known = self.words.get(text)
        if known is not None:
            return known
        ids, k = [], 0
        for i in self.best_path(text):
            if i >= 0:
                ids.append(i)
                k += len(self.texts[i])
            else:
                data = text[k].encode("utf-8", "replace")
                ids += [self.bytes[b] for b in data] if self.bytes else [self.unknown]
                k += 1
        out = array("I", ids).tobytes() if sys.byteorder == "little" else np.asarray(ids, "<u4").tobytes()
        if len(text) <= CACHE_CHARS:
            if len(self.words) > CACHE_WORDS:
                self.words.clear()
            self.words[text] = out
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text: a blank goes before it, blanks show as SPACE."""
        if not text:
            return b""
        text = SPACE + text.replace(" ", SPACE)
        if not self.apart:
            return self.word(text)
        stretches = re.findall(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+" if self.lines else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", text)
        return b"".join(map(self.word, stretches))

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces and bytes side by side, without the blank before it."""
        parts, raw = [], bytearray()
        for i in np.frombuffer(ids, "<u4").tolist():
            b = self.byte_of.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                parts.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            if i not in self.special:
                parts.append(self.texts[i])
        parts.append(raw.decode("utf-8", "replace"))
        text = "".join(parts).replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


_LOADED: dict[tuple[str, str], Pieces] = {}


def pieces(path: str, kind: str = "bpe") -> Pieces:
    """One for each worker process, which takes many tasks."""
    if (path, kind) not in _LOADED:
        _LOADED[path, kind] = Pieces(path, kind)
    return _LOADED[path, kind]


def encode(docs: DataFrame, path: str, kind: str = "bpe") -> DataFrame:
    """One row for each row of docs: doc_id, ids (array of int), ids_crc32 (of little-endian 32-bit ids).

    A null or empty text has no ids.  Other columns are ignored; repeated rows are encoded alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path, kind)
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id")
            for i in range(0, len(batch), 500):
                got = [model.encode(t) for t in texts[i : i + 500].to_pylist()]
                ends = np.cumsum([0, *(len(x) // 4 for x in got)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(got), "<i4")))
                crcs = pa.array([zlib.crc32(x) for x in got], pa.int64())
                yield pa.RecordBatch.from_arrays([ids[i : i + 500], lists, crcs], names=["doc_id", "ids", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, ids_crc32 long")


def decode(encoded: DataFrame, path: str, kind: str = "bpe") -> DataFrame:
    """encoded(doc_id, ids, ids_crc32) with the text of the ids; no ids give an empty text, null ids a null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path, kind)
        for batch in batches:
            ids = batch.column("ids")
            texts = [x.values.to_numpy(zero_copy_only=False).tobytes() if x.is_valid else None for x in ids]
            texts = pa.array([None if x is None else model.decode(x) for x in texts], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, batch.column("ids_crc32"), texts], names=["doc_id", "ids", "ids_crc32", "text"])

    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids"), "ids_crc32").mapInArrow(run, "doc_id long, ids array<int>, ids_crc32 long, text string")
