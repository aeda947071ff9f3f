import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tidemark.llm import packing
from tidemark.llm.packing import WordTokens, best_fit, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(texts):
    model = Tokenizer.from_file(PATH)
    return [e.ids + [0] for e in model.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def held(rows, texts, capacity):
    """Checks that every piece is there once, and that sequences are gapless; gives their lengths."""
    want = sorted(
        (d, k, at, len(ids[at : at + capacity]), zlib.crc32(struct.pack(f"<{len(ids[at : at + capacity])}I", *ids[at : at + capacity])))
        for d, ids in enumerate(ids_of(texts))
        for k, at in enumerate(range(0, len(ids), capacity))
    )
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return [sum(n for _, n in p) for p in by.values()]


def test_tokens_are_the_tokenizers_own():
    r = random.Random(2)
    parts = ["don't", "The", "É", "ß", "İ", " ", "\n", "\x85", "x.", "!!", "<|endoftext|>", "日本", "12", "'s", "ﬁ", "é", "\xa0", "ab|", "%%%", "ΑΣ", "\x1c", "🙂", "\u200b", "</w>", "ÀÉ;", "a" * 60]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(30))) for _ in range(3000)] + ["", None, " "]
    mine = WordTokens(PATH)(texts)
    assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in mine] == [ids[:-1] for ids in ids_of(texts)]


def test_units_are_held_in_arrays(monkeypatch):
    """A unit takes some tens of bytes; a table that overflows again and again gives the same ids, nulls and slices too."""
    r = random.Random(3)
    texts = [" ".join("".join(r.choice("aeiourstnl") for _ in range(8)) + r.choice(["", ".", "!!"]) for _ in range(500)) for _ in range(60)]
    texts = [None, *texts[:30], "", "日本 don't x", *texts[30:], None]
    want = [struct.pack(f"<{len(ids) - 1}I", *ids[:-1]) for ids in ids_of(texts)]
    tokens = WordTokens(PATH)
    assert tokens(pa.array(texts)) == want and tokens(pa.array(texts, pa.large_string())[2:9]) == want[2:9]
    assert 20_000 < len(tokens.units) and sum(x.nbytes for x in (tokens.units, tokens.ids, tokens.starts)) < 60 * len(tokens.units)
    monkeypatch.setattr(packing, "CACHE_UNITS", 1000)
    tokens = WordTokens(PATH)
    assert [x for i in range(len(texts)) for x in tokens(pa.array(texts[i : i + 1], pa.string()))] == want and len(tokens.units) <= 1000
    assert tokens(pa.array([], pa.string())) == [] and tokens(pa.array([None, " "])) == [b"", b""]


def test_workers_get_some_megabytes_at_a_time(spark, monkeypatch):
    real = packing.pack_partition

    def spying(path, capacity):
        run = real(path, capacity)

        def seen(batches):
            for batch in batches:
                if batch.nbytes > 5_000_000:
                    raise ValueError(f"a batch of {batch.nbytes} bytes")
                yield batch

        return lambda batches: run(seen(batches))

    monkeypatch.setattr(packing, "pack_partition", spying)
    docs = spark.range(0, 4000, 1, 1).selectExpr("id AS doc_id", "repeat('alpha beta ', 300) AS text")
    assert pack(docs, PATH).count() == 4000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None


def test_best_fit_is_tight():
    r = np.random.default_rng(0)
    for _ in range(20):
        lengths = r.integers(1, 101, r.integers(1, 300))
        where, offset, full = best_fit(lengths, 100)
        assert full.max() <= 100 and full.sum() == lengths.sum()
        assert len(full) <= 11 / 9 * -(-lengths.sum() // 100) + 1 or (lengths > 50).sum() >= len(full) - 1
        for b in range(len(full)):
            inside = sorted((offset[i], lengths[i]) for i in np.flatnonzero(where == b))
            assert [o for o, _ in inside] == list(np.cumsum([0, *(n for _, n in inside)])[:-1])


def test_partitions_meet_up_the_tree(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(r.randrange(40))) for _ in range(900)] + ["word " * 700, "", None]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, bin string").repartition(40)
    full = held(pack(docs, PATH, capacity=256).collect(), texts, 256)
    assert len(full) <= 1.03 * sum(full) / 256 + 1


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id")
    texts = [r.text for r in docs.collect()]
    full = held(pack(docs, PATH).collect(), texts, 2048)
    assert len(full) <= 1.05 * sum(full) / 2048 + 1


def test_carrying_few_bins_loses_nothing(spark):
    """Two bins of a node hold more than the capacity together, so that few go up and as few sequences result."""
    r = random.Random(6)
    texts = [" ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(r.randrange(150))) for _ in range(1200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(40)
    counts = [len(held(pack(docs, PATH, capacity=256, carry=carry).collect(), texts, 256)) for carry in (None, 32)]
    assert abs(counts[0] - counts[1]) <= 1


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.length) for r in pack(docs, PATH).collect())
    assert got == [(0, 2), (1, 3), (1, 3)] and pack(docs.limit(0), PATH).collect() == []
