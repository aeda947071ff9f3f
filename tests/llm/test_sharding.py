import hashlib

import pytest

from tidemark.llm.sharding import SHARDS, SIZE, fill, place


def test_table_is_fair_and_moves_little():
    table = fill()
    shares = [table.count(i) for i in range(len(SHARDS))]
    assert len(table) == SIZE and max(shares) - min(shares) <= 1
    fewer = fill(SHARDS[:-1])
    kept = [i for i in range(SIZE) if table[i] != 63]
    assert sum(table[i] != fewer[i] for i in kept) < 0.1 * len(kept)


def test_first_slots_follow_preferences():
    names, size = ("a", "b", "c"), 7
    number = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:12], 16)
    orders = [[(number(f"{s}/offset") + j * (number(f"{s}/skip") % (size - 1) + 1)) % size for j in range(size)] for s in names]
    want, turn = {}, 0
    while len(want) < size:
        want[next(x for x in orders[turn % 3] if x not in want)] = turn % 3
        turn += 1
    assert fill(names, size) == [want[i] for i in range(size)]


def test_rejects_bad_sizes():
    for shards, size in ((("a", "a"), 7), ((), 7), (("a",), 8), (("a", "b", "c"), 2)):
        with pytest.raises(ValueError):
            fill(shards, size)


def test_place(spark):
    rows = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y"), (2**40, None)], "doc_id long, shard string")
    table = fill()
    got = sorted((tuple(r) for r in place(rows, "doc_id").collect()), key=str)
    slot = lambda k: int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16) % SIZE
    want = [(k, slot(k), SHARDS[table[slot(k)]]) for k in (1, 1, 2**40)] + [(None, None, None)]
    assert got == sorted(want, key=str)
    assert place(rows.limit(0), "doc_id").collect() == []


def test_key_columns_of_any_name(spark):
    for name in ("slot", "shard", "_at"):
        got = place(spark.createDataFrame([(5, "x")], f"{name} long, other string"), name).collect()
        assert len(got) == 1 and got[0][0] == 5 and got[0][2] == SHARDS[fill()[got[0][1]]]


def test_very_long_keys(spark):
    key = "k" * 500_000
    got = place(spark.createDataFrame([(key,)], "name string"), "name").collect()[0]
    assert got.slot == int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % SIZE
