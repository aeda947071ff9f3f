"""Scans, windows, downsampling, queries and blocks on small fixtures."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.errors import CodecError, InvalidTimeRange, QueryError, SeriesNotFound
from tidemark.functions import codec, generators
from tidemark.operators import aggregate, blocks, correlate, scan
from tidemark.operators.downsample import downsample
from tidemark.plans.query import Query, execute, execute_multi
from tidemark.sources import points as P
from tidemark.operators.ranks import placed
from tidemark.sources.journal import Journal
from tidemark.sources.store import PointStore
from tidemark.streaming import ingest


def series(spark, pairs, key="s"):
    return P.create(spark, [(key, t, float(v)) for t, v in pairs])


@pytest.fixture(scope="module")
def five(spark):
    return series(spark, [(1000 + 100 * i, 10 * (i + 1)) for i in range(5)]).cache()


@pytest.fixture(scope="module")
def ten(spark):
    return series(spark, [(1000 + 100 * i, i) for i in range(10)], "test.metric").cache()


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(
    "name, window, want",
    [
        ("sum", 1000, [(1000, 150, 5)]),
        ("avg", 200, [(1000, 15, 2), (1200, 35, 2), (1400, 50, 1)]),
        ("min", 300, [(1000, 10, 3), (1300, 40, 2)]),
        ("max", 300, [(1000, 30, 3), (1300, 50, 2)]),
        ("count", 250, [(1000, 3, 3), (1250, 2, 2)]),
        ("first", 200, [(1000, 10, 2), (1200, 30, 2), (1400, 50, 1)]),
        ("last", 200, [(1000, 20, 2), (1200, 40, 2), (1400, 50, 1)]),
        ("stddev", 200, [(1000, 5, 2), (1200, 5, 2), (1400, 0, 1)]),
    ],
)
def test_aggregates(five, name, window, want):
    assert rows(execute(five, Query("s", 0, 9999).with_aggregate(name, window))) == want


def test_windows_start_at_the_first_point_in_range(ten):
    q = Query("test.metric", 1100, 1900).with_aggregate("sum", 400)
    assert rows(execute(ten, q)) == [(1100, 1 + 2 + 3 + 4, 4), (1500, 5 + 6 + 7 + 8, 4), (1900, 9, 1)]
    assert rows(execute(ten, Query("test.metric", 1000, 1900).with_aggregate("sum", 400))) == [(1000, 6, 4), (1400, 22, 4), (1800, 17, 2)]


def test_empty_windows_are_left_out(spark):
    assert rows(execute(series(spark, [(0, 1), (5000, 2)]), Query("s", 0, 9999).with_aggregate("count", 100))) == [(0, 1, 1), (5000, 1, 1)]


def test_nan(spark):
    nan = float("nan")
    some = series(spark, [(0, 1), (1, nan), (2, 3)])
    none = series(spark, [(0, nan), (1, nan)])
    one = lambda p, name: execute(p, Query("s", 0, 9).with_aggregate(name, 10)).first()["value"]
    assert (one(some, "min"), one(some, "max")) == (1, 3)
    assert (one(none, "min"), one(none, "max")) == (math.inf, -math.inf)
    assert all(math.isnan(one(some, n)) for n in ("sum", "avg", "stddev"))


def test_ties_follow_arrival(spark):
    p = series(spark, [(5, 1), (5, 2), (4, 9), (5, 3)])
    assert [r.value for r in scan.range_scan(p, "s", 0, 9).collect()] == [9, 1, 2, 3]
    assert rows(execute(p, Query("s", 5, 5).with_aggregate("first", 1)))[0][1] == 1
    assert rows(execute(p, Query("s", 5, 5).with_aggregate("last", 1)))[0][1] == 3
    assert rows(scan.latest_point(p)) == [("s", 5, 3)]


def test_ranges(ten):
    assert [r.ts_ms for r in scan.range_scan(ten, "test.metric", 1200, 1600).collect()] == [1200, 1300, 1400, 1500, 1600]
    with pytest.raises(InvalidTimeRange):
        scan.range_scan(ten, "test.metric", 2, 1)
    with pytest.raises(SeriesNotFound):
        execute(ten, Query("other", 0, 1), strict=True)
    assert execute(ten, Query("other", 0, 1)).collect() == []
    empty = execute(ten, Query("other", 0, 1).with_aggregate("avg", 5))
    assert empty.columns == ["window_start", "value", "count"] and empty.collect() == []


@pytest.mark.parametrize("q", [Query("s", 0, 1, aggregate="sum"), Query("s", 0, 1, "sum", 0), Query("s", 0, 1, "mode", 5), Query("s", 2, 1), Query("s", 0, 1, max_points=-1)])
def test_wrong_queries(ten, q):
    with pytest.raises(QueryError):
        execute(ten, q)


def test_cap_comes_before_the_aggregate(ten):
    q = Query("test.metric", 1000, 1900, max_points=3)
    assert [r.ts_ms for r in execute(ten, q).collect()] == [1000, 1400, 1800]
    assert rows(execute(ten, q.with_aggregate("sum", 400))) == [(1000, 0, 1), (1400, 4, 1), (1800, 8, 1)]
    assert execute(ten, Query("test.metric", 0, 9999, window_ms=5)).columns == ["series_key", "ts_ms", "value", "seq"]


@pytest.mark.parametrize("n, m", [(5, 10), (5, 3), (5, 0), (100, 99), (100, 7), (0, 3), (10, 10)])
def test_downsample(spark, n, m):
    p = series(spark, [(3_000_000 * i, i) for i in range(n)]) if n else P.empty(spark)
    step = 1 if n <= m else n if m == 0 else -(-n // m)
    assert sorted(r.value for r in downsample(p, m).collect()) == list(range(0, n, step)) if n else downsample(p, m).collect() == []


def test_many_queries(spark):
    p = P.create(spark, [(f"metric.{k}", 1000 + 100 * j, 10.0 * k + j) for k in range(3) for j in range(5)])
    got = rows(execute_multi(p, [Query("metric.0", 1000, 1400), Query("metric.1", 1100, 1300), Query("metric.0", 1400, 1400)]))
    assert [sum(r[0] == i for r in got) for i in range(3)] == [5, 3, 1]
    capped = execute_multi(p, [Query("metric.0", 0, 9999, "sum", 200, 3), Query("metric.2", 1100, 9999, "sum", 200, 3)])
    assert sorted(rows(capped)) == [(0, "metric.0", 1000, 0, 1), (0, "metric.0", 1200, 2, 1), (0, "metric.0", 1400, 4, 1), (1, "metric.2", 1100, 21, 1), (1, "metric.2", 1300, 23, 1)]
    for bad in ([], [Query("a", 2, 1)], [Query("a", 0, 1), Query("a", 0, 1, max_points=2)]):
        with pytest.raises(QueryError):
            execute_multi(p, bad)


def chain(times):
    out, start, block = [], None, -1
    for t in times:
        if start is None or not start <= t < start + blocks.BLOCK_MS:
            start, block = t, block + 1
        out.append(block)
    return out


@pytest.mark.parametrize("times", [[0, 7_199_999, 7_200_000], [1000, 500, 600, 1000], [7_300_000, 0, 7_200_000, 50, 9_000_000, 14_400_000], []])
def test_blocks_follow_arrival(spark, times):
    p = series(spark, [(t, 0) for t in times]) if times else P.empty(spark)
    got = blocks.assign_blocks(p).orderBy("seq").collect()
    assert [r.block_id for r in got] == chain(times)
    if times:
        last = max(chain(times))
        assert scan.head_scan(p, "s", 0, 10**9).count() == chain(times).count(last)
        stats = blocks.store_stats(p).first()
        assert (stats.n_points, stats.n_blocks) == (len(times), last + 1)


def test_sizes(spark, ten):
    assert blocks.compressed_bytes(blocks.assign_blocks(ten)).first()["bytes"] == 77
    three = series(spark, [(1500, 42.5), (1600, 43), (1700, 43.5)])
    assert blocks.compressed_bytes(blocks.assign_blocks(three)).first()["bytes"] == 19
    assert rows(blocks.compression_ratio(blocks.store_stats(three)).select("compressed_bytes", "ratio", "saved_percent")) == [(0, 0, 0)]
    flags = [r.is_sealed for r in blocks.sealed_at(blocks.assign_blocks(three), 1500 + 7_199_999).collect()]
    assert flags == [False] and blocks.sealed_at(blocks.assign_blocks(three), 1500 + 7_200_000).first()["is_sealed"]


@pytest.mark.parametrize("short", [False, True])
@given(st.data())
def test_codec_is_lossless(short, data):
    steps = data.draw(st.lists(st.one_of(st.integers(-70, 70), st.sampled_from([256, 257, -255, -256, 2048, 2049, -2047, -2048, 10**6, -(10**6)])), max_size=30))
    values = data.draw(st.lists(st.one_of(st.sampled_from([0.0, -0.0, 1.0, math.inf, -math.inf, math.nan]), st.floats()), min_size=len(steps) + 1, max_size=len(steps) + 1))
    import numpy as np

    ts, v = np.cumsum([10**12, *steps]), np.array(values)
    t2, v2 = codec.decode(int(ts[0]), float(v[0]), len(ts), codec.encode(ts, v, short), short)
    assert t2.tolist() == ts.tolist() and v2.view("uint64")[1:].tolist() == v.view("uint64")[1:].tolist()


def test_codec_errors():
    import numpy as np

    with pytest.raises(CodecError):
        codec.encode(np.array([0, 2**33]), np.array([1.0, 2.0]))
    with pytest.raises(CodecError):
        codec.decode(0, 1.0, 3, b"")


def test_encoded_blocks_come_back(spark):
    made = generators.server(spark, 50).union(generators.client(spark, 50))
    assigned = blocks.assign_blocks(made).cache()
    encoded = codec.encode_blocks(assigned).cache()
    want = sorted(rows(assigned.select("series_key", "ts_ms", "value")))
    assert sorted(rows(codec.decode_blocks(encoded).select("series_key", "ts_ms", "value"))) == want
    sizes = {r.series_key: r.bytes for r in blocks.compressed_bytes(assigned).collect()}
    assert {r.series_key: len(r.data) for r in encoded.collect()} == sizes


def test_journal(spark, tmp_path):
    journal = Journal(spark, str(tmp_path / "j"))
    journal.append(P.create(spark, [("metric1", 1000, 42.0), ("metric2", 2000, 84.0), ("metric1", 3000, 126.0)]), now_ms=7)
    assert rows(journal.replay().orderBy("seq").select("series_key", "ts_ms", "value")) == [("metric1", 1000, 42), ("metric2", 2000, 84), ("metric1", 3000, 126)]
    assert journal.replay_each(lambda part: None) == 3
    assert [r.wal_ts_ms for r in journal.entries().collect()] == [7, 7, 7]
    journal.truncate()
    assert journal.count() == 0


def test_catalogue(spark):
    p = P.create(spark, [(f"metric.{k}", 1000, 42.5) for k in (3, 1, 2)])
    assert sorted(rows(scan.list_series(p))) == [("metric.1",), ("metric.2",), ("metric.3",)]
    assert rows(scan.store_len(p)) == [(3, 3, False)] and rows(scan.store_len(P.empty(spark))) == [(0, 0, True)]
    assert rows(scan.series_snapshot(p, "metric.1").select("block_id", "is_open", F.size("points"))) == [(0, True, 1)]
    stay, gone = scan.retain(p, 1000)
    assert stay.count() == 3 and gone.count() == 0
    keys = spark.createDataFrame([(f"k{i}",) for i in range(1000)], "series_key string")
    shards = ["a", "b", "c", "d"]
    of = {r.series_key: r.shard for r in scan.shard_of(keys, shards).collect()}
    assert len(of) == 1000 and set(of.values()) == set(shards)
    moved = scan.rebalanced(keys, shards, [*shards, "e"]).collect()
    assert 80 < len(moved) < 350 and all(r["to"] == "e" and of[r["series_key"]] == r["from"] for r in moved)
    dirty = spark.createDataFrame([("a", 1, 1.0, 0), (None, 1, 1.0, 1), ("a", None, 1.0, 2), ("a", 1, None, 3)], P.POINTS)
    assert P.clean(dirty).count() == 1


def test_shards_are_found_for_keys_not_points(spark):
    """Nothing but the null test of the key stands under the distinct; owners are those of a walk round the ring."""
    points = spark.range(3000).selectExpr("concat('key', id % 700) AS series_key")
    shards = [f"s{i}" for i in range(9)]

    def owner(key, of):
        number, stops = int(hashlib.md5(key.encode()).hexdigest()[:15], 16), scan.ring(of)
        return next((s for a, s in stops if a >= number), stops[0][1])

    names = [f"key{i}" for i in range(700)]
    assert dict(map(tuple, scan.shard_of(points, shards).collect())) == {k: owner(k, shards) for k in names}
    for before, after in ((shards[:8], shards), (shards, shards[3:]), (shards[:1], shards[1:2])):
        moved = scan.rebalanced(points, before, after)
        assert sorted(map(tuple, moved.collect())) == sorted((k, owner(k, before), owner(k, after)) for k in names if owner(k, before) != owner(k, after))
        plan = moved._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Aggregate") == 1 and "md5" not in plan.split("Aggregate")[1].split("\n", 1)[1]
    assert scan.rebalanced(points, shards, shards[::-1]).collect() == []
    assert scan.arcs([(scan.TOP, "a")]) == [(0, scan.TOP, "a")] and scan.arcs([(0, "a"), (9, "b")]) == [(0, 0, "a"), (1, 9, "b"), (10, scan.TOP, "a")]


def test_correlations(spark):
    pairs = spark.createDataFrame([(i, float(i), float(i * i)) for i in range(60)], "bucket long, x double, y double")
    assert correlate.spearman(pairs).first()["corr"] == pytest.approx(1)
    assert 0.9 < correlate.pearson(pairs).first()["corr"] < 1
    assert correlate.rolling(pairs, 50).count() == 11
    ties = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (2.0, 3.0)], "x double, y double")
    assert correlate.spearman(ties).first()["corr"] == pytest.approx(0.8660254)
    p = series(spark, [(i, i % 2) for i in range(50)])
    assert correlate.autocorrelation(p, 1).first()["corr"] == pytest.approx(-1)


def test_rollups_add_up(spark, ten):
    small = aggregate.rollup(ten, 200)
    assert rows(aggregate.rollup_again(small, 1000)) == rows(aggregate.rollup(ten, 1000))
    assert aggregate.percentiles(ten, (0.5,)).first()["p50"] == 4.5


def test_stream_of_blocks(spark, tmp_path):
    times = [0, 10, 7_200_000, 5, 7_200_005, 20_000_000]
    p = series(spark, [(t, i) for i, t in enumerate(times)])
    for i in range(3):
        p.where(f"seq div 2 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(P.POINTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = ingest.drain(ingest.sealed_blocks(stream), str(tmp_path / "s")).orderBy("block_id").collect()
    assert [(r.block_id, r.start_ts, r.end_ts, r["count"]) for r in got] == [(0, 0, 10, 2), (1, 7_200_000, 7_200_000, 1), (2, 5, 5, 1), (3, 7_200_005, 7_200_005, 1)]


def test_filters_reach_the_scan(spark):
    p = P.from_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet"), ["click"], 1_704_067_200_000, 1_704_153_600_000)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = p._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed and "event_type" in pushed


def test_many_blocks_at_once():
    """Blocks encoded side by side are those encoded one by one, and are read back side by side."""
    r = np.random.default_rng(1)
    sizes = [1, 2, 50, 1, 7, 300]
    ts = [np.cumsum(r.integers(-500, 4000, n)) for n in sizes]
    values = [r.choice([1.5, 2.5, np.nan, -0.0, 0.0, np.inf], n) for n in sizes]
    for short in (False, True):
        got = codec.encode_many(np.concatenate(ts), np.concatenate(values), np.repeat(np.arange(6), sizes), short)
        assert got == [codec.encode(t, v, short) for t, v in zip(ts, values)]
        block, place, t2, v2 = codec.decode_many(np.array([t[0] for t in ts]), np.array([v[0] for v in values]), np.array(sizes), got, short)
        order = np.lexsort((place, block))
        assert (t2[order] == np.concatenate(ts)).all() and (v2[order].view(np.uint64) == np.concatenate(values).view(np.uint64)).all()
        with pytest.raises(CodecError):
            codec.decode(0, 1.0, 300, got[5][:-3], short)


class Held:
    """A state as the stream keeps it for a series."""

    def __init__(self):
        self.get, self.exists, self.hasTimedOut, self.timeout = None, False, False, None

    def update(self, value):
        self.get, self.exists = value, True

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def test_idle_blocks_are_sealed():
    """When no point has come in time, the open block is sealed; the next point opens another; nothing is sealed twice."""
    run, state = ingest.machine(7_200_000, idle_ms=5_000), Held()
    frame = lambda *rows: iter([pd.DataFrame([(t, float(v), k) for k, (t, v) in enumerate(rows)], columns=["ts_ms", "value", "seq"])])
    assert next(run(("s",), frame((1000, 1), (1500, 2)), state)).empty and state.timeout == 5_000
    state.hasTimedOut = True
    assert next(run(("s",), iter([]), state)).values.tolist() == [["s", 0, 1000, 1500, 2, 1.0]]
    assert next(run(("s",), iter([]), state)).empty
    state.hasTimedOut = False
    assert next(run(("s",), frame((1600, 3)), state)).empty and tuple(state.get) == (1, 1600, 1600, 1, 3.0)


def test_store(spark, tmp_path):
    day = 86_400_000
    store = PointStore(spark, str(tmp_path / "store"), 4)
    assert store.points().count() == 0
    rows = [("a", 10, 1.0), ("b", day + 5, 2.0), ("a", day + 7, 3.0), ("a", 2 * day, 4.0)]
    store.append(P.create(spark, rows[:2]))
    PointStore(spark, store.path, 4).append(P.create(spark, rows[2:]))
    shown = lambda df: sorted((r.series_key, r.ts_ms, r.value) for r in df.collect())
    assert shown(store.points()) == sorted(rows) and shown(store.series("a", 0, day + 7)) == [rows[0], rows[2]]
    assert store.retain(day + 6) == 2 and shown(store.points()) == [rows[2], rows[3]] and store.retain(day + 6) == 0


def test_journal_recovers(spark, tmp_path):
    journal = Journal(spark, str(tmp_path / "log"))
    journal.append(P.create(spark, [("s", 0, 1.0), ("s", 7_199_999, 2.0), ("s", 7_200_000, 3.0)]))
    sealed, head = journal.recover()
    assert [tuple(r) for r in sealed.collect()] == [("s", 0, 0, 7_199_999, 2, 1.0)]
    assert [(r.ts_ms, r.value) for r in head.collect()] == [(7_200_000, 3.0)]


def test_ranks_and_rolling_by_slices(spark, monkeypatch):
    """Against the definitions, with ties and slices far smaller than the table."""
    r = np.random.default_rng(2)
    x = r.integers(0, 40, 500).astype(float)
    got = {v.x: (v.ties, v.before, v.n) for v in placed(spark.createDataFrame([(float(v),) for v in x], "x double"), "x", ranges=8).collect()}
    assert got == {v: ((x == v).sum(), (x < v).sum(), 500) for v in set(x)}
    monkeypatch.setattr(correlate, "SLICE", 16)
    y = x + r.normal(0, 5, 500)
    pairs = spark.createDataFrame([(i * 1000, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "bucket long, x double, y double")
    rolled = {v.bucket: v.corr for v in correlate.rolling(pairs, 10).collect()}
    assert len(rolled) == 491 and all(rolled[1000 * i] == pytest.approx(np.corrcoef(x[i - 9 : i + 1], y[i - 9 : i + 1])[0, 1]) for i in range(9, 500))


def test_many_anchors_are_salted(spark, ten):
    few, many = (sorted(map(tuple, aggregate.anchored_windows(ten, "sum", 400, few=f).collect())) for f in (True, False))
    assert few == many
