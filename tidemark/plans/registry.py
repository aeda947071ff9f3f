"""The queries of the time-series operators, and the SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..operators import aggregate, blocks, correlate, scan
from ..operators.aggregate import AGGREGATES
from ..operators.downsample import downsample
from ..sources.journal import Journal
from ..sources.points import POINTS, from_events, from_lineitem
from ..sources.store import PointStore
from ..streaming import ingest
from .query import Query, execute, execute_multi

HOUR, DAY = 3_600_000, 86_400_000
#: One day, and ten days, of January 2024.
T0 = 1_704_067_200_000 + 4 * DAY
T1, T10 = T0 + DAY - 1, T0 + 10 * DAY - 1

QUERIES: dict = {}
ORACLE_SQL: dict = {}

PTS = "pts AS (SELECT event_type AS series_key, epoch_us(ts) // 1000 AS ts_ms, value, event_id AS seq FROM events)"
#: Greedy blocks of time-ordered points, one point at a time: the next block starts at the first point out of reach.
CHAIN = f"""{PTS},
starts AS (
    SELECT series_key, 0::BIGINT AS block_id, min(ts_ms) AS start_ts FROM pts GROUP BY 1
    UNION ALL
    SELECT series_key, block_id, start_ts FROM (
        SELECT s.series_key, s.block_id + 1 AS block_id, (SELECT min(p.ts_ms) FROM pts p WHERE p.series_key = s.series_key AND p.ts_ms >= s.start_ts + 7200000) AS start_ts
        FROM starts s) WHERE start_ts IS NOT NULL),
blocks AS (
    SELECT p.*, s.block_id, s.start_ts FROM pts p ASOF JOIN starts s ON p.series_key = s.series_key AND p.ts_ms >= s.start_ts)"""
SIZES = f"""{CHAIN},
steps AS (SELECT *, ts_ms - lag(ts_ms) OVER w AS step, lag(value) OVER w AS before FROM blocks WINDOW w AS (PARTITION BY series_key, block_id ORDER BY seq)),
changes AS (SELECT *, step - coalesce(lag(step) OVER (PARTITION BY series_key, block_id ORDER BY seq), 0) AS change FROM steps),
sizes AS (
    SELECT series_key, block_id, count(*) AS count, CAST(ceil(sum(CASE WHEN step IS NULL THEN 0 ELSE
        (CASE WHEN change = 0 THEN 1 WHEN change BETWEEN -63 AND 64 THEN 9 WHEN change BETWEEN -255 AND 256 THEN 12
              WHEN change BETWEEN -2047 AND 2048 THEN 16 ELSE 36 END) + (CASE WHEN value = before THEN 1 ELSE 66 END) END) / 8) AS BIGINT) AS bytes
    FROM changes GROUP BY 1, 2),
stats AS (
    SELECT count(*) AS n_series, CAST(sum(points) AS BIGINT) AS n_points, CAST(sum(blocks) AS BIGINT) AS n_blocks, CAST(sum(bytes - open_bytes) AS BIGINT) AS compressed_bytes
    FROM (SELECT series_key, sum(count) AS points, count(*) AS blocks, sum(bytes) AS bytes, arg_max(bytes, block_id) AS open_bytes FROM sizes GROUP BY 1))"""
WINDOWED = {
    "sum": "sum(value)", "avg": "avg(value)", "min": "coalesce(min(value) FILTER (NOT isnan(value)), 'inf'::DOUBLE)", "max": "coalesce(max(value) FILTER (NOT isnan(value)), '-inf'::DOUBLE)",
    "count": "count(*)::DOUBLE", "first": "arg_min(value, seq)", "last": "arg_max(value, seq)", "stddev": "stddev_pop(value)",
}


def events(spark: SparkSession, sf_dir: str, *args) -> DataFrame:
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"), *args)


def scratch(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
    return f"{base.rstrip('/')}/tidemark/{uuid.uuid4().hex}"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH RECURSIVE {sql}" if sql.lstrip().startswith("pts AS") else sql
        return f

    return register


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(execute(events(spark, sf_dir, ["click"], T0, T1), Query("click", T0, T1, "avg", HOUR)), "value")


QUERIES["entry"] = flagship
ORACLE_SQL["entry"] = f"""WITH {PTS}, f AS (SELECT * FROM pts WHERE series_key = 'click' AND ts_ms BETWEEN {T0} AND {T1}), a AS (SELECT min(ts_ms) AS t0 FROM f)
SELECT t0 + (ts_ms - t0) // {HOUR} * {HOUR} AS window_start, round(avg(value), 6) AS value, count(*) AS count FROM f, a GROUP BY 1"""


@query(f"{PTS} SELECT * FROM pts WHERE series_key = 'view' AND ts_ms BETWEEN {T0} AND {T10}")
def range_scan(spark, sf_dir):
    return scan.range_scan(events(spark, sf_dir, ["view"], T0, T10), "view", T0, T10)


@query("SELECT l_returnflag AS series_key, epoch_us(l_shipdate) // 1000 AS ts_ms, l_quantity AS value, l_orderkey * 8 + l_linenumber AS seq FROM lineitem WHERE l_returnflag = 'A' AND l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'")
def range_scan_lineitem(spark, sf_dir):
    a, b = 852_076_800_000, 883_612_800_000 - 1
    return scan.range_scan(from_lineitem(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), a, b), "A", a, b)


@query(f"{PTS} SELECT DISTINCT series_key FROM pts")
def list_series(spark, sf_dir):
    return scan.list_series(events(spark, sf_dir))


@query(f"{PTS} SELECT count(DISTINCT series_key) AS n_series, count(*) AS n_points, count(*) = 0 AS is_empty FROM pts")
def store_len(spark, sf_dir):
    return scan.store_len(events(spark, sf_dir))


def _window_query(name: str) -> None:
    def run(spark, sf_dir):
        return rounded(aggregate.anchored_windows(events(spark, sf_dir), name, 6 * HOUR), "value")

    QUERIES[f"win_{name}"] = run
    ORACLE_SQL[f"win_{name}"] = f"""WITH {PTS}, a AS (SELECT series_key, min(ts_ms) AS t0 FROM pts GROUP BY 1)
SELECT series_key, t0 + (ts_ms - t0) // {6 * HOUR} * {6 * HOUR} AS window_start, round({WINDOWED[name]}, 6) AS value, count(*) AS count
FROM pts JOIN a USING (series_key) GROUP BY 1, 2"""


for _name in AGGREGATES:
    _window_query(_name)

_RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY ts_ms, seq) - 1 AS rn, count(*) OVER (PARTITION BY series_key) AS n FROM pts)"
_KEPT = "(n <= 500 OR rn % CAST(ceil(n / 500) AS BIGINT) = 0)"


@query(f"{PTS}, {_RANKED} SELECT series_key, ts_ms, value, seq FROM r WHERE {_KEPT}")
def downsample_500(spark, sf_dir):
    return downsample(events(spark, sf_dir), 500)


@query(f"""{PTS}, {_RANKED}, k AS (SELECT * FROM r WHERE series_key = 'error' AND {_KEPT}), a AS (SELECT min(ts_ms) AS t0 FROM k)
SELECT t0 + (ts_ms - t0) // {DAY} * {DAY} AS window_start, round(avg(value), 6) AS value, count(*) AS count FROM k, a GROUP BY 1""")
def downsample_then_avg(spark, sf_dir):
    return rounded(execute(events(spark, sf_dir, ["error"]), Query("error", 0, 2**42, "avg", DAY, 500)), "value")


_REQUESTS = [("click", T0, T1), ("view", T0, T10), ("click", T0 - DAY, T10)]


@query(f"""{PTS}, q(req_id, k, a, b) AS (VALUES {", ".join(f"({i}, '{k}', {a}, {b})" for i, (k, a, b) in enumerate(_REQUESTS))}),
m AS (SELECT req_id::INT AS req_id, pts.* FROM pts JOIN q ON series_key = k AND ts_ms BETWEEN a AND b), t AS (SELECT req_id, min(ts_ms) AS t0 FROM m GROUP BY 1)
SELECT req_id, series_key, t0 + (ts_ms - t0) // {HOUR} * {HOUR} AS window_start, round(sum(value), 6) AS value, count(*) AS count FROM m JOIN t USING (req_id) GROUP BY 1, 2, 3""")
def execute_many(spark, sf_dir):
    low, high = min(r[1] for r in _REQUESTS), max(r[2] for r in _REQUESTS)
    points = events(spark, sf_dir, sorted({r[0] for r in _REQUESTS}), low, high)
    return rounded(execute_multi(points, [Query(*r).with_aggregate("sum", HOUR) for r in _REQUESTS]), "value")


@query(f"{CHAIN} SELECT series_key, block_id, min(ts_ms) AS start_ts, max(ts_ms) AS end_ts, count(*) AS count, arg_min(value, seq) AS first_value FROM blocks GROUP BY 1, 2")
def block_stats(spark, sf_dir):
    return blocks.block_stats(blocks.assign_blocks(events(spark, sf_dir)))


@query(f"{CHAIN} SELECT series_key, ts_ms, value, seq FROM blocks b WHERE series_key = 'click' AND block_id = (SELECT max(block_id) FROM blocks WHERE series_key = 'click')")
def head_scan(spark, sf_dir):
    return scan.head_scan(events(spark, sf_dir, ["click"]), "click", 0, 2**42)


@query(f"{SIZES} SELECT * FROM stats")
def store_stats(spark, sf_dir):
    return blocks.store_stats(events(spark, sf_dir))


@query(f"{SIZES} SELECT *, round(n_points * 16 / compressed_bytes, 6) AS ratio, round((1 - compressed_bytes / (n_points * 16)) * 100, 6) AS saved_percent FROM stats")
def compression_ratio(spark, sf_dir):
    return rounded(blocks.compression_ratio(blocks.store_stats(events(spark, sf_dir))), "ratio", "saved_percent")


@query(f"{SIZES} SELECT * FROM sizes")
def block_compressed_size(spark, sf_dir):
    return blocks.compressed_bytes(blocks.assign_blocks(events(spark, sf_dir)))


@query(f"{CHAIN} SELECT series_key, block_id, block_id = max(block_id) OVER (PARTITION BY series_key) AS is_open, count(*) AS n_points, round(sum(value), 6) AS total FROM blocks WHERE series_key = 'signup' GROUP BY 1, 2")
def series_snapshot(spark, sf_dir):
    rows = scan.series_snapshot(events(spark, sf_dir, ["signup"]), "signup")
    total = F.aggregate("points", F.lit(0.0), lambda a, p: a + p["value"])
    return rows.select("series_key", "block_id", "is_open", F.size("points").cast("bigint").alias("n_points"), F.round(total, 6).alias("total"))


@query(f"{CHAIN} SELECT series_key, block_id, row_number() OVER (PARTITION BY series_key, block_id ORDER BY seq) - 1 AS place, ts_ms, value FROM blocks")
def codec_roundtrip(spark, sf_dir):
    return codec.decode_blocks(codec.encode_blocks(blocks.assign_blocks(events(spark, sf_dir))))


@query(f"{CHAIN} SELECT series_key, block_id, row_number() OVER (PARTITION BY series_key, block_id ORDER BY seq) - 1 AS place, ts_ms, value FROM blocks")
def short_codec_roundtrip(spark, sf_dir):
    return codec.decode_blocks(codec.encode_blocks(blocks.assign_blocks(events(spark, sf_dir)), short=True), short=True)


@query(f"{SIZES} SELECT series_key, block_id, bytes FROM sizes")
def encoded_bytes(spark, sf_dir):
    return codec.encode_blocks(blocks.assign_blocks(events(spark, sf_dir))).select("series_key", "block_id", F.octet_length("data").cast("bigint").alias("bytes"))


@query(f"{PTS} SELECT * FROM pts")
def journal_replay(spark, sf_dir):
    journal = Journal(spark, scratch(spark))
    journal.append(events(spark, sf_dir))
    return journal.replay()


@query(f"{PTS} SELECT series_key, max(ts_ms) AS ts_ms, arg_max(value, seq) AS value FROM pts GROUP BY 1")
def latest_point(spark, sf_dir):
    return scan.latest_point(events(spark, sf_dir))


@query(f"{PTS} SELECT series_key, min(ts_ms) AS first_ts, max(ts_ms) AS last_ts, count(*) AS n_points, min(value) AS min_value, max(value) AS max_value FROM pts GROUP BY 1")
def series_info(spark, sf_dir):
    return scan.series_info(events(spark, sf_dir))


@query(f"{PTS} SELECT series_key, {', '.join(f'round(quantile_cont(value, {s}), 6) AS p{round(s * 100)}' for s in (0.5, 0.9, 0.95, 0.99))} FROM pts GROUP BY 1")
def percentiles(spark, sf_dir):
    return rounded(aggregate.percentiles(events(spark, sf_dir)), "p50", "p90", "p95", "p99")


@query(f"""{PTS}, m AS (SELECT * FROM pts WHERE series_key IN ('click', 'view') AND ts_ms BETWEEN {T0} AND {T10}), a AS (SELECT series_key, min(ts_ms) AS t0 FROM m GROUP BY 1)
SELECT series_key, t0 + (ts_ms - t0) // {HOUR} * {HOUR} AS window_start, round(avg(value), 6) AS value, count(*) AS count FROM m JOIN a USING (series_key) GROUP BY 1, 2""")
def multi_series_step(spark, sf_dir):
    points = events(spark, sf_dir, ["click", "view"], T0, T10)
    return rounded(aggregate.anchored_windows(points, "avg", HOUR, few=True), "value")


_PAIRS = f"""{PTS}, h AS (SELECT series_key, ts_ms // {HOUR} * {HOUR} AS bucket, avg(value) AS v FROM pts GROUP BY 1, 2),
pairs AS (SELECT bucket, a.v AS x, b.v AS y FROM h a JOIN h b USING (bucket) WHERE a.series_key = 'click' AND b.series_key = 'view')"""


def _pairs(spark, sf_dir):
    return correlate.aligned(events(spark, sf_dir, ["click", "view"]), "click", "view", HOUR)


@query(f"{_PAIRS} SELECT round(corr(x, y), 6) AS corr, count(*) AS n FROM pairs")
def pearson(spark, sf_dir):
    return rounded(correlate.pearson(_pairs(spark, sf_dir)), "corr")


@query(f"""{_PAIRS}, k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS p, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS q FROM pairs)
SELECT round(corr(p, q), 6) AS corr, count(*) AS n FROM k""")
def spearman(spark, sf_dir):
    return rounded(correlate.spearman(_pairs(spark, sf_dir)), "corr")


@query(f"""{_PAIRS}, w AS (SELECT bucket, corr(x, y) OVER o AS corr, count(*) OVER o AS n FROM pairs WINDOW o AS (ORDER BY bucket ROWS 49 PRECEDING))
SELECT bucket, round(corr, 6) AS corr FROM w WHERE n = 50""")
def rolling_corr(spark, sf_dir):
    return rounded(correlate.rolling(_pairs(spark, sf_dir), 50), "corr")


@query(f"""{PTS}, l AS (SELECT series_key, value, lag(value, 3) OVER (PARTITION BY series_key ORDER BY ts_ms, seq) AS before FROM pts)
SELECT series_key, round(corr(value, before), 6) AS corr, count(*) AS n FROM l WHERE before IS NOT NULL GROUP BY 1""")
def autocorr(spark, sf_dir):
    return rounded(correlate.autocorrelation(events(spark, sf_dir), 3), "corr")


@query(f"""{PTS} SELECT series_key, ts_ms // {DAY} * {DAY} AS bucket, count(*) AS n, round(sum(value), 6) AS total, round(sum(value * value), 6) AS squares, min(value) AS low, max(value) AS high FROM pts GROUP BY 1, 2""")
def rollup_hour_day(spark, sf_dir):
    return rounded(aggregate.rollup_again(aggregate.rollup(events(spark, sf_dir), HOUR), DAY), "total", "squares")


@query(f"{PTS} SELECT * FROM pts WHERE ts_ms >= {T10}")
def retention(spark, sf_dir):
    return scan.retain(events(spark, sf_dir), T10)[0]


@query(f"{PTS} SELECT series_key, count(*) AS n_removed FROM pts WHERE ts_ms < {T10} GROUP BY 1")
def retention_removed(spark, sf_dir):
    return scan.retain(events(spark, sf_dir), T10)[1]


@query(f"{CHAIN}, s AS (SELECT series_key, block_id, min(ts_ms) AS start_ts, max(ts_ms) AS end_ts, count(*) AS count, arg_min(value, seq) AS first_value FROM blocks GROUP BY 1, 2) SELECT *, block_id < max(block_id) OVER (PARTITION BY series_key) OR {2**42} >= start_ts + 7200000 AS is_sealed FROM s")
def expired_blocks(spark, sf_dir):
    return blocks.sealed_at(blocks.assign_blocks(events(spark, sf_dir)), 2**42)


_SHARDS = [f"shard-{i:02d}" for i in range(16)]
_RING = """ring AS (SELECT ('0x' || substr(md5(shard || '/' || k::VARCHAR), 1, 15))::BIGINT AS stop, shard FROM (SELECT 'shard-' || lpad(i::VARCHAR, 2, '0') AS shard, i FROM range({n}) t(i)), range(64) u(k)),
keys AS (SELECT DISTINCT series_key, ('0x' || substr(md5(series_key), 1, 15))::BIGINT AS number FROM pts)"""
_OWNER = "coalesce((SELECT arg_min(shard, stop) FROM ring WHERE stop >= number{more}), (SELECT arg_min(shard, stop) FROM ring{only}))"


@query(f"{PTS}, {_RING.format(n=16)} SELECT series_key, {_OWNER.format(more='', only='')} AS shard FROM keys")
def shard_assign(spark, sf_dir):
    return scan.shard_of(events(spark, sf_dir), _SHARDS)


@query(f"""{PTS}, {_RING.format(n=16)}, moved AS (SELECT series_key, {_OWNER.format(more=" AND shard < 'shard-08'", only=" WHERE shard < 'shard-08'")} AS "from", {_OWNER.format(more='', only='')} AS "to" FROM keys)
SELECT * FROM moved WHERE "from" <> "to" """)
def shard_rebalance(spark, sf_dir):
    return scan.rebalanced(events(spark, sf_dir), _SHARDS[:8], _SHARDS)


@query(f"{PTS} SELECT * FROM pts")
def store_append(spark, sf_dir):
    path = scratch(spark)
    whole = events(spark, sf_dir)
    PointStore(spark, path).append(whole.where("seq % 2 = 0"))
    PointStore(spark, path).append(whole.where("seq % 2 = 1"))
    return PointStore(spark, path).points()


@query(f"{PTS} SELECT * FROM pts WHERE series_key = 'view' AND ts_ms BETWEEN {T0} AND {T10}")
def store_range(spark, sf_dir):
    store = PointStore(spark, scratch(spark))
    store.append(events(spark, sf_dir))
    return store.series("view", T0, T10)


@query(f"{PTS} SELECT * FROM pts WHERE ts_ms >= {T10 - 10_000_000}")
def store_retention(spark, sf_dir):
    store = PointStore(spark, scratch(spark))
    store.append(events(spark, sf_dir))
    store.retain(T10 - 10_000_000)
    return store.points()


@query(f"{CHAIN} SELECT series_key, block_id, min(ts_ms) AS start_ts, max(ts_ms) AS end_ts, count(*) AS count, arg_min(value, seq) AS first_value FROM blocks b WHERE block_id < (SELECT max(block_id) FROM blocks c WHERE c.series_key = b.series_key) GROUP BY 1, 2")
def journal_recover(spark, sf_dir):
    journal = Journal(spark, scratch(spark))
    journal.append(events(spark, sf_dir))
    return journal.recover()[0]


def _stream(spark, sf_dir) -> DataFrame:
    whole = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(whole.schema)
    if any(f.endswith("/events.parquet") for f in whole.inputFiles()):  # one file; a stream reads folders
        return from_events(stream.option("pathGlobFilter", "events.parquet").parquet(sf_dir))
    return from_events(stream.parquet(f"{sf_dir}/events.parquet"))


@query(f"{PTS} SELECT series_key, ts_ms // {HOUR} * {HOUR} AS window_start, round(avg(value), 6) AS value, count(*) AS count FROM pts GROUP BY 1, 2")
def stream_window_avg(spark, sf_dir):
    return rounded(ingest.drain(ingest.window_averages(_stream(spark, sf_dir), HOUR), scratch(spark), "complete"), "value")


@query(f"{CHAIN} SELECT series_key, block_id, min(ts_ms) AS start_ts, max(ts_ms) AS end_ts, count(*) AS count, arg_min(value, seq) AS first_value FROM blocks b WHERE block_id < (SELECT max(block_id) FROM blocks c WHERE c.series_key = b.series_key) GROUP BY 1, 2")
def stream_blocks(spark, sf_dir):
    return ingest.drain(ingest.sealed_blocks(_stream(spark, sf_dir)), scratch(spark))


__all__ = ["ORACLE_SQL", "POINTS", "QUERIES", "flagship"]
