"""Scans and catalogue operators over points."""

from __future__ import annotations

import bisect
import hashlib
import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidTimeRange, SeriesNotFound
from .blocks import assign_blocks


def check_range(start: int, end: int) -> None:
    if start > end:
        raise InvalidTimeRange(f"range starts at {start}, after its end {end}")


def range_scan(points: DataFrame, key: str, start: int, end: int, strict: bool = False) -> DataFrame:
    """Points of a series with start <= ts_ms <= end, in time order, arrival breaking ties.

    strict: raise where the series has no points at all, which takes a job of its own.
    """
    check_range(start, end)
    series = points.where(F.col("series_key") == key)
    if strict and series.isEmpty():
        raise SeriesNotFound(key)
    return series.where(F.col("ts_ms").between(start, end)).orderBy("ts_ms", "seq")


def head_scan(points: DataFrame, key: str, start: int, end: int) -> DataFrame:
    """range_scan over the points of the series' open block alone."""
    check_range(start, end)
    blocks = assign_blocks(points.where(F.col("series_key") == key))
    last = blocks.groupBy("series_key").agg(F.max("block_id").alias("block_id"))
    return blocks.join(F.broadcast(last), ["series_key", "block_id"], "left_semi").where(F.col("ts_ms").between(start, end)).select("series_key", "ts_ms", "value", "seq").orderBy("ts_ms", "seq")


def list_series(points: DataFrame) -> DataFrame:
    return points.select("series_key").distinct()


def store_len(points: DataFrame) -> DataFrame:
    """Series and points, and whether there are none."""
    return points.agg(F.countDistinct("series_key").alias("n_series"), F.count("*").alias("n_points"), (F.count("*") == 0).alias("is_empty"))


def latest_point(points: DataFrame) -> DataFrame:
    """The last point of each series; of equal times the last to arrive."""
    last = F.max_by(F.struct("ts_ms", "value"), F.struct("ts_ms", "seq"))
    return points.groupBy("series_key").agg(last.alias("p")).select("series_key", "p.ts_ms", "p.value")


def series_info(points: DataFrame) -> DataFrame:
    return points.groupBy("series_key").agg(
        F.min("ts_ms").alias("first_ts"), F.max("ts_ms").alias("last_ts"), F.count("*").alias("n_points"), F.min("value").alias("min_value"), F.max("value").alias("max_value")
    )


def series_snapshot(points: DataFrame, key: str) -> DataFrame:
    """A series as one row for each block: its points in order of arrival, the last block open.  Blocks, not whole
    series, are gathered into rows."""
    blocks = assign_blocks(points.where(F.col("series_key") == key))
    rows = blocks.groupBy("series_key", "block_id").agg(F.sort_array(F.collect_list(F.struct("seq", "ts_ms", "value"))).alias("points"))
    last = rows.groupBy("series_key").agg(F.max("block_id").alias("last"))
    return rows.join(F.broadcast(last), "series_key").select("series_key", "block_id", (F.col("block_id") == F.col("last")).alias("is_open"), "points")


def retain(points: DataFrame, cutoff_ms: int) -> tuple[DataFrame, DataFrame]:
    """The points that stay (ts_ms >= cutoff_ms), and how many of each series go."""
    gone = points.where(F.col("ts_ms") < cutoff_ms).groupBy("series_key").agg(F.count("*").alias("n_removed"))
    return points.where(F.col("ts_ms") >= cutoff_ms), gone


#: The last number on a ring.
TOP = 2**60 - 1


def ring(shards: list[str], places: int = 64) -> list[tuple[int, str]]:
    """Where shards stand on a ring of 60-bit numbers, each at several places: the first 15 digits of MD5 of shard/k."""
    return sorted((int(hashlib.md5(f"{s}/{k}".encode()).hexdigest()[:15], 16), s) for s in set(shards) for k in range(places))


def arcs(*rings: list[tuple[int, str]]) -> list[tuple]:
    """Stretches of numbers on which no ring changes its shard: first and last number, and the shard on each ring."""
    at = [[a for a, _ in r] for r in rings]
    lasts = sorted({TOP, *itertools.chain.from_iterable(at)})
    return [(a + 1, b, *(r[bisect.bisect_left(x, b) % len(r)][1] for r, x in zip(rings, at))) for a, b in itertools.pairwise([-1, *lasts])]


def _placed(keys: DataFrame, found: list[tuple], names: list[str]) -> DataFrame:
    """series_key and the names of the arc of each different key whose number lies on an arc.

    The arcs are a small table, cut where the numbers' leading bits change and joined by those.  No expression of the
    key may be null, since the optimiser would test that for every point, before the keys are made distinct.
    """
    low = TOP.bit_length() - len(found).bit_length()
    rows = [(b, max(first, b << low), min(last, ((b + 1) << low) - 1), *shards) for first, last, *shards in found for b in range(first >> low, (last >> low) + 1)]
    table = keys.sparkSession.createDataFrame(rows, ", ".join(["bits long", "first long", "last long", *(f"`{n}` string" for n in names)]))
    number = F.coalesce(F.conv(F.substring(F.md5("series_key"), 1, 15), 16, 10).cast("bigint"), F.lit(0))
    each = keys.where("series_key IS NOT NULL").select("series_key").distinct().withColumn("number", number)
    on = (F.shiftright("number", low) == F.col("bits")) & F.col("number").between(F.col("first"), F.col("last"))
    return each.join(F.broadcast(table), on).select("series_key", *names)


def shard_of(keys: DataFrame, shards: list[str], places: int = 64) -> DataFrame:
    """series_key and shard of each different key: the first that stands at or after the key's own number on the ring,
    so that a shard more or less moves only the keys that it takes or leaves."""
    return _placed(keys, arcs(ring(shards, places)), ["shard"])


def rebalanced(keys: DataFrame, before: list[str], after: list[str], places: int = 64) -> DataFrame:
    """series_key, from, to of the keys that move when shards change: those on arcs that do."""
    return _placed(keys, [a for a in arcs(ring(before, places), ring(after, places)) if a[2] != a[3]], ["from", "to"])
