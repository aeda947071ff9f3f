"""Points: (series_key, ts_ms, value, seq), and adapters that give them from other tables."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = T.StructType(
    [
        T.StructField("series_key", T.StringType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("seq", T.LongType()),
    ]
)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], POINTS)


def create(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Points from (series_key, ts_ms, value) in order of arrival."""
    return spark.createDataFrame([(*row, i) for i, row in enumerate(rows)], POINTS)


def clean(points: DataFrame) -> DataFrame:
    """The canonical columns, without rows that lack a key, time or value; times before 0 have no meaning here."""
    kept = points.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in POINTS))
    return kept.where("series_key IS NOT NULL AND ts_ms >= 0 AND value IS NOT NULL")


def _millis(column: str) -> Column:
    return F.unix_millis(F.col(column).cast("timestamp"))


def _instant(ms: int) -> Column:
    return F.lit(datetime.fromtimestamp(ms / 1000, timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def between(table: DataFrame, column: str, start: int | None, end: int | None) -> DataFrame:
    """Rows whose time, floored to milliseconds, lies in [start, end], by bounds on the stored column, which the
    Parquet reader takes."""
    if start is not None:
        table = table.where(F.col(column) >= _instant(start))
    if end is not None:
        table = table.where(F.col(column) < _instant(end + 1))
    return table


def from_events(events: DataFrame, keys: list[str] | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """A series for each event type; keys and range reach the scan."""
    if keys is not None:
        events = events.where(F.col("event_type").isin(keys))
    events = between(events, "ts", start, end)
    return events.select(F.col("event_type").alias("series_key"), _millis("ts").alias("ts_ms"), "value", F.col("event_id").alias("seq"))


def from_lineitem(items: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """A series of quantities for each return flag; many points share a time."""
    items = between(items, "l_shipdate", start, end)
    seq = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return items.select(F.col("l_returnflag").alias("series_key"), _millis("l_shipdate").alias("ts_ms"), F.col("l_quantity").alias("value"), seq.alias("seq"))
