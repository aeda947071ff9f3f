"""Queries over series, one or many, as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidTimeRange, QueryError, SeriesNotFound
from ..operators.aggregate import AGGREGATES, anchored_windows, check_window
from ..operators.downsample import downsample

#: Requests of one call whose table and first points are broadcast.
FEW_REQUESTS = 10_000


@dataclass(frozen=True)
class Query:
    """An inclusive range of a series; a cap on points, then an aggregate over windows, each if asked for."""

    key: str
    start: int
    end: int
    aggregate: str | None = None
    window_ms: int | None = None
    max_points: int | None = None

    def with_aggregate(self, name: str, window_ms: int) -> Query:
        return replace(self, aggregate=name, window_ms=window_ms)

    def with_max_points(self, n: int) -> Query:
        return replace(self, max_points=n)

    def validate(self) -> Query:
        if self.start > self.end:
            raise InvalidTimeRange(f"range starts at {self.start}, after its end {self.end}")
        if self.aggregate is not None:
            if self.window_ms is None:
                raise QueryError("an aggregate needs a window")
            if self.aggregate not in AGGREGATES:
                raise QueryError(f"no aggregate {self.aggregate!r}")
            check_window(self.window_ms)
        if self.max_points is not None and self.max_points < 0:
            raise QueryError("max_points is negative")
        return self


def execute(points: DataFrame, query: Query, strict: bool = False) -> DataFrame:
    """Range, then cap, then aggregate.  Without an aggregate: series_key, ts_ms, value, seq in time order; with one:
    window_start, value, count in time order.  No point in range gives no row, with the same columns."""
    query.validate()
    series = points.where(F.col("series_key") == query.key)
    if strict and series.isEmpty():
        raise SeriesNotFound(query.key)
    found = series.where(F.col("ts_ms").between(query.start, query.end))
    if query.max_points is not None:
        found = downsample(found, query.max_points)
    if query.aggregate is None:
        return found.select("series_key", "ts_ms", "value", "seq").orderBy("ts_ms", "seq")
    windows = anchored_windows(found, query.aggregate, query.window_ms, few=True)  # one series, one first point
    return windows.select("window_start", "value", "count").orderBy("window_start")


def execute_multi(points: DataFrame, queries: list[Query]) -> DataFrame:
    """All queries in one plan over one scan: req_id (their place in the list) before the columns of execute().

    They must agree on aggregate, window and cap.  Any that is wrong fails the call; a key may come again.
    """
    if not queries:
        raise QueryError("no queries")
    for q in queries:
        q.validate()
    if len({(q.aggregate, q.window_ms, q.max_points) for q in queries}) > 1:
        raise QueryError("queries of one call must agree on aggregate, window and cap")
    spark, first = points.sparkSession, queries[0]
    few = len(queries) <= FEW_REQUESTS
    requests = spark.createDataFrame([(i, q.key, q.start, q.end) for i, q in enumerate(queries)], "req_id int, want string, a bigint, b bigint")
    met = points.where(F.col("series_key").isin(sorted({q.key for q in queries}))) if few else points
    met = met.join(F.broadcast(requests) if few else requests, (F.col("series_key") == F.col("want")) & F.col("ts_ms").between(F.col("a"), F.col("b"))).drop("want", "a", "b")
    by = ("req_id", "series_key")
    if first.max_points is not None:
        met = downsample(met, first.max_points, by)
    if first.aggregate is None:
        return met.select(*by, "ts_ms", "value", "seq")
    return anchored_windows(met, first.aggregate, first.window_ms, by, few).select(*by, "window_start", "value", "count")
