"""The eight aggregates over windows that start at a series' first point, and over windows of the epoch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from .ranks import placed

_ORDER = F.struct
_INF = float("inf")
#: First points up to which they are broadcast; with more, each is spread over so many parts.
BROADCAST_GROUPS, SALTS = 500_000, 16


def _number(value: str = "value") -> Column:
    return F.when(~F.isnan(value), F.col(value))


#: Minimum and maximum pass over NaN, and are infinite where nothing else is there; deviation is of the population.
AGGREGATES = {
    "sum": lambda: F.sum("value"),
    "avg": lambda: F.avg("value"),
    "min": lambda: F.coalesce(F.min(_number()), F.lit(_INF)),
    "max": lambda: F.coalesce(F.max(_number()), F.lit(-_INF)),
    "count": lambda: F.count(F.lit(1)).cast("double"),
    "first": lambda: F.min_by("value", F.struct("ts_ms", "seq")),
    "last": lambda: F.max_by("value", F.struct("ts_ms", "seq")),
    "stddev": lambda: F.stddev_pop("value"),
}


def aggregate(name: str) -> Column:
    if name not in AGGREGATES:
        raise QueryError(f"no aggregate {name!r}; there are {', '.join(AGGREGATES)}")
    return AGGREGATES[name]()


def check_window(window_ms: int) -> None:
    if window_ms <= 0:
        raise QueryError("a window must be longer than 0 ms")


def anchored_windows(points: DataFrame, name: str, window_ms: int, by: tuple[str, ...] = ("series_key",), few: bool | None = None) -> DataFrame:
    """window_start, value, count for each group of by and window, empty windows left out.

    Windows start at the group's first point.  The first points are found by a partial aggregate.  Up to
    BROADCAST_GROUPS of them are broadcast, so that points stay where they are and the aggregate itself combines before
    its one shuffle; more meet the points by a salted shuffle.  few: whether there are few, where the caller knows it;
    else they are counted.
    """
    check_window(window_ms)
    anchors = points.groupBy(*by).agg(F.min("ts_ms").alias("t0"))
    if few is None:
        few = anchors.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    if few:
        placed = points.join(F.broadcast(anchors), list(by))
    else:
        dealt = anchors.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        placed = points.withColumn("_salt", F.pmod(F.xxhash64("ts_ms", "seq"), F.lit(SALTS)).cast("int")).join(dealt, [*by, "_salt"]).drop("_salt")
    start = F.col("t0") + F.expr(f"(ts_ms - t0) div {int(window_ms)}") * window_ms
    return placed.withColumn("window_start", start).groupBy(*by, "window_start").agg(aggregate(name).alias("value"), F.count(F.lit(1)).alias("count"))


def epoch_windows(points: DataFrame, name: str, window_ms: int) -> DataFrame:
    """The same for windows that start at multiples of window_ms; no join."""
    check_window(window_ms)
    start = F.expr(f"ts_ms div {int(window_ms)}") * window_ms
    return points.withColumn("window_start", start).groupBy("series_key", "window_start").agg(aggregate(name).alias("value"), F.count(F.lit(1)).alias("count"))


def percentiles(points: DataFrame, shares: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99), exact: bool = True) -> DataFrame:
    """Percentiles of each series: interpolated and exact, or by sketches of bounded memory.

    The exact ones are picked by place: no task holds all values of a series.
    """
    names = [f"p{round(s * 100)}" for s in shares]
    if not exact:
        return points.groupBy("series_key").agg(*(F.percentile_approx("value", s).alias(p) for s, p in zip(shares, names)))
    every = placed(points.where("value IS NOT NULL"), "value", ("series_key",))
    picks = {}
    for s, p in zip(shares, names):
        at = (F.col("n") - 1) * F.lit(s)
        for side, place in (("low", F.floor(at)), ("high", F.ceil(at))):
            picks[f"{p}_{side}"] = F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("ties")), F.col("value")))
    found = every.groupBy("series_key").agg(F.first("n").alias("n"), *(c.alias(k) for k, c in picks.items()))

    def between(s: float, p: str) -> Column:
        part = (F.col("n") - 1) * F.lit(s) - F.floor((F.col("n") - 1) * F.lit(s))
        return F.when(part == 0, F.col(f"{p}_low")).otherwise((1 - part) * F.col(f"{p}_low") + part * F.col(f"{p}_high"))

    return found.select("series_key", *(between(s, p).alias(p) for s, p in zip(shares, names)))


def rollup(points: DataFrame, window_ms: int) -> DataFrame:
    """Sums from which all larger windows' sums, averages and deviations follow."""
    start = F.expr(f"ts_ms div {int(window_ms)}") * window_ms
    return points.groupBy("series_key", start.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.sum(F.col("value") * F.col("value")).alias("squares"), F.min("value").alias("low"), F.max("value").alias("high")
    )


def rollup_again(rolled: DataFrame, window_ms: int) -> DataFrame:
    """Roll-ups of larger windows from those of smaller ones."""
    start = F.expr(f"bucket div {int(window_ms)}") * window_ms
    return rolled.groupBy("series_key", start.alias("bucket")).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.min("low").alias("low"), F.max("high").alias("high")
    )
