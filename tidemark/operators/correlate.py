"""Correlation of series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .aggregate import epoch_windows
from .downsample import ranked
from .ranks import placed

#: Pairs of a slice of rolling().
SLICE = 4096


def aligned(points: DataFrame, left: str, right: str, window_ms: int) -> DataFrame:
    """bucket, x, y: averages of two series in the windows of the epoch that both have."""
    means = epoch_windows(points.where(F.col("series_key").isin(left, right)), "avg", window_ms)
    sides = means.groupBy("window_start").agg(F.max(F.when(F.col("series_key") == left, F.col("value"))).alias("x"), F.max(F.when(F.col("series_key") == right, F.col("value"))).alias("y"))
    return sides.where("x IS NOT NULL AND y IS NOT NULL").withColumnRenamed("window_start", "bucket")


def pearson(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.corr("x", "y").alias("corr"), F.count(F.lit(1)).alias("n"))


def _average_rank(pairs: DataFrame, column: str) -> DataFrame:
    """value -> average rank."""
    return placed(pairs, column).select(F.col(column).alias(f"of_{column}"), (F.col("before") + (F.col("ties") + 1) / 2).alias(f"rank_{column}"))


def spearman(pairs: DataFrame) -> DataFrame:
    """Pearson of average ranks; ties share theirs."""
    for c in ("x", "y"):
        pairs = pairs.join(_average_rank(pairs.select(c), c), F.col(c) == F.col(f"of_{c}"))
    return pairs.agg(F.corr("rank_x", "rank_y").alias("corr"), F.count(F.lit(1)).alias("n"))


def rolling(pairs: DataFrame, n: int = 50) -> DataFrame:
    """bucket, corr of the last n pairs, where there are as many.

    Pairs are numbered by ranges of time and dealt into slices; the last n - 1 of a slice are in the next one too, so
    that each window lies in one slice.
    """
    size = max(SLICE, n)
    numbered = pairs.join(placed(pairs.select(F.col("bucket").cast("double").alias("at")), "at").select("at", F.col("before").alias("rn")), F.col("bucket").cast("double") == F.col("at"))
    own = F.expr(f"rn div {size}")
    both = F.when(F.col("rn") % size > size - n, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = numbered.select("bucket", "x", "y", "rn", own.alias("own"), F.explode(both).alias("slice"))
    w = Window.partitionBy("slice").orderBy("rn").rowsBetween(1 - n, 0)
    found = dealt.select("bucket", "own", "slice", "rn", F.corr("x", "y").over(w).alias("corr"))
    return found.where((F.col("own") == F.col("slice")) & (F.col("rn") >= n - 1)).select("bucket", "corr")


def autocorrelation(points: DataFrame, lag: int = 1) -> DataFrame:
    """Pearson of each series' values with those lag points before, which meet by their numbers."""
    numbered = ranked(points).select("series_key", "value", "rn")
    pairs = numbered.join(numbered.select("series_key", F.col("value").alias("before"), (F.col("rn") + lag).alias("rn")), ["series_key", "rn"])
    return pairs.groupBy("series_key").agg(F.corr("value", "before").alias("corr"), F.count(F.lit(1)).alias("n"))
