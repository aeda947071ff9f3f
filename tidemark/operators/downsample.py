"""Downsampling to every s-th point."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Points are ranked within slices of this length, so that no task sorts a whole series.
SLICE_MS = 3_600_000


def ranked(points: DataFrame, by: tuple[str, ...] = ("series_key",), slice_ms: int = SLICE_MS) -> DataFrame:
    """points with rn, their place from 0 in the time order of their group, and n, the group's size.

    Counts of slices, summed up over a group, say where each slice begins; within a slice rows are numbered.
    """
    sliced = points.withColumn("_slice", F.expr(f"ts_ms div {int(slice_ms)}"))
    sizes = sliced.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_size"))
    group = Window.partitionBy(*by)
    before = F.sum("_size").over(group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*by, "_slice", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_size").over(group).alias("n"))
    inside = F.row_number().over(Window.partitionBy(*by, "_slice").orderBy("ts_ms", "seq"))
    return sliced.withColumn("_inside", inside).join(sizes, [*by, "_slice"]).withColumn("rn", F.col("_before") + F.col("_inside") - 1).drop("_slice", "_inside", "_before")


def downsample(points: DataFrame, max_points: int, by: tuple[str, ...] = ("series_key",)) -> DataFrame:
    """All points of a group that has at most max_points; else those at places 0, s, 2s, ... with s = ceil(n / m).
    max_points 0 leaves the first point."""
    if max_points < 0:
        raise ValueError("max_points is negative")
    step = F.when(F.lit(max_points) == 0, F.col("n")).otherwise(F.ceil(F.col("n") / F.lit(max(max_points, 1))).cast("bigint"))
    kept = (F.col("n") <= max_points) | (F.col("rn") % step == 0)
    return ranked(points, by).where(kept).drop("rn", "n")
