"""Places in a global order, without a task that sorts everything.

Values are dealt into ranges whose borders are quantiles; counts of the ranges, summed up, say where each begins, and
within a range rows are numbered.  Equal values are counted first, so that one value is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that values are dealt into.
RANGES = 64


def placed(values: DataFrame, column: str, by: tuple[str, ...] = (), ranges: int = RANGES) -> DataFrame:
    """by, column, ties, before and n: each different value of a group, how many rows have it, how many rows of the
    group have a smaller one, and the group's rows.  NaN is the greatest."""
    borders = sorted(set(values.approxQuantile(column, [k / ranges for k in range(1, ranges)], 1 / (4 * ranges))))
    borders = F.array(*map(F.lit, borders)) if borders else F.array().cast("array<double>")
    ties = values.groupBy(*by, column).agg(F.count(F.lit(1)).alias("ties"))
    dealt = ties.withColumn("_range", F.size(F.filter(borders, lambda b: b < F.col(column))))
    sizes = dealt.groupBy(*by, "_range").agg(F.sum("ties").alias("_size"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # one row for each range
    before = F.sum("_size").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*by, "_range", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_size").over(group).alias("n"))
    inside = F.sum("ties").over(Window.partitionBy(*by, "_range").orderBy(column).rowsBetween(Window.unboundedPreceding, -1))
    out = dealt.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(sizes, [*by, "_range"])
    return out.select(*by, column, "ties", (F.col("_before") + F.col("_inside")).alias("before"), "n")
