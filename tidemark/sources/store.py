"""A store of points: a Parquet folder partitioned by part of the key and by day, that is appended to and reopened."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .points import clean

DAY_MS = 86_400_000
STORED = "series_key string, ts_ms bigint, value double, seq bigint, part int, day bigint"


class PointStore:
    """parts: into how many the keys are dealt by hash; a key's range reads one part and the days it covers."""

    def __init__(self, spark: SparkSession, path: str, parts: int = 16):
        self.spark, self.path, self.parts = spark, path, parts

    def _part(self, key) -> F.Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def append(self, points: DataFrame) -> None:
        """Add points; what one call adds is there whole or not at all."""
        rows = clean(points).withColumns({"part": self._part("series_key"), "day": F.expr(f"ts_ms div {DAY_MS}")})
        rows.repartition("part", "day").write.mode("append").partitionBy("part", "day").parquet(self.path)

    def points(self) -> DataFrame:
        """All points; none where nothing was ever added."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], STORED).drop("part", "day")
        return self.spark.read.schema(STORED).parquet(self.path).drop("part", "day")

    def series(self, key: str, start: int, end: int) -> DataFrame:
        """Points of a series in an inclusive range, from its part and days alone."""
        part = self.spark.range(1).select(self._part(F.lit(key))).first()[0]
        rows = self.spark.read.schema(STORED).parquet(self.path).where((F.col("part") == part) & F.col("day").between(start // DAY_MS, end // DAY_MS))
        return rows.where((F.col("series_key") == key) & F.col("ts_ms").between(start, end)).drop("part", "day")

    def retain(self, cutoff_ms: int) -> int:
        """Remove points before cutoff_ms from the store, and tell how many.  Whole days go as folders; the points of
        the cutoff's own day that stay are written over that day."""
        day = cutoff_ms // DAY_MS
        rows = self.spark.read.schema(STORED).parquet(self.path)
        old = rows.where(f"day <= {day}").groupBy("part", "day").agg(F.sum((F.col("ts_ms") < cutoff_ms).cast("long")).alias("gone"), F.count("*").alias("n")).collect()  # one row a folder
        split = [r for r in old if 0 < r.gone < r.n]
        if split:
            spare = PointStore(self.spark, f"{self.path.rstrip('/')}_kept", self.parts)
            kept = rows.where(f"day = {day} and ts_ms >= {cutoff_ms}")
            kept.write.mode("overwrite").partitionBy("part", "day").parquet(spare.path)
            kept = self.spark.read.schema(STORED).parquet(spare.path)
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "day").parquet(self.path)
            self._remove(spare.path)
        for r in old:
            if r.gone == r.n:
                self._remove(f"{self.path.rstrip('/')}/part={r.part}/day={r.day}")
        return sum(r.gone for r in old)

    def _remove(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
