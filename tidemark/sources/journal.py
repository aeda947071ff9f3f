"""A journal of points: an append-only Parquet folder.  A commit is whole or absent, so no entry is ever torn."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import assign_blocks, block_stats

ENTRIES = "series_key string, ts_ms bigint, value double, seq bigint, wal_ts_ms bigint"


class Journal:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], ENTRIES).write.mode("append").parquet(path)

    def append(self, points: DataFrame, now_ms: int | None = None) -> None:
        """Add points, stamped with the clock of the write or with now_ms."""
        stamp = F.unix_millis(F.current_timestamp()) if now_ms is None else F.lit(now_ms).cast("bigint")
        points.select("series_key", "ts_ms", "value", "seq", stamp.alias("wal_ts_ms")).write.mode("append").parquet(self.path)

    def entries(self) -> DataFrame:
        return self.spark.read.schema(ENTRIES).parquet(self.path)

    def replay(self) -> DataFrame:
        """The points of all entries; seq keeps their order of arrival."""
        return self.entries().select("series_key", "ts_ms", "value", "seq")

    def replay_each(self, use: Callable) -> int:
        """use(rows of a partition) on the executors for all entries, and how many there are."""
        self.entries().foreachPartition(use)
        return self.count()

    def count(self) -> int:
        return self.entries().count()

    def recover(self) -> tuple[DataFrame, DataFrame]:
        """What a lost store held: the sealed blocks of the entries (block_stats) and the points of open blocks."""
        rows = assign_blocks(self.replay())
        last = rows.groupBy("series_key").agg(F.max("block_id").alias("last"))
        sealed = block_stats(rows).join(last, "series_key").where("block_id < last").drop("last")
        return sealed, rows.join(last, "series_key").where("block_id = last").drop("last", "block_id")

    def truncate(self) -> None:
        self.spark.createDataFrame([], ENTRIES).write.mode("overwrite").parquet(self.path)
