"""Blocks of two hours: assignment, statistics, and the size that the compressed format takes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_MS = 7_200_000


def _fold(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = start = block = None
        for pdf in batches:
            ids = []
            for k, ts in zip(pdf["series_key"].tolist(), pdf["ts_ms"].tolist()):
                if k != key:
                    key, start, block = k, ts, 0
                elif not start <= ts < start + length:
                    start, block = ts, block + 1
                ids.append(block)
            yield pdf.assign(block_id=ids)

    return run


def assign_blocks(points: DataFrame, length_ms: int = BLOCK_MS) -> DataFrame:
    """points with block_id, from 0 for each series.

    In order of arrival a point joins the open block if it lies in its two hours; else, older or newer, it opens the
    next one at its own time.  Each point depends on the one before, so rows of a series pass one task, sorted and
    streamed; the state is one number, whatever the length of the series.
    """
    rows = points.select("series_key", "ts_ms", "value", "seq").repartition("series_key").sortWithinPartitions("series_key", "seq")
    return rows.mapInPandas(_fold(length_ms), "series_key string, ts_ms bigint, value double, seq bigint, block_id bigint")


def block_stats(blocks: DataFrame) -> DataFrame:
    """start_ts (when it opened), end_ts (its last time), count and first_value of each block."""
    return blocks.groupBy("series_key", "block_id").agg(
        F.min_by("ts_ms", "seq").alias("start_ts"), F.max("ts_ms").alias("end_ts"), F.count(F.lit(1)).alias("count"), F.min_by("value", "seq").alias("first_value")
    )


def compressed_bytes(blocks: DataFrame) -> DataFrame:
    """series_key, block_id, count and the bytes of each block in the compressed format, without encoding it.

    Every point after the first takes 1, 9, 12, 16 or 36 bits for the change of its time step, and 1 bit for a value
    of the same bits as before or 66 for another.
    """
    w = Window.partitionBy("series_key", "block_id").orderBy("seq")
    steps = blocks.select("series_key", "block_id", "seq", "value", F.lag("value").over(w).alias("before"), (F.col("ts_ms") - F.lag("ts_ms").over(w)).alias("step"))
    change = F.col("step") - F.coalesce(F.lag("step").over(w), F.lit(0))
    time_bits = F.when(change == 0, 1).when(change.between(-63, 64), 9).when(change.between(-255, 256), 12).when(change.between(-2047, 2048), 16).otherwise(36)
    same = (F.col("value") == F.col("before")) & (F.col("value").cast("string") == F.col("before").cast("string"))
    bits = F.when(F.col("step").isNull(), 0).otherwise(time_bits + F.when(same, 1).otherwise(66))
    return steps.withColumn("bits", bits).groupBy("series_key", "block_id").agg(F.count(F.lit(1)).alias("count"), F.ceil(F.sum("bits") / 8).cast("bigint").alias("bytes"))


def store_stats(points: DataFrame) -> DataFrame:
    """Series, points, blocks and compressed bytes; an open block counts as a block and has no bytes yet."""
    sizes = compressed_bytes(assign_blocks(points))
    series = sizes.groupBy("series_key").agg(F.sum("count").alias("points"), F.count(F.lit(1)).alias("blocks"), F.sum("bytes").alias("bytes"), F.max_by("bytes", "block_id").alias("open_bytes"))
    return series.agg(
        F.count(F.lit(1)).alias("n_series"),
        F.coalesce(F.sum("points"), F.lit(0)).alias("n_points"),
        F.coalesce(F.sum("blocks"), F.lit(0)).alias("n_blocks"),
        F.coalesce(F.sum(F.col("bytes") - F.col("open_bytes")), F.lit(0)).alias("compressed_bytes"),
    )


def compression_ratio(stats: DataFrame) -> DataFrame:
    """Bytes of the points as pairs of 64-bit numbers to the compressed bytes, 0 without any, and what is saved."""
    ratio = F.when(F.col("compressed_bytes") > 0, F.col("n_points") * 16 / F.col("compressed_bytes")).otherwise(F.lit(0.0))
    return stats.withColumn("ratio", ratio).withColumn("saved_percent", F.when(F.col("ratio") > 1, (1 - 1 / F.col("ratio")) * 100).otherwise(F.lit(0.0)))


def sealed_at(blocks: DataFrame, now_ms: int, length_ms: int = BLOCK_MS) -> DataFrame:
    """block_stats with is_sealed: a later block follows, or now_ms has come to the block's end."""
    stats = block_stats(blocks)
    last = stats.groupBy("series_key").agg(F.max("block_id").alias("last"))
    sealed = (F.col("block_id") < F.col("last")) | (F.lit(now_ms) >= F.col("start_ts") + length_ms)
    return stats.join(last, "series_key").select("series_key", "block_id", "start_ts", "end_ts", "count", "first_value", sealed.alias("is_sealed"))
