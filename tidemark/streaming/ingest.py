"""Streams of points: blocks by a stateful operator, and averages over windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.blocks import BLOCK_MS

SEALED = "series_key string, block_id bigint, start_ts bigint, end_ts bigint, count bigint, first_value double"


def machine(length_ms: int = BLOCK_MS, idle_ms: int | None = None) -> Callable:
    """The block machine of one series: handles a batch of its points, or that none came in time."""
    columns = ["series_key", "block_id", "start_ts", "end_ts", "count", "first_value"]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = list(state.get) if state.exists else None  # block_id, start_ts, end_ts, count, first_value
        out = []
        if state.hasTimedOut:
            if now and now[3]:
                out.append((key[0], *now))
                state.update((now[0] + 1, -1, -1, 0, 0.0))
            yield pd.DataFrame(out, columns=columns)
            return
        every = pd.concat(list(batches), ignore_index=True).sort_values("seq", kind="stable")
        for ts, value in zip(every["ts_ms"].tolist(), every["value"].tolist()):
            if now and now[3] and now[1] <= ts < now[1] + length_ms:
                now[2], now[3] = max(now[2], ts), now[3] + 1
                continue
            block = 0
            if now:
                block = now[0]
                if now[3]:
                    out.append((key[0], *now))
                    block += 1
            now = [block, ts, ts, 1, value]
        state.update(tuple(now))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=columns)

    return run


def sealed_blocks(points: DataFrame, length_ms: int = BLOCK_MS, idle_ms: int | None = None) -> DataFrame:
    """Blocks of a stream of points as they are sealed; the open block of a series is its state.

    A point outside the open block, older ones too, seals it and opens the next; nothing is dropped as late.  Within
    a batch points count in the order of seq.  idle_ms: seal a block also when no point has come for so long.
    """
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    held = "block_id bigint, start_ts bigint, end_ts bigint, count bigint, first_value double"
    return points.groupBy("series_key").applyInPandasWithState(machine(length_ms, idle_ms), SEALED, held, "append", timeout)


def window_averages(points: DataFrame, window_ms: int, late: str = "2 hours") -> DataFrame:
    """Averages over windows of the epoch; points later than late no longer count."""
    timed = points.withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", late)
    means = timed.groupBy(F.window("at", f"{window_ms} milliseconds"), "series_key").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("count"))
    return means.select("series_key", F.unix_millis("window.start").alias("window_start"), "value", "count")


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now, and read what it wrote below path; append mode writes Parquet, any other
    the whole result of the last batch."""
    writer = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    out = f"{path}/out"
    if mode == "append":
        query = writer.format("parquet").option("path", out).outputMode("append").start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).outputMode(mode).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
