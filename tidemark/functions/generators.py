"""Synthetic series for demonstrations, at a fixed base time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_MS = 1_609_459_200_000


def _series(spark: SparkSession, key: str, steps: int, value: str) -> DataFrame:
    return spark.range(steps).select(F.lit(key).alias("series_key"), (F.col("id") * 1000 + BASE_MS).alias("ts_ms"), F.expr(value).cast("double").alias("value"), F.col("id").alias("seq"))


#: Steps of one second and the value at step id.
SERVER = {
    "cpu.usage": "50 + 20 * sin(0.1 * id) + id % 10",
    "memory.usage": "60 + 15 * sin(0.1 * id) + 2 * (id % 5)",
    "disk.io": "1000 + 500 * sin(0.1 * id) + 10 * (id % 20)",
    "network.bytes": "10000 + 2000 * sin(0.1 * id) + 100 * (id % 15)",
}
CLIENT = {
    "server.cpu.percent": "30 + 20 * sin(0.01 * id) + 0.5 * (id % 17)",
    "server.memory.bytes": "4e9 + 1000 * id + if(id % 300 = 0, 5e8, 0)",
    "server.network.rx_bytes": "1e6 + if(id % 60 < 10, 1e7, 0) + 5e5 * cos(0.05 * id)",
}


def server(spark: SparkSession, steps: int = 1000) -> DataFrame:
    frames = [_series(spark, k, steps, v) for k, v in SERVER.items()]
    return frames[0].union(frames[1]).union(frames[2]).union(frames[3])


def client(spark: SparkSession, steps: int = 3600) -> DataFrame:
    frames = [_series(spark, k, steps, v) for k, v in CLIENT.items()]
    return frames[0].union(frames[1]).union(frames[2])
