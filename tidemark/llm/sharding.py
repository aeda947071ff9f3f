"""Sharding by a permutation-filled lookup table.

Each shard prefers the slots of a prime-sized table in an order of its own: (offset + j * skip) mod size, from two
hashes of its name.  Shards take turns claiming the first slot they prefer that is still free, until the table is
full, so that shares differ by one slot at most and a change of shards moves few keys.  A key's slot is a hash of
it; the table, of a size fixed beforehand, is broadcast, and placement is one look-up.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of the table, a prime of at least a hundred times the number of shards.
SIZE = 8191
SHARDS = tuple(f"shard-{i:02d}" for i in range(64))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16)


def fill(shards: tuple[str, ...] = SHARDS, size: int = SIZE) -> list[int]:
    """For each slot the place of its shard in shards."""
    if len(shards) != len(set(shards)) or not 0 < len(shards) <= size:
        raise ValueError("shards must be different names, one at least and at most as many as slots")
    if size < 2 or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("size must be a prime")
    at = [_number(f"{s}/offset") % size for s in shards]
    skip = [_number(f"{s}/skip") % (size - 1) + 1 for s in shards]
    table = [-1] * size
    for turn in range(size):
        i = turn % len(shards)
        while table[at[i]] >= 0:
            at[i] = (at[i] + skip[i]) % size
        table[at[i]] = i
    return table


def lookup(spark: SparkSession, shards: tuple[str, ...] = SHARDS, size: int = SIZE) -> DataFrame:
    """slot, shard: the filled table as rows."""
    slots = F.from_json(F.lit(json.dumps(fill(shards, size))), "array<int>")
    names = F.array(*map(F.lit, shards))
    return spark.range(1).select(F.posexplode(slots).alias("slot", "i")).select("slot", F.get(names, F.col("i")).alias("shard"))


def slot_of(key: Column, size: int = SIZE) -> Column:
    """The slot of a key: the first 15 hexadecimal digits of its MD5, modulo size."""
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 15), 16, 10).cast("long") % size).cast("int")


def place(rows: DataFrame, key: str, shards: tuple[str, ...] = SHARDS, size: int = SIZE) -> DataFrame:
    """One row for each row of rows: its key, slot and shard.

    A null key has neither.  Equal keys, repeated rows too, share a shard; a key that many rows have is one key, and
    what is to be spread must have keys of its own.  Other columns are ignored; a key column may have any name, slot
    or shard too, whose column then comes first of two by that name.
    """
    keyed = rows.select(F.col(key).alias("_key"), slot_of(F.col(key), size).alias("_slot"))
    table = lookup(rows.sparkSession, shards, size).withColumnRenamed("slot", "_at")
    return keyed.join(F.broadcast(table), F.col("_slot") == F.col("_at"), "left").select(F.col("_key").alias(key), F.col("_slot").alias("slot"), "shard")
