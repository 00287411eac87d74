"""Shards: rows by a hash of their key. Within a job Spark's shuffles do this; shards are for jobs that run side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shard(keys: list[str], n: int) -> Column:
    """The shard that owns a key, from 0; a NULL in the key means shard 0."""
    if n <= 0:
        raise ValueError("shards must be above 0")
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return F.when(missing, 0).otherwise(F.pmod(F.xxhash64(*keys), F.lit(n))).cast("int")


def owned(df: DataFrame, keys: list[str], i: int, n: int) -> DataFrame:
    """Rows of shard i of n."""
    return df.filter(shard(keys, n) == i)


def sharded(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Rows with equal keys in one of n partitions."""
    return df.repartition(n, *keys)


def migration(df: DataFrame, keys: list[str], before: int, after: int) -> DataFrame:
    """Keys that another shard owns once there are `after` instead of `before`: the keys, from_shard, to_shard."""
    moves = df.select(*keys).distinct().withColumn("from_shard", shard(keys, before)).withColumn("to_shard", shard(keys, after))
    return moves.filter("from_shard <> to_shard")


def absorbed(df: DataFrame, keys: list[str], failed: int, before: int) -> DataFrame:
    """Keys of a failed shard and who takes them: the keys, to_shard among the one fewer shards left, and from which of the old ones that is (was_shard). The shards left are renumbered without a gap."""
    if not 0 <= failed < before:
        raise ValueError(f"no shard {failed} of {before}")
    lost = owned(df, keys, failed, before).select(*keys).distinct()
    if before == 1:
        return lost.limit(0).withColumn("to_shard", F.lit(0)).withColumn("was_shard", F.lit(0))
    return lost.withColumn("to_shard", shard(keys, before - 1)).withColumn("was_shard", (F.col("to_shard") + (F.col("to_shard") >= failed).cast("int")).cast("int"))
