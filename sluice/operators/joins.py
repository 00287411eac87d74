"""Joins of rows, and of change streams. Strategies are left to the planner, which broadcasts by size and splits skewed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRATEGIES = {"inner": "inner", "left": "left", "right": "right", "outer": "full"}


def join(left: DataFrame, right: DataFrame, keys: list[str], strategy: str = "inner") -> DataFrame:
    """Equal keys; all pairs of a key. Columns other than keys must differ in name. NULL keys match nothing."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy: {strategy}")
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    return left.join(right, keys, STRATEGIES[strategy])


def differential_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Change rows (time, diff): each pair of a key at the later time, with the product of both diffs; pairs that cancel go."""
    a = left.withColumnsRenamed({"time": "_lt", "diff": "_ld"})
    b = right.withColumnsRenamed({"time": "_rt", "diff": "_rd"})
    out = join(a, b, keys).withColumn("time", F.greatest("_lt", "_rt")).withColumn("diff", F.col("_ld") * F.col("_rd"))
    return out.filter("diff <> 0").drop("_lt", "_rt", "_ld", "_rd")


def consolidated(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows that a change stream leaves, with their multiplicity in diff."""
    return df.groupBy(*columns).agg(F.sum("diff").alias("diff")).filter("diff <> 0")
