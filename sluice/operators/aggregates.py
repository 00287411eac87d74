"""Aggregation over everything or by key; partial sums in every task before the shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _by(df: DataFrame, keys: list[str] | None, **aggregates: Column) -> DataFrame:
    return df.groupBy(*(keys or [])).agg(*[v.alias(k) for k, v in aggregates.items()])


def count(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return _by(df, keys, count=F.count(F.lit(1)))


def total(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """0 for no rows; NULL if it overflows."""
    return _by(df, keys, sum=F.when(F.count(value) == 0, 0).otherwise(F.try_sum(value)))


def average(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """NULL for no rows."""
    return _by(df, keys, average=F.avg(F.col(value).cast("double")))


def minimum(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    return _by(df, keys, min=F.min(value))


def maximum(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    return _by(df, keys, max=F.max(value))


def group_by(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """A row for each key with its rows in order. For keys of bounded size; aggregates need no such rows."""
    item = F.struct(*order_by, F.struct(*[c for c in df.columns if c not in keys]).alias("_item"))
    return df.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["_item"]).alias("items"))


def aggregate(df: DataFrame, f: Callable[[DataFrame], DataFrame] | dict[str, Column], keys: list[str] | None = None, schema: str | None = None) -> DataFrame:
    """User-defined: columns of aggregate expressions, or a function of a key's pandas DataFrame with a schema."""
    if isinstance(f, dict):
        return _by(df, keys, **f)
    return df.groupBy(*(keys or [])).applyInPandas(f, schema)


def reduce(df: DataFrame, f: Callable[[Column, Column], Column], initial, value: str, order_by: list[str], state_type: str, keys: list[str] | None = None) -> DataFrame:
    """Left fold in order. For keys of bounded size; associative folds have aggregates without that bound."""
    rows = F.sort_array(F.collect_list(F.struct(*order_by, F.col(value).alias("_v"))))
    return _by(df, keys, result=F.aggregate(rows, F.lit(initial).cast(state_type), lambda acc, x: f(acc, x["_v"]).cast(state_type)))


def distinct(df: DataFrame, columns: list[str] | None = None, order_by: list[str] | None = None) -> DataFrame:
    """One row of each value, the first in order if one is given."""
    columns = columns or df.columns
    if not order_by:
        return df.dropDuplicates(columns)
    return df.groupBy(*[F.col(c).alias(f"_{c}") for c in columns]).agg(F.min_by(F.struct(*df.columns), F.struct(*order_by)).alias("_row")).select("_row.*")


def differential_group_by(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """Each change row with its key's count after it."""
    w = W.partitionBy(*keys).orderBy(*order_by).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("count", F.sum("diff").over(w))


def to_differential(df: DataFrame, time: Column) -> DataFrame:
    """Rows as insertions."""
    return df.withColumn("time", time.cast("long")).withColumn("diff", F.lit(1).cast("long"))
