"""Projection, filters and routes. Routes are filters over one input, so each branch reads only what it needs; NULL conditions count as false."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR = "error"


def map_rows(df: DataFrame, **columns: Column) -> DataFrame:
    """New columns from expressions."""
    return df.withColumns(columns)


def map_batches(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """For functions that have no expression: f takes and gives a pandas DataFrame, batch by batch."""
    return df.mapInPandas(lambda batches: map(f, batches), schema)


def memoizing_map(df: DataFrame, key: list[str], f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A costly function once for each distinct key: f adds columns to the distinct keys, which are joined back, NULL keys too."""
    done = f(df.select(*key).distinct())
    renamed = done.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], *[c for c in done.columns if c not in key])
    on = F.lit(True)
    for i, k in enumerate(key):
        on &= df[k].eqNullSafe(renamed[f"_k{i}"])
    return df.join(renamed, on).drop(*[f"_k{i}" for i in range(len(key))])


def filter_rows(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(condition)


def filter_map(df: DataFrame, value: Column, name: str) -> DataFrame:
    """A new column; rows where it is NULL go."""
    return df.withColumn(name, value).filter(F.col(name).isNotNull())


def for_each(df: DataFrame, values: Column, name: str) -> DataFrame:
    """A row for each element of an array."""
    return df.withColumn(name, F.explode(values))


def condition(df: DataFrame, test: Column) -> dict[str, DataFrame]:
    """true and false, and error where the test is NULL."""
    rows = df.withColumn("_test", test)
    return {k: rows.filter(c).drop("_test") for k, c in (("true", F.col("_test")), ("false", ~F.col("_test")), (ERROR, F.col("_test").isNull()))}


def branches(df: DataFrame, branch: Column, n: int, overflow: str = "default") -> dict[str, DataFrame]:
    """out_0 … out_{n-1} by the number in `branch`; without one, default; from n on, `overflow`."""
    rows = df.withColumn("_branch", branch)
    b = F.col("_branch")
    in_range = F.coalesce((b >= 0) & (b < n), F.lit(False))
    out = {f"out_{i}": rows.filter(b == i).drop("_branch") for i in range(n)}
    if overflow == "default":
        return out | {"default": rows.filter(~in_range).drop("_branch")}
    return out | {"default": rows.filter(b.isNull()).drop("_branch"), overflow: rows.filter(b.isNotNull() & ~in_range).drop("_branch")}


def first_match(tests: list[Column]) -> Column:
    """Number of the first test that holds, or NULL."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(tests))):
        out = F.when(tests[i], i).otherwise(out)
    return out


def match(df: DataFrame, tests: list[Column], n: int | None = None) -> dict[str, DataFrame]:
    """The first test that holds names the branch; n: how many branches there are."""
    return branches(df, first_match(tests), len(tests) if n is None else n)


def match_regex(df: DataFrame, column: str, patterns: list[str]) -> dict[str, DataFrame]:
    return match(df, [F.col(column).rlike(p) for p in patterns])


def match_exact(df: DataFrame, column: str, values: list) -> dict[str, DataFrame]:
    return match(df, [F.col(column) == v for v in values])


def match_range(df: DataFrame, column: str, ranges: list[tuple[int, int]]) -> dict[str, DataFrame]:
    """Ranges [a, b)."""
    return match(df, [(F.col(column) >= a) & (F.col(column) < b) for a, b in ranges])


def switch(df: DataFrame, branch: Column, n: int) -> dict[str, DataFrame]:
    """A branch number for each row; from n on it is an error."""
    return branches(df, branch, n, ERROR)


def split_errors(df: DataFrame, value: Column, name: str, message: str) -> dict[str, DataFrame]:
    """out with the value, and error with a message where it is NULL."""
    rows = df.withColumn(name, value)
    return {"out": rows.filter(F.col(name).isNotNull()), ERROR: rows.filter(F.col(name).isNull()).drop(name).withColumn(ERROR, F.lit(message))}


def error_branch(df: DataFrame, result: str = "result") -> dict[str, DataFrame]:
    """Structs of ok and err: payloads as `value` on success, messages on error."""
    rest = [c for c in df.columns if c != result]
    return {"success": df.filter(F.col(f"{result}.err").isNull()).select(*rest, F.col(f"{result}.ok").alias("value")), ERROR: df.filter(F.col(f"{result}.err").isNotNull()).select(*rest, F.col(f"{result}.err").alias(ERROR))}


def try_catch(df: DataFrame, attempt: Column, fallback: Column | None, name: str) -> dict[str, DataFrame]:
    """attempt, or fallback where it is NULL; error where both are."""
    return split_errors(df, attempt if fallback is None else F.coalesce(attempt, fallback), name, "no value")
