"""Iteration, retries and variables. Loops run on the driver over lazy tables; each round's table is written, so plans don't grow."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .order import merged
from .working import saved


def bounded_iteration(seed: DataFrame, step: Callable[[DataFrame], DataFrame], max_rounds: int, converged: Callable[[DataFrame, DataFrame], bool] | None = None) -> DataFrame:
    """Outputs of all rounds, with `round` from 1. The first round takes the seed, each other one the output before."""
    out, current = [], seed
    for i in range(1, max_rounds + 1):
        before, current = current, saved(step(current))
        out.append(current.withColumn("round", F.lit(i)))
        if converged is not None and converged(before, current):
            break
    return merged(out) if out else seed.limit(0).withColumn("round", F.lit(0))


def while_loop(df: DataFrame, condition: Column, max_iterations: int, body: Callable[[DataFrame], DataFrame] | None = None, stop: Column | None = None) -> dict[str, DataFrame]:
    """out: rows for which the condition became false; break: those for which `stop` held; error: those left after max_iterations rounds of body."""
    out, broken, rest = [], [], df
    for _ in range(max_iterations if body is not None else 1):
        if stop is not None:
            broken.append(rest.filter(stop))
            rest = rest.filter(~F.coalesce(stop, F.lit(False)))
        out.append(rest.filter(~F.coalesce(condition, F.lit(False))))
        rest = rest.filter(condition)
        if body is None:
            break
        rest = saved(body(rest))
        if rest.isEmpty():
            break
    return {"out": merged(out) if out else df.limit(0), "break": merged(broken) if broken else df.limit(0), "error": rest}


def with_retries(df: DataFrame, f: Callable, schema: str, max_retries: int, base_delay_ms: int = 0) -> DataFrame:
    """f on pandas batches with a backoff of base * 2 ** attempt; the last error fails the task, which Spark retries in turn."""

    def run(batches):
        for batch in batches:
            for attempt in range(max_retries + 1):
                try:
                    yield f(batch)
                    break
                except Exception:
                    if attempt == max_retries:
                        raise
                    time.sleep(base_delay_ms * 2**attempt / 1000)

    return df.mapInPandas(run, schema)


def retried(df: DataFrame, f: Callable, schema: str, max_retries: int, base_delay_ms: int = 0) -> dict[str, DataFrame]:
    """out: what f makes of pandas batches; error: the rows for which the last attempt failed, with its message.

    A batch that fails is tried again row by row, so a bad row costs no other one. All is written once, then split.
    """
    made, given = T.StructType.fromDDL(schema), df.schema
    both = T.StructType([T.StructField(f"_o_{x.name}", x.dataType) for x in made] + [T.StructField(f"_i_{x.name}", x.dataType) for x in given] + [T.StructField("_error", T.StringType())])

    def filled(part, prefix, error):
        part = part.rename(columns=lambda c: prefix + c).reset_index(drop=True)
        return part.assign(_error=error).reindex(columns=both.names).astype({c: object for c in both.names if c not in part.columns}).replace({float("nan"): None})

    def attempts(rows):
        for attempt in range(max_retries + 1):
            try:
                return f(rows), None
            except Exception as e:
                last = e
                if attempt < max_retries:
                    time.sleep(base_delay_ms * 2**attempt / 1000)
        return None, str(last) or type(last).__name__

    def run(batches):
        for batch in batches:
            try:
                yield filled(f(batch), "_o_", None)
            except Exception:
                alike, failed, errors = {}, [], []  # frames of the same types go together, so no value changes its type
                for i in range(len(batch)):
                    out, error = attempts(batch.iloc[i : i + 1])
                    if error is None:
                        alike.setdefault(tuple(map(str, out.dtypes.items())), []).append(out)
                    else:
                        failed.append(i)
                        errors.append(error)
                for frames in alike.values():
                    yield filled(pd.concat(frames), "_o_", None)
                if failed:
                    yield filled(batch.iloc[failed], "_i_", errors)

    rows = saved(df.mapInPandas(run, both))
    out = rows.filter("_error is null").select(*[F.col(f"_o_{x.name}").alias(x.name) for x in made])
    return {"out": out, "error": rows.filter("_error is not null").select(*[F.col(f"_i_{x.name}").alias(x.name) for x in given], F.col("_error").alias("error"))}


def retry(action: Callable, max_retries: int, base_delay_ms: int = 0):
    """action() on the driver, as with_retries()."""
    for attempt in range(max_retries + 1):
        try:
            return action()
        except Exception:
            if attempt == max_retries:
                raise
            time.sleep(base_delay_ms * 2**attempt / 1000)


class Variables:
    """Named values on the driver; `table` gives those of a table of (name, value, seq): the last of each name."""

    def __init__(self):
        self._values: dict[str, object] = {}

    def write(self, name: str, value):
        self._values[name] = value
        return value

    def read(self, name: str):
        if name not in self._values:
            raise KeyError(f"variable {name} is not set")
        return self._values[name]

    @staticmethod
    def table(writes: DataFrame) -> DataFrame:
        return writes.groupBy("name").agg(F.max_by("value", "seq").alias("value"))

    @staticmethod
    def lookup(reads: DataFrame, writes: DataFrame) -> dict[str, DataFrame]:
        """reads (with `name`) joined to the variables: out, and error for names without a value."""
        rows = reads.join(Variables.table(writes).withColumnRenamed("name", "_name"), F.col("name") == F.col("_name"), "left")
        return {"out": rows.filter("_name is not null").drop("_name"), "error": rows.filter("_name is null").drop("_name", "value")}
