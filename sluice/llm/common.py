"""Session helpers shared by the corpus operators: working tables and Arrow batches of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.working import Working, shared_dir  # noqa: F401

#: Words of all contracts: runs of anything but space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts are taken to numpy in slices of about this many bytes (a longer text is a slice of its own).
SLICE_BYTES = 2 << 20


class Workspace(Working):
    """Working tables of one operator call; long texts make large rows, so few rows go to an Arrow batch while they are made."""

    def save(self, df: DataFrame, table: str, **options: str) -> DataFrame:
        conf, name = self.spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = conf.get(name, None)
        conf.set(name, str(min(1000, int(before or 10000))))
        try:
            return super().save(df, table, **options)
        finally:
            conf.unset(name) if before is None else conf.set(name, before)


def running(df: DataFrame, key: str, order: str, value: str, name: str, width: int = 4096) -> DataFrame:
    """df with `name`: the sum of `value` over the rows of the same key before it. key: no nulls; order: a number, once for each key.

    Sums within blocks of `width` orders and then over blocks, so that a key's rows are spread over tasks.
    """
    block = F.expr(f"{order} div {width}")
    inner = df.withColumn("_block", block).withColumn("_inner", F.sum(value).over(W.partitionBy(key, "_block").orderBy(order)) - F.col(value))
    sums = df.groupBy(F.col(key).alias("_key"), block.alias("_b")).agg(F.sum(value).alias("_sum")).withColumn("_before", F.sum("_sum").over(W.partitionBy("_key").orderBy("_b")) - F.col("_sum"))
    joined = inner.join(sums, (F.col(key) == F.col("_key")) & (F.col("_block") == F.col("_b")))
    return joined.withColumn(name, F.col("_inner") + F.col("_before")).drop("_block", "_inner", "_key", "_b", "_sum", "_before")


#: A mixture's sources: a table of one row for each comes to the driver and to all tasks.
MOST_SOURCES = 1_000_000


def source_sums(parts: DataFrame, value: str = "n") -> list[tuple]:
    """(source, sum) by code point, null last; an error if there are too many sources for one table."""
    found = [tuple(x) for x in parts.groupBy("source").agg(F.sum(value)).limit(MOST_SOURCES + 1).collect()]
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: mix by a coarser column")
    return sorted(found, key=lambda x: (x[0] is None, x[0] or ""))


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores behind it while df has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that `column` holds about `most` bytes in each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and where each begins and ends; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def trim() -> None:
    """Freed memory goes back to the system, as Spark keeps its Python workers."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library than glibc
        pass


def released(rows: Iterator) -> Iterator:
    """The rows; memory is given back at the end of a task."""
    try:
        yield from rows
    finally:
        trim()


def map_batches(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """mapInArrow; f takes the iterator of batches."""
    return df.mapInArrow(lambda batches: released(f(batches)), schema)


def map_arrow(df: DataFrame, f: Callable, schema: str, column: str = "text") -> DataFrame:
    """mapInArrow over slices of bounded size; f takes the iterator of slices."""
    return map_batches(df, lambda batches: f(sliced(batches, column)), schema)


def record(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t.type) for x, t in ((columns[t.name], t) for t in schema)], schema=schema)
