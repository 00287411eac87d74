"""Global positions of rows without one task that sees them all.

Rows are range-partitioned and sorted by the order columns and written with their partition and place in it; partitions'
counts, one row each, give the rows before every partition. What needs neighbours joins on positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .working import saved

POSITION = "position"


def partitioned(df: DataFrame, order_by: list[str]) -> DataFrame:
    """Sorted rows with _part and _place, written whole: joining positions back to the rest would shuffle it once more."""
    rows = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    return saved(rows.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))


def positioned(df: DataFrame, order_by: list[str], partition_by: list[str] | None = None, name: str = POSITION) -> DataFrame:
    """df with positions from 0. order_by should settle the order fully; keys in partition_by are numbered each."""
    if partition_by:
        return df.withColumn(name, F.row_number().over(W.partitionBy(*partition_by).orderBy(*order_by)).cast("long") - 1)
    rows = partitioned(df, order_by)
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = counts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return rows.join(starts, F.col("_part") == F.col("_p")).withColumn(name, (F.col("_start") + F.col("_place")).cast("long")).drop("_part", "_place", "_p", "_start")


def take(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """The first n rows, by partial top-n in every task."""
    return df.orderBy(*order_by).limit(n)


limit = take


def skip(df: DataFrame, n: int, order_by: list[str], partition_by: list[str] | None = None) -> DataFrame:
    return positioned(df, order_by, partition_by).filter(F.col(POSITION) >= n).drop(POSITION)


def _end(df: DataFrame, order_by: list[str], partition_by: list[str] | None, pick) -> DataFrame:
    groups = df.groupBy(*(partition_by or []))
    return groups.agg(pick(F.struct(*df.columns), F.struct(*order_by)).alias("_row")).filter("_row is not null").select("_row.*")


def first(df: DataFrame, order_by: list[str], partition_by: list[str] | None = None) -> DataFrame:
    """One row, pre-aggregated in every task; one of each key if keys are given."""
    return _end(df, order_by, partition_by, F.min_by)


def last(df: DataFrame, order_by: list[str], partition_by: list[str] | None = None) -> DataFrame:
    return _end(df, order_by, partition_by, F.max_by)


def sample(df: DataFrame, every: int, order_by: list[str], partition_by: list[str] | None = None) -> DataFrame:
    """Rows number every, 2 * every and so on."""
    if every <= 0:
        raise ValueError("rate must be above 0")
    return positioned(df, order_by, partition_by).filter((F.col(POSITION) + 1) % every == 0).drop(POSITION)


def neighbour(df: DataFrame, columns: list[str], order_by: list[str], step: int, name: str) -> DataFrame:
    """df with position, and the row `step` before (after, if negative) in a struct, NULL where there is none."""
    rows = positioned(df, order_by)
    other = rows.select((F.col(POSITION) + step).alias("_next"), F.struct(*columns).alias(name))
    return rows.join(other, F.col(POSITION) == F.col("_next"), "left").drop("_next")


def running_max(df: DataFrame, value: str, order_by: list[str], partition_by: list[str] | None = None, name: str = "max") -> DataFrame:
    """The largest value of the rows before each. Without keys: maxima within partitions, and the partitions' maxima before them."""
    if partition_by:
        return df.withColumn(name, F.max(value).over(W.partitionBy(*partition_by).orderBy(*order_by).rowsBetween(W.unboundedPreceding, -1)))
    rows = partitioned(df, order_by)
    tops = rows.groupBy("_part").agg(F.max(value).alias("_m"))
    before = tops.select(F.col("_part").alias("_p"), F.max("_m").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    w = W.partitionBy("_part").orderBy("_place").rowsBetween(W.unboundedPreceding, -1)
    out = rows.withColumn(name, F.max(value).over(w)).join(before, F.col("_part") == F.col("_p"))
    return out.withColumn(name, F.greatest(name, "_before")).drop("_part", "_place", "_p", "_before")


def distinct_until_changed(df: DataFrame, columns: list[str], order_by: list[str], partition_by: list[str] | None = None) -> DataFrame:
    """Rows that differ from the one before in `columns`; NULLs are equal."""
    if partition_by:
        w = W.partitionBy(*partition_by).orderBy(*order_by)
        same = F.lag(F.struct(*columns)).over(w).eqNullSafe(F.struct(*columns))
        return df.withColumn("_same", same).filter(~F.col("_same")).drop("_same")
    rows = neighbour(df, columns, order_by, 1, "previous")
    return rows.filter((F.col(POSITION) == 0) | ~F.col("previous").eqNullSafe(F.struct(*columns))).select(df.columns)


def batches(df: DataFrame, size: int, order_by: list[str], partition_by: list[str] | None = None, name: str = "items") -> DataFrame:
    """Rows in order, `size` at a time: columns batch and an array of structs; a last, incomplete batch is left out."""
    if size <= 0:
        raise ValueError("size must be above 0")
    rows = positioned(df, order_by, partition_by).withColumn("batch", F.floor(F.col(POSITION) / size))
    item = F.struct(POSITION, F.struct(*df.columns).alias("item"))
    full = rows.groupBy(*(partition_by or []), "batch").agg(F.sort_array(F.collect_list(item)).alias("_items")).filter(F.size("_items") == size)
    return full.withColumn(name, F.transform("_items", lambda x: x["item"])).drop("_items")


count_window = batches


def buffer(df: DataFrame, size: int, order_by: list[str], partition_by: list[str] | None = None) -> DataFrame:
    return batches(df, size, order_by, partition_by)


def scan_sum(df: DataFrame, value: str, order_by: list[str], partition_by: list[str] | None = None, initial=0, name: str = "scan") -> DataFrame:
    """Running sums, the initial value included. Without keys: sums within partitions, and the partitions' sums before them."""
    if partition_by:
        w = W.partitionBy(*partition_by).orderBy(*order_by).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumn(name, F.sum(value).over(w) + initial)
    rows = partitioned(df, order_by)
    w = W.partitionBy("_part").orderBy("_place").rowsBetween(W.unboundedPreceding, 0)
    sums = rows.groupBy("_part").agg(F.sum(value).alias("_s"))
    before = sums.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_s").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    out = rows.withColumn(name, F.sum(value).over(w)).join(before, F.col("_part") == F.col("_p"))
    return out.withColumn(name, F.col(name) + F.col("_before") + initial).drop("_part", "_place", "_p", "_before")


def scan(df: DataFrame, f, initial, order_by: list[str], partition_by: list[str], state_type: str, name: str = "scan") -> DataFrame:
    """Running fold by any column function f(state, row struct), for each key: an array of states, the initial one first. Keys must be of bounded size; scan_sum has no such bound."""
    rows = df.groupBy(*partition_by).agg(F.sort_array(F.collect_list(F.struct(*order_by, F.struct(*df.columns).alias("_row")))).alias("_rows"))
    start = F.lit(initial).cast(state_type)
    return rows.select(*partition_by, F.aggregate("_rows", F.array(start), lambda acc, x: F.concat(acc, F.array(f(F.element_at(acc, -1), x["_row"]).cast(state_type)))).alias(name))


def zipped(inputs: list[DataFrame], order_by: list[list[str]]) -> DataFrame:
    """Rows of equal position as structs in_0, in_1, …; as many as the shortest input has."""
    out = None
    for i, (df, order) in enumerate(zip(inputs, order_by, strict=True)):
        rows = positioned(df, order).select(POSITION, F.struct(*df.columns).alias(f"in_{i}"))
        out = rows if out is None else out.join(rows, POSITION)
    return out


def synced(inputs: list[DataFrame], order_by: list[list[str]]) -> DataFrame:
    """One row of all inputs at a time, as zipped(); the wait for the slowest is the join."""
    return zipped(inputs, order_by)


def merged(inputs: list[DataFrame]) -> DataFrame:
    """All rows of all inputs."""
    out = inputs[0]
    for df in inputs[1:]:
        out = out.unionByName(df)
    return out


def interleaved(inputs: list[DataFrame], order_by: list[list[str]]) -> DataFrame:
    """Turn by turn: columns position (the turn) and input give the order; ended inputs are passed over."""
    return merged([positioned(df, order).withColumn("input", F.lit(i)) for i, (df, order) in enumerate(zip(inputs, order_by, strict=True))])


def repeated(df: DataFrame, n) -> DataFrame:
    """Every row n times (a number or a column); 0 drops it."""
    n = F.lit(n) if isinstance(n, int) else n
    return df.withColumn("_n", F.explode(F.array_repeat(F.lit(1), n.cast("int")))).drop("_n")


def until_signal(df: DataFrame, signals: DataFrame, order_column: str) -> DataFrame:
    """Rows before the first signal; all if there is none."""
    first_ = signals.agg(F.min(order_column).alias("_signal"))
    return df.join(F.broadcast(first_), F.lit(True)).filter(F.col("_signal").isNull() | (F.col(order_column) < F.col("_signal"))).drop("_signal")


def skipping_signals(df: DataFrame, signals: DataFrame, order_column: str, partition_by: list[str] | None = None) -> DataFrame:
    """Without the first row after each signal, for each key if keys are given; signals before the next row count once."""
    keys = [F.col(c) for c in partition_by or []]
    rows = df.select(*keys, F.col(order_column).alias("_o"), F.lit(1).alias("_kind"), F.struct(*df.columns).alias("_row"))
    marks = signals.select(*keys, F.col(order_column).alias("_o"), F.lit(0).alias("_kind")).withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType))
    both = rows.unionByName(marks)
    if partition_by:
        both = both.withColumn("_after", F.lag("_kind").over(W.partitionBy(*partition_by).orderBy("_o", "_kind")))
    else:
        both = neighbour(both, ["_kind"], ["_o", "_kind"], 1, "_before").withColumn("_after", F.col("_before._kind"))
    return both.filter((F.col("_kind") == 1) & (F.coalesce("_after", F.lit(1)) == 1)).select("_row.*")
