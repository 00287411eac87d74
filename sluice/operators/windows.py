"""Event-time windows over tables: end of input closes all of them. `streaming.windows` has the live forms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import order


def _ms(time: str) -> Column:
    return F.col(time).cast("long")


def tumbling(df: DataFrame, time: str, size: int, keys: list[str] | None = None, **aggregates: Column) -> DataFrame:
    """Windows [k * size, (k + 1) * size) of milliseconds; rows without a time are in window 0."""
    start = (F.floor(F.coalesce(_ms(time), F.lit(0)) / size) * size).cast("long")
    return df.withColumn("window_start", start).groupBy(*(keys or []), "window_start").agg(*[v.alias(k) for k, v in aggregates.items()])


def sliding(df: DataFrame, time: str, size: int, slide: int, keys: list[str] | None = None, **aggregates: Column) -> DataFrame:
    """All windows [k * slide, k * slide + size), k >= 0, that hold the row's time."""
    t = F.coalesce(_ms(time), F.lit(0))
    last, first = F.floor(t / slide), F.greatest(F.floor((t - size) / slide) + 1, F.lit(0))
    starts = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    rows = df.withColumn("_k", F.explode(starts)).withColumn("window_start", (F.col("_k") * slide).cast("long")).drop("_k")
    return rows.groupBy(*(keys or []), "window_start").agg(*[v.alias(k) for k, v in aggregates.items()])


def session(df: DataFrame, time: str, gap: int, keys: list[str] | None = None, **aggregates: Column) -> DataFrame:
    """Runs of rows no more than `gap` apart, merged by Spark's session windows; a gap of just that length stays within."""
    window = F.session_window(F.timestamp_millis(_ms(time)), f"{gap} milliseconds")
    out = df.filter(F.col(time).isNotNull()).groupBy(*(keys or []), window.alias("w")).agg(*[v.alias(k) for k, v in aggregates.items()])
    return out.withColumn("session_start", F.unix_millis("w.start")).withColumn("session_end", F.unix_millis("w.end") - gap).drop("w")


def with_watermark(df: DataFrame, time: str, order_by: list[str], partition_by: list[str] | None = None, name: str = "watermark") -> DataFrame:
    """The largest event time before each row in arrival order, for each key if keys are given."""
    return order.running_max(df, time, order_by, partition_by, name)


def injected_watermark(df: DataFrame, time: str) -> DataFrame:
    """What an injected watermark says at the end of input: the largest event time, 0 for none."""
    return df.agg(F.coalesce(F.max(_ms(time)), F.lit(0)).alias("watermark"))


def split_late(df: DataFrame, time: str, size: int, watermark: str = "watermark") -> dict[str, DataFrame]:
    """out, and late: rows whose tumbling window had ended by the watermark."""
    end = F.floor(_ms(time) / size) * size + size
    late = F.coalesce(end <= F.col(watermark), F.lit(False))
    return {"out": df.filter(~late), "late": df.filter(late)}


def split_late_session(df: DataFrame, time: str, watermark: str = "watermark") -> dict[str, DataFrame]:
    """Sessions are stricter: late is before the watermark."""
    late = F.coalesce(_ms(time) < F.col(watermark), F.lit(False))
    return {"out": df.filter(~late), "late": df.filter(late)}


def debounced(df: DataFrame, time: str, delay: int, keys: list[str] | None, order_by: list[str]) -> DataFrame:
    """Rows that no other (of their key, if keys are given) follows within `delay`."""
    if not keys:
        rows = order.neighbour(df, [time], order_by, -1, "_following")
        quiet = F.col(f"_following.{time}").cast("long") - _ms(time)
        return rows.filter(quiet.isNull() | (quiet >= delay)).select(df.columns)
    w = W.partitionBy(*keys).orderBy(*order_by)
    quiet = F.lead(_ms(time)).over(w) - _ms(time)
    return df.withColumn("_quiet", quiet).filter(F.col("_quiet").isNull() | (F.col("_quiet") >= delay)).drop("_quiet")


def kept_times(times: np.ndarray, new: np.ndarray, period: int, last: int | None) -> np.ndarray:
    """Which of the ascending times of each key (new: its first) are kept, all keys a step at a time; last: the time kept last of a key that goes on from before."""
    n, run = len(times), np.cumsum(new)
    low = int(times.min())
    place = run * (int(times.max()) - low + period + 1) + times - low  # ascending over all keys
    following = np.searchsorted(place, place + period)
    at, keep = np.flatnonzero(new), np.zeros(n, bool)
    if not new[0]:  # goes on from before
        first = int(np.searchsorted(times[: at[0] if len(at) else n], last + period))
        at = np.append(at, first)[: len(at) + (first < (at[0] if len(at) else n))]
    while len(at):
        keep[at] = True
        on = following[at]
        at = on[(on < n) & (run[np.minimum(on, n - 1)] == run[at])]
    return keep


def throttled(df: DataFrame, time: str, period: int, keys: list[str], ties: list[str] | None = None) -> DataFrame:
    """The first row of each key, then the first at least `period` after the last one kept; `ties` orders rows of one time. Rows without a time stand at 0.

    What is kept depends on what was kept before, so each key is a fold over its times in order; rows are streamed
    through sorted partitions, and no key is gathered.
    """
    w = W.partitionBy(*keys).orderBy("_t", *(ties or []))
    rows = df.withColumn("_t", F.coalesce(_ms(time), F.lit(0))).withColumn("_new", F.row_number().over(w) == 1)

    def fold(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            times, new = batch["_t"].to_numpy(), batch["_new"].to_numpy(zero_copy_only=False)
            keep = kept_times(times, new, period, last)
            starts = np.flatnonzero(new)
            of_last = np.flatnonzero(keep[starts[-1] if len(starts) else 0 :])
            if len(of_last):
                last = int(times[(starts[-1] if len(starts) else 0) + of_last[-1]])
            yield batch.filter(pa.array(keep))

    return rows.mapInArrow(fold, rows.schema).drop("_t", "_new")


def within_timeout(df: DataFrame, time: str, timeout: int, keys: list[str] | None, order_by: list[str]) -> DataFrame:
    """Rows (of each key, if keys are given) before the first gap longer than `timeout`."""
    if not keys:
        rows = order.neighbour(df, [time], order_by, 1, "_before")
        end = rows.filter(_ms(time) - F.col(f"_before.{time}").cast("long") > timeout).agg(F.min(order.POSITION).alias("_end"))
        return rows.join(F.broadcast(end), F.lit(True)).filter(F.col("_end").isNull() | (F.col(order.POSITION) < F.col("_end"))).select(df.columns)
    w = W.partitionBy(*keys).orderBy(*order_by)
    gap = F.coalesce((_ms(time) - F.lag(_ms(time)).over(w) > timeout).cast("int"), F.lit(0))
    rows = df.withColumn("_gap", gap)
    return rows.withColumn("_ended", F.max("_gap").over(w.rowsBetween(W.unboundedPreceding, 0))).filter("_ended = 0").drop("_gap", "_ended")


def versioned(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Keyed state: of each key the row with the newest version; of equal ones the first written should be given by a lower `_seq`, if there is one."""
    newest = F.struct(F.col(version), *([-F.col("_seq")] if "_seq" in df.columns else []))
    return df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max_by(F.struct(*df.columns), newest).alias("_row")).select("_row.*")
