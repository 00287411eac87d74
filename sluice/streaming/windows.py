"""Live forms of event-time operators. Times are TIMESTAMP columns; late rows are those whose window the watermark has closed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def as_timestamp(df: DataFrame, time: str) -> DataFrame:
    """TIMESTAMP_NTZ columns can't carry a watermark; the session's time zone should be UTC."""
    return df.withColumn(time, F.col(time).cast("timestamp"))


def tumbling(df: DataFrame, time: str, size: str, lateness: str, keys: list[str] | None = None, **aggregates: Column) -> DataFrame:
    return df.withWatermark(time, lateness).groupBy(*(keys or []), F.window(time, size)).agg(*[v.alias(k) for k, v in aggregates.items()])


def sliding(df: DataFrame, time: str, size: str, slide: str, lateness: str, keys: list[str] | None = None, **aggregates: Column) -> DataFrame:
    return df.withWatermark(time, lateness).groupBy(*(keys or []), F.window(time, size, slide)).agg(*[v.alias(k) for k, v in aggregates.items()])


def session(df: DataFrame, time: str, gap: str, lateness: str, keys: list[str], **aggregates: Column) -> DataFrame:
    """Spark merges live sessions only for a key."""
    return df.withWatermark(time, lateness).groupBy(*keys, F.session_window(time, gap)).agg(*[v.alias(k) for k, v in aggregates.items()])


def distinct(df: DataFrame, time: str, lateness: str, columns: list[str]) -> DataFrame:
    """State is kept for `lateness`."""
    return df.withWatermark(time, lateness).dropDuplicatesWithinWatermark(columns)


def join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, within: str, lateness: str, how: str = "inner") -> DataFrame:
    """Rows of equal keys no more than `within` apart; the bound lets state go."""
    a, b = left.withWatermark(left_time, lateness).alias("l"), right.withWatermark(right_time, lateness).alias("r")
    on = F.expr(f"l.{left_time} BETWEEN r.{right_time} - INTERVAL {within} AND r.{right_time} + INTERVAL {within}")
    for k in keys:
        on &= F.col(f"l.{k}") == F.col(f"r.{k}")
    return a.join(b, on, how)


class _Keyed(StatefulProcessor):
    """State of one value for each key."""

    schema = "v bigint"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", self.schema)

    def get(self):
        return tuple(self.state.get()) if self.state.exists() else None

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802,N803
        """Takes up exported state: the values' columns by name."""
        names = [x.split()[0] for x in self.schema.split(", ")]
        self.state.update(tuple(initialState[names].iloc[0].tolist()))

    def close(self) -> None:
        pass


class Versioned(_Keyed):
    """Keeps the value of the newest version of each key; equal and older versions change nothing. Gives the state after each row."""

    schema = "value bigint, version bigint"

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        out, now = [], self.get()
        for batch in rows:
            for value, version in zip(batch["value"].tolist(), batch["version"].tolist(), strict=True):
                if now is None or version > now[1]:
                    now = (int(value), int(version))
                out.append((key[0], *now))
        if now is not None:
            self.state.update(now)
        yield pd.DataFrame(out, columns=["key", "value", "version"])


class Counted(_Keyed):
    """Changes (diff) to counts: the key's count after each row."""

    schema = "count bigint"

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802,N803
        count, out = (self.get() or (0,))[0], []
        for batch in rows:
            for time, diff in zip(batch["time"].tolist(), batch["diff"].tolist(), strict=True):
                count += int(diff)
                out.append((key[0], count, int(time), int(diff)))
        self.state.update((count,))
        yield pd.DataFrame(out, columns=["key", "count", "time", "diff"])


class Throttled(_Keyed):
    """A row of each key, then the first at least `period` ms of event time after the last one given."""

    def __init__(self, period: int):
        self.period = period

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802,N803
        last, out = self.get(), []
        for batch in rows:
            for time, value in sorted(zip(batch["time"].tolist(), batch["value"].tolist(), strict=True)):
                if last is None or time - last[0] >= self.period:
                    last = (int(time),)
                    out.append((key[0], int(time), int(value)))
        if last is not None:
            self.state.update(last)
        yield pd.DataFrame(out, columns=["key", "time", "value"])


class Debounced(_Keyed):
    """A row after `delay` ms of processing time without another of its key; each new row sets the timer anew."""

    schema = "time bigint, value bigint, timer bigint"

    def __init__(self, delay: int):
        self.delay = delay

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802,N803
        best, now = None, self.get()
        for batch in rows:
            best = max([x for x in (best,) if x] + list(zip(batch["time"].tolist(), batch["value"].tolist(), strict=True)))
        if now is not None:
            self.handle.deleteTimer(now[2])
        at = timerValues.getCurrentProcessingTimeInMs() + self.delay
        self.handle.registerTimer(at)
        self.state.update((int(best[0]), int(best[1]), at))
        yield pd.DataFrame([], columns=["key", "time", "value"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802,N803
        time, value, _ = self.get()
        self.state.clear()
        yield pd.DataFrame([(key[0], time, value)], columns=["key", "time", "value"])


class TimedOut(_Keyed):
    """Rows of each key until `timeout` ms of processing time pass without one: then a row with `error` set, and nothing after it."""

    schema = "timer bigint, ended boolean"

    def __init__(self, timeout: int):
        self.timeout = timeout

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802,N803
        now, out = self.get(), []
        for batch in rows:
            out += zip(batch["time"].tolist(), batch["value"].tolist(), strict=True)
        if now is not None and now[1]:
            out = []
        else:
            if now is not None:
                self.handle.deleteTimer(now[0])
            at = timerValues.getCurrentProcessingTimeInMs() + self.timeout
            self.handle.registerTimer(at)
            self.state.update((at, False))
        yield pd.DataFrame([(key[0], int(t), int(v), None) for t, v in out], columns=["key", "time", "value", "error"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802,N803
        at, _ = self.get()
        self.state.update((at, True))
        yield pd.DataFrame([(key[0], at, None, f"no row in {self.timeout} ms")], columns=["key", "time", "value", "error"]).astype({"value": "Int64"})


class Delayed(_Keyed):
    """Every row after `delay` ms of processing time, with how long it has waited; rows of one batch wait together."""

    def __init__(self, delay: int):
        self.delay = delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.rows = handle, handle.getListState("rows", "time bigint, value bigint, arrived bigint")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802,N803
        now = timerValues.getCurrentProcessingTimeInMs()
        for batch in rows:
            self.rows.appendList([(int(t), int(v), now) for t, v in zip(batch["time"].tolist(), batch["value"].tolist(), strict=True)])
        self.handle.registerTimer(now + self.delay)
        yield pd.DataFrame([], columns=["key", "time", "value", "waited"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802,N803
        now = timerValues.getCurrentProcessingTimeInMs()
        held = [tuple(x) for x in self.rows.get()] if self.rows.exists() else []
        later = [x for x in held if now - x[2] < self.delay]
        self.rows.put(later) if later else self.rows.clear()
        yield pd.DataFrame([(key[0], t, v, now - at) for t, v, at in held if now - at >= self.delay], columns=["key", "time", "value", "waited"])


class LateSplit(_Keyed):
    """Rows with `late`: whether their tumbling window had ended by the largest time of their key before them."""

    def __init__(self, size: int):
        self.size = size

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802,N803
        top, out = (self.get() or (-(2**62),))[0], []
        for batch in rows:
            for time, value in zip(batch["time"].tolist(), batch["value"].tolist(), strict=True):
                out.append((key[0], int(time), int(value), time // self.size * self.size + self.size <= top))
                top = max(top, int(time))
        self.state.update((top,))
        yield pd.DataFrame(out, columns=["key", "time", "value", "late"])


def stateful(df: DataFrame, key: str, processor: StatefulProcessor, schema: str, mode: str = "None", initial: DataFrame | None = None) -> DataFrame:
    """A processor for each key; needs the RocksDB provider (ROCKS) in the session, and mode "ProcessingTime" for timers. initial: state to begin with, as exported_state() gives it."""
    return df.groupBy(key).transformWithStateInPandas(processor, schema, "Append", mode, None if initial is None else initial.groupBy(key))


def exported_state(spark: SparkSession, checkpoint: str, name: str = "state", operator: int = 0, batch: int | None = None) -> DataFrame:
    """A snapshot of a stream's keyed state as a table of keys and values, of the last batch or a given one; write it to keep it."""
    read = spark.read.format("statestore").option("operatorId", operator).option("stateVarName", name)
    rows = (read if batch is None else read.option("batchId", batch)).load(checkpoint)
    return rows.select("key.*", "value.*")


def processing_time_batches(df: DataFrame, interval: str, f: Callable[[DataFrame, int], None], checkpoint: str):
    """Wall-clock windows: f gets each interval's rows, empty ones not."""
    return df.writeStream.trigger(processingTime=interval).option("checkpointLocation", checkpoint).foreachBatch(lambda batch, i: None if batch.isEmpty() else f(batch, i)).start()
