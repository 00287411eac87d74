"""Queries over streams: `events` is replayed as a stream to its end, what comes out is written and read again."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.working import fresh
from ..sources import tables
from ..streaming import windows as live
from .catalog import query
from .functions import table
from .rows import EVENTS


def source(spark, sf_dir: str) -> DataFrame:
    """A stream takes a folder or a pattern, not one file, so the table is named by a pattern."""
    schema = table(spark, sf_dir, "events").schema
    rows = live.as_timestamp(tables.read_stream(spark, f"{sf_dir}/events.parque[t]", schema), "ts")
    return rows.select("event_id", "user_id", "ts", F.unix_millis("ts").alias("ms"))


def appended(out: DataFrame) -> DataFrame:
    """All rows of a stream whose rows are final."""
    path = fresh(out.sparkSession)
    out.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"{path}/rows")


def updated(out: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row of each key of a stream of updates. A batch that is tried again replaces its own rows."""
    path = fresh(out.sparkSession)

    def keep(batch: DataFrame, i: int) -> None:
        batch.withColumn("_batch", F.lit(i)).write.mode("overwrite").parquet(f"{path}/rows/{i}")

    out.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    rows = out.sparkSession.read.option("recursiveFileLookup", "true").schema(T.StructType([*out.schema, T.StructField("_batch", T.IntegerType())])).parquet(f"{path}/rows")
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max_by(F.struct(*out.columns), "_batch").alias("_row")).select("_row.*")


def stateful(rows: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """appended() with the state store that processors need; the session's own setting comes back."""
    conf = rows.sparkSession.conf
    before = {k: conf.get(k, None) for k in live.ROCKS}
    try:
        for k, v in live.ROCKS.items():
            conf.set(k, v)
        return appended(make(rows))
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


@query(EVENTS + "SELECT ms // 3600000 * 3600000 AS window_start, count(*) AS n, max(event_id) AS top FROM e GROUP BY 1")
def stream_tumbling(spark, sf_dir):
    out = live.tumbling(source(spark, sf_dir), "ts", "1 hour", "1 day", n=F.count("*"), top=F.max("event_id"))
    return updated(out.select(F.unix_millis("window.start").alias("window_start"), "n", "top"), ["window_start"])


@query(EVENTS + ", w AS (SELECT user_id, unnest([ms // 43200000 - 1, ms // 43200000]) * 43200000 AS window_start FROM e) SELECT user_id, window_start, count(*) AS n FROM w GROUP BY 1, 2")
def stream_sliding(spark, sf_dir):
    out = live.sliding(source(spark, sf_dir), "ts", "1 day", "12 hours", "1 day", ["user_id"], n=F.count("*"))
    return updated(out.select("user_id", F.unix_millis("window.start").alias("window_start"), "n"), ["user_id", "window_start"])


@query("SELECT DISTINCT user_id FROM events")
def stream_distinct(spark, sf_dir):
    """All rows arrive within the time that keys are kept."""
    return appended(live.distinct(source(spark, sf_dir), "ts", "36500 days", ["user_id"]).select("user_id"))


@query(EVENTS + "SELECT a.user_id AS user_id, a.event_id AS event_id, b.event_id AS other_id FROM e a JOIN e b ON a.user_id = b.user_id AND abs(a.ms - b.ms) <= 86400000 WHERE a.event_id <> b.event_id")
def stream_join(spark, sf_dir):
    a, b = source(spark, sf_dir).drop("ms"), source(spark, sf_dir).select("user_id", F.col("event_id").alias("other_id"), F.col("ts").alias("other_ts"))
    return appended(live.join(a, b, ["user_id"], "ts", "other_ts", "1 day", "1 day").filter("event_id <> other_id").select("l.user_id", "event_id", "other_id"))


@query(EVENTS.replace("WITH", "WITH RECURSIVE") + """, d AS (SELECT user_id, ms, min(event_id) AS event_id FROM e GROUP BY 1, 2),
  f AS (SELECT user_id, ms, min(ms) OVER (PARTITION BY user_id ORDER BY ms RANGE BETWEEN 3600000 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM d),
  r AS (SELECT user_id, min(ms) AS ms FROM d GROUP BY 1 UNION ALL SELECT r.user_id, f.later FROM r JOIN f ON r.user_id = f.user_id AND r.ms = f.ms WHERE f.later IS NOT NULL)
SELECT d.event_id AS value, d.user_id AS key, d.ms AS time FROM r JOIN d ON r.user_id = d.user_id AND r.ms = d.ms""")
def stream_throttle(spark, sf_dir):
    rows = source(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("ms").alias("time"), F.col("event_id").alias("value"))
    return stateful(rows, lambda d: live.stateful(d, "key", live.Throttled(3_600_000), "key bigint, time bigint, value bigint"))


@query(EVENTS + ", g AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms) <= 300000 THEN 0 ELSE 1 END AS new FROM e), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ms) AS session_start, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ms) + 300000 <= (SELECT max(ms) FROM e)")
def stream_session(spark, sf_dir):
    """Sessions that the watermark has closed."""
    out = live.session(source(spark, sf_dir), "ts", "5 minutes", "0 seconds", ["user_id"], n=F.count("*"))
    return appended(out.select("user_id", F.unix_millis("session_window.start").alias("session_start"), "n"))


def keyed(spark, sf_dir: str) -> DataFrame:
    return source(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("ms").alias("time"), F.col("event_id").alias("value"))


def timed(spark, rows: DataFrame, processor, schema: str, done: Callable[[DataFrame], bool], most_s: float = 120.0) -> DataFrame:
    """What a processor with wall-clock timers gives until done(rows so far)."""
    conf, path = spark.conf, fresh(spark)
    before = {k: conf.get(k, None) for k in live.ROCKS}
    try:
        for k, v in live.ROCKS.items():
            conf.set(k, v)
        out = live.stateful(rows, "key", processor, schema, "ProcessingTime")
        running = out.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").start()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    began = time.monotonic()
    try:
        while time.monotonic() - began < most_s:
            if running.exception() is not None:
                raise running.exception()
            if running.recentProgress and done(spark.read.schema(out.schema).parquet(f"{path}/rows")):
                break
            time.sleep(0.5)
    finally:
        running.stop()
    return spark.read.schema(out.schema).parquet(f"{path}/rows")


@query(EVENTS + "SELECT user_id AS key, max(ms) AS time, max_by(event_id, (ms, event_id)) AS value FROM e GROUP BY 1")
def stream_debounce(spark, sf_dir):
    """Of each key the last row, as all arrive at once."""
    keys = table(spark, sf_dir, "events").select("user_id").distinct().count()
    return timed(spark, keyed(spark, sf_dir), live.Debounced(500), "key bigint, time bigint, value bigint", lambda d: d.count() >= keys)


@query(EVENTS + "SELECT user_id AS key, ms AS time, event_id AS value, NULL AS error FROM e UNION ALL SELECT DISTINCT user_id, NULL, NULL, 'no row in 500 ms' FROM e")
def stream_timeout(spark, sf_dir):
    """All rows, and an error for each key once the time has passed; when it did is the run's own."""
    d = table(spark, sf_dir, "events")
    n = d.count() + d.select("user_id").distinct().count()
    out = timed(spark, keyed(spark, sf_dir), live.TimedOut(500), "key bigint, time bigint, value bigint, error string", lambda rows: rows.count() >= n)
    return out.withColumn("time", F.when(F.col("error").isNull(), F.col("time")))


@query(EVENTS + "SELECT user_id AS key, ms AS time, event_id AS value, true AS held FROM e")
def stream_delay(spark, sf_dir):
    """All rows, each held back by half a second at least."""
    n = table(spark, sf_dir, "events").count()
    out = timed(spark, keyed(spark, sf_dir), live.Delayed(500), "key bigint, time bigint, value bigint, waited bigint", lambda rows: rows.count() >= n)
    return out.select("key", "time", "value", (F.col("waited") >= 500).alias("held"))


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def stream_processing_windows(spark, sf_dir):
    """Rows of all wall-clock windows together; which window a row falls in is the run's own."""
    path = fresh(spark)
    running = live.processing_time_batches(source(spark, sf_dir), "200 milliseconds", lambda batch, i: batch.select("event_id").write.mode("overwrite").parquet(f"{path}/rows/{i}"), f"{path}/state")
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/rows").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@query("SELECT true AS spaced, true AS on_time")
def src_timer(spark, sf_dir):
    """Three ticks of a timer: an interval or more apart, and none before the start."""
    path, began = fresh(spark), time.time() * 1000
    running = tables.timer(spark, 200).writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").start()
    ticks: list[int] = []
    try:
        while len(ticks) < 3 and time.time() * 1000 < began + 60_000:
            time.sleep(0.3)
            if running.recentProgress:
                ticks = sorted(r.tick for r in spark.read.schema("tick long").parquet(f"{path}/rows").limit(100).collect())
    finally:
        running.stop()
    spaced = len(ticks) >= 3 and all(b - a >= 195 for a, b in zip(ticks, ticks[1:], strict=False))
    return spark.createDataFrame([(spaced, bool(ticks) and ticks[0] >= began - 1000)], "spaced boolean, on_time boolean")
