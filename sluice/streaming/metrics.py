"""Counters of running streams, in the text form that scrapers read, observed aggregates of any table, and the session's health."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

COUNTERS = ("rows_in", "rows_out", "batches", "failures")
GAUGES = ("rows_per_second", "state_rows", "late_rows", "batch_ms")


class Metrics(StreamingQueryListener):
    """By query name (or id): rows in and out, batches and failures so far; of the last batch, its rate, state rows, late rows and duration.

    with Metrics.of(spark) as m: … m.text()
    """

    def __init__(self):
        self.values: dict[str, dict[str, float]] = {}
        self._names: dict[str, str] = {}
        self._lock = threading.Lock()

    @classmethod
    def of(cls, spark: SparkSession) -> Metrics:
        found = cls()
        found._spark = spark
        return found

    def __enter__(self) -> Metrics:
        self._spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self._spark.streams.removeListener(self)

    def _of(self, id_: str) -> dict[str, float]:
        return self.values.setdefault(self._names.get(id_, id_), dict.fromkeys(COUNTERS + GAUGES, 0))

    def onQueryStarted(self, event) -> None:  # noqa: N802
        with self._lock:
            self._names[str(event.id)] = event.name or str(event.id)
            self._of(str(event.id))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        with self._lock:
            v = self._of(str(p.id))
            v["rows_in"] += p.numInputRows
            v["rows_out"] += max(0, p.sink.numOutputRows)  # -1 where a sink doesn't know
            v["batches"] += 1
            v["rows_per_second"] = p.processedRowsPerSecond
            v["state_rows"] = sum(x.numRowsTotal for x in p.stateOperators)
            v["late_rows"] = sum(x.numRowsDroppedByWatermark for x in p.stateOperators)
            v["batch_ms"] = p.batchDuration

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.exception:
            with self._lock:
                self._of(str(event.id))["failures"] += 1

    def text(self, prefix: str = "stream") -> str:
        """One line for each value, its query as a label."""
        with self._lock:
            out = []
            for kind, names, end in (("counter", COUNTERS, "_total"), ("gauge", GAUGES, "")):
                for name in names:
                    out.append(f"# TYPE {prefix}_{name}{end} {kind}")
                    for query, v in sorted(self.values.items()):
                        label = query.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
                        out.append(f'{prefix}_{name}{end}{{query="{label}"}} {v[name]:g}')
            return "\n".join(out) + "\n"


def observed(df: DataFrame, name: str, **aggregates: Column) -> tuple[DataFrame, Observation]:
    """df, and its aggregates once it has run (`observation.get`), from the same pass."""
    seen = Observation(name)
    return df.observe(seen, *[v.alias(k) for k, v in aggregates.items()]), seen


def health(spark: SparkSession) -> dict[str, int | bool]:
    """Whether the session can run jobs, its executors (the driver in local mode), cores, running jobs and streams."""
    sc = spark.sparkContext
    alive = not sc._jsc.sc().isStopped()
    nodes = sc._jsc.sc().getExecutorMemoryStatus().size() if alive else 0
    return {
        "alive": alive, "executors": nodes if sc.master.split("[")[0] == "local" else max(0, nodes - 1), "cores": sc.defaultParallelism if alive else 0,
        "running_jobs": len(sc.statusTracker().getActiveJobsIds()) if alive else 0, "streams": len(spark.streams.active) if alive else 0,
    }
