"""Working tables in the folder that driver and executors share; they go when the process ends."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, Working] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, a folder of this machine will do for a local master alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or "/tmp/checkpoints").rstrip("/")


class Working:
    """Tables under a folder of their own. A lost executor costs a reread, not a recomputation.

    Tables that a returned DataFrame reads must outlive the call, so the folder goes when the process ends; drop()
    removes a table that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._remove, self.root)

    def save(self, df: DataFrame, table: str, **options: str) -> DataFrame:
        path = f"{self.root}/{table}"
        df.write.options(**({"compression": "zstd"} | options)).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, table: str) -> None:
        self._remove(f"{self.root}/{table}")

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session may be gone by then
            return


def working(spark: SparkSession) -> Working:
    """The one of this session's own working tables."""
    key = f"{spark.sparkContext.applicationId} {shared_dir(spark)}"
    if key not in _ROOTS:
        _ROOTS[key] = Working(spark, "working")
    return _ROOTS[key]


def fresh(spark: SparkSession) -> str:
    """A new folder among them."""
    return f"{working(spark).root}/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df written and reread: lineage ends, and lost executors don't cost its computation again."""
    return working(df.sparkSession).save(df, uuid.uuid4().hex)
