"""Sources and sinks: ranges, inline rows, files, clocks; files of all formats that Spark has."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "json", "csv", "text", "avro", "jdbc", "binaryFile")


def number_range(spark: SparkSession, start, end, step=1) -> DataFrame:
    """start, start + step, … before end, which is left out; downwards for a negative step. All three ints or all floats."""
    if step == 0:
        raise ValueError("step must not be 0")
    kinds = {type(x) for x in (start, end, step)}
    if len(kinds) > 1 or bool in kinds:
        raise TypeError("start, end and step must be of one type")
    if isinstance(start, int):
        return spark.range(start, end, step).withColumnRenamed("id", "value")
    n = max(0, math.ceil((end - start) / step))
    return spark.range(n).select((F.lit(start) + F.col("id") * F.lit(step)).alias("value"))


def timer(spark: SparkSession, interval_ms: int) -> DataFrame:
    """A stream of wall-clock ticks, milliseconds in `tick`, one each interval from the stream's start on."""
    if interval_ms <= 0:
        raise ValueError("interval must be above 0")
    per_second = max(1, math.ceil(1000 / interval_ms))
    passed = lambda i: F.floor(i * 1000 / per_second / interval_ms)
    rows = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return rows.filter(passed(F.col("value")) > passed(F.col("value") - 1)).select(F.unix_millis("timestamp").alias("tick"))


class TimestampedInput:
    """Rows for a dataflow, each with the time that the input has reached; the time never goes back."""

    def __init__(self, spark: SparkSession, schema: str):
        self.spark, self.schema, self.time, self._sent, self._open = spark, schema, 0, [], True

    def send(self, df: DataFrame) -> None:
        if not self._open:
            raise ValueError("the input is closed")
        self._sent.append(df.withColumn("time", F.lit(self.time).cast("long")))

    def advance_to(self, time: int) -> None:
        if time < self.time:
            raise ValueError(f"time can't go back from {self.time} to {time}")
        self.time = time

    def close(self) -> DataFrame:
        """All that was sent, with `time`."""
        self._open, out = False, self.spark.createDataFrame([], f"{self.schema}, time bigint")
        for df in self._sent:
            out = out.unionByName(df)
        return out


def constants(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def read(spark: SparkSession, path: str, format: str = "parquet", schema: str | None = None, **options) -> DataFrame:  # noqa: A002
    reader = spark.read.format(format).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def read_stream(spark: SparkSession, path: str, schema, format: str = "parquet", **options) -> DataFrame:  # noqa: A002
    return spark.readStream.format(format).options(**options).schema(schema).load(path)


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "error", partition_by: list[str] | None = None, **options) -> None:  # noqa: A002
    writer = df.write.format(format).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def drop(df: DataFrame) -> DataFrame:
    """Nothing of df."""
    return df.limit(0)


def discard(df: DataFrame) -> None:
    """Runs df and keeps nothing."""
    df.write.format("noop").mode("overwrite").save()
