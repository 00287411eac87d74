"""Registered queries by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS revenue, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL")
def slice_returned_revenue(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_returnflag = 'R'")
    amount = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.sum(amount.cast("decimal(18,4)")).cast("double").alias("revenue"), F.count("*").alias("n"))


from . import functions, rows, streams  # noqa: E402,F401  they register themselves
