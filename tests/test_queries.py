"""Every registered query of the package against its SQL in DuckDB."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as registered
from sluice.plans import catalog

SF = "/root/testdata/sf0.001"


def value(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return [value(x) for x in v]
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
        return None
    return round(float(v), 6) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)


def rows(df):
    return sorted(repr([value(x) for x in row]) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.execute(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_whole_joins(spark, tmp_path, how):
    customers, orders = [(1, "a"), (2, "b"), (5, "c"), (None, "d")], [(10, 1), (11, 1), (12, 5), (13, 7), (14, None)]
    spark.createDataFrame(customers, "c_custkey long, c_name string").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = catalog.QUERIES[f"join_{how}"](spark, str(tmp_path)).collect()
    want = [(1, "a", 10), (1, "a", 11), (5, "c", 12)]
    want += [(2, "b", None), (None, "d", None)] if how in ("left", "outer") else []
    want += [(7, None, 13), (None, None, 14)] if how in ("right", "outer") else []
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_whole_stream_join_has_pairs_of_all_events(spark):
    got = {(r.event_id % 2, r.other_id % 2) for r in catalog.QUERIES["stream_join"](spark, SF).collect()}
    assert got == {(0, 0), (0, 1), (1, 0), (1, 1)}


def test_entry(spark):
    assert registered.entry(spark).count() > 0
    assert set(registered.oracle_sql()) <= set(registered.queries())
