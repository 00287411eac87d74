"""Literal cases of functions and operators, plans, flowcharts and streams."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sluice.functions import collections as c
from sluice.functions import scalars as n
from sluice.functions import strings as s
from sluice.functions import time as t
from sluice.functions import types as ty
from sluice.operators import control, joins, order, routing, windows, working
from sluice.plans import mermaid, sharding
from sluice.plans.graph import Graph, GraphError, plan_recompute
from sluice.sources import tables
from sluice.streaming import metrics, progress
from sluice.streaming import windows as live


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).collect()[0])


def test_scalars(spark):
    big = F.lit(2**63 - 1)
    assert one(spark, n.add(big, 1), n.divide(-7, 2, integer=True), n.divide(1, 0, integer=True), n.divide(F.lit(-(2**63)), -1, integer=True), n.modulo(-7, 2)) == (None, -3, None, None, -1)
    assert one(spark, n.power(3, 39, integer=True), n.power(10, 30, integer=True), n.power(2, -1, integer=True), n.power(-1, 1001, integer=True), n.power(0, 0, integer=True)) == (3**39, None, None, -1, 1)
    assert one(spark, n.sqrt(F.lit(-1.0)), n.log(F.lit(8.0), F.lit(1.0)), n.rounded(F.lit(-2.5)), n.ceil(F.lit(1e30)), n.larger(F.lit(float("nan")), F.lit(1.0), floats=True)) == (None, None, -3, 2**63 - 1, 1.0)
    assert one(spark, n.absolute(F.lit(-(2**63))), n.absolute(F.lit(-5))) == (None, 5)


def test_comparisons(spark):
    x = F.lit
    assert one(spark, n.greater_than(x("b"), x("a")), n.less_than(x("a"), x(1)), n.greater_than(x(2), x(1.5)), n.equal(x("x"), x(1)), n.not_equal(x("x"), x(1)), n.equal(x("a"), x("a")), n.equal(x(1), x(1.0))) == (False, False, True, False, True, True, True)
    plan = spark.range(3).filter(n.greater_than("id", 1))._jdf.queryExecution().optimizedPlan().toString()
    assert "typeof" not in plan and "CASE" not in plan


def test_strings(spark):
    x = lambda v: F.lit(v)
    assert one(spark, s.length(x("héllo")), s.index_of(x("héllo"), "l"), s.last_index_of(x("héllo"), "l"), s.index_of(x("abc"), "z")) == (6, 3, 4, -1)
    assert one(spark, s.pad(x("ab"), 5, "*", "center"), s.pad(x("abcdef"), 3, "*"), s.case(x("  hello   WORLD "), "title"), s.trim(x("\t a \n")), s.capitalize(x("hELLO"))) == ("*ab**", "abcdef", "Hello World", "a", "HELLO")
    assert one(spark, s.replace(x("ab"), "", "-"), s.split(x("ab"), ""), s.split(x("a,b,"), ","), s.slice(x("abc"), F.lit(2), F.lit(5)), s.char_at(x("abc"), F.lit(-1)), s.format("{}-{}", x(3))) == ("-a-b-", ["", "a", "b", ""], ["a", "b", ""], None, None, "3-3")


def test_collections(spark):
    a = F.array(F.lit(3), F.lit(1), F.lit(2))
    assert one(spark, c.array_split(a, 2), c.array_slice(a, F.lit(1), F.lit(9)), c.array_slice(a, F.lit(2), F.lit(1)), c.array_index(a, F.lit(9)), c.array_index_of(a, F.lit(7)), c.array_sort(a, True)) == ([[3, 1], [2]], [1, 2], None, None, -1, [3, 2, 1])
    m = F.create_map(F.lit("a"), F.lit(1))
    assert one(spark, c.object_merge(m, F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(3))), c.object_delete_property(m, "a"), c.object_property(m, "z")) == ({"a": 2, "b": 3}, {}, None)


def test_types_and_time(spark):
    assert one(spark, ty.to_int(F.lit("12 "), "string"), ty.to_int(F.lit("-12"), "string"), ty.to_int(F.lit(1e30), "double"), ty.to_boolean(F.lit("false"), "string"), ty.to_string(F.lit(1.0), "double"), ty.to_string(F.array(F.lit("a"), F.lit("b")), "array")) == (None, -12, 2**63 - 1, True, "1", '["a", "b"]')
    assert one(spark, ty.is_int(F.parse_json(F.lit("5")), variant=True), ty.is_object(F.parse_json(F.lit("{}")), variant=True), ty.is_null(F.parse_json(F.lit("null")), variant=True)) == (True, True, True)
    assert one(spark, t.format_time(F.lit(1500)), t.parse_time(F.lit("1970-01-02")), t.parse_time(F.lit("nonsense")), t.parse_time(F.lit("02/01/1970"), "%d/%m/%Y")) == ("1970-01-01T00:00:01.500Z", 86_400_000, None, 86_400_000)


def test_order(spark):
    d = spark.createDataFrame([(i, v) for i, v in enumerate("xx\0yyx")], "i int, v string").withColumn("v", F.when(F.col("v") != "\0", F.col("v")))
    assert [r.i for r in order.distinct_until_changed(d, ["v"], ["i"]).orderBy("i").collect()] == [0, 2, 3, 5]
    assert sorted(r.position for r in order.positioned(d, ["i"]).collect()) == list(range(6))
    assert [r.i for r in order.sample(d, 2, ["i"]).orderBy("i").collect()] == [1, 3, 5]
    assert order.batches(d, 4, ["i"]).count() == 1
    states = order.scan(d.withColumn("k", F.lit(1)), lambda a, x: a + x["i"], 0, ["i"], ["k"], "bigint").collect()[0].scan
    assert states == [0, 0, 1, 3, 6, 10, 15]
    assert [r.i for r in order.skip(d, 4, ["i"]).orderBy("i").collect()] == [4, 5]


def test_routes_and_joins(spark):
    d = spark.createDataFrame([(1, 5), (2, None), (3, -1)], "id int, v int")
    routes = routing.condition(d, F.col("v") > 0)
    assert {k: df.count() for k, df in routes.items()} == {"true": 1, "false": 1, "error": 1}
    assert {k: df.count() for k, df in routing.switch(d, F.col("v"), 3).items()} == {"out_0": 0, "out_1": 0, "out_2": 0, "default": 1, "error": 2}
    with pytest.raises(ValueError):
        joins.join(d, d, ["id"])
    change = lambda rows, v: spark.createDataFrame(rows, f"id int, {v} int, time long, diff long")
    out = joins.differential_join(change([(1, 10, 1, 1), (2, 7, 1, 1)], "name"), change([(1, 100, 3, -1)], "value"), ["id"]).collect()
    assert [(r.id, r.name, r.value, r.time, r.diff) for r in out] == [(1, 10, 100, 3, -1)]


def test_windows(spark):
    d = spark.createDataFrame([(100, 1), (500, 2), (1100, 3)], "time long, value int")
    assert sorted(tuple(r) for r in windows.tumbling(d, "time", 1000, n=F.count("*")).collect()) == [(0, 2), (1000, 1)]
    assert windows.sliding(spark.createDataFrame([(500, 1)], "time long, value int"), "time", 1000, 400, n=F.count("*")).count() == 2
    assert windows.session(spark.createDataFrame([(100,), (200,), (800,), (1300,)], "time long"), "time", 500, n=F.count("*")).count() == 2
    arrived = spark.createDataFrame([(1, 100, None), (2, 50, 1000), (3, 1100, 1000)], "i int, time long, watermark long")
    assert [r.i for r in windows.split_late(arrived, "time", 1000)["late"].collect()] == [2]
    kept = windows.throttled(spark.createDataFrame([("a", x) for x in (0, 5, 10, 12, 25)], "k string, time long"), "time", 10, ["k"])
    assert sorted(r.time for r in kept.collect()) == [0, 10, 25]


def test_throttle_matches_a_loop(spark):
    rows = [(i % 3, (i * 37) % 101) for i in range(200)]
    got = sorted(tuple(r) for r in windows.throttled(spark.createDataFrame(rows, "k int, time long").distinct(), "time", 7, ["k"]).collect())
    want = []
    for k in range(3):
        last = None
        for x in sorted({b for a, b in rows if a == k}):
            if last is None or x - last >= 7:
                last = x
                want.append((k, x))
    assert got == sorted(want)


def test_control(spark):
    seed = spark.createDataFrame([(1,)], "x int")
    out = control.bounded_iteration(seed, lambda d: d.select((F.col("x") * 2).alias("x")), 9, lambda a, b: b.filter("x > 7").count() > 0)
    assert sorted(r.x for r in out.collect()) == [2, 4, 8]
    routes = control.while_loop(seed, F.col("x") < 5, 10, lambda d: d.select((F.col("x") + 2).alias("x")))
    assert [r.x for r in routes["out"].collect()] == [5] and not routes["error"].count()
    tries = []
    with pytest.raises(ZeroDivisionError):
        control.retry(lambda: tries.append(1) or 1 / 0, 2)
    assert len(tries) == 3
    v = control.Variables()
    with pytest.raises(KeyError):
        v.read("a")
    assert v.write("a", 1) == v.read("a") == 1


def test_retried_sends_bad_rows_to_error(spark):
    def f(batch):
        return batch.assign(y=[10 // v for v in batch["v"]])[["i", "y"]]

    d = spark.createDataFrame([(1, 5), (2, 0), (3, 2)], "i int, v int")
    routes = control.retried(d, f, "i int, y int", 1)
    assert sorted(tuple(r) for r in routes["out"].collect()) == [(1, 2), (3, 5)]
    assert [(r.i, r.v, bool(r.error)) for r in routes["error"].collect()] == [(2, 0, True)]
    assert not control.retried(d.limit(0), f, "i int, y int", 1)["out"].count()


def test_retried_keeps_values_of_many_rows(spark):
    def f(batch):
        if (batch["i"] % 3 == 0).any():
            raise ValueError(f"third {batch['i'].iloc[0]}")
        return batch.assign(y=[None if v % 2 else v for v in batch["v"]])[["i", "y"]]

    rows = [(i, 2**60 + i) for i in range(100)]
    routes = control.retried(spark.createDataFrame(rows, "i long, v long").coalesce(1), f, "i long, y long", 0)
    assert sorted((r.i, r.y) for r in routes["out"].collect()) == [(i, None if v % 2 else v) for i, v in rows if i % 3]
    assert sorted(tuple(r) for r in routes["error"].collect()) == [(i, v, f"third {i}") for i, v in rows if not i % 3]


def test_shards(spark):
    d = spark.createDataFrame([(k,) for k in (None, *range(50))], "k int")
    parts = [{r.k for r in sharding.owned(d, ["k"], i, 3).collect()} for i in range(3)]
    assert sum(map(len, parts)) == 51 and None in parts[0]
    moves = {r.k: (r.from_shard, r.to_shard) for r in sharding.migration(d, ["k"], 3, 4).collect()}
    assert all(k in parts[a] and a != b and b < 4 for k, (a, b) in moves.items()) and len(moves) < 51


def test_timer(spark):
    with pytest.raises(ValueError):
        tables.timer(spark, 0)
    q = tables.timer(spark, 200).writeStream.format("memory").queryName("t_ticks").start()
    try:
        for _ in range(60):
            q.processAllAvailable()
            if spark.table("t_ticks").count() > 3:
                break
    finally:
        q.stop()
    ticks = sorted(r.tick for r in spark.table("t_ticks").collect())
    assert len(ticks) > 3 and {b - a for a, b in zip(ticks, ticks[1:])} == {200}


def test_sources(spark):
    assert [r.value for r in tables.number_range(spark, 5, 0, -2).collect()] == [5, 3, 1]
    with pytest.raises(ValueError):
        tables.number_range(spark, 1, 5, 0)
    with pytest.raises(TypeError):
        tables.number_range(spark, 1, 5.0, 1)


def diamond():
    g = Graph("d").add("a", lambda rows: rows).add("b", lambda rows: rows.limit(1)).add("c", lambda left, right: left.unionByName(right))
    return g.connect("a", "b").connect("a", "c", target_port="left").connect("b", "c", target_port="right").expose_input("x", "a", "rows").expose_output("y", "c")


def test_graph(spark):
    g = diamond()
    assert g.run(x=spark.range(3))["y"].count() == 4
    assert not g.has_cycles() and g.order() == ["a", "b", "c"]
    for bad in (lambda: g.connect("a", "c", target_port="left"), lambda: g.connect("a", "z"), lambda: g.connect("a", "b", "nope"), lambda: g.add("a", len), lambda: g.run(z=spark.range(1))):
        with pytest.raises(GraphError):
            bad()
    assert plan_recompute(g, "b", (0, 5), {"c": 9}) == ["b"] and plan_recompute(g, "b", (0, 5), {"c": 5}) == ["b", "c"]
    outer = Graph("o").add("inner", diamond().as_node(), ["x"], ["y"]).expose_input("x", "inner", "x").expose_output("y", "inner", "y")
    assert outer.run(x=spark.range(2))["y"].count() == 3


def test_flowcharts(spark):
    text = mermaid.export(diamond())
    bp = mermaid.parse(text)
    assert (bp.edges, bp.inputs, bp.outputs) == (diamond().edges, diamond().exposed_inputs, diamond().exposed_outputs)
    for ports in (("a->b", "c\\d"), ("out", "in")):
        assert mermaid.parse_label(mermaid.label(*ports)) == ports
    boxes = 'flowchart TD\n output["result"]\n subgraph a["Src"]\n  a_core["a"]\n  a_out_out["out"]\n  a_core --> a_out_out\n end\n subgraph b["Twice"]\n  b_in_rows["rows"]\n  b_core["b"]\n  b_out_out["out"]\n end\n a_out_out --> b_in_rows\n b_out_out --> output\n'
    bp = mermaid.parse(boxes)
    assert [(e.source, e.source_port, e.target, e.target_port) for e in bp.edges] == [("a", "out", "b", "rows")] and bp.outputs == {"result": ("b", "out")}
    g = mermaid.build(bp, {"Src": lambda: spark.range(2), "Twice": lambda rows: rows.unionByName(rows)})
    assert g.run()["result"].count() == 4
    with pytest.raises(mermaid.UnknownOperator):
        mermaid.build(bp, {}).run()


def streamed(spark, tmp_path, rows, schema, make, mode="append"):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = tables.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    q = make(source).writeStream.outputMode(mode).format("memory").queryName("t_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table("t_out").toPandas()


def test_live_versions(spark, tmp_path):
    rows = [("k", 100, 1), ("k", 999, 1), ("k", 200, 2)]
    out = streamed(spark, tmp_path, rows, "key string, value long, version long", lambda d: live.stateful(d, "key", live.Versioned(), "key string, value bigint, version bigint"))
    assert sorted(zip(out.value, out.version, strict=True)) == [(100, 1), (100, 1), (200, 2)]


def test_live_counts(spark, tmp_path):
    rows = [("a", 1, 1), ("a", 2, 1), ("b", 3, 1), ("a", 4, -1)]
    out = streamed(spark, tmp_path, rows, "key string, time long, diff long", lambda d: live.stateful(d, "key", live.Counted(), "key string, count bigint, time bigint, diff bigint"))
    assert sorted(zip(out.time, out["count"], strict=True)) == [(1, 1), (2, 2), (3, 1), (4, 1)]


def test_live_throttle_and_late(spark, tmp_path):
    rows = [("k", x, x) for x in (0, 5, 10, 12, 25)]
    out = streamed(spark, tmp_path, rows, "key string, time long, value long", lambda d: live.stateful(d, "key", live.Throttled(10), "key string, time bigint, value bigint"))
    assert sorted(out.time) == [0, 10, 25]


def test_live_late_rows(spark, tmp_path):
    rows = [("k", x, x) for x in (5, 25, 7, 21, 9)]
    out = streamed(spark, tmp_path, rows, "key string, time long, value long", lambda d: live.stateful(d, "key", live.LateSplit(10), "key string, time bigint, value bigint, late boolean"))
    assert {t for t, late in zip(out.time, out.late, strict=True) if late} == {7, 9}


def test_live_timeout(spark, tmp_path):
    def put(i, rows):
        spark.createDataFrame(rows, "key string, time long, value long").coalesce(1).write.parquet(str(tmp_path / f"in/n={i}"))

    put(0, [("a", 1, 10), ("b", 2, 20)])
    source = spark.readStream.schema("key string, time long, value long, n int").parquet(str(tmp_path / "in")).drop("n")
    made = live.stateful(source, "key", live.TimedOut(500), "key string, time bigint, value bigint, error string", "ProcessingTime")
    q = made.writeStream.format("memory").queryName("t_timeout").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    try:
        seen = lambda: spark.table("t_timeout").collect()
        for _ in range(200):
            if sum(r.error is not None for r in seen()) == 2:
                break
            time.sleep(0.2)
        put(1, [("a", 3, 30), ("c", 4, 40)])
        for _ in range(200):
            if any(r.key == "c" for r in seen()):
                break
            time.sleep(0.2)
    finally:
        q.stop()
    rows = seen()
    assert sorted((r.key, r.value) for r in rows if r.error is None) == [("a", 10), ("b", 20), ("c", 40)]
    assert {"a", "b"} <= {r.key for r in rows if r.error is not None}


def test_metrics(spark, tmp_path):
    rows = [(pd.Timestamp(x, unit="ms").to_pydatetime(), 1) for x in (100, 500, 1100)]
    with metrics.Metrics.of(spark) as m:
        streamed(spark, tmp_path, rows, "ts timestamp, v int", lambda d: d.filter("v > 0"))
        for _ in range(50):
            if m.values.get("t_out", {}).get("rows_in"):
                break
            time.sleep(0.1)
    assert m.values["t_out"]["rows_in"] == 3 and 'stream_rows_in_total{query="t_out"} 3' in m.text()
    df, seen = metrics.observed(spark.range(10), "t_seen", n=F.count("*"), top=F.max("id"))
    assert df.filter("id > 5").count() == 4 and seen.get == {"n": 10, "top": 9}
    assert metrics.health(spark)["alive"] and metrics.health(spark)["executors"] == 1


def test_live_window(spark, tmp_path):
    rows = [(pd.Timestamp(x, unit="ms").to_pydatetime(), 1) for x in (100, 500, 1100)]
    out = streamed(spark, tmp_path, rows, "ts timestamp, v int", lambda d: live.tumbling(d, "ts", "1 second", "0 seconds", n=F.count("*")), "complete")
    assert sorted(out.n) == [1, 2]


def test_progress():
    f = progress.CompletedFrontier()
    assert (f.advance(5), f.advance(3)) == (5, 5)
    assert progress.scale(3, 20_000, 0) == 4 and progress.scale(3, 10, 0) == 2 and progress.scale(1, 10, 0) == 1

    class Failing:
        def awaitTermination(self):  # noqa: N802
            raise RuntimeError("x")

    started = []
    with pytest.raises(progress.EscalatedError):
        progress.supervise(lambda: started.append(1) or Failing(), "restart", 2)
    assert len(started) == 3 and progress.supervise(Failing, "stop") == 0


def test_throttle_over_batches_and_nulls(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab") if i % 4 else None, None if i % 50 == 0 else rng.randrange(40_000), i) for i in range(25_000)]
    got = {r.i for r in windows.throttled(spark.createDataFrame(rows, "k string, time long, i int"), "time", 37, ["k"], ["i"]).collect()}
    want, last = set(), {}
    for k, t, i in sorted(rows, key=lambda r: (r[1] or 0, r[2])):
        if k not in last or (t or 0) - last[k] >= 37:
            want.add(i)
            last[k] = t or 0
    assert got == want


def test_input_time_does_not_go_back(spark):
    d = tables.TimestampedInput(spark, "x int")
    d.send(spark.createDataFrame([(1,)], "x int"))
    d.advance_to(5)
    with pytest.raises(ValueError):
        d.advance_to(4)
    d.send(spark.createDataFrame([(2,)], "x int"))
    assert sorted(map(tuple, d.close().collect())) == [(1, 0), (2, 5)]
    with pytest.raises(ValueError):
        d.send(spark.createDataFrame([(3,)], "x int"))


def test_scaler_waits(spark):
    s = progress.Scaler(2, stable_s=10, cooldown_s=30)
    assert [s.tick(t, rate, 0) for t, rate in ((0, 20_000), (5, 20_000), (10, 20_000), (20, 20_000), (35, 20_000), (41, 20_000), (45, 5_000), (80, 10), (85, 5_000), (90, 10), (100, 10))] == [2, 2, 3, 3, 3, 4, 4, 4, 4, 4, 3]


def test_group_restarts_together_and_lifecycle(spark, tmp_path):
    tries = {"n": 0}

    def start(name, fails):
        def batch(df, i):
            if fails and tries["n"] < 1:
                tries["n"] += 1
                raise ValueError("once")
            df.write.mode("append").parquet(str(tmp_path / name / "rows"))

        return lambda: tables.read_stream(spark, str(tmp_path / "in"), "x long").writeStream.option("checkpointLocation", str(tmp_path / name / "state")).trigger(availableNow=True).foreachBatch(batch).start()

    spark.range(10).withColumnRenamed("id", "x").write.parquet(str(tmp_path / "in"))
    assert progress.supervise_group([start("a", False), start("b", True)]) == 1
    assert spark.read.parquet(str(tmp_path / "b" / "rows")).count() == 10
    out = str(tmp_path / "live")
    run = progress.Lifecycle([lambda: tables.read_stream(spark, str(tmp_path / "in"), "x long").writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").start()])
    run.start()
    run.queries[0].processAllAvailable()
    run.pause()
    spark.range(5).withColumnRenamed("id", "x").write.mode("append").parquet(str(tmp_path / "in"))
    assert run.state == "paused" and spark.read.parquet(f"{out}/rows").count() == 10
    run.resume()
    run.queries[0].processAllAvailable()
    run.stop()
    assert spark.read.parquet(f"{out}/rows").count() == 15
    with pytest.raises(ValueError):
        run.start()


def test_working_folder():
    class Fake:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        working.shared_dir(Fake)
    Fake.sparkContext.master = "local[4]"
    assert working.shared_dir(Fake) == "/tmp/checkpoints"


def test_state_is_exported_and_taken_up(spark, tmp_path):
    def run(rows, name, initial=None):
        spark.createDataFrame(rows, "key string, value long, version long").coalesce(1).write.parquet(str(tmp_path / name / "in"))
        d = tables.read_stream(spark, str(tmp_path / name / "in"), "key string, value long, version long")
        out = live.stateful(d, "key", live.Versioned(), "key string, value bigint, version bigint", initial=initial)
        out.writeStream.format("parquet").option("path", str(tmp_path / name / "out")).option("checkpointLocation", str(tmp_path / name / "state")).trigger(availableNow=True).start().awaitTermination()
        return {r.key: r.value for r in live.exported_state(spark, str(tmp_path / name / "state")).collect()}

    assert run([("a", 1, 5), ("b", 2, 7)], "first") == {"a": 1, "b": 2}
    live.exported_state(spark, str(tmp_path / "first" / "state")).write.parquet(str(tmp_path / "kept"))
    assert run([("a", 9, 4), ("b", 8, 9), ("c", 3, 1)], "second", spark.read.parquet(str(tmp_path / "kept"))) == {"a": 1, "b": 8, "c": 3}


def test_failed_shard_is_absorbed(spark):
    d = spark.range(500).unionByName(spark.range(3).select(F.lit(None).cast("long").alias("id")))
    lost = {r.id for r in sharding.owned(d, ["id"], 1, 4).collect()}
    got = {r.id: (r.to_shard, r.was_shard) for r in sharding.absorbed(d, ["id"], 1, 4).collect()}
    assert set(got) == lost and {x for x, _ in got.values()} == {0, 1, 2} and set(got.values()) == {(0, 0), (1, 2), (2, 3)}
    for i in range(3):
        assert {k for k, (to, _) in got.items() if to == i} == lost & {r.id for r in sharding.owned(d, ["id"], i, 3).collect()}
    assert sharding.absorbed(d, ["id"], 0, 1).count() == 0
