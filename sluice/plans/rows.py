"""Queries over row operators: sources, routes, joins, aggregates, order, windows, iteration, graphs, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates, control, joins, order, routing, windows
from ..sources import tables
from .catalog import query
from .functions import table
from . import sharding
from .graph import Graph


def tagged(routes: dict):
    """All routes in one table, by name."""
    return order.merged([df.withColumn("route", F.lit(k)) for k, df in routes.items()])


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


EVENTS = "WITH e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS ms FROM events) "


@query("SELECT CAST(sum(x * x) AS BIGINT) AS total FROM range(1, 11) t(x) WHERE x % 2 = 0")
def src_range_even_squares(spark, sf_dir):
    return tables.number_range(spark, 1, 11).filter("value % 2 = 0").agg(F.sum(F.col("value") * F.col("value")).alias("total"))


@query("SELECT CAST(x * 0.5 AS DOUBLE) AS value FROM range(0, 9) t(x)")
def src_range_float(spark, sf_dir):
    return tables.number_range(spark, 0.0, 4.5, 0.5)


@query("SELECT * FROM (VALUES (1, 'a'), (2, 'b')) t(id, name)")
def src_constants(spark, sf_dir):
    return tables.constants(spark, [(1, "a"), (2, "b")], "id int, name string")


@query("SELECT r_regionkey, r_name FROM region WHERE false")
def sink_drop(spark, sf_dir):
    return tables.drop(table(spark, sf_dir, "region"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity > 45")
def row_map_filter(spark, sf_dir):
    return routing.map_rows(routing.filter_rows(table(spark, sf_dir, "lineitem"), F.col("l_quantity") > 45), net=F.col("l_extendedprice") * (1 - F.col("l_discount"))).select("l_orderkey", "l_linenumber", "net")


@query("SELECT o_orderkey, CAST(substring(o_orderpriority, 1, 1) AS INT) AS level FROM orders WHERE o_orderpriority SIMILAR TO '[12].*'")
def row_filter_map(spark, sf_dir):
    return routing.filter_map(table(spark, sf_dir, "orders"), F.when(F.col("o_orderpriority").rlike("^[12]"), F.substring("o_orderpriority", 1, 1).cast("int")), "level").select("o_orderkey", "level")


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def row_for_each(spark, sf_dir):
    return routing.for_each(table(spark, sf_dir, "part"), F.split("p_name", " "), "word").select("p_partkey", "word")


@query("SELECT l_orderkey, l_linenumber, upper(l_returnflag) || l_linestatus AS code FROM lineitem")
def row_memoizing_map(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return routing.memoizing_map(d, ["l_returnflag", "l_linestatus"], lambda k: k.withColumn("code", F.concat(F.upper("l_returnflag"), "l_linestatus"))).select("l_orderkey", "l_linenumber", "code")


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'true' ELSE 'false' END AS route FROM customer")
def route_condition(spark, sf_dir):
    return tagged(routing.condition(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), F.col("c_acctbal") > 0)).select("c_custkey", "route")


@query("SELECT c_custkey, CASE WHEN c_mktsegment LIKE 'A%' THEN 'out_0' WHEN c_mktsegment LIKE '%E%' THEN 'out_1' ELSE 'default' END AS route FROM customer")
def route_match_regex(spark, sf_dir):
    return tagged(routing.match_regex(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ["^A", "E"])).select("c_custkey", "route")


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'out_0' WHEN p_size < 30 THEN 'out_1' ELSE 'default' END AS route FROM part")
def route_match_range(spark, sf_dir):
    return tagged(routing.match_range(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", [(0, 10), (10, 30)])).select("p_partkey", "route")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'out_0' WHEN 'O' THEN 'out_1' ELSE 'default' END AS route FROM orders")
def route_match_exact(spark, sf_dir):
    return tagged(routing.match_exact(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O"])).select("o_orderkey", "route")


@query("SELECT n_nationkey, CASE WHEN n_regionkey < 3 THEN 'out_' || n_regionkey ELSE 'error' END AS route FROM nation")
def route_switch(spark, sf_dir):
    return tagged(routing.switch(table(spark, sf_dir, "nation"), F.col("n_regionkey"), 3)).select("n_nationkey", "route")


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'error' ELSE 'success' END AS route FROM supplier")
def route_error_branch(spark, sf_dir):
    bad = F.col("s_acctbal") < 0
    d = table(spark, sf_dir, "supplier").select("s_suppkey", F.struct(F.when(~bad, F.col("s_acctbal")).alias("ok"), F.when(bad, F.lit("overdrawn")).alias("err")).alias("result"))
    return tagged({k: df.select("s_suppkey") for k, df in routing.error_branch(d).items()})


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) WHEN c_acctbal > -500 THEN 0 END AS root, CASE WHEN c_acctbal > -500 THEN 'out' ELSE 'error' END AS route FROM customer")
def route_try_catch(spark, sf_dir):
    x = F.col("c_acctbal")
    routes = routing.try_catch(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), F.when(x >= 0, F.sqrt(x)), F.when(x > -500, F.lit(0.0)), "root")
    return tagged({"out": routes["out"].select("c_custkey", "root"), "error": routes["error"].select("c_custkey", F.lit(None).cast("double").alias("root"))})


def joined(how):
    def f(spark, sf_dir):
        a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_name")
        b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey")
        return joins.join(a, b, ["key"], how)

    f.__name__ = f"join_{how}"
    return f


for _how, _sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("outer", "FULL JOIN")):
    query(f"SELECT key, c_name, o_orderkey FROM (SELECT c_custkey AS key, c_name FROM customer) a {_sql} (SELECT o_custkey AS key, o_orderkey FROM orders) b USING (key)")(joined(_how))


@query(EVENTS + ", x AS (SELECT user_id, ms AS t, CASE WHEN event_id % 5 = 0 THEN -1 ELSE 1 END AS d FROM e) SELECT a.user_id AS user_id, CAST(sum(a.d * b.d) AS BIGINT) AS diff FROM x a JOIN x b ON a.user_id = b.user_id GROUP BY a.user_id HAVING sum(a.d * b.d) <> 0")
def join_differential(spark, sf_dir):
    d = events(spark, sf_dir).select("user_id", F.col("ms").alias("time"), F.when(F.col("event_id") % 5 == 0, -1).otherwise(1).cast("long").alias("diff"))
    return joins.consolidated(joins.differential_join(d, d.select("user_id", "time", "diff"), ["user_id"]), ["user_id"])


@query("SELECT n_name, r_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) JOIN (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS i FROM region) USING (i)")
def join_zip(spark, sf_dir):
    return order.zipped([table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")], [["n_nationkey"], ["r_regionkey"]]).select("in_0.n_name", "in_1.r_name")


@query("SELECT n_name, r_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_name) AS i FROM nation) JOIN (SELECT r_name, row_number() OVER (ORDER BY r_name) AS i FROM region) USING (i)")
def join_sync(spark, sf_dir):
    return order.synced([table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")], [["n_name"], ["r_name"]]).select("in_0.n_name", "in_1.r_name")


@query("SELECT o_orderstatus, count(*) AS count FROM orders GROUP BY 1")
def agg_count(spark, sf_dir):
    return aggregates.count(table(spark, sf_dir, "orders"), ["o_orderstatus"])


@query("SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS sum FROM lineitem GROUP BY 1")
def agg_sum(spark, sf_dir):
    return aggregates.total(table(spark, sf_dir, "lineitem"), "l_linenumber", ["l_returnflag"])


@query("SELECT l_returnflag, round(avg(l_quantity), 6) AS average FROM lineitem GROUP BY 1")
def agg_average(spark, sf_dir):
    return aggregates.average(table(spark, sf_dir, "lineitem"), "l_quantity", ["l_returnflag"]).withColumn("average", F.round("average", 6))


@query("SELECT min(o_totalprice) AS min FROM orders")
def agg_min(spark, sf_dir):
    return aggregates.minimum(table(spark, sf_dir, "orders"), "o_totalprice")


@query("SELECT max(o_totalprice) AS max FROM orders")
def agg_max(spark, sf_dir):
    return aggregates.maximum(table(spark, sf_dir, "orders"), "o_totalprice")


@query("SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")
def agg_group_by(spark, sf_dir):
    return aggregates.group_by(table(spark, sf_dir, "nation"), ["n_regionkey"], ["n_nationkey"]).select("n_regionkey", F.transform("items", lambda x: x["n_name"]).alias("names"))


@query("SELECT c_mktsegment, count(*) FILTER (c_acctbal < 0) AS n_negative, max(c_acctbal) - min(c_acctbal) AS spread FROM customer GROUP BY 1")
def agg_user_defined(spark, sf_dir):
    return aggregates.aggregate(table(spark, sf_dir, "customer"), {"n_negative": F.count_if(F.col("c_acctbal") < 0), "spread": F.max("c_acctbal") - F.min("c_acctbal")}, ["c_mktsegment"])


@query("SELECT n_regionkey, string_agg(n_name, '' ORDER BY n_nationkey) AS result FROM nation GROUP BY 1")
def agg_reduce(spark, sf_dir):
    return aggregates.reduce(table(spark, sf_dir, "nation"), lambda a, x: F.concat(a, x), "", "n_name", ["n_nationkey"], "string", ["n_regionkey"])


@query("SELECT user_id, min(event_id) AS event_id FROM (SELECT user_id, first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS event_id FROM events) GROUP BY 1")
def agg_distinct_first(spark, sf_dir):
    return aggregates.distinct(events(spark, sf_dir), ["user_id"], ["ms", "event_id"]).select("user_id", "event_id")


@query(EVENTS + "SELECT event_id, user_id, CAST(sum(CASE WHEN event_id % 4 = 0 THEN -1 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS BIGINT) AS count FROM e")
def agg_differential(spark, sf_dir):
    d = events(spark, sf_dir).withColumn("diff", F.when(F.col("event_id") % 4 == 0, -1).otherwise(1).cast("long"))
    return aggregates.differential_group_by(d, ["user_id"], ["ms", "event_id"]).select("event_id", "user_id", "count")


@query(EVENTS + "SELECT event_id, ms AS time, CAST(1 AS BIGINT) AS diff FROM e")
def agg_to_differential(spark, sf_dir):
    return aggregates.to_differential(events(spark, sf_dir), F.col("ms")).select("event_id", "time", "diff")


@query(EVENTS + "SELECT event_id, CAST(sum(user_id) OVER (ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS scan FROM e")
def ord_scan(spark, sf_dir):
    return order.scan_sum(events(spark, sf_dir), "user_id", ["ms", "event_id"]).select("event_id", "scan")


@query(EVENTS + ", x AS (SELECT *, lag(event_type) OVER (ORDER BY ms, event_id) AS p FROM e) SELECT event_id, event_type FROM x WHERE p IS DISTINCT FROM event_type")
def ord_distinct_until_changed(spark, sf_dir):
    return order.distinct_until_changed(events(spark, sf_dir), ["event_type"], ["ms", "event_id"]).select("event_id", "event_type")


@query(EVENTS + ", x AS (SELECT event_id, (row_number() OVER (ORDER BY ms, event_id) - 1) // 7 AS batch FROM e) SELECT CAST(batch AS BIGINT) AS batch, CAST(sum(event_id) AS BIGINT) AS total, count(*) AS n FROM x GROUP BY 1 HAVING count(*) = 7")
def ord_count_window(spark, sf_dir):
    return order.count_window(events(spark, sf_dir), 7, ["ms", "event_id"]).select("batch", F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x["event_id"]).alias("total"), F.size("items").cast("long").alias("n"))


@query(EVENTS + ", x AS (SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) - 1) // 3 AS batch FROM e) SELECT user_id, CAST(batch AS BIGINT) AS batch, min(event_id) AS least FROM x GROUP BY 1, 2 HAVING count(*) = 3")
def ord_buffer(spark, sf_dir):
    return order.buffer(events(spark, sf_dir), 3, ["ms", "event_id"], ["user_id"]).select("user_id", "batch", F.array_min(F.transform("items", lambda x: x["event_id"])).alias("least"))


@query(EVENTS + "SELECT event_id FROM e ORDER BY ms, event_id LIMIT 25")
def ord_take(spark, sf_dir):
    return order.take(events(spark, sf_dir), 25, ["ms", "event_id"]).select("event_id")


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10")
def ord_limit(spark, sf_dir):
    return order.limit(table(spark, sf_dir, "orders"), 10, ["o_totalprice", "o_orderkey"]).select("o_orderkey")


@query(EVENTS + "SELECT event_id FROM e ORDER BY ms, event_id OFFSET 100")
def ord_skip(spark, sf_dir):
    return order.skip(events(spark, sf_dir), 100, ["ms", "event_id"]).select("event_id")


@query(EVENTS + "SELECT event_id FROM e ORDER BY ms, event_id LIMIT 1")
def ord_first(spark, sf_dir):
    return order.first(events(spark, sf_dir), ["ms", "event_id"]).select("event_id")


@query(EVENTS + "SELECT user_id, last(event_id ORDER BY ms, event_id) AS event_id FROM e GROUP BY 1")
def ord_last(spark, sf_dir):
    return order.last(events(spark, sf_dir), ["ms", "event_id"], ["user_id"]).select("user_id", "event_id")


@query(EVENTS + ", x AS (SELECT event_id, row_number() OVER (ORDER BY ms, event_id) AS i FROM e) SELECT event_id FROM x WHERE i % 5 = 0")
def ord_sample(spark, sf_dir):
    return order.sample(events(spark, sf_dir), 5, ["ms", "event_id"]).select("event_id")


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def ord_merge(spark, sf_dir):
    return order.merged([table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), table(spark, sf_dir, "region").select(F.col("r_name").alias("name"))])


@query("SELECT n_name AS name, row_number() OVER (ORDER BY n_name) - 1 AS position, 0 AS input FROM nation UNION ALL SELECT r_name, row_number() OVER (ORDER BY r_name) - 1, 1 FROM region")
def ord_interleave(spark, sf_dir):
    return order.interleaved([table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), table(spark, sf_dir, "region").select(F.col("r_name").alias("name"))], [["name"], ["name"]])


@query("SELECT n_nationkey FROM nation, range(0, 3) t(i) WHERE i < n_nationkey % 3")
def ctl_repeat(spark, sf_dir):
    return order.repeated(table(spark, sf_dir, "nation").select("n_nationkey"), F.col("n_nationkey") % 3)


@query(EVENTS + "SELECT event_id FROM e WHERE ms < (SELECT min(ms) FROM e WHERE value > 90)")
def ctl_break(spark, sf_dir):
    d = events(spark, sf_dir)
    return order.until_signal(d, d.filter("value > 90").select("ms"), "ms").select("event_id")


@query("WITH e AS (SELECT event_id, user_id FROM events), d AS (SELECT * FROM e WHERE event_id % 7 <> 0), s AS (SELECT * FROM e WHERE event_id % 7 = 0), u AS (SELECT event_id, user_id, 1 AS kind FROM d UNION ALL SELECT event_id, user_id, 0 FROM s), w AS (SELECT *, lag(kind) OVER (PARTITION BY user_id ORDER BY event_id, kind) AS p FROM u) SELECT event_id, user_id FROM w WHERE kind = 1 AND coalesce(p, 1) = 1")
def ctl_continue(spark, sf_dir):
    d = events(spark, sf_dir).select("event_id", "user_id")
    return order.skipping_signals(d.filter("event_id % 7 <> 0"), d.filter("event_id % 7 = 0"), "event_id", ["user_id"])


@query("WITH RECURSIVE r AS (SELECT n_nationkey * 2 AS x, 1 AS round FROM nation UNION ALL SELECT x * 2, round + 1 FROM r WHERE round < 3) SELECT CAST(x AS BIGINT) AS x, round FROM r")
def ctl_bounded_iteration(spark, sf_dir):
    seed = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("x"))
    return control.bounded_iteration(seed, lambda d: d.select((F.col("x") * 2).alias("x")), 3)


@query("WITH RECURSIVE r AS (SELECT n_nationkey AS id, n_nationkey AS k, 0 AS i FROM nation UNION ALL SELECT id, k + 3, i + 1 FROM r WHERE k < 20 AND i < 5) SELECT CAST(id AS BIGINT) AS id, CAST(max(k) AS BIGINT) AS k, CASE WHEN max(k) >= 20 AND max(i) < 5 THEN 'out' ELSE 'error' END AS route FROM r GROUP BY id")
def ctl_while_body(spark, sf_dir):
    """Up to five rounds of adding three."""
    d = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_nationkey").cast("long").alias("k"))
    routes = control.while_loop(d, F.col("k") < 20, 5, lambda rows: rows.select("id", (F.col("k") + 3).alias("k")))
    return tagged({k: routes[k] for k in ("out", "error")})


@query("SELECT CAST(c_custkey AS BIGINT) AS key, 2 AS attempt FROM customer")
def ctl_retry_passes(spark, sf_dir):
    """Every batch fails twice and passes then, within a task's process."""

    def make():
        tries = {"n": 0}

        def f(batch):
            tries["n"] += 1
            if tries["n"] % 3:
                raise ValueError(f"attempt {tries['n']}")
            return batch.assign(attempt=2)[["key", "attempt"]]

        return f

    return control.with_retries(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("key")), make(), "key bigint, attempt int", 2)


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, CASE WHEN n_nationkey >= 20 THEN 'out' ELSE 'error' END AS route FROM nation")
def ctl_while(spark, sf_dir):
    d = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    routes = control.while_loop(d, F.col("k") < 20, 10)
    return tagged({k: routes[k] for k in ("out", "error")})


@query("SELECT r_regionkey AS id, r_name AS name FROM region")
def ctl_retry(spark, sf_dir):
    d = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return control.with_retries(d, lambda b: b, "id int, name string", 2)


@query("SELECT event_type AS name, max_by(user_id, event_id) AS value FROM events GROUP BY 1")
def ctl_variables(spark, sf_dir):
    return control.Variables.table(events(spark, sf_dir).select(F.col("event_type").alias("name"), F.col("user_id").alias("value"), F.col("event_id").alias("seq")))


@query(EVENTS + "SELECT ms // 3600000 * 3600000 AS window_start, count(*) AS n, max(event_id) AS top FROM e GROUP BY 1")
def win_tumbling(spark, sf_dir):
    return windows.tumbling(events(spark, sf_dir), "ms", 3_600_000, n=F.count("*"), top=F.max("event_id"))


@query(EVENTS + ", w AS (SELECT unnest([ms // 1800000 - 1, ms // 1800000]) * 1800000 AS window_start, event_id FROM e) SELECT window_start, count(*) AS n FROM w GROUP BY 1")
def win_sliding(spark, sf_dir):
    return windows.sliding(events(spark, sf_dir), "ms", 3_600_000, 1_800_000, n=F.count("*"))


@query(EVENTS + ", g AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms) <= 300000 THEN 0 ELSE 1 END AS new FROM e), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ms) AS session_start, max(ms) AS session_end, count(*) AS n FROM s GROUP BY user_id, k")
def win_session(spark, sf_dir):
    return windows.session(events(spark, sf_dir), "ms", 300_000, ["user_id"], n=F.count("*"))


@query(EVENTS + ", w AS (SELECT *, max(ms) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wm FROM e) SELECT event_id, CASE WHEN coalesce(ms // 3600000 * 3600000 + 3600000 <= wm, false) THEN 'late' ELSE 'out' END AS route FROM w")
def win_late(spark, sf_dir):
    d = windows.with_watermark(events(spark, sf_dir), "ms", ["event_id"], ["user_id"])
    return tagged(windows.split_late(d, "ms", 3_600_000)).select("event_id", "route")


@query(EVENTS + "SELECT max(ms) AS watermark FROM e")
def win_watermark(spark, sf_dir):
    return windows.injected_watermark(events(spark, sf_dir), "ms")


@query(EVENTS + ", w AS (SELECT *, lead(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) - ms AS q FROM e) SELECT event_id FROM w WHERE q IS NULL OR q >= 600000")
def win_debounce(spark, sf_dir):
    return windows.debounced(events(spark, sf_dir), "ms", 600_000, ["user_id"], ["ms", "event_id"]).select("event_id")


@query(EVENTS.replace("WITH", "WITH RECURSIVE") + """, d AS (SELECT user_id, ms, min(event_id) AS event_id FROM e GROUP BY 1, 2),
  f AS (SELECT user_id, ms, min(ms) OVER (PARTITION BY user_id ORDER BY ms RANGE BETWEEN 3600000 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM d),
  r AS (SELECT user_id, min(ms) AS ms FROM d GROUP BY 1 UNION ALL SELECT r.user_id, f.later FROM r JOIN f ON r.user_id = f.user_id AND r.ms = f.ms WHERE f.later IS NOT NULL)
SELECT d.event_id, d.user_id, d.ms FROM r JOIN d ON r.user_id = d.user_id AND r.ms = d.ms""")
def win_throttle(spark, sf_dir):
    return windows.throttled(events(spark, sf_dir), "ms", 3_600_000, ["user_id"], ["event_id"]).select("event_id", "user_id", "ms")


@query(EVENTS + ", w AS (SELECT *, max(ms) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wm FROM e) SELECT event_id, CASE WHEN coalesce(ms // 3600000 * 3600000 + 3600000 <= wm, false) THEN 'late' ELSE 'out' END AS route FROM w")
def win_late_all(spark, sf_dir):
    """One watermark for all rows."""
    return tagged(windows.split_late(windows.with_watermark(events(spark, sf_dir), "ms", ["event_id"]), "ms", 3_600_000)).select("event_id", "route")


@query(EVENTS + ", w AS (SELECT *, lead(ms) OVER (ORDER BY ms, event_id) - ms AS q FROM e) SELECT event_id FROM w WHERE q IS NULL OR q >= 300000")
def win_debounce_all(spark, sf_dir):
    return windows.debounced(events(spark, sf_dir), "ms", 300_000, None, ["ms", "event_id"]).select("event_id")


@query(EVENTS + ", g AS (SELECT *, CASE WHEN ms - lag(ms) OVER (ORDER BY ms, event_id) > 1200000 THEN 1 ELSE 0 END AS gap FROM e), s AS (SELECT *, max(gap) OVER (ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS ended FROM g) SELECT event_id FROM s WHERE ended = 0")
def win_timeout_all(spark, sf_dir):
    return windows.within_timeout(events(spark, sf_dir), "ms", 1_200_000, None, ["ms", "event_id"]).select("event_id")


@query("SELECT event_id FROM events WHERE event_id % 7 <> 0 AND (event_id - 1) % 7 <> 0 OR event_id % 7 <> 0 AND event_id = 1 AND NOT EXISTS (SELECT 1 FROM events WHERE event_id = 0)")
def ctl_continue_all(spark, sf_dir):
    d = events(spark, sf_dir).select("event_id")
    return order.skipping_signals(d.filter("event_id % 7 <> 0"), d.filter("event_id % 7 = 0"), "event_id")


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'error' ELSE 'out' END AS route FROM part")
def ctl_retried(spark, sf_dir):
    def f(batch):
        if (batch["p_partkey"] % 5 == 0).any():
            raise ValueError("fifth")
        return batch[["p_partkey"]]

    routes = control.retried(table(spark, sf_dir, "part").select("p_partkey"), f, "p_partkey bigint", 1)
    return tagged({k: df.select("p_partkey") for k, df in routes.items()})


@query("SELECT c_custkey FROM customer")
def shard_all(spark, sf_dir):
    """Every key is owned by one shard."""
    d = table(spark, sf_dir, "customer").select("c_custkey")
    return order.merged([sharding.owned(d, ["c_custkey"], i, 4) for i in range(4)])


@query("SELECT c_custkey, 1 AS owners, true AS whole, 4 AS shards FROM customer")
def shard_once(spark, sf_dir):
    """Every key has one owner, all its rows with it, and every shard owns some."""
    d = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).unionByName(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("c_custkey")))
    rows = order.merged([sharding.owned(d, ["c_custkey"], i, 4).withColumn("shard", F.lit(i)) for i in range(4)])
    held = rows.groupBy("c_custkey").agg(F.count_distinct("shard").cast("int").alias("owners"), F.count("*").alias("n"))
    all_ = d.groupBy(F.col("c_custkey").alias("k")).agg(F.count("*").alias("m"))
    shards = rows.agg(F.count_distinct("shard").cast("int").alias("shards"))
    return held.join(all_, F.col("c_custkey") == F.col("k")).select("c_custkey", "owners", (F.col("n") == F.col("m")).alias("whole")).join(F.broadcast(shards), F.lit(True))


@query(EVENTS + ", g AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) > 86400000 THEN 1 ELSE 0 END AS gap FROM e), s AS (SELECT *, max(gap) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS ended FROM g) SELECT event_id FROM s WHERE ended = 0")
def win_timeout(spark, sf_dir):
    return windows.within_timeout(events(spark, sf_dir), "ms", 86_400_000, ["user_id"], ["ms", "event_id"]).select("event_id")


@query(EVENTS + ", w AS (SELECT *, max(ms) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wm FROM e) SELECT event_id, CASE WHEN coalesce(ms < wm, false) THEN 'late' ELSE 'out' END AS route FROM w")
def win_late_session(spark, sf_dir):
    d = windows.with_watermark(events(spark, sf_dir), "ms", ["event_id"], ["user_id"])
    return tagged(windows.split_late_session(d, "ms")).select("event_id", "route")


@query("WITH s AS (SELECT n_regionkey, n_nationkey, sum(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS t FROM nation) SELECT n_regionkey, list_prepend(CAST(0 AS BIGINT), list(CAST(t AS BIGINT) ORDER BY n_nationkey)) AS scan FROM s GROUP BY 1")
def ord_scan_fold(spark, sf_dir):
    """A running fold by any function, for each key."""
    return order.scan(table(spark, sf_dir, "nation"), lambda a, row: a + row["n_nationkey"], 0, ["n_nationkey"], ["n_regionkey"], "bigint")


@query("SELECT r.event_id, w.value, CASE WHEN w.name IS NULL THEN 'error' ELSE 'out' END AS route FROM events r LEFT JOIN (SELECT event_type AS name, max_by(user_id, event_id) AS value FROM events WHERE event_type < 'm' GROUP BY 1) w ON r.event_type = w.name")
def ctl_lookup(spark, sf_dir):
    d = events(spark, sf_dir).select("event_id", F.col("event_type").alias("name"), "user_id")
    writes = d.filter("name < 'm'").select("name", F.col("user_id").alias("value"), F.col("event_id").alias("seq"))
    routes = control.Variables.lookup(d.select("event_id", "name"), writes)
    return tagged({"out": routes["out"].select("event_id", "value"), "error": routes["error"].select("event_id", F.lit(None).cast("long").alias("value"))})


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def state_versioned(spark, sf_dir):
    return windows.versioned(events(spark, sf_dir), ["user_id"], "event_id").select("user_id", "event_id")


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY 1")
def graph_run(spark, sf_dir):
    g = Graph("q").add("big", lambda rows: rows.filter("l_quantity > 25")).add("counts", lambda rows: rows.groupBy("l_returnflag").agg(F.count("*").alias("n")))
    g.connect("big", "counts").expose_input("lines", "big", "rows").expose_output("result", "counts")
    return g.run(lines=table(spark, sf_dir, "lineitem"))["result"]


@query("SELECT CAST(x AS BIGINT) AS x FROM (WITH RECURSIVE r AS (SELECT n_nationkey AS x FROM nation UNION ALL SELECT x + 10 FROM r WHERE x < 30) SELECT x FROM r)")
def graph_rounds(spark, sf_dir):
    g = Graph("q").add("all", lambda new, old: order.merged([new, old])).add("step", lambda rows: rows.filter("x < 30").select((F.col("x") + 10).alias("x")))
    g.connect("all", "step").connect("step", "all", target_port="old").expose_input("seed", "all", "new").expose_output("out", "all")
    return g.run_rounds(10, seed=table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("x")))["out"]
