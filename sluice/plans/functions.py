"""Queries over scalar, string, collection, type and time functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import collections as c
from ..functions import scalars as n
from ..functions import strings as s
from ..functions import time as t
from ..functions import types as ty
from .catalog import query


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""SELECT l_orderkey, l_linenumber, l_suppkey + l_linenumber AS added, l_suppkey - l_partkey AS subtracted, l_suppkey * l_linenumber AS multiplied,
  CASE WHEN l_linenumber <> 3 THEN (l_partkey // (l_linenumber - 3)) END AS divided, l_extendedprice / l_quantity AS quotient,
  CASE WHEN l_linenumber <> 3 THEN l_partkey % (l_linenumber - 3) END AS modulo, CAST(pow(l_linenumber, 5) AS BIGINT) AS powered FROM lineitem""")
def fn_arithmetic(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem")
    line = F.col("l_linenumber").cast("long")
    return d.select(
        "l_orderkey", "l_linenumber", n.add("l_suppkey", "l_linenumber").alias("added"), n.subtract("l_suppkey", "l_partkey").alias("subtracted"), n.multiply("l_suppkey", "l_linenumber").alias("multiplied"),
        n.divide("l_partkey", line - 3, integer=True).alias("divided"), n.divide("l_extendedprice", "l_quantity").alias("quotient"), n.modulo("l_partkey", line - 3).alias("modulo"), n.power("l_linenumber", F.lit(5), integer=True).alias("powered"),
    )


@query("""SELECT l_orderkey, l_linenumber, l_tax = l_discount AS eq_exact, abs(l_tax - l_discount) < 2.220446049250313e-16 AS eq, abs(l_tax - l_discount) >= 2.220446049250313e-16 AS ne,
  l_tax > l_discount AS gt, l_tax >= l_discount AS ge, l_tax < l_discount AS lt, l_tax <= l_discount AS le FROM lineitem""")
def fn_comparison(spark, sf_dir):
    a, b = "l_tax", "l_discount"
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", n.equal(a, b).alias("eq_exact"), n.equal(a, b, "double").alias("eq"), n.not_equal(a, b, "double").alias("ne"),
        n.greater_than(a, b).alias("gt"), n.greater_than_or_equal(a, b).alias("ge"), n.less_than(a, b).alias("lt"), n.less_than_or_equal(a, b).alias("le"),
    )


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_tax <> 0 AS a, l_returnflag <> 'R' AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, a AND b AS both_, a OR b AS either_, NOT a AS negated, a <> b AS exclusive, NOT (a AND b) AS not_both, NOT (a OR b) AS neither FROM x""")
def fn_boolean(spark, sf_dir):
    a, b = n.truth("l_tax", "double"), F.col("l_returnflag") != "R"
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", n.both(a, b).alias("both_"), n.either(a, b).alias("either_"), n.negated(a).alias("negated"), n.exclusive(a, b).alias("exclusive"), n.not_both(a, b).alias("not_both"), n.neither(a, b).alias("neither"))


@query("""SELECT c_custkey, abs(c_acctbal) AS absolute, CAST(ceil(c_acctbal) AS BIGINT) AS ceiled, CAST(floor(c_acctbal) AS BIGINT) AS floored, CAST(round(c_acctbal) AS BIGINT) AS rounded, round(exp(c_nationkey / 10.0), 6) AS exped,
  CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal) / ln(10), 6) END AS logged, CASE WHEN c_acctbal >= 0 THEN round(sqrt(c_acctbal), 6) END AS rooted, greatest(c_acctbal, 100.0) AS larger, least(c_acctbal, 100.0) AS smaller FROM customer""")
def fn_math(spark, sf_dir):
    x = "c_acctbal"
    return table(spark, sf_dir, "customer").select(
        "c_custkey", n.absolute(x).alias("absolute"), n.ceil(x).alias("ceiled"), n.floor(x).alias("floored"), n.rounded(x).alias("rounded"), F.round(n.exp(F.col("c_nationkey") / 10.0), 6).alias("exped"),
        F.round(n.log(x, F.lit(10)), 6).alias("logged"), F.round(n.sqrt(x), 6).alias("rooted"), n.larger(x, F.lit(100.0), floats=True).alias("larger"), n.smaller(x, F.lit(100.0), floats=True).alias("smaller"),
    )


@query("""SELECT p_partkey, p_name || '!' AS appended, '>' || p_name AS prepended, p_name || p_brand AS joined, upper(p_name) AS uppered, lower(p_brand) AS lowered,
  upper(substring(p_name, 1, 1)) || substring(p_name, 2) AS capitalized, reverse(p_name) AS reversed, replace(p_name, 'a', '4') AS replaced, substring(p_name, 2, 3) AS sliced, substring(p_name, 1, 1) AS first_char,
  string_split(p_name, ' ') AS parts, trim(p_name) AS trimmed, replace('<{}|{}>', '{}', p_name) AS formatted, rpad(p_brand, 12, '*') AS right_padded, lpad(p_brand, 12, '*') AS left_padded,
  list_aggregate(list_transform(list_filter(string_split(p_name, ' '), lambda x: x <> ''), lambda x: upper(substring(x, 1, 1)) || lower(substring(x, 2))), 'string_agg', ' ') AS titled FROM part""")
def fn_string_build(spark, sf_dir):
    x = "p_name"
    return table(spark, sf_dir, "part").select(
        "p_partkey", s.append(x, "!").alias("appended"), s.prepend(x, ">").alias("prepended"), s.concat(x, "p_brand").alias("joined"), s.uppercase(x).alias("uppered"), s.lowercase("p_brand").alias("lowered"),
        s.capitalize(x).alias("capitalized"), s.reverse(x).alias("reversed"), s.replace(x, "a", "4").alias("replaced"), s.slice(x, F.lit(1), F.lit(4)).alias("sliced"), s.char_at(x, F.lit(0)).alias("first_char"),
        s.split(x, " ").alias("parts"), s.trim(x).alias("trimmed"), s.format("<{}|{}>", x).alias("formatted"), s.pad("p_brand", 12, "*").alias("right_padded"), s.pad("p_brand", 12, "*", "left").alias("left_padded"), s.case(x, "TitleCase").alias("titled"),
    )


@query("""SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes_, contains(text, 'the') AS has, starts_with(text, 'The') AS starts, ends_with(text, '.') AS ends_, text = upper(text) AS same,
  regexp_matches(text, '[0-9]{3}') AS matched, CASE WHEN strpos(text, 'en') = 0 THEN -1 ELSE CAST(strlen(substring(text, 1, strpos(text, 'en') - 1)) AS BIGINT) END AS first_at,
  CASE WHEN strpos(reverse(text), 'ne') = 0 THEN -1 ELSE CAST(strlen(substring(text, 1, length(text) - strpos(reverse(text), 'ne') - 1)) AS BIGINT) END AS last_at FROM documents""")
def fn_string_search(spark, sf_dir):
    x = "text"
    return table(spark, sf_dir, "documents").select(
        "doc_id", s.length(x).alias("bytes_"), s.contains(x, "the").alias("has"), s.starts_with(x, "The").alias("starts"), s.ends_with(x, ".").alias("ends_"), s.equal(x, s.uppercase(x)).alias("same"),
        s.match(x, "[0-9]{3}").alias("matched"), s.index_of(x, "en").alias("first_at"), s.last_index_of(x, "en").alias("last_at"),
    )


@query("""WITH x AS (SELECT p_partkey, list_transform(string_split(p_name, ' '), lambda v: v) AS a, CAST(length(p_name) AS INT) AS k FROM part)
SELECT p_partkey, a || ['z'] AS added, list_contains(a, 'part') AS has, list_filter(a, lambda v: length(v) > 4) AS filtered, list_transform(a, lambda v: upper(v)) AS mapped, flatten([a, a]) AS flat, a[1] AS first_,
  CAST(coalesce(list_position(a, 'part'), 0) - 1 AS INT) AS at, array_to_string(a, '-') AS joined, CAST(len(a) AS BIGINT) AS size_, list_reverse(a) AS reversed, a[1:2] AS sliced, list_sort(a) AS sorted_, list_reverse(list_sort(a)) AS sorted_down FROM x""")
def fn_array(spark, sf_dir):
    d = table(spark, sf_dir, "part").select("p_partkey", s.split("p_name", " ").alias("a"))
    return d.select(
        "p_partkey", c.array_concat("a", F.array(F.lit("z"))).alias("added"), c.array_contains("a", F.lit("part")).alias("has"), c.array_filter("a", lambda v: F.length(v) > 4).alias("filtered"), c.array_map("a", lambda v: F.upper(v)).alias("mapped"),
        c.array_flatten(F.array("a", "a")).alias("flat"), c.array_index("a", F.lit(0)).alias("first_"), c.array_index_of("a", F.lit("part")).alias("at"), c.array_join("a", "-").alias("joined"), c.array_length("a").alias("size_"),
        c.array_reverse("a").alias("reversed"), c.array_slice("a", F.lit(0), F.lit(2)).alias("sliced"), c.array_sort("a").alias("sorted_"), c.array_sort("a", True).alias("sorted_down"),
    )


@query("""SELECT n_nationkey, CAST(n_nationkey // 2 AS INT) AS half, CAST((n_nationkey % 3) AS INT) AS third, CAST(len(list_distinct([n_nationkey % 2, n_nationkey % 3, n_nationkey % 2])) AS BIGINT) AS uniques,
  CAST(ceil((n_nationkey % 5 + 1) / 2.0) AS BIGINT) AS chunks FROM nation""")
def fn_array_parts(spark, sf_dir):
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", n.divide(k, F.lit(2), integer=True).cast("int").alias("half"), n.modulo(k, F.lit(3)).cast("int").alias("third"),
        c.array_length(c.array_unique(F.array(k % 2, k % 3, k % 2))).alias("uniques"), c.array_length(c.array_split(F.sequence(F.lit(0), k % 5), 2)).alias("chunks"),
    )


@query("""WITH x AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, ['k'] AS keys_, [k] AS vals, 1 AS entries_, k AS prop, NULL::BIGINT AS no_prop, true AS has, CAST(1 AS BIGINT) AS size_, CAST(0 AS BIGINT) AS deleted, k * 2 AS merged, CAST(2 AS BIGINT) AS set_size FROM x""")
def fn_object(spark, sf_dir):
    m = F.from_json("props", "map<string,bigint>").alias("m")
    d = table(spark, sf_dir, "events").select("event_id", m)
    return d.select(
        "event_id", c.object_keys("m").alias("keys_"), c.object_values("m").alias("vals"), F.size(c.object_entries("m")).alias("entries_"), c.object_property("m", "k").alias("prop"), c.object_property("m", "none").alias("no_prop"),
        c.object_has_property("m", "k").alias("has"), c.object_size("m").alias("size_"), c.object_size(c.object_delete_property("m", "k")).alias("deleted"),
        c.object_property(c.object_merge("m", F.create_map(F.lit("k"), F.col("m")["k"] * 2)), "k").alias("merged"), c.object_size(c.object_set_property("m", "new", F.lit(1).cast("long"))).alias("set_size"),
    )


@query("""SELECT c_custkey, true AS str_, true AS int_, true AS float_, true AS number_, false AS array_, false AS object_, false AS bool_, c_name IS NULL AS null_, c_acctbal <> 0 AS to_bool, CAST(trunc(c_acctbal) AS BIGINT) AS to_int,
  CAST(c_custkey AS DOUBLE) AS to_number, CAST(substring(c_name, length(c_name) - 2) AS BIGINT) AS parsed, CAST(c_custkey AS VARCHAR) AS to_text, [c_custkey] AS to_list, 'bigint' AS kind FROM customer""")
def fn_types(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey", ty.is_string("c_name").alias("str_"), ty.is_int("c_custkey").alias("int_"), ty.is_float("c_acctbal").alias("float_"), ty.is_number("c_nationkey").alias("number_"), ty.is_array("c_name").alias("array_"),
        ty.is_object("c_name").alias("object_"), ty.is_boolean("c_name").alias("bool_"), ty.is_null("c_name").alias("null_"), ty.to_boolean("c_acctbal", "double").alias("to_bool"), ty.to_int("c_acctbal", "double").alias("to_int"),
        ty.to_number("c_custkey", "bigint").alias("to_number"), ty.to_int(F.expr("substring(c_name, length(c_name) - 2)"), "string").alias("parsed"), ty.to_string("c_custkey", "bigint").alias("to_text"), ty.to_array("c_custkey", "bigint").alias("to_list"), ty.type_of("c_custkey").alias("kind"),
    )


@query("""WITH x AS (SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events)
SELECT event_id, ms, strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S') AS formatted, ms AS parsed, ms AS event_timestamp, ms + 500 AS delayed FROM x""")
def fn_time(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    d = t.event_timed(d, "ms").withColumn("formatted", t.format_time("ms", "%Y-%m-%dT%H:%M:%S"))
    return t.delayed(d.withColumn("parsed", t.parse_time(t.format_time("ms"))).withColumn("delayed", F.col("ms")), "delayed", 500)


@query("SELECT r_regionkey, true AS same, true AS in_run, true AS stamped FROM region")
def fn_clock(spark, sf_dir):
    """The run's own time: one for the whole query, within a day of the driver's clock, and on every row."""
    import time

    d = t.timestamped(table(spark, sf_dir, "region").select("r_regionkey"))
    near = F.abs(F.col("timestamp") - F.lit(int(time.time() * 1000))) < 86_400_000
    return d.select("r_regionkey", (F.col("timestamp") == t.now()).alias("same"), near.alias("in_run"), F.col("timestamp").isNotNull().alias("stamped"))


@query("""WITH x AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, make_timestamp(epoch_us(ts) // 1000000 * 1000000) AS s FROM events)
SELECT event_id, ms AS a, epoch_us(s) // 1000 AS b, epoch_us(s) // 1000 AS c, epoch_us(s) // 1000 AS d, epoch_us(date_trunc('day', s)) // 1000 AS e, CAST(NULL AS BIGINT) AS f, epoch_us(s) // 1000 AS g FROM x""")
def fn_parse_time(spark, sf_dir):
    """Every format that is tried without being given, a time alone, and a given one."""
    d = table(spark, sf_dir, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    formats = {**dict(zip("abcde", t.FORMATS, strict=True)), "f": "%H:%M:%S"}
    out = {k: t.parse_time(t.format_time("ms", f)) for k, f in formats.items()}
    return d.select("event_id", *[v.alias(k) for k, v in out.items()], t.parse_time(t.format_time("ms", "%d.%m.%Y %H:%M:%S"), "%d.%m.%Y %H:%M:%S").alias("g"))


@query("""WITH x AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS a, list(o_orderstatus ORDER BY o_orderkey) AS s FROM orders GROUP BY 1)
SELECT o_custkey, list_transform(range(0, len(a), 3), lambda i: a[i + 1 : i + 3]) AS parts, list_filter(s, lambda v, i: list_position(s, v) = i) AS firsts, array_to_string(s, '-') AS joined,
  CAST(o_custkey AS FLOAT) / 2 AS float_, CAST(len(a) AS FLOAT) AS n FROM x""")
def fn_split_unique_join(spark, sf_dir):
    """Arrays in parts of three, first occurrences, texts joined, and numbers as floats."""
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("r"))
    rows = rows.select("o_custkey", F.col("r.o_orderkey").alias("a"), F.col("r.o_orderstatus").alias("s"))
    return rows.select(
        "o_custkey", c.array_split("a", 3).alias("parts"), c.array_unique("s").alias("firsts"), s.join("s", "-").alias("joined"),
        (ty.to_float("o_custkey", "bigint") / 2).cast("float").alias("float_"), ty.to_float(F.size("a").cast("string"), "string").alias("n"),
    )
