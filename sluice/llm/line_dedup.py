"""Line dedup by site-relative frequency: lines that stand on more than a share of a host's pages are boilerplate and go.

Pages that contain each line are counted by host and line hash (each line once for a page, pre-aggregated before the
shuffle) and divided by the host's pages. A host has few lines above the share (lines of a page / share at most), so they
go to its pages as one array by a join on hosts, which needs no shuffle of texts while the table of all hosts is small
enough for Spark to broadcast by its size, and joins by host, split at run time where skewed, when it isn't.

Lines are the parts between line feeds, compared whole; those without a word are left alone. A line must stand on
`least` pages, or a small host would have nothing else. Nulls: a null text stays null; a null host is a host. A text all
of whose lines go is empty. Rows repeated count as pages. Ties: a line on just the share of pages stays. Very long texts are
split and cleared whole, one at a time. An empty table gives an empty result. Other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Workspace, documents, free_name
from .native import let

SHARE, LEAST = 0.05, 10


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(docs: DataFrame, host: Column, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """b_host, bad: hashes of each host's boilerplate lines."""
    pages = docs.select(host.alias("host"), "text")
    worded = F.transform(F.filter(lines(F.col("text")), lambda x: x.rlike(WORD)), lambda x: F.xxhash64(x))
    counted = pages.select("host", F.explode(F.array_distinct(worded)).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    totals = pages.groupBy("host").agg(F.count("*").alias("pages")).withColumnRenamed("host", "t_host")
    often = counted.filter(F.col("n") >= least).join(totals, F.col("host").eqNullSafe(F.col("t_host"))).filter(F.col("n") > share * F.col("pages"))
    return often.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("bad")).select(F.col("host").alias("b_host"), "bad")


def without_boilerplate(docs: DataFrame, host: Column | None = None, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """docs with `text` cleared of boilerplate, and n_lines, n_removed in a last, struct column `dedup` (`dedup_` if docs has one)."""
    host = F.col("source") if host is None else host
    ws = Workspace(docs.sparkSession, "lines")
    bad = ws.save(boilerplate(docs, host, share, least), "boilerplate")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), host.alias("host"), "text").join(bad, F.col("host").eqNullSafe(F.col("b_host")), "left")

    def cleared(all_: Column) -> Column:
        keep = F.filter(all_, lambda x: ~(F.array_contains(F.col("bad"), F.xxhash64(x)) & x.rlike(WORD)))
        return let(keep, lambda k: F.struct(F.array_join(k, "\n").alias("text"), F.size(all_).cast("long").alias("n_lines"), (F.size(all_) - F.size(k)).cast("long").alias("n_removed")))

    whole = lambda all_: F.struct(F.col("text").alias("text"), F.size(all_).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    none = F.struct(F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    out = F.when(F.col("text").isNull(), none).otherwise(let(lines(F.col("text")), lambda all_: F.when(F.col("bad").isNull(), whole(all_)).otherwise(cleared(all_))))
    rows = rows.select("doc", out.alias("dedup"))
    return rows.select(*[F.col("dedup.text").alias("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns], F.col("dedup").alias(free_name(docs, "dedup")))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their sources' boilerplate lines."""
    docs = documents(spark, sf_dir)
    name = free_name(docs, "dedup")
    return without_boilerplate(docs).select("doc_id", "text", f"{name}.n_lines", f"{name}.n_removed")


QUERIES = {"op6_line_dedup": op6_line_dedup}

ORACLE = {
    "op6_line_dedup": r"""
WITH p AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS all_lines FROM documents),
u AS (SELECT source, unnest(list_distinct(all_lines)) AS line FROM p),
c AS (SELECT source, line, count(*) AS k FROM u WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY source, line),
t AS (SELECT source, count(*) AS pages FROM p GROUP BY source),
b AS (SELECT c.source AS b_source, list(c.line) AS bad FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
      WHERE c.k >= 10 AND c.k > 0.05 * t.pages GROUP BY c.source),
j AS (SELECT doc_id, all_lines, coalesce(bad, []) AS bad FROM p LEFT JOIN b ON p.source IS NOT DISTINCT FROM b.b_source),
f AS (SELECT doc_id, all_lines, list_filter(all_lines, lambda x: NOT list_contains(bad, x)) AS good FROM j)
SELECT doc_id, array_to_string(good, chr(10)) AS text, CAST(coalesce(len(all_lines), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(all_lines) - len(good), 0) AS BIGINT) AS n_removed FROM f
"""
}
