"""Secret scans over a blob ledger: each distinct content is scanned once for each version of the rules.

A text's address is its SHA-256. Contents that the ledger already has for this version are left out before any rule
runs; the others are scanned once each, however many documents or versions hold them; findings go back to all of them by
address. Ledger rows are (blob, rule_version, spans); appending the new ones makes the next scan incremental.
All of it is built-in functions; positions are code points.

Nulls: a null text is empty. Rows repeated have the same blob. Ties: spans with equal starts are listed in the order of
their rules. Very long texts are scanned whole, in time that grows with their length and matches. An empty table gives an
empty result. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, documents
from .native import let, matches

#: kind: pattern, group that must have `least` characters, least. The first three are the base, in this order.
RULES: dict[str, tuple[str, int, int]] = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),  # runs are maximal, so shorter ones needn't be matched first
    "pem": (r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 0),
    "jwt": (r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 0),
    "forge": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    "chat": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    "cloud": (r"AIza[A-Za-z0-9_-]{35}", 0, 0),
}
BASE = ("assign", "access", "hex")
SPAN = "array<struct<start:int,no:int,end:int>>"


def version(rules: dict = RULES) -> str:
    """A name that changes with the rules."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def spans(text: Column, rules: dict = RULES) -> Column:
    """All matches of all rules as structs start, no (of the rule), end, in order."""
    def of(no: int, pattern: str, group: int, least: int) -> Column:
        found = F.transform(matches(text, pattern, group, least), lambda x: F.struct(x["start"].alias("start"), F.lit(no).alias("no"), x["end"].alias("end")))
        return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))

    found = [of(i, *rule) for i, rule in enumerate(rules.values())]
    return F.array_sort(F.concat(*found))


def listed(spans_: Column, rules: dict = RULES) -> Column:
    names = F.array(*[F.lit(x) for x in rules])
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", F.get(names, x["no"]), x["start"], x["end"])), ",")


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: dict = RULES) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, blob, spans) of all documents, and the ledger's new rows (blob, rule_version, spans)."""
    ws, now = Workspace(docs.sparkSession, "secrets"), version(rules)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.unhex(F.sha2("text", 256)).alias("blob"), "text")
    seen = None if ledger is None else ledger.filter(F.col("rule_version") == now)
    todo = rows.select("blob", "text")
    if seen is not None:
        todo = todo.join(seen.select("blob"), "blob", "left_anti")
    todo = todo.groupBy("blob").agg(F.first("text").alias("text"))  # copies in a task merge before the shuffle
    new = ws.save(todo.select("blob", F.lit(now).alias("rule_version"), spans(F.col("text"), rules).alias("spans")), "ledger")
    all_ = new if seen is None else new.unionByName(seen)
    hits = all_.filter("size(spans) > 0").select(F.col("blob").alias("b"), "spans")
    out = rows.select("doc_id", "blob").join(hits, F.col("blob") == F.col("b"), "left")
    return out.select("doc_id", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans")), new


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    found, _ = scan(documents(spark, sf_dir))
    count = lambda i: F.size(F.filter("spans", lambda x: x["no"] == i)).cast("long")
    base = let(F.filter("spans", lambda x: x["no"] < len(BASE)), listed)
    return found.select("doc_id", *[count(i).alias(f"n_{x}") for i, x in enumerate(BASE)], F.sha2(base, 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


QUERIES = {"op9_secrets": op9_secrets}
