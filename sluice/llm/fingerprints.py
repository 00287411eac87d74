"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A fingerprint holds the k least distinct 64-bit hashes of a text's shingles, in order. The k least of two fingerprints'
hashes together are the fingerprint of both texts' shingles, so parts of a document or of a corpus merge in any order.
From it come estimates of resemblance, of containment, and of the number of distinct shingles; all are exact while sets
have fewer than k members. Memory is k hashes for a text of any length.

Nulls: a null text is empty. A text with fewer words than a shingle is one shingle, without words it has none; two empty
sets resemble each other fully, an empty one and another not at all. Null ids come first; rows of one id follow each
other by their texts' hashes, so ties are equal rows. Long texts are worked through in pieces of a million words. An empty table gives an empty result. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, flat, map_arrow, record
from .kernels import shingles, word_hashes

K, WORDS = 256, 5


def fingerprints(texts: pa.Array, k: int = K, words: int = WORDS) -> list[np.ndarray]:
    data, offsets = flat(texts)
    h, counts = word_hashes(data, offsets)
    out = []
    for a, b in zip(counts[:-1].tolist(), counts[1:].tolist(), strict=True):
        least = np.empty(0, np.uint64)
        for i in range(a, max(a + 1, b - words + 1), 1 << 20):  # long texts merge their parts' fingerprints
            least = np.unique(np.concatenate([least, shingles(h[i : min(b, i + (1 << 20) + words - 1)], words)]))[:k]
        out.append(least)
    return out


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity."""
    both = np.union1d(a, b)
    if max(len(a), len(b)) >= k:
        both = both[:k]
    if not len(both):
        return 1.0
    return len(np.intersect1d(np.intersect1d(a, b, True), both, True)) / len(both)


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k)) if max(len(a), len(b)) >= k else len(np.intersect1d(a, b, True)) / len(a)


def encode(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8")


def fingerprinted(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint (text form), n_distinct of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string()), ("n_distinct", pa.float64())])

    def make(batches):
        for batch in batches:
            each = fingerprints(batch["text"], k, words)
            yield record(schema, doc_id=batch["doc_id"], fingerprint=[encode(x) for x in each], n_distinct=[distinct(x, k) for x in each])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, fingerprint string, n_distinct double")


def in_order(docs: DataFrame) -> DataFrame:
    """Rows in ascending order within a bucket of ids, buckets dealt to tasks; the last row of each bucket (`extra`) is the first of the next one, and the first of all after the last.

    Bucket bounds are quantiles of the ids, and where one id (or none) has the rows of several buckets, parts of its
    texts' hashes, so a task's share is bounded; the driver holds one key per bucket, and four buckets per shuffle
    partition. Bounds are two constants of the plan, however many.
    """
    spark, least = docs.sparkSession, -(1 << 63)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("k", F.coalesce("doc_id", F.lit(least))).withColumn("h", F.xxhash64("text"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = Counter(int(x) for x in rows.approxQuantile("k", [i / n for i in range(1, n)], 1 / (8 * n)) or [])
    bounds = [(k, least + (i << 64) // m) for k, m in sorted(found.items()) for i in range(m)]
    if bounds:
        k, h = (F.split(F.lit(",".join(str(x[i]) for x in bounds)), ",").cast("array<bigint>") for i in (0, 1))
        reached = lambda at: (F.get(k, at) < F.col("k")) | ((F.get(k, at) == F.col("k")) & (F.get(h, at) <= F.col("h")))
        steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
        bucket = F.aggregate(steps, F.lit(0), lambda at, s: at + F.when(reached(at + s - 1), s).otherwise(0))
    else:
        bucket = F.lit(0)
    rows = rows.withColumn("bucket", bucket)
    heads = sorted(rows.groupBy("bucket").agg(F.min(F.struct("k", "h")).alias("at")).select("bucket", "at.k", "at.h").collect())
    if not heads:
        return rows.withColumn("extra", F.lit(False))
    order = [x[0] for x in heads]
    before = dict(zip(order, [order[-1], *order[:-1]], strict=True))
    table = spark.createDataFrame([(before[x], k, h) for x, k, h in heads], "to int, first_k long, first_h long")
    extra = rows.join(F.broadcast(table), (F.col("k") == F.col("first_k")) & (F.col("h") == F.col("first_h"))).select("doc_id", "text", "k", "h", F.col("to").alias("bucket"), F.lit(True).alias("extra"))
    return rows.withColumn("extra", F.lit(False)).unionByName(extra).repartition("bucket").sortWithinPartitions("bucket", "extra", "k", "h").drop("k", "h")


def with_next(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """Each text's fingerprint beside that of its edited text (its last half replaced by the next document's beginning) and of the next document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def pairs(batches):
        last = None
        for batch in batches:
            ids, texts, own, extra = (batch[c].to_pylist() for c in ("doc_id", "text", "bucket", "extra"))
            rows = list(zip(ids, texts, own, extra, fingerprints(batch["text"], k, words), strict=True))
            found = []
            for row in rows:
                if last is not None and last[2] == row[2] and not last[3]:
                    found.append((last, row))
                if not (last is not None and last[2] == row[2] and last[3]):  # further copies of a bucket's extra row
                    last = row
            edited = [a[1][: len(a[1]) - len(a[1]) // 2] + b[1][: len(a[1]) // 2] for a, b in found]
            if not found:
                continue
            prints = fingerprints(pa.array(edited, pa.string()), k, words)
            yield record(
                schema, doc_id=[a[0] for a, _ in found], n_chars=[len(a[1]) for a, _ in found], edited_sha256=[hashlib.sha256(x.encode()).hexdigest() for x in edited],
                fingerprint=[encode(a[4]) for a, _ in found], edited_fingerprint=[encode(x) for x in prints],
                near_edited=[resemblance(a[4], x, k) for (a, _), x in zip(found, prints, strict=True)], near_next=[resemblance(a[4], b[4], k) for a, b in found],
            )

    return map_arrow(in_order(docs), pairs, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, their edited texts and their neighbours."""
    return with_next(documents(spark, sf_dir))


QUERIES = {"op8_fingerprints": op8_fingerprints}
