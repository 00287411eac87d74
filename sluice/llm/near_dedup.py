"""Near-duplicate groups: SetSketch registers, banded; candidates judged by likelihood; links confirmed on full sets.

1. Each text gives the set of its distinct shingles, its SetSketch (registers floor(1 - log_b(x)) of the least of
   exponentially distributed hashes, truncated to 16 bits; registers of a union are the larger ones, so sketches merge)
   and a hash of the set. Texts of equal sets are linked without more ado and go on as one.
2. Bands of registers: sets that agree in a band are candidates. A pair at the threshold agrees in none of 60 bands of 7
   with probability 7e-7; one of similarity 0.5 in some with 0.37, of 0.3 with 0.013. Each bucket names its least member,
   its hub, so that no pairs are emitted.
3. Each set is held against the hub that it shares most bands with: a task has a hub and some of its sets. Copies of one
   text, however many, are linked here by one comparison each.
4. Buckets whose sets are in one component are done. The others' sets form coarse groups, those of over 500 sets cut
   into blocks, with a task for each pair of blocks. Registers alone are dealt: sets of different components are judged
   by sizes, then by the likelihood of the threshold given how many registers are equal, larger and smaller. Texts go
   only to the pairs of blocks in which they have a likely partner, and full sets are compared there; a task gives links
   that span its components.
5. Links of all tasks are joined to components, named by the least document id.

Only the likelihood test (at 1e-7) and the bands are not exact; no partner is dropped for its group's size. A group
of n sets that are candidates for each other but not linked costs n * n / 2 register comparisons, spread over tasks.

Nulls: a null or wordless text has no shingles and is linked with nothing; with fewer words than a shingle, the whole
sequence is one. A null id is never a component's name unless all its members' are null. Rows repeated are members of one
component, and `kept` alike; deduplicated() keeps one of them. Ties: the least id names a component; among equal ids the
least hash of the text stays. Very long texts are sketched in slices, and are a block of their own where they fill one.
An empty table gives an empty result. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, documents, flat, map_arrow, map_batches, record, trim
from .graph import components
from .kernels import LOWER, mix, shingles, word_hashes

B, RATE, TOP = 1.001, 20.0, 65535
#: A task's block: sets and bytes of text.
BLOCK_SETS, BLOCK_BYTES = 500, 8 << 20
#: Log-likelihood ratio beyond which a pair is taken to be below the threshold: once in 1e7 pairs at it.
RATIO = 14.0
BANDS, ROWS = 60, 7


@cache
def family(m: int) -> tuple[np.ndarray, np.ndarray]:
    """What makes m 32-bit hashes of one: bits to flip, and odd factors."""
    seeds = (mix(np.arange(1, 2 * m + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
    return seeds[:m], seeds[m:] | np.uint32(1)


def minima(x: np.ndarray, m: int) -> np.ndarray:
    """Least of m 32-bit hashes of a set of 64-bit hashes."""
    (flip, odd), short = family(m), (x >> np.uint64(32)).astype(np.uint32)
    least = np.full(m, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(short), 256):
        some = short[i : i + 256, None] ^ flip
        some *= odd
        np.minimum(least, some.min(0), out=least)
    return least


def registers(least: np.ndarray) -> np.ndarray:
    u = (least.astype(np.float64) + 0.5) / 2.0**32
    return np.clip(np.floor(1 - np.log(-np.log1p(-u) / RATE) / math.log(B)), 0, TOP).astype(np.uint16)


def sketch(x: np.ndarray, m: int) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes."""
    return registers(minima(x, m))


def likely(n_a: int, n_b: np.ndarray, equal: np.ndarray, larger: np.ndarray, smaller: np.ndarray, at: float, ratio: float = RATIO) -> np.ndarray:
    """Whether a Jaccard similarity of `at` or more fits registers of which so many are equal, larger in a, and smaller."""
    n_a, n_b = float(n_a), n_b.astype(np.float64)
    top = np.minimum(n_a / n_b, n_b / n_a)

    def ln(j):
        return equal * np.log(np.maximum(j, 1e-12)) + larger * np.log(np.maximum(n_a - j * n_b, 1e-12)) + smaller * np.log(np.maximum(n_b - j * n_a, 1e-12))

    lo, hi = np.zeros(len(n_b)), top.copy()  # the likelihood is concave in j
    for _ in range(30):
        a, b = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
        left = ln(a) > ln(b)
        hi, lo = np.where(left, b, hi), np.where(left, lo, a)
    best = (lo + hi) / 2
    return (top >= at) & ((best >= at) | (ln(best) - ln(np.full(len(n_b), at)) <= ratio))


def opponents(i: int, root: np.ndarray, sizes: np.ndarray, side: np.ndarray, one: bool, percent: int) -> np.ndarray:
    """Sets that i is to be held against: of other components and fitting sizes, behind it, or of the other side if there are two."""
    open_ = (root[i + 1 :] != root[i]) & (100 * np.minimum(sizes[i + 1 :], sizes[i]) >= percent * np.maximum(sizes[i + 1 :], sizes[i]))
    if not one:
        open_ &= side[i + 1 :] != side[i]
    return np.flatnonzero(open_) + i + 1


def judged(i: int, them: np.ndarray, sizes: np.ndarray, regs: np.ndarray, percent: int) -> np.ndarray:
    """Those of `them` that may be linked with i by their registers."""
    equal, larger = (regs[them] == regs[i]).sum(1), (regs[them] < regs[i]).sum(1)
    # a larger register is a smaller minimum: the minimum of both sets is in that one alone
    return them[likely(sizes[i], sizes[them], equal, larger, regs.shape[1] - equal - larger, percent / 100)]


def likely_members(sizes: np.ndarray, regs: np.ndarray, comp: np.ndarray, side: np.ndarray, percent: int) -> np.ndarray:
    """Whether each set has a likely partner of another component (and side, if there are two)."""
    out, one = np.zeros(len(sizes), bool), side.min() == side.max()
    for i in range(len(sizes)):
        if len(them := opponents(i, comp, sizes, side, one, percent)) and len(them := judged(i, them, sizes, regs, percent)):
            out[i] = out[them] = True
    return out


def spanning_links(flat_sets: np.ndarray, bounds: np.ndarray, regs: np.ndarray, comp: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that, beside those that made the components `comp`, span the components of sets flat_sets[bounds[i]:bounds[i + 1]]; only sets of different sides are compared, or all if there is one side."""
    sizes, one, out = np.diff(bounds), side.min() == side.max(), []
    _, root = np.unique(comp, return_inverse=True)
    for i in range(len(sizes)):
        if not len(them := opponents(i, root, sizes, side, one, percent)):
            continue
        them = judged(i, them, sizes, regs, percent)
        for some in np.array_split(them, 1 + int(sizes[them].sum()) // 1_000_000):
            if not len(some):
                continue
            all_ = np.concatenate([flat_sets[bounds[j] : bounds[j + 1]] for j in some])
            own = flat_sets[bounds[i] : bounds[i + 1]]
            hit = own[np.minimum(np.searchsorted(own, all_), len(own) - 1)] == all_
            both = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes[some]) - sizes[some])
            for j in some[100 * both >= percent * (sizes[i] + sizes[some] - both)]:
                if root[j] != root[i]:
                    out.append((i, int(j)))
                    root[root == root[j]] = root[i]
    return out


def shingle_set(h: np.ndarray, words: int) -> np.ndarray:
    return np.unique(shingles(h, words))


def sketched(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_id, regs."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.int64()), ("regs", pa.binary())])

    def make(batches):
        for batch in batches:
            data, offsets = flat(batch["text"])
            h, counts = word_hashes(LOWER[data], offsets)
            n, ids, least = [], [], []
            for a, b in zip(counts[:-1].tolist(), counts[1:].tolist(), strict=True):
                x = shingle_set(h[a:b], words)
                n.append(len(x))
                ids.append(int(mix(mix(x + np.arange(1, len(x) + 1, dtype=np.uint64)).sum(keepdims=True)).view(np.int64)[0]) if len(x) else None)
                least.append(minima(x, bands * rows))
            regs = registers(np.stack(least)) if least else []
            yield record(schema, doc_id=batch["doc_id"], text_hash=batch["text_hash"], n_shingles=n, set_id=ids, regs=[r.tobytes() if k else None for r, k in zip(regs, n, strict=True)])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return map_arrow(picked, make, "doc_id long, text_hash long, n_shingles long, set_id long, regs binary")


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
DEALT = ["set_id", "n_shingles", "regs", "comp", "coarse", "i", "j", "own"]


def arranged(group: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The sets of a pair of blocks, each once and one block after the other; their sides and registers."""
    _, first = np.unique(group["set_id"].to_numpy(), return_index=True)  # repeated rows
    side = (group["own"].to_numpy() != group["i"].to_numpy())[first].astype(np.int8)
    picked = group.take(pa.array(first[np.argsort(side, kind="stable")])).combine_chunks()
    return picked, np.sort(side), np.frombuffer(b"".join(picked["regs"].to_pylist()), np.uint16).reshape(len(first), -1)


def apart(group: pa.Table, side: np.ndarray) -> bool:
    """Whether the group is a pair of blocks of which one is missing."""
    return group["i"][0].as_py() != group["j"][0].as_py() and side.min() == side.max()


def linked(dealt: DataFrame, words: int, percent: int) -> DataFrame:
    """a, b: spanning links of each pair of blocks, from the full sets; dealt has DEALT and text."""

    def link(group):
        picked, side, regs = arranged(group)
        links = []
        if not apart(group, side):
            data, offsets = flat(picked["text"].combine_chunks())
            h, counts = word_hashes(LOWER[data], offsets)
            each = [shingle_set(h[a:b], words) for a, b in zip(counts[:-1], counts[1:], strict=True)]
            links = spanning_links(np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])]), regs, picked["comp"].to_numpy(), side, percent)
            del h, each, data
        if group.nbytes > 1 << 20:
            trim()
        ids = picked["set_id"].to_numpy()
        return pa.table({"a": pa.array([ids[a] for a, _ in links], pa.int64()), "b": pa.array([ids[b] for _, b in links], pa.int64())}, schema=LINKS)

    return dealt.groupBy("coarse", "i", "j").applyInArrow(link, "a long, b long")


def likely_rows(dealt: DataFrame, percent: int) -> DataFrame:
    """Those rows of dealt (as DEALT) whose sets have a likely partner in their pair of blocks."""

    def judge(group):
        picked, side, regs = arranged(group)
        if apart(group, side):
            return picked.slice(0, 0)
        return picked.filter(pa.array(likely_members(picked["n_shingles"].to_numpy(), regs, picked["comp"].to_numpy(), side, percent)))

    return dealt.groupBy("coarse", "i", "j").applyInArrow(judge, dealt.schema)


def blocks(sizes: str = "n", shingles_: str = "w"):
    return F.ceil(F.greatest(F.col(sizes) / BLOCK_SETS, F.col(shingles_) * 8 / BLOCK_BYTES)).cast("int")


def grouped(docs: DataFrame, words: int = 4, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_hash, n_shingles, group (null for texts without words) of each row."""
    ws = Workspace(docs.sparkSession, "near")
    all_ = ws.save(sketched(docs, words, bands, rows), "sketches")
    # one row of each set; its text is that of the first of its documents
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_hash")).alias("first")
    sets = ws.save(all_.filter("set_id is not null").groupBy("set_id").agg(first, F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs")).select("set_id", "n_shingles", "first.doc_id", "first.text_hash", "regs"), "sets")

    def band(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(batch["regs"].to_pylist()), np.uint16).reshape(batch.num_rows, bands, rows).astype(np.uint64)
            key = np.full((batch.num_rows, bands), 1, np.uint64) + np.arange(bands, dtype=np.uint64)
            for i in range(rows):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + regs[:, :, i])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch["set_id"].to_numpy(), bands)), pa.array(key.ravel().view(np.int64))], ["set_id", "key"])

    keys = ws.save(map_batches(sets.select("set_id", "regs"), band, "set_id long, key long"), "keys")
    hubs = ws.save(keys.groupBy("key").agg(F.min("set_id").alias("hub"), F.count("*").alias("k")).filter("k > 1").select("key", "hub"), "hubs")
    buckets = ws.save(keys.join(hubs, "key"), "buckets")
    ws.drop("keys")
    text = docs.select(F.col("doc_id").cast("long").alias("d"), "text", F.xxhash64("text").alias("h"))
    wanted = ws.save(sets.join(buckets.select(F.col("set_id").alias("m")), F.col("set_id") == F.col("m"), "left_semi"), "wanted")
    texts = ws.save(wanted.join(text, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))).select("set_id", "n_shingles", "regs", "text"), "texts")

    # each set against the hub with which it shares most bands
    best = buckets.filter("set_id <> hub").groupBy("set_id", "hub").agg(F.count("*").alias("k")).groupBy("set_id").agg(F.max(F.struct("k", "hub")).alias("best")).select(F.col("set_id").alias("s"), F.col("best.hub").alias("hub"))
    best = ws.save(best, "best")
    sized = best.join(wanted.select("set_id", "n_shingles"), F.col("s") == F.col("set_id")).groupBy("hub").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w")).select(F.col("hub").alias("h"), blocks().alias("blocks"))
    sized = ws.save(sized, "hub-sizes")
    dealt = best.join(sized, F.col("hub") == F.col("h")).select("s", F.col("hub").alias("coarse"), F.pmod(F.xxhash64("s"), F.col("blocks")).cast("int").alias("i"))
    centres = sized.select(F.col("h").alias("s"), F.col("h").alias("coarse"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
    stars = dealt.withColumn("own", F.lit(-1)).unionByName(centres.withColumn("own", F.col("i"))).withColumn("j", F.lit(-1))
    stars = stars.join(texts, F.col("s") == F.col("set_id")).withColumn("comp", F.col("set_id"))
    near = ws.save(linked(stars.select(*DEALT, "text"), words, percent), "near-links")
    roots = components(ws, near, "near")

    # buckets of several components
    named = ws.save(buckets.join(roots, F.col("set_id") == F.col("id"), "left").select("set_id", "key", "hub", F.coalesce("root", "set_id").alias("comp")), "named")
    open_ = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    open_ = named.join(ws.save(open_, "open"), "key", "left_semi")
    coarse = components(ws, open_.filter("set_id <> hub").select(F.col("set_id").alias("a"), F.col("hub").alias("b")).distinct(), "coarse")
    comps = open_.select(F.col("set_id").alias("s"), "comp").distinct()
    left = ws.save(coarse.join(comps, F.col("id") == F.col("s")).join(wanted, F.col("s") == F.col("set_id")).select("set_id", "n_shingles", "regs", "comp", F.col("root").alias("coarse")), "left")
    sizes = ws.save(left.groupBy("coarse").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w")).select(F.col("coarse").alias("c"), blocks().alias("blocks")), "sizes")
    left = left.join(sizes, F.col("coarse") == F.col("c")).withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = left.select("set_id", "n_shingles", "regs", "comp", "coarse", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
    maybe = ws.save(likely_rows(dealt.select(*DEALT), percent), "likely")
    full = maybe.join(texts.select(F.col("set_id").alias("s"), "text"), F.col("set_id") == F.col("s"))
    far = ws.save(linked(full.select(*DEALT, "text"), words, percent), "far-links")
    roots = components(ws, near.unionByName(far), "links")
    for table in ("sets", "hubs", "buckets", "wanted", "texts", "best", "hub-sizes", "near-links", "named", "open", "left", "sizes", "likely", "far-links"):
        ws.drop(table)
    return all_.join(roots, all_["set_id"] == roots["id"], "left").select("doc_id", "text_hash", "n_shingles", F.coalesce("root", "set_id").alias("group"))


def near_groups(docs: DataFrame, **how) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept of each row."""
    ws = Workspace(docs.sparkSession, "near")
    rows = ws.save(grouped(docs, **how), "groups")
    names = ws.save(rows.filter("group is not null").groupBy("group").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("group", "g"), "names")
    out = rows.join(names, F.col("group") == F.col("g"), "left").withColumn("component_id", F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "text_hash", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """docs with one row of each group, that of the least id (null last, then by the text's hash); any one of rows with equal ids and texts. Rows without words all stay."""
    ws = Workspace(docs.sparkSession, "near")
    rows = grouped(docs, **how).filter("group is not null").groupBy("group", "doc_id", "text_hash").agg(F.count("*").alias("k"))
    rows = ws.save(rows.select("group", F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_hash").alias("at"), "k"), "rows")
    best = ws.save(rows.groupBy("group").agg(F.min("at").alias("best")).withColumnRenamed("group", "g"), "best")
    fate = rows.join(best, F.col("group") == F.col("g")).select("at.doc_id", "at.text_hash", F.when(F.col("at") != F.col("best"), 0).otherwise(F.least("k", F.lit(2))).alias("n"))
    fate = ws.save(fate.filter("n <> 1"), "fate")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").cast("long").alias("i"), F.xxhash64("text").alias("h"))
    same = F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash"))
    out = whole.join(fate, same, "left_anti").select("doc")
    several = fate.filter("n = 2")
    if not several.isEmpty():
        out = out.unionByName(whole.join(several, same, "left_semi").groupBy("i", "h").agg(F.first("doc").alias("doc")).select("doc"))
    return out.select("doc.*")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_groups(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {"op4_near_dedup": op4_near_dedup}
