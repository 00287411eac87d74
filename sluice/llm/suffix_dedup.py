"""Repeated substrings of `length` bytes, from longest previous and next factors in suffix order.

A byte is removed if a string of `length` bytes that covers it also starts elsewhere (keep="none"), or started earlier
(keep="first": documents by id, then by position; the first copy stays): the suffix at its start has a longest previous
(or next) factor of `length` or more. Suffixes are ordered only with those that they can share so much with:

1. Each string of `length` bytes has an anchor, the k-gram with the least hash in it (the leftmost of equal ones), which
   depends on its content alone, so equal strings have equal anchors at equal places. Consecutive starts with one anchor
   form a span; a document has about one span for 185 bytes. Spans carry the anchor's hash and their content's hash.
2. Spans whose anchor occurs once are done. Of those with equal content, all starts repeat: no bytes are needed.
3. Where an anchor has several contents, each distinct content goes, once, to the task of its anchor. There the suffixes
   at each distance before the anchor are put in order with their common prefixes, and previous and next smaller
   positions in the corpus give longest previous and next factors (module factors).
4. An anchor with more contents than a task takes has its contents cut into pieces of 64 neighbouring starts. All starts of
   a piece share the bytes in its middle, and equal strings lie in pieces that agree in them, so these bytes name the
   pieces' task in place of the anchor, and steps 2 and 3 are done for pieces. Groups that are still too large are cut
   to pieces of 8 starts, and of 1, which are equal if their bytes are, and go by step 2. So no group of any size meets in
   one task, and nothing is left out.
5. Results go back to all spans of equal anchor and content, and to their documents.

Contents are told apart by a pair of 64-bit hashes (anchor and content, group and piece).

Nulls: a null text is empty. A null id sorts first and is joined as an equal. Documents shorter than `length` stay whole.
Rows repeated are copies of each other; of rows with equal ids and texts, keep="first" takes all for one document. An
empty table gives an empty result. Other columns are left out, whatever their names. Long texts are worked through in
pieces of a million starts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, documents, flat, map_arrow, map_batches, record
from .factors import repeated_starts
from .kernels import BASE, mix, prefix, sliding_min

K = 32
#: Starts worked on at once; positions in them fit the low 20 bits of a key.
CHUNK = (1 << 20) - 4096
#: Distinct strings of one group that one task takes; starts of a piece of a larger group, round by round.
GATHERED, WIDTHS = 500, (64, 8, 1)
#: Bytes of strings whose suffixes are ordered at once.
AT_ONCE = 4 << 20
SPANS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("middle", pa.int32()), ("anchor", pa.int64()), ("content", pa.int64())])
SPANS_SQL = "doc_id long, text_hash long, start long, n int, middle int, anchor long, content long"
PIECES = pa.schema([*[(x, pa.int64()) for x in ("anchor", "content", "lo", "group", "piece", "doc_id", "text_hash", "start")], ("n", pa.int32()), ("middle", pa.int32()), ("bytes", pa.binary())])
PIECES_SQL = "anchor long, content long, lo long, group long, piece long, doc_id long, text_hash long, start long, n int, middle int, bytes binary"


def spans(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """start, starts, place of the anchor, its hash and content hash of all spans of one text; together they have each start once."""
    out, w = [], length - K + 1
    for base in range(0, max(0, len(data) - length + 1), CHUNK):
        part = data[base : base + CHUNK + length - 1]
        sums, down = prefix(part)
        grams = mix((sums[K:] - sums[:-K]) * down[: len(part) - K + 1])
        low = np.uint64((1 << 20) - 1)
        at = (sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), w) & low).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        n = np.diff(first, append=len(at))
        end = first + n - 1 + length
        content = mix((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64))
        out.append((first + base, n, at[first] - first, grams[at[first]], content))
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (*[np.empty(0, np.int64)] * 3, *[np.empty(0, np.uint64)] * 2)


def runs(mask: np.ndarray) -> np.ndarray:
    """Begin and end of each run of true, one after the other."""
    return np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))


def merged(ranges: np.ndarray, length: int) -> np.ndarray:
    """Maximal runs of bytes covered by strings that start in any of the ranges [a, b)."""
    if not len(ranges):
        return np.empty((0, 2), np.int64)
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    begin, end = ranges[:, 0], np.maximum.accumulate(ranges[:, 1] + length - 1)
    new = np.append(True, begin[1:] > end[:-1])
    return np.stack([begin[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]], 1)


FOUND = pa.schema([("group", pa.int64()), ("piece", pa.int64()), ("any_runs", pa.list_(pa.int32())), ("later_runs", pa.list_(pa.int32()))])
FOUND_SQL = "group long, piece long, any_runs array<int>, later_runs array<int>"


def matched(table: pa.Table, length: int) -> pa.RecordBatch:
    """Of complete groups of distinct pieces: the runs of their starts that occur in another piece, and that occur in one with an earlier first copy."""
    data, offsets = flat(table["bytes"].combine_chunks().cast(pa.large_binary()).view(pa.large_string()))
    n = table["n"].to_numpy()
    place = np.lexsort((table["start"].to_numpy(), table["text_hash"].to_numpy(), table["doc_id"].fill_null(np.iinfo(np.int64).min).to_numpy()))
    rank = np.empty(len(n), np.int64)
    rank[place] = np.arange(len(n))
    _, group = np.unique(table["group"].to_numpy(), return_inverse=True)
    masks = repeated_starts(data, offsets[:-1], offsets[1:], n, table["middle"].to_numpy(), group, rank, length)
    ends = np.cumsum(n)
    lists = [[runs(mask[a:b]) for a, b in zip(ends - n, ends, strict=True)] for mask in masks]
    return record(FOUND, group=table["group"].combine_chunks(), piece=table["piece"].combine_chunks(), any_runs=lists[0], later_runs=lists[1])


def match_groups(batches, length: int):
    """matched() over a stream ordered by group, some megabytes of whole groups at a time."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size > AT_ONCE:
            table = pa.Table.from_batches(held)
            group = table["group"].to_numpy()
            cut = int(np.searchsorted(group, group[-1]))
            if cut:
                yield matched(table.slice(0, cut), length)
            held = table.slice(cut).combine_chunks().to_batches()
            size = sum(x.nbytes for x in held)
    if held:
        yield matched(pa.Table.from_batches(held), length)


def narrower(batches, width: int, length: int):
    """Pieces cut into those of `width` distances from the anchor, named by the bytes that all strings of such a piece share."""
    base, one = np.uint64(BASE), np.uint64(1)
    for batch in batches:
        rows = []
        for i, raw in enumerate(batch["bytes"].to_pylist()):
            n, middle = batch["n"][i].as_py(), batch["middle"][i].as_py()
            sums, down = prefix(np.frombuffer(raw, np.uint8))
            near, far = middle - n + 1, middle
            j = np.arange(near // width, far // width + 1)
            first, last = middle - np.minimum(far, (j + 1) * width - 1), middle - np.maximum(near, j * width)
            a, z = middle - j * width, middle - (j + 1) * width + 1 + length
            core = mix((sums[z] - sums[a]) * down[a])
            group = mix(core + mix(np.array([batch["group"][i].as_py()]).view(np.uint64)) * base + j.astype(np.uint64) + one)
            whole = mix((sums[last + length] - sums[first]) * down[first])
            piece = mix(whole + mix((middle - first).astype(np.uint64) * base + (last - first).astype(np.uint64)))
            rows += [(i, x, y - x + 1, middle - x, g, p, raw[x : y + length]) for x, y, g, p in zip(first.tolist(), last.tolist(), group.view(np.int64).tolist(), piece.view(np.int64).tolist(), strict=True)]
        for k in range(0, len(rows), 8000):
            i, lo, n, middle, group, piece, cut = zip(*rows[k : k + 8000], strict=True)
            same, lo = batch.take(pa.array(i)), np.array(lo)
            yield record(PIECES, anchor=same["anchor"], content=same["content"], lo=same["lo"].to_numpy() + lo, group=group, piece=piece, doc_id=same["doc_id"], text_hash=same["text_hash"], start=same["start"].to_numpy() + lo, n=n, middle=middle, bytes=cut)


def settled(ws: Workspace, pieces: DataFrame, length: int, gathered: int) -> DataFrame:
    """anchor, content, any_runs, later_runs: the starts that occur in other contents, in one row or several; from distinct contents as pieces."""
    out, distinct, level = [], pieces, 0
    runs_sql = lambda c: F.transform(c, lambda x: (x + F.col("lo")).cast("int"))
    none = F.array().cast("array<int>")
    while True:
        big = ws.save(distinct.groupBy("group").agg(F.count("*").alias("k")).filter(F.col("k") > gathered).select(F.col("group").alias("g")), f"big-{level}")
        usual = distinct.join(big, F.col("group") == F.col("g"), "left_anti").select("group", "piece", "doc_id", "text_hash", "start", "n", "middle", "bytes")
        found = ws.save(map_batches(usual.repartition("group").sortWithinPartitions("group", "piece"), lambda batches: match_groups(batches, length), FOUND_SQL), f"found-{level}")
        named = distinct.select("anchor", "content", "lo", F.col("group").alias("g"), F.col("piece").alias("p"))
        if not level:  # a group is an anchor, a piece a content
            out.append(found.select(F.col("group").alias("anchor"), F.col("piece").alias("content"), "any_runs", "later_runs"))
        else:
            out.append(found.join(named, (F.col("group") == F.col("g")) & (F.col("piece") == F.col("p"))).select("anchor", "content", runs_sql("any_runs").alias("any_runs"), runs_sql("later_runs").alias("later_runs")))
        if level == len(WIDTHS) or big.isEmpty():
            break
        width, level = WIDTHS[level], level + 1
        rest = distinct.join(big, F.col("group") == F.col("g"), "left_semi").select(*PIECES.names)
        cut = ws.save(map_batches(rest, lambda batches, width=width: narrower(batches, width, length), PIECES_SQL), f"cut-{level}")
        position = F.struct("doc_id", "text_hash", "start", "anchor", "content", "lo")
        distinct = cut.groupBy("group", "piece").agg(F.count("*").alias("copies"), F.min(position).alias("first"), F.first("n").alias("n"), F.first("middle").alias("middle"), F.first("bytes").alias("bytes"))
        distinct = ws.save(distinct.select("group", "piece", "first.*", "n", "middle", "bytes", "copies"), f"distinct-{level}")
        # pieces that occur several times: all starts repeat, and all but those of the first copy are later ones
        often = distinct.filter("copies > 1").select(F.col("group").alias("g"), F.col("piece").alias("p"), F.struct("anchor", "content", "lo").alias("first"))
        copies = cut.drop("bytes").join(often, (F.col("group") == F.col("g")) & (F.col("piece") == F.col("p")))
        whole = runs_sql(F.array(F.lit(0), F.col("n")))
        later = F.when(F.struct("anchor", "content", "lo") == F.col("first"), none).otherwise(whole)
        out.append(ws.save(copies.select("anchor", "content", whole.alias("any_runs"), later.alias("later_runs")), f"copies-{level}"))
    all_ = out[0]
    for x in out[1:]:
        all_ = all_.unionByName(x)
    joined = lambda c: F.flatten(F.collect_list(F.when(F.size(c) > 0, F.col(c)))).alias(c)
    return all_ if len(out) == 1 else all_.groupBy("anchor", "content").agg(joined("any_runs"), joined("later_runs"))


def repeated_spans(docs: DataFrame, length: int = 400, keep: str = "none", gathered: int = GATHERED) -> DataFrame:
    """doc_id, text_hash, ranges: the starts (begin, end, one after the other) of strings to remove, of each document that has any."""
    if keep not in ("none", "first"):
        raise ValueError(f"keep: {keep}")
    ws = Workspace(docs.sparkSession, "suffix")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).filter(F.octet_length("text") >= length)

    def find(batches):
        for batch in batches:
            data, offsets = flat(batch["text"])
            each = [spans(data[a:b], length) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            row = pa.array(np.repeat(np.arange(len(each)), [len(x[0]) for x in each]))
            start, n, middle, anchor, content = (np.concatenate(x) for x in zip(*each, strict=True))
            yield record(SPANS, doc_id=batch["doc_id"].take(row), text_hash=batch["text_hash"].take(row), start=start, n=n, middle=middle, anchor=anchor.view(np.int64), content=content.view(np.int64))

    all_ = ws.save(map_arrow(rows, find, SPANS_SQL), "spans")
    often = all_.groupBy("anchor").agg(F.count("*").alias("k"), F.min("content").alias("lo"), F.max("content").alias("hi")).filter("k > 1").select("anchor", (F.col("lo") != F.col("hi")).alias("several"))
    # as a table, so that the join has plain shuffles below it and a hot anchor's spans are split over tasks
    met = ws.save(all_.join(ws.save(often, "often"), "anchor"), "met")
    ws.drop("spans")
    contents = ws.save(met.groupBy("anchor", "content").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "text_hash", "start")).alias("first"), F.first("n").alias("n"), F.first("middle").alias("middle"), F.first("several").alias("several")), "contents")
    # bytes of each distinct content, from its first copy
    wanted = contents.filter("several").select("first.doc_id", "first.text_hash", F.struct("first.start", "n", "middle", "anchor", "content").alias("w"))
    wanted = wanted.groupBy("doc_id", "text_hash").agg(F.collect_list("w").alias("wanted")).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "wanted")

    def cut(batches):
        for batch in batches:
            data, offsets = flat(batch["text"])
            raw = data.tobytes()
            lists = batch["wanted"]
            w = lists.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            start, n = w.field("start").to_numpy(), w.field("n").to_numpy()
            begin = offsets[row] + start
            for i in range(0, len(row), 8000):  # each is up to twice `length` long
                at = slice(i, i + 8000)
                pick, anchor, content = pa.array(row[at]), w.field("anchor")[at], w.field("content")[at]
                texts = [raw[a:b] for a, b in zip(begin[at].tolist(), (begin[at] + n[at] - 1 + length).tolist(), strict=True)]
                yield record(PIECES, anchor=anchor, content=content, lo=np.zeros(len(pick), np.int64), group=anchor, piece=content, doc_id=batch["doc_id"].take(pick), text_hash=batch["text_hash"].take(pick), start=start[at], n=n[at], middle=w.field("middle")[at], bytes=texts)

    first_copies = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))).select("doc_id", "text_hash", "text", "wanted")
    # documents that occur in several rows are cut in each
    pieces = ws.save(map_arrow(first_copies, cut, PIECES_SQL), "pieces")
    if not cut_once(pieces, contents):
        pieces = ws.save(pieces.dropDuplicates(["group", "piece"]), "pieces-once")
    found = settled(ws, pieces, length, gathered)
    told = contents.join(found, ["anchor", "content"], "left").filter("copies > 1 OR size(any_runs) > 0").select(F.col("anchor").alias("a"), F.col("content").alias("c"), "copies", "first", "any_runs", "later_runs")
    back = met.join(ws.save(told, "told"), (F.col("anchor") == F.col("a")) & (F.col("content") == F.col("c")))
    whole = F.array(F.lit(0), F.col("n"))
    if keep == "none":
        which = F.when(F.col("copies") > 1, whole).otherwise(F.col("any_runs"))
    else:
        is_first = F.struct("doc_id", "text_hash", "start").eqNullSafe(F.col("first"))
        which = F.when(~is_first, whole).otherwise(F.coalesce(F.col("later_runs"), F.array().cast("array<int>")))
    ranges = back.select("doc_id", "text_hash", F.transform(which, lambda x: x + F.col("start")).alias("r")).filter("size(r) > 0")
    return ranges.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("r")).alias("ranges"))


def cut_once(pieces: DataFrame, contents: DataFrame) -> bool:
    """Whether each content was cut once."""
    return pieces.count() == contents.filter("several").count()


def without_repeats(docs: DataFrame, length: int = 400, keep: str = "none", gathered: int = GATHERED) -> DataFrame:
    """doc_id, n_bytes, kept (the bytes that stay), removed (begin and end of each maximal removed run, one after the other) of each row."""
    found = repeated_spans(docs, length, keep, gathered).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "ranges")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("kept", pa.binary()), ("removed", pa.list_(pa.int64()))])

    def apply(batches):
        for batch in batches:
            data, offsets = flat(batch["text"])
            raw, kept, removed = data.tobytes(), [], []
            lists = batch["ranges"]
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                found = lists[i]
                if not found.is_valid:
                    kept.append(raw[a:b])
                    removed.append([])
                    continue
                gone = merged(found.values.to_numpy().reshape(-1, 2), length).ravel()
                edges = [a, *(a + gone).tolist(), b]
                kept.append(b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
                removed.append(gone)
            yield record(schema, doc_id=batch["doc_id"], n_bytes=np.diff(offsets), kept=kept, removed=removed)

    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("text_hash").eqNullSafe(F.col("h")), "left").select("doc_id", "text", "ranges")
    return map_arrow(joined, apply, "doc_id long, n_bytes long, kept binary, removed array<long>")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of all documents without strings of 400 bytes that occur twice; characters cut in the middle are U+FFFD in `text`."""
    out = without_repeats(documents(spark, sf_dir))
    removed = (F.col("n_bytes") - F.octet_length("kept")).cast("long")
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.expr("cast(size(removed) div 2 as bigint)").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
