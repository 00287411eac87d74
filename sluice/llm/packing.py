"""Mixture-controlled packing: deficit round-robin over source queues, its deficits in closed form.

Each source is a queue of tokens, served in granules of a few tokens. In every round a source earns a quantum in
proportion to its target share, sends as many whole granules as its credit covers and carries the rest on as deficit.
Credits are exact fractions, so what source s has sent before round r is floor(r * q_s), at most its queue: any task
works out any round from one row per source, no task waits for another, and deficits carry over windows and partitions
alike. An ended queue sends nothing and the others share its place. Rounds follow each other without gaps and are cut
into windows of `length` tokens. Queues' last parts of under a granule come at the end. The last window's remainder is
cut at powers of two, so nothing is padded.

Default targets are the sources' shares of all tokens: every window has them, and all queues end together.
The source table (1,000,000 rows at most, else an error) is all that the driver takes and every task gets.
Queue order is that of the written token table: by its part, then by row, ties and all. A very long text is encoded whole
and placed in slices of rows. Nulls: a null text is empty and has its end id
alone; a null source is a source. An empty table gives no pieces. Repeated rows are packed each. Other columns are left
out, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, documents, map_arrow, map_batches, record, running, source_sums
from .tokens import default_tokenizer, encoder, with_end

#: ids: as many bytes to an id as its tokenizer needs, one value to the JVM and to Arrow, not thousands.
TOKENS = "doc_id long, source string, part long, local_start long, n long, ids binary"
TOKENS_ARROW = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("part", pa.int64()), ("local_start", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, ids array<int>"
PIECES_ARROW = pa.schema([(x, pa.int64()) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("source", pa.string()), ("ids", pa.list_(pa.int32()))])


class Schedule:
    """Places of all tokens of all queues. sizes: tokens of each source, in order; weights: target shares, or None for the sizes."""

    def __init__(self, sizes: list[int], length: int, granule: int, weights: list[float] | None = None):
        if length % granule:
            raise ValueError("granule must divide length")
        self.length, self.granule = length, granule
        self.sizes = np.array(sizes, np.int64)
        self.full = self.sizes // granule
        self.total, self.all_full = int(self.sizes.sum()), int(self.full.sum()) * granule
        if weights is None:  # all queues end in the same, last round; rounds stay below 2 ** 31, so products below stay exact
            self.den = min(max(1, -(-self.all_full // length)), (1 << 31) - 1)
            self.num = self.full.copy()
        else:
            self.den = 1 << 20
            share = np.array(weights, np.float64) / sum(weights)
            self.num = np.maximum(1, np.round(share * (length // granule) * self.den)).astype(np.int64)
        rest = self.sizes - self.full * granule
        self.rest = self.all_full + np.cumsum(rest) - rest
        self.windows = self.total // length * length  # tokens in full windows
        bits = [1 << b for b in reversed(range(length.bit_length())) if (self.total - self.windows) >> b & 1]
        self.cuts = np.array([self.windows, *(self.windows + np.cumsum(bits))], np.int64)

    def sent(self, r: np.ndarray, s: int | slice) -> np.ndarray:
        """Granules that a source sent before round r."""
        num, full = self.num[s], self.full[s]
        if isinstance(s, slice):
            r = r[:, None]
        return np.minimum(full, r * (num // self.den) + r * (num % self.den) // self.den)

    def granules(self, s: int, k: np.ndarray) -> np.ndarray:
        """Where the full granules k of source s begin."""
        if not len(k):
            return k
        r = np.floor((k + 1) * (self.den / self.num[s])).astype(np.int64)
        while True:  # the float is at most a little off
            late, early = self.sent(r, s) > k, self.sent(r + 1, s) <= k
            if not late.any() and not early.any():
                break
            r = r - late + (early & ~late)
        rounds, back = np.unique(r, return_inverse=True)
        base, step = np.empty(len(rounds), np.int64), max(1, 2_000_000 // len(self.sizes))
        for i in range(0, len(rounds), step):
            before, after = (self.sent(rounds[i : i + step] + d, slice(None)) for d in (0, 1))
            base[i : i + step] = before.sum(1) + (after - before)[:, :s].sum(1) - before[:, s]
        return (base[back] + k) * self.granule

    def pieces(self, s: int, a: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of documents at tokens a to a + n of queue s: document's number, start in it, length, sequence and offset of each piece."""
        g = self.granule
        first, last = a // g, (a + n - 1) // g
        counts = last - first + 1
        doc = np.repeat(np.arange(len(a)), counts)
        k = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + first[doc]
        begin, end = np.maximum(k * g, a[doc]), np.minimum((k + 1) * g, (a + n)[doc])
        whole = k < self.full[s]
        place = np.empty(len(k), np.int64)
        place[whole] = self.granules(s, k[whole])
        place[~whole] = self.rest[s]
        place += begin - k * g
        begin, length = begin - a[doc], end - begin
        ends = place + length
        if len(self.cuts) > 1 and len(over := np.flatnonzero(ends > self.windows)):  # only at the very end
            keep = np.setdiff1d(np.arange(len(k)), over)
            more = [(doc[i], begin[i] + (x - place[i]), y - x, x) for i in over for edges in [[place[i], *self.cuts[(self.cuts > place[i]) & (self.cuts < ends[i])], ends[i]]] for x, y in zip(edges[:-1], edges[1:], strict=True)]
            doc, begin, length, place = (np.concatenate([old[keep], np.array([m[i] for m in more], np.int64)]) for i, old in enumerate((doc, begin, length, place)))
            order = np.lexsort((begin, doc))
            doc, begin, length, place = doc[order], begin[order], length[order], place[order]
        late = place >= self.windows
        block = np.searchsorted(self.cuts, place, side="right") - 1
        sequence = np.where(late, self.windows // self.length + block, place // self.length)
        offset = np.where(late, place - self.cuts[np.maximum(block, 0)], place % self.length)
        new = np.ones(len(doc), bool)  # runs that follow each other in a document and in a sequence are one piece
        new[1:] = (doc[1:] != doc[:-1]) | (sequence[1:] != sequence[:-1]) | (place[1:] != place[:-1] + length[:-1])
        at = np.flatnonzero(new)
        return doc[at], begin[at], np.add.reduceat(length, at) if len(at) else length, sequence[at], offset[at]


def token_queues(ws: Workspace, docs: DataFrame, tokenizer: str, end_id: int, order: list[str]) -> DataFrame:
    """Token ids with each document's place in its source's queue, within the table's part."""

    def encode(batches):
        part, at = TaskContext.get().partitionId(), {}
        for batch in batches:
            ids, offsets = with_end(*encoder(tokenizer).encode(batch["text"]), end_id)
            start = np.empty(batch.num_rows, np.int64)
            for i, (s, n) in enumerate(zip(batch["source"].to_pylist(), np.diff(offsets).tolist(), strict=True)):
                start[i] = at.get(s, 0)
                at[s] = at.get(s, 0) + n
            short = ids.astype("<u2" if encoder(tokenizer).size <= 1 << 16 and end_id < 1 << 16 else "<u4")
            raw = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer((offsets * short.itemsize).astype(np.int32)), pa.py_buffer(short)])
            yield record(TOKENS_ARROW, doc_id=batch["doc_id"], source=batch["source"], part=np.full(len(start), part), local_start=start, n=np.diff(offsets), ids=raw)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"))
    if order:
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return ws.save(map_arrow(rows, encode, TOKENS), "tokens")


def queue_starts(ws: Workspace, tokens: DataFrame) -> tuple[DataFrame, list[tuple[str | None, int]]]:
    """Tokens before each part in its source's queue, and each source's tokens, null last (one row per source)."""
    parts = ws.save(tokens.groupBy("source", "part").agg(F.sum("n").alias("n")), "parts")
    sums = source_sums(parts)
    table = parts.sparkSession.createDataFrame([(i, s) for i, (s, _) in enumerate(sums)], "no int, name string")
    numbered = parts.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    return ws.save(running(numbered, "no", "part", "n", "queue_start").drop("no"), "starts"), sums


def pack(docs: DataFrame, length: int = 4096, granule: int = 32, weights: dict | None = None, tokenizer: str | None = None, end_id: int = 2, order: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, ids.

    weights: target share by source (None: the sources' own shares); one for a source that isn't there is left out,
    a missing one is an error. order: columns by which queues run; None takes the table's order.
    """
    ws = Workspace(docs.sparkSession, "packing")
    tokens = token_queues(ws, docs, tokenizer or default_tokenizer(), end_id, order or [])
    starts, sums = queue_starts(ws, tokens)
    starts = starts.select(F.col("source").alias("s"), F.col("part").alias("p"), "queue_start")
    names = {s: i for i, (s, _) in enumerate(sums)}
    plan = Schedule([n for _, n in sums], length, granule, None if weights is None else [weights[s] for s, _ in sums]) if sums else None

    def cut(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            raw, n = batch["ids"], batch["n"].to_numpy()
            edges = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
            width = int((edges[-1] - edges[0]) // n.sum())
            offsets = (edges - edges[0]) // width
            values = np.frombuffer(raw.buffers()[2], "<u2" if width == 2 else "<u4", int(offsets[-1]), int(edges[0])).astype("<u4")
            source = np.array([names[x] for x in batch["source"].to_pylist()], np.int64)
            at = batch["local_start"].to_numpy() + batch["queue_start"].to_numpy()
            for s in np.unique(source):
                rows = np.flatnonzero(source == s)
                for some in np.array_split(rows, max(1, int(n[rows].sum()) // 4_000_000)):
                    doc, begin, size, sequence, offset = plan.pieces(s, at[some], n[some])
                    row = some[doc]
                    lo = offsets[row] + begin
                    crc = [zlib.crc32(values[a:b]) for a, b in zip(lo.tolist(), (lo + size).tolist(), strict=True)]
                    if with_ids:
                        spans = np.concatenate([[0], np.cumsum(size)])
                        where = np.repeat(lo - spans[:-1], size) + np.arange(spans[-1])
                        ids = pa.ListArray.from_arrays(pa.array(spans, pa.int32()), pa.array(values[where].view(np.int32)))
                    else:
                        ids = pa.nulls(len(row), pa.list_(pa.int32()))
                    yield record(PIECES_ARROW, doc_id=batch["doc_id"].take(pa.array(row)), start=begin, length=size, ids_crc32=np.array(crc, np.int64), doc_tokens=n[row], sequence_id=sequence, offset=offset, source=batch["source"].take(pa.array(row)), ids=ids)

    placed = tokens.join(starts, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "local_start", "queue_start", "n", "ids")
    return map_batches(placed, cut, PIECES)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 ids at most, each with the sources' shares of the corpus."""
    return pack(documents(spark, sf_dir), with_ids=False).drop("ids")


QUERIES = {"op3_packing": op3_packing}
