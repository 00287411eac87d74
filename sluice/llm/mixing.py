"""Mixing sources to target weights: fixed-length blocks, multinomial draws per output shard, permuted indexes, a join.

Every source's words, its documents one after the other by id, are packed into blocks of `block` words (the last is
shorter). The mix is a sequence of slots of one block each, in shards of `shard_slots`. Each shard draws from a
multinomial how many of its slots each source gets, by a generator keyed with its number, so shards need nothing of each
other. The draws' sums come near the slots a source is due; those of a source over its due, chosen by a permutation of
its draws, go to the sources under theirs. Slot j of a source takes block p(j) of pass j div blocks, p a keyed permutation
of the block numbers for each pass, in the last of the full blocks with the short one behind them: no block comes twice
in a pass, and a source's very last slot takes only the words still due, so that all targets are met to the word. Block
data meet slots in a join by block number, of which a source of any size has many.

Targets: sources in code-point order, null last, weigh 5, 2, 1, repeating, and share `share` times all words; no target
goes above `most` times its source's words, and what is over goes to the others by weight, until none is above. The
source table, one row per source (1,000,000 at most, else an error), is the only thing that the driver takes.

The mix doesn't depend on how the table is cut into files and partitions: a source's documents stand by id (null first)
and hash of the text, and only rows that agree in both are told apart by their place.

Nulls: a null text has no words; a null source is a source. Documents without words are listed with nothing taken. An
empty table gives an empty mix. Repeated rows are mixed each. Very long texts are cut into blocks like others, one at a
time in memory. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, documents, flat, map_arrow, map_batches, record, running, source_sums
from .kernels import permute, words

WEIGHTS = (5.0, 2.0, 1.0)
ROWS = "part long, row long, doc_id long, text_hash long, source string, size long"
ROWS_ARROW = pa.schema([("part", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("source", pa.string()), ("size", pa.int64())])
PLACED = "part long, row long, doc_id long, source string, size long, stretch long, local_start long"
PLACED_ARROW = pa.schema([("part", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("source", pa.string()), ("size", pa.int64()), ("stretch", pa.int64()), ("local_start", pa.int64())])
SLOTS_ARROW = pa.schema([(x, pa.int64()) for x in ("shard", "slot", "source_no", "pass", "block", "most")])


def targets(sizes: list[int], share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> list[float]:
    """Words that each source is due; sizes in the order of the sources."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out, rest, open_ = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while open_:
        unit = rest / sum(weight[i] for i in open_)
        over = [i for i in sorted(open_) if unit * weight[i] > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = unit * weight[i]
            break
        for i in over:
            out[i] = most * sizes[i]
            rest -= out[i]
            open_.remove(i)
    return out


def sized_rows(ws: Workspace, docs: DataFrame, texts: bool) -> DataFrame:
    """Rows with their words, named by part and row; with texts if they are wanted."""
    schema = ROWS_ARROW if not texts else pa.schema([*ROWS_ARROW, ("text", pa.string()), ("lang", pa.string())])

    def count(batches):
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = np.diff(words(*flat(batch["text"]))[2])
            more = {"text": batch["text"], "lang": batch["lang"]} if texts else {}
            yield record(schema, part=np.full(len(n), part), row=row + np.arange(len(n)), doc_id=batch["doc_id"], text_hash=batch["text_hash"], source=batch["source"], size=n, **more)
            row += len(n)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"), F.col("source").cast("string").alias("source"), *(["lang"] if texts else []))
    return ws.save(map_arrow(rows, count, ROWS + (", text string, lang string" if texts else "")), "rows")


def placed_rows(ws: Workspace, rows: DataFrame) -> DataFrame:
    """Rows without texts, in stretches by id, with the words before them in their source within the stretch."""

    def place(batches):
        stretch, at = TaskContext.get().partitionId(), {}
        for batch in batches:
            start = np.empty(batch.num_rows, np.int64)
            for i, (s, k) in enumerate(zip(batch["source"].to_pylist(), batch["size"].to_pylist(), strict=True)):
                start[i] = at.get(s, 0)
                at[s] = start[i] + k
            yield record(PLACED_ARROW, stretch=np.full(len(start), stretch), local_start=start, **{c: batch[c] for c in ("part", "row", "doc_id", "source", "size")})

    order = ["doc_id", "text_hash", "part", "row"]
    return ws.save(map_batches(rows.select(*ROWS_ARROW.names).repartitionByRange(*order).sortWithinPartitions(*order), place, PLACED), "placed")


class Mix:
    """sources: (source, size, target) in order. rows: documents with part and row as their key, source_no and the start in their source. pieces: words of documents in blocks. slots: the mix. texts: rows' texts, if wanted."""

    def __init__(self, docs: DataFrame, block: int = 64, shard_slots: int = 1 << 14, seed: int = 20, texts: bool = False, **how):
        self.spark, self.block = docs.sparkSession, block
        self.ws = ws = Workspace(self.spark, "mixing")
        self.texts = sized_rows(ws, docs, texts)
        rows = placed_rows(ws, self.texts)
        parts = ws.save(rows.groupBy("source", "stretch").agg(F.sum("size").alias("n")), "parts")
        sums = source_sums(parts)
        due = targets([n for _, n in sums], **how)
        self.sources = [(s, n, t) for (s, n), t in zip(sums, due, strict=True)]
        table = self.spark.createDataFrame([(i, *x) for i, x in enumerate(self.sources)], "source_no int, name string, source_size long, target double")
        numbered = parts.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("name"))).select("source_no", F.col("source").alias("s"), F.col("stretch").alias("p"), "n", "source_size", "target")
        # one table by source and stretch, written: its size decides how it is joined, and a hot source has many stretches
        places = ws.save(running(numbered, "source_no", "p", "n", "before").drop("n"), "places")
        self.rows = rows.join(places, F.col("source").eqNullSafe(F.col("s")) & (F.col("stretch") == F.col("p"))).withColumn("start", F.col("local_start") + F.col("before")).drop("s", "p", "before", "local_start", "stretch")
        first, last = F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")
        cut = self.rows.filter("size > 0").select("part", "row", "doc_id", "source_no", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
        begin = F.greatest(F.col("start"), F.col("block") * block)
        self.pieces = cut.select(
            "part", "row", "doc_id", "source_no", "block", (begin - F.col("start")).alias("first_word"), (begin - F.col("block") * block).alias("at"),
            (F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - begin).alias("n_words"),
        )
        self.slots = self._slots(shard_slots, seed)

    def _slots(self, m: int, seed: int) -> DataFrame:
        """shard, slot, source_no, pass, block, most (words that the slot takes of the block)."""
        b = self.block
        sizes, due = np.array([x[1] for x in self.sources], np.int64), np.array([round(x[2]) for x in self.sources], np.int64)
        blocks, full = -(-sizes // b), sizes // b
        whole = due // np.maximum(sizes, 1)
        rest = due - whole * sizes
        last = np.where(rest > 0, rest - np.minimum(-(-rest // b) - 1, full) * b, b)  # words of a source's last slot
        slots = whole * blocks + np.where(rest > 0, (rest - last) // b + 1, 0)
        total = int(slots.sum())
        schema = "shard long, slot long, source_no long, pass long, block long, most long"
        if not total:
            return self.spark.createDataFrame([], schema)
        share, n_shards = slots / total, -(-total // m)

        def draw(batches):
            for batch in batches:
                for shard in batch.column(0).to_pylist():
                    counts = np.random.Generator(np.random.Philox(key=[seed, shard])).multinomial(min(m, total - shard * m), share)
                    keep = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), shard)), pa.array(keep), pa.array(counts[keep])], ["shard", "source_no", "n"])

        draws = self.ws.save(self.spark.range(n_shards).mapInArrow(draw, "shard long, source_no long, n long"), "draws")
        drawn = np.zeros(len(sizes), np.int64)
        for s, n in draws.groupBy("source_no").agg(F.sum("n")).collect():
            drawn[s] = n
        over, under = np.maximum(drawn - slots, 0), np.maximum(slots - drawn, 0)
        over_start, under_end = np.cumsum(over) - over, np.cumsum(under)
        at = W.partitionBy("shard").orderBy("source_no")
        placed = running(draws, "source_no", "shard", "n", "before").select("*", (F.sum("n").over(at) - F.col("n")).alias("slot"))

        def fill(batches):
            for batch in batches:
                for shard, s, n, before, slot in zip(*(batch.column(c).to_pylist() for c in ("shard", "source_no", "n", "before", "slot")), strict=True):
                    j = permute(np.arange(before, before + n), int(drawn[s]), seed * 1000003 + 2 * s + 1)
                    source = np.full(n, s, np.int64)
                    if len(extra := np.flatnonzero(j >= slots[s])):
                        t = over_start[s] + j[extra] - slots[s]
                        source[extra] = got = np.searchsorted(under_end, t, side="right")
                        j[extra] = drawn[got] + t - (under_end - under)[got]
                    turn, index = j // blocks[source], j % blocks[source]
                    for g in np.unique(source):
                        for k in np.unique(turn[source == g]):
                            which = np.flatnonzero((source == g) & (turn == k))
                            n_blocks = int(full[g] if k == whole[g] else blocks[g])  # the short block stands last in a pass that isn't whole
                            which = which[index[which] < n_blocks]
                            index[which] = permute(index[which], n_blocks, (seed * 1000003 + int(g)) * 64 + int(k) + 7)
                    most = np.where((j == slots[source] - 1) & (rest[source] > 0), last[source], b)
                    yield record(SLOTS_ARROW, shard=np.full(n, shard), slot=slot + np.arange(n), source_no=source, **{"pass": turn}, block=index, most=most)

        # as a table: its size is known, so the join by block number shuffles it once it is large
        deal = placed.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "shard", "source_no")
        return self.ws.save(map_batches(deal, fill, schema), "slots")

    def taken(self) -> DataFrame:
        """The mix: shard, slot, pass, source_no, block and, of each document in the block, part, row, doc_id, first_word, n_words."""
        return self.slots.join(self.pieces, ["source_no", "block"]).withColumn("n_words", F.least("n_words", F.col("most") - F.col("at"))).filter("n_words > 0").drop("most", "at")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix as rows with the columns of documents: for each pass over a document, the words that the mix takes of it.

    Words that follow each other keep what stands between them; other parts are joined by line feeds.
    """
    mix = Mix(docs, texts=True, **how)
    runs = mix.taken().groupBy("part", "row", "pass").agg(F.sort_array(F.collect_list(F.struct("first_word", "n_words"))).alias("runs"))
    runs = mix.texts.select("part", "row", "doc_id", "text", "lang", "source").join(runs, ["part", "row"])
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])

    def cut(batches):
        for batch in batches:
            data, offsets = flat(batch["text"])
            s, e, counts = words(data, offsets)
            raw, out = data.tobytes(), []
            for base, taken in zip(counts[:-1].tolist(), batch["runs"].to_pylist(), strict=True):
                spans: list[list[int]] = []
                for x in taken:
                    a, n = x["first_word"], x["n_words"]
                    if spans and spans[-1][1] == a:
                        spans[-1][1] = a + n
                    else:
                        spans.append([a, a + n])
                out.append(b"\n".join(raw[s[base + a] : e[base + b - 1]] for a, b in spans).decode())
            yield record(schema, doc_id=batch["doc_id"], text=out, lang=batch["lang"], source=batch["source"], n_chars=[len(x) for x in out])

    return map_arrow(runs, cut, "doc_id long, text string, lang string, source string, n_chars long")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents takes of each."""
    mix = Mix(documents(spark, sf_dir))
    taken = mix.taken().groupBy("part", "row").agg(F.sum("n_words").alias("taken"))
    return mix.rows.join(taken, ["part", "row"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


QUERIES = {"op2_mixing": op2_mixing}
