"""Token-id files: Parquet list columns in document order, with chosen encodings, row groups and page indexes.

One row is a document: its key, how many ids it has, where it begins in its file, and the ids. Ids are delta-coded
(DELTA_BINARY_PACKED, data pages v2) or dictionary-coded; row groups and pages have a set size, and Parquet's column and
offset indexes are written, so a reader takes the metadata columns alone, or the ids of chosen keys alone.

Nulls: a null text has the end id only; a null key comes first. Repeated keys follow each other by their texts' hashes,
so equal inputs give equal files. A very long text is encoded whole, one at a time, into one row. An empty table gives an empty file set. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, documents, map_arrow, map_batches, record
from .tokens import default_tokenizer, encoder, with_end

FILE = "doc_id long, n_tokens long, part long, local_start long, ids array<int>"
FILE_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("part", pa.int64()), ("local_start", pa.int64()), ("ids", pa.list_(pa.int32()))])
INDEX_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write_token_files(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 1, encoding: str = "delta", row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, page_rows: int = 2000) -> None:
    """Writes the ids of all texts to `path`, files and rows in ascending order of the key."""
    if encoding not in ("delta", "dictionary"):
        raise ValueError(f"encoding: {encoding}")
    tokenizer = tokenizer or default_tokenizer()

    def encode(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, offsets = with_end(*encoder(tokenizer).encode(batch["text"]), end_id)
            n = np.diff(offsets)
            yield record(FILE_ARROW, doc_id=batch["doc_id"], n_tokens=n, part=np.full(len(n), part), local_start=at + offsets[:-1], ids=pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view(np.int32))))
            at += int(offsets[-1])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    options = {
        "compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
        "parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes), "parquet.page.row.count.limit": str(page_rows),
    }
    map_arrow(rows, encode, FILE).write.options(**options).parquet(path)


def token_rows(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows: doc_id, n_tokens, part, local_start, ids. Select what is needed: the reader takes only that."""
    return spark.read.schema(FILE).parquet(path)


def file_starts(spark: SparkSession, path: str) -> dict[int, int]:
    """Ids in all files before each file. One entry for each written file, of which the driver has a list anyway."""
    starts, at = {}, 0
    for part, n in sorted(token_rows(spark, path).groupBy("part").agg(F.sum("n_tokens")).collect()):
        starts[part], at = at, at + n
    return starts


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files alone."""
    starts = spark.sparkContext.broadcast(file_starts(spark, path))

    def index(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            offsets = batch["ids"].offsets.to_numpy()
            values = np.ascontiguousarray(batch["ids"].values.to_numpy(zero_copy_only=False), "<u4")
            crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            start = np.array([starts.value[p] for p in batch["part"].to_pylist()], np.int64) + batch["local_start"].to_numpy()
            yield record(INDEX_ARROW, doc_id=batch["doc_id"], start=start, n_tokens=np.diff(offsets), ids_crc32=np.array(crc, np.int64))

    return map_batches(token_rows(spark, path), index, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token files, and what a reader finds in them."""
    path = f"{Workspace(spark, 'tokens').root}/files"
    write_token_files(documents(spark, sf_dir), path)
    return token_index(spark, path)


QUERIES = {"op5_token_files": op5_token_files}
