"""Token files: Parquet with one row per document, made for reading tokens or metadata alone.

Columns: part int, doc_id, start (ids before the document in its part), n_tokens, ids array<int>. Rows lie in ascending
doc_id order, parts in ascending order over files. ids is dictionary-encoded (a page of distinct ids, then bit-packed
places); part, doc_id, start and n_tokens are delta-encoded. Row groups and pages have set sizes, and pages carry the
min/max index that Parquet readers use to skip pages on a doc_id range. Files are written by Spark's own committer, so
a lost task's half-written file is never seen.

Null texts count as empty: only the end id is written. Null doc_ids come first; rows with equal doc_ids are ordered by
a hash of their texts. Very long texts are one row each. An empty table gives a file without rows. doc_ids are longs;
other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._text import chunks
from millrace.llm.bpe import encoder

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
#: Documents in a page: a page of small columns would else hold those of a whole row group, and nothing could be skipped.
PAGE_ROWS = 1000
SCHEMA = "part int, doc_id long, start long, n_tokens long, ids array<int>"


def encode_in_order(docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    """Rows of a token file: texts are dealt by ranges of doc_id, encoded where they lie, and counted by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, before = encoder(vocabulary), TaskContext.get().partitionId(), 0
        for rows, texts in chunks(batches):
            ids, at = bpe.encode(texts)
            n = len(texts)
            full = np.insert(ids, at[1:], end_id).astype(np.int32)
            at = at + np.arange(n + 1)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(full, pa.int32()))
            columns = {"part": pa.array(np.full(n, part), pa.int32()), "doc_id": rows.column("doc_id"), "start": pa.array(before + at[:-1], pa.int64()), "n_tokens": pa.array(np.diff(at), pa.int64()), "ids": lists}
            yield from pa.table(columns).to_batches(max_chunksize=500)
            before += int(at[-1])

    # rows of one doc_id, or of none, may be many: they are dealt by a hash of the text too
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    return ordered.select("doc_id", "text").mapInArrow(run, SCHEMA)


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Writes the token file of all rows of docs (doc_id, text) to the folder ``path``."""
    writer = encode_in_order(docs, vocabulary, end_id).write.mode("overwrite")
    options = {
        "compression": "snappy",  # ids are bit-packed already; zstd's contexts for so many pages cost gigabytes
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.page.row.count.limit": page_rows,
        "parquet.enable.dictionary": "true",
        **{f"parquet.enable.dictionary#{c}": "false" for c in ("part", "doc_id", "start", "n_tokens")},
    }
    for key, value in options.items():
        writer = writer.option(key, value)
    writer.parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """part, doc_id, start within all tokens, n_tokens; the ids are not read.

    A part's first id follows from the sums of the parts before it: one row for each written part, gathered at the
    driver, which is bounded by the number of tasks that wrote.
    """
    rows = spark.read.schema(SCHEMA).parquet(path)
    sums = sorted(rows.groupBy("part").agg(F.sum("n_tokens")).collect())
    before, base = 0, []
    for part, n in sums:
        base.append((part, before))
        before += n
    bases = spark.createDataFrame(base, "part int, base long")
    return rows.join(F.broadcast(bases), "part").select("part", "doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens")


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id, start within its part, n_tokens, ids of documents with first <= doc_id <= last; other pages are skipped."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    return rows if last is None else rows.where(F.col("doc_id") <= last)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    base, before = {}, 0
    for part, n in sorted(rows.groupBy("part").agg(F.sum("n_tokens")).collect()):
        base[part] = before
        before += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            at = lists.offsets.to_numpy().astype(np.int64)
            raw = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            spans = zip(at[:-1].tolist(), at[1:].tolist())
            crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in spans]
            start = np.array([base[p] for p in b.column("part").to_pylist()], np.int64) + b.column("start").to_numpy()
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "start": pa.array(start, pa.int64()), "n_tokens": b.column("n_tokens"), "ids_crc32": pa.array(crc, pa.int64())})

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
