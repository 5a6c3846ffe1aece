"""BPE encoding and decoding of whole texts by forced-boundary splitting (see ``bpe.py``)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from millrace.llm._spark import id_type
from millrace.llm._text import chunks
from millrace.llm.bpe import encoder


def encode(docs: DataFrame, vocabulary: str, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """id_column, ids array<int> of each row (null and empty texts: an empty array). Narrow: nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for rows, texts in chunks(batches):
            ids, at = bpe.encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
            yield from pa.table({id_column: rows.column(id_column), "ids": lists}).to_batches()

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.selectExpr(f"`{id_column}`", f"`{text}` AS text").mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")


def decode(tokens: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """The rows with a column ``decoded`` for their ids (null ids: an empty text). A column of that name is replaced."""
    tokens = tokens.drop("decoded")
    schema = StructType([*tokens.schema.fields, StructField("decoded", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for b in batches:
            made = pa.array([bpe.decode(x or []) for x in b.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, made], [*b.schema.names, "decoded"])

    return tokens.mapInArrow(run, schema)


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row's whole text; encoding and decoding in one pass.

    Null and empty texts: 0 tokens and the digests of no bytes. Repeated rows come out as often as they go in; columns
    other than doc_id and text are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for rows, texts in chunks(batches):
            ids, at = bpe.encode(texts)
            raw = memoryview(ids.astype("<u4").tobytes())
            listed, bounds = ids.tolist(), at.tolist()
            spans = list(zip(bounds, bounds[1:]))
            yield from pa.table(
                {
                    "doc_id": rows.column("doc_id"),
                    "n_tokens": pa.array(np.diff(at), pa.int64()),
                    "ids_sha256": [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in spans],
                    "decoded_sha256": [hashlib.sha256(bpe.decode(listed[a:b]).encode()).hexdigest() for a, b in spans],
                }
            ).to_batches()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type(docs)}, n_tokens long, ids_sha256 string, decoded_sha256 string")
