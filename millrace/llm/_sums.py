"""Sums of fixed-size arrays over all tasks, and narrow filters over whole rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from millrace.llm._text import chunks

#: Values in one row of partial sums.
_ROW = 4096


def summed(docs: DataFrame, size: int, count: Callable[[pa.Table, list[str]], np.ndarray]) -> np.ndarray:
    """The sum of count(rows, texts), an array of ``size`` numbers, over all rows of docs (it has a column text).

    Each task keeps one array and sends it in slices; slices are added in two rounds, first in 16 groups of tasks, so
    no task meets the slices of all others. What reaches the driver has the fixed size.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for rows, texts in chunks(batches):
            total += count(rows, texts)
        task = TaskContext.get().partitionId() % 16
        for at in range(0, size, _ROW):
            if (part := total[at : at + _ROW]).any():
                yield pa.RecordBatch.from_pydict({"at": pa.array([at], pa.int64()), "team": pa.array([task], pa.int64()), "part": pa.array([part.tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for at, team, part in zip(b.column("at").to_pylist(), b.column("team").to_pylist(), b.column("part").to_pylist()):
                values = np.frombuffer(part)
                sums[at, team] = sums[at, team] + values if (at, team) in sums else values
        for (at, team), values in sums.items():
            yield pa.RecordBatch.from_pydict({"at": pa.array([at], pa.int64()), "team": pa.array([team], pa.int64()), "part": pa.array([values.tobytes()], pa.binary())})

    schema = "at long, team long, part binary"
    teams = docs.mapInArrow(partial, schema).repartition("at", "team").mapInArrow(add, schema)
    out = np.zeros(size)
    for at, part in teams.selectExpr("at", "0L AS team", "part").repartition("at").mapInArrow(add, schema).select("at", "part").collect():
        out[at : at + _ROW] += np.frombuffer(part)
    return out


def keep_rows(docs: DataFrame, wanted: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """The rows of docs, all columns as they are, whose text (null: empty) is wanted; rows stay in their tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            yield from rows.filter(pa.array(wanted(texts), pa.bool_())).to_batches()

    return docs.mapInArrow(run, docs.schema)
