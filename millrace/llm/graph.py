"""Links and their components: in arrays, and of an edge table by contraction, without gathering them at the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._spark import cut, discard
from millrace.llm._text import release

#: Rows of one key that are compared in one place; a key with more is dealt into tiles.
MOST_TOGETHER = 20_000


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the sets of a and b; a label is the smallest member."""
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return label
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while (label[label] != label).any():
            label = label[label]


def spanning(label: np.ndarray, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which of the edges (a, b) make a forest of least weight between the sets of ``label`` (as in ``joined``)."""
    order = np.argsort(weight, kind="stable")
    a, b, label = a[order], b[order], label.copy()
    live, chosen = np.arange(len(a)), [np.zeros(0, np.int64)]
    while True:
        live = live[label[a[live]] != label[b[live]]]
        if not len(live):
            return order[np.concatenate(chosen)]
        best = np.full(len(label), len(a))
        np.minimum.at(best, label[a[live]], live)
        np.minimum.at(best, label[b[live]], live)
        pick = np.unique(best[best < len(a)])
        chosen.append(pick)
        label = joined(label, a[pick], b[pick])


def tiled(rows: DataFrame, most: int | None = None) -> DataFrame:
    """The rows (key, node, ...) in groups of (key, tile): any two rows of a key meet in one of its tiles.

    Most keys have one tile. A key of more than ``most`` rows (MOST_TOGETHER) is dealt into parts by its nodes and has a tile for every
    two of them, so no group has many more than twice ``most`` rows, however many rows have the key. Rows come
    partitioned and sorted by (key, tile, node).
    """
    most = most or MOST_TOGETHER
    often = rows.groupBy("key").count().where(F.col("count") > most)
    hot = cut(often.select("key", F.ceil(F.col("count") / most).cast("int").alias("parts")))
    if hot.isEmpty():
        dealt = rows.withColumn("tile", F.lit(0))
    else:
        n = F.col("parts")
        own = F.pmod(F.xxhash64("node", "key"), n).cast("int")
        tiles = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.least(j, own) * n + F.greatest(j, own))
        dealt = rows.join(hot, "key", "left").withColumn("tile", F.explode(F.coalesce(tiles, F.array(F.lit(0))))).drop("parts")
    return dealt.repartition("key", "tile").sortWithinPartitions("key", "tile", "node")


def whole_groups(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.Table]:
    """Tables of whole groups of equal (key, tile), from rows sorted by them.

    With ``most``, a group of more rows comes in several tables, all but the last of that group alone.
    """
    held: list[pa.Table] = []
    end = lambda t, i: (t.column("key")[i].as_py(), t.column("tile")[i].as_py())
    for b in batches:
        if not b.num_rows:
            continue
        held.append(pa.Table.from_batches([b]))
        last = end(held[-1], -1)
        if end(held[0], 0) == last:  # one group so far
            if most is not None and sum(t.num_rows for t in held) > most:
                yield pa.concat_tables(held)
                held = []
            continue
        table = pa.concat_tables(held)
        key, tile = table.column("key").to_numpy(), table.column("tile").to_numpy()
        at = int(np.flatnonzero((key != last[0]) | (tile != last[1]))[-1]) + 1
        yield table.slice(0, at)
        held = [table.slice(at)]
    if held:
        yield pa.concat_tables(held)
    release()


def bounds(key: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """Where groups start, and the end."""
    return np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (tile[1:] != tile[:-1]), [True]]))


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of edges (a, b); nodes without an edge are absent.

    In each round every node takes its smallest neighbour or itself as its label; labels of labels are followed, each
    step twice as far, until they end at a node that is its own; and edges are drawn between those ends instead. Every
    node that still has an edge thus joins another, so a round at least halves them, and a path of any length takes a
    logarithm of rounds. Nulls in edges are dropped; loops and repeated edges do no harm.
    """
    edges = cut(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct())
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    over = []  # tables of the rounds before, whose rows are in later ones
    while not edges.isEmpty():
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.least("a", "b").alias("y")), F.struct(F.col("b").alias("x"), F.least("a", "b").alias("y")))).alias("e"))
        labels = cut(both.groupBy(F.col("e.x").alias("x")).agg(F.min("e.y").alias("label")))
        while True:
            ends = labels.select(F.col("x").alias("label"), F.col("label").alias("next"))
            further = cut(labels.select("x", "label").join(ends, "label", "left").select("x", F.coalesce("next", "label").alias("label"), (F.col("next") < F.col("label")).alias("moved")))
            discard(labels)
            labels = further
            if further.where("moved").isEmpty():
                break
        label = labels.select("x", "label")
        named = cut(nodes.join(label, F.col("component") == F.col("x"), "left").select("node", F.coalesce("label", "component").alias("component")))
        left = label.select(F.col("x").alias("a"), F.col("label").alias("la"))
        right = label.select(F.col("x").alias("b"), F.col("label").alias("lb"))
        fewer = cut(edges.join(left, "a").join(right, "b").where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
        over += [edges, labels, nodes]
        edges, nodes = fewer, named
    if over:
        discard(*over, edges)
    return nodes
