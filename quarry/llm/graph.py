"""Connected components of an edge table, without gathering any component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quarry.llm.scratch import importable, release, stored, width

#: Edges that a task puts together at a time.
HELD = 1 << 18


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of edges between ids an edge from each id to the least of its component: one an id, and often the same one in other tasks."""
    ids, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, label = flat[: len(u)], flat[len(u) :], np.arange(len(ids))
    while ((x := label[a]) != (y := label[b])).any():
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label != (up := label[label])).any():
            label = up
    away = np.flatnonzero(label != np.arange(len(ids)))
    return ids[away], ids[label[away]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``stars`` of the edges of a task, some at a time."""
    held: list[list[np.ndarray]] = []
    size = 0

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*(np.concatenate(c) for c in zip(*held)))], names=["u", "v"])

    for b in batches:
        held.append([c.to_numpy() for c in b.columns])
        size += b.num_rows
        if size >= HELD:
            yield told()
            held, size = [], 0
    if size:
        yield told()


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The different edges as a table, and what tells two tables apart, in one job."""
    seen = Observation()
    total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("total")
    table = stored(edges.distinct().observe(seen, F.count("*").alias("n"), total), "edges")
    return table, (seen.get["n"], seen.get["total"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(u long, v long)``; the component is its smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014): a number of rounds
    logarithmic in the component sizes, each a few joins on the node key and one job, whose result is
    written to the shared folder. Before them the edges of a node meet in one task, which leaves it one edge, to the least
    that they lead to, and joins the others to that. Neighbour sets
    are only ever aggregated to a minimum, so a node with any number of neighbours is no
    problem. Loops, repeated edges and edges with a null end are ignored; an empty table gives no rows.
    """
    importable(edges.sparkSession)
    ends = edges.where("u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v"))
    now, state = _written(ends.repartition(width(edges.sparkSession), "u").mapInArrow(_contracted, "u long, v long"))
    before = None
    while state[0] and state != before:
        old, before = now, state
        now, state = _written(_small_star(_large_star(old).distinct()))
        release(old)
    own = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own)
    out._reads = [now]
    return out
