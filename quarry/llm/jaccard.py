"""MinHash bands of shingle sets, and exact Jaccard similarity within groups of candidates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import words
from quarry.llm.graph import connected_components
from quarry.llm.scratch import importable, release, stored, width

SHINGLE, SIMILAR, RECALL, ROWS, SEED = 5, 0.8, 0.995, 3, 11
#: Members and bytes of text of one group that are compared in one piece; a larger group is cut
#: into pieces of about this size, and every two pieces meet, so the result does not depend on it.
CHUNK, CHUNK_BYTES = 2048, 16 << 20
#: Members up to which each pair is compared by itself.
FEW = 32


def banding(similar: float, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of ``rows`` values that a pair of this similarity shares one of with probability ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similar**rows))) if similar < 1 else 1


def bands_of(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, n_bands: int, rows: int = ROWS) -> np.ndarray:
    """(bodies, bands) of hashed MinHash bands; the shingle hashes of each body are those from its start to its end."""
    if not len(starts):
        return np.zeros((0, n_bands), np.int64)
    h = np.append(h, np.uint64(0))  # an end may be the end of all
    places = np.stack([starts, ends], axis=1).ravel()
    rng = np.random.default_rng(SEED)
    mul = rng.integers(1, 1 << 31, n_bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, n_bands * rows, dtype=np.uint64)
    out = np.zeros((n_bands, len(starts)), np.uint64)
    for i in range(n_bands):
        key = np.full(len(starts), i + 1, np.uint64)
        for j in range(i * rows, (i + 1) * rows):
            x = h * mul[j]
            x += add[j]
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            key = (key ^ np.minimum.reduceat(x, places)[::2]) * np.uint64(0x94D049BB133111EB)
            key ^= key >> np.uint64(32)
        out[i] = key
    return out.T.view(np.int64)


def spanning(sets: list[set[int]], similar: float) -> list[tuple[int, int]]:
    """Edges that span the components of the pairs of sets with Jaccard similarity of at least ``similar``.

    All pairs are counted, in larger groups by an inverted index over the sets' values; of those that reach
    ``similar`` the ones are returned that join two parts.
    """
    n, label, edges = len(sets), list(range(len(sets))), []

    def join(i: int, j: int) -> None:
        edges.append((i, j))
        old, new = label[j], label[i]
        for k in range(n):
            if label[k] == old:
                label[k] = new

    if n <= FEW:
        for i in range(n):
            for j in range(i + 1, n):
                if label[i] != label[j]:
                    shared = len(sets[i] & sets[j])
                    if shared >= similar * (len(sets[i]) + len(sets[j]) - shared) - 1e-9:
                        join(i, j)
        return edges
    sizes = np.array([len(c) for c in sets])
    values, flat = np.unique(np.concatenate([np.fromiter(c, np.uint64, len(c)) for c in sets]), return_inverse=True)
    order = np.argsort(flat, kind="stable")
    posts, ends = np.repeat(np.arange(n), sizes)[order], np.searchsorted(flat[order], np.arange(len(values) + 1))
    marks = np.arange(n)
    for i, c in enumerate(np.split(flat, np.cumsum(sizes)[:-1])):
        if (marks == marks[0]).all():
            break  # all in one part: no pair can join two
        shared = np.zeros(n, np.int64)
        for s in c.tolist():
            shared[posts[ends[s] : ends[s + 1]]] += 1  # a set has a value once
        for j in np.flatnonzero((shared >= similar * (sizes + sizes[i] - shared) - 1e-9) & (marks != marks[i])).tolist():
            if marks[j] != marks[i]:
                edges.append((i, j))
                marks[marks == marks[j]] = marks[i]
    return edges


def shingle_sets(bodies: list[bytes]) -> list[set[int]]:
    """The shingles of each body of normalised words; fewer words than a shingle make one."""
    whole = b"\n".join(bodies)
    first, last = words.bounds(whole)
    h = words.hashes(whole, first, last)
    grams = words.runs(h, SHINGLE).tolist()
    starts = np.searchsorted(first, np.cumsum([0] + [len(x) + 1 for x in bodies])).tolist()
    short = lambda a, e: {int(words.shingles(h[a:e], SHINGLE)[0])}
    return [set(grams[a : e - SHINGLE + 1]) if e - a >= SHINGLE else short(a, e) for a, e in zip(starts, starts[1:])]


def _verify(similar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, set[int]]] = []
        key = None
        us: list[int] = []
        vs: list[int] = []

        def settle() -> None:
            for i, j in spanning([s for _, s in held], similar) if len(held) > 1 else ():
                us.append(held[i][0])
                vs.append(held[j][0])

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
            us.clear()
            vs.clear()
            return out

        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                sets = shingle_sets([x.as_py().encode() for x in b.columns[-1]])
                for *place, node, own in zip(*(c.to_pylist() for c in b.columns[:-1]), sets):
                    if place != key:
                        settle()
                        held, key = [], place
                    held.append((node, own))
            yield told()
        settle()
        yield told()

    return run


def _links(met: DataFrame, similar: float) -> DataFrame:
    """Edges (u, v) that span all pairs of similar bodies in each group of ``met(group, id, m, body)``.

    m is the number of pieces of the group; a member's piece is a hash of its id, and every two pieces meet in a task of their own.
    """
    mine = F.pmod(F.xxhash64("id"), F.col("m")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda j: F.struct(F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j")))
    dealt = met.select("group", F.explode(meets).alias("c"), "id", "body").select("group", "c.i", "c.j", "id", "body")
    near = dealt.repartition(width(met.sparkSession), "group", "i", "j").sortWithinPartitions("group", "i", "j", "id")
    return near.mapInArrow(_verify(similar), "u long, v long")


def classes(rows: DataFrame, candidates: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(id, component) of those of ``rows(id, node, size, body)`` that have a candidate; a row without a similar one is its own component.

    ``candidates(u, v)`` are edges between ids. Whatever is reached over them is one group; within a group all pairs are
    counted exactly, and the pairs that reach ``similar`` make the components. ``node`` names the body, normalised words: equal ones of a group are compared, and moved, once.
    """
    importable(rows.sparkSession)
    close = connected_components(candidates)
    members = stored(close.select(F.col("component").alias("group"), F.col("node").alias("id")).join(rows.select("id", "node", "size"), "id"), "groups")
    release(*close._reads)
    firsts = stored(members.groupBy("group", "node", "size").agg(F.min("id").alias("first")), "group-firsts")
    pieces = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("size") / CHUNK_BYTES)).cast("int")
    several = firsts.groupBy("group").agg(F.count("*").alias("n"), pieces.alias("m")).where("n > 1")
    met = firsts.join(several, "group").select("group", F.col("first").alias("id"), "m")
    part = connected_components(_links(rows.select("id", "body").join(met.hint("shuffle_hash"), "id"), similar))
    own = members.join(firsts, ["group", "node"]).join(part.withColumnRenamed("node", "first"), "first", "left")
    out = stored(own.select("id", F.coalesce("component", "first").alias("component")), "classes")
    release(members, firsts, *part._reads)
    out._reads = [out]
    return out
