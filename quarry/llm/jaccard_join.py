"""Jaccard metric-space join of whole documents, exact at every size.

A document is the set of its word shingles; distance is 1 - Jaccard similarity, a metric, and
two documents link within the radius 1 - percent / 100. Unrelated texts are all at distance one from each other and
from any pivot, so pivots alone can't cut the space of all texts. The regions come in three levels.

1. *Rings and projections.* The empty set is the first pivot: by the number of differing shingles a
   set is as far from it as it is large. Rings of sizes are the regions, and the triangle inequality is the window that
   copies a set to the rings of larger sets which it can link with. In a ring linked sets differ
   in at most ``delta`` shingles. Shingles are dealt to ``delta + 1 + slack`` classes by
   hash; projected on a class no distance grows, so linked sets are equal in
   ``slack + 1`` classes at least. Sets that are equal in a class are a region. Empty projections
   are left out, but for the few sets that have more than ``slack`` of them.
2. *Voronoi regions.* The least member of a region is a pivot to which all others are measured. Members
   within the radius link to it and are one component, which needs no further pair; beside those outside they
   stay only in the window of the triangle inequality. What is left of a large region is cut again: members are
   measured to several pivots, belong to the cell of the nearest, and are copied to each other cell
   whose pivot is at most two radii farther. Regions that hold the same members are one.
   Before that, sets in large regions are dealt anew by their rarest shingles, of which linked sets share one.
3. *Leaves.* Regions of bounded size are compared in one task through an index of their shingles. Before sets are moved, sketches are: the
   parities of the numbers of shingles in classes differ in no more places than the sets, so pairs that they put beyond the radius are no links. A region that
   pivots don't cut (its members are all equally far from each other) is dealt to blocks that meet in twos.

Equal sets are one node, whatever their number. Links are verified exactly on 64-bit hashes of whole shingles, and
classes are the components of verified links only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import words
from quarry.llm.graph import connected_components
from quarry.llm.jaccard import spanning
from quarry.llm.scratch import importable, release, stored, width

#: Members and shingles of a region that one task compares; a larger one is cut further, so the result does not depend on them.
LEAF, LEAF_SIZE = 256, 1 << 20
#: Pivots that each region is measured to, one after the other, before a look at what is connected.
STARS = 2
#: A shingle is frequent if a sample of one set in ``DRAWN`` of those in large regions has it ``OFTEN`` times. It decides which regions sets get, not what is found.
DRAWN, OFTEN = 32, 4
#: Pivots of a region that is cut, at most; the share of its pairs that its cells may have for the cut to be worth while.
PIVOTS, CUT = 64, 0.5
#: Rows that are broadcast at most, some ids each; leaves of members that regions with common members may have together, and shingles from which on they are made one.
FEW_ROWS, MERGED, MERGE_SIZE = 1 << 16, 16, 1 << 25
#: A key is salted if a sample of one document in ``SAMPLE`` has it ``HOT`` times. It decides where rows go, not what is found.
SAMPLE, HOT, SALTS = 256, 32, 64
#: Bits of the map that tells which documents are read a second time; a full map only makes more of them be read.
MAP_BITS = 23
MEMO = 1 << 18
PARITIES = 1024
_FINE = 1e-9
_ALL = (1 << 64) - 1
_K = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


class Ring(NamedTuple):
    number: int
    low: int
    high: int
    #: Classes of shingles; 0: linked sets of this ring are equal.
    classes: int
    slack: int


def _delta(high: int, percent: int) -> int:
    """The most shingles in which linked sets of at most ``high`` differ."""
    return 2 * high * (100 - percent) // (100 + percent)


@lru_cache(1 << 16)
def rings(size: int, percent: int) -> tuple[Ring, ...]:
    """The ring of a set of this size, and the rings of larger sets that it can link with."""
    out, low, number = [], 1, 0
    step = max(1.05, (100 / percent) ** 1.6)
    while 100 * size >= percent * low:
        high = max(low, int(low * step)) if number else max(1, (100 + percent - 1) // max(1, 2 * (100 - percent)))
        if high >= size:
            delta = _delta(high, percent)
            classes, slack = delta + 1, 0
            for _ in range(3 if delta else 0):
                empty = classes * math.exp(-percent * low / 100 / classes)
                slack = round(empty + 4 * math.sqrt(empty))
                classes = delta + 1 + slack
            out.append(Ring(number, low, high, classes if delta else 0, slack))
        low, number = high + 1, number + 1
    return tuple(out)


def set_of(text: str | None, shingle: int) -> np.ndarray:
    """Sorted hashes of the different shingles; fewer words than a shingle make one, no words none."""
    h = words.of(words.encoded(text))
    return np.unique(words.runs(h, min(shingle, len(h)))) if len(h) else np.zeros(0, np.uint64)


def signature(g: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set from others."""
    return tuple(int(words.mixed(g * k).sum(dtype=np.uint64).view(np.int64)) for k in _K[:2])


def sketch(g: np.ndarray) -> np.ndarray:
    """The parities of a set's numbers of shingles in ``PARITIES`` classes: two sets differ in at least as many shingles as in bits."""
    n = np.bincount((g & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(n.astype(np.uint8), bitorder="little").view(np.int64)


def keys_of(g: np.ndarray, percent: int) -> np.ndarray:
    """The regions of a set: sets that link share one at least, unless they are equal."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.mixed(g * _K[2]))])
    high, out = g >> np.uint64(32), [np.zeros(0, np.uint64)]
    for ring in rings(len(g), percent) if len(g) else ():
        if not ring.classes:
            continue
        c = (high * np.uint64(ring.classes)) >> np.uint64(32)  # the set is sorted, so a class is a run
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        held, inside = c[first], total[np.append(first[1:], len(g))] - total[first]
        if ring.classes - len(held) > ring.slack:
            none = np.setdiff1d(np.arange(ring.classes, dtype=np.uint64), held)
            held, inside = np.append(held, none), np.append(inside, np.zeros(len(none), np.uint64))
        ids = (held + np.uint64(1)) * _K[0] + np.full(1, ring.number, np.uint64) * _K[1]
        out.append(words.mixed(inside ^ words.mixed(ids)))
    return np.concatenate(out).view(np.int64)


def _scan(percent: int, shingle: int):
    """Of each document its set's size, signature and, once a task for equal sets, regions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b, ns, ss, ks = whole.slice(at, 512), [], [], []
                for x in b.column(1):
                    g = set_of(x.as_py(), shingle)
                    s = signature(g)
                    ns.append(len(g))
                    ss.append(s)
                    ks.append(None if s in seen else keys_of(g, percent))
                    if len(seen) >= MEMO:
                        seen.clear()
                    seen.add(s)
                ids = [pa.array([s[i] for s in ss], pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ns, pa.int64()), *ids, pa.array(ks, pa.list_(pa.int64()))], names=["doc_id", "n", "s1", "s2", "keys"])

    return run


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key those whose key another has, and all of a salted key."""
    key, at, hot, was = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(1, bool)

    def told(keep: np.ndarray, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key[:n][keep]), pa.array(at[:n][keep])], names=["key", "at"])

    for b in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        key, at, hot = (np.concatenate([a[-1:], c]) for a, c in zip((key, at, hot), new))
        if not len(key):
            continue
        same = key[1:] == key[:-1]
        before = np.concatenate([was if len(key) > b.num_rows else np.zeros(1, bool), same])
        yield told((before[:-1] | same | hot[:-1]), len(key) - 1)
        was = before[-1:]
    if len(key):
        key, at, hot = key[-1:], at[-1:], hot[-1:]
        yield told(was | hot, 1)


def _chosen(bitmap: np.ndarray, shingle: int):
    """The sets of documents whose bit is in the map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            bit = whole.column(0).to_numpy()
            rows = np.flatnonzero(bitmap[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1))
            for at in range(0, len(rows), 512):
                sets = [set_of(whole.column(1)[int(i)].as_py(), shingle) for i in rows[at : at + 512]]
                ids = list(zip(*map(signature, sets)))
                shaped = [pa.array([len(g) for g in sets], pa.int64()), *(pa.array(i, pa.int64()) for i in ids), pa.array([g.view(np.int64) for g in sets], pa.list_(pa.int64()))]
                shaped.append(pa.array([sketch(g) for g in sets], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(shaped, names=["n", "s1", "s2", "items", "bits"])

    return run


def _rarest(often: tuple[np.ndarray, np.ndarray], percent: int):
    """(key, node, n) of sets (node, n, items): those of a set's shingles, the rarest first, of which sets that link share one at least.

    The order is the same for all sets: places in ``often``, sorted values and their ranks, others before them.
    """
    values, ranks = often

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b, keys = whole.slice(at, 512), [np.zeros(0, np.uint64)]
                for items in b.column(2):
                    g = items.values.to_numpy().view(np.uint64)
                    rank = np.zeros(len(g), np.int64)
                    if len(values):
                        place = np.minimum(np.searchsorted(values, g), len(values) - 1)
                        rank = np.where(values[place] == g, ranks[place], 0)
                    keys.append(g[np.lexsort((g, rank))[: len(g) + 1 + (-percent * len(g)) // 100]])
                many = np.array([len(k) for k in keys[1:]], np.int64)
                cols = [pa.array(np.repeat(b.column(i).to_numpy(), many)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(words.mixed(np.concatenate(keys) ^ _K[1]).view(np.int64)), *cols], names=["key", "node", "n"])

    return run


def _possible(percent: int):
    """Of rows (region.., node, part, n, bits), a region after the other, those that by their sketches may link with one of another part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        now, fields = None, None

        def told() -> pa.RecordBatch:
            n, part = (np.array([r[k] for r in rows], np.int64) for k in (-2, -3))
            x = np.array([r[-1] for r in rows], np.int64).view(np.uint64).reshape(len(rows), PARITIES // 64)
            keep = np.zeros(len(rows), bool)
            for i in range(len(rows)):
                apart, both = np.bitwise_count(x ^ x[i]).sum(axis=1, dtype=np.int64), n + n[i]
                near = 100 * (both - apart) >= percent * (both + apart)
                keep[i] = (near & (part != part[i])).any()
            kept = [rows[i][:-3] for i in np.flatnonzero(keep)]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in kept], f.type) for i, f in enumerate(fields)], names=[f.name for f in fields])

        for b in batches:
            fields = list(b.schema)[:-3]
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[:-4] != now:
                    if len(rows) > 1:
                        yield told()
                    rows, now = [], row[:-4]
                rows.append(row)
        if len(rows) > 1:
            yield told()

    return run


def _leaf(similar: float):
    """Edges that span the links of each region; rows of a region follow one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, set[int]]] = []
        now = None
        for whole in batches:
            for at in range(0, whole.num_rows, LEAF):
                b, us, vs = whole.slice(at, LEAF), [], []
                for *place, node, items in zip(*(c.to_pylist() for c in b.columns)):
                    if place != now:
                        for i, j in spanning([s for _, s in held], similar) if len(held) > 1 else ():
                            us.append(held[i][0])
                            vs.append(held[j][0])
                        held, now = [], place
                    held.append((node, {x & _ALL for x in items}))
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
        last = spanning([s for _, s in held], similar) if len(held) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([held[e[k]][0] for e in last], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return run


def _different(members: DataFrame) -> DataFrame:
    """``members(key, node, n, ..)`` of one region of each set of members, with their number ``m`` and total size; single ones go."""
    marks = [F.bit_xor(F.xxhash64("node")), F.bit_xor(F.xxhash64("node", F.lit(1))), F.min("node"), F.count("*")]
    told = members.groupBy("key").agg(*[x.alias(f"x{i}") for i, x in enumerate(marks)], F.sum("n").alias("total")).where("x3 > 1")
    one = told.groupBy("x0", "x1", "x2", "x3").agg(F.min("key").alias("key"), F.min("total").alias("total"))
    return members.join(one.select("key", F.col("x3").alias("m"), "total"), "key")


class _Space:
    """Sets of the nodes, the radius, and the links found so far."""

    def __init__(self, sets: DataFrame, percent: int):
        self.sets, self.percent, self.radius = sets, percent, 1 - percent / 100
        self.tables: list[DataFrame] = []
        self.links: list[DataFrame] = []

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(stored(df, name))
        return self.tables[-1]

    def beside(self, rows: DataFrame, column: str) -> DataFrame:
        """The sets, ``column`` being their node, joined to ``rows``; few rows are broadcast, so that sets which nobody asks for aren't moved."""
        here = self.sets.withColumnRenamed("node", column)
        return here.join(F.broadcast(rows) if rows.count() <= FEW_ROWS else rows, column)

    def sketched(self, pairs: DataFrame) -> DataFrame:
        """(p, node, low, possible) of ``pairs(p, node)``: their distance is ``low`` at least, and whether they may link."""
        here = self.sets.select("node", F.col("n").alias("a"), F.col("bits").alias("x"))
        there = self.sets.select(F.col("node").alias("p"), F.col("n").alias("b"), F.col("bits").alias("y"))
        apart = sum((F.bit_count(F.col("x")[i].bitwiseXOR(F.col("y")[i])) for i in range(PARITIES // 64)), F.lit(0)).cast("long")
        met = pairs.join(here, "node").join(there, "p").select("p", "node", (F.col("a") + F.col("b")).alias("both"), apart.alias("apart"))
        possible = 100 * (F.col("both") - F.col("apart")) >= self.percent * (F.col("both") + F.col("apart"))
        return self.kept(met.select("p", "node", (2 * F.col("apart") / (F.col("both") + F.col("apart"))).alias("low"), possible.alias("possible")), "join-sketched")

    def measured(self, pairs: DataFrame) -> DataFrame:
        """(p, node, d, near) of different ``pairs(p, node)``; near ones become links."""
        here = self.beside(pairs, "node").select("p", "node", F.col("n").alias("a"), F.col("items").alias("x"))
        there = self.beside(pairs.select("p").distinct(), "p").select("p", F.col("n").alias("b"), F.col("items").alias("y"))
        met = here.join(there, "p").select("p", "node", F.size(F.array_intersect("x", "y")).cast("long").alias("shared"), (F.col("a") + F.col("b")).alias("both"))
        d = 1 - F.col("shared") / (F.col("both") - F.col("shared"))
        near = 100 * F.col("shared") >= self.percent * (F.col("both") - F.col("shared"))
        out = self.kept(met.select("p", "node", d.alias("d"), near.alias("near")), "join-measured")
        self.links.append(out.where("near").select(F.col("p").alias("u"), F.col("node").alias("v")))
        return out

    def outside(self, measured: DataFrame) -> DataFrame:
        """What a pivot leaves of ``measured(key, node, n, d, near)``: members beyond the radius, and those within that the window lets meet them."""
        least = measured.where("not near").groupBy("key").agg(F.min("d").alias("least"))
        left = measured.join(least, "key").where(~F.col("near") | (F.col("d") >= F.col("least") - self.radius - _FINE))
        return _different(left.drop("d", "p", "least"))

    def star(self, regions: DataFrame) -> DataFrame:
        """Members of ``regions(key, node, n, near)`` against the least of each that isn't within the radius of the pivot before; what is left. Of pairs that sketches tell apart a lower bound of the distance is enough."""
        pivots = regions.where("not near").groupBy("key").agg(F.min("node").alias("p"))
        members = self.kept(regions.join(pivots, "key").where("node <> p").select("key", "node", "n", "p"), "join-members")
        pairs = self.sketched(members.select("p", "node").distinct())
        near = self.measured(pairs.where("possible").select("p", "node"))
        apart = pairs.where("not possible").select("p", "node", F.col("low").alias("d"), F.lit(False).alias("near"))
        return self.kept(self.outside(members.join(near.unionByName(apart), ["p", "node"])), "join-left")

    def cells(self, regions: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
        """Large ``regions(key, node, n, part, m, total)`` as Voronoi cells with windows of two radii, and those that are better left whole.

        A region is cut if its cells together have at most ``CUT`` of its pairs, so each level has fewer.
        """
        share = F.least(F.lit(float(PIVOTS)), F.greatest(F.lit(2.0), 2 * F.col("m") / LEAF)) / F.col("m")
        drawn = (F.pmod(F.xxhash64("node", F.lit(level)), F.lit(1 << 30)) / F.lit(float(1 << 30))) < share
        least = regions.groupBy("key").agg(F.min("node").alias("least"))
        pivots = regions.join(least, "key").where(drawn | (F.col("node") == F.col("least"))).select("key", F.col("node").alias("p"))
        met = self.kept(regions.join(pivots, "key"), "join-met")
        found = self.measured(met.where("node <> p").select("p", "node").distinct())
        own = met.where("node = p").select("key", "node", "n", "part", "m", "p", F.lit(0.0).alias("d"), F.lit(True).alias("near"))
        far = met.where("node <> p").join(found, ["p", "node"]).select(own.columns).unionByName(own)
        nearest = far.groupBy("key", "node").agg(F.min("d").alias("own"))
        held = self.kept(far.join(nearest, ["key", "node"]).where(F.col("d") <= F.col("own") + 2 * self.radius + _FINE), "join-held")
        sizes = held.groupBy("key", "p", "m").agg(F.count("*").cast("double").alias("c"))
        useful = self.kept(sizes.groupBy("key", "m").agg(F.sum(F.col("c") * F.col("c")).alias("pairs")).where(F.col("pairs") <= CUT * F.col("m") * F.col("m")).select("key"), "join-useful")
        cells = held.join(useful, "key", "left_semi").where("node <> p").select(F.xxhash64("key", "p").alias("key"), "node", "n", "part", "d", "near")
        return self.kept(self.outside(cells).drop("near"), "join-cells"), regions.join(useful, "key", "left_anti")

    def blocks(self, regions: DataFrame, *columns: str) -> DataFrame:
        """``columns`` of ``regions(key, node, m, total, ..)`` with i and j: a small region is one block, members of a large one meet in twos of blocks.

        Where ``main`` is given, its members needn't meet each other: each is in one block, and the few others are in all.
        """
        count = F.when(_small(), 1).otherwise(F.greatest(F.ceil(2 * F.col("m") / LEAF), F.ceil(2 * F.col("total") / LEAF_SIZE)).cast("int"))
        mine = F.pmod(F.xxhash64("node"), F.col("k")).cast("int")
        meets = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct(F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j")))
        if "main" in regions.columns:
            own, each = F.array(F.struct(mine.alias("i"), mine.alias("j"))), F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct(j.alias("i"), j.alias("j")))
            meets = F.when(F.col("main").isNull(), meets).when(F.col("part") == F.col("main"), own).otherwise(each)
        return regions.withColumn("k", count).select(*columns, F.explode(meets).alias("c")).select(*columns, "c.i", "c.j")

    def dealt(self, regions: DataFrame) -> DataFrame:
        """(key, i, j, node) of ``regions(key, node, part, m, total)``: members that by their sketches may link with one of another part of their block."""
        told = self.blocks(regions, "key", "node", "part").join(self.sets.select("node", "n", "bits"), "node").select("key", "i", "j", "node", "part", "n", "bits")
        told = told.repartition(width(told.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
        return self.kept(told.mapInArrow(_possible(self.percent), "key long, i int, j int, node long"), "join-possible")

    def compared(self, regions: DataFrame) -> None:
        """Links within ``regions(key, node, part, m, total)``. Regions that share members are one, so that a set is moved once, unless they grow too large together."""
        possible = self.dealt(regions)
        if possible.isEmpty():
            return
        left = possible.join(self.sets.select("node", "n"), "node")
        if left.agg(F.sum("n")).first()[0] <= MERGE_SIZE:
            return self.linked(possible)
        firsts = left.groupBy("key", "i", "j").agg(F.min("node").alias("first"))
        group = connected_components(left.join(firsts, ["key", "i", "j"]).select(F.col("node").alias("u"), F.col("first").alias("v")))
        one = left.select("node", "n").distinct().join(group, "node").select(F.col("component").alias("key"), "node", "n")
        sizes = one.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
        few = one.join(sizes.where(F.col("m") <= MERGED * LEAF), "key")
        apart = left.join(few.select("node"), "node", "left_anti").select("key", "i", "j", "node")
        rows = self.kept(self.blocks(few, "key", "node").unionByName(apart), "join-leaves")
        release(*group._reads)
        self.linked(rows)

    def linked(self, rows: DataFrame) -> None:
        """Links of ``rows(key, i, j, node)``, a block being what one task compares."""
        near = self.beside(rows, "node").select("key", "i", "j", "node", "items")
        near = near.repartition(width(near.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
        self.links.append(self.kept(near.mapInArrow(_leaf(self.percent / 100), "u long, v long"), "join-links"))

    def found(self) -> DataFrame:
        out = self.links[0]
        for x in self.links[1:]:
            out = out.unionByName(x)
        return out

    def parted(self, regions: DataFrame, steps: int = 2) -> DataFrame:
        """``regions`` with ``part``, a node that each member is known to be connected with: the least within two steps, or of all. Regions of one part are done."""
        links, known = self.found(), None
        if steps == 2:
            both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
            once = self.kept(both.groupBy("u").agg(F.least("u", F.min("v")).alias("part")), "join-near")
            parts = once.join(once.select(F.col("u").alias("part"), F.col("part").alias("next")), "part").select(F.col("u").alias("node"), F.col("next").alias("part"))
        else:
            known = connected_components(links)
            parts = known.select("node", F.col("component").alias("part"))
        named = regions.drop("near", "m", "total", "part").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
        several = named.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("key")
        out = self.kept(_different(named.join(several, "key")), "join-parted")
        release(*(known._reads if known else ()))
        return out

    def told(self, regions: DataFrame) -> DataFrame:
        """``regions(key, node, n, part, m, total)`` with ``main``, the largest part of a region if few members are outside it, else null."""
        sizes = regions.groupBy("key", "part").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
        sizes = sizes.groupBy("key").agg(F.max_by("part", "c").alias("main"), (F.sum("c") - F.max("c")).alias("others"), (F.sum("s") - F.max_by("s", "c")).alias("size"))
        few = (F.col("others") <= LEAF // 2) & (F.col("size") <= LEAF_SIZE // 2)
        return self.kept(regions.join(sizes.select("key", F.when(few, F.col("main")).alias("main")), "key"), "join-told")

    def rarest(self, regions: DataFrame) -> DataFrame:
        """Large ``regions(key, node, ..)`` dealt anew, by the rarest shingles of their members: (key, node, n, m, total).

        Two linked sets share 0.85 of each one's shingles, so in any order of all shingles one of the first 0.15 of each; frequent ones, such as
        those of a common passage, come last. A region of texts that share nothing else thus falls apart without looking at its pairs.
        """
        nodes = self.kept(regions.select("node").distinct(), "join-crowded")
        members = self.beside(nodes, "node")
        drawn = members.where(F.pmod(F.xxhash64("node", F.lit(7)), F.lit(DRAWN)) == 0).select(F.explode("items").alias("x"))
        often = drawn.groupBy("x").agg(F.count("*").alias("c")).where(F.col("c") >= OFTEN).orderBy(F.desc("c"), "x").limit(FEW_ROWS).toArrow()
        values = often["x"].to_numpy().view(np.uint64)
        order = np.argsort(values)
        table = values[order], often["c"].to_numpy()[order]
        dealt = self.kept(members.select("node", "n", "items").mapInArrow(_rarest(table, self.percent), "key long, node long, n long"), "join-rarest")
        return self.kept(_different(dealt), "join-anew")

    def joined(self, regions: DataFrame) -> DataFrame:
        """All links that are needed for the components of ``regions(key, node, n, m, total)``."""
        large = regions.where(~_small())
        if not large.isEmpty():
            regions = regions.where(_small()).unionByName(self.rarest(large))
        few = self.dealt(regions.where(_small()).withColumn("part", F.col("node"))).select("key", "node").join(self.sets.select("node", "n"), "node")
        left, level = few.select("key", "node", "n").unionByName(regions.where(~_small()).select("key", "node", "n")), 0
        left = left.withColumn("near", F.lit(False))
        for _ in range(STARS):
            left = self.star(left)
            if left.isEmpty():
                return self.found()
        left = self.parted(left)
        while not left.isEmpty():
            self.compared(left.where(_small()))
            large = left.where(~_small())
            if large.isEmpty():
                break
            level += 1
            left, whole = self.cells(large, level)
            if not whole.isEmpty():  # its members were measured to many pivots: most are connected by now
                self.compared(self.told(self.parted(whole, steps=0)))
        return self.found()


def _small():
    return (F.col("m") <= 4) | ((F.col("m") <= LEAF) & (F.col("total") <= LEAF_SIZE))


def _regions(scanned: DataFrame) -> DataFrame:
    """(key, at) of ``scanned(at, keys)``: each place in a region that has another."""
    rows = scanned.where("keys is not null").select("at", F.explode("keys").alias("key"))
    often = rows.where(F.pmod(F.xxhash64("at"), F.lit(SAMPLE)) == 0).groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") >= HOT)
    hot = stored(often.select("key", F.lit(True).alias("hot")), "join-hot")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("at"), F.lit(SALTS))).otherwise(0)
    dealt = rows.join(hot, "key", "left").select("key", "at", F.coalesce("hot", F.lit(False)).alias("hot"), salt.alias("salt"))
    near = dealt.repartition(width(rows.sparkSession), "key", "salt").sortWithinPartitions("key", "at")
    out = stored(near.select("key", "at", "hot").mapInArrow(_meeting, "key long, at long"), "join-regions")
    release(hot)
    return out


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, n, items) of ``wanted(node, first, n, s1, s2)``: documents are read again, those with other ids are passed over."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << MAP_BITS))
    cells = wanted.select(bit("first").alias("b")).groupBy((F.col("b") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("bits"))
    found = cells.toArrow()
    bitmap = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    bitmap[found["w"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    read = docs.select(bit("doc_id").alias("b"), "text").mapInArrow(_chosen(bitmap, shingle), "n long, s1 long, s2 long, items array<long>, bits array<long>")
    return read.join(wanted.select("node", "n", "s1", "s2"), ["n", "s1", "s2"]).groupBy("node").agg(F.first("n").alias("n"), F.first("items").alias("items"), F.first("bits").alias("bits"))


def classes(docs: DataFrame, percent: int = 85, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    ``component_id`` is the least id that is reached over links, the row's own included: 100 * intersection >= percent * union of the sets of
    different shingles of ``shingle`` words, A-Z lower-cased, words being what ASCII white space separates. A text of fewer words is one
    shingle; one without words, or null, has none and links with nothing. Rows of equal sets are linked; rows that repeat an id are
    rows of their own with one id. A null id is no candidate for ``component_id``, which is null where a class has no other. Texts of any length are read
    whole. An empty table gives no rows; other columns are not read. ``percent`` is from 1 to 100. ``docs`` is read twice.
    """
    spark = docs.sparkSession
    importable(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    scanned = rows.mapInArrow(_scan(percent, shingle), "doc_id long, n long, s1 long, s2 long, keys array<long>")
    scanned = stored(scanned.withColumn("at", F.monotonically_increasing_id()), "join-scan")
    same = ["n", "s1", "s2"]
    nodes = stored(scanned.where("n > 0").groupBy(*same).agg(F.min("at").alias("node"), F.min("doc_id").alias("first")), "join-nodes")
    met = _regions(scanned)
    placed = met.join(scanned.select("at", *same), "at").join(nodes, same).select("key", "node", "n").distinct()
    regions = stored(_different(stored_placed := stored(placed, "join-placed")), "join-different")
    release(met, stored_placed)
    wanted = nodes.join(regions.select("node").distinct(), "node", "left_semi")
    sets = stored(_sets(rows, wanted, shingle), "join-sets")
    space = _Space(sets, percent)
    part = connected_components(space.joined(regions))
    release(regions, sets, *space.tables)
    least = nodes.join(part, "node").groupBy("component").agg(F.min("first").alias("least"))
    own = stored(part.join(least, "component").select("node", "least"), "join-classes")
    release(*part._reads)
    named = nodes.join(own, "node", "left").select(*same, F.when(F.col("least").isNotNull(), F.col("least")).otherwise(F.col("first")).alias("component_id"))
    return scanned.select("doc_id", *same).join(named, same, "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
