"""SimHash near-dedup with bit-sliced comparison.

A fingerprint is the bitwise majority of the XXH64 hashes of a text's word shingles.
Two fingerprints link when they differ in at most ``radius`` bits; classes are the
connected components of the links over all documents.

Candidates: fingerprints meet that agree on all bits of some mask. For a
small radius, the bits are cut into ``radius + KEEP`` blocks and the masks are all
choices of ``KEEP`` blocks: two fingerprints within the radius agree on at least ``KEEP``
blocks, so the search is exact. Only distinct fingerprints take part, so copies cost nothing.

Texts of a stated similarity are found by wide fingerprints (``WORDS`` words of 64 bits) of the set of their
five-word shingles: sets with Jaccard similarity J differ in a share acos(2J / (1 + J)) / pi of the bits on
average. The radius is three standard deviations more, the masks are random, as many as find a pair at that
distance with probability ``RECALL``. Fingerprints only bring texts together; the exact similarity of the shingles decides.

Comparison: within a partition the fingerprints, sorted by key, are stored as bit
planes, 64 fingerprints to a machine word. Fingerprint i meets fingerprint i+d by
shifting the planes by d; differing bits are counted for 64 pairs at once in
carry-save counters, and words in which all 64 pairs have exceeded the radius are
abandoned between groups of planes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import jaccard, words
from quarry.llm.graph import connected_components, stars
from quarry.llm.scratch import importable, release, stored, width

SEED = 42
KEEP = 3
WORDS, RECALL, BUCKET = 2, 0.999, 8
_FPS = [f"fp{i}" for i in range(WORDS)]
#: Fingerprints of one key that are compared in one piece; a larger key is cut into chunks
#: of about this size, and every two chunks meet, so the result does not depend on it.
CHUNK = 4096
_ONE = np.uint64(1)
_ALL = ~np.uint64(0)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Signed fingerprint of one text of 64 bits; no words give zero, fewer than a shingle give one shingle."""
    parts = words.encoded(text).split()
    if not parts:
        return 0
    grams = [b" ".join(g) for g in zip(*(parts[i:] for i in range(shingle)))] if len(parts) > shingle else [b" ".join(parts)]
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(grams), 65536):
        h = np.array([digest(g, SEED) for g in grams[at : at + 65536]], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(grams), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp0 long) for every row; whole texts, null as empty."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(x.as_py(), shingle) for x in b.column(1)], pa.int64())], names=["doc_id", "fp0"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp0 long")


def exact_masks(radius: int, bits: int = 64) -> list[int]:
    """Masks of which two fingerprints within the radius agree on at least one."""
    cuts = np.linspace(0, bits, radius + KEEP + 1).astype(int)
    blocks = [((1 << int(b - a)) - 1) << int(a) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(blocks, KEEP)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def planes_of(values: np.ndarray) -> np.ndarray:
    """(64 * words, lanes / 64) bit planes of (n, words) uint64 values; bit j of word w of a plane is value 64 w + j."""
    values = values.reshape(len(values), -1)
    n = -(-max(len(values), 1) // 64) * 64
    padded = np.zeros((n, values.shape[1]), np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def _shifted(row: np.ndarray, at: np.ndarray, d: int) -> np.ndarray:
    """Words ``at`` of a bit row moved down by d lanes."""
    q, r = divmod(d, 64)
    low = row[np.minimum(at + q, len(row) - 1)]
    if not r:
        return low
    high = row[np.minimum(at + q + 1, len(row) - 1)]
    return (low >> np.uint64(r)) | (high << np.uint64(64 - r))


def _exceeds(count: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose vertical count is above ``radius``."""
    more, same = np.zeros_like(over), ~np.zeros_like(over)
    for i in reversed(range(len(count))):
        if radius >> i & 1:
            same &= count[i]
        else:
            more |= same & count[i]
            same &= ~count[i]
    return over | more


def within(planes: np.ndarray, lanes: np.ndarray, at: np.ndarray, d: int, radius: int) -> np.ndarray:
    """Of ``lanes`` (words at ``at``), those whose fingerprint is within ``radius`` bits of the one d places on."""
    alive, out, left = np.arange(len(at)), np.zeros(len(at), np.uint64), lanes.copy()
    over = np.zeros(len(at), np.uint64)
    count = [over] * max(1, radius.bit_length())
    for start in range(0, len(planes), 16):
        here = at[alive]
        for p in range(start, start + 16, 2):
            x = planes[p][here] ^ _shifted(planes[p], here, d)
            y = planes[p + 1][here] ^ _shifted(planes[p + 1], here, d)
            half = count[0] ^ x  # carry-save: count[0] + x + y = count[0]' + 2 * carry
            carry = (count[0] & x) | (half & y)
            count[0] = half ^ y
            for i in range(1, len(count)):
                count[i], carry = count[i] ^ carry, count[i] & carry
            over = over | carry
        left &= ~_exceeds(count, over, radius)
        stay = np.flatnonzero(left)
        if len(stay) < len(left):
            alive, left, over, count = alive[stay], left[stay], over[stay], [c[stay] for c in count]
        if not len(alive):
            return out
    out[alive] = left
    return out


def _lanes(word: np.ndarray, at: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(np.ascontiguousarray(word).view(np.uint8).reshape(len(word), 8), axis=1, bitorder="little")
    w, j = np.nonzero(bits)
    return at[w] * 64 + j


def linked(keys: list[np.ndarray], values: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Edges (as places) that span, within each run of equal keys, the components of values within the radius.

    Every pair of a run is compared; of the pairs that link only those are returned
    that join two parts not yet joined, so a run of n gives fewer than n edges.
    """
    n = len(values)
    if n < 2:
        return [], []
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(new)
    ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    room = ends - np.arange(n)  # lanes i with room > d have a partner at distance d
    planes, label = planes_of(values), np.arange(n)
    us, vs = [], []
    lane = np.arange(n)
    for d in range(1, int(room.max())):
        lane = lane[room[lane] > d]
        mask = np.zeros(planes.shape[1], np.uint64)
        np.bitwise_or.at(mask, lane >> 6, _ONE << (lane & 63).astype(np.uint64))
        at = np.flatnonzero(mask)
        i = _lanes(within(planes, mask[at], at, d, radius), at)
        i = i[label[i] != label[i + d]]
        if not len(i):
            continue
        for a in i.tolist():
            x, y = a, a + d
            while label[x] != x:
                x = label[x]
            while label[y] != y:
                y = label[y]
            if x != y:
                label[max(x, y)] = min(x, y)
                us.append(a)
                vs.append(a + d)
        while (label != (up := label[label])).any():
            label = up
    return us, vs


def _search(radius: int, keys: int):
    """Edges of batches sorted by their first ``keys`` columns, which a node and its fingerprint follow."""

    def edges(cols: list[np.ndarray]) -> pa.RecordBatch:
        u, v = linked(cols[:keys], np.stack(cols[keys + 1 :], axis=1).view(np.uint64), radius)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in stars(cols[keys][u], cols[keys][v])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for b in batches:
            held.append([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns])
            size += b.num_rows
            if size < 65536:
                continue
            cols = [np.concatenate(c) for c in zip(*held)]
            other = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in cols[:keys]]))
            cut = int(other[-1]) + 1 if len(other) else 0  # the last run may go on in the next batch
            if cut:
                yield edges([c[:cut] for c in cols])
            held, size = [[c[cut:] for c in cols]], len(cols[0]) - cut
        if size:
            yield edges([np.concatenate(c) for c in zip(*held)])

    return run


def links(nodes: DataFrame, radius: int = 3, masks: list[int] | None = None) -> DataFrame:
    """Edges (u, v) that span all links between ``nodes(node, fp0, fp1, ...)`` within ``radius`` bits.

    Without ``masks`` the search is exact; given masks find the pairs that agree on all bits of one of them.
    """
    spark = nodes.sparkSession
    importable(spark)
    names = [c for c in nodes.columns if c != "node"]
    parts = [[m >> (64 * w) & (2**64 - 1) for w in range(len(names))] for m in masks or exact_masks(radius, 64 * len(names))]
    table = F.array(*[F.struct(F.lit(i).alias("t"), *[F.lit(_signed(x)).alias(n) for n, x in zip(names, p)]) for i, p in enumerate(parts)])
    keys = F.transform(table, lambda m: F.xxhash64(m["t"], *[F.col(n).bitwiseAND(m[n]) for n in names]))
    keyed = nodes.select(F.explode(keys).alias("key"), "node", *names)
    crowded = stored(keyed.groupBy("key").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("m")).where("m > 1"), "simhash-crowded")
    if crowded.isEmpty():
        release(crowded)
        dealt = keyed
    else:
        met = keyed.join(crowded, "key", "left").withColumn("m", F.coalesce("m", F.lit(1)))
        mine = F.pmod(F.xxhash64("node"), F.col("m")).cast("int")
        meets = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda j: F.struct(F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j")))
        dealt = met.select("key", F.explode(meets).alias("c"), "node", *names).select("key", "c.i", "c.j", "node", *names)
    by = [c for c in dealt.columns if c in ("key", "i", "j")]
    near = dealt.repartition(width(spark), *by).sortWithinPartitions(*by)
    return near.mapInArrow(_search(radius, len(by)), "u long, v long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp0, component_id) for every row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links, the row's own included; the search is exact.
    Null texts are empty; texts without words have fingerprint 0 and link like others. Texts of any length are read whole.
    Rows with a null doc_id take part; they never give a component its id unless all its
    ids are null, when it is null. Repeated rows fall into one class, so ties cannot matter. Other columns are
    not read, whatever their names. An empty table gives no rows.
    """
    prints = stored(fingerprints(docs, id_col, text_col, shingle), "simhash")
    nodes = stored(prints.groupBy("fp0").agg(F.min("doc_id").alias("first")).select(F.col("fp0").alias("node"), "first"), "simhash-nodes")
    part = connected_components(links(nodes.select("node", F.col("node").alias("fp0")), radius))
    named = nodes.select("node", "first").join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    by_node = stored(named.join(least, "component").select(F.col("node").alias("fp0"), "component_id"), "simhash-classes")
    release(nodes, *part._reads)
    return prints.join(by_node, "fp0").select("doc_id", "fp0", "component_id")


# Similar texts: wide fingerprints find the candidates, the exact similarity decides.


def wide(grams: np.ndarray) -> np.ndarray:
    """Fingerprint of ``WORDS`` words of 64 bits of a set of shingle hashes."""
    total = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(grams), 16384):
        h = np.empty((len(grams[at : at + 16384]), WORDS), "<u8")
        h[:, 0] = grams[at : at + 16384]
        for w in range(1, WORDS):
            h[:, w] = words.mixed((h[:, w - 1] + np.uint64(w)) * np.uint64(words.BASES[1]))
        total += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * total > len(grams), bitorder="little").view("<i8")


def distance(similar: float) -> float:
    """Share of the bits in which two sets of this Jaccard similarity differ on average."""
    return math.acos(2 * similar / (1 + similar)) / math.pi


def radius_of(similar: float) -> int:
    """Bits that all but one in a thousand pairs of this similarity stay within."""
    bits, p = 64 * WORDS, distance(similar)
    return math.ceil(bits * p + 3 * math.sqrt(bits * p * (1 - p)))


def wide_masks(similar: float, n: int) -> list[int]:
    """Random masks that find a pair at the average distance with probability ``RECALL``.

    Of n fingerprints a mask brings together some ``BUCKET`` by chance, so its bits grow with log2(n).
    """
    key_bits = max(16, math.ceil(math.log2(max(n, 1) / BUCKET)))
    met = (1 - distance(similar)) ** key_bits
    rng = np.random.default_rng(SEED)
    picks = (rng.choice(64 * WORDS, key_bits, replace=False) for _ in range(math.ceil(math.log(1 - RECALL) / math.log(1 - met))))
    return [sum(1 << int(b) for b in p) for p in picks]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, node, fp0, fp1, size, body) of rows (doc_id, key, text)."""
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            bodies = [b" ".join(words.encoded(text.as_py()).split()) for text in part.column(2)]
            prints = [wide(words.shingles(words.of(x), jaccard.SHINGLE)) for x in bodies]
            cols = [part.column(0), part.column(1), pa.array([xxhash.xxh3_128_digest(x) for x in bodies], pa.binary()), *(pa.array(c) for c in np.array(prints, np.int64).T)]
            cols += [pa.array([len(x) for x in bodies], pa.int64()), pa.array(bodies, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "node", *_FPS, "size", "body"])


def _between(rows: DataFrame, near: DataFrame) -> DataFrame:
    """``near``, edges between the first ids of fingerprints, and edges from the other ids of a fingerprint to its first."""
    first = rows.groupBy(*_FPS).agg(F.min("id").alias("v"), F.count("*").alias("n")).where("n > 1").drop("n")
    return near.unionByName(rows.select("id", *_FPS).join(first, _FPS).where("id <> v").select(F.col("id").alias("u"), "v"))


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = jaccard.SIMILAR) -> DataFrame:
    """(doc_id, key, component_id) for every row of ``docs``; ``key`` is the XXH64 of the text.

    Texts link when the Jaccard similarity of their five-word shingles is at least ``similar``. Candidates are texts in one component
    of fingerprints within ``radius_of``; among them every pair's exact similarity is counted. Classes are the components of the links.
    ``component_id`` is the smallest doc_id of the class, null if all its ids are. Null texts are empty; texts
    without words are one class. Repeated rows fall into one class. Texts of any length are read whole. Other columns are not read. An empty table gives no rows.
    """
    importable(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    schema = ", ".join(["doc_id long, key long, node binary", *(f"{n} long" for n in _FPS), "size long, body string"])
    found = stored(rows.mapInArrow(_texts, schema).withColumn("id", F.monotonically_increasing_id()), "near-texts")
    prints = stored(found.groupBy(*_FPS).agg(F.min("id").alias("node")), "near-prints")
    near = links(prints, radius_of(similar), wide_masks(similar, prints.count()))
    part = jaccard.classes(found.select("id", "node", "size", "body"), _between(found, near), similar)
    release(prints)
    named = found.select("id", "doc_id", "key").join(part, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = named.join(least, "component").select("doc_id", "key", "component_id")
    out._reads = [found, *part._reads]
    return out


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = jaccard.SIMILAR) -> DataFrame:
    """The rows of ``docs`` that stay: of each class of ``similar_classes`` the one with the smallest doc_id.

    A class whose ids are all null keeps all its rows; rows that repeat the smallest id of their class
    all stay. Each row is known by id and text and judged by its own class, whatever other rows have its id. Null and empty texts are one class.
    """
    found = similar_classes(docs, id_col, text_col, similar)
    other = found.where(F.col("component_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id")))
    dropped = stored(other.select(F.col("doc_id").alias("_dropped"), F.col("key").alias("_key")).distinct(), "near-dropped")
    release(*found._reads)
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("_dropped")) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col("_key"))
    return docs.join(dropped, same, "left_anti")
