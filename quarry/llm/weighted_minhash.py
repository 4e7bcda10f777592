"""Document fingerprints by consistent weighted sampling.

A document is its words with their counts as weights. For each sample k and word, hashes
give r and c of a Gamma(2, 1) distribution and b uniform on [0, 1); a word of weight w has

    t = floor(ln w / r + b),    ln a = ln c - r (t + 1 - b)

and the sample is the (word, t) of the least a (Ioffe, 2010). Two documents share a
sample with the probability of their generalised Jaccard similarity, the sum of the
smaller over the sum of the larger weights. As a depends on the word and t alone, the
least a itself tells (word, t); sixteen bits of its hash are kept for each sample.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.scratch import importable, width

SAMPLES = 128
#: Rows of ln a that a worker keeps; forgetting them changes no result.
MEMO = 150_000
_FIRST = -(2**63)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray, part: int) -> np.ndarray:
    """One of three parts of 21 bits as float32 in (0, 1)."""
    low = ((x >> np.uint64(21 * part)) & np.uint64(2**21 - 1)).astype(np.uint32).view(np.int32)
    return (low.astype(np.float32) + np.float32(0.5)) * np.float32(2**-21)


def log_a(terms: np.ndarray, weights: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """(n, samples) float32 of ln a for hashed terms and their weights."""
    k = _mix(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = _mix(terms.astype(np.uint64)[:, None] ^ k)
    y = _mix(x + np.uint64(0x9E3779B97F4A7C15))
    r = -np.log(_uniform(x, 0) * _uniform(x, 1))  # -ln of a product of two uniforms is Gamma(2, 1)
    log_c = np.log(-np.log(_uniform(y, 0) * _uniform(y, 1)))
    b = _uniform(x, 2)
    some = np.flatnonzero(weights > 1)
    t = np.zeros_like(r)  # floor(0 / r + b) is 0
    t[some] = np.floor(np.log(weights[some].astype(np.float32))[:, None] / r[some] + b[some])
    return log_c - r * (t + np.float32(1) - b)


class Sampler:
    """Fingerprints of texts as rows of uint16; keeps ln a of words met before."""

    def __init__(self, samples: int = SAMPLES):
        self.samples = samples
        self._rows = np.empty((0, samples), np.float32)
        self._at: dict[tuple[bytes, int], int] = {}

    def _places(self, keys: list[tuple[bytes, int]]) -> np.ndarray:
        """Rows of different (word, weight) keys; those not kept are made."""
        at = self._at
        places = np.fromiter(map(at.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(places < 0)
        if not len(new):
            return places
        if len(at) + len(new) > MEMO:
            at.clear()
            new = np.arange(len(keys))
        start, stop = len(at), len(at) + len(new)
        if stop > len(self._rows):
            grown = np.empty((max(stop, min(2 * len(self._rows), MEMO)), self.samples), np.float32)
            grown[:start] = self._rows[:start]
            self._rows = grown
        made = [keys[i] for i in new.tolist()]
        terms = np.fromiter((xxhash.xxh64_intdigest(w) for w, _ in made), np.uint64, len(made))
        weights = np.fromiter((c for _, c in made), np.float64, len(made))
        for i in range(0, len(made), 512):
            self._rows[start + i : min(start + i + 512, stop)] = log_a(terms[i : i + 512], weights[i : i + 512], self.samples)
        at.update(zip(made, range(start, stop)))
        places[new] = np.arange(start, stop)
        return places

    def _least(self, terms: list[tuple[bytes, int]]) -> np.ndarray:
        least = None
        for i in range(0, len(terms), 16384):
            places = self._places(terms[i : i + 16384])
            found = self._rows[places].min(axis=0)
            least = found if least is None else np.minimum(least, found)
        return least

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.samples), np.uint16)
        for i, text in enumerate(texts):
            terms = list(Counter(text.encode("utf-8", "replace").lower().split()).items())
            if terms:
                bits = self._least(terms).view(np.uint32).astype(np.uint64)
                out[i] = (_mix(bits) >> np.uint64(48)).astype(np.uint16)
        return out


_SAMPLERS: dict[int, Sampler] = {}


def sampler(samples: int = SAMPLES) -> Sampler:
    """The worker's sampler, kept across tasks."""
    return _SAMPLERS.setdefault(samples, Sampler(samples))


def _hex(rows: np.ndarray) -> list[str]:
    return [r.astype(">u2").tobytes().hex() for r in rows]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(doc_id, fingerprint): four hex digits a sample, for every row; whole texts.

    A null text is empty; texts without words have all zeros. Equal texts have equal
    fingerprints. Null and repeated ids pass through, other columns are not read, an empty table gives no rows.
    """
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                made = _hex(sampler(samples)([x or "" for x in part.column(1).to_pylist()]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def likeness(a: str, b: str) -> float:
    """Share of equal samples of two fingerprints: an estimate of the generalised Jaccard similarity."""
    x, y = (np.frombuffer(bytes.fromhex(f), np.uint16) for f in (a, b))
    return float((x == y).mean())


def edited(text: str, following: str) -> str:
    """``text`` with the last half of its code points replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _ranged(docs: DataFrame, ranges: int) -> DataFrame:
    """``docs(doc_id, text)`` with its range, and for each range the row that follows it.

    Ranges are quantiles of the id. The first row of a range is added to the range before it
    (that of the first to the last) as one that only follows; so a range needs nothing of another one.
    """
    from pyspark.ml.feature import Bucketizer

    keyed = docs.withColumn("key", F.coalesce("doc_id", F.lit(_FIRST))).withColumn("place", F.col("key").cast("double"))
    cuts = sorted(set(keyed.approxQuantile("place", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)))) if ranges > 1 else []
    if cuts:
        split = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="place", outputCol="range")
        keyed = split.transform(keyed).withColumn("part", F.col("range").cast("int")).drop("place", "range")
    else:
        keyed = keyed.withColumn("part", F.lit(0)).drop("place")
    heads = sorted(keyed.groupBy("part").agg(F.min("key").alias("key")).collect())  # one row a range
    before = [(h["key"], heads[i - 1]["part"]) for i, h in enumerate(heads)]
    first = F.broadcast(docs.sparkSession.createDataFrame(before, "key long, part int"))
    follow = keyed.drop("part").join(first, "key").groupBy("key", "part").agg(F.min("text").alias("text"))
    rows = keyed.select("part", F.lit(0).alias("after"), "key", "doc_id", "text")
    return rows.unionByName(follow.select("part", F.lit(1).alias("after"), "key", F.lit(None).cast("long").alias("doc_id"), "text"))


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Each text's fingerprint next to that of its edited text and of the text that follows it.

    Columns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The
    next row is that of the next id (null ids come first, equal ids go by text); after the
    last comes the first. Null texts are empty. An empty table gives no rows. Texts travel
    once, to the range of their id; no range holds more rows than its share, unless one id repeats.
    """
    spark = docs.sparkSession
    importable(spark)
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = _ranged(own, 4 * width(spark)).repartition(width(spark), "part").sortWithinPartitions("part", "after", "key", "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def made(part: list[tuple]) -> pa.RecordBatch:
        """Of rows in order, all but the last, which only follows."""
        find = sampler(samples)
        texts = [r[2] for r in part]
        changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
        of, of_changed = find(texts), find(changed)
        cols = [
            pa.array([r[1] for r in part[:-1]], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in changed], pa.string()),
            pa.array(_hex(of[:-1]), pa.string()), pa.array(_hex(of_changed), pa.string()),
            pa.array((of[:-1] == of_changed).mean(axis=1)), pa.array((of[:-1] == of[1:]).mean(axis=1)),
        ]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (part, doc_id, text), the last one not yet done
        for b in batches:
            for part, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if held and held[-1][0] != part:
                    if len(held) > 1:
                        yield made(held)
                    held = []
                held.append((part, doc_id, text.as_py()))
                if len(held) > 256:
                    yield made(held)
                    held = held[-1:]
        if len(held) > 1:
            yield made(held)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.select("part", "doc_id", "text").mapInArrow(run, schema)
