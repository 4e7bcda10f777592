"""Toxicity by class-conditional Kneser-Ney models over bytes.

Two interpolated Kneser-Ney models of order six, one of the toxic and one of the
ordinary labelled texts. Each has counts of its own down to order three, continuation counts
below the top; below that both share the continuation counts of all texts:

    P_k(w | h5) = max(c_k(h5 w) - D(c), 0) / c_k(h5) + left_k(h5) * P_k(w | h4), and so on
    P_k(w | h1) = P(w | h1): the same on continuation counts of both classes; P(w) likewise

The discounts depend on the count (one, two, more) and come from each class's counts
of counts, so an expression that one text happens to use says little: what a class has seen
once it mostly takes from the shared counts, as does the class that has not seen it.

What a text needs of the two models is the log ratio at each byte. For a six-gram of the labelled texts it is one number; an
expression that they don't have backs off class by class: the ratio of what both classes leave to shorter histories, plus the ratio of the five-gram, and
so on down to order three, below which the classes share all. All labelled texts of the training folds are counted, and
the ratios of all their n-grams and histories are kept, exactly, in a table that grows with their number.

Executors score with tables of at most ``SLICE`` entries (twelve bytes each), which bounds what is broadcast and what
the driver holds. A larger table is cut by the two bytes before the last, which all entries that one byte of a text asks for
agree on; each slice is broadcast in turn, and a pass over the texts adds its ratios to those of the slices before, kept in the shared folder.

A document is compared by length-normalised ratios: of the whole text, of windows
of ``WINDOW`` bytes and of single words, since a long text may be abusive in one place. A
logistic function of these, fitted on the fold that the counts leave out, gives the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quarry.llm.labels import fold, truth
from quarry.llm.scratch import importable, release, stored

ORDER = 6
DISCOUNT = 0.75
WINDOW = 64
#: Entries of a table that is broadcast, at most.
SLICE = 1 << 24
#: Rows of the calibration fold that the logistic function is fitted on, at most.
CALIBRATION_ROWS = 20_000
_PAD = b"\x00" * (ORDER - 1)
_SPACES = re.compile(r"\s+")
_CHUNK = 1 << 21
FEATURES = 10
#: The feature that is the length-normalised ratio of the whole text.
_MEAN = 7
_NAMES = [f"x{i}" for i in range(FEATURES)]
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOW = {n: (1 << (8 * n)) - 1 for n in range(1, ORDER + 1)}


def _bytes(text: str | None) -> bytes:
    return _SPACES.sub(" ", text or "").lower().encode("utf-8", "replace")


def grams(body: bytes) -> np.ndarray:
    """The six bytes that end at each byte after the padding, as integers."""
    b = np.frombuffer(_PAD + body, np.uint8)
    n = len(b) - ORDER + 1
    out = np.zeros(n, np.uint64)
    for i in range(ORDER):
        out = (out << np.uint64(8)) | b[i : i + n]
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct six-grams of each few megabytes of text, with counts by class."""

    def of(parts: dict[int, list[bytes]]) -> pa.RecordBatch:
        gs, cs = [], []
        for label, texts in parts.items():
            # The padding between two texts separates them; what ends in it is not counted.
            g = grams(_PAD.join(texts))
            g, c = np.unique(g[(g & np.uint64(255)) != 0], return_counts=True)
            gs.append(g.astype(np.int64))
            cs.append(np.stack([c if label else 0 * c, 0 * c if label else c]))
        c = np.concatenate(cs, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(gs)), pa.array(c[0]), pa.array(c[1])], names=["g", "ct", "co"])

    held: dict[int, list[bytes]] = {}
    size = 0
    for b in batches:
        for text, label in zip(b.column(0), b.column(1).to_pylist()):
            body = _bytes(text.as_py())
            held.setdefault(label, []).append(body)
            size += len(body)
            if size > 4 * _CHUNK:
                yield of(held)
                held, size = {}, 0
    if held:
        yield of(held)


def counts(rows: DataFrame) -> DataFrame:
    """(g, ct, co): every distinct six-gram of ``rows(text, label)`` with its toxic and ordinary counts."""
    found = rows.select("text", "label").mapInArrow(_count, "g long, ct long, co long")
    return found.groupBy("g").agg(F.sum("ct").alias("ct"), F.sum("co").alias("co"))


def _level(table: DataFrame, name: str) -> tuple[DataFrame, dict[str, tuple[float, float, float]], tuple[int, int]]:
    """``table(g, ct, co)`` stored, what is taken from counts of one, two and more in each class, by the counts of counts (Chen and Goodman, 1998), and the counts' sums."""
    seen = Observation()
    kinds = [F.count_if(F.col(c) == i).alias(f"{c}{i}") for c in ("ct", "co") for i in (1, 2, 3, 4)]
    kept = stored(table.observe(seen, *kinds, F.sum("ct").alias("all_ct"), F.sum("co").alias("all_co")), name)
    counted, out = seen.get, {}
    for c in ("ct", "co"):
        n1, n2, n3, n4 = (counted[f"{c}{i}"] for i in (1, 2, 3, 4))
        if n1 and n2 and n3:
            y = n1 / (n1 + 2 * n2)
            out[c] = tuple(min(max(d, 0.1), i - 0.02) for i, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))
        else:
            out[c] = (DISCOUNT,) * 3
    return kept, out, (counted["all_ct"] or 0, counted["all_co"] or 0)


def _low(n: int) -> Column:
    return F.col("g").bitwiseAND(F.lit(_LOW[n]))


def _shared(ends: DataFrame, lower: DataFrame) -> DataFrame:
    """(g, p) of seen pairs ``ends(g, c)``: discounted, plus the share left times ``lower(k, p)``."""
    stats = ends.withColumn("h", F.shiftright("g", 8)).groupBy("h").agg(F.sum("c").alias("all"), F.count("*").alias("kinds"))
    joined = ends.withColumn("h", F.shiftright("g", 8)).withColumn("k", _low(1)).join(stats, "h").join(lower, "k")
    return joined.select("g", (F.greatest(F.col("c") - DISCOUNT, F.lit(0.0)) / F.col("all") + DISCOUNT * F.col("kinds") / F.col("all") * F.col("p")).alias("p"))


def _own(ends: DataFrame, cut: dict, n: int, lower: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, pt, po) of n-grams ``ends(g, ct, co)``, each class's probabilities over those of ``lower(k, pt, po)``, and (h, left_ct, left_co), the shares that histories leave to it."""
    less = lambda c: F.when(F.col(c) == 0, 0.0).when(F.col(c) == 1, cut[c][0]).when(F.col(c) == 2, cut[c][1]).otherwise(cut[c][2])
    marked = ends.withColumn("h", F.shiftright("g", 8))
    sums = marked.groupBy("h").agg(*[f.alias(a) for c in ("ct", "co") for f, a in ((F.sum(c), f"all_{c}"), (F.sum(less(c)), f"left_{c}"))])
    share = [F.when(F.col(f"all_{c}") > 0, F.col(f"left_{c}") / F.col(f"all_{c}")).otherwise(1.0).alias(f"left_{c}") for c in ("ct", "co")]
    stats = stored(sums.select("h", "all_ct", "all_co", *share), "toxicity-histories")
    joined = marked.withColumn("k", _low(n - 1)).join(stats, "h").join(lower, "k")
    of = lambda c, p: F.when(F.col(f"all_{c}") > 0, (F.col(c) - less(c)) / F.col(f"all_{c}") + F.col(f"left_{c}") * F.col(p)).otherwise(F.col(p))
    return stored(joined.select("g", of("ct", "pt").alias("pt"), of("co", "po").alias("po")), "toxicity-grams"), stats


def _entries(n: int, of: Column, value: Column, pair: Column) -> list[Column]:
    """A table entry: what it is of, tagged by its order, the value, and the two bytes before the byte that it is for."""
    return [of.bitwiseOR(F.lit(n << 48)).alias("g"), value.cast("float").alias("r"), pair.alias("pair")]


def ratios(table: DataFrame, cut: dict) -> list[DataFrame]:
    """From the level of six-grams: tables (g, r, pair) of the log ratios of n-grams (order in the bits from 48 on) and of what histories leave (order + 8)."""
    levels, cuts = {ORDER: table}, {ORDER: cut}
    for n in range(ORDER - 1, 2, -1):
        fewer = levels[n + 1].groupBy(_low(n).alias("g")).agg(F.count_if(F.col("ct") > 0).alias("ct"), F.count_if(F.col("co") > 0).alias("co"))
        levels[n], cuts[n], _ = _level(fewer, "toxicity-level")
    twos = levels[3].groupBy(_low(2).alias("g")).agg(F.count("*").alias("c"))
    ones = twos.groupBy(_low(1).alias("k")).agg(F.count("*").alias("c"))
    total = ones.agg(F.sum("c").alias("all"))
    single = F.broadcast(ones.crossJoin(F.broadcast(total)).select("k", ((F.col("c") + 0.5) / (F.col("all") + 128)).alias("p")))  # 256 rows at most
    found = stored(_shared(twos, single).select(F.col("g").alias("k"), F.col("p").alias("pt"), F.col("p").alias("po")), "toxicity-shared")
    out, lower = [], found
    for n in range(3, ORDER + 1):
        made, left = _own(levels[n], cuts[n], n, lower)
        out.append(made.select(*_entries(n, F.col("g"), F.log("pt") - F.log("po"), F.shiftright("g", 8).bitwiseAND(F.lit(0xFFFF)))))
        out.append(left.select(*_entries(n + 8, F.col("h"), F.log("left_ct") - F.log("left_co"), F.col("h").bitwiseAND(F.lit(0xFFFF)))))
        out[-2]._reads, out[-1]._reads = [made], [left]
        lower = made.select(F.col("g").alias("k"), "pt", "po")
    release(found, *(levels[n] for n in range(3, ORDER)))
    return out


class Grams:
    """Value by key, exact for every key of the table; as large as the number of keys asks for.

    An odd factor permutes the 52 bits of a key. The top bits of the product are its slot; keys of a slot lie together and are
    told apart by the other bits, at most 32.
    """

    BITS = 52

    def __init__(self, g: np.ndarray, r: np.ndarray):
        self.rest_bits = self.BITS - min(max(len(g).bit_length() + 1, 20), 30)
        mixed = self._mixed(g)
        order = np.argsort(mixed)
        slots, self.rest = self._cut(mixed[order])
        self.start = np.concatenate([[0], np.cumsum(np.bincount(slots, minlength=1 << (self.BITS - self.rest_bits)))]).astype(np.uint32)
        self.r = r[order].astype(np.float32)

    def _mixed(self, g: np.ndarray) -> np.ndarray:
        return (g * _ODD) & np.uint64((1 << self.BITS) - 1)

    def _cut(self, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (mixed >> np.uint64(self.rest_bits)).astype(np.int64), (mixed & np.uint64((1 << self.rest_bits) - 1)).astype(np.uint32)

    def of(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, 0 where there is none, and the places without."""
        slot, rest = self._cut(self._mixed(g))
        at, end = self.start[slot].astype(np.int64), self.start[slot + 1]
        out, none, left = np.zeros(len(g), np.float32), np.ones(len(g), bool), np.flatnonzero(at < end)
        while len(left):
            hit = self.rest[at[left]] == rest[left]
            out[left[hit]] = self.r[at[left[hit]]]
            none[left[hit]] = False
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out, np.flatnonzero(none)

    def ratios(self, g: np.ndarray) -> np.ndarray:
        """Log ratios of the last bytes of six-grams, backing off where an n-gram is unknown."""
        out, left = np.zeros(len(g), np.float32), np.arange(len(g))
        for n in range(ORDER, 2, -1):
            own = g[left] & np.uint64(_LOW[n])
            found, none = self.of(own | np.uint64(n << 48))
            out[left] += found
            left = left[none]
            if not len(left):
                break
            out[left] += self.of((own[none] >> np.uint64(8)) | np.uint64((n + 8) << 48))[0]
        return out


def _slice_of(pair: np.ndarray | Column, slices: int) -> np.ndarray | Column:
    """The slice of two bytes."""
    return (pair * 40503 % 65521) % slices


class Slices:
    """The table of ``ratios`` in slices of at most about ``SLICE`` entries, one of which is on the driver at a time."""

    def __init__(self, tables: list[DataFrame]):
        self._tables = tables
        self.spark = tables[0].sparkSession
        self.count = max(1, -(-sum(t.count() for t in tables) // SLICE))
        self._whole = self._gathered(0) if self.count == 1 else None

    def _gathered(self, k: int) -> Grams:
        rows = reduce(DataFrame.unionByName, self._tables)
        if self.count > 1:
            rows = rows.where(_slice_of(F.col("pair"), self.count) == k)
        found = rows.select("g", "r").toArrow()
        return Grams(found["g"].to_numpy().astype(np.int64).view(np.uint64), found["r"].to_numpy())

    def release(self) -> None:
        release(*(x for t in self._tables for x in t._reads))

    def added(self, rows: DataFrame, text_col: str) -> tuple[DataFrame, object]:
        """``rows`` with ``_r``, the ratios of all bytes as floats if there are several slices, else null; and the broadcast table of a single slice."""
        if self.count == 1:
            return rows.withColumn("_r", F.lit(None).cast("binary")), self.spark.sparkContext.broadcast(self._whole)
        place, slices = rows.columns.index(text_col), self.count
        now = rows.withColumn("_r", F.lit(None).cast("binary"))
        for k in range(slices):
            sent = self.spark.sparkContext.broadcast(self._gathered(k))

            def run(batches: Iterator[pa.RecordBatch], sent=sent, k=k) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for at in range(0, b.num_rows, 64):
                        part = b.slice(at, 64)
                        made = []
                        for text, before in zip(part.column(place), part.column(part.num_columns - 1)):
                            g = grams(_bytes(text.as_py()))
                            r = np.frombuffer(before.as_py(), np.float32).copy() if before.is_valid else np.zeros(len(g), np.float32)
                            mine = np.flatnonzero(_slice_of(((g >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int64), slices) == k)
                            r[mine] = sent.value.ratios(g[mine])
                            made.append(r.tobytes())
                        yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(made, pa.binary())], names=part.schema.names)

            later = stored(now.mapInArrow(run, now.schema), "toxicity-pass")
            sent.unpersist()
            if k:
                release(now)
            now = later
        return now, None


def features(texts: list[str | None], table: Grams | None, known: list[bytes | None]) -> np.ndarray:
    """Length-normalised log ratios of whole texts and of their strongest windows and words, and the log length; ratios come from the table or are known."""
    out = np.zeros((len(texts), FEATURES))
    start = 0
    while start < len(texts):
        bodies, size, stop = [], 0, start
        while stop < len(texts) and (size < _CHUNK or not bodies):
            bodies.append(_bytes(texts[stop]))
            size += len(bodies[-1])
            stop += 1
        r = table.ratios(grams(_PAD.join(bodies))) if table is not None else None
        at = 0
        for i, body in enumerate(bodies):
            n = len(body)
            if n:
                own = r[at : at + n] if r is not None else np.frombuffer(known[start + i], np.float32)
                # Sums start anew in each text, so equal texts have equal scores.
                total = np.concatenate([[0.0], np.cumsum(own, dtype=np.float64)])
                cuts = np.arange(0, n, WINDOW // 2)
                cuts = np.minimum(np.stack([cuts, cuts + WINDOW]), n)
                window = np.sort(total[cuts[1]] - total[cuts[0]])[: -9 : -1] / WINDOW
                # A word reaches to the space after it; short words are not overrated.
                ends = np.append(np.flatnonzero(np.frombuffer(body, np.uint8) == 32) + 1, n)
                starts = np.append(0, ends[:-1])
                word = np.sort((total[ends] - total[starts]) / (ends - starts + 4.0))[: -9 : -1]
                window, word = (np.pad(x, (0, 8 - len(x))) for x in (window, word))
                out[start + i, :-1] = *word[[0, 1, 3, 7]], *window[[0, 2, 7]], total[n] / n, np.log1p(n)
            out[start + i, -1] = 1.0
            at += n + ORDER - 1
        start = stop
    return out


@dataclass
class Model:
    """The weights of the logistic function, none if there was nothing to learn from, and the share of toxic texts, which is then the score, as it is for a text without any words."""

    weights: np.ndarray | None
    prior: float

    def scores(self, texts: list[str | None], table: Grams | None, known: list[bytes | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        found = 1 / (1 + np.exp(-np.clip(features(texts, table, known) @ self.weights, -30, 30)))
        return np.where([not (t and t.strip()) for t in texts], self.prior, found)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(rows: DataFrame) -> tuple[Model, Slices | None]:
    """A model of ``rows(text, label, fold)`` and its table; folds 1 to 3 are counted, fold 4 calibrates, others are not used.

    Without labelled rows of both classes in the counted part there is nothing to compare: the score is then the
    smoothed share of toxic rows. If fold 4 lacks a class, the length-normalised ratio of the whole text decides alone, a mean ratio of zero being even.
    """
    importable(rows.sparkSession)
    table, cut, have = _level(counts(rows.where("fold in (1, 2, 3)")), "toxicity-counts")
    if not all(have):
        release(table)
        prior = rows.where("fold between 1 and 4").agg(F.sum("label").alias("t"), F.count("*").alias("n")).first()
        return Model(None, ((prior["t"] or 0) + 0.5) / (prior["n"] + 10)), None
    slices = Slices(ratios(table, cut))
    release(table)
    calibration, sent = slices.added(rows.where("fold = 4").select("label", "text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                x = features(part.column(1).to_pylist(), sent and sent.value, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in x.T)], names=["label", *_NAMES])

    found = calibration.mapInArrow(run, ", ".join(["label int", *(f"{n} double" for n in _NAMES)]))
    sample = found.orderBy(F.xxhash64(*_NAMES), "label").limit(CALIBRATION_ROWS).toArrow()
    x, y = np.stack([sample[n].to_numpy() for n in _NAMES], axis=1), sample["label"].to_numpy().astype(float)
    prior = float((y.sum() + 0.5) / (len(y) + 10))
    if len(set(y)) == 2:
        return Model(_logistic(x, y), prior), slices
    alone = np.zeros(FEATURES)
    alone[_MEAN] = 1.0
    return Model(alone, prior), slices


def _scored(docs: DataFrame, model: Model, slices: Slices | None, text_col: str, made, schema) -> DataFrame:
    """``made(batch without ratios, scores)`` of each batch of ``docs``."""
    importable(docs.sparkSession)
    rows, sent = slices.added(docs, text_col) if slices else (docs.withColumn("_r", F.lit(None).cast("binary")), None)
    if slices:
        slices.release()
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                own = part.select(part.schema.names[:-1])
                yield made(own, model.scores(part.column(place).to_pylist(), sent and sent.value, part.column(part.num_columns - 1).to_pylist()))

    return rows.mapInArrow(run, schema)


def learned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[Model, Slices | None]:
    """A model from the labelled rows of ``docs`` outside fold 0. Labels of unknown or null ids are of no use."""
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where(fold() != 0)
    known = truth(labels, label_col, id_col).where(fold() != 0)
    rows = stored(texts.join(known.hint("shuffle_hash"), "doc_id").select("text", "label", fold().cast("int").alias("fold")), "toxicity-rows")
    model = fit(rows)
    release(rows)
    return model


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Labels teach only outside fold 0, which is held out; a row with a null id is not held out.
    Null and empty texts, and those of white space alone, have the smoothed share of toxic rows as their score. Texts of any length are read whole. Equal texts have
    equal scores; repeated rows are scored each. Other columns are not read. An empty
    table gives no rows.
    """
    model, slices = learned(docs, labels, id_col, text_col, label_col)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    made = lambda part, scores: pa.RecordBatch.from_arrays([part.column(0), pa.array(scores)], names=["doc_id", "score"])
    found = _scored(rows, model, slices, "text", made, "doc_id long, score double")
    return found.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of ``docs`` whose score in ``classify`` is below one half, with its columns and no others.

    Rows are judged each by its own text: nulls, empty and very long texts, repeated rows and ids as there. An empty table gives no rows.
    """
    model, slices = learned(docs, labels, id_col, text_col, label_col)
    return _scored(docs, model, slices, text_col, lambda part, scores: part.filter(pa.array(scores < 0.5)), docs.schema)
