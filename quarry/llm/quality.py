"""Quality by a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover all of it. Each byte
enters as a learned vector and one more plane that says whether its last four bytes came
up within the ``LAGS`` bytes before, since filters alone cannot see repetition. A layer
of learned filters slides over each chunk and is max-pooled; the chunk vectors are
combined into their maximum and their mean over the document, and a small dense layer
gives one probability. Training is plain back-propagation with Adam, on the driver, over the whole texts of
a bounded sample of labelled rows (``PER_CLASS``, ``TRAIN_BYTES``); scoring runs on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.labels import fold, truth
from quarry.llm.scratch import importable

CHUNK, STEP = 512, 448
KERNEL, STRIDE = 12, 4
DIM, FILTERS, HIDDEN = 7, 24, 12
LAGS = 40
#: Labelled rows of each class that the network is trained on, at most, chosen by a hash of the id, and bytes of all their
#: texts: rows in order of the hash as long as they fit, each with its whole text. Scoring has no such bounds.
PER_CLASS, TRAIN_BYTES = 2000, 32 << 20
#: Chunks that are convolved at once.
GROUP = 256
#: Passes over the sample: eight, or on a small one as many as make 800 steps.
EPOCHS, STEPS, BATCH, RATE, SEED = 8, 800, 32, 0.01, 7
_POSITIONS = (CHUNK - KERNEL) // STRIDE + 1
_PAD = 256


def recurring(b: np.ndarray) -> np.ndarray:
    """1 where the four bytes that end here also ended somewhere in the ``LAGS`` bytes before."""
    out = np.zeros(len(b), bool)
    if len(b) < 5:
        return out
    w = b.astype(np.uint32)
    four = w[3:] | w[2:-1] << 8 | w[1:-2] << 16 | w[:-3] << 24
    for lag in range(1, min(LAGS, len(four) - 1) + 1):
        out[3 + lag :] |= four[lag:] == four[:-lag]
    return out


def chunks(text: str | bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(n, CHUNK) byte codes, padded with 256, and the recurrence plane; at least one chunk."""
    b = np.frombuffer(text if isinstance(text, bytes) else (text or "").encode("utf-8", "replace"), np.uint8)
    n = max(1, -(-(len(b) - CHUNK) // STEP) + 1)
    size = (n - 1) * STEP + CHUNK
    codes, again = np.full(size, _PAD, np.int16), np.zeros(size, np.uint8)
    codes[: len(b)] = b
    again[: len(b)] = recurring(b)
    cut = lambda x: np.lib.stride_tricks.sliding_window_view(x, CHUNK)[::STEP]
    return cut(codes), cut(again)


def _start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    inputs = KERNEL * (DIM + 1)
    shapes = {"embed": ((_PAD + 1, DIM), 0.5), "filters": ((inputs, FILTERS), inputs**-0.5), "shift": ((FILTERS,), 0), "dense": ((2 * FILTERS, HIDDEN), FILTERS**-0.5), "dense_shift": ((HIDDEN,), 0), "out": ((HIDDEN,), HIDDEN**-0.5), "out_shift": ((1,), 0)}
    return {k: (rng.standard_normal(s) * scale).astype(np.float32) for k, (s, scale) in shapes.items()}


@dataclass
class Network:
    """Weights, and the probability given without any (``constant``), if there was nothing to learn from."""

    w: dict[str, np.ndarray] | None
    constant: float = 0.5

    def convolve(self, codes: np.ndarray, again: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filters over each chunk: their maxima, not below zero, and the places of these."""
        kind = self.w["filters"].dtype
        most, place = np.empty((len(codes), FILTERS), kind), np.empty((len(codes), FILTERS), np.int64)
        for at in range(0, len(codes), GROUP):
            part = slice(at, at + GROUP)
            x = np.empty((*codes[part].shape, DIM + 1), kind)
            x[..., :DIM] = self.w["embed"][codes[part]]
            x[..., DIM] = again[part]
            flat = x.reshape(len(x), -1)
            windows = np.lib.stride_tricks.sliding_window_view(flat, KERNEL * (DIM + 1), axis=1)[:, :: STRIDE * (DIM + 1)]
            windows = np.ascontiguousarray(windows).reshape(-1, KERNEL * (DIM + 1))
            made = (windows @ self.w["filters"]).reshape(len(x), _POSITIONS, FILTERS) + self.w["shift"]
            place[part] = made.argmax(axis=1)
            most[part] = np.take_along_axis(made, place[part][:, None], axis=1)[:, 0]
        return np.maximum(most, 0), place * STRIDE

    def head(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(pooled @ self.w["dense"] + self.w["dense_shift"])
        return 1 / (1 + np.exp(-np.clip(hidden @ self.w["out"] + self.w["out_shift"], -30, 30))), hidden

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of each whole text."""
        if self.w is None:
            return np.full(len(texts), self.constant)
        pooled = np.zeros((len(texts), 2 * FILTERS), np.float32)
        for i, text in enumerate(texts):
            per_chunk, _ = self.convolve(*chunks(text))
            pooled[i] = np.concatenate([per_chunk.max(axis=0), per_chunk.sum(axis=0, dtype=np.float64) / len(per_chunk)])
        return self.head(pooled)[0].astype(np.float64)


def gradient(net: Network, labels: np.ndarray, weights: np.ndarray, codes: np.ndarray, again: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the weighted mean log loss of texts, whose chunks follow each other, ``sizes`` of each."""
    w, starts = net.w, np.concatenate([[0], np.cumsum(sizes)[:-1]])
    per_chunk, place = net.convolve(codes, again)
    most = np.maximum.reduceat(per_chunk, starts)
    pooled = np.concatenate([most, np.add.reduceat(per_chunk, starts) / sizes[:, None]], axis=1).astype(most.dtype)
    p, hidden = net.head(pooled)
    d = ((p - labels) * weights / len(labels)).astype(np.float32)
    g = {"out": hidden.T @ d, "out_shift": d.sum(keepdims=True)}
    dh = d[:, None] * w["out"] * (1 - hidden**2)
    g["dense"], g["dense_shift"] = pooled.T @ dh, dh.sum(axis=0)
    dp = dh @ w["dense"].T
    doc = np.repeat(np.arange(len(labels)), sizes)
    # Chunks overlap, so the strongest place of a text may be in two of them, which then share its gradient.
    best = (per_chunk == most[doc]).astype(most.dtype)
    dc = dp[doc, FILTERS:] / sizes[doc, None] + dp[doc, :FILTERS] * best / np.add.reduceat(best, starts)[doc]
    dc = np.where(per_chunk > 0, dc, 0)
    g["shift"] = dc.sum(axis=0)
    # Of each filter in each chunk, only the strongest place has a gradient.
    gf, ge = np.zeros((FILTERS, KERNEL * (DIM + 1)), np.float32), np.zeros_like(w["embed"])
    for at in range(0, len(codes), GROUP):
        part = slice(at, at + GROUP)
        c, f = np.nonzero(dc[part])
        cols = place[part][c, f][:, None] + np.arange(KERNEL)
        seen, value = codes[part][c[:, None], cols], dc[part][c, f].astype(np.float32)
        x = np.concatenate([w["embed"][seen], again[part][c[:, None], cols][..., None]], axis=2).astype(np.float32).reshape(len(c), -1)
        np.add.at(gf, f, x * value[:, None])
        back = (w["filters"].T[f] * value[:, None]).reshape(len(c), KERNEL, DIM + 1)[..., :DIM]
        np.add.at(ge, seen.reshape(-1), back.reshape(-1, DIM))
    return g | {"filters": gf.T, "embed": ge}


def train(sample: list[tuple[int, np.ndarray, np.ndarray]]) -> Network:
    """A network from (label, codes, recurrence plane) of labelled texts, classes weighing alike; see ``fit``."""
    rng = np.random.default_rng(SEED)
    net = Network(_start(rng))
    w = net.w
    mean, var = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    step = 0
    weight = {y: 0.5 / max(1, sum(s[0] == y for s in sample)) * len(sample) for y in (0, 1)}
    epochs = max(EPOCHS, -(-STEPS * BATCH // len(sample)))
    for epoch in range(epochs):
        order = rng.permutation(len(sample))
        rate = RATE * (1 - epoch / epochs)
        for at in range(0, len(order), BATCH):
            batch = [sample[i] for i in order[at : at + BATCH]]
            y = np.array([s[0] for s in batch], np.float32)
            codes, again = np.concatenate([s[1] for s in batch]), np.concatenate([s[2] for s in batch])
            g = gradient(net, y, np.where(y == 1, weight[1], weight[0]), codes, again, np.array([len(s[1]) for s in batch]))
            step += 1
            for k in w:
                grad = g[k].astype(np.float32) + 1e-4 * w[k]
                mean[k] += 0.1 * (grad - mean[k])
                var[k] += 0.001 * (grad**2 - var[k])
                w[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-8)
    return net


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Network:
    """A network from labelled rows outside fold 0.

    Trained with both classes weighing alike; afterwards the shares of the classes among all
    labelled rows are put back into the output's shift. Without rows of both classes the
    probability is their smoothed share. Labels of null or unknown ids are of no use; a row that repeats an id counts as often as it is there.
    """
    spark = docs.sparkSession
    importable(spark)
    known = truth(labels, label_col, id_col).where(fold() != 0)
    shares = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    mark = F.xxhash64("doc_id")
    chosen = reduce(DataFrame.unionByName, [known.where(F.col("label") == y).orderBy(mark, "doc_id").limit(PER_CLASS) for y in (0, 1)])
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("label", mark.alias("mark"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("body"))
    total = F.sum(F.length("body").cast("long")).over(Window.partitionBy("label").orderBy("mark", "body").rowsBetween(Window.unboundedPreceding, 0))
    found = rows.withColumn("total", total).where(F.col("total") <= TRAIN_BYTES // 2).select("label", "body").toArrow()
    sample = [(y, *chunks(body)) for y, body in sorted(zip(found["label"].to_pylist(), found["body"].to_pylist()))]
    if {s[0] for s in sample} != {0, 1}:
        return Network(None, (shares.get(1, 0) + 0.5) / (sum(shares.values()) + 1))
    net = train(sample)
    net.w["out_shift"] = net.w["out_shift"] + np.float32(np.log(shares[1] / shares[0]))
    return net


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Labels teach only outside fold 0, which is held out; a row with a null id is not held
    out. Null and empty texts are one chunk of padding and are scored like any other, as are repeated rows and texts of any length. Nothing but the
    text enters a score; other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sent.value.scores(part.column(1).to_pylist()))], names=["doc_id", "score"])

    found = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
