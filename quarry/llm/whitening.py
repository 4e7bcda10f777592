"""Whitening of embeddings over an exact scatter matrix.

Entries become integers, so the scatter is an integer matrix and can be had without
rounding. Each partition multiplies its block modulo several primes: the residues are
below 2^20, a block has at most 2^13 rows, so a product of floating-point matrices is exact
and BLAS does the work. Residues are summed by Spark for each prime and cell;
as many primes are used as the largest possible sum needs, and Chinese remaindering
gives back the sums themselves. Covariances follow in whole numbers, centred, and only
then is there one rounding, to doubles, and one symmetric eigenproblem of the size of the dimension.

What the driver holds is d * (d + 3) / 2 sums for each prime, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.scratch import importable, release, stored

#: Residues below 2^BITS; rows of a block, so that 2^BITS squared times ROWS stays within the 53 bits of a double.
BITS, ROWS = 20, 1 << 13
LEAST_PRIMES = 2
WIDEST = (1 << 63) - 1


def primes(above: int, least: int = LEAST_PRIMES, bits: int = BITS) -> list[int]:
    """The largest primes below 2^bits, as many as have a product above ``above``, and ``least`` at any rate."""
    found, product, p = [], 1, (1 << bits) - 1
    while len(found) < least or product <= above:
        if all(p % q for q in range(3, int(p**0.5) + 1, 2)):
            found.append(p)
            product *= p
        p -= 2
    return found


def remaindered(residues: list[int], moduli: list[int]) -> int:
    """The number of least magnitude with these residues."""
    x, product = 0, 1
    for r, p in zip(residues, moduli):
        x += product * ((int(r) - x) * pow(product, -1, p) % p)
        product *= p
    return x - product if 2 * x > product else x


def gram(x: np.ndarray, p: int) -> np.ndarray:
    """x' x modulo p of an int64 matrix, in blocks whose products are exact."""
    total = np.zeros((x.shape[1], x.shape[1]), np.int64)
    for at in range(0, len(x), ROWS):
        r = (x[at : at + ROWS] % p).astype(np.float64)
        total = (total + (r.T @ r).astype(np.int64)) % p
    return total


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _grams(dim: int, moduli: list[int]):
    """Residues of the scatter of (x, 1), the upper half of it, of one partition."""
    upper = np.triu_indices(dim + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(moduli), dim + 1, dim + 1), np.int64)
        for b in batches:
            x = _matrix(b.column(0), dim)
            x = np.concatenate([x, np.ones((len(x), 1), np.int64)], axis=1)
            for k, p in enumerate(moduli):
                total[k] = (total[k] + gram(x, p)) % p
        for k in range(len(moduli)):
            cells = [np.full(len(upper[0]), k), *upper, total[k][upper]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["k", "i", "j", "residue"])

    return run


class Basis(NamedTuple):
    """Number of fitted vectors, their exact sums, the components as rows, their eigenvalues (falling) and the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float


def scatter(fit: DataFrame, dim: int, largest: int, n: int) -> tuple[list[int], list[list[int]]]:
    """Exact sums and scatter of ``fit(x array<long>)``: n vectors of ``dim`` entries of at most ``largest`` in magnitude."""
    importable(fit.sparkSession)
    moduli = primes(2 * n * max(largest, 1) ** 2 + 1)
    cells = fit.select("x").mapInArrow(_grams(dim, moduli), "k int, i int, j int, residue long").groupBy("i", "j", "k").agg(F.sum("residue").alias("residue"))
    of: dict[tuple[int, int], list[int]] = {}
    for r in cells.collect():
        of.setdefault((r.i, r.j), [0] * len(moduli))[r.k] = r.residue
    whole = {at: remaindered([x % p for x, p in zip(found, moduli)], moduli) for at, found in of.items()}
    return [whole.get((i, dim), 0) for i in range(dim)], [[whole.get((min(i, j), max(i, j)), 0) for j in range(dim)] for i in range(dim)]


def basis(n: int, sums: list[int], products: list[list[int]], components: int) -> Basis:
    """Leading components of the covariance (n * products - sums sums') / n^2, taken in whole numbers and rounded once.

    The largest entry of a component is positive. Components whose eigenvalue does not stand out from rounding are left out.
    """
    d = len(sums)
    v = np.array([[(n * products[i][j] - sums[i] * sums[j]) / (n * n) for j in range(d)] for i in range(d)], dtype=np.float64).reshape(d, d)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors.T[::-1][:components]
    real = values > d * np.finfo(np.float64).eps * max(values[0], 0.0) if len(values) else np.zeros(0, bool)
    values, vectors = values[real], vectors[real]
    signs = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)]) if len(vectors) else np.ones(0)
    return Basis(n, sums, vectors * signs[:, None], values, float(sum(n * products[i][i] - sums[i] ** 2 for i in range(d)) / (n * n)))


def _exact(x: np.ndarray, n: int, sums: list[int], largest: int) -> tuple[np.ndarray, list]:
    """(n x - S) as doubles and the exact sums of its squares over the dimensions; a sum that a long can't hold is null."""
    if 4 * (n * max(largest, 1)) ** 2 * max(x.shape[1], 1) <= WIDEST:
        moved = x * n - np.array(sums, np.int64)
        return moved.astype(np.float64), (moved * moved).sum(axis=1).tolist()
    moved = x.astype(object) * n - np.array(sums, object)
    squares = [sum(v * v for v in row) for row in moved]
    return moved.astype(np.float64), [s if s <= WIDEST else None for s in squares]


def _whitener(b: Basis, largest: int, dim: int):
    scaled = b.components / np.sqrt(b.values)[:, None] / b.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moved, squares = _exact(_matrix(batch.column(1), dim), b.n, b.sums, largest)
            z = moved @ scaled.T
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(squares, pa.int64()), pa.array(list(z), pa.list_(pa.float64()))], names=["vec_id", "deviation", "z"])

    return run


def integers(vectors: Column, scale: int) -> Column:
    """floor(scale * c) of each entry as a long; beyond the longs it is the nearest of them."""
    return F.transform(vectors, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))


def whiten(rows: DataFrame, components: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per remaining row and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Left out are rows whose vector is null, empty, holds a null or a non-finite entry, or has not the length that most
    others have (of equally frequent ones the larger). Ids are carried as they are, null or repeated; every row is
    returned, and equal vectors get equal values, but the basis is fitted to each different one once. Of a component that has no variance ``whitened`` is null;
    ``explained`` is then 0 or, if nothing varies, null. A ``deviation`` beyond a long is null. ``identity_error`` covers the components with variance, and is null
    without any. An empty table, or one without a usable vector, gives no rows; other columns are not read.
    """
    spark = rows.sparkSession
    importable(spark)
    given = rows.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    usable = given.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(finite, F.lit(False)))
    lengths = usable.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("d")).limit(1).collect()
    shape = f"vec_id {given.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not lengths:
        return spark.createDataFrame([], shape)
    dim = lengths[0].d
    found = usable.where(F.size("v") == dim).select("vec_id", integers(F.col("v"), scale).alias("x"))
    fit = stored(found.select("x").distinct(), "whitening-fit")
    far = F.greatest(F.max(F.array_max("x")), -F.min(F.array_min("x")).cast("decimal(20,0)"))
    n, largest = (int(v) for v in fit.agg(F.count("*"), far).first())
    b = basis(n, *scatter(fit, dim, largest, n), components)
    kind = f"vec_id {given.schema['vec_id'].dataType.simpleString()}, deviation long, z array<double>"
    run = _whitener(b, largest, dim)
    z = fit.select(F.lit(None).cast(given.schema["vec_id"].dataType).alias("vec_id"), "x").mapInArrow(run, kind)
    pairs = [(i, j) for i in range(len(b.values)) for j in range(i, len(b.values))]
    off = [F.abs(F.covar_pop(F.col("z")[i], F.col("z")[j]) - F.lit(float(i == j))).alias(f"c{i}_{j}") for i, j in pairs]
    error = max(z.agg(*off).first()) if off else None
    release(fit)
    k = min(components, dim)
    explained = [float(e) / b.trace for e in b.values] + [0.0 if b.trace else None] * (k - len(b.values))
    parts = [F.struct(F.lit(i + 1).alias("component"), F.get("z", F.lit(i)).alias("whitened"), F.lit(explained[i]).cast("double").alias("explained")) for i in range(k)]
    out = found.mapInArrow(run, kind).select("vec_id", "deviation", F.explode(F.array(*parts)).alias("p"))
    return out.select("vec_id", "p.component", F.lit(n).cast("long").alias("n"), "deviation", "p.whitened", "p.explained", F.lit(error).cast("double").alias("identity_error"))
