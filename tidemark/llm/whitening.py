"""Whitening of embeddings from an exact integer scatter.

Entries become integers. Every task takes a shift off them and adds up sums and cross products
exactly: integers are cut into limbs of 20 bits, whose products of at most 2^13 rows are exact in
double precision, so the fast product of matrices can be used, and what it gives is kept in Python's
integers of any size. Tasks send their sums in limbs of 30 bits, a row for each pair of dimensions and limb, which
Spark adds up as longs; so only numbers of the dimensions' square reach the driver, never rows. There n·XᵀX − SSᵀ is formed exactly
and only then turned into floating point and decomposed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
#: Rows multiplied at once, and bits of a limb: 2 ** 13 products of 40 bits stay below 2 ** 53.
ROWS, BITS = 1 << 13, 20
#: Largest number of dimensions: their square is what the driver gets.
MOST_DIMENSIONS = 4096
#: Bits of a limb on its way between tasks; 2 ** 33 tasks may be added up.
SENT_BITS = 30


def integers(vectors: pa.Array, size: int, scale: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their matrix of floor(scale * c) + shift).

    A row takes part if its vector has ``size`` entries, all of them finite and small enough for a long.
    """
    lengths = np.asarray(vectors.value_lengths().fill_null(-1), np.int64)
    rows = np.flatnonzero(lengths == size)
    if not size or not len(rows):
        return rows[:0], np.zeros((0, size), np.int64)
    flat = np.asarray(vectors.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(np.nan)).reshape(-1, size)
    with np.errstate(over="ignore"):
        whole = np.floor(flat * scale)
    good = (np.abs(whole) < 2.0**62 - abs(shift)).all(axis=1)  # false for NaN, and for infinite ones
    return rows[good], whole[good].astype(np.int64) + shift


class Scatter:
    """Exact number, sums and cross products of integer rows, less a shift that keeps them small."""

    def __init__(self, size: int, shift: int):
        self.n = 0
        self.shift = shift
        self.sums = np.zeros(size, object)
        self.products = np.zeros((size, size), object)
        self._parts: dict[int, np.ndarray] = {}  # by the joint place of two limbs
        self._held = 0

    def add(self, x: np.ndarray) -> None:
        for begin in range(0, len(x), ROWS):
            part = x[begin : begin + ROWS] - self.shift
            self.n += len(part)
            limbs = []
            rest = part
            while True:
                low = rest & ((1 << BITS) - 1)
                if ((rest >> (BITS - 1)) == (rest >> 63)).all():  # the rest fits a limb with its sign
                    limbs.append(rest.astype(np.float64))
                    break
                limbs.append(low.astype(np.float64))
                rest = rest >> BITS
            for k, a in enumerate(limbs):
                self.sums += np.array([int(s) << (BITS * k) for s in a.sum(axis=0)], object)
                for m, b in enumerate(limbs):
                    held = self._parts.setdefault(k + m, np.zeros(self.products.shape, np.int64))
                    held += (a.T @ b).astype(np.int64)
            self._held += 1
            if self._held == 128:  # at most four products of 2 ** 53 a place and step
                self.flush()

    def flush(self) -> None:
        for place, held in self._parts.items():
            self.products += held.astype(object) << (BITS * place)
        self._parts.clear()
        self._held = 0


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    k = 0
    while not -(1 << SENT_BITS) <= value < 1 << SENT_BITS:
        yield k, value & ((1 << SENT_BITS) - 1)
        value >>= SENT_BITS
        k += 1
    if value:
        yield k, value


def scatter(vectors: DataFrame, column: str, size: int, scale: int = SCALE, shift: int = SHIFT) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums and the cross products of all rows of ``size`` finite entries, exactly, with the shift taken off."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Scatter(size, shift)
        for batch in batches:
            total.add(integers(batch.column(0), size, scale, shift)[1])
        total.flush()
        rows = [(-1, -1, k, v) for k, v in _limbs(total.n)]
        for i in range(size):
            rows += [(i, -1, k, v) for k, v in _limbs(total.sums[i])]
            rows += [(i, j, k, v) for j in range(i, size) for k, v in _limbs(total.products[i, j])]
            if len(rows) >= 1 << 16 or i == size - 1:
                yield pa.RecordBatch.from_pydict(dict(zip(("i", "j", "limb", "value"), map(list, zip(*rows, strict=True)), strict=True)) if rows else {"i": [], "j": [], "limb": [], "value": []}, pa.schema([("i", pa.int32()), ("j", pa.int32()), ("limb", pa.int32()), ("value", pa.int64())]))
                rows = []

    sent = vectors.select(F.col(column).alias("v")).mapInArrow(run, "i int, j int, limb int, value long")
    n, sums, products = 0, [0] * size, [[0] * size for _ in range(size)]
    for r in sent.groupBy("i", "j", "limb").agg(F.sum("value").alias("value")).collect():
        value = r["value"] << (SENT_BITS * r["limb"])
        if r["i"] < 0:
            n += value
        elif r["j"] < 0:
            sums[r["i"]] += value
        else:
            products[r["i"]][r["j"]] += value
            if r["i"] != r["j"]:
                products[r["j"]][r["i"]] += value
    return n, sums, products


@dataclass
class Whitening:
    """What was fitted: rows, exact sums (without the shift), projections (dimensions by components) over the square root of the
    variance, each component's share of all variance, and whether it has any."""

    n: int
    sums: list[int]
    projection: np.ndarray
    explained: np.ndarray
    varies: np.ndarray


def decompose(n: int, sums: list[int], products: list[list[int]], components: int) -> Whitening:
    """The components of n·XᵀX − SSᵀ, exact as integers, over n²."""
    size = len(sums)
    whole = np.array([[n * products[i][j] - sums[i] * sums[j] for j in range(size)] for i in range(size)], object).reshape(size, size)
    # Division of integers is rounded once.
    v = np.array([[x / (n * n) for x in row] for row in whole], float).reshape(size, size)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    e, q = values[order], vectors[:, order]
    trace = sum(whole[i, i] for i in range(size)) / (n * n) if size else 0.0
    varies = e > max(values, default=0.0) * size * np.finfo(float).eps
    projection = np.where(varies, q / np.sqrt(np.where(varies, e, 1.0)), 0.0)
    return Whitening(n, sums, projection, np.where(varies, e, 0.0) / trace if trace else np.zeros(len(e)), varies)


def dimensions(vectors: DataFrame, column: str) -> int:
    """The number of entries that most vectors have, the larger of equals; 0 without vectors."""
    found = vectors.filter(F.size(column) > 0).groupBy(F.size(column).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return found["size"] if found else 0


def project(x: np.ndarray, shift: int, model: Whitening) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whitened values of integer rows; the sum of (n*x - S)^2 where it fits a long; and where it does."""
    x = x - shift
    most = max(int(np.abs(x).max(initial=0)), *(abs(s) // model.n + 1 for s in model.sums))
    if 2 * most * model.n < 1 << 62:
        off = x * model.n - np.array(model.sums, np.int64)
    else:
        off = x.astype(object) * model.n - np.array(model.sums, object)
    white = (off.astype(np.float64) / model.n) @ model.projection
    if int(abs(off).max(initial=0)) ** 2 * x.shape[1] < 1 << 63:
        off = off.astype(np.int64)
        return white, (off * off).sum(axis=1), np.ones(len(x), bool)
    exact = [sum(int(v) ** 2 for v in row) for row in off]
    fits = np.array([d < 1 << 63 for d in exact], bool)
    return white, np.array([d if ok else 0 for d, ok in zip(exact, fits, strict=True)], np.int64), fits


def identity_error(vectors: DataFrame, column: str, model: Whitening, scale: int, shift: int) -> float:
    """Largest absolute entry of the whitened values' covariance, less the identity, over the components that vary.

    The whitened values of every row are made anew and their products added up by task; they are centred by S/n, and what
    rounding leaves of their mean is taken off at the end.
    """
    size, keep = len(model.sums), np.flatnonzero(model.varies)
    if not len(keep):
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(len(keep)), np.zeros((len(keep), len(keep)))
        for batch in batches:
            white = project(integers(batch.column(0), size, scale, shift)[1], shift, model)[0][:, keep]
            sums += white.sum(axis=0)
            products += white.T @ white
        i, j = np.triu_indices(len(keep))
        first = np.concatenate([i, np.arange(len(keep))]).astype(np.int32)
        second = np.concatenate([j, np.full(len(keep), -1)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(second), pa.array(np.concatenate([products[i, j], sums]))], ["i", "j", "value"])

    rows = vectors.select(F.col(column).alias("v")).mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    mean = {r["i"]: r["value"] / model.n for r in rows if r["j"] < 0}
    return max(abs(r["value"] / model.n - mean[r["i"]] * mean[r["j"]] - (r["i"] == r["j"])) for r in rows if r["j"] >= 0)


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> Whitening | None:
    """Fits on all rows that take part; None if there are none. The same rows give the same numbers, however they are dealt."""
    size = dimensions(vectors, column)
    if size > MOST_DIMENSIONS:
        raise ValueError(f"{size} dimensions are more than {MOST_DIMENSIONS}, whose square the driver could hold")
    n, sums, products = scatter(vectors, column, size, scale, shift) if size else (0, [], [])
    return decompose(n, sums, products, components) if n else None


def whiten(vectors: DataFrame, carry: list[str], column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """One row for each vector that takes part: the ``carry`` columns, n, deviation, whitened and explained (arrays by component), identity_error.

    An entry c becomes x = floor(scale * c) + shift; as every covariance is centred, the shift changes no result, and sums are held
    without it. A vector that is null or empty, holds a null, a non-finite entry or one whose integer reaches 2^62, or has
    another number of entries than most vectors (of equally many, the larger number counts) takes no part. Repeated rows count as
    often as they come. A direction without variance (as with one row, or with fewer rows than dimensions) is whitened
    to 0 and explains 0. ``deviation`` is the exact sum of (n*x - S)^2, null where that does not fit a long. No vectors: no rows.
    Only the carried columns and the vectors are read; a carried column with the name of a result is left out.
    """
    added = {"n": "long", "deviation": "long", "whitened": "array<double>", "explained": "array<double>", "identity_error": "double"}
    carry = [c for c in dict.fromkeys(carry) if c not in added]
    fields = [f"`{c.replace('`', '``')}` {vectors.schema[c].dataType.simpleString()}" for c in carry]
    names = [*carry, *added]
    column = f"`{column.replace('`', '``')}`"
    model = fit(vectors, column, components, scale, shift)
    error = identity_error(vectors, column, model, scale, shift) if model else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch) if model else 0, ROWS):
                part = batch.slice(begin, ROWS)
                rows, x = integers(part.column(len(carry)), len(model.sums), scale, shift)
                white, deviation, fits = project(x, shift, model)
                many = white.shape[1]
                bounds = pa.array(np.arange(0, many * len(rows) + 1, many) if many else np.zeros(len(rows) + 1), pa.int32())
                results = [
                    pa.array(np.full(len(rows), model.n)),
                    pa.array(deviation, mask=~fits),
                    pa.ListArray.from_arrays(bounds, pa.array(white.ravel())),
                    pa.ListArray.from_arrays(bounds, pa.array(np.tile(model.explained, len(rows)))),
                    pa.array(np.full(len(rows), error)),
                ]
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(rows)) for k in range(len(carry))), *results], names)

    placed = vectors.select(*(F.col(f"`{c.replace('`', '``')}`").alias(f"c{k}") for k, c in enumerate(carry)), F.col(column).alias("v"))
    return placed.mapInArrow(run, ", ".join([*fields, *(f"{c} {kind}" for c, kind in added.items())]))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), ["vec_id"])
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "c")
    return rows.select("vec_id", "n", "deviation", "identity_error", each).select(
        "vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error"
    )
