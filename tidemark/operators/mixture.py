"""Gaussian mixtures with full covariances: fitting on complete rows, the number of components, posteriors of partly unknown rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.inference import finite
from tidemark.sources.tables import materialised

#: Added to the diagonal of every covariance.
RIDGE = 1e-4
#: A fit ends when a row's mean log-likelihood grows by less.
TOLERANCE = 1e-3
#: Rows, the first by a hash of their values, on which the starting centres are sought. They set where the passes begin; all rows take part in these.
START_ROWS = 4096
#: Bytes of factors of all 2 ** dimensions patterns that are sent to every executor; beyond, those of the patterns that occur are joined by shuffle.
MOST_BYTES = 64 << 20
#: Parts that a pattern's rows are dealt to in that shuffle.
SALTS = 64


@dataclass(frozen=True)
class Mixture:
    """Weights (k), means (k, d) and covariances (k, d, d)."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray


@dataclass(frozen=True)
class Fit:
    """A mixture, the rows it was fitted on, their log-likelihood under it, passes made, and whether the last one changed little."""

    mixture: Mixture
    rows: int
    log_likelihood: float
    rounds: int
    converged: bool

    @property
    def bic(self) -> float:
        k, d = self.mixture.means.shape
        return -2 * self.log_likelihood + (k - 1 + k * d + k * d * (d + 1) // 2) * float(np.log(self.rows))


def start(x: np.ndarray, k: int, seed: int, steps: int = 20) -> Mixture:
    """Centres drawn by distance from those before, moved to the means of their nearest rows a few times."""
    rng = np.random.default_rng([seed, k])
    centres = x[[int(rng.integers(len(x)))]]
    while len(centres) < k:
        far = ((x[:, None] - centres[None]) ** 2).sum(2).min(1)
        pick = rng.choice(len(x), p=far / far.sum()) if far.sum() > 0 else 0
        centres = np.vstack([centres, x[pick]])
    for _ in range(steps):
        near = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.stack([x[near == j].mean(0) if (near == j).any() else centres[j] for j in range(k)])
    spread = np.cov(x.T, bias=True).reshape(x.shape[1], -1)
    own = [np.cov(x[near == j].T, bias=True).reshape(x.shape[1], -1) if (near == j).sum() > 1 else spread for j in range(k)]
    share = np.maximum(np.bincount(near, minlength=k), 1.0)
    return Mixture(share / share.sum(), centres, np.stack(own) + RIDGE * np.eye(x.shape[1]))


def log_densities(model: Mixture, x: np.ndarray) -> np.ndarray:
    """(rows, k): logarithms of weight times density."""
    out = np.empty((len(x), len(model.weights)))
    for j, (weight, mean, covariance) in enumerate(zip(model.weights, model.means, model.covariances, strict=True)):
        root = np.linalg.cholesky(covariance)
        z = np.linalg.solve(root, (x - mean).T)
        out[:, j] = np.log(max(weight, 1e-300)) - 0.5 * ((z * z).sum(0) + x.shape[1] * np.log(2 * np.pi)) - np.log(np.diag(root)).sum()
    return out


def sums(model: Mixture, x: np.ndarray) -> tuple[float, np.ndarray]:
    """Log-likelihood of rows, and a row for each component: its share of rows, and sums and products of what lies between a row and the old mean."""
    log = log_densities(model, x)
    top = log.max(1, keepdims=True)
    part = np.exp(log - top)
    whole = part.sum(1, keepdims=True)
    share = part / whole
    out = []
    for j, mean in enumerate(model.means):
        away = x - mean
        held = away * share[:, [j]]
        out.append(np.concatenate([[share[:, j].sum()], held.sum(0), (held.T @ away).ravel()]))
    return float((top + np.log(whole)).sum()), np.stack(out)


def moved(model: Mixture, total: np.ndarray, rows: int) -> Mixture:
    """The mixture that the sums of a pass give; a component without rows stays where it is."""
    d = model.means.shape[1]
    held = np.maximum(total[:, 0], 1e-12)
    step, products = total[:, 1 : 1 + d] / held[:, None], (total[:, 1 + d :] / held[:, None]).reshape(-1, d, d)
    covariances = products - step[:, :, None] * step[:, None] + RIDGE * np.eye(d)
    empty = total[:, 0] < 1e-9
    step[empty], covariances[empty] = 0, model.covariances[empty]
    return Mixture(total[:, 0] / rows, model.means + step, covariances)


def fit(df: DataFrame, columns: list[str], choices: Iterable[int], rounds: int = 200, seed: int = 0) -> dict[int, Fit]:
    """A mixture for each number of components in ``choices``, all fitted in the same passes over the complete rows.

    A pass is one job: a task adds up the sums of all mixtures over its rows, and the driver gets their totals, whose number follows the
    choices and the square of the dimensions, never the rows. Starts come from a hash of the values, so they do not follow the order or the partitions of
    the rows. A choice that is not below the number of complete rows is left out; null, NaN and infinite values make a row incomplete;
    equal rows each count; other columns are not read.
    """
    values = materialised(df.select(*(finite(f"`{c}`").alias(f"x{i}") for i, c in enumerate(columns))).dropna())
    names = values.columns
    first = values.orderBy(F.xxhash64(F.lit(seed), *names), *names).limit(START_ROWS).toArrow()
    rows = values.count()
    begun = np.stack([np.asarray(first[n], float) for n in names], 1)
    going = {k: start(begun, k, seed) for k in sorted(set(choices)) if 0 < k < rows}
    before = dict.fromkeys(going, -np.inf)
    out: dict[int, Fit] = {}
    for number in range(1, rounds + 1):
        if not going:
            break
        totals = _pass(values, going)
        for k in list(going):
            likelihood, total = totals[k]
            close = likelihood / rows - before[k] < TOLERANCE
            out[k] = Fit(going[k], rows, likelihood, number, bool(close))
            before[k] = likelihood / rows
            if close:
                del going[k]
            else:
                going[k] = moved(going[k], total, rows)
    return dict(sorted(out.items()))


def _pass(values: DataFrame, models: dict[int, Mixture]) -> dict[int, tuple[float, np.ndarray]]:
    """For each number of components the log-likelihood of all rows and the components' sums."""
    width = 1 + len(values.columns) + len(values.columns) ** 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([np.asarray(c, float) for c in batch.columns], 1)
            for k, model in models.items():
                likelihood, total = sums(model, x)
                mine = held.setdefault(k, [0.0, np.zeros((k, width))])
                mine[0] += likelihood
                mine[1] += total
        for k, (likelihood, total) in held.items():
            flat = np.concatenate([[likelihood], total.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), k), pa.int32()), pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["k", "place", "value"])

    flat = {k: np.zeros(1 + k * width) for k in models}
    for r in values.mapInArrow(run, "k int, place int, value double").groupBy("k", "place").agg(F.sum("value").alias("value")).collect():
        flat[r["k"]][r["place"]] = r["value"]
    return {k: (float(f[0]), f[1:].reshape(k, width)) for k, f in flat.items()}


def chosen(fits: dict[int, Fit]) -> int:
    """The number of components with the smallest BIC, the smaller of equals."""
    return min(fits, key=lambda k: (fits[k].bic, k))


def choices_table(df: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """(k, rows, rounds, converged, log_likelihood, bic, chosen) of the fits."""
    best = chosen(fits) if fits else None
    rows = [(k, f.rows, f.rounds, f.converged, f.log_likelihood, f.bic, k == best) for k, f in fits.items()]
    return df.sparkSession.createDataFrame(rows, "k int, rows long, rounds int, converged boolean, log_likelihood double, bic double, chosen boolean")


_FACTORS = pa.list_(pa.struct([("log", pa.float64()), ("rows", pa.list_(pa.struct([("offset", pa.float64()), ("by", pa.list_(pa.float64()))])))]))


def factors(model: Mixture, pattern: int) -> list[dict]:
    """A component's constant, and the rows whose products with a row, less an offset, are its standardised distances in the known dimensions.

    Bit i of ``pattern`` says that dimension i is known. Directions in which a covariance has no extent are left out.
    """
    d = model.means.shape[1]
    seen = [i for i in range(d) if pattern >> i & 1]
    out = []
    for weight, mean, covariance in zip(model.weights, model.means, model.covariances, strict=True):
        log, rows = float(np.log(max(weight, 1e-300))), []
        if seen:
            extent, axes = np.linalg.eigh(covariance[np.ix_(seen, seen)])
            use = extent > 1e6 * np.finfo(float).eps * np.abs(extent).max()
            root = (axes[:, use] / np.sqrt(extent[use])).T
            log -= 0.5 * float(np.log(2 * np.pi * extent[use]).sum())
            for line in root:
                by = np.zeros(d)
                by[seen] = line
                rows.append({"offset": float(line @ mean[seen]), "by": by.tolist()})
        out.append({"log": log, "rows": rows})
    return out


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def _normalised(logs: Column) -> Column:
    parts = _let(F.array_max(logs), lambda top: F.transform(logs, lambda x: F.exp(x - top)))
    return _let(parts, lambda p: _let(F.aggregate(p, F.lit(0.0), lambda a, x: a + x), lambda whole: F.transform(p, lambda x: x / whole)))


def add_posterior(df: DataFrame, columns: list[str], model: Mixture, name: str = "posterior") -> DataFrame:
    """Adds an array of component probabilities, from the dimensions that are known.

    The marginal of a mixture over some dimensions is a mixture, so nothing is filled in; a row of unknowns (null, NaN, infinite) gets
    the weights. Covariances are factorised once for each pattern of what is known, in a table by the pattern's bits; all else is columns.
    """
    spark, d = df.sparkSession, len(columns)
    if d > 62:
        raise ValueError("patterns of more than 62 dimensions do not fit into 64 bits")
    x = [finite(f"`{c}`") for c in columns]
    bits = sum((F.when(v.isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, v in enumerate(x)), F.lit(0).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                part = batch.column(0).slice(begin, 64)
                yield pa.RecordBatch.from_arrays([part, pa.array([factors(model, p) for p in part.to_pylist()], _FACTORS)], ["_pattern", "_factors"])

    kind = "_pattern long, _factors array<struct<log: double, rows: array<struct<offset: double, by: array<double>>>>>"
    left = df.withColumn("_pattern", bits)
    if (1 << d) * len(model.weights) * (d * (d + 3) + 4) * 8 <= MOST_BYTES:
        met = left.join(F.broadcast(spark.range(1 << d).toDF("_pattern").mapInArrow(run, kind)), "_pattern")
    else:
        # Most rows may have one pattern, so each pattern's rows are dealt; where a row goes changes nothing.
        table = left.select("_pattern").distinct().mapInArrow(run, kind).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = left.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(table, ["_pattern", "_salt"])
    row = F.array(*(F.coalesce(v, F.lit(0.0)) for v in x))
    dot = lambda by, values: F.aggregate(F.zip_with(by, values, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    distance = lambda rows, values: F.aggregate(rows, F.lit(0.0), lambda a, f: a + F.pow(dot(f["by"], values) - f["offset"], 2.0))
    logs = lambda values: F.transform("_factors", lambda f: f["log"] - 0.5 * distance(f["rows"], values))
    return met.withColumn(name, _let(row, lambda values: _let(logs(values), _normalised))).select(*(F.col(f"`{c}`") for c in df.columns if c != name), name)
