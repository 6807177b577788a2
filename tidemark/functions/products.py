"""Rank correlations of all pairs of columns, as sums of products that each task adds up as a block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SUMS = ("n", "a", "b", "aa", "bb", "ab")
#: Pairs of columns in a batch that a task sends.
_BATCH = 1 << 16


def percent_ranks(x: np.ndarray) -> np.ndarray:
    """Average rank of each known value in its column over the number of known ones; NaN stays."""
    out = np.full(x.shape, np.nan)
    for k in range(x.shape[1]):
        known = np.flatnonzero(~np.isnan(x[:, k]))
        if len(known):
            _, place, many = np.unique(x[known, k], return_inverse=True, return_counts=True)
            out[known, k] = (np.cumsum(many) - (many - 1) / 2)[place.reshape(-1)] / len(known)
    return out


def rank_correlations(panel: DataFrame, columns: list[str], by: str = "ts") -> DataFrame:
    """(feature_a, feature_b, rho, n) of each two columns, a before b by name: the correlation of their percent ranks within ``by``, over rows that know both.

    Rows are shuffled once, by ``by``; a task holds the rows of one date at a time and one sum of products for each pair of columns,
    so what it sends on does not follow the rows. A pair without a shared row has no row, one without spread no rho.
    """
    names = sorted(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(names)
        total = np.zeros((len(_SUMS), size, size))

        def add(parts: list[np.ndarray]) -> None:
            x = percent_ranks(np.concatenate(parts))
            m = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            total[0] += m.T @ m
            total[1] += x.T @ m
            total[3] += (x * x).T @ m
            total[5] += x.T @ x

        held: list[np.ndarray] = []
        date = None
        for batch in batches:
            dates = batch.column(0)
            if not len(dates):
                continue
            x = np.stack([np.asarray(c.cast(pa.float64()).fill_null(np.nan)) for c in batch.columns[1:]], 1)
            codes = dates.dictionary_encode().indices.fill_null(-1).to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            for begin, end in zip(starts, starts[1:], strict=False):
                now = dates[begin].as_py()
                if held and now != date:
                    add(held)
                    held = []
                date = now
                held.append(x[begin:end])
        if held:
            add(held)
        total[2], total[4] = total[1].T, total[3].T
        i, j = np.triu_indices(size, 1)
        for begin in range(0, len(i), _BATCH):
            p, q = i[begin : begin + _BATCH], j[begin : begin + _BATCH]
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(q.astype(np.int32)), *(pa.array(t[p, q]) for t in total)], ["p", "q", *_SUMS])

    values = [F.col(c).try_cast("double").alias(f"c{k}") for k, c in enumerate(names)]
    rows = panel.select(F.col(by).alias("d"), *values).repartition("d").sortWithinPartitions("d")
    sums = rows.mapInArrow(run, "p int, q int, " + ", ".join(f"{s} double" for s in _SUMS)).groupBy("p", "q").agg(*(F.sum(s).alias(s) for s in _SUMS)).filter("n > 0")
    spread = lambda x, xx: F.col("n") * F.col(xx) - F.col(x) * F.col(x)
    least = F.col("n") * F.col("n") * 1e-12  # ranks are up to 1, so this is rounding
    rho = F.when((spread("a", "aa") > least) & (spread("b", "bb") > least), (F.col("n") * F.col("ab") - F.col("a") * F.col("b")) / F.sqrt(spread("a", "aa") * spread("b", "bb")))
    named = F.array(*(F.lit(c) for c in names))
    return sums.select(F.get(named, F.col("p")).alias("feature_a"), F.get(named, F.col("q")).alias("feature_b"), rho.alias("rho"), F.col("n").cast("long").alias("n"))
