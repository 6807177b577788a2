"""Whitening against exact rational arithmetic."""

import math
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import registry, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def slow_sums(x):
    """n, sums and cross products in Python's integers."""
    size = len(x[0])
    return len(x), [sum(r[i] for r in x) for i in range(size)], [[sum(r[i] * r[j] for r in x) for j in range(size)] for i in range(size)]


@pytest.mark.parametrize("bits", [3, 18, 19, 20, 21, 40, 61])
def test_scatter_is_exact_at_every_size(bits, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 16)
    rng = random.Random(bits)
    x = [[rng.choice([-1, 1]) * rng.randint(0, 2**bits - 1) for _ in range(5)] for _ in range(2500)]
    x[7] = [2**bits - 1, -(2**bits), -1, 0, 1]
    total = whitening.Scatter(5, 1000)
    for begin in range(0, len(x), 100):
        total.add(np.array(x[begin : begin + 100], np.int64) + 1000)
    total.flush()
    n, sums, products = slow_sums(x)
    assert total.n == n and total.sums.tolist() == sums and total.products.tolist() == products
    assert all(type(v) is int for v in total.sums) and all(type(v) is int for v in total.products.ravel())


def test_limbs_add_up():
    for v in [0, 1, -1, 2**30, -(2**30), 2**30 - 1, -(2**30) - 1, 3**90, -(3**90), 2**200, -(2**200)]:
        assert sum(x << (whitening.SENT_BITS * k) for k, x in whitening._limbs(v)) == v
        assert all(-(2**30) <= x <= 2**30 for _, x in whitening._limbs(v))


def test_rows_that_take_part():
    vectors = [[1.0, 2.0], None, [], [1.0], [1.0, None], [1.0, math.nan], [math.inf, 0.0], [1e300, 0.0], [-0.01, 0.0], [1.0, 2.0, 3.0]]
    rows, x = whitening.integers(pa.array(vectors, pa.list_(pa.float64())), 2, 64, 1_000_000)
    assert rows.tolist() == [0, 8] and x.tolist() == [[1_000_064, 1_000_128], [999_999, 1_000_000]]
    sliced = pa.array([[9.0, 9.0], *vectors], pa.list_(pa.float64())).slice(1)
    assert whitening.integers(sliced, 2, 64, 0)[0].tolist() == [0, 8]


def rows_of(n=300, size=40, seed=0):
    g = np.random.default_rng(seed)
    x = g.normal(size=(n, size)) * np.linspace(0.1, 3, size)
    return [(k, v.astype(np.float32).tolist(), k % 3) for k, v in enumerate(x @ g.normal(size=(size, size)) / 5)]


def test_query_against_rational_arithmetic(spark, tables):
    rows = rows_of()
    rows += [(1000, None, 1), (1001, [None, *[0.5] * 39], 1), (1002, [math.nan, *[0.5] * 39], 1), (1003, [math.inf, *[0.5] * 39], 1), (1004, [], 1), (1005, [1.0] * 7, 1), (5, rows[5][1], 0), (None, rows[6][1], 0)]
    got = registry.QUERIES["op12_whitening"](spark, tables("embeddings", rows, SCHEMA))
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    got = got.collect()
    fit = [r for r in rows if r[0] is None or r[0] < 1000]
    x = [[math.floor(64 * c) + 1_000_000 for c in r[1]] for r in fit]
    n, sums, products = slow_sums(x)
    assert len(got) == n * 32 and {r["n"] for r in got} == {n}
    v = np.array([[float(Fraction(n * products[i][j] - sums[i] * sums[j], n * n)) for j in range(40)] for i in range(40)])
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:32], q[:, ::-1][:, :32]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(r, sums, strict=True)] for r in x])
    want = centred @ q / np.sqrt(e)
    of = {}
    for r in got:
        of.setdefault(r["vec_id"], []).append(r)
    assert len(of[5]) == 64
    signs = None
    for k, (i, _, _) in enumerate(fit):
        mine = sorted(of[i], key=lambda r: r["component"])
        assert {r["deviation"] for r in mine} == {sum((n * c - s) ** 2 for c, s in zip(x[k], sums, strict=True))}
        mine = mine[:: len(mine) // 32]
        assert [r["component"] for r in mine] == list(range(1, 33))
        assert [r["explained"] for r in mine] == pytest.approx(e / np.trace(v), rel=1e-9)
        values = np.array([r["whitened"] for r in mine])
        if signs is None:
            signs = np.where(values * want[k] < 0, -1, 1)
        assert values * signs == pytest.approx(want[k], abs=1e-6)
    white = np.array([[r["whitened"] for r in sorted(of[i], key=lambda r: r["component"])[:: len(of[i]) // 32]] for i, _, _ in fit])
    assert np.abs(np.cov(white.T, bias=True) - np.eye(32)).max() < 1e-9
    assert {r["identity_error"] < 1e-9 for r in got} == {True} and len({r["identity_error"] for r in got}) == 1


def test_odd_tables(spark, tables):
    query = registry.QUERIES["op12_whitening"]
    assert query(spark, tables("embeddings", [], SCHEMA)).collect() == []
    assert query(spark, tables("embeddings", [(1, None, 0), (2, [], 0), (3, [math.nan], 0)], SCHEMA)).collect() == []
    one = query(spark, tables("embeddings", [(1, [0.5, 1.5], 0)], SCHEMA)).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 1, 0, 0.0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0, 0.0)]
    line = query(spark, tables("embeddings", [(k, [k / 64, 2 * k / 64], 0) for k in range(4)], SCHEMA)).collect()
    assert sorted((r["component"], round(r["explained"], 9)) for r in line if r["vec_id"] == 0) == [(1, 1.0), (2, 0.0)]
    assert {r["whitened"] for r in line if r["component"] == 2} == {0.0}
    huge = query(spark, tables("embeddings", [(1, [1e15, 0.0], 0), (2, [-1e15, 1.0], 0), (3, [0.0, 2.0], 0)], SCHEMA)).collect()
    assert {r["deviation"] for r in huge if r["vec_id"] != 3} == {None} and all(math.isfinite(r["whitened"]) for r in huge)


def test_added_columns_and_names(spark):
    rows = [(k, [float(k), float(k * k % 7)], "x", k) for k in range(9)]
    table = spark.createDataFrame(rows, "vec_id long, `a.vec` array<double>, n string, `q``t` int")
    got = whitening.whiten(table, ["vec_id", "n", "q`t"], "a.vec", components=1)
    assert got.columns == ["vec_id", "q`t", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.collect()
    assert len(got) == 9 and all(r["q`t"] == r["vec_id"] and len(r["whitened"]) == 1 for r in got)


def test_the_same_however_rows_are_dealt(spark):
    table = spark.createDataFrame(rows_of(500, 6, 3), SCHEMA)
    one, many = (whitening.fit(table.repartition(k, F.rand(1))) for k in (1, 7))
    assert (one.n, one.sums) == (many.n, many.sums) and (one.projection == many.projection).all() and (one.explained == many.explained).all()
