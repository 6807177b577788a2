"""Mixtures against plain loops over rows."""

import numpy as np
import pytest

from tidemark.operators import mixture, state
from tidemark.operators.mixture import Mixture

MODEL = Mixture(np.array([0.3, 0.7]), np.array([[0.0, 0.0, 1.0], [4.0, 4.0, -1.0]]), np.array([[[1.0, 0.3, 0.0], [0.3, 2.0, 0.1], [0.0, 0.1, 0.5]], [[2.0, -0.5, 0.2], [-0.5, 1.0, 0.0], [0.2, 0.0, 1.0]]]))


def slow_density(x, mean, covariance):
    away = x - mean
    return np.exp(-0.5 * away @ np.linalg.inv(covariance) @ away) / np.sqrt(np.linalg.det(2 * np.pi * covariance))


def slow_posterior(model, row):
    seen = [i for i, v in enumerate(row) if v is not None and np.isfinite(v)]
    x = np.array([row[i] for i in seen])
    p = np.array([w * (slow_density(x, m[seen], c[np.ix_(seen, seen)]) if seen else 1.0) for w, m, c in zip(model.weights, model.means, model.covariances, strict=True)])
    return p / p.sum()


def rows_with_gaps():
    rng = np.random.default_rng(3)
    rows = [tuple(float(v) for v in rng.normal(1, 3, 3)) for _ in range(40)]
    for pattern in range(8):
        rows += [tuple(v if pattern >> i & 1 else None for i, v in enumerate(r)) for r in rows[:5]]
    return rows + [(float("nan"), 1.0, float("inf")), (None, None, None)]


@pytest.mark.parametrize("most", [mixture.MOST_BYTES, 0])
def test_posterior_uses_what_is_known(spark, monkeypatch, most):
    """The sent table of all patterns and the dealt join of those that occur give the same."""
    monkeypatch.setattr(mixture, "MOST_BYTES", most)
    rows = rows_with_gaps()
    df = spark.createDataFrame([(k, "z", *r) for k, r in enumerate(rows)], "id int, posterior string, `a.b` double, y double, z double")
    got = mixture.add_posterior(df, ["a.b", "y", "z"], MODEL)
    assert got.columns == ["id", "a.b", "y", "z", "posterior"]
    found = {r["id"]: r["posterior"] for r in got.collect()}
    assert len(found) == len(rows)
    for k, row in enumerate(rows):
        assert found[k] == pytest.approx(slow_posterior(MODEL, row), abs=1e-12)
    assert found[len(rows) - 1] == pytest.approx([0.3, 0.7], abs=1e-15)


def test_posterior_of_no_rows_and_flat_covariances(spark):
    flat = Mixture(np.array([0.5, 0.5]), np.array([[0.0, 0.0], [5.0, 5.0]]), np.stack([np.ones((2, 2))] * 2))
    df = spark.createDataFrame([(0.0, 0.0), (5.0, 5.0)], "x double, y double")
    assert mixture.add_posterior(df.limit(0), ["x", "y"], flat).count() == 0
    p = [r["posterior"][0] for r in mixture.add_posterior(df, ["x", "y"], flat).orderBy("x").collect()]
    assert p[0] > 0.999 and p[1] < 0.001


def slow_fit(x, begun, rounds):
    """Expectation and maximisation, a row and a component at a time."""
    model, before = begun, -np.inf
    for number in range(1, rounds + 1):
        p = np.array([[w * slow_density(v, m, c) for w, m, c in zip(model.weights, model.means, model.covariances, strict=True)] for v in x])
        likelihood = np.log(p.sum(1)).sum()
        if likelihood / len(x) - before < mixture.TOLERANCE:
            break
        before = likelihood / len(x)
        if number == rounds:
            break
        p /= p.sum(1, keepdims=True)
        weights = p.mean(0)
        means = np.array([np.average(x, axis=0, weights=p[:, j]) for j in range(p.shape[1])])
        covariances = np.array([sum(q * np.outer(v - m, v - m) for q, v in zip(p[:, j], x, strict=True)) / p[:, j].sum() for j, m in enumerate(means)]) + mixture.RIDGE * np.eye(x.shape[1])
        model = Mixture(weights, means, covariances)
    return model, likelihood, number


def planted(n=300):
    rng = np.random.default_rng(9)
    own = rng.integers(0, 3, n)
    return np.array([[0.0, 0.0], [6.0, 1.0], [2.0, 7.0]])[own] + rng.normal(0, [0.7, 1.1], (n, 2)), own


def test_fit_equals_plain_loops_and_finds_three(spark):
    x, _ = planted()
    rows = [(float(a), float(b), "other") for a, b in x] + [(None, 1.0, "gap"), (float("nan"), 0.0, "gap"), (0.0, float("inf"), "gap")]
    df = spark.createDataFrame(rows, "a double, b double, note string").repartition(5)
    fits = mixture.fit(df, ["a", "b"], range(1, 6), rounds=40)
    assert list(fits) == [1, 2, 3, 4, 5] and mixture.chosen(fits) == 3
    # All rows are among the first by hash, so the start does not depend on their number here, but on their order by hash.
    order = [(r[0], r[1]) for r in df.dropna().filter("not isnan(a) and b < double('infinity')").selectExpr("a", "b", "xxhash64(0, a, b) AS h").orderBy("h", "a", "b").collect()]
    for k, f in fits.items():
        model, likelihood, number = slow_fit(x, mixture.start(np.array(order), k, 0), 40)
        assert f.rows == len(x) and f.rounds == number and f.log_likelihood == pytest.approx(likelihood, rel=1e-9)
        assert np.allclose(f.mixture.means, model.means) and np.allclose(f.mixture.covariances, model.covariances) and np.allclose(f.mixture.weights, model.weights)
        assert f.bic == pytest.approx(-2 * likelihood + (6 * k - 1) * np.log(len(x)))
    again = mixture.fit(df.repartition(2), ["a", "b"], [3], rounds=40)[3]
    assert np.allclose(again.mixture.means, fits[3].mixture.means, atol=1e-9)
    table = {r["k"]: r for r in mixture.choices_table(df, fits).collect()}
    assert [k for k, r in table.items() if r["chosen"]] == [3]


def test_fit_of_few_equal_or_no_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0)] * 4, "a double, b double")
    fits = mixture.fit(df, ["a", "b"], range(1, 9), rounds=5)
    assert list(fits) == [1, 2, 3] and np.allclose(fits[1].mixture.means, [[1.0, 2.0]])
    assert mixture.fit(df.limit(0), ["a", "b"], [1, 2]) == {}
    assert mixture.choices_table(df, {}).count() == 0


def test_posterior_carried_between_fits(spark):
    x, own = planted()
    df = spark.createDataFrame([(int(o), float(a), float(b)) for o, (a, b) in zip(own, x, strict=True)], "own int, a double, b double")
    one, two = (mixture.fit(df, ["a", "b"], [3], seed=s)[3].mixture for s in (0, 5))
    order, distance = state.align_components(one.means, two.means)
    assert distance < 0.05
    first = mixture.add_posterior(df, ["a", "b"], one, "first")
    both = state.carried(mixture.add_posterior(first, ["a", "b"], two), order)
    assert all(np.argmax(r["first"]) == np.argmax(r["posterior"]) for r in both.collect())
