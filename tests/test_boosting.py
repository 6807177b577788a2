"""Boosted trees against plain loops on the same bins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting
from tidemark.operators.boosting import Rules


def slow_split(g, bins, rows, rules):
    """Largest gain over all features, cuts and sides of what is missing; the first of equals."""
    total, best = g[rows].sum(), None
    score = lambda d, n: d * d / (n + rules.l2)
    for k in range(bins.shape[1]):
        b = bins[rows, k]
        for cut in sorted(set(b[b < rules.bins])):
            for missing_left in (True, False):
                left = np.where(b == rules.bins, missing_left, b <= cut)
                n = left.sum()
                if n < rules.least or len(rows) - n < rules.least:
                    continue
                dl = g[rows][left].sum()
                gain = score(dl, n) + score(total - dl, len(rows) - n) - score(total, len(rows))
                if gain > 1e-12 and (best is None or gain > best[0] * (1 + 1e-9) + 1e-15):
                    best = (gain, rows[left], rows[~left])
    return best


def slow_fit(bins, y, rules):
    p = np.full(len(y), y.mean())
    for _ in range(rules.rounds):
        g = np.rint((p - y) * boosting.UNIT) / boosting.UNIT
        leaves = [(slow_split(g, bins, np.arange(len(y)), rules), np.arange(len(y)))]
        while len(leaves) < rules.leaves:
            at = max((k for k in range(len(leaves)) if leaves[k][0]), key=lambda k: leaves[k][0][0], default=None)
            if at is None:
                break
            _, left, right = leaves.pop(at)[0]
            leaves += [(slow_split(g, bins, part, rules), part) for part in (left, right)]
        for _, rows in leaves:
            p[rows] -= rules.rate * g[rows].sum() / (len(rows) + rules.l2)
    return p


@pytest.mark.parametrize("rounds", [1, 12])
def test_trees_equal_plain_loops(spark, rounds):
    rng = np.random.default_rng(rounds)
    rules = Rules(rounds=rounds, rate=0.3, leaves=7, least=8, bins=15)
    rows = []
    for group, n in (("a", 260), ("b", 140), ("c", 10)):
        x = np.round(rng.normal(size=(n, 3)), 2)
        y = np.where(x[:, 0] > 0.3, 1.0, 0) + 0.5 * x[:, 1] * (x[:, 2] > 0) + rng.normal(0, 0.1, n)
        x[rng.random((n, 3)) < 0.15] = np.nan
        rows += [(group, k, float(v), *(None if np.isnan(c) else float(c) for c in r)) for k, (v, r) in enumerate(zip(y, x, strict=True))]
    df = spark.createDataFrame(rows, "grp string, k long, y double, x0 double, x1 double, x2 double").repartition(3)
    model = boosting.fit(df.withColumn("y", F.col("y")), "grp", "y", ["x0", "x1", "x2"], rules)
    got = {(r["grp"], r["k"]): r["score"] for r in boosting.predict(df, model, "grp", ["grp", "k"]).collect()}
    for group in "abc":
        mine = [r for r in rows if r[0] == group]
        x = np.array([[np.nan if v is None else v for v in r[3:]] for r in mine])
        y = np.array([r[2] for r in mine])
        want = slow_fit(model.binned(group, x), y, rules)
        assert np.allclose([got[group, r[1]] for r in mine], want, atol=1e-6)
    again = boosting.fit(df.repartition(5), "grp", "y", ["x0", "x1", "x2"], rules)
    assert again.trees == model.trees


def test_unknown_groups_and_empty_tables(spark):
    df = spark.createDataFrame([("a", float(k), float(k % 2)) for k in range(40)], "g string, y double, x double")
    rules = Rules(rounds=2, least=5)
    model = boosting.fit(df, "g", "y", ["x"], rules)
    other = spark.createDataFrame([("a", 1.0), ("z", 1.0), ("a", None)], "g string, x double")
    got = [r["score"] for r in boosting.predict(other, model, "g", ["g"]).collect()]
    assert got[0] is not None and got[1] is None and got[2] is not None
    none = boosting.fit(df.limit(0), "g", "y", ["x"], rules)
    assert none.trees == {} and {r["score"] for r in boosting.predict(other, none, "g", ["g"]).collect()} == {None}


def test_missing_values_go_where_they_help(spark):
    rows = [(1, 1.0 if k % 3 == 0 else 0.0, None if k % 3 == 0 else float(k % 5)) for k in range(300)]
    df = spark.createDataFrame(rows, "g int, y double, x double")
    model = boosting.fit(df, "g", "y", ["x"], Rules(rounds=1, rate=1.0, leaves=2, least=20))
    got = boosting.predict(df, model, "g", ["y"]).groupBy("y").agg(F.min("score").alias("a"), F.max("score").alias("b")).collect()
    assert all(abs(r["a"] - r["y"]) < 0.02 and r["a"] == r["b"] for r in got)
