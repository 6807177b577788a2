"""Hand examples, invariants and point-in-time checks of the panel library."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import bands
from tidemark.functions import windows as win
from tidemark.operators import audit, evidence, features, inference, labels, panel, screen, selection, simulate, state
from tidemark.sources import files

BAR = "symbol string, ts date, open double, high double, low double, close double, volume double"


def days(n):
    return [datetime.date(2021, 1, 4) + datetime.timedelta(days=k) for k in range(n)]


def bars(spark, prices, symbol="A"):
    return spark.createDataFrame([(symbol, t, *map(float, p)) for t, p in zip(days(len(prices)), prices, strict=True)], BAR)


def walk(n, symbols=3, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(symbols):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        open_ = close * np.exp(rng.normal(0, 0.01, n))
        for k, t in enumerate(days(n)):
            top, low = max(open_[k], close[k]) * 1.01, min(open_[k], close[k]) * 0.99
            rows.append((f"S{s}", t, float(open_[k]), float(top), float(low), float(close[k]), float(rng.integers(100, 900))))
    return rows


def test_open_to_close_by_hand(spark):
    rows = [(99, 101, 98, 100, 1), (100, 103, 99, 102, 1), (102, 106, 101, 105, 1), (104, 105, 102, 103, 1), (103, 112, 103, 110, 1), (110, 111, 109, 110, 1), (110, 112, 108, 110, 1)]
    got = labels.open_to_close(bars(spark, rows)).orderBy("ts").first()
    assert [round(got[f"label_oc_{h}"], 9) for h in (1, 2, 3, 5)] == [0.02, 0.05, 0.03, 0.10]
    assert got["label_buyable_o1"] == 1.0


def test_unbuyable_open_and_unknown(spark):
    got = labels.open_to_close(bars(spark, [(100, 100, 100, 100, 1), (105, 105, 104, 105, 1), (0, 1, 0, 1, 1)])).orderBy("ts").collect()
    assert got[0]["label_buyable_o1"] == 0.0
    assert got[1]["label_oc_1"] is None and got[1]["label_buyable_o1"] is None and got[2]["label_oc_1"] is None


def test_bracket_tie_is_the_stop(spark):
    rows = [(100, 100, 100, 100, 1)] + [(100, 106, 96, 100, 1)] * 5
    got = labels.first_touch(bars(spark, rows), (("x", 0.05, 0.03, False),)).orderBy("ts").first()
    assert (got["label_first_x"], got["label_tie_x"], round(got["label_exit_x"], 9)) == (-1, 1, -0.03)


def test_locked_exit_moves_to_the_first_free_open(spark):
    rows = [(100, 101, 99, 100, 1), (100, 101, 99, 100, 1), (90, 90, 90, 90, 1), (81, 81, 81, 81, 1), (85, 86, 84, 85, 1), (85, 86, 84, 85, 1)]
    got = labels.locked_exit(bars(spark, rows), 2).orderBy("ts").first()
    assert got["locked_exit"] and round(got["outcome"], 9) == -0.10 and round(got["outcome_lock"], 9) == -0.15 and got["exit_shift"] == 2


def test_tick_schedule(spark):
    rows = [("2024-01-01", 100.0, 0.05), ("2024-07-01", 100.0, 0.01), ("2024-07-01", 300.0, 0.05), ("2025-05-01", 1000.0, 0.05), ("2025-05-01", 1000.5, 0.1), ("2025-05-01", 30000.0, 5.0)]
    df = spark.createDataFrame(rows, "d string, p double, want double").withColumn("got", bands.tick_size(F.col("d").cast("date"), F.col("p")))
    assert all(abs(x["want"] - x["got"]) < 1e-12 for x in df.collect())


def test_ranks_share_ties_and_skip_unknowns(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 2.0), (1, 3.0), (1, None)], "ts int, x double")
    got = [x["p"] for x in df.withColumn("p", win.percent_rank("x")).orderBy(F.col("x").asc_nulls_last()).collect()]
    assert got == [0.25, 0.625, 0.625, 1.0, None]


def test_streaks(spark):
    rows = [(0, 0, 0, c, 1) for c in (10, 11, 12, 12, 11, 10, 11)]
    df = bars(spark, rows).withColumn("d", F.coalesce(F.col("close") - win.lag("close"), F.lit(0.0)))
    assert [x["s"] for x in win.signed_streak(df, "d", "s").orderBy("ts").collect()] == [0, 1, 2, 0, -1, -2, 1]


def test_features_look_at_nothing_ahead(spark):
    rows = walk(300)
    whole = spark.createDataFrame(rows, BAR)
    cut = days(300)[260]
    bent = spark.createDataFrame([r if r[1] <= cut else (*r[:2], *(x * 7 for x in r[2:])) for r in rows], BAR)
    names = None
    parts = []
    for df in (whole, bent):
        got = features.interactions(features.symbol_features(df)).filter(F.col("ts") <= F.lit(cut))
        names = sorted(features.feature_names(got))
        parts.append(got.select("symbol", "ts", *names).orderBy("symbol", "ts").toPandas())
    assert len(names) >= 100
    for c in names:
        a, b = (p[c].to_numpy(float) for p in parts)
        assert np.allclose(a, b, rtol=1e-9, atol=1e-9, equal_nan=True), c
    assert parts[0]["C_beta_60"].notna().sum() > 0 and parts[0]["ema20"].notna().sum() > 0 if "ema20" in parts[0] else True


def test_recursive_means_equal_pandas(spark):
    rows = walk(160, 1)
    df = spark.createDataFrame(rows, BAR)
    base = features.base(df)
    got = features.recursive(features.with_market(base, features.market(base))).orderBy("ts").toPandas()
    want = pd.Series([r[5] for r in rows]).ewm(span=20, adjust=False, min_periods=20).mean()
    assert np.allclose(got["ema20"], want, equal_nan=True)


def test_exponential_means_with_gaps_equal_pandas(spark):
    rng = np.random.default_rng(1)
    rows = []
    for name, n in (("A", 400), ("B", 64), ("C", 63), ("D", 1), ("E", 129)):
        x = np.round(rng.normal(10, 3, n), 3)
        gone = rng.random(n) < 0.3
        rows += [(name, t, None if g or (name == "A" and k < 70) else float(v)) for k, (t, v, g) in enumerate(zip(days(n), x, gone, strict=True))]
    df = spark.createDataFrame(rows, "symbol string, ts date, close double").repartition(3)
    for span in (2, 20, 400):
        got = features.exponential_mean(df, "close", span, "mean").toPandas().sort_values(["symbol", "ts"])
        assert list(got.columns) == ["symbol", "ts", "close", "mean"] and len(got) == len(rows)
        want = pd.DataFrame(rows, columns=["symbol", "ts", "close"]).groupby("symbol")["close"].transform(lambda x, span=span: x.astype(float).ewm(span=span, adjust=False, min_periods=span).mean())
        assert np.allclose(got["mean"].astype(float), want, rtol=1e-11, equal_nan=True)


def test_delay_equals_least_squares(spark):
    rng = np.random.default_rng(7)
    m = rng.normal(0, 0.01, 200)
    y = 0.8 * m + 0.3 * np.append(0, m[:-1]) + rng.normal(0, 0.01, 200)
    rows = [("A", t, float(a) if k != 30 else None, float(b)) for k, (t, a, b) in enumerate(zip(days(200), y, m, strict=True))]
    got = features.delay(spark.createDataFrame(rows, "symbol string, ts date, lr double, m double")).orderBy("ts").collect()
    x = np.stack([np.ones(200)] + [np.append(np.full(k, np.nan), m[: 200 - k]) for k in range(5)], 1)
    for end in range(1, 201):
        a, b = x[end - 120 : end], y[end - 120 : end]
        if end < 151:
            assert got[end - 1]["C_delay_120"] is None
            continue
        fit = lambda k: (lambda c: (c, 1 - ((b - a[:, :k] @ c) ** 2).sum() / ((b - b.mean()) ** 2).sum()))(np.linalg.lstsq(a[:, :k], b, rcond=None)[0])  # noqa: B023, E731
        (_, narrow), (c, wide) = fit(2), fit(6)
        assert got[end - 1]["C_delay_120"] == pytest.approx(1 - narrow / wide) and got[end - 1]["C_lagbeta_120"] == pytest.approx(c[2:].sum())


def test_pooled_ranks_equal_pandas(spark, monkeypatch):
    from tidemark.functions import ranks

    monkeypatch.setattr(ranks, "HEAVY", 20)
    monkeypatch.setattr(ranks, "RUNS", 7)
    rng = np.random.default_rng(1)
    x = np.where(rng.random(600) < 0.3, 0.0, np.round(rng.normal(0, 1, 600), 2))
    rows = [(f"g{k % 3}", k, float(v) if k % 11 else None) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "g string, k long, x double")
    want = pd.DataFrame(rows, columns=["g", "k", "x"])
    for keys in ([], ["g"]):
        got = ranks.pooled_rank(df, ["x"], keys).toPandas().set_index("k").sort_index()["r_x"]
        ref = want.groupby("g")["x"].rank() if keys else want["x"].rank()
        assert len(got) == 600 and np.allclose(got.to_numpy(float), ref.to_numpy(float), equal_nan=True)


def test_bh_equals_the_plain_loop(spark):
    rng = np.random.default_rng(2)
    p = np.round(rng.random(300), 2)
    rows = [(k, float(v) if k % 7 else None) for k, v in enumerate(p)]
    got = {r["k"]: r["q"] for r in screen.bh_q(spark.createDataFrame(rows, "k long, p double")).collect()}
    known = sorted(v for _, v in rows if v is not None)
    want = {v: min(1.0, min(w * len(known) / (i + 1) for i, w in enumerate(known) if w >= v)) for v in set(known)}
    assert len(got) == 300 and all((got[k] is None) if v is None else got[k] == pytest.approx(want[v]) for k, v in rows)


def world(n=90, symbols=20, seed=3):
    """(symbol, ts, F_a, F_b, F_twin, F_m, y): F_a is right about y, F_twin almost F_a, F_m one value a date."""
    rng = np.random.default_rng(seed)
    rows = []
    for t in days(n):
        m = float(rng.normal())
        for s in range(symbols):
            a = float(rng.normal())
            rows.append((f"S{s:02d}", t, a, float(rng.normal()), a + float(rng.normal(0, 0.05)), m, 0.01 * a + 0.004 * m + float(rng.normal(0, 0.01)), float(rng.normal(0, 0.01))))
    return rows


WORLD = "symbol string, ts date, F_a double, F_b double, F_twin double, F_m double, label_y double, label_z double"
FEATURES, TARGETS = ["F_a", "F_b", "F_twin", "F_m"], ["label_y", "label_z"]


def test_screen_equals_pandas(spark):
    from math import erfc

    rows = world()
    df = spark.createDataFrame(rows, WORLD)
    calendar = df.select("ts").distinct().orderBy("ts").collect()
    folds = selection.tested_folds(spark.createDataFrame([(r["ts"], k) for k, r in enumerate(calendar)], "ts date, session_idx int"))
    got = {(r["feature"], r["target"]): r for r in screen.screen(df, FEATURES, TARGETS, folds).collect()}
    assert set(got) == {(f, t) for f in FEATURES for t in TARGETS}
    p = pd.DataFrame(rows, columns=["symbol", "ts", *FEATURES, *TARGETS])
    ps = {}
    for f in FEATURES[:3]:
        for t in TARGETS:
            ic = p.groupby("ts")[[f, t]].apply(lambda g, f=f, t=t: g[f].rank().corr(g[t].rank()))
            e = (ic - ic.mean()).to_numpy()
            n = len(e)
            var = sum((1 - lag / 21) * (1 if lag == 0 else 2) * (e[lag:] * e[: n - lag]).sum() for lag in range(21)) / n
            stat = ic.mean() / np.sqrt((var if var > 0 else (e * e).mean()) / n)
            r = got[f, t]
            assert r["kind"] == "ranked" and r["mean"] == pytest.approx(ic.mean()) and r["t"] == pytest.approx(stat) and r["n"] == n
            ps[f, t] = erfc(abs(stat) / 2**0.5)
    order = sorted(ps, key=ps.get)
    for i, k in enumerate(order):
        assert got[k]["q"] == pytest.approx(min(1.0, min(ps[j] * 6 / (h + 1) for h, j in enumerate(order) if h >= i)), rel=1e-6)
    assert got["F_a", "label_y"]["passes"] and not got["F_b", "label_y"]["passes"]
    assert got["F_a", "label_y"]["family"] == got["F_twin", "label_y"]["family"] and got["F_b", "label_y"]["family"] is None
    market = got["F_m", "label_y"]
    day = p.groupby("ts")[["F_m", "label_y"]].mean()
    assert market["kind"] == "market" and market["passes"] is None and market["mean"] == pytest.approx(day["F_m"].corr(day["label_y"]))
    pairs = {(r["feature_a"], r["feature_b"]): r["rho"] for r in screen.family_pairs(df, FEATURES[:3], dates=1000).collect()}
    pr = p.groupby("ts")[FEATURES[:3]].rank(pct=True)
    assert pairs["F_a", "F_twin"] == pytest.approx(pr["F_a"].corr(pr["F_twin"]))


def test_nested_screen_pools_over_targets_and_leaves_the_market_out(spark):
    df = spark.createDataFrame(world(120), WORLD).coalesce(1)
    calendar = spark.createDataFrame(list(zip(days(120), range(120), strict=True)), "ts date, session_idx int")
    folds = selection.tested_folds(calendar, 1, 2, 0.7)
    got = state.nested_screen(df, FEATURES, TARGETS, folds)
    rows = got.collect()
    assert {r["feature"] for r in rows} == {"F_a", "F_b", "F_twin"} and {r["target"] for r in rows} == set(TARGETS)
    for fold in {r["fold"] for r in rows}:
        mine = sorted((r for r in rows if r["fold"] == fold), key=lambda r: r["p"])
        assert len(mine) == 6
        for i, r in enumerate(mine):
            assert r["q"] == pytest.approx(min(1.0, min(x["p"] * 6 / (h + 1) for h, x in enumerate(mine) if h >= i)))
            assert r["passes"] == (r["q"] <= 0.1 and r["same_sign"] >= 4)
    assert all(r["passes"] for r in rows if r["feature"] == "F_a" and r["target"] == "label_y")
    led = {(r["fold"], r["feature"]): r["family"] for r in state.nested_leaders(df, got, folds, FEATURES[:3]).filter("target = 'label_y'").collect()}
    assert all(led[f, "F_a"] == led[f, "F_twin"] for f, n in led if n == "F_a")


def test_guards_refuse_what_is_out_of_order(spark, tmp_path):
    path = str(tmp_path / "ledger")
    audit.ledger_append(spark, path, {"kind": "other", "run_id": "X"})
    needs = {"screen": "panel_audit"}
    refused = lambda **k: pytest.raises(audit.Refused, match=k["match"])
    with refused(match="not on record"):
        audit.check_order(audit.ledger(spark, path), "screen", needs)
    audit.ledger_append(spark, path, {"kind": "panel_audit", "run_id": "A1", "passed": False, "manifest_sha": "s"})
    with refused(match="did not pass"):
        audit.check_order(audit.ledger(spark, path), "screen", needs)
    audit.ledger_append(spark, path, {"kind": "panel_audit", "run_id": "A2", "passed": True, "manifest_sha": "s"})
    audit.check_order(audit.ledger(spark, path), "screen", needs, built_at="2000-01-01", sha="s")
    with refused(match="built after"):
        audit.check_order(audit.ledger(spark, path), "screen", needs, built_at="2999-01-01")
    with refused(match="settings changed"):
        audit.check_order(audit.ledger(spark, path), "screen", needs, sha="other")
    audit.ledger_append(spark, path, {"kind": "screen", "run_id": "B1"})
    with refused(match="another run"):
        audit.check_order(audit.ledger(spark, path), "screen", needs)
    audit.check_order(audit.ledger(spark, path), "screen", needs, reason="a bug")
    assert files.latest_run(audit.ledger(spark, path), "panel_audit") == "A2" and files.latest_run(audit.ledger(spark, path), "none") is None
    with refused(match="look ahead"):
        audit.refuse_forward(["D_pos", "label_oc_1"])
    audit.refuse_forward(["D_pos"])
    two = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with refused(match="right side"):
        audit.join_one_to_one(two.limit(1), two, ["k"])


def test_text_formats_come_back(spark, tmp_path):
    df = spark.createDataFrame([(days(2)[0], "A", 1.5), (days(2)[1], "B", None)], "ts date, symbol string, x double")
    files.write_csv(df, str(tmp_path / "t"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "t"), "ts date, symbol string, x double").collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    files.write_json(spark, str(tmp_path / "s"), {"config": {"n": 3, "stops": [0.05]}, "stage": "E"})
    found, sha = files.settings(spark, str(tmp_path / "s"), {"n": 3, "stops": [0.05]})
    assert found["stage"] == "E" and len(sha) == 16
    with pytest.raises(ValueError, match="stops"):
        files.settings(spark, str(tmp_path / "s"), {"n": 3, "stops": [0.08]})
    assert files.schema_difference(["a", "b"], ["b", "c"]) == {"only_a": ["a"], "only_b": ["c"]}
    spark.createDataFrame([("A", 1.0, 2.0)], "symbol string, label_ret double, label_ret_o1 double").write.parquet(str(tmp_path / "p"))
    got = files.panel_labels(spark, str(tmp_path / "p"), ["symbol", "label_ret"], "_o1", F.col("label_ret") > 1)
    assert got.columns == ["symbol", "label_ret"] and got.first()["label_ret"] == 2.0


def test_audits_find_planted_faults(spark):
    base = spark.createDataFrame(walk(80), BAR)
    df = labels.next_open_bracket(labels.with_atr(labels.excursions(labels.open_to_close(base))))
    assert all(r["failed"] == 0 for r in audit.label_audit(df, base).collect())
    bent = df.withColumn("label_oc_3", F.when(F.col("symbol") == "S1", F.col("label_oc_3") + 0.01).otherwise(F.col("label_oc_3")))
    broken = {r["check"] for r in audit.label_audit(bent, base).collect() if r["failed"]}
    assert broken == {"recomputed_oc_3"}
    verdict = lambda new: audit.panel_verdict(base, new, ["symbol", "ts"], "close").first()
    last = days(80)[-10]
    assert verdict(base)["verdict"] == "same"
    assert verdict(base.withColumn("close", F.when(F.col("ts") >= F.lit(last), 0.0).otherwise(F.col("close"))))["verdict"] == "same"
    one = base.withColumn("close", F.when((F.col("ts") == F.lit(days(80)[5])) & (F.col("symbol") == "S0"), 0.0).otherwise(F.col("close")))
    assert verdict(one)["verdict"] == "warn" and verdict(one)["differ"] == 1
    scored = base.select("symbol", "ts", F.col("volume").alias("score"), F.when(F.col("volume") > 200, F.col("close")).alias("outcome"))
    daily = selection.daily_top(scored)
    assert all(r["failed"] == 0 for r in audit.reproduced_ranking(scored, daily).collect())
    assert audit.reproduced_ranking(scored, daily.withColumn("top3_gross", F.col("top3_gross") + 1)).filter("failed > 0").count() == 1
    assert audit.sample_table(base, 3).first()["formula"].endswith("- 1")


def test_forensic_gate_by_hand(spark):
    rows = [(f"S{s}", t, float(s), 0.02 if s == 2 else 0.01, 0.02 if s == 2 else 0.01, 100.0, False) for t in days(40) for s in range(4)]
    scored = spark.createDataFrame([r[:4] for r in rows], "symbol string, ts date, score double, outcome double")
    exits = spark.createDataFrame([(r[0], r[1], r[4], r[5], r[6], False, False, False) for r in rows], "symbol string, ts date, outcome_lock double, entry double, locked_exit boolean, frozen_entry boolean, entry_lower_band boolean, exit_upper_band boolean")
    picks = evidence.honest_picks(scored, exits, spark.createDataFrame([("S3",)], "symbol string"), 1)
    assert {r["symbol"] for r in picks.collect()} == {"S2"}
    market = spark.createDataFrame([(t, 0.011, 0.0005) for t in days(40)], "ts date, market double, tick_cost double")
    got = evidence.forensic_gate(picks, market, recent="2021-01-01", lockbox="2021-01-20", replicates=200).first()
    assert got["net_final_mean"] == pytest.approx(0.02 - 0.0035 - 0.0005) and got["final_excess_mean"] == pytest.approx(0.009)
    assert got["passes"] and got["picks"] == 40 and got["distinct_symbols"] == 1 and got["locked_share"] == 0.0
    buckets = evidence.picks_by(picks, evidence.price_bucket(F.col("entry")), "bucket").collect()
    assert [(r["bucket"], r["share"]) for r in buckets] == [(100, 1.0)]
    hit = {(r["top_n"], r["measure"]): r for r in evidence.topn_evidence(scored, (1,), replicates=200).collect()}
    assert hit[1, "hit"]["mean"] == 1.0 and hit[1, "net"]["clears"] and hit[1, "net"]["mean"] == pytest.approx(0.01 - 0.0035)


def test_hac_equals_a_double_sum(spark):
    x = np.random.default_rng(3).normal(0.1, 1, 80)
    df = spark.createDataFrame([("f", "t", d, float(v)) for d, v in zip(days(80), x, strict=True)], "feature string, target string, ts date, ic double")
    e = x - x.mean()
    total = sum((1 - abs(i - j) / 21) * e[i] * e[j] for i in range(80) for j in range(80) if abs(i - j) <= 20)
    got = screen.hac_t(df).first()
    assert got["t"] == pytest.approx(x.mean() / np.sqrt(total / 80 / 80))


def test_two_sided_p(spark):
    from math import erfc

    got = spark.createDataFrame([(x / 8,) for x in range(-240, 241)] + [(None,)], "t double").withColumn("p", screen.two_sided_p(F.col("t"))).collect()
    for r in got:
        assert (r["p"] is None) if r["t"] is None else r["p"] == pytest.approx(erfc(abs(r["t"]) / 2**0.5), rel=1e-9)


def test_liquidity_floor_needs_history(spark):
    df = bars(spark, [(10, 10, 10, 10, 100)] * 50)
    assert panel.liquidity_floor(df, 500.0).count() == 11


def test_upsert_equals_full_rebuild(spark):
    full = spark.createDataFrame(walk(40), BAR)
    cal = full.select("ts").distinct()
    old = full.filter(F.col("ts") <= F.lit(days(40)[35])).withColumn("close", F.when(F.col("ts") >= F.lit(days(40)[32]), F.col("close") * 2).otherwise(F.col("close")))
    got = panel.upsert_tail(old, full, cal, 10)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, full.collect()))


def test_folds_are_apart(spark):
    cal = spark.createDataFrame([(d, k) for k, d in enumerate(days(100))], "ts date, session_idx int")
    folds = selection.tested_folds(cal).orderBy("fold").collect()
    assert [f["n_sessions"] for f in folds] == [13] * 5
    assert all((f["test_start"] - f["train_end"]).days == 6 for f in folds)


def test_top_n_breaks_ties_by_symbol(spark):
    df = spark.createDataFrame([("b", 1, 1.0, 0.1), ("a", 1, 1.0, 0.2), ("c", 1, None, 9.0)], "symbol string, ts int, score double, outcome double")
    assert [r["symbol"] for r in selection.picks(df, 3).orderBy("rank").collect()] == ["a", "b"]


def slow_interval(x, replicates, block, level, seed):
    """The same resamples with plain loops."""
    from hashlib import md5

    x = [v for v in x if v is not None and np.isfinite(v)]
    n = len(x)
    if n < 2 * block:
        return None, None
    means = []
    for k in range(replicates):
        drawn = []
        for b in range(-(-n // block)):
            start = int(md5(f"{seed}:{k}:{b}".encode()).hexdigest()[:8], 16) % n
            drawn += [x[(start + i) % n] for i in range(block)]
        means.append(np.mean(drawn[:n]))
    return tuple(np.quantile(means, [(1 - level) / 2, (1 + level) / 2]))


def test_bootstrap_covers_and_refuses_short_series(spark):
    rng = np.random.default_rng(0)
    series = {"long": rng.normal(0.5, 1, 400), "short": np.ones(15), "flat": np.ones(33), "exact": rng.normal(0, 1, 40), "empty": [None] * 30}
    series["holes"] = [None if k % 5 == 0 else float("nan") if k % 7 == 0 else float("inf") if k % 11 == 0 else float(k % 13) for k in range(90)]
    rows = [(name, t, None if v is None else float(v)) for name, x in series.items() for t, v in zip(days(len(x)), x, strict=True)]
    daily = spark.createDataFrame(rows, "s string, ts date, v double").repartition(5)
    got = {r["s"]: r for r in inference.intervals(daily, ["s"], "v", replicates=300).collect()}
    assert set(got) == set(series)
    for name, x in series.items():
        known = [v for v in x if v is not None and np.isfinite(v)]
        want = slow_interval(x, 300, 10, 0.9875, 7)
        assert got[name]["n"] == len(known) and got[name]["mean"] == (pytest.approx(np.mean(known)) if known else None)
        assert (got[name]["lo"], got[name]["hi"]) == (want if want[0] is None else pytest.approx(want))
    assert got["short"]["lo"] is None and got["empty"]["lo"] is None
    assert (got["flat"]["lo"], got["flat"]["hi"]) == (1.0, 1.0)
    wide = inference.intervals(daily.filter("s = 'long'"), ["s"], "v", replicates=2000).first()
    assert wide["lo"] < 0.5 < wide["hi"] and wide["hi"] - wide["lo"] < 0.4


def test_rank_correlations_equal_pandas(spark):
    from tidemark.functions.products import rank_correlations

    rng = np.random.default_rng(6)
    rows = []
    for t in days(12):
        for s in range(int(rng.integers(1, 30))):
            a = float(rng.integers(0, 6))
            rows.append((f"S{s}", t, a, None if rng.random() < 0.3 else a + float(rng.normal()), float(rng.normal()) if rng.random() < 0.5 else float("nan"), 1.0, None))
    names = ["a", "b", "c", "flat", "none"]
    df = spark.createDataFrame(rows, "symbol string, ts date, a double, b double, c double, flat double, none double").repartition(3)
    got = {(r["feature_a"], r["feature_b"]): r for r in rank_correlations(df, names).collect()}
    p = pd.DataFrame(rows, columns=["symbol", "ts", *names]).astype(dict.fromkeys(names, float))
    pr = p.groupby("ts")[names].rank(pct=True)
    for i, x in enumerate(names):
        for y in names[i + 1 :]:
            both = pr[[x, y]].dropna()
            if not len(both):
                assert (x, y) not in got
                continue
            assert got[x, y]["n"] == len(both)
            if "flat" in (x, y) and (both[x].std() < 1e-9 or both[y].std() < 1e-9):
                assert got[x, y]["rho"] is None
            else:
                assert got[x, y]["rho"] == pytest.approx(both[x].corr(both[y]))


def test_q_in_groups_and_by_counted_values_agree(spark):
    rng = np.random.default_rng(4)
    rows = [(k, k % 2, float(np.round(rng.random(), 2)) if k % 9 else None) for k in range(200)]
    df = spark.createDataFrame(rows, "k long, g long, p double")
    plain = {r["k"]: r["q"] for r in screen.bh_q(df).collect()}
    window = {r["k"]: r["q"] for r in screen.bh_q(df, most=200).collect()}
    assert plain.keys() == window.keys() and all(plain[k] == (None if window[k] is None else pytest.approx(window[k])) for k in plain)
    halves = {r["k"]: r["q"] for r in screen.bh_q(df, by=("g",)).collect()}
    for g in (0, 1):
        part = {r["k"]: r["q"] for r in screen.bh_q(df.filter(F.col("g") == g)).collect()}
        assert all(halves[k] == (None if q is None else pytest.approx(q)) for k, q in part.items())


def test_impact_of_a_value_below_zero(spark):
    from tidemark.operators import book

    assert book.impact(1.0, -5.0, 10.0, 0.2) == 0.0 and book.impact(0.5, 40.0, 10.0, 0.2) == pytest.approx(0.2)
    df = spark.createDataFrame([(-5.0, 10.0, 0.2), (40.0, 10.0, 0.2), (40.0, 0.0, 0.2), (40.0, 10.0, None)], "v double, adv double, vol double")
    assert [r[0] for r in df.select(book.impact_column(0.5, F.col("v"), F.col("adv"), F.col("vol"))).collect()] == [0.0, pytest.approx(0.2), 0.0, 0.0]


def test_exits_and_brackets(spark):
    rows = [(100, 101, 99, 100, 1), (100, 104, 99, 103, 1), (106, 107, 105, 106, 1), (100, 100, 90, 91, 1), (91, 92, 90, 91, 1), (91, 93, 90, 92, 1)]
    df = simulate.with_path(bars(spark, rows), 10)
    got = df.withColumns({"t": simulate.bracket(4, 0.05, 0.08), "s": simulate.bracket(4, 0.20, 0.08), "x": simulate.plan_exit(4, 0.08), "p": simulate.plan_exit(4), "tr": simulate.trailing_stop(4, 0.05)}).orderBy("ts").first()
    assert got["t"]["kind"] == "target_gap" and got["t"]["ret"] == pytest.approx(0.06)
    assert got["s"]["kind"] == "stop" and got["s"]["ret"] == pytest.approx(-0.08)
    assert got["x"]["kind"] == "stop" and got["x"]["price"] == pytest.approx(92)
    assert got["p"]["kind"] == "close" and got["p"]["price"] == 91
    assert got["tr"]["kind"] == "trail_gap" and got["tr"]["ret"] == pytest.approx(0.0)


def test_never_triggered_bracket_is_the_plain_exit_and_excursions_bound_it(spark):
    df = simulate.path_record(simulate.with_path(spark.createDataFrame(walk(80), BAR), 30).withColumn("b", simulate.bracket(5, 9.0, 0.99)))
    bad = df.filter((F.abs(F.col("b.ret") - F.col("final")) > 1e-12) | (F.col("final") > F.col("mfe") + 1e-12) | (F.col("final") < F.col("mae") - 1e-12))
    assert bad.count() == 0


def test_audit_finds_what_is_wrong(spark):
    df = labels.next_open_bracket(labels.with_atr(labels.excursions(labels.open_to_close(spark.createDataFrame(walk(60), BAR)))))
    assert all(r["failed"] == 0 for r in audit.checks(df, audit.label_rules()).collect())
    hurt = df.withColumn("label_mae", F.lit(1.0))
    assert audit.checks(hurt, audit.label_rules()).filter("check = 'mae_not_above_mfe'").first()["failed"] > 0


def test_ledger_and_manifest(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert audit.ledger_append(spark, path, {"kind": "screen", "run_id": "B_20210101_001"}) == 1
    assert audit.ledger_append(spark, path, {"kind": "screen", "run_id": "B_20210101_002"}) == 2
    assert audit.next_run_id(audit.ledger(spark, path), "B", "20210101") == "B_20210101_003"
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.txt").write_text("one")
    frozen = spark.createDataFrame(audit.manifest(spark, str(tmp_path / "f")).collect())
    (tmp_path / "f" / "a.txt").write_text("two")
    assert [r["status"] for r in audit.verify(frozen, audit.manifest(spark, str(tmp_path / "f"))).collect()] == ["changed"]


def test_stream_gives_the_batch_bars(spark, tmp_path):
    from tidemark.streaming import tail

    t0 = datetime.datetime(2024, 1, 1)
    rows = [(k, t0 + datetime.timedelta(hours=7 * k), "click", float(k % 5)) for k in range(60)]
    schema = "event_id long, ts timestamp, event_type string, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    query = tail.sink(tail.daily_bars(tail.read_events(spark, str(tmp_path / "in"), schema), "1 hour"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    got = {str(r["ts"]): (r["open"], r["close"], r["volume"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    day = [r for r in rows if r[1].date() == datetime.date(2024, 1, 3)]
    assert got["2024-01-03"] == (day[0][3], day[-1][3], len(day))


def test_assignments_are_the_least(spark):
    from itertools import permutations

    rng = np.random.default_rng(5)
    for n in range(1, 8):
        for _ in range(20):
            cost = rng.integers(0, 6, (n, n)).astype(float) if rng.random() < 0.5 else rng.random((n, n))
            got = state.assignment(cost)
            assert sorted(got) == list(range(n))
            assert cost[np.arange(n), got].sum() == pytest.approx(min(sum(cost[i, j] for i, j in enumerate(p)) for p in permutations(range(n))))
    # Of a hidden order and small noise, the order comes back, for as many components as there may be.
    for n in (12, 30):
        means = rng.normal(0, 10, (n, 4))
        hidden = rng.permutation(n)
        order, distance = state.align_components(means, means[hidden] + rng.normal(0, 0.01, (n, 4)))
        assert [int(hidden[k]) for k in order] == list(range(n)) and distance < 0.1
    df = spark.createDataFrame([([0.1, 0.2, 0.7],)], "posterior array<double>")
    assert state.carried(df, [2, 0, 1]).first()["posterior"] == [0.7, 0.1, 0.2]


def test_components_are_aligned():
    ref = np.array([[0.0, 0.0], [5.0, 5.0], [9.0, 0.0]])
    order, drift = state.align_components(ref, ref[[2, 0, 1]] + 0.01)
    assert order == [1, 2, 0] and drift < 0.02


def test_stock_state_refuses_too_few_inputs(spark):
    with pytest.raises(ValueError):
        state.stock_state(spark.createDataFrame([("a", 1, 1.0)], "symbol string, ts int, adx14 double"))


def test_correlations_that_cancel_have_no_sign(spark):
    """0.1, 0.2 and -0.3 add up to 3e-17 or 6e-17, by their order."""
    day = lambda k: datetime.date(2024, 1, k)
    daily = spark.createDataFrame([("f", "t", day(k), ic) for k, ic in enumerate((0.1, 0.2, -0.3, 0.4, 0.4, 0.4), 1)], "feature string, target string, ts date, ic double")
    folds = spark.createDataFrame([(1, day(1), day(3)), (2, day(4), day(6))], "fold int, test_start date, test_end date")
    got = screen.fold_signs(daily, folds).first()
    assert (got["same_sign"], got["n_folds"]) == (1, 2)
