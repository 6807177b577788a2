"""The cash book by hand, and the statistics of equity and trades against pandas."""

import datetime
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import book, performance, simulate
from tidemark.plans import execution
from tidemark.plans.catalog import QUERIES

BAR = "symbol string, ts date, open double, high double, low double, close double, volume double"
LIST = "engine string, ts date, rank int, symbol string, adv double"
NAMES = [c.split()[0] for c in book.SCENARIO.split(", ")]


def days(n, start=datetime.date(2023, 3, 1)):
    return [start + datetime.timedelta(days=k) for k in range(n)]


def plans(spark, *changes):
    base = dict(scenario="x", engine="main", n=1, hold=2, capital=100_000.0, costs="base", cap=None, stop=None, duplicates=True, whole=True)
    return spark.createDataFrame([tuple((base | c)[k] for k in NAMES) for c in changes or [{}]], book.SCENARIO)


def calendar(spark, n):
    return spark.createDataFrame(list(zip(days(n), range(n), strict=True)), "ts date, session_idx int")


def run(spark, rows, lists, scenarios, n):
    bars = spark.createDataFrame(rows, BAR)
    asked = book.orders(spark.createDataFrame(lists, LIST), bars, calendar(spark, n), scenarios)
    return book.simulate(asked, bars, calendar(spark, n), scenarios)


def flat(symbol, prices):
    return [(symbol, t, float(o), float(max(o, c)) + 1, float(min(o, c)) - 1, float(c), 1000.0) for t, (o, c) in zip(days(len(prices)), prices, strict=True) if o]


def test_costs_by_hand():
    assert book.buy_cost(100_000.0) == pytest.approx(100 + 15 + 3.22 + 0.1 + 0.18 * (3.22 + 0.1))
    assert book.sell_cost(110_000.0) + book.DEPOSITORY == pytest.approx(110 + 3.542 + 0.11 + 0.18 * (3.542 + 0.11) + 15.93)


def test_a_trade_by_hand(spark):
    """Bought at the next session's open for half of the equity, sold at the close of the second session held."""
    rows = flat("A", [(100, 100), (100, 102), (103, 110), (111, 111), (111, 111)])
    lists = [("main", days(5)[0], 1, "A", 1e9)]
    done = run(spark, rows, lists, plans(spark), 5).cache()
    trade = book.trades(done).collect()
    assert len(trade) == 1
    t = trade[0]
    assert (t["entry_day"], t["ts"], t["kind"], t["shares"]) == (days(5)[1], days(5)[2], "close", 500)
    assert t["buy_value"] == 50_000 and t["buy_cost"] == pytest.approx(book.buy_cost(50_000.0))
    # One tick is lost at the exit; there is no volatility yet, so no impact.
    assert t["exit_fill"] == pytest.approx(110 - 0.05) and t["sell_value"] == pytest.approx(500 * 109.95)
    assert t["sell_cost"] == pytest.approx(book.sell_cost(500 * 109.95) + book.DEPOSITORY)
    assert t["pnl"] == pytest.approx(t["sell_value"] - t["sell_cost"] - 50_000 - t["buy_cost"]) and t["raw_ret"] == pytest.approx(0.1)
    by = {r["ts"]: r for r in book.days(done).collect()}
    assert by[days(5)[0]]["equity"] == 100_000 and by[days(5)[1]]["positions"] == 1
    assert by[days(5)[1]]["equity"] == pytest.approx(50_000 - t["buy_cost"] + 500 * 102)
    assert by[days(5)[4]]["equity"] == pytest.approx(100_000 + t["pnl"]) and by[days(5)[4]]["positions"] == 0
    assert book.counts(done).first().asDict() == {"scenario": "x", "orders": 1, "filled": 1, "replaced": 0, "capped_orders": 0, "cash_limited": 0}


def test_the_flat_convention_gives_the_plain_net(spark):
    rows = flat("A", [(100, 100), (100, 102), (103, 110), (111, 111)])
    done = run(spark, rows, [("main", days(4)[0], 1, "A", None)], plans(spark, {"costs": "flat", "whole": False}), 4)
    t = book.trades(done).first()
    assert t["ret"] == pytest.approx(0.1 - 0.0035) and t["shares"] == pytest.approx(500.0)


def test_names_without_a_bar_are_replaced_and_turnover_caps(spark):
    rows = flat("A", [(100, 100), (0, 0), (100, 100), (100, 100)]) + flat("B", [(50, 50), (50, 50), (50, 50), (50, 50)]) + flat("C", [(10, 10)] * 4)
    first = days(4)[0]
    lists = [("main", first, 1, "A", 1e9), ("main", first, 2, "B", 100_000.0), ("main", first, 3, "C", 1e9)]
    done = run(spark, rows, lists, plans(spark, {"cap": 0.02}, {"scenario": "two", "n": 2, "cap": 0.02}), 4).cache()
    t = book.trades(done).filter("scenario = 'x'").collect()
    assert [(r["symbol"], r["rank"], r["shares"], r["capped"]) for r in t] == [("B", 2, 40, True)]
    assert {r["symbol"] for r in book.trades(done).filter("scenario = 'two'").collect()} == {"B", "C"}
    counts = {r["scenario"]: r for r in book.counts(done).collect()}
    assert counts["x"]["replaced"] == 1 and counts["x"]["capped_orders"] == 1 and counts["two"]["filled"] == 2


def test_held_names_are_skipped_without_duplicates(spark):
    rows = flat("A", [(100, 100)] * 8) + flat("B", [(50, 50)] * 8)
    lists = [("main", d, k, s, 1e9) for d in days(8)[:4] for k, s in ((1, "A"), (2, "B"))]
    done = run(spark, rows, lists, plans(spark, {"hold": 4, "duplicates": False}, {"scenario": "many", "hold": 4}), 8).cache()
    bought = lambda name: [r["symbol"] for r in book.trades(done).filter(F.col("scenario") == name).orderBy("entry_day").collect()]
    assert bought("many") == ["A"] * 4 and bought("x") == ["A", "B"]


def test_stops_and_locked_exits(spark):
    rows = flat("A", [(100, 100), (100, 101), (102, 96)])
    c = 96 * 0.95
    rows += [("A", days(6)[3], 93.0, 94.0, c, c, 1.0), ("A", days(6)[4], c * 0.95, c * 0.95, c * 0.95, c * 0.95, 1.0), ("A", days(6)[5], 88.0, 90.0, 87.0, 89.0, 1.0)]
    lists = [("main", days(6)[0], 1, "A", 1e9)]
    scenarios = plans(spark, {"hold": 3}, {"scenario": "stopped", "hold": 3, "stop": 0.05})
    got = {r["scenario"]: r for r in book.trades(run(spark, rows, lists, scenarios, 6)).collect()}
    assert got["stopped"]["stopped"] and got["stopped"]["exit_price"] == pytest.approx(95.0) and got["stopped"]["ts"] == days(6)[2]
    # The close is locked at the lower band and the day after is frozen there, so the sale is at the open after that.
    assert got["x"]["locked_exit"] and got["x"]["kind"] == "open" and got["x"]["ts"] == days(6)[5] and got["x"]["exit_price"] == 88.0


def test_books_balance_and_cash_never_runs_out(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(6):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.03, 60)))
        rows += [(f"S{k}", t, float(c * 1.001), float(c * 1.02), float(c * 0.98), float(c), 500.0) for t, c in zip(days(60), close, strict=True) if rng.random() > 0.1]
    lists = [("main", t, r + 1, f"S{s}", 1e6) for t in days(60) for r, s in enumerate(rng.permutation(6))]
    done = run(spark, rows, lists, plans(spark, {"n": 2, "hold": 3, "costs": "stress", "cap": 0.02}), 60).cache()
    got = book.days(done).orderBy("ts").collect()
    assert len(got) == 60 and all(abs(r["equity"] - r["cash"] - r["invested"]) < 1e-6 and r["cash"] >= 0 for r in got)
    trades = book.trades(done).toPandas()
    still = done.filter("what = 'day'").orderBy(F.desc("ts")).first()["positions"]
    assert len(trades) + still == book.counts(done).first()["filled"]
    # What came in and what was lost adds up to the last equity, but for positions still open.
    if not still:
        assert got[-1]["equity"] == pytest.approx(100_000 + trades["pnl"].sum())
    stats = performance.trade_stats(book.trades(done)).first()
    assert stats["trades"] == len(trades) and stats["win_rate"] == pytest.approx((trades["ret"] > 0).mean())
    assert stats["median_ret_bp"] == pytest.approx(trades["ret"].median() * 1e4) and stats["p95_bp"] == pytest.approx(np.percentile(trades["ret"], 95) * 1e4)
    best = np.sort(trades["pnl"].to_numpy())[::-1]
    if best.sum() > 0:
        assert stats["top5pct_share_of_pnl"] == pytest.approx(best[: max(int(len(best) * 0.05), 1)].sum() / best.sum())


def equity_of(spark, values, start=datetime.date(2023, 1, 20)):
    rows = [("x", t, float(v), 0.0, float(v), 1) for t, v in zip(days(len(values), start), values, strict=True)]
    return spark.createDataFrame(rows, "scenario string, ts date, equity double, cash double, invested double, positions int")


def test_performance_equals_pandas(spark):
    rng = np.random.default_rng(1)
    values = 1e6 * np.exp(np.cumsum(np.append(0, rng.normal(0, 0.01, 200))))
    df = equity_of(spark, values)
    got = performance.performance(df).first()
    e = pd.Series(values, index=pd.DatetimeIndex(days(201, datetime.date(2023, 1, 20))))
    r = e.pct_change().dropna()
    years = (e.index[-1] - e.index[0]).days / 365.25
    dd = e / e.cummax() - 1
    month = e.resample("ME").last().pct_change()
    month.iloc[0] = e.resample("ME").last().iloc[0] / e.iloc[0] - 1
    want = {"cagr": (e.iloc[-1] / e.iloc[0]) ** (1 / years) - 1, "vol": r.std() * 250**0.5, "sharpe": r.mean() / r.std() * 250**0.5, "sortino": r.mean() / r[r < 0].std() * 250**0.5, "max_dd": dd.min(), "worst_day": r.min(), "worst_week": e.resample("W").last().pct_change().min(), "worst_month": month.min(), "best_month": month.max(), "pos_months": (month > 0).mean(), "days": 201}
    for k, v in want.items():
        assert got[k] == pytest.approx(v), k
    under, run_, longest, lose, streak = dd < 0, 0, 0, 0, 0
    for u, x in zip(under, [0, *r], strict=True):
        run_, lose = (run_ + 1 if u else 0), (lose + 1 if x < 0 else 0)
        longest, streak = max(longest, run_), max(streak, lose)
    assert got["max_dd_sessions"] == longest and got["losing_day_streak"] == streak
    assert got["calmar"] == pytest.approx(got["cagr"] / -got["max_dd"])


def test_calendars_start_from_the_capital(spark):
    df = equity_of(spark, [100.0] * 10 + [110.0] * 20 + [99.0] * 5)
    year = performance.yearly(df, 80.0).first()
    assert year["ret"] == pytest.approx(99 / 80 - 1)
    month = performance.monthly(df, 80.0).first()
    assert month["1"] == pytest.approx(110 / 80 - 1) and month["2"] == pytest.approx(99 / 110 - 1)


def test_bootstrap_of_a_steady_path_is_that_path(spark):
    df = equity_of(spark, [100 * 1.001**k for k in range(120)])
    got = {r["measure"]: r for r in performance.bootstrap_paths(df, 50).collect()}
    assert got["cagr"]["p5"] == pytest.approx(1.001**250 - 1) and got["cagr"]["p95"] == pytest.approx(1.001**250 - 1)
    assert got["max_dd"]["p50"] == pytest.approx(0.0)


def test_regimes_by_hand(spark):
    market = spark.createDataFrame([(t, 1.0 + 0.01 * k if k < 70 else 1.7 - 0.01 * (k - 70)) for k, t in enumerate(days(140))], "ts date, growth double")
    labels = {r["ts"]: r for r in performance.regime_labels(market).collect()}
    assert labels[days(140)[20]]["trend"] == "down" and labels[days(140)[60]]["trend"] == "up" and labels[days(140)[139]]["trend"] == "down"
    df = equity_of(spark, [100 + k for k in range(140)], days(1)[0])
    table = performance.regime_table(df, spark.createDataFrame([tuple(r) for r in labels.values()], "ts date, trend string, vol string"))
    assert sum(r["days"] for r in table.filter("kind = 'trend'").collect()) == 139
    assert sum(r["share"] for r in table.filter("kind = 'vol'").collect()) == pytest.approx(1.0)


def test_benchmark_uses_yesterdays_members(spark):
    rows = flat("A", [(10, 10), (10, 11), (11, 11)]) + flat("B", [(10, 10), (10, 20), (20, 40)])
    members = spark.createDataFrame([("A", days(3)[0]), ("B", days(3)[1])], "symbol string, ts date")
    got = performance.benchmark(spark.createDataFrame(rows, BAR), members, calendar(spark, 3)).orderBy("ts").collect()
    assert [r["ret"] for r in got] == pytest.approx([0.0, 0.1, 1.0]) and got[-1]["growth"] == pytest.approx(2.2)


def test_scenarios_fan_out(spark):
    df = book.scenario_set(spark)
    names = [r["scenario"] for r in df.collect()]
    assert len(names) == len(set(names)) == 7 + 3 + 8 + 30 + 10
    both = equity_of(spark, [1.0, 2.0]).unionByName(equity_of(spark, [3.0, 4.0]).withColumn("scenario", F.lit("y")))
    assert [r["equity"] for r in book.combined(both, "s", ["x", "y"]).orderBy("ts").collect()] == [4.0, 6.0]


def test_paths_only_of_entries_equal_those_of_all_bars(spark):
    rng = np.random.default_rng(2)
    rows = flat("A", [(100 + x, 100 + y) for x, y in rng.normal(0, 5, (40, 2))])
    df = spark.createDataFrame(rows, BAR)
    some = df.filter(F.dayofmonth("ts") % 3 == 0).select("symbol", "ts")
    got = {r["ts"]: [b["o"] for b in r["path"]] for r in simulate.path_at(some, df, 7).collect()}
    want = {r["ts"]: [b["o"] for b in r["path"]] for r in simulate.with_path(df, 7).join(some, ["symbol", "ts"]).collect()}
    assert got == want and len(got) == some.count()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", ["e16_summary", "e11_regime_table"])
def test_line_items_are_read_once(spark, name, monkeypatch):
    made = []
    found = execution.trade_bars
    monkeypatch.setattr(execution, "trade_bars", lambda *a: made.append(a) or found(*a))
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(made) == 1
    assert "lineitem" not in df._jdf.queryExecution().optimizedPlan().toString().lower() and "l_shipdate" not in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_trades_do_not_sort_all_line_items(spark, monkeypatch):
    made = []
    found = execution.materialised
    monkeypatch.setattr(execution, "materialised", lambda df: made.append(df._jdf.queryExecution().executedPlan().toString()) or found(df))
    QUERIES["e04_trades"](spark, "/root/testdata/sf0.001")
    over_items = [p for p in made if "l_orderkey" in p]
    assert len(over_items) == 1
    assert "HashAggregate(keys=[symbol#" in over_items[0] and ", l_shipdate#" in over_items[0].split("HashAggregate(keys=[symbol#")[1].split("]")[0]
