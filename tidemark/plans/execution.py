"""Queries on exits, orders, the cash book and what comes out of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import windows as win
from tidemark.operators import book, labels, performance, selection, simulate
from tidemark.plans import sql as S
from tidemark.plans.queries import _SCORED, _top, r, register, rs, scores
from tidemark.sources.bars import sessions, trade_bars
from tidemark.sources.tables import materialised

DEPTH = 20


def made_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars from a table, so that the line items are read once, however often a query asks for bars."""
    return materialised(trade_bars(spark, sf_dir))


def lists(bars: DataFrame, engines: set[str]) -> DataFrame:
    """The engines' lists with the turnover known on the day: two scores, and random orders of the same names."""
    adv = bars.withColumn("tv", F.col("close") * F.col("volume")).select("symbol", "ts", win.roll("tv", 60, "median", least=40).alias("adv"))
    parts = [selection.picks(scores(bars, by), DEPTH).select(F.lit(name).alias("engine"), "ts", "rank", "symbol") for name, by in (("main", "volume"), ("second", "close")) if name in engines]
    parts += [selection.random_lists(bars.select("symbol", "ts"), int(e[7:]), DEPTH).select(F.lit(e).alias("engine"), "ts", "rank", "symbol") for e in sorted(engines) if e.startswith("random_")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.join(adv, ["symbol", "ts"], "left")


def entries(bars: DataFrame, ahead: int = 30) -> DataFrame:
    """The main list of a session as entries on the next one, with their path; names without a bar there drop out."""
    chosen = selection.picks(scores(bars), DEPTH).select("symbol", "ts", "rank")
    wanted = book.on_next_session(chosen, sessions(bars))
    return simulate.path_at(wanted.select("symbol", "ts").distinct(), bars, ahead).join(wanted, ["symbol", "ts"])


_WANTED = f"wanted AS (SELECT a.symbol, a.ts AS signal, b.ts, a.rank FROM ({_top('scored', DEPTH)}) a JOIN sess s ON a.ts = s.ts JOIN sess b ON b.session_idx = s.session_idx + 1)"
_NUMBERED = "nb AS (SELECT b.*, max(idx) OVER (PARTITION BY symbol) AS n FROM b)"
#: The bars of an entry from the first on, k counted from 1.
_WALK = "w AS (SELECT e.symbol, e.ts, e.rank, e.signal, x.open AS entry, x.n - x.idx + 1 AS left_bars, v.ts AS day, v.idx - x.idx + 1 AS k, v.open AS o, v.high AS h, v.low AS l, v.close AS c, v.lock_dn = 1 AS cl, v.open_lock_dn = 1 AS ol, v.open = v.high AND v.high = v.low AND v.low = v.close AND v.lock_dn = 1 AS fz FROM wanted e JOIN nb x USING (symbol, ts) JOIN nb v ON v.symbol = e.symbol AND v.idx BETWEEN x.idx AND x.idx + 30)"
_EXIT_CTES = (S.BASE, S.SESSIONS, _SCORED, _WANTED, _NUMBERED, _WALK)


def _plain(hold: int) -> str:
    """The time exit of each entry as (symbol, ts, day, kind, price)."""
    x = f"least(left_bars, {hold})"
    return (
        f"(SELECT symbol, ts, CASE WHEN waits AND free_k IS NOT NULL THEN free_day WHEN waits THEN last_day ELSE x_day END AS day, "
        f"CASE WHEN waits AND free_k IS NOT NULL THEN 'open' ELSE 'close' END AS kind, CASE WHEN waits AND free_k IS NOT NULL THEN free_o WHEN waits THEN last_c ELSE x_c END AS price "
        f"FROM (SELECT symbol, ts, coalesce(bool_or(cl) FILTER (WHERE k = {x}) AND any_value(left_bars) >= {hold}, false) AS waits, min(k) FILTER (WHERE k > {x} AND k <= {x} + 20 AND NOT ol) AS free_k, "
        f"arg_min(day, k) FILTER (WHERE k > {x} AND k <= {x} + 20 AND NOT ol) AS free_day, arg_min(o, k) FILTER (WHERE k > {x} AND k <= {x} + 20 AND NOT ol) AS free_o, "
        f"arg_max(day, k) FILTER (WHERE k <= {x} + 20) AS last_day, arg_max(c, k) FILTER (WHERE k <= {x} + 20) AS last_c, max(day) FILTER (WHERE k = {x}) AS x_day, max(c) FILTER (WHERE k = {x}) AS x_c FROM w GROUP BY symbol, ts))"
    )


_STOP = "s AS (SELECT symbol, ts, arg_min(CASE WHEN k > 1 AND o <= entry * 0.92 THEN 'open' ELSE 'stop' END, k) AS kind, arg_min(CASE WHEN k > 1 AND o <= entry * 0.92 THEN o ELSE entry * 0.92 END, k) AS price FROM w WHERE k <= 5 AND NOT fz AND ((k > 1 AND o <= entry * 0.92) OR l <= entry * 0.92) GROUP BY symbol, ts)"


# Prices are exact quotients that may end in a five at any digit, so they are compared as they are.
@register("l09_time_and_stop_exits", S.query("SELECT symbol, ts, rank, px.day, px.kind, px.price AS price, coalesce(s.kind, px.kind) AS stop_kind, coalesce(s.price, px.price) AS stop_price FROM (SELECT DISTINCT symbol, ts, rank FROM w) JOIN px USING (symbol, ts) LEFT JOIN s USING (symbol, ts)", *_EXIT_CTES, f"px AS {_plain(5)}", _STOP))
def l09(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = entries(made_bars(spark, sf_dir)).withColumns({"plain": simulate.plan_exit(5), "stopped": simulate.plan_exit(5, 0.08)})
    return df.select("symbol", "ts", "rank", F.col("plain.day").alias("day"), F.col("plain.kind").alias("kind"), F.col("plain.price").alias("price"), F.col("stopped.kind").alias("stop_kind"), F.col("stopped.price").alias("stop_price"))


# The declared targets and stops in percent and in average true ranges, and the trailing stops.
TARGETS, STOPS, ATR_TARGETS, ATR_STOPS, TRAILING = (0.02, 0.03, 0.05, 0.08, 0.10, 0.15), (0.03, 0.05, 0.08, 0.10), (1.0, 1.5, 2.0, 3.0), (1.0, 1.5, 2.0), (0.05, 0.08, 0.12)


def ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of the first three entries of a session under every bracket: rule, year, base, ret, kind, best."""
    bars = made_bars(spark, sf_dir)
    atr = labels.with_atr(bars).select("symbol", F.col("ts").alias("signal"), F.col("atr_pct").alias("atr_frac"))
    df = entries(bars).filter("rank <= 3").join(atr, ["symbol", "signal"], "left")
    base = F.try_divide(simulate.plan_exit(5)["price"], F.col("open")) - 1
    name = lambda unit, t, s: f"{unit}_{t:g}_{s:g}"
    rules = {name("pct", t, s): (F.lit(t), F.lit(s)) for t in TARGETS for s in STOPS} | {name("atr", t, s): (t * F.col("atr_frac"), s * F.col("atr_frac")) for t in ATR_TARGETS for s in ATR_STOPS}
    cells = [F.struct(F.lit(k).alias("rule"), simulate.bracket(5, t, s).alias("a"), simulate.bracket(5, t, s, "optimistic")["ret"].alias("best")) for k, (t, s) in rules.items()]
    trail = [F.struct(F.lit(f"trail_{x:g}").alias("rule"), simulate.trailing_stop(5, x).alias("a"), simulate.trailing_stop(5, x)["ret"].alias("best")) for x in TRAILING]
    long = df.select("symbol", "ts", F.year("signal").alias("year"), base.alias("base"), F.explode(F.array(*cells, *trail)).alias("x"))
    return long.select("symbol", "ts", "year", "base", "x.rule", "x.a.ret", "x.a.kind", "x.best").filter("ret IS NOT NULL")


def _bracket_sql(t: float, s: float) -> str:
    up, down = f"entry * (1 + {t!r}::DOUBLE)", f"entry * (1 - {s!r}::DOUBLE)"
    kind = f"CASE WHEN k > 1 AND o >= {up} THEN 'target_gap' WHEN k > 1 AND o <= {down} THEN 'stop_gap' WHEN h >= {up} AND l <= {down} THEN 'stop_tie' WHEN h >= {up} THEN 'target' WHEN l <= {down} THEN 'stop' END"
    ret = f"CASE WHEN k > 1 AND (o >= {up} OR o <= {down}) THEN o / entry - 1 WHEN l <= {down} THEN -{s!r}::DOUBLE WHEN h >= {up} THEN {t!r}::DOUBLE END"
    return f"SELECT 'pct_{t:g}_{s:g}' AS rule, coalesce(hit.ret, px.price / entry - 1) AS ret, coalesce(hit.kind, 'time') AS kind FROM (SELECT DISTINCT symbol, ts, entry FROM w WHERE rank <= 3) LEFT JOIN px USING (symbol, ts) LEFT JOIN (SELECT symbol, ts, arg_min(kind, k) AS kind, arg_min(ret, k) AS ret FROM (SELECT symbol, ts, k, {kind} AS kind, {ret} AS ret FROM w WHERE k <= 5) WHERE kind IS NOT NULL GROUP BY symbol, ts) hit USING (symbol, ts)"


# Bars frozen at the lower band do not occur in these tables, so the SQL leaves late sales out.
@register("e14_bracket_rules", S.query("SELECT rule, kind, count(*) AS trades, round(avg(ret), 6) + 0.0 AS mean_ret FROM (" + " UNION ALL ".join(_bracket_sql(t, s) for t in TARGETS for s in STOPS) + ") WHERE ret IS NOT NULL GROUP BY rule, kind", *_EXIT_CTES, f"px AS {_plain(5)}"))
def e14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ruled(spark, sf_dir).filter("rule LIKE 'pct%'").groupBy("rule", "kind").agg(F.count("*").alias("trades"), r(F.avg("ret")).alias("mean_ret"))


@register("e15_rule_table")
def e15(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = performance.rule_table(ruled(spark, sf_dir))
    return df.select("rule", "trades", "years", "years_beating", *rs(["net_bp", "net_best_bp", "vs_time_exit_bp", "target_first", "stop_first", "time_exit", "ambiguous"], 4))


HITS, TOUCHES = (2, 3, 5, 8, 10, 15, 20), (3, 5, 8, 10)


def recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = made_bars(spark, sf_dir)
    atr = labels.with_atr(bars).select("symbol", F.col("ts").alias("signal"), F.col("atr_pct").alias("atr_frac"))
    df = entries(bars).filter("rank <= 3").join(atr, ["symbol", "signal"], "left")
    return simulate.path_record(df, levels=tuple(v / 100 for v in HITS), stops=tuple(v / 100 for v in TOUCHES)).drop("path")


@register("l12_path_records", S.query("SELECT symbol, ts, rank, " + S.rounded({"mfe": "max(h) FILTER (WHERE k <= 5) / any_value(entry) - 1", "mae": "min(l) FILTER (WHERE k <= 5) / any_value(entry) - 1", "mfe_w": "max(h) FILTER (WHERE k <= 10) / any_value(entry) - 1", "close_1": "max(c) FILTER (WHERE k = 1) / any_value(entry) - 1", "close_7": "max(c) FILTER (WHERE k = 7) / any_value(entry) - 1"}) + ", (min(k) FILTER (WHERE k <= 10 AND h >= entry * (1 + 0.05::DOUBLE)))::INT AS hit_5, (min(k) FILTER (WHERE k <= 5 AND l <= entry * (1 - 0.03::DOUBLE)))::INT AS touch_3, list_position(list(h ORDER BY k) FILTER (WHERE k <= 5), max(h) FILTER (WHERE k <= 5))::INT AS day_mfe FROM w WHERE rank <= 3 GROUP BY symbol, ts, rank", *_EXIT_CTES))
def l12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recorded(spark, sf_dir).select("symbol", "ts", "rank", *rs(["mfe", "mae", "mfe_w", "close_1", "close_7"]), "hit_5", "touch_3", "day_mfe")


_TARGET_ROWS = "t AS (" + " UNION ALL ".join(f"SELECT {v} AS level, px.price / entry - 1 AS final, h FROM (SELECT symbol, ts, rank, any_value(entry) AS entry, min(k) FILTER (WHERE k <= 10 AND h >= entry * (1 + {v / 100}::DOUBLE)) AS h FROM w WHERE rank <= 3 GROUP BY 1, 2, 3) JOIN px USING (symbol, ts)" for v in HITS) + ")"


@register("e15_path_targets", S.query("SELECT level, " + S.rounded({"hit_within_hold": "avg(coalesce(h <= 5, false)::INT)", "hit_within_window": "avg((h IS NOT NULL)::INT)", "median_sessions_to_hit": "quantile_cont(h, 0.5)", "hit_on_session_1": "avg(coalesce(h = 1, false)::INT)", "final_net_if_hit_bp": "(avg(final) FILTER (h <= 5) - 0.0035) * 1e4", "final_net_if_not_bp": "(avg(final) FILTER (h IS NULL OR h > 5) - 0.0035) * 1e4"}, 4) + " FROM t GROUP BY level", *_EXIT_CTES, f"px AS {_plain(5)}", _TARGET_ROWS))
def e15b(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = performance.path_summary(recorded(spark, sf_dir), HITS, TOUCHES)["targets"]
    return df.select("level", *rs([c for c in df.columns if c != "level"], 4))


@register("e15_path_by_rank", S.query("SELECT rank, count(*) AS trades, " + S.rounded({"mfe": "avg(mfe)", "mae": "avg(mae)", "final_net": "avg(price / entry - 1) - 0.0035"}) + " FROM (SELECT symbol, ts, rank, any_value(entry) AS entry, max(h) FILTER (WHERE k <= 5) / any_value(entry) - 1 AS mfe, min(l) FILTER (WHERE k <= 5) / any_value(entry) - 1 AS mae FROM w WHERE rank <= 3 GROUP BY 1, 2, 3) JOIN px USING (symbol, ts) GROUP BY rank", *_EXIT_CTES, f"px AS {_plain(5)}"))
def e15c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return performance.path_summary(recorded(spark, sf_dir), HITS, TOUCHES)["by_rank"].select("rank", "trades", *rs(["mfe", "mae", "final_net"]))


def _cost(kind: str) -> str:
    fees = "v * 0.0000332 * 1.18"
    return f"v * 0.00115 + {fees}" if kind == "buy" else f"v * 0.001 + {fees}"


@register("e01_costs", "SELECT o_orderkey AS orderkey, " + S.rounded({"buy": _cost("buy"), "sell": _cost("sell")}, 4) + " FROM (SELECT o_orderkey, o_totalprice AS v FROM orders)")
def e01(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("o_totalprice")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("orderkey"), r(book.buy_cost(v), 4).alias("buy"), r(book.sell_cost(v), 4).alias("sell"))


@register("e02_impact", S.query("SELECT symbol, ts, round(CASE WHEN adv > 0 AND vol IS NOT NULL THEN 0.5 * vol * sqrt(100000 / adv) ELSE 0 END, 6) + 0.0 AS impact FROM (SELECT symbol, ts, " + S.roll("tv", 60, "median", 40) + " AS adv, " + S.roll("r", 20, "std") + " AS vol FROM (SELECT *, close * volume AS tv FROM (SELECT symbol, ts, close, volume, r FROM b)))", S.BASE))
def e02(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trade_bars(spark, sf_dir).withColumns({"tv": F.col("close") * F.col("volume"), "ret": win.ratio("close", win.lag("close")) - 1})
    df = df.withColumns({"adv": win.roll("tv", 60, "median", least=40), "vol": win.roll("ret", 20, "std")})
    return df.select("symbol", "ts", r(book.impact_column(0.5, F.lit(1e5), F.col("adv"), F.col("vol"))).alias("impact"))


@register("e03_tick_slippage", S.query("SELECT symbol, ts, costs, round(n_in * " + S.tick("ts", "open") + " / open, 8) + 0.0 AS entry, round(n_out * " + S.tick("ts", "close") + " / close, 8) + 0.0 AS exit FROM bars CROSS JOIN (VALUES ('flat', 0, 0), ('base', 0, 1), ('stress', 1, 1)) v(costs, n_in, n_out)"))
def e03(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trade_bars(spark, sf_dir).withColumn("costs", F.explode(F.array(*map(F.lit, book.SLIPPAGE))))
    slip = lambda side, price: r(book.tick_slip(F.col("costs"), side, F.col("ts"), F.col(price)), 8)
    return df.select("symbol", "ts", "costs", slip("entry", "open").alias("entry"), slip("exit", "close").alias("exit"))


@register("e05_scenarios")
def e05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.scenario_set(spark)


_ANY = ("primary", "second", "flat", "stress", "once", "stop_8", "random_0")


def orders(spark: SparkSession, sf_dir: str, names: tuple[str, ...] | None = _ANY, bars: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Candidates, bars, calendar and scenarios."""
    bars, plans = bars or made_bars(spark, sf_dir), book.scenario_set(spark)
    plans = plans if names is None else plans.filter(F.col("scenario").isin(*names))
    calendar = sessions(bars)
    engines = {r["engine"] for r in plans.select("engine").distinct().collect()}  # a few dozen
    return book.orders(lists(bars, engines), bars, calendar, plans), bars, calendar, plans


def books(spark: SparkSession, sf_dir: str, names: tuple[str, ...] | None = _ANY, bars: DataFrame | None = None) -> DataFrame:
    """The books from a table: candidates are asked for twice, and days, trades and counts several times."""
    candidates, *rest = orders(spark, sf_dir, names, bars)
    return materialised(book.simulate(materialised(candidates), *rest))


@register("e17_candidates", S.query("SELECT e.signal, e.ts, e.rank, e.symbol, round(x.open, 6) + 0.0 AS open, px.day, px.kind FROM wanted e LEFT JOIN bars x USING (symbol, ts) LEFT JOIN px USING (symbol, ts)", *_EXIT_CTES, f"px AS {_plain(5)}"))
def e17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir, ("primary",))[0].select("signal", "ts", "rank", "symbol", r("open").alias("open"), "day", "kind")


@register("e13_picks_with_replacement", S.query("SELECT signal, ts, symbol, (row_number() OVER (PARTITION BY ts ORDER BY rank))::INT AS place FROM wanted WHERE EXISTS (SELECT 1 FROM bars x WHERE x.symbol = wanted.symbol AND x.ts = wanted.ts) QUALIFY place <= 3", *_EXIT_CTES))
def e13(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = made_bars(spark, sf_dir)
    wanted = book.on_next_session(selection.picks(scores(bars), DEPTH).select("symbol", "ts", "rank"), sessions(bars))
    return selection.with_replacement(wanted, bars, 3).select("signal", "ts", "symbol", "place")


@register("e04_portfolio_equity")
def e04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.days(books(spark, sf_dir)).select("scenario", "ts", *rs(["equity", "cash", "invested"], 2), "positions")


@register("e04_trades")
def e04b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.trades(books(spark, sf_dir))


@register("e05_split_scenario")
def e05b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.combined(book.days(books(spark, sf_dir, ("split_a", "split_b"))), "split", ["split_a", "split_b"])


@register("e06_performance")
def e06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return performance.performance(book.days(books(spark, sf_dir)))


@register("e07_bootstrap_paths")
def e07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return performance.bootstrap_paths(book.days(books(spark, sf_dir, ("primary",))))


@register("e08_trade_stats")
def e08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return performance.trade_stats(book.trades(books(spark, sf_dir)))


@register("e09_rank_table", S.query("SELECT rank, count(*) AS trades, round(avg(net) * 1e4, 4) + 0.0 AS mean_bp, round(quantile_cont(net, 0.5) * 1e4, 4) + 0.0 AS median_bp FROM (SELECT rank, px.price / x.open - 1 - 0.0035 AS net FROM wanted JOIN bars x USING (symbol, ts) JOIN px USING (symbol, ts) WHERE x.open > 0 AND rank <= 10) GROUP BY rank", *_EXIT_CTES, f"px AS {_plain(5)}"))
def e09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return performance.rank_table(orders(spark, sf_dir, ("primary",))[0]).select("rank", "trades", r("mean_bp", 4).alias("mean_bp"), r("median_bp", 4).alias("median_bp"))


_BENCH = "bench AS (SELECT s.ts, coalesce(avg(a.close / p.close - 1), 0) AS ret FROM sess s LEFT JOIN (SELECT * FROM bars JOIN sess USING (ts)) a ON a.session_idx = s.session_idx LEFT JOIN (SELECT * FROM bars JOIN sess USING (ts) WHERE close > 0) p ON p.symbol = a.symbol AND p.session_idx = s.session_idx - 1 GROUP BY s.ts), grown AS (SELECT ts, ret, exp(sum(ln(1 + ret)) OVER (ORDER BY ts)) AS growth FROM bench)"


def market(spark: SparkSession, sf_dir: str, bars: DataFrame | None = None) -> DataFrame:
    bars = bars or made_bars(spark, sf_dir)
    return performance.benchmark(bars, bars.select("symbol", "ts"), sessions(bars))


# The statistics of equity again on the benchmark's growth, a dated series that SQL makes too; as it grows beyond all measure, some are logarithms.
def market_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market(spark, sf_dir).select(F.lit("market").alias("scenario"), "ts", F.col("growth").alias("equity"))


_EQ = "q AS (SELECT ts, growth AS e, growth / lag(growth) OVER (ORDER BY ts) - 1 AS r, max(growth) OVER (ORDER BY ts) AS peak FROM grown)"
_STREAKS = "q2 AS (SELECT *, sum(1 - (e < peak)::INT) OVER (ORDER BY ts) AS iu, sum(1 - coalesce(r < 0, false)::INT) OVER (ORDER BY ts) AS il FROM q), q3 AS (SELECT *, sum((e < peak)::INT) OVER (PARTITION BY iu) AS nu, sum(coalesce(r < 0, false)::INT) OVER (PARTITION BY il) AS nl FROM q2)"
_MONTHS = "mo AS (SELECT m, l / coalesce(lag(l) OVER (ORDER BY m), o) - 1 AS ret FROM (SELECT date_trunc('month', ts) AS m, arg_max(growth, ts) AS l, arg_min(growth, ts) AS o FROM grown GROUP BY 1)), wk AS (SELECT l / lag(l) OVER (ORDER BY w) - 1 AS ret FROM (SELECT date_trunc('week', ts) AS w, arg_max(growth, ts) AS l FROM grown GROUP BY 1))"
_PERF = {"log_growth": "ln(last / first)", "max_dd": "dd", "worst_day": "wd", "log_cagr": "ln(last / first) * 365.25 / span", "vol": "sd * sqrt(250)", "sharpe": "mean / sd * sqrt(250)", "sortino": "mean / down * sqrt(250)", "worst_month": "wm", "best_month": "bm", "pos_months": "pm", "worst_week": "ww"}


@register("e06_benchmark_performance", S.query(
    "SELECT days, max_dd_sessions, losing_day_streak, " + S.rounded(_PERF, 4) + " FROM (SELECT count(*) AS days, arg_max(e, ts) AS last, arg_min(e, ts) AS first, max(ts) - min(ts) AS span, avg(r) AS mean, stddev_samp(r) AS sd, stddev_samp(r) FILTER (WHERE r < 0) AS down, min(e / peak - 1) AS dd, max(nu)::BIGINT AS max_dd_sessions, max(nl)::BIGINT AS losing_day_streak, min(r) AS wd FROM q3), (SELECT min(ret) AS wm, max(ret) AS bm, avg((ret > 0)::INT) AS pm FROM mo), (SELECT min(ret) AS ww FROM wk)",
    S.SESSIONS, _BENCH, _EQ, _STREAKS, _MONTHS,
))
def e06b(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = performance.performance(market_equity(spark, sf_dir)).withColumns({"log_growth": F.log1p("total_return"), "log_cagr": F.log1p("cagr")})
    return out.select("days", F.col("max_dd_sessions").cast("long").alias("max_dd_sessions"), F.col("losing_day_streak").cast("long").alias("losing_day_streak"), *(r(c, 4).alias(c) for c in _PERF))


@register("e07_benchmark_paths", S.query(
    "SELECT 'market' AS scenario, measure, round(ln(1 + quantile_cont(x, 0.05)), 4) + 0.0 AS p5, round(ln(1 + quantile_cont(x, 0.5)), 4) + 0.0 AS p50, round(ln(1 + quantile_cont(x, 0.95)), 4) + 0.0 AS p95 FROM (SELECT unnest(['cagr', 'max_dd']) AS measure, unnest([exp(level * 250 / n) - 1, exp(worst) - 1]) AS x FROM (SELECT k, any_value(n) AS n, arg_max(level, i) AS level, min(level - peak) AS worst FROM lv GROUP BY k)) GROUP BY measure",
    S.SESSIONS, _BENCH, _EQ, "vv AS (SELECT list(ln(1 + r) ORDER BY ts) AS v, count(*) AS n FROM q WHERE r IS NOT NULL)",
    "pa AS (SELECT k, n, flatten(list_transform(range((n + 9) // 10), lambda b: list_concat(v, v)[(('0x' || substr(md5('7:' || k || ':' || b), 1, 8))::BIGINT % n + 1)::BIGINT:(('0x' || substr(md5('7:' || k || ':' || b), 1, 8))::BIGINT % n + 10)::BIGINT]))[1:n] AS p FROM vv, range(1000) AS z(k))",
    "st AS (SELECT k, n, unnest(p) AS x, unnest(range(n)) AS i FROM pa)", "le AS (SELECT k, n, i, sum(x) OVER (PARTITION BY k ORDER BY i) AS level FROM st)", "lv AS (SELECT *, max(level) OVER (PARTITION BY k ORDER BY i) AS peak FROM le)",
))
def e07b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return performance.bootstrap_paths(market_equity(spark, sf_dir)).select("scenario", "measure", *(r(F.log1p(c), 4).alias(c) for c in ("p5", "p50", "p95")))


_LASTS = "la AS (SELECT y, m, l / coalesce(lag(l) OVER (ORDER BY y, m), 1.0) - 1 AS ret FROM (SELECT year(ts)::INT AS y, month(ts) AS m, arg_max(growth, ts) AS l FROM grown GROUP BY 1, 2))"


@register("e12_benchmark_months", S.query("SELECT y AS year, " + ", ".join(f"round(max(ret) FILTER (WHERE m = {k}), 6) + 0.0 AS m{k}" for k in range(1, 13)) + " FROM la GROUP BY y", S.SESSIONS, _BENCH, _LASTS))
def e12b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return performance.monthly(market_equity(spark, sf_dir), 1.0).select("year", *(r(F.col(f"`{k}`")).alias(f"m{k}") for k in range(1, 13)))


@register("e12_benchmark_years", S.query("SELECT year, round(ln(l / coalesce(lag(l) OVER (ORDER BY year), 1.0)), 6) + 0.0 AS log_ret FROM (SELECT year(ts)::INT AS year, arg_max(growth, ts) AS l FROM grown GROUP BY 1)", S.SESSIONS, _BENCH))
def e12c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return performance.yearly(market_equity(spark, sf_dir), 1.0).select("year", r(F.log1p("ret")).alias("log_ret"))



@register("e10_equal_weight_benchmark", S.query("SELECT ts, " + S.rounded({"ret": "ret", "log_growth": "ln(growth)"}) + " FROM grown", S.SESSIONS, _BENCH))
def e10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market(spark, sf_dir).select("ts", r("ret").alias("ret"), r(F.log("growth")).alias("log_growth"))


_REGIME = "rg AS (SELECT ts, lag(t) OVER (ORDER BY ts) AS t, lag(v) OVER (ORDER BY ts) AS v FROM (SELECT ts, growth / lag(growth, 50) OVER (ORDER BY ts) - 1 AS t, CASE WHEN count(r) OVER w >= 20 THEN stddev_samp(r) OVER w END AS v FROM (SELECT ts, growth, growth / lag(growth) OVER (ORDER BY ts) - 1 AS r FROM grown) WINDOW w AS (ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)))"


@register("w27_regime_labels", S.query("SELECT ts, CASE WHEN t > 0 THEN 'up' ELSE 'down' END AS trend, CASE WHEN v <= (SELECT quantile_cont(v, 1 / 3) FROM rg) THEN 'low' WHEN v <= (SELECT quantile_cont(v, 2 / 3) FROM rg) THEN 'mid' ELSE 'high' END AS vol FROM rg", S.SESSIONS, _BENCH, _REGIME))
def w27(spark: SparkSession, sf_dir: str) -> DataFrame:
    return performance.regime_labels(market(spark, sf_dir))


@register("e11_regime_table")
def e11(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = made_bars(spark, sf_dir)
    return performance.regime_table(book.days(books(spark, sf_dir, bars=bars)), performance.regime_labels(market(spark, sf_dir, bars)))


@register("e12_monthly_returns")
def e12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return performance.monthly(book.days(books(spark, sf_dir, ("primary",))), 1e6)


@register("e12_yearly_returns")
def e12b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return performance.yearly(book.days(books(spark, sf_dir, ("primary",))), 1e6)


@register("a14_exposure")
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return performance.exposure(book.days(books(spark, sf_dir)))


@register("e16_summary")
def e16(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = books(spark, sf_dir)
    plans = book.scenario_set(spark).filter(F.col("scenario").isin(*_ANY))
    return performance.summary(plans, book.days(done), book.trades(done), book.counts(done))
