"""What the equity and the trades of scenarios say: returns, drawdown, calendars, regimes, trade statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions.windows import ratio
from tidemark.operators.inference import block_start, finite

PER_YEAR = 250
COST = 0.0035


def _calendar_returns(equity: DataFrame, start: float | Column, *period: Column) -> DataFrame:
    """(scenario, period columns, ret) from the last equity of each period; the first counts from ``start``, or is unknown where that is null."""
    last = equity.groupBy("scenario", *period).agg(F.max_by("equity", "ts").alias("_last"), F.max("ts").alias("_end"))
    before = F.lag("_last").over(W.partitionBy("scenario").orderBy("_end"))
    return last.withColumn("ret", ratio("_last", F.coalesce(before, start if isinstance(start, Column) else F.lit(start))) - 1).drop("_last", "_end")


def performance(equity: DataFrame, per_year: int = PER_YEAR) -> DataFrame:
    """Per scenario: growth, volatility, Sharpe, Sortino, drawdown and its length, Calmar, worst and best periods, losing streak.

    Everything is measured from the first day's equity.  Weeks end on Sunday.
    """
    order = W.partitionBy("scenario").orderBy("ts")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    df = equity.select("scenario", "ts", "equity").withColumns({"_r": ratio("equity", F.lag("equity").over(order)) - 1, "_peak": F.max("equity").over(so_far), "_first": F.first("equity").over(so_far)})
    df = df.withColumns({"_dd": ratio("equity", "_peak") - 1, "_under": (F.col("equity") < F.col("_peak")).cast("int"), "_lose": F.coalesce(F.col("_r") < 0, F.lit(False)).cast("int")})
    df = df.withColumns({"_iu": F.sum(1 - F.col("_under")).over(so_far), "_il": F.sum(1 - F.col("_lose")).over(so_far)})
    df = df.withColumns({"_nu": F.sum("_under").over(W.partitionBy("scenario", "_iu")), "_nl": F.sum("_lose").over(W.partitionBy("scenario", "_il"))})
    g = df.groupBy("scenario").agg(
        F.count("*").alias("days"),
        F.max_by("equity", "ts").alias("final_equity"),
        F.first("_first").alias("_start"),
        F.datediff(F.max("ts"), F.min("ts")).alias("_span"),
        F.avg("_r").alias("_mean"),
        F.stddev_samp("_r").alias("_sd"),
        F.stddev_samp(F.when(F.col("_r") < 0, F.col("_r"))).alias("_down"),
        F.min("_dd").alias("max_dd"),
        F.max("_nu").alias("max_dd_sessions"),
        F.max("_nl").alias("losing_day_streak"),
        F.min("_r").alias("worst_day"),
    )
    # A month's return is against the last equity before it, in the first month against the first equity.
    month = equity.groupBy("scenario", F.date_trunc("month", "ts").alias("month")).agg(F.max_by("equity", "ts").alias("_last"), F.min_by("equity", "ts").alias("_open"))
    month = month.withColumn("ret", ratio("_last", F.coalesce(F.lag("_last").over(W.partitionBy("scenario").orderBy("month")), "_open")) - 1)
    months = month.groupBy("scenario").agg(F.min("ret").alias("worst_month"), F.max("ret").alias("best_month"), F.avg((F.col("ret") > 0).cast("double")).alias("pos_months"))
    weeks = _calendar_returns(equity, F.lit(None).cast("double"), F.date_trunc("week", "ts").alias("week")).groupBy("scenario").agg(F.min("ret").alias("worst_week"))
    growth = F.when(F.col("final_equity") > 0, F.pow(ratio("final_equity", "_start"), 1 / F.greatest(F.col("_span") / 365.25, F.lit(1e-9))) - 1).otherwise(-1.0)
    year = per_year**0.5
    out = g.withColumns({"cagr": growth, "total_return": ratio("final_equity", "_start") - 1, "vol": F.col("_sd") * year, "sharpe": ratio("_mean", "_sd") * year, "sortino": ratio("_mean", "_down") * year})
    out = out.withColumn("calmar", F.when(F.col("max_dd") < 0, ratio("cagr", F.abs("max_dd"))))
    return out.join(months, "scenario", "left").join(weeks, "scenario", "left").drop("_start", "_span", "_mean", "_sd", "_down")


def monthly(equity: DataFrame, start: float) -> DataFrame:
    """Returns by year and month (1 to 12 as columns); the first counts from the starting equity."""
    month = _calendar_returns(equity, start, F.year("ts").alias("year"), F.month("ts").alias("month"))
    return month.groupBy("scenario", "year").pivot("month", list(range(1, 13))).agg(F.first("ret"))


def yearly(equity: DataFrame, start: float) -> DataFrame:
    """Returns by year; the first counts from the starting equity."""
    return _calendar_returns(equity, start, F.year("ts").alias("year"))


def bootstrap_paths(equity: DataFrame, replicates: int = 1000, block: int = 10, seed: int = 7, per_year: int = PER_YEAR) -> DataFrame:
    """Per scenario and measure (cagr, max_dd): 5th, 50th and 95th percentile over circular block resamples of the daily returns.

    A scenario has a row per day and is one array; replicates are rows, and a path is added up from the slices of its blocks. Days without a
    finite return are left out; a scenario without returns has no rows.
    """
    order = W.partitionBy("scenario").orderBy("ts")
    ret = finite(F.log(ratio("equity", F.lag("equity").over(order))))
    known = equity.select("scenario", "ts", ret.alias("_r")).filter("_r IS NOT NULL")
    series = known.groupBy("scenario").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "_r"))), lambda s: s["_r"]).alias("_v")).withColumn("_n", F.size("_v").cast("long"))
    rows = series.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    ring = F.flatten(F.array_repeat("_v", F.ceil(block / F.col("_n")).cast("int") + 1))
    places = F.sequence(F.lit(0), F.ceil(F.col("_n") / block).cast("int") - 1)
    parts = F.transform(places, lambda k: F.slice("_ring", block_start(F.col("replicate"), k, F.col("_n"), seed).cast("int") + 1, block))
    path = F.slice(F.flatten(parts), 1, F.col("_n").cast("int"))
    # The peak starts with the first resampled day.
    begin = F.struct(F.lit(0.0).alias("level"), F.lit(float("-inf")).alias("peak"), F.lit(0.0).alias("worst"))

    def step(acc: Column, x: Column) -> Column:
        level = acc["level"] + x
        peak = F.greatest(acc["peak"], level)
        return F.struct(level.alias("level"), peak.alias("peak"), F.least(acc["worst"], level - peak).alias("worst"))

    ends = rows.withColumn("_ring", ring).withColumn("_end", F.aggregate(path, begin, step))
    out = ends.select("scenario", F.expm1(F.col("_end.level") * per_year / F.col("_n")).alias("cagr"), F.expm1("_end.worst").alias("max_dd")).unpivot(["scenario"], ["cagr", "max_dd"], "measure", "x")
    cuts = F.percentile("x", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return out.groupBy("scenario", "measure").agg(cuts.alias("_p")).select("scenario", "measure", *(F.get("_p", k).alias(n) for k, n in enumerate(("p5", "p50", "p95"))))


def trade_stats(trades: DataFrame) -> DataFrame:
    """Per scenario: win rate, payoff, percentiles, the share of profit that the best 5 % of trades carry, and how trades ended."""
    bp = lambda c: c * 1e4
    best = W.partitionBy("scenario").orderBy(F.desc("pnl"), "entry_day", "symbol", "rank", "ts")
    df = trades.withColumns({"_i": F.row_number().over(best), "_n": F.count(F.lit(1)).over(W.partitionBy("scenario"))})
    top = F.col("_i") <= F.greatest(F.floor(F.col("_n") * 0.05), F.lit(1))
    win, loss = (F.avg(F.when(c, F.col("ret"))) for c in (F.col("ret") > 0, F.col("ret") <= 0))
    total = F.sum("pnl")
    flag = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("long")).alias(c)
    part = F.percentile("ret", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    out = df.groupBy("scenario").agg(
        F.count("*").alias("trades"),
        F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"),
        bp(F.avg("ret")).alias("avg_ret_bp"),
        part.alias("_p"),
        bp(win).alias("avg_win_bp"),
        bp(loss).alias("avg_loss_bp"),
        F.try_divide(win, F.abs(loss)).alias("payoff"),
        F.when(total > 0, F.try_divide(F.sum(F.when(top, F.col("pnl"))), total)).alias("top5pct_share_of_pnl"),
        *(flag(c) for c in ("locked_exit", "stopped", "capped", "data_end")),
        bp(F.avg(F.when(F.col("locked_exit"), F.col("ret")))).alias("avg_locked_exit_bp"),
    )
    return out.withColumns({name: bp(F.get("_p", k)) for k, name in enumerate(("p5_bp", "median_ret_bp", "p95_bp"))}).drop("_p")


def rank_table(candidates: DataFrame, depth: int = 10, cost: float = COST) -> DataFrame:
    """Per rank of one scenario's candidates: trades, mean and median net of a flat cost, without any money."""
    net = F.try_divide(F.col("price"), F.when(F.col("open") > 0, F.col("open"))) - 1 - cost
    known = candidates.filter(F.col("rank") <= depth).withColumn("_net", net).filter("_net IS NOT NULL")
    return known.groupBy("rank").agg(F.count("*").alias("trades"), (F.avg("_net") * 1e4).alias("mean_bp"), (F.percentile("_net", 0.5) * 1e4).alias("median_bp"))


def benchmark(bars: DataFrame, members: DataFrame, calendar: DataFrame) -> DataFrame:
    """(ts, ret, growth): equal weights in the names that were members on the session before and have a bar on both."""
    dated = bars.join(F.broadcast(calendar), "ts").select("symbol", "session_idx", "close")
    before = dated.join(members.join(F.broadcast(calendar), "ts").select("symbol", "session_idx"), ["symbol", "session_idx"], "left_semi")
    before = before.select("symbol", (F.col("session_idx") + 1).alias("session_idx"), F.col("close").alias("_before")).filter("_before > 0")
    day = dated.join(before, ["symbol", "session_idx"]).groupBy("session_idx").agg(F.avg(F.col("close") / F.col("_before") - 1).alias("ret"))
    whole = calendar.join(day, "session_idx", "left").withColumn("ret", F.coalesce("ret", F.lit(0.0)))
    growth = F.exp(F.sum(F.log1p("ret")).over(W.orderBy("ts").rowsBetween(W.unboundedPreceding, 0)))  # a row per session
    return whole.select("ts", "ret", growth.alias("growth"))


def regime_labels(market: DataFrame, window: int = 50, calm: int = 20) -> DataFrame:
    """(ts, trend, vol): yesterday's sign of the benchmark's move over ``window`` sessions, and third of its volatility.

    The thirds are those of the whole series.  What is not known yet counts as down and as high.
    """
    w = W.orderBy("ts")  # a row per session
    ret = ratio("growth", F.lag("growth").over(w)) - 1
    df = market.withColumn("_r", ret).withColumn("_trend", ratio("growth", F.lag("growth", window).over(w)) - 1)
    last = w.rowsBetween(-(calm - 1), 0)
    df = df.withColumn("_vol", F.when(F.count("_r").over(last) >= calm, F.stddev_samp("_r").over(last)))
    df = df.select("ts", F.lag("_trend").over(w).alias("_t"), F.lag("_vol").over(w).alias("_v"))
    cuts = df.agg(F.percentile("_v", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("_q"))
    third = F.when(F.col("_v") <= F.get("_q", 0), "low").when(F.col("_v") <= F.get("_q", 1), "mid").otherwise("high")
    return df.crossJoin(F.broadcast(cuts)).select("ts", F.when(F.col("_t") > 0, "up").otherwise("down").alias("trend"), third.alias("vol"))  # cuts are one row


def regime_table(equity: DataFrame, labels: DataFrame, per_year: int = PER_YEAR) -> DataFrame:
    """Per scenario and regime: days, their share, the mean daily return and what it comes to in a year."""
    r = ratio("equity", F.lag("equity").over(W.partitionBy("scenario").orderBy("ts"))) - 1
    df = equity.withColumn("_r", r).filter("_r IS NOT NULL").join(F.broadcast(labels), "ts").select("scenario", "_r", F.explode(F.array(F.struct(F.lit("trend").alias("kind"), F.col("trend").alias("regime")), F.struct(F.lit("vol").alias("kind"), F.col("vol").alias("regime")))).alias("x"))
    out = df.groupBy("scenario", "x.kind", "x.regime").agg(F.count("*").alias("days"), F.avg("_r").alias("_m"))
    share = F.col("days") / F.sum("days").over(W.partitionBy("scenario", "kind"))
    return out.withColumns({"share": share, "mean_daily_bp": F.col("_m") * 1e4, "annualised": F.pow(1 + F.col("_m"), per_year) - 1}).drop("_m")


def exposure(equity: DataFrame) -> DataFrame:
    """Per scenario: mean invested share and mean number of positions."""
    return equity.groupBy("scenario").agg(F.avg(ratio("invested", "equity")).alias("exposure"), F.avg("positions").alias("avg_positions"))


def summary(scenarios: DataFrame, equity: DataFrame, trades: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per scenario: its rule, its performance, its trades and what they cost."""
    t = trades.groupBy("scenario").agg(F.count("*").alias("trades"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"), (F.avg("ret") * 1e4).alias("avg_trade_bp"), F.sum(F.col("buy_cost") + F.col("sell_cost")).alias("costs_total"))
    out = scenarios
    for part in (performance(equity), exposure(equity), t, counts):
        out = out.join(part, "scenario", "left")
    return out.withColumn("trades", F.coalesce("trades", F.lit(0)))


def path_summary(paths: DataFrame, levels: tuple[int, ...], stops: tuple[int, ...], hold: int = 5, window: int = 10, cost: float = COST) -> dict[str, DataFrame]:
    """Tables on path records (``simulate.path_record`` with rank and atr_frac): excursions, path, targets, stops, giveback, by_rank."""
    bp = lambda c: c * 1e4
    measures = {"mfe": F.col("mfe"), "mae": F.col("mae"), "mfe_atr": F.try_divide(F.col("mfe"), F.when(F.col("atr_frac") > 0, F.col("atr_frac"))), "mae_atr": F.try_divide(F.col("mae"), F.when(F.col("atr_frac") > 0, F.col("atr_frac"))), "final": F.col("final")}
    long = paths.select(F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), v.alias("x")) for k, v in measures.items()))).alias("m")).select("m.*").filter("x IS NOT NULL")
    points = (5, 25, 50, 75, 95)
    excursions = long.groupBy("measure").agg(F.percentile("x", F.array(*(F.lit(p / 100) for p in points))).alias("_p"), F.avg("x").alias("mean")).select("measure", *(F.get("_p", k).alias(f"p{p}") for k, p in enumerate(points)), "mean")
    closes = paths.select(F.explode(F.array(*(F.struct(F.lit(k).alias("session"), F.col(f"close_{k}").alias("x")) for k in range(1, window + 1)))).alias("m")).select("m.*").filter("x IS NOT NULL")
    path = closes.groupBy("session").agg(F.avg("x").alias("mean_close_ret"), F.percentile("x", 0.5).alias("median_close_ret"), F.avg((F.col("x") > 0).cast("double")).alias("share_up"))
    hits = paths.select("final", F.explode(F.array(*(F.struct(F.lit(v).alias("level"), F.col(f"hit_{v}").alias("h")) for v in levels))).alias("m")).select("final", "m.*")
    within = F.coalesce(F.col("h") <= hold, F.lit(False))
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    targets = hits.groupBy("level").agg(share(within).alias("hit_within_hold"), share(F.col("h").isNotNull()).alias("hit_within_window"), F.percentile("h", 0.5).alias("median_sessions_to_hit"), share(F.col("h") == 1).alias("hit_on_session_1"), bp(F.avg(F.when(within, F.col("final"))) - cost).alias("final_net_if_hit_bp"), bp(F.avg(F.when(~within, F.col("final"))) - cost).alias("final_net_if_not_bp"))
    touches = paths.select("final", F.explode(F.array(*(F.struct(F.lit(v).alias("stop"), F.col(f"touch_{v}").isNotNull().alias("t")) for v in stops))).alias("m")).select("final", "m.*")
    won = F.coalesce(F.col("final") > 0, F.lit(False))
    among = lambda c, base: F.sum((c & base).cast("long")) / F.greatest(F.sum(base.cast("long")), F.lit(1))
    stopped = touches.groupBy("stop").agg(share(F.col("t")).alias("touched"), among(F.col("t"), won).alias("winners_touching_first"), among(F.col("t"), ~won).alias("losers_touching"), bp(F.avg(F.when(F.col("t"), F.col("final"))) - cost).alias("final_net_if_touched_bp"))
    up3, up5 = F.col("mfe") >= 0.03, F.col("mfe") >= 0.05
    giveback = paths.agg(F.avg("mfe").alias("mean_mfe"), F.avg("final").alias("mean_final"), F.when(F.avg("mfe") > 0, F.avg("final") / F.avg("mfe")).alias("capture"), among(F.col("final") < 0, up3).alias("up3_closed_negative"), among(F.col("final") < 0.01, up5).alias("up5_closed_below_1pct"))
    by_rank = paths.groupBy("rank").agg(F.count("*").alias("trades"), F.avg("mfe").alias("mfe"), F.avg("mae").alias("mae"), (F.avg("final") - cost).alias("final_net"))
    return {"excursions": excursions, "path": path, "targets": targets, "stops": stopped, "giveback": giveback, "by_rank": by_rank}


def rule_table(rules: DataFrame, cost: float = COST) -> DataFrame:
    """Per bracket rule (rows: rule, year, base, ret, kind, and best, the return if ties went to the target): net, gain over the plain exit, years that beat it, and how trades ended."""
    bp = lambda c: c * 1e4
    year = rules.groupBy("rule", "year").agg(F.avg("ret").alias("_a"), F.avg("base").alias("_b")).groupBy("rule").agg(F.sum((F.col("_a") > F.col("_b")).cast("long")).alias("years_beating"), F.count("*").alias("years"))
    like = lambda *k: F.avg(F.exists(F.array(*map(F.lit, k)), lambda x: F.col("kind").contains(x)).cast("double"))
    table = rules.groupBy("rule").agg(F.count("*").alias("trades"), bp(F.avg("ret") - cost).alias("net_bp"), bp(F.avg("best") - cost).alias("net_best_bp"), bp(F.avg("ret") - F.avg("base")).alias("vs_time_exit_bp"), like("target").alias("target_first"), like("stop", "trail").alias("stop_first"), F.avg((F.col("kind") == "time").cast("double")).alias("time_exit"), F.avg(F.col("kind").endswith("tie").cast("double")).alias("ambiguous"))
    return table.join(year, "rule")
