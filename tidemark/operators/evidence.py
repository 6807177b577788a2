"""Evidence on targets and picks: distributions, leaks, intervals of daily selections, and the gate on honest exits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions.bands import tick_size
from tidemark.functions.windows import ratio
from tidemark.operators import inference, screen, selection

PERCENTS = (1, 5, 25, 50, 75, 95, 99)
COST = 0.0035
LEAK = 0.15
RECENT, LOCKBOX = "2024-01-01", "2025-03-05"
#: Lower ends of the price buckets; each is closed below and open above.
PRICES = (0, 10, 20, 50, 100, 250)


def target_distributions(panel: DataFrame, targets: list[str], folds: DataFrame, cost: float = COST) -> DataFrame:
    """Per target, pooled (fold null) and per fold: rows, mean, spread, percentiles, shares above zero and above cost, and the market's daily mean, in basis points.

    Rows count inside the test windows only.
    """
    spans = F.broadcast(folds.select("fold", "test_start", "test_end"))  # a handful
    inside = panel.join(spans, F.col("ts").between(F.col("test_start"), F.col("test_end")))
    long = inside.select("ts", "fold", *(F.col(t).try_cast("double").alias(t) for t in targets)).unpivot(["ts", "fold"], targets, "target", "y").filter("y IS NOT NULL")
    share = lambda c: F.avg(c.cast("double")) * 100
    y = F.col("y")
    stats = [F.count("*").alias("n"), (F.avg("y") * 1e4).alias("mean_bp"), (F.stddev_samp("y") * 1e4).alias("sd_bp"), F.percentile("y", F.array(*(F.lit(p / 100) for p in PERCENTS))).alias("_p"), share(y > 0).alias("positive_pct"), share(y > cost).alias("above_cost_pct")]
    rows = long.groupingSets([["target", "fold"], ["target"]], "target", "fold").agg(*stats)
    market = long.groupBy("target", "fold", "ts").agg(F.avg("y").alias("_m")).groupingSets([["target", "fold"], ["target"]], "target", "fold").agg((F.avg("_m") * 1e4).alias("market_mean_bp"))
    met = rows.alias("a").join(market.alias("b"), (F.col("a.target") == F.col("b.target")) & F.col("a.fold").eqNullSafe(F.col("b.fold"))).select("a.*", "b.market_mean_bp")
    return met.withColumns({f"p{p}_bp": F.get("_p", k) * 1e4 for k, p in enumerate(PERCENTS)} | {"market_net_after_cost_bp": F.col("market_mean_bp") - cost * 1e4}).drop("_p")


def leak_stops(panel: DataFrame, features: list[str], targets: list[str], gap: str = "label_gap1", limit: float = LEAK) -> DataFrame:
    """Per feature: the strongest mean IC against a target, that against the next overnight gap, the strongest future correlation, and what is suspect."""
    daily = screen.daily_ic(screen.ranked(screen.cells(panel, features, [*targets, gap])))
    mean = daily.groupBy("feature", "target").agg(F.avg("ic").alias("_ic"))
    against = mean.groupBy("feature").agg(F.coalesce(F.max(F.when(F.col("target") != gap, F.abs("_ic"))), F.lit(0.0)).alias("max_abs_ic_vs_targets"), F.max(F.when(F.col("target") == gap, F.col("_ic"))).alias("ic_vs_gap1"))
    met = screen.leak_table(panel, features, limit=limit).withColumnRenamed("suspect", "suspect_future").join(against, "feature", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    met = met.withColumns({"suspect_target": yes(F.col("max_abs_ic_vs_targets") >= limit), "suspect_gap1": yes(F.abs("ic_vs_gap1") >= limit), "suspect_future": yes(F.col("suspect_future"))})
    return met.withColumn("leak_suspect", F.col("suspect_target") | F.col("suspect_gap1") | F.col("suspect_future"))


def daily_values(scored: DataFrame, n: int, value: str) -> DataFrame:
    """(ts, value): the mean of the first n of each date, among rows whose score and value are known."""
    known = scored.filter(F.col("score").isNotNull() & F.col(value).isNotNull())
    return known.withColumn("_k", F.row_number().over(selection.by_score())).filter(F.col("_k") <= n).groupBy("ts").agg(F.avg(value).alias(value))


def topn_evidence(scored: DataFrame, sizes: tuple[int, ...] = (1, 3, 5), cost: float = COST, **how: float) -> DataFrame:
    """Per size: hit rate and net return of the daily first n, each with its interval, and whether the net one lies above zero."""
    rows = scored.withColumns({"_hit": (F.col("outcome") > 0).cast("double"), "_net": F.col("outcome") - cost})
    day = [daily_values(rows, n, v).select("ts", F.lit(n).alias("top_n"), F.lit(v[1:]).alias("measure"), F.col(v).alias("value")) for n in sizes for v in ("_hit", "_net")]
    series = day[0]
    for d in day[1:]:
        series = series.unionByName(d)
    out = inference.intervals(series, ["top_n", "measure"], "value", **({"level": 0.95, "replicates": 2000} | how))
    return out.withColumn("clears", F.when(F.col("measure") == "net", F.coalesce(F.col("lo") > 0, F.lit(False))))


def pick_profile(scored: DataFrame, columns: list[str], n: int = 3) -> DataFrame:
    """Per column: its median among each date's first n, and among all."""
    known = scored.filter(F.col("score").isNotNull()).withColumn("_top", F.row_number().over(selection.by_score()) <= n)
    long = known.select("_top", *(F.col(c).try_cast("double").alias(c) for c in columns)).unpivot(["_top"], columns, "column", "x").filter("x IS NOT NULL")
    return long.groupBy("column").agg(F.percentile(F.when(F.col("_top"), F.col("x")), 0.5).alias("top_median"), F.percentile("x", 0.5).alias("all_median"))


def price_bucket(price: Column) -> Column:
    """Lower end of the bucket that a price is in."""
    out: Column = F.lit(None).cast("int")
    for low in PRICES:
        out = F.when(price >= low, F.lit(low)).otherwise(out)
    return out


def honest_picks(scored: DataFrame, exits: DataFrame, funds: DataFrame, n: int = 3, cost: float = COST) -> DataFrame:
    """Each date's first n without funds, with the outcome at an exit that could be had, and three nets: of funds, of locks, and of ticks too.

    ``exits`` is ``labels.locked_exit``; ``funds`` has symbol.
    """
    clean = scored.join(F.broadcast(funds.select("symbol").distinct()), "symbol", "left_anti")  # funds are a short list
    top = selection.picks(clean, n)
    met = top.drop("outcome_lock").join(exits.drop("outcome", "score"), ["symbol", "ts"], "left")
    tick = F.coalesce(ratio(tick_size(F.col("ts"), F.col("entry")), "entry"), F.lit(0.0))
    return met.withColumn("tick_cost", tick).withColumns({"net_funds": F.col("outcome") - cost, "net_lock": F.col("outcome_lock") - cost, "net_final": F.col("outcome_lock") - cost - F.col("tick_cost")})


def forensic_gate(picks: DataFrame, daily: DataFrame, cost: float = COST, recent: str = RECENT, lockbox: str = LOCKBOX, **how: float) -> DataFrame:
    """One row: means and intervals of the daily net in every reading, what the picks were like, and the verdict.

    ``picks`` is ``honest_picks``; ``daily`` (ts, market, tick_cost) gives the market's daily mean and
    tick cost, net of which the picks must be.
    """
    day = picks.groupBy("ts").agg(*(F.avg(c).alias(c) for c in ("net_funds", "net_lock", "net_final")))
    day = daily.select("ts", "market", F.col("tick_cost").alias("_tick")).join(day, "ts", "left")
    day = day.withColumns({"final_excess": F.col("net_final") - (F.col("market") - cost - F.coalesce("_tick", F.lit(0.0))), "final_recent": F.when(F.col("ts") >= F.lit(recent).cast("date"), F.col("net_final"))})
    names = ["net_funds", "net_lock", "net_final", "final_excess"]
    long = day.select("ts", *names).unpivot(["ts"], names, "measure", "value")
    wide = inference.intervals(long, ["measure"], "value", **how).groupBy().agg(*(F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{m}_{c}") for m in names for c in ("mean", "lo", "hi")))
    late = day.agg(F.avg("final_recent").alias("final_recent_mean"), F.avg(F.when(F.col("ts") >= F.lit(lockbox).cast("date"), F.col("net_final"))).alias("post_lockbox_mean"))
    flag = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double"))
    best = W.orderBy(F.desc("net_final"), "ts", "symbol")
    # Picks are a few a date, so this window is short; it does not follow the rows of the panel.
    ranked = picks.withColumn("_i", F.when(F.col("net_final").isNotNull(), F.row_number().over(best))).withColumn("_n", F.count("net_final").over(W.partitionBy()))
    top = F.col("_i") <= F.greatest(F.floor(F.col("_n") * 0.05), F.lit(1))
    about = ranked.agg(
        F.count("*").alias("picks"),
        flag("locked_exit").alias("locked_share"),
        F.avg(F.when(F.col("locked_exit"), F.col("outcome_lock") - F.col("outcome")) * 1e4).alias("locked_cost_bp"),
        flag("frozen_entry").alias("frozen_entry_share"),
        flag("entry_lower_band").alias("entry_at_lower_band_share"),
        flag("exit_upper_band").alias("exit_at_upper_band_share"),
        F.avg((F.col("outcome") == 0).cast("double")).alias("zero_outcome_share"),
        (F.avg("tick_cost") * 1e4).alias("tick_cost_bp"),
        F.countDistinct("symbol").alias("distinct_symbols"),
        F.try_divide(F.sum(F.when(top, F.col("net_final"))), F.sum("net_final")).alias("tail_share"),
        (F.avg(F.when(~top, F.col("net_final"))) * 1e4).alias("mean_without_tail_bp"),
    )
    out = wide.crossJoin(late).crossJoin(about)  # one row each
    yes = lambda c: F.coalesce(c, F.lit(False))
    out = out.withColumns({"net_clears": yes(F.col("net_final_lo") > 0), "recent_clears": yes(F.col("final_recent_mean") > 0), "excess_clears": yes(F.col("final_excess_lo") > 0)})
    return out.withColumn("passes", F.col("net_clears") & F.col("recent_clears") & F.col("excess_clears"))


def picks_by(picks: DataFrame, what: Column, name: str) -> DataFrame:
    """Share and mean final net of the picks by a property, such as the price bucket or the year."""
    total = F.sum("picks").over(W.partitionBy())  # a row per value
    return picks.groupBy(what.alias(name)).agg(F.count("*").alias("picks"), (F.avg("net_final") * 1e4).alias("final_net_bp")).withColumn("share", F.col("picks") / total)
