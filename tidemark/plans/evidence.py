"""Queries on evidence, audits, and the remaining scans and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions import windows as win
from tidemark.operators import audit, evidence, labels, selection
from tidemark.plans import sql as S
from tidemark.plans.queries import _FEATURES, _FOLDS, _PANEL, _SCORED, _SCREEN, _draw, _oc, r, register, rs, scored, screen_panel
from tidemark.sources import files
from tidemark.sources.bars import sessions, table, trade_bars, with_sessions

_TARGETS = ("label_oc_1", "label_oc_5")
_PCT = {f"p{p}_bp": f"quantile_cont(y, {p / 100}) * 1e4" for p in evidence.PERCENTS}
_YS = "ys AS (" + " UNION ALL ".join(f"SELECT '{t}' AS target, fold, ts, {t} AS y FROM panel JOIN folds ON ts BETWEEN test_start AND test_end WHERE {t} IS NOT NULL" for t in _TARGETS) + ")"
_SETS = "GROUPING SETS ((target, fold), (target))"


@register("i10_target_distributions", S.query(f"SELECT a.*, round(m, 4) + 0.0 AS market_mean_bp FROM (SELECT target, fold, count(*) AS n, " + S.rounded({"mean_bp": "avg(y) * 1e4", "sd_bp": "stddev_samp(y) * 1e4", **_PCT, "positive_pct": "avg((y > 0)::INT) * 100", "above_cost_pct": "avg((y > 0.0035)::INT) * 100"}, 4) + f" FROM ys GROUP BY {_SETS}) a JOIN (SELECT target, fold, avg(m) * 1e4 AS m FROM (SELECT target, fold, ts, avg(y) AS m FROM ys GROUP BY 1, 2, 3) GROUP BY {_SETS}) b ON a.target = b.target AND a.fold IS NOT DISTINCT FROM b.fold", S.SESSIONS, _PANEL, _FOLDS, _YS))
def i10(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = selection.tested_folds(sessions(trade_bars(spark, sf_dir)))
    df = evidence.target_distributions(screen_panel(spark, sf_dir), list(_TARGETS), folds)
    return df.select("target", "fold", "n", *rs(["mean_bp", "sd_bp", *_PCT, "positive_pct", "above_cost_pct", "market_mean_bp"], 4))


_GAP = "gp AS (SELECT *, lead(open) OVER (PARTITION BY symbol ORDER BY ts) / nullif(close, 0) - 1 AS gap FROM bars)"
_LONG_GAP = "lg AS (" + " UNION ALL ".join(f"SELECT ts, '{f}' AS feature, ({e})::DOUBLE AS x, gap AS y FROM gp WHERE ({e}) IS NOT NULL AND gap IS NOT NULL" for f, e in _FEATURES.items()) + ")"
_IC_GAP = f"ig AS (SELECT feature, avg(ic) AS g FROM (SELECT feature, ts, CASE WHEN max(rx) > min(rx) AND max(ry) > min(ry) THEN corr(rx, ry) END AS ic FROM (SELECT *, {S.rank('x', 'feature', 'ts')} AS rx, {S.rank('y', 'feature', 'ts')} AS ry FROM lg) GROUP BY 1, 2 HAVING count(*) >= 15) GROUP BY feature)"


def gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen_panel(spark, sf_dir).withColumn("label_gap1", win.ratio(win.lead("open"), "close") - 1)


@register("i13_leak_stops", S.query("SELECT feature, " + S.rounded({"max_abs_ic_vs_targets": "t", "ic_vs_gap1": "g"}) + ", t >= 0.15 AS suspect_target, abs(g) >= 0.15 AS suspect_gap1 FROM ig JOIN (SELECT feature, max(abs(m)) AS t FROM (SELECT feature, target, avg(ic) AS m FROM ic GROUP BY 1, 2) GROUP BY 1) USING (feature)", *_SCREEN, _GAP, _LONG_GAP, _IC_GAP))
def i13(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = evidence.leak_stops(gapped(spark, sf_dir), list(_FEATURES), list(_TARGETS))
    return df.select("feature", r("max_abs_ic_vs_targets").alias("max_abs_ic_vs_targets"), r("ic_vs_gap1").alias("ic_vs_gap1"), "suspect_target", "suspect_gap1")


_DAILY = "dn AS (SELECT ts, avg(outcome) FILTER (WHERE k <= 3) AS v FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY score DESC NULLS LAST, symbol) AS k FROM scored WHERE score IS NOT NULL AND outcome IS NOT NULL) GROUP BY ts)"


@register("i15_daily_values", S.query("SELECT ts, round(v, 6) + 0.0 AS outcome FROM dn", _SCORED, _DAILY))
def i15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.daily_values(scored(spark, sf_dir), 3, "outcome").select("ts", r("outcome").alias("outcome"))


_TOPN = "topn AS (" + " UNION ALL ".join(f"SELECT {n} AS top_n, '{m}' AS measure, ts, avg({x}) AS v FROM k WHERE k <= {n} GROUP BY ts" for n in (1, 3, 5) for m, x in (("hit", "(outcome > 0)::INT"), ("net", "outcome - 0.0035"))) + ")"
_KNOWN = "k AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY score DESC NULLS LAST, symbol) AS k FROM scored WHERE score IS NOT NULL AND outcome IS NOT NULL)"


@register("i15_topn_evidence", S.query("SELECT top_n, measure, n, " + S.rounded({"mean": "mean", "lo": "lo", "hi": "hi"}, 8) + ", CASE WHEN measure = 'net' THEN coalesce(lo > 0, false) END AS clears FROM boot", _SCORED, _KNOWN, _TOPN, S.resampled("boot", "topn", "top_n, measure", "v", 2000, level=0.95)))
def i15b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.topn_evidence(scored(spark, sf_dir)).select("top_n", "measure", "n", r("mean", 8).alias("mean"), r("lo", 8).alias("lo"), r("hi", 8).alias("hi"), "clears")


def honest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three a date without one brand that stands for the funds."""
    bars = trade_bars(spark, sf_dir)
    funds = bars.filter("symbol = 'Brand#11'").select("symbol")
    exits = labels.locked_exit(bars, 2)
    mine = scored(spark, sf_dir).drop("outcome").join(exits.select("symbol", "ts", "outcome"), ["symbol", "ts"], "left")
    return evidence.honest_picks(mine, exits, funds)


@register("i17_honest_picks", S.query(f"SELECT symbol, ts, rank, round(outcome - 0.0035, 6) + 0.0 AS net_funds, round({S.tick('ts', 'entry')} / entry, 8) + 0.0 AS tick_cost FROM (SELECT s.symbol, s.ts, (row_number() OVER (PARTITION BY s.ts ORDER BY score DESC NULLS LAST, s.symbol))::INT AS rank, outcome, entry FROM scored s JOIN (SELECT symbol, ts, lead(open) OVER (PARTITION BY symbol ORDER BY ts) AS entry FROM bars) e USING (symbol, ts) WHERE score IS NOT NULL AND s.symbol <> 'Brand#11' QUALIFY rank <= 3)", _SCORED))
def i17(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = honest(spark, sf_dir)
    return df.select("symbol", "ts", "rank", r("net_funds").alias("net_funds"), r(F.when(F.col("entry") > 0, F.col("tick_cost")), 8).alias("tick_cost"))


@register("i17_forensic_gate")
def i17b(spark: SparkSession, sf_dir: str) -> DataFrame:
    market = scored(spark, sf_dir).groupBy("ts").agg(F.avg("outcome").alias("market"), F.lit(0.0).alias("tick_cost"))
    return evidence.forensic_gate(honest(spark, sf_dir), market, recent="1999-01-01", lockbox="2000-01-01", replicates=2000)


@register("r03_price_buckets_of_picks", S.query("SELECT bucket, count(*) AS picks, round(count(*) / sum(count(*)) OVER (), 6) + 0.0 AS share FROM (SELECT s.ts, s.symbol, CASE " + " ".join(f"WHEN entry >= {low} THEN {low}" for low in reversed(evidence.PRICES)) + " END AS bucket, row_number() OVER (PARTITION BY s.ts ORDER BY score DESC NULLS LAST, s.symbol) AS rank FROM scored s JOIN (SELECT symbol, ts, lead(open) OVER (PARTITION BY symbol ORDER BY ts) AS entry FROM bars) e USING (symbol, ts) WHERE score IS NOT NULL AND s.symbol <> 'Brand#11' QUALIFY rank <= 3) GROUP BY bucket", _SCORED))
def r03b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.picks_by(honest(spark, sf_dir), evidence.price_bucket(F.col("entry")), "bucket").select("bucket", "picks", r("share").alias("share"))


@register("i29_pick_profile", S.query("SELECT 'volume' AS \"column\", round(quantile_cont(volume, 0.5) FILTER (WHERE k <= 3), 4) + 0.0 AS top_median, round(quantile_cont(volume, 0.5), 4) + 0.0 AS all_median FROM (SELECT bars.*, row_number() OVER (PARTITION BY ts ORDER BY score DESC NULLS LAST, symbol) AS k FROM bars JOIN scored USING (symbol, ts) WHERE score IS NOT NULL) UNION ALL SELECT 'close', round(quantile_cont(close, 0.5) FILTER (WHERE k <= 3), 4) + 0.0, round(quantile_cont(close, 0.5), 4) + 0.0 FROM (SELECT bars.*, row_number() OVER (PARTITION BY ts ORDER BY score DESC NULLS LAST, symbol) AS k FROM bars JOIN scored USING (symbol, ts) WHERE score IS NOT NULL)", _SCORED))
def i29(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir).join(trade_bars(spark, sf_dir).select("symbol", "ts", "volume", "close"), ["symbol", "ts"])
    return evidence.pick_profile(df, ["volume", "close"]).select("column", r("top_median", 4).alias("top_median"), r("all_median", 4).alias("all_median"))


# --- audits --------------------------------------------------------------------------------------


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.next_open_bracket(labels.with_atr(labels.excursions(labels.open_to_close(trade_bars(spark, sf_dir)))))


_CHECKS = ("mae_not_above_mfe", "return_within_excursions", "buyable_is_flag", "entries_agree", "recomputed_oc_1", "recomputed_oc_2", "recomputed_oc_3", "recomputed_oc_5", "recomputed_gap1")


@register("q01_label_audit", S.query("SELECT * FROM (VALUES " + ", ".join(f"('{c}')" for c in _CHECKS) + ") v(\"check\") CROSS JOIN (SELECT 0::BIGINT AS failed, count(*) AS seen FROM bars)"))
def q01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.label_audit(labelled(spark, sf_dir), trade_bars(spark, sf_dir))


_LEAD = lambda c: f"lead({c}) OVER (PARTITION BY symbol ORDER BY ts)"
_UPPER = f"abs({_LEAD('open')} - {_LEAD('high')}) <= 1e-6 * greatest(abs({_LEAD('open')}), abs({_LEAD('high')})) AND {S.at_band(_LEAD('open') + ' / close - 1', 'close')}"
_BUY = f"CASE WHEN {_LEAD('open')} > 0 AND {_LEAD('high')} IS NOT NULL AND close > 0 THEN CASE WHEN {_UPPER} THEN 0 ELSE 1 END END"


@register("q01_exclusions_by_year", S.query(f"SELECT year(ts)::INT AS year, count(*) AS rows, count(*) FILTER (WHERE b = 0) AS unbuyable, count(*) FILTER (WHERE b IS NULL) AS unknown, count(*) FILTER (WHERE y IS NULL) AS without_outcome FROM (SELECT ts, {_BUY} AS b, {_oc(5)} AS y FROM bars) GROUP BY 1"))
def q01b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.exclusions(labelled(spark, sf_dir), F.year("ts"), "year")


@register("q01_market_terciles", S.query("SELECT ts, ntile(3) OVER (ORDER BY m, ts)::INT - 1 AS tercile FROM (SELECT ts, avg(volume) AS m FROM bars GROUP BY ts)"))
def q01c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.market_terciles(trade_bars(spark, sf_dir), "volume").select("ts", F.col("tercile").cast("int").alias("tercile"))


@register("q02_panel_verdict", S.query("SELECT count(*) AS shared, count(*) FILTER (WHERE symbol = 'Brand#22') AS differ, CASE WHEN count(*) FILTER (WHERE symbol = 'Brand#22') > 0.01 * count(*) THEN 'fail' ELSE 'same' END AS verdict FROM bars JOIN sess USING (ts) WHERE session_idx < (SELECT max(session_idx) FROM sess) - 19", S.SESSIONS))
def q02(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = trade_bars(spark, sf_dir)
    new = bars.withColumn("close", F.when(F.col("symbol") == "Brand#22", F.col("close") + 1).otherwise(F.col("close")))
    return audit.panel_verdict(bars, new, ["symbol", "ts"], "close")


@register("q06_reproduced_ranking", S.query("SELECT * FROM (VALUES " + ", ".join(f"('top{n}_{k}')" for n in (1, 3, 5, 10) for k in ("gross", "missing")) + ") v(\"check\") CROSS JOIN (SELECT 0::BIGINT AS failed, count(DISTINCT ts) AS seen FROM bars)"))
def q06(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    return audit.reproduced_ranking(rows, selection.daily_top(rows))


@register("q06_pick_eligibility", S.query(f"SELECT count(*) AS picks, 0::BIGINT AS not_in_panel, count(*) FILTER (WHERE b IS NULL OR b = 0) AS unbuyable FROM (SELECT s.*, e.b, row_number() OVER (PARTITION BY ts ORDER BY score DESC NULLS LAST, symbol) AS rank FROM scored s JOIN (SELECT symbol, ts, {_BUY} AS b FROM bars) e USING (symbol, ts) WHERE score IS NOT NULL QUALIFY rank <= 10)", _SCORED))
def q06b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.pick_eligibility(selection.picks(scored(spark, sf_dir), 10), labels.open_to_close(trade_bars(spark, sf_dir)))


@register("q06_missing_outcomes", S.query("SELECT count(*) AS days, sum(m)::BIGINT AS missing_slots, round(avg(g), 6) + 0.0 AS headline, round(avg(g * (3 - m) / 3), 6) + 0.0 AS with_zero_returns FROM (SELECT ts, avg(outcome) AS g, count(*) FILTER (WHERE outcome IS NULL) AS m FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY score DESC NULLS LAST, symbol) AS rank FROM scored WHERE score IS NOT NULL QUALIFY rank <= 3) GROUP BY ts)", _SCORED))
def q06c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.missing_outcomes(selection.daily_top(scored(spark, sf_dir))).select("days", "missing_slots", r("headline").alias("headline"), r("with_zero_returns").alias("with_zero_returns"))


@register("q06_fold_rules", S.query("SELECT fold, (b.session_idx - a.session_idx)::INT AS gap, coalesce(train_end < test_start AND b.session_idx - a.session_idx > 5, false) AS ok FROM folds LEFT JOIN sess a ON a.ts = train_end LEFT JOIN sess b ON b.ts = test_start", S.SESSIONS, _FOLDS))
def q06d(spark: SparkSession, sf_dir: str) -> DataFrame:
    calendar = sessions(trade_bars(spark, sf_dir))
    return audit.fold_rules(selection.tested_folds(calendar), calendar, 5)


@register("q06_winsor_cuts", S.query(f"SELECT fold, count(*) AS rows, round(quantile_cont(y, 0.01), 6) + 0.0 AS low, round(quantile_cont(y, 0.99), 6) + 0.0 AS high FROM (SELECT ts, y - avg(y) OVER (PARTITION BY ts) AS y FROM (SELECT ts, {_BUY} AS b, {_oc(5)} AS y FROM bars) WHERE b = 1 AND y IS NOT NULL) JOIN folds ON ts <= train_end GROUP BY fold", S.SESSIONS, _FOLDS))
def q06e(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = trade_bars(spark, sf_dir)
    return audit.winsor_cuts(labels.open_to_close(bars), "label_oc_5", selection.tested_folds(sessions(bars))).select("fold", "rows", r("low").alias("low"), r("high").alias("high"))


@register("q07_sample_table", S.query(f"SELECT symbol, ts, entry, exit, exit / entry - 1 AS outcome, printf('%.8f / %.8f - 1', exit, entry) AS formula FROM (SELECT symbol, ts, {S.shifted('open', -1)} AS entry, {S.shifted('close', -5)} AS exit FROM bars) WHERE entry > 0 AND exit IS NOT NULL ORDER BY {_draw('symbol', 'ts', seed=7)}, symbol, ts LIMIT 25"))
def q07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.sample_table(trade_bars(spark, sf_dir), 5)


# --- scans, joins, places ------------------------------------------------------------------------


@register("s04_external_columns", S.query("SELECT symbol, ts, round(score, 6) + 0.0 AS score, close FROM bars LEFT JOIN (SELECT symbol, ts, score FROM scored WHERE symbol <> 'Brand#11') USING (symbol, ts)", _SCORED))
def s04(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = scored(spark, sf_dir).filter("symbol <> 'Brand#11'")
    return files.with_external(trade_bars(spark, sf_dir), other, ["score"]).select("symbol", "ts", r("score").alias("score"), "close")


@register("s06_filtered_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F'")
def s06(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = (F.col("o_totalprice") > 200000) & (F.col("o_orderstatus") == "F")
    return files.panel_labels(spark, f"{sf_dir}/orders.parquet", ["o_orderkey", "o_totalprice", "o_orderstatus"], where=where).drop("o_orderstatus")


@register("j01_one_to_one_join", S.query(f"SELECT symbol, ts, close, round({_oc(1)}, 6) + 0.0 AS label_oc_1 FROM bars"))
def j01(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = trade_bars(spark, sf_dir)
    side = labels.open_to_close(bars, (1,)).select("symbol", "ts", "label_oc_1")
    return audit.join_one_to_one(bars, side, ["symbol", "ts"]).select("symbol", "ts", "close", r("label_oc_1").alias("label_oc_1"))


@register("j02_market_relative", S.query("SELECT b.symbol, b.ts, round(b.r - m.r, 6) + 0.0 AS excess FROM (SELECT symbol, ts, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM bars) b LEFT JOIN (SELECT ts, avg(r) AS r FROM (SELECT ts, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM bars) GROUP BY ts) m USING (ts)"))
def j02(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trade_bars(spark, sf_dir).select("symbol", "ts", (win.ratio("close", win.lag("close")) - 1).alias("_r"))
    market = df.groupBy("ts").agg(F.avg("_r").alias("_m"))
    return df.join(F.broadcast(market), "ts", "left").select("symbol", "ts", r(F.col("_r") - F.col("_m")).alias("excess"))  # a row per date


@register("j14_map_lookup", "SELECT o_orderkey AS orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 END AS grade FROM orders")
def j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    grades = F.create_map(*(F.lit(x) for pair in (("1-URGENT", 1), ("2-HIGH", 2), ("3-MEDIUM", 3)) for x in pair))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), grades[F.col("o_orderpriority")].alias("grade"))


@register("a09_distinct_counts", "SELECT o_orderstatus AS status, count(DISTINCT o_custkey) AS customers, count(DISTINCT CAST(o_orderdate AS DATE)) AS days FROM orders GROUP BY 1")
def a09(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.countDistinct("o_custkey").alias("customers"), F.countDistinct(F.col("o_orderdate").cast("date")).alias("days"))


@register("w12_first_rank", S.query("SELECT symbol, ts, row_number() OVER (PARTITION BY ts ORDER BY volume DESC, symbol)::INT AS place FROM bars"))
def w12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade_bars(spark, sf_dir).select("symbol", "ts", F.row_number().over(W.partitionBy("ts").orderBy(F.desc("volume"), "symbol")).alias("place"))


@register("w29_place_in_group", "SELECT o_orderkey AS orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INT - 1 AS place FROM orders")
def w29(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), (F.row_number().over(order) - 1).alias("place"))


@register("u04_symmetric_difference", "SELECT k AS custkey, in_a FROM (SELECT DISTINCT o_custkey AS k, 1 AS in_a FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') UNION ALL SELECT DISTINCT o_custkey, 0 FROM orders WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'))")
def u04(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = (table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("custkey")) for s in ("F", "O"))
    return one.subtract(two).withColumn("in_a", F.lit(1)).unionByName(two.subtract(one).withColumn("in_a", F.lit(0)))


@register("r06_factorize", S.query("SELECT symbol, (dense_rank() OVER (ORDER BY symbol) - 1)::INT AS code FROM (SELECT DISTINCT symbol FROM bars)"))
def r06(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = trade_bars(spark, sf_dir).select("symbol").distinct()
    return names.select("symbol", (F.dense_rank().over(W.orderBy("symbol")) - 1).alias("code"))  # a row per symbol


@register("j09_bar_number", S.query("SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts)::INT AS bar, session_idx FROM bars JOIN sess USING (ts)", S.SESSIONS))
def j09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_sessions(trade_bars(spark, sf_dir)).select("symbol", "ts", F.row_number().over(win.by_symbol()).alias("bar"), "session_idx")
