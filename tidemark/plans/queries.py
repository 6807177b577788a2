"""All queries of the library by name, each with the SQL it is held against where there is one.

The name begins with the operator's place in the inventory.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions import bands
from tidemark.functions import windows as win
from tidemark.operators import audit, boosting, features, inference, labels, mixture, panel, screen, selection, state
from tidemark.plans import sql as S
from tidemark.sources import listings, store
from tidemark.sources.bars import clean, event_bars, sessions, table, trade_bars, with_sessions
from tidemark.sources.tables import materialised, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
#: Rounds of boosting in the query; the library's rule is 200.
ROUNDS = 4
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, text: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return put


def r(x: str | Column, digits: int = 6) -> Column:
    return F.round(win.col(x).cast("double"), digits) + 0.0


def rs(names: list[str], digits: int = 6) -> list[Column]:
    return [r(n, digits).alias(n) for n in names]


def based(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features.base(trade_bars(spark, sf_dir))
    return features.with_market(df, features.market(df))


# --- sources -----------------------------------------------------------------------------------


# Prices are exact quotients that may end in a five at any digit, so they are compared as they are.
@register("s01_trade_bars", S.query("SELECT symbol, ts, open, high, low, close, volume FROM bars"))
def s01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade_bars(spark, sf_dir)


@register(
    "s01_event_bars",
    "SELECT event_type AS symbol, CAST(ts AS DATE) AS ts, " + S.rounded({"open": "arg_min(value, ROW(ts, event_id))", "high": "max(value)", "low": "min(value)", "close": "arg_max(value, ROW(ts, event_id))", "volume": "count(*)"}) + " FROM events GROUP BY event_type, CAST(ts AS DATE)",
)
def s01e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_bars(spark, sf_dir).select("symbol", "ts", *rs(["open", "high", "low", "close", "volume"]))


@register("s02_keep_last_per_key", "SELECT o_custkey AS custkey, o_orderkey AS orderkey, round(o_totalprice, 6) + 0.0 AS total FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def s02(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = panel.dedupe_last(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return last.select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), r("o_totalprice").alias("total"))


@register("s01_long_enough", S.query("SELECT symbol, count(*) AS n FROM bars GROUP BY symbol HAVING count(*) >= 340"))
def s01l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.long_enough(trade_bars(spark, sf_dir), 340).groupBy("symbol").agg(F.count("*").alias("n"))


@register("m03_sessions", S.query("SELECT * FROM sess", S.SESSIONS))
def m03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(trade_bars(spark, sf_dir))


@register("p07_clean_values", "SELECT event_id, CASE WHEN value > 50 THEN NULL ELSE round(value, 6) + 0.0 END AS value FROM events")
def p07(spark: SparkSession, sf_dir: str) -> DataFrame:
    hurt = table(spark, sf_dir, "events").select("event_id", F.when(F.col("value") > 90, float("nan")).when(F.col("value") > 50, float("inf")).otherwise(F.col("value")).alias("value"))
    return clean(hurt, "value").select("event_id", r("value").alias("value"))


# --- bands and universe --------------------------------------------------------------------------


@register("p09_price_bands", S.query(f"SELECT symbol, ts, ({S.at_band('close / open - 1', 'open')})::INT AS up, ({S.at_band('1 - close / open', 'open')})::INT AS down FROM bars"))
def p09(spark: SparkSession, sf_dir: str) -> DataFrame:
    move = F.try_divide(F.col("close"), F.col("open"))
    return trade_bars(spark, sf_dir).select("symbol", "ts", bands.at_band(move - 1, F.col("open")).cast("int").alias("up"), bands.at_band(1 - move, F.col("open")).cast("int").alias("down"))


@register("p11_tick_size", f"SELECT o_orderkey AS orderkey, {S.tick('(CAST(o_orderdate AS DATE) + 9500)', 'o_totalprice / 10')}::DOUBLE AS tick FROM orders")
def p11(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_add(F.col("o_orderdate").cast("date"), 9500)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), bands.tick_size(day, F.col("o_totalprice") / 10).cast("double").alias("tick"))


@register("p13_lock_flags", S.query("SELECT symbol, ts, lock_up::INT AS lock_up, lock_dn::INT AS lock_dn, open_lock_dn::INT AS open_lock_dn FROM b", S.BASE))
def p13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.base(trade_bars(spark, sf_dir)).select("symbol", "ts", *(F.col(c).cast("int").alias(c) for c in ("lock_up", "lock_dn", "open_lock_dn")))


@register("p05_fund_rule", "SELECT p_partkey AS partkey, regexp_matches(upper(p_type || CASE WHEN p_size % 3 = 0 THEN 'ETF' ELSE '' END), '(BEES|ETF)$|^SETF|ETF')::INT AS is_fund FROM part")
def p05(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_type", F.when(F.col("p_size") % 3 == 0, "ETF").otherwise(""))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("partkey"), panel.is_fund(name).cast("int").alias("is_fund"))


@register("p02_liquidity_floor", S.query(f"SELECT symbol, ts, {S.rounded({'log_turnover_med': 'ln(x)'}, 8)} FROM (SELECT *, {S.roll('(close * volume)', 60, 'median', 40)} AS x FROM bars) WHERE x >= 30000"))
def p02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.liquidity_floor(trade_bars(spark, sf_dir), 30000).select("symbol", "ts", r(F.ln("turnover_med"), 8).alias("log_turnover_med"))


@register("p03_thin_dates", S.query("SELECT symbol, ts, n::INT AS universe_size FROM (SELECT *, count(*) OVER (PARTITION BY ts) AS n FROM bars) WHERE n >= 25"))
def p03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.thin_dates(trade_bars(spark, sf_dir), 25).select("symbol", "ts", "universe_size")


@register("k09_universe_hash", S.query("SELECT substr(sha256(string_agg(symbol, '|' ORDER BY symbol)), 1, 16) AS universe_hash FROM (SELECT DISTINCT symbol FROM bars)"))
def k09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.universe_hash(trade_bars(spark, sf_dir).select("symbol"))


@register("k07_upsert_tail", S.query("SELECT symbol, ts, close FROM bars WHERE symbol <> 'Brand#11'"))
def k07(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = trade_bars(spark, sf_dir).filter("symbol <> 'Brand#11'").select("symbol", "ts", "close")
    cal = sessions(new)
    last = cal.agg(F.max("session_idx").alias("last"))
    old = trade_bars(spark, sf_dir).select("symbol", "ts", "close").join(F.broadcast(cal.join(F.broadcast(last), F.col("session_idx") <= F.col("last") - 8).select("ts")), "ts").select("symbol", "ts", F.when(F.col("ts") >= "2001-08-01", F.col("close") + 1).otherwise(F.col("close")).alias("close"))
    return panel.upsert_tail(old, new, cal, 20).select("symbol", "ts", "close")


# --- windows and ranks ---------------------------------------------------------------------------

_ROLLS = {"mean_20": ("lp", 20, "mean"), "sum_5": ("volume", 5, "sum"), "std_20": ("lp", 20, "std"), "max_20": ("lp", 20, "max"), "min_20": ("lp", 20, "min"), "median_20": ("lp", 20, "median")}


@register("w03_trailing_windows", S.query("SELECT symbol, ts, " + S.rounded({k: S.roll(*v) for k, v in _ROLLS.items()}, 4) + f", {S.rounded({'lagged_mean': S.roll('lp', 10, 'mean', lag=5)}, 4)} FROM (SELECT *, ln(close) AS lp FROM bars)"))
def w03(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trade_bars(spark, sf_dir).withColumn("lp", F.ln("close"))
    return df.select("symbol", "ts", *(r(win.roll(*v), 4).alias(k) for k, v in _ROLLS.items()), r(win.roll("lp", 10, lag=5), 4).alias("lagged_mean"))


@register("w06_average_rank", S.query("SELECT symbol, ts, " + S.rounded({"rank_volume": S.rank("volume"), "pct_volume": S.percent_rank("volume"), "pct_close": S.percent_rank("close")}) + " FROM bars"))
def w06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade_bars(spark, sf_dir).select("symbol", "ts", r(win.average_rank("volume")).alias("rank_volume"), r(win.percent_rank("volume")).alias("pct_volume"), r(win.percent_rank("close")).alias("pct_close"))


_Z = "greatest(-5, least(5, ({x} - avg({x}) OVER (PARTITION BY ts)) / nullif(stddev_samp({x}) OVER (PARTITION BY ts), 0)))"


@register("w08_cross_section", S.query("SELECT symbol, ts, " + S.rounded({"X_rank_close": S.percent_rank("close"), "X_z_close": _Z.format(x="close"), "X_rank_volume": S.percent_rank("volume"), "X_z_volume": _Z.format(x="volume"), "demeaned": "ln(close) - avg(ln(close)) OVER (PARTITION BY ts)"}) + ", (count(*) OVER (PARTITION BY ts))::INT AS X_universe_size FROM bars"))
def w08(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = panel.add_cross_section(trade_bars(spark, sf_dir), ["close", "volume"])
    return df.select("symbol", "ts", *rs(["X_rank_close", "X_z_close", "X_rank_volume", "X_z_volume"]), r(win.demean(F.ln("close"))).alias("demeaned"), "X_universe_size")


@register("w17_streaks_and_flags", S.query(
    "SELECT symbol, ts, streak, up_streak, since_up FROM (SELECT symbol, ts, sg * row_number() OVER (PARTITION BY symbol, isl ORDER BY ts) AS streak, sum(up) OVER (PARTITION BY symbol, ui ORDER BY ts)::DOUBLE AS up_streak, coalesce(least(idx - max(CASE WHEN up = 1 THEN idx END) OVER (PARTITION BY symbol ORDER BY ts), 250), 250)::DOUBLE AS since_up FROM "
    "(SELECT *, sum(turn) OVER (PARTITION BY symbol ORDER BY ts) AS isl, sum(1 - up) OVER (PARTITION BY symbol ORDER BY ts) AS ui FROM (SELECT *, CASE WHEN sg = lag(sg) OVER (PARTITION BY symbol ORDER BY ts) THEN 0 ELSE 1 END AS turn, (sg > 0)::INT AS up FROM (SELECT *, coalesce(sign(close - cp), 0)::DOUBLE AS sg FROM b))))",
    S.BASE,
))
def w17(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features.base(trade_bars(spark, sf_dir)).withColumn("change", F.coalesce(F.col("close") - F.col("cp"), F.lit(0.0))).withColumn("up", (F.col("change") > 0).cast("int"))
    df = win.flag_streak(win.signed_streak(df, "change", "streak"), "up", "up_streak")
    return df.select("symbol", "ts", F.col("streak") + 0.0, "up_streak", win.bars_since_flag(F.col("up") == 1, "idx").alias("since_up")).toDF("symbol", "ts", "streak", "up_streak", "since_up")


@register("w19_session_runs", S.query(
    "SELECT symbol, ts, sum(n) OVER (PARTITION BY symbol ORDER BY ts)::BIGINT AS run_id FROM (SELECT symbol, ts, CASE WHEN session_idx - lag(session_idx) OVER (PARTITION BY symbol ORDER BY ts) = 1 THEN 0 ELSE 1 END AS n FROM bars JOIN sess USING (ts))",
    S.SESSIONS,
))
def w19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win.session_runs(with_sessions(trade_bars(spark, sf_dir))).select("symbol", "ts", F.col("run_id").cast("bigint").alias("run_id"))


@register("w28_quintile_bucket", S.query(f"SELECT symbol, ts, least(floor(({S.rank('volume')} - 0.5) / count(*) OVER (PARTITION BY ts) * 5), 4)::INT AS bucket FROM bars"))
def w28(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade_bars(spark, sf_dir).select("symbol", "ts", win.quantile_bucket(win.average_rank("volume"), F.count(F.lit(1)).over(W.partitionBy("ts")), 5).alias("bucket"))


# --- joins and sets ------------------------------------------------------------------------------


@register("j05_lagged_as_of", "WITH d AS (SELECT CAST(ts AS DATE) AS ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY 1), cal AS (SELECT DISTINCT CAST(ts AS DATE) AS ts FROM events), f AS (SELECT cal.ts, last_value(value IGNORE NULLS) OVER (ORDER BY cal.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v, value IS NOT NULL AS own FROM cal LEFT JOIN d USING (ts)) SELECT ts, round(lag(v, 2) OVER (ORDER BY ts), 6) + 0.0 AS value, (NOT coalesce(lag(own, 2) OVER (ORDER BY ts), false))::INT AS stale FROM f")
def j05(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("date"))
    series = events.filter("event_type = 'click'").groupBy("ts").agg(F.max("value").alias("value"))
    return panel.as_of_sessions(series, events.select("ts").distinct(), 2).select("ts", r("value").alias("value"), F.col("stale").cast("int").alias("stale"))


@register("j05_as_of_by_key", "SELECT o.o_orderkey AS orderkey, round(last_total, 6) + 0.0 AS last_total FROM (SELECT o_orderkey, o_custkey, o_orderdate FROM orders) o ASOF LEFT JOIN (SELECT o_custkey, CAST(o_orderdate AS DATE) + 1 AS d, max(o_totalprice) AS last_total FROM orders GROUP BY 1, 2) q ON o.o_custkey = q.o_custkey AND CAST(o.o_orderdate AS DATE) >= q.d")
def j05b(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("ts"), "o_totalprice")
    # A day's largest order is known from the next day on.
    right = orders.groupBy("o_custkey", F.date_add("ts", 1).alias("ts")).agg(F.max("o_totalprice").alias("last_total"))
    return panel.as_of(orders.drop("o_totalprice"), right, "o_custkey", "last_total").select(F.col("o_orderkey").alias("orderkey"), r("last_total").alias("last_total"))


@register("j10_global_session_outcome", S.query("SELECT a.symbol, a.ts, round(c.close / nullif(e.open, 0) - 1, 6) + 0.0 AS outcome FROM (SELECT * FROM bars JOIN sess USING (ts)) a LEFT JOIN (SELECT * FROM bars JOIN sess USING (ts)) e ON a.symbol = e.symbol AND e.session_idx = a.session_idx + 1 LEFT JOIN (SELECT * FROM bars JOIN sess USING (ts)) c ON a.symbol = c.symbol AND c.session_idx = a.session_idx + 3", S.SESSIONS))
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.global_outcome(with_sessions(trade_bars(spark, sf_dir)), 3).select("symbol", "ts", r("outcome").alias("outcome"))


@register("j12_semi_anti", "SELECT c_custkey AS custkey, (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey))::INT AS has_orders FROM customer")
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"))
    return customer.join(orders, "custkey", "left_semi").withColumn("has_orders", F.lit(1)).unionByName(customer.join(orders, "custkey", "left_anti").withColumn("has_orders", F.lit(0)))


_SCORED = f"scored AS (SELECT symbol, ts, {S.percent_rank('volume')} AS score, lead(close, 2) OVER (PARTITION BY symbol ORDER BY ts) / nullif(lead(open) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS outcome FROM bars)"
_SCORED_B = f"other AS (SELECT symbol, ts, {S.percent_rank('close')} AS score, outcome FROM (SELECT bars.*, outcome FROM bars JOIN scored USING (symbol, ts)))"


def scored(spark: SparkSession, sf_dir: str, by: str = "volume") -> DataFrame:
    return scores(trade_bars(spark, sf_dir), by)


def scores(bars: DataFrame, by: str = "volume") -> DataFrame:
    return bars.select("symbol", "ts", win.percent_rank(by).alias("score"), (win.ratio(win.lead("close", 2), win.lead("open")) - 1).alias("outcome"))


def _top(name: str, n: int) -> str:
    return f"SELECT symbol, ts, score, outcome, row_number() OVER (PARTITION BY ts ORDER BY score DESC NULLS LAST, symbol) AS rank FROM {name} WHERE score IS NOT NULL QUALIFY rank <= {n}"


@register("j06_pick_agreement", S.query(f"SELECT coalesce(a.ts, b.ts) AS ts, count(*) FILTER (WHERE a.ts IS NOT NULL AND b.ts IS NOT NULL) AS both, count(*) FILTER (WHERE b.ts IS NULL) AS only_a, count(*) FILTER (WHERE a.ts IS NULL) AS only_b FROM a FULL JOIN b ON a.ts = b.ts AND a.symbol = b.symbol GROUP BY 1", _SCORED, _SCORED_B, f"a AS ({_top('scored', 5)})", f"b AS ({_top('other', 5)})"))
def j06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.agreement(selection.picks(scored(spark, sf_dir), 5), selection.picks(scored(spark, sf_dir, "close"), 5))


# --- aggregates and shapes -----------------------------------------------------------------------


@register("a04_quantiles", S.query("SELECT symbol, " + S.rounded({f"p{round(q * 100):02d}": f"quantile_cont(close, {q})" for q in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)}, 4) + ", " + S.rounded({"positive": "avg((close > open)::INT)"}) + " FROM bars GROUP BY symbol"))
def a04(spark: SparkSession, sf_dir: str) -> DataFrame:
    qs = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
    return trade_bars(spark, sf_dir).groupBy("symbol").agg(*(r(F.percentile("close", q), 4).alias(f"p{round(q * 100):02d}") for q in qs), r(F.avg((F.col("close") > F.col("open")).cast("int"))).alias("positive"))


@register("a05_value_counts", "SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) + 0.0 AS share FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3")
def a05(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.withColumn("share", r(F.col("n") / F.sum("n").over(W.partitionBy()))).orderBy(F.desc("n"), "event_type").limit(3)


@register("a06_grouping_sets", "SELECT o_orderstatus AS status, year(o_orderdate)::INT AS year, count(*) AS n, " + S.rounded({"log_mean": "ln(avg(o_totalprice))"}, 8) + " FROM orders GROUP BY GROUPING SETS ((o_orderstatus, year(o_orderdate)), (o_orderstatus), ())")
def a06(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.year("o_orderdate").alias("year"), "o_totalprice")
    return o.groupingSets([["status", "year"], ["status"], []], "status", "year").agg(F.count("*").alias("n"), r(F.ln(F.avg("o_totalprice")), 8).alias("log_mean"))


@register("a10_tail_share", S.query("SELECT symbol, round(sum(CASE WHEN i <= greatest(floor(n * 0.05), 1) THEN outcome END) / nullif(sum(outcome), 0), 4) + 0.0 AS tail_share, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY outcome DESC, ts) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM scored WHERE outcome IS NOT NULL) GROUP BY symbol", _SCORED))
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.tail_share(scored(spark, sf_dir), ["symbol"], "outcome").select("symbol", r("tail_share", 4).alias("tail_share"), "n")


@register("r01_pivot_year_month", S.query("SELECT symbol, y AS year, " + ", ".join(f"max(CASE WHEN m = {m} THEN v END) AS m{m}" for m in range(1, 13)) + " FROM (SELECT symbol, year(ts)::INT AS y, month(ts) AS m, arg_max(close, ts) AS v FROM bars GROUP BY 1, 2, 3) GROUP BY 1, 2"))
def r01(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = trade_bars(spark, sf_dir).groupBy("symbol", F.year("ts").alias("year"), F.month("ts").alias("m")).agg(F.max_by("close", "ts").alias("v"))
    return month.groupBy("symbol", "year").pivot("m", list(range(1, 13))).agg(F.first("v")).toDF("symbol", "year", *(f"m{m}" for m in range(1, 13)))


@register("r03_cut_buckets", "SELECT CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 20 THEN 1 WHEN l_quantity < 40 THEN 2 ELSE 3 END AS bucket, count(*) AS n, sum(l_quantity) AS total FROM lineitem GROUP BY 1")
def r03(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy(F.when(q < 10, 0).when(q < 20, 1).when(q < 40, 2).otherwise(3).alias("bucket")).agg(F.count("*").alias("n"), F.sum(q).alias("total"))


# --- labels --------------------------------------------------------------------------------------

_LEAD = S.shifted


def _oc(h: int) -> str:
    return f"CASE WHEN {_LEAD('close', -h)} > 0 THEN {_LEAD('close', -h)} / (CASE WHEN {_LEAD('open', -1)} > 0 THEN {_LEAD('open', -1)} END) - 1 END"


_UPPER = f"(abs({_LEAD('open', -1)} - {_LEAD('high', -1)}) <= 1e-6 * greatest(abs({_LEAD('open', -1)}), abs({_LEAD('high', -1)})) AND {S.at_band(f'{_LEAD("open", -1)} / nullif(close, 0) - 1', 'close')})"


@register("l01_open_to_close", S.query("SELECT symbol, ts, " + S.rounded({f"label_oc_{h}": _oc(h) for h in (1, 2, 3, 5)}) + f", CASE WHEN {_LEAD('open', -1)} > 0 AND {_LEAD('high', -1)} IS NOT NULL AND close > 0 THEN CASE WHEN {_UPPER} THEN 0.0::DOUBLE ELSE 1.0 END END AS label_buyable_o1 FROM bars"))
def l01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.open_to_close(trade_bars(spark, sf_dir)).select("symbol", "ts", *rs([f"label_oc_{h}" for h in (1, 2, 3, 5)]), "label_buyable_o1")


_NEXT5 = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"


@register("l03_excursions", S.query("SELECT symbol, ts, " + S.rounded({"label_fwd_ret": f"CASE WHEN count(close) {_NEXT5} = 5 THEN {_LEAD('close', -5)} / close - 1 END", "label_mfe": f"CASE WHEN count(close) {_NEXT5} = 5 THEN max(high) {_NEXT5} / close - 1 END", "label_mae": f"CASE WHEN count(close) {_NEXT5} = 5 THEN min(low) {_NEXT5} / close - 1 END", "label_touch": f"CASE WHEN count(close) {_NEXT5} = 5 THEN (max(high) {_NEXT5} / close - 1 >= 0.05)::INT END"}) + " FROM bars"))
def l03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.excursions(trade_bars(spark, sf_dir)).select("symbol", "ts", *rs(["label_fwd_ret", "label_mfe", "label_mae", "label_touch"]))


_ATR = f"t AS (SELECT *, CASE WHEN cp IS NOT NULL THEN greatest(high - low, abs(high - cp), abs(low - cp)) END AS tr FROM b), a AS (SELECT *, {S.roll('tr', 14)} / close AS atr_pct FROM t)"
_RUN = "x AS (SELECT *, " + ", ".join(f"max(high) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING) / close - 1 AS u{k}, min(low) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING) / close - 1 AS d{k}" for k in range(1, 6)) + f", count(close) {_NEXT5} AS n5, {_LEAD('close', -5)} / close - 1 AS fe FROM a)"


def _touch(tp: str, sl: str) -> str:
    up = "CASE " + " ".join(f"WHEN u{k} >= {tp} THEN {k}" for k in range(1, 6)) + " ELSE 6 END"
    down = "CASE " + " ".join(f"WHEN d{k} <= -({sl}) THEN {k}" for k in range(1, 6)) + " ELSE 6 END"
    return f"SELECT symbol, ts, side AS first, CASE WHEN ok AND ku < 6 THEN ku END AS days_tp, CASE WHEN ok AND kd < 6 THEN kd END AS days_sl, CASE WHEN ok THEN (ku = kd AND ku < 6)::INT END AS tie, round(CASE side WHEN 1 THEN {tp} WHEN -1 THEN -({sl}) WHEN 0 THEN fe END, 6) + 0.0 AS exit_ret FROM (SELECT *, CASE WHEN ok THEN CASE WHEN ku < kd THEN 1 WHEN kd < 6 THEN -1 ELSE 0 END END AS side FROM (SELECT *, {up} AS ku, {down} AS kd, n5 = 5 AND ({tp}) IS NOT NULL AS ok FROM x))"


def _variant(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = labels.first_touch(labels.with_atr(trade_bars(spark, sf_dir)))
        return df.select("symbol", "ts", F.col(f"label_first_{name}").alias("first"), F.col(f"label_days_tp_{name}").alias("days_tp"), F.col(f"label_days_sl_{name}").alias("days_sl"), F.col(f"label_tie_{name}").alias("tie"), r(f"label_exit_{name}").alias("exit_ret"))

    return run


for _name, _tp, _sl, _scaled in labels.VARIANTS:
    register(f"l04_first_touch_{_name}", S.query(_touch(f"{_tp} * atr_pct" if _scaled else f"{_tp}::DOUBLE", f"{_sl} * atr_pct" if _scaled else f"{_sl}::DOUBLE"), S.BASE, _ATR, _RUN))(_variant(_name))


_MOVES = "x AS (SELECT *, " + ", ".join(f"{_LEAD(c, -k)} / {_LEAD('open', -1)} - 1 AS {c[0]}{k}" for k in range(1, 6) for c in ("open", "high", "low")) + f", {_LEAD('close', -5)} / {_LEAD('open', -1)} - 1 AS fe, {_LEAD('open', -1)} / close - 1 AS gap FROM a)"
_STEPS = [s for k in range(1, 6) for s in (([(f"o{k} <= -atr_pct", -1, f"o{k}"), (f"o{k} >= 1.5 * atr_pct", 1, f"o{k}")] if k > 1 else []) + [(f"l{k} <= -atr_pct", -1, "-atr_pct"), (f"h{k} >= 1.5 * atr_pct", 1, "1.5 * atr_pct")])]


@register("l05_next_open_bracket", S.query(
    "SELECT symbol, ts, CASE WHEN fe IS NOT NULL AND atr_pct IS NOT NULL THEN CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v, _ in _STEPS) + " ELSE 0 END END AS label_o1_first, round(CASE WHEN fe IS NOT NULL AND atr_pct IS NOT NULL THEN CASE " + " ".join(f"WHEN {c} THEN {e}" for c, _, e in _STEPS) + " ELSE fe END END, 6) + 0.0 AS label_o1_exit, " + S.rounded({"label_o1_mfe": "CASE WHEN fe IS NOT NULL AND atr_pct IS NOT NULL THEN greatest(h1, h2, h3, h4, h5) END", "label_o1_mae": "CASE WHEN fe IS NOT NULL AND atr_pct IS NOT NULL THEN least(l1, l2, l3, l4, l5) END", "label_gap1": "gap"}) + " FROM x",
    S.BASE, _ATR, _MOVES,
))
def l05(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = labels.next_open_bracket(labels.with_atr(trade_bars(spark, sf_dir)))
    return df.select("symbol", "ts", "label_o1_first", *rs(["label_o1_exit", "label_o1_mfe", "label_o1_mae", "label_gap1"]))


@register("l08_locked_exit", S.query(
    "SELECT symbol, ts, round(outcome, 6) + 0.0 AS outcome, round(CASE WHEN outcome IS NULL THEN NULL WHEN NOT lk OR nb = 0 THEN outcome WHEN fo IS NOT NULL THEN fo / e - 1 ELSE lc / e - 1 END, 6) + 0.0 AS outcome_lock, coalesce(outcome IS NOT NULL AND lk, false)::INT AS locked_exit FROM (SELECT symbol, ts, "
    f"{_LEAD('open', -1)} AS e, {_LEAD('close', -2)} / nullif({_LEAD('open', -1)}, 0) - 1 AS outcome, {_LEAD('lk0', -2)} AS lk, {_LEAD('nb0', -2)} AS nb, {_LEAD('fo0', -2)} AS fo, {_LEAD('lc0', -2)} AS lc FROM (SELECT symbol, ts, open, close, lock_dn = 1 AS lk0, count(*) OVER n AS nb0, arg_min(open, ts) FILTER (WHERE open_lock_dn = 0) OVER n AS fo0, arg_max(close, ts) OVER n AS lc0 FROM b WINDOW n AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)))",
    S.BASE,
))
def l08(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = labels.locked_exit(trade_bars(spark, sf_dir), 2)
    return df.select("symbol", "ts", *rs(["outcome", "outcome_lock"]), F.col("locked_exit").cast("int").alias("locked_exit"))


# --- selection and inference ---------------------------------------------------------------------

_TOP3 = "SELECT ts, count(*) AS n_names, " + S.rounded({"market": "avg(outcome)", "top3_gross": "avg(outcome) FILTER (WHERE rank <= 3)", "top3_net": "avg(outcome) FILTER (WHERE rank <= 3) - 0.0035", "top3_excess": "avg(outcome) FILTER (WHERE rank <= 3) - avg(outcome)"}) + ", count(*) FILTER (WHERE rank <= 3 AND outcome IS NULL) AS top3_missing, coalesce(max(score) FILTER (WHERE rank = 3) = max(score) FILTER (WHERE rank = 4), false)::INT AS tie_at_3 FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY score DESC NULLS LAST, symbol) AS rank FROM {} WHERE score IS NOT NULL) GROUP BY ts"


@register("w11_daily_top_n", S.query(_TOP3.format("scored"), _SCORED))
def w11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.daily_top(scored(spark, sf_dir)).select("ts", "n_names", *rs(["market", "top3_gross", "top3_net", "top3_excess"]), "top3_missing", "tie_at_3")


@register("t02_picks", S.query(f"SELECT symbol, ts, rank::INT AS rank FROM ({_top('scored', 10)})", _SCORED))
def t02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.picks(scored(spark, sf_dir), 10).select("symbol", "ts", "rank")


@register("w30_tie_report", S.query("SELECT count(*) AS days, count(*) FILTER (WHERE reach > 3) AS tied_days, max(reach) AS widest FROM (SELECT s.ts, count(*) FILTER (WHERE s.score >= e.score) AS reach FROM scored s JOIN (SELECT ts, score FROM scored WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ts ORDER BY score DESC, symbol) = 3) e USING (ts) GROUP BY s.ts)", _SCORED))
def w30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.tie_report(scored(spark, sf_dir), 3)


@register("i19_rank_ensemble", S.query(f"SELECT symbol, ts, round(0.5 * {S.percent_rank('sa')} + 0.5 * {S.percent_rank('sb')}, 6) + 0.0 AS score FROM (SELECT a.symbol, a.ts, a.score AS sa, b.score AS sb FROM scored a JOIN other b USING (symbol, ts) WHERE a.score IS NOT NULL AND b.score IS NOT NULL)", _SCORED, _SCORED_B))
def i19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.ensemble(scored(spark, sf_dir), scored(spark, sf_dir, "close")).select("symbol", "ts", r("score").alias("score"))


@register("i20_score_correlation", S.query(f"SELECT ts, round(corr(ra, rb), 6) + 0.0 AS rho, count(*) AS n FROM (SELECT a.ts, {S.rank('a.score', 'a.ts')} AS ra, {S.rank('b.score', 'a.ts')} AS rb FROM scored a JOIN other b USING (symbol, ts)) GROUP BY ts HAVING count(*) >= 3", _SCORED, _SCORED_B))
def i20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.score_correlation(scored(spark, sf_dir), scored(spark, sf_dir, "close")).filter("n >= 3").select("ts", r("rho").alias("rho"), "n")


_FOLDS = "f AS (SELECT *, ntile(5) OVER (ORDER BY ts) AS fold FROM sess WHERE session_idx >= floor((SELECT count(*) FROM sess) * 0.35)), runs AS (SELECT fold, min(ts) AS test_start, max(ts) AS test_end, min(session_idx) AS i0, count(*) AS n_sessions FROM f GROUP BY fold), folds AS (SELECT fold::INT AS fold, s.ts AS train_end, test_start, test_end, n_sessions FROM runs LEFT JOIN sess s ON s.session_idx = i0 - 6)"


@register("i21_walk_forward_folds", S.query("SELECT * FROM folds", S.SESSIONS, _FOLDS))
def i21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.tested_folds(sessions(trade_bars(spark, sf_dir)))


@register("i21_expanding_folds", S.query("SELECT fold::INT AS fold, s.ts AS train_end, test_start, test_end, n_sessions FROM (SELECT fold, min(ts) AS test_start, max(ts) AS test_end, min(session_idx) AS i0, count(*) AS n_sessions FROM (SELECT *, ntile(6) OVER (ORDER BY ts) - 1 AS fold FROM sess) WHERE fold > 0 GROUP BY fold) LEFT JOIN sess s ON s.session_idx = i0 - 6", S.SESSIONS))
def i21b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.expanding_folds(sessions(trade_bars(spark, sf_dir)))


# --- draws, lists and classes --------------------------------------------------------------------


def _draw(*keys: str, seed: int) -> str:
    return f"('0x' || substr(md5('{seed}:' || {" || ':' || ".join(f'{k}::VARCHAR' for k in keys)}), 1, 8))::BIGINT"


@register("a16_drawn_rows", f"SELECT o_orderkey AS orderkey FROM orders ORDER BY {_draw('o_orderkey', seed=7)}, o_orderkey LIMIT 100")
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.drawn(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey")), ["orderkey"], 100, 7)


@register("a16_drawn_in_groups", f"SELECT o_custkey AS custkey, o_orderkey AS orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY {_draw('o_orderkey', seed=3)}, o_orderkey) <= 3")
def a16b(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"))
    return selection.drawn(rows, ["orderkey"], 3, 3, ("custkey",))


@register("t05_random_lists", S.query(f"SELECT ts, symbol, (row_number() OVER (PARTITION BY ts ORDER BY {_draw('symbol', 'ts', seed=5)}, symbol))::INT AS rank FROM bars QUALIFY rank <= 5"))
def t05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.random_lists(trade_bars(spark, sf_dir).select("ts", "symbol"), 5, 5)


@register("t03_watchlists", S.query(f"SELECT ts, string_agg(symbol, ',' ORDER BY rank) AS symbols FROM ({_top('scored', 5)}) GROUP BY ts", _SCORED))
def t03b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.watchlists(scored(spark, sf_dir), 5).select("ts", F.array_join("symbols", ",").alias("symbols"))


# Every third part has no identifier, and of the others some are funds by theirs; names end in ETF by size.
_PARTS = "CASE WHEN p_size % 7 = 0 THEN 'P' || p_partkey || 'ETF' ELSE 'P' || p_partkey END"


@register("p06_fund_class", f"SELECT symbol, CASE WHEN isin IS NULL THEN symbol LIKE '%ETF' ELSE isin LIKE 'INF%' END AS is_fund, CASE WHEN isin IS NULL THEN 'name' ELSE 'isin' END AS source FROM (SELECT {_PARTS} AS symbol, CASE WHEN p_partkey % 3 > 0 THEN CASE WHEN p_size % 5 = 0 THEN 'INF' ELSE 'INE' END || lpad(p_partkey::VARCHAR, 9, '0') END AS isin FROM part)")
def p06(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("symbol", F.expr(_PARTS))
    code = F.concat(F.when(F.col("p_size") % 5 == 0, F.lit("INF")).otherwise(F.lit("INE")), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    isin = part.filter("p_partkey % 3 > 0").select("symbol", code.alias("isin"))
    return panel.classify(part.select("symbol"), isin).select("symbol", "is_fund", "source")


_EXTRA = ["P30", "P60"]


def _packed(part: DataFrame) -> DataFrame:
    """(path, content): the parts' listings as ZIP archives of two CSV files each, of 500 parts at most, as an exchange would send them."""

    def pack(rows: pa.Table) -> pa.Table:
        content, number = io.BytesIO(), rows["number"][0].as_py()
        heads = ("Symbol , ISIN Number,Series", "series,TckrSymb,ISIN_CODE")
        with zipfile.ZipFile(content, "w", zipfile.ZIP_DEFLATED) as z:
            for k, head in enumerate(heads):
                lines = [f" {r['symbol'].lower()},{r['isin']} ,{r['series']}" if k == 0 else f'"{r["series"]}",{r["symbol"]},{r["isin"]}' for r in rows.to_pylist() if r["side"] == k]
                z.writestr(f"list_{k}.csv", "\n".join([head, *lines, ""]))
        return pa.table({"path": [f"listing_{number}.zip"], "content": [content.getvalue()]})

    return part.groupBy("number").applyInArrow(pack, "path string, content binary")


@register("s08_packed_listings", "SELECT symbol, isin, series, CASE WHEN isin IS NULL THEN symbol IN ('P30', 'P60') OR symbol LIKE '%ETF' ELSE isin LIKE 'INF%' END AS is_fund, CASE WHEN isin IS NOT NULL THEN 'isin' WHEN symbol IN ('P30', 'P60') THEN 'user_list' ELSE 'name' END AS source "
    f"FROM (SELECT {_PARTS} AS symbol, CASE WHEN p_partkey % 3 > 0 THEN CASE WHEN p_size % 5 = 0 AND p_partkey % 2 = 0 THEN 'INF' ELSE 'INE' END || lpad(p_partkey::VARCHAR, 9, '0') END AS isin, CASE WHEN p_partkey % 3 > 0 THEN 'EQ' END AS series FROM part)")
def s08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each listed part stands in its archive twice, with an EQ line and a later one of another series and a smaller ISIN; one in three has a broken ISIN only."""
    part = table(spark, sf_dir, "part").withColumn("symbol", F.expr(_PARTS))
    key, whole = F.col("p_partkey"), F.col("p_partkey") % 3 > 0
    own = F.concat(F.when((F.col("p_size") % 5 == 0) & (key % 2 == 0), F.lit("INF")).otherwise(F.lit("INE")), F.lpad(key.cast("string"), 9, "0"))
    lines = F.array(
        F.struct(F.when(whole, own).otherwise(F.lit("INE1")).alias("isin"), F.lit("EQ").alias("series"), (key % 2).cast("int").alias("side")),
        F.struct(F.when(whole, F.concat(F.lit("IND"), F.lpad(key.cast("string"), 9, "0"))).otherwise(F.lit("")).alias("isin"), F.lit("BE").alias("series"), F.lit(1).alias("side")),
    )
    rows = part.select("symbol", F.floor(key / 500).alias("number"), F.explode(lines).alias("l")).select("symbol", "number", "l.*")
    best = listings.best_listing(listings.unpacked(_packed(rows))).drop("source")
    return panel.classify(part.select("symbol"), best, _EXTRA).select("symbol", "isin", "series", "is_fund", "source")


@register("k01_committed_tail", S.query("SELECT symbol, ts, open, high, low, close, volume FROM bars WHERE symbol <> 'Brand#11'"))
def k01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A panel without its last four sessions, and wrong in the six before, committed; then its last ten, without a symbol; read back."""
    bars = materialised(trade_bars(spark, sf_dir))
    calendar = sessions(bars)
    back = F.broadcast(calendar.withColumn("back", F.max("session_idx").over(W.partitionBy(F.lit(1))) - F.col("session_idx")).select("ts", "back"))  # a row per session
    stale = bars.join(back, "ts").filter("back >= 4").withColumn("close", F.when(F.col("back") < 10, F.col("close") * 2).otherwise(F.col("close"))).select(*bars.columns)
    path = f"{shared_folder(spark)}/panel_{uuid.uuid4().hex}"
    store.commit_all(stale, path)
    store.commit_tail(bars.filter("symbol <> 'Brand#11'"), path, calendar, 10)
    return store.read(spark, path)


@register("i25_missing_report", S.query("SELECT 'move' AS \"column\", count(*) AS rows, count(*) FILTER (WHERE r IS NULL) AS missing FROM b UNION ALL SELECT 'turnover', count(*), count(*) FILTER (WHERE tv IS NULL) FROM b UNION ALL SELECT 'month', count(*), count(*) FILTER (WHERE idx <= 4) FROM b", S.BASE))
def i25(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features.base(trade_bars(spark, sf_dir)).withColumns({"move": F.col("r"), "turnover": F.col("tv"), "month": win.lag("close", 4)})
    return state.missing_report(df, ["move", "turnover", "month"]).select("column", "rows", "missing")


# --- the screen ----------------------------------------------------------------------------------

_FEATURES = {"F_volume": "volume", "F_range": "high / nullif(low, 0) - 1", "F_move": "close / nullif(open, 0) - 1"}
_PANEL = "panel AS (SELECT symbol, ts, close, " + ", ".join(f"{e} AS {n}" for n, e in _FEATURES.items()) + f", {_oc(1)} AS label_oc_1, {_oc(5)} AS label_oc_5 FROM bars)"
_LONG = "long AS (" + " UNION ALL ".join(f"SELECT symbol, ts, '{f}' AS feature, '{t}' AS target, {f}::DOUBLE AS x, {t} AS y FROM panel WHERE {f} IS NOT NULL AND {t} IS NOT NULL" for f in _FEATURES for t in ("label_oc_1", "label_oc_5")) + ")"
_RANKS = f"ranks AS (SELECT *, {S.rank('x', 'feature', 'target', 'ts')} AS rx, {S.rank('y', 'feature', 'target', 'ts')} AS ry, count(*) OVER (PARTITION BY feature, target, ts) AS n FROM long)"
_IC = "ic AS (SELECT feature, target, ts, CASE WHEN max(rx) > min(rx) AND max(ry) > min(ry) THEN corr(rx, ry) END AS ic, count(*) AS n FROM ranks GROUP BY 1, 2, 3 HAVING count(*) >= 15)"
_HAC = (
    "e AS (SELECT *, ic - avg(ic) OVER (PARTITION BY feature, target) AS d FROM ic WHERE ic IS NOT NULL), "
    "g AS (SELECT *, " + ", ".join(f"d * lag(d, {k}) OVER (PARTITION BY feature, target ORDER BY ts) AS g{k}" for k in range(1, 21)) + " FROM e), "
    "v AS (SELECT feature, target, avg(ic) AS mean, count(*) AS n, sum(d * d) AS g0, sum(d * d) + " + " + ".join(f"2 * {1 - k / 21!r} * coalesce(sum(g{k}), 0)" for k in range(1, 21)) + " AS gw FROM g GROUP BY 1, 2), "
    "hac AS (SELECT feature, target, mean, n, mean / nullif(sqrt(CASE WHEN gw > 0 THEN gw ELSE g0 END / n / n), 0) AS t FROM v)"
)
_SCREEN = (S.SESSIONS, _PANEL, _LONG, _RANKS, _IC)


def screen_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = labels.open_to_close(trade_bars(spark, sf_dir), (1, 5))
    return df.withColumns({"F_volume": F.col("volume"), "F_range": win.ratio("high", "low") - 1, "F_move": win.ratio("close", "open") - 1})


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.ranked(screen.cells(screen_panel(spark, sf_dir), list(_FEATURES), ["label_oc_1", "label_oc_5"]))


@register("i01_rank_ic", S.query("SELECT feature, target, ts, round(ic, 6) + 0.0 AS ic, n FROM ic", *_SCREEN))
def i01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.daily_ic(_ranked(spark, sf_dir)).select("feature", "target", "ts", r("ic").alias("ic"), "n")


@register("i02_newey_west", S.query("SELECT feature, target, round(mean, 6) + 0.0 AS mean, n, round(t, 4) + 0.0 AS t FROM hac", *_SCREEN, _HAC))
def i02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.hac_t(screen.daily_ic(_ranked(spark, sf_dir))).select("feature", "target", r("mean").alias("mean"), "n", r("t", 4).alias("t"))


@register("i04_bh_q", "SELECT o_custkey AS feature, 'p' AS target, round(p, 6) + 0.0 AS p, round(least(1, min(p * m / i) OVER (ORDER BY i DESC)), 6) + 0.0 AS q FROM (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, o_custkey) AS i FROM (SELECT o_custkey, ((o_custkey * 7919) % 1009 + 1) / 1010.0 AS p FROM orders GROUP BY o_custkey))")
def i04(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("feature")).distinct().withColumns({"target": F.lit("p"), "p": ((F.col("feature") * 7919) % 1009 + 1) / 1010.0})
    return screen.bh_q(p).select("feature", "target", r("p").alias("p"), r("q").alias("q"))


@register("i05_fold_signs", S.query("SELECT a.feature, a.target, sum((sign(fi) = sign(pi))::INT)::BIGINT AS same_sign, count(*) AS n_folds FROM (SELECT feature, target, fold, avg(ic) AS fi FROM ic JOIN folds ON ts BETWEEN test_start AND test_end GROUP BY 1, 2, 3) a JOIN (SELECT feature, target, avg(ic) AS pi FROM ic JOIN folds ON ts BETWEEN test_start AND test_end GROUP BY 1, 2) b USING (feature, target) GROUP BY 1, 2", *_SCREEN, _FOLDS))
def i05(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = selection.tested_folds(sessions(trade_bars(spark, sf_dir)))
    return screen.fold_signs(screen.daily_ic(_ranked(spark, sf_dir)), folds)


_QUINT = "d AS (SELECT feature, target, ts, " + ", ".join(f"avg(y) FILTER (WHERE k = {k}) AS q{k + 1}" for k in range(5)) + ", avg(y) AS market FROM (SELECT *, least(floor((rx - 0.5) / n * 5), 4) AS k FROM ranks WHERE n >= 15) GROUP BY 1, 2, 3), m AS (SELECT feature, target, avg(q1) AS q1, avg(q5) AS q5, avg(q5 - q1) AS spread, avg(market) AS market FROM d GROUP BY 1, 2)"


@register("i06_quintile_economics", S.query("SELECT feature, target, " + S.rounded({"q1": "q1", "q5": "q5", "spread": "spread", "net": "CASE WHEN spread >= 0 THEN q5 ELSE q1 END - 0.0035", "excess": "CASE WHEN spread >= 0 THEN q5 ELSE q1 END - market"}) + " FROM m", *_SCREEN, _QUINT))
def i06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.quintiles(_ranked(spark, sf_dir)).select("feature", "target", *rs(["q1", "q5", "spread", "net", "excess"]))


# The year is one value a date, so it is tested as a series.
_PASS = f"tested AS (SELECT *, {S.two_sided_p('t')} AS p FROM hac WHERE n >= 60), adjusted AS (SELECT *, least(1, min(p * m / i) OVER (ORDER BY i DESC)) AS q FROM (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p) AS i FROM tested))"
_SIGNS = "signs AS (SELECT a.feature, a.target, sum((sign(fi) = sign(pi))::INT)::BIGINT AS same_sign FROM (SELECT feature, target, fold, avg(ic) AS fi FROM ic JOIN folds ON ts BETWEEN test_start AND test_end GROUP BY 1, 2, 3) a JOIN (SELECT feature, target, avg(ic) AS pi FROM ic JOIN folds ON ts BETWEEN test_start AND test_end GROUP BY 1, 2) b USING (feature, target) GROUP BY 1, 2)"
_YEARS = "yr AS (SELECT target, ts, (x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0) * (y - avg(y) OVER w) / nullif(stddev_pop(y) OVER w, 0) AS ic FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS target, ts, year(ts)::DOUBLE AS x, avg({t}) AS y FROM panel GROUP BY ts HAVING count({t}) > 0" for t in ("label_oc_1", "label_oc_5")) + ") WINDOW w AS (PARTITION BY target))"
_YEAR_HAC = _HAC.replace("feature, ", "").replace("FROM ic ", "FROM yr ").replace("e AS (", "ye AS (", 1).replace(" g AS (", " yg AS (").replace("FROM e)", "FROM ye)").replace(" v AS (", " yv AS (").replace("FROM g GROUP BY 1, 2", "FROM yg GROUP BY 1").replace("hac AS (", "yhac AS (").replace("FROM v)", "FROM yv)")
_DRAWN = "drawn AS (SELECT ts FROM (SELECT DISTINCT ts FROM panel) ORDER BY md5(ts::VARCHAR || ':0'), ts LIMIT 60), pr AS (" + " UNION ALL ".join(f"SELECT symbol, ts, '{f}' AS feature, {S.percent_rank(f)} AS pr FROM panel JOIN drawn USING (ts) WHERE {f} IS NOT NULL" for f in _FEATURES) + "), pairs AS (SELECT a.feature AS feature_a, b.feature AS feature_b, corr(a.pr, b.pr) AS rho, count(*) AS n FROM pr a JOIN pr b USING (symbol, ts) WHERE a.feature < b.feature GROUP BY 1, 2 HAVING count(*) >= 50)"


def _walk(source: str, limit: float) -> tuple[str, ...]:
    near = f"near AS (SELECT coalesce(list(a || '>' || b), []) AS near FROM (SELECT feature_a AS a, feature_b AS b FROM pairs WHERE abs(rho) >= {limit} UNION ALL SELECT feature_b, feature_a FROM pairs WHERE abs(rho) >= {limit}))"
    order = f"o AS (SELECT feature, target, row_number() OVER (PARTITION BY target ORDER BY abs(t) DESC, feature) AS i, near FROM {source}, near)"
    step = "SELECT w.target, w.i, CASE WHEN len(c) = 0 THEN list_append(leaders, feature) ELSE leaders END, feature, coalesce(c[1], feature) FROM (SELECT w.target, o.i, leaders, o.feature, list_filter(leaders, lambda x: list_contains(near, x || '>' || o.feature)) AS c FROM walk w JOIN o ON o.target = w.target AND o.i = w.i + 1) w"
    return near, order, f"walk AS (SELECT DISTINCT target, 0::BIGINT AS i, []::VARCHAR[] AS leaders, '' AS feature, '' AS family FROM o UNION ALL {step})"


_SCREENED = (
    "SELECT feature, target, 'ranked' AS kind, n, same_sign, passes, "
    + S.rounded({"t": "t", "mean": "mean", "p": "p", "q": "q"}, 4) + ", " + S.rounded({"spread": "spread", "gross": "gross", "net": "gross - 0.0035", "excess": "gross - market"})
    + ", family FROM good LEFT JOIN (SELECT feature, target, family FROM walk WHERE i > 0) USING (feature, target) LEFT JOIN (SELECT *, CASE WHEN spread >= 0 THEN q5 ELSE q1 END AS gross FROM (SELECT feature, target, q1, q5, spread, market FROM m)) USING (feature, target)"
    + " UNION ALL SELECT 'F_year', target, 'market', n, NULL, NULL, round(t, 4) + 0.0, round(mean, 4) + 0.0, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM yhac WHERE n >= 60"
)


def screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = selection.tested_folds(sessions(trade_bars(spark, sf_dir)))
    df = screen_panel(spark, sf_dir).withColumn("F_year", F.year("ts").cast("double"))
    return screen.screen(df, [*_FEATURES, "F_year"], ["label_oc_1", "label_oc_5"], folds)


_GOOD = "good AS (SELECT *, coalesce(q <= 0.1 AND same_sign >= 4, false) AS passes FROM adjusted LEFT JOIN signs USING (feature, target))"


@register("i09_screen", S.query(_SCREENED, *_SCREEN, _FOLDS, _HAC, _PASS, _SIGNS, _QUINT, _YEARS, _YEAR_HAC, _DRAWN, _GOOD, *_walk("(SELECT * FROM good WHERE passes)", 0.8)).replace("WITH", "WITH RECURSIVE", 1))
def i09(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = {c: 4 for c in ("t", "mean", "p", "q")} | {c: 6 for c in ("spread", "gross", "net", "excess")}
    return screened(spark, sf_dir).select("feature", "target", "kind", "n", "same_sign", "passes", "family", *(r(c, d).alias(c) for c, d in wide.items()))


# The strongest first, each feature joins the first leader that it is close to, and leads where there is none.
@register("i08_families", S.query("SELECT feature, target, family FROM walk WHERE i > 0", *_SCREEN, _HAC, _PASS, _DRAWN, *_walk("adjusted", 0.3)).replace("WITH", "WITH RECURSIVE", 1))
def i08(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = screen_panel(spark, sf_dir)
    stats = screen.hac_t(screen.daily_ic(_ranked(spark, sf_dir))).filter("n >= 60")
    return screen.families_of(stats, screen.family_pairs(df, list(_FEATURES)), 0.3).select("feature", "target", "family")


@register("a02_market_level", S.query("SELECT feature, round(avg((lo = hi)::INT), 6) + 0.0 AS constant_share, avg((lo = hi)::INT) >= 0.95 AS is_market FROM (SELECT ts, 'F_volume' AS feature, count(*) AS n, min(volume) AS lo, max(volume) AS hi FROM bars GROUP BY ts UNION ALL SELECT ts, 'F_year', count(*), min(year(ts)), max(year(ts)) FROM bars GROUP BY ts) WHERE n >= 2 GROUP BY feature"))
def a02(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trade_bars(spark, sf_dir).select("ts", F.col("volume").alias("F_volume"), F.year("ts").alias("F_year"))
    return screen.market_level(df, ["F_volume", "F_year"]).select("feature", r("constant_share").alias("constant_share"), "is_market")


@register("i12_leak_screen", S.query(
    "SELECT feature, " + ", ".join(f"round(max(rho) FILTER (WHERE k = {k}), 6) + 0.0 AS rho_{k}" for k in range(1, 6)) + ", round(max(abs(rho)), 6) + 0.0 AS max_abs_rho, max(abs(rho)) >= 0.15 AS suspect FROM (SELECT feature, k, corr(rx, ry) AS rho FROM (SELECT feature, k, " + S.rank("x", "feature", "k") + " AS rx, " + S.rank("y", "feature", "k") + " AS ry FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {k} AS k, {f}::DOUBLE AS x, {_LEAD('close', -k)} / {_LEAD('close', -(k - 1))} - 1 AS y FROM panel QUALIFY x IS NOT NULL AND y IS NOT NULL" for f in _FEATURES for k in range(1, 6)) + ")) GROUP BY 1, 2) GROUP BY feature",
    _PANEL,
))
def i12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.leak_table(screen_panel(spark, sf_dir), list(_FEATURES)).select("feature", *rs([f"rho_{k}" for k in range(1, 6)]), r("max_abs_rho").alias("max_abs_rho"), "suspect")


@register("a13_family_pairs", S.query("SELECT feature_a, feature_b, round(rho, 6) + 0.0 AS rho, n FROM pairs", _PANEL, _DRAWN))
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.family_pairs(screen_panel(spark, sf_dir), list(_FEATURES)).select("feature_a", "feature_b", r("rho").alias("rho"), "n")


_DAY3 = "SELECT 'oc_2' AS target, ts, avg(outcome) FILTER (WHERE rank <= 3) - 0.0035 AS net, avg(outcome) FILTER (WHERE rank <= 3) - avg(outcome) AS excess FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY score DESC NULLS LAST, symbol) AS rank FROM {} WHERE score IS NOT NULL) GROUP BY ts"


@register("i14_bootstrap_intervals", S.query("SELECT target, n, " + S.rounded({"mean": "mean", "lo": "lo", "hi": "hi"}, 8) + " FROM boot", _SCORED, f"day AS ({_DAY3.format('scored')})", S.resampled("boot", "day", "target", "net")))
def i14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.intervals(selection.daily_top(scored(spark, sf_dir)).withColumn("target", F.lit("oc_2")), ["target"], "top3_net").select("target", "n", *rs(["mean", "lo", "hi"], 8))


@register("i16_gate", S.query(
    "SELECT target, n, " + S.rounded({"net_mean": "a.mean", "net_lo": "a.lo", "net_hi": "a.hi", "excess_mean": "b.mean", "excess_lo": "b.lo", "excess_hi": "b.hi", "recent_mean": "late"}, 8) + ", coalesce(a.lo > 0, false) AS net_clears, coalesce(late > 0, false) AS recent_clears, coalesce(b.lo > 0, false) AS excess_clears, coalesce(a.lo > 0 AND late > 0 AND b.lo > 0, false) AS passes FROM a JOIN (SELECT target, mean, lo, hi FROM b) AS b USING (target) LEFT JOIN (SELECT target, avg(net) AS late FROM day WHERE ts >= DATE '2000-01-01' GROUP BY target) USING (target)",
    _SCORED, f"day AS ({_DAY3.format('scored')})", S.resampled("a", "day", "target", "net"), S.resampled("b", "day", "target", "excess"),
))
def i16(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = inference.gate(selection.daily_top(scored(spark, sf_dir)).withColumn("target", F.lit("oc_2")), ["target"], recent="2000-01-01")
    return met.select("target", "n", *rs(["net_mean", "net_lo", "net_hi", "excess_mean", "excess_lo", "excess_hi", "recent_mean"], 8), "net_clears", "recent_clears", "excess_clears", "passes")


@register("i18_paired_comparison", S.query(
    "SELECT target, n, " + S.rounded({"mean": "mean", "lo": "lo", "hi": "hi"}, 8) + ", coalesce(lo > 0, false) AS switch FROM boot",
    _SCORED, _SCORED_B, f"one AS ({_DAY3.format('scored')})", f"two AS ({_DAY3.format('other')})", "pair AS (SELECT target, ts, two.net - one.net AS d FROM one JOIN two USING (target, ts))", S.resampled("boot", "pair", "target", "d"),
))
def i18(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (selection.daily_top(scored(spark, sf_dir, c)).withColumn("target", F.lit("oc_2")) for c in ("volume", "close"))
    return inference.paired(a, b, ["target"], "top3_net").select("target", "n", *rs(["mean", "lo", "hi"], 8), "switch")


@register("i28_walk_forward")
def i28(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per fold: rows scored, and the mean daily rank correlation of score and outcome."""
    folds = selection.tested_folds(sessions(trade_bars(spark, sf_dir)))
    out = inference.walk_forward(screen_panel(spark, sf_dir), list(_FEATURES), "label_oc_5", folds, boosting.Rules(rounds=ROUNDS, least=100))
    pairs = out.select("ts", F.lit("score").alias("feature"), F.col("fold").cast("string").alias("target"), F.col("score").alias("x"), F.col("outcome").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    return screen.daily_ic(screen.ranked(pairs), 8).groupBy(F.col("target").cast("int").alias("fold")).agg(F.avg("ic").alias("ic"), F.count("*").alias("sessions"), F.sum("n").alias("rows"))


def _mk_roll(x: str, f: str) -> str:
    w = "OVER (ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} >= 10 THEN {f}({x}) {w} END"


_STATE = "d AS (SELECT symbol, ts, close, session_idx - lag(session_idx) OVER w AS step, lag(close) OVER w AS pc FROM bars JOIN sess USING (ts) WINDOW w AS (PARTITION BY symbol ORDER BY ts)), st AS (SELECT ts, quantile_cont(r, 0.5) AS mk_ret1, avg((r > 0)::INT) AS mk_breadth, stddev_samp(r) AS mk_disp FROM (SELECT ts, CASE WHEN step = 1 THEN close / pc - 1 END AS r FROM d) GROUP BY ts)"


@register("i27_market_state", S.query("SELECT ts, " + S.rounded({"mk_ret1": "mk_ret1", "mk_breadth": "mk_breadth", "mk_disp": "mk_disp", "mk_trend20": _mk_roll("mk_ret1", "sum"), "mk_vol20": _mk_roll("mk_ret1", "stddev_samp"), "mk_breadth20": _mk_roll("mk_breadth", "avg"), "mk_disp20": _mk_roll("mk_disp", "avg")}) + " FROM st", S.SESSIONS, _STATE))
def i27(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = state.market_state(with_sessions(trade_bars(spark, sf_dir)))
    return df.select("ts", *rs([c for c in df.columns if c != "ts"]))


@register("i22_lockbox", S.query("SELECT max(ts) FILTER (WHERE session_idx < floor(n * 0.8) - 5) AS research_end, min(ts) FILTER (WHERE session_idx >= floor(n * 0.8)) AS lockbox_start FROM (SELECT *, count(*) OVER () AS n FROM sess)", S.SESSIONS))
def i22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.lockbox(sessions(trade_bars(spark, sf_dir)))


@register("i26_stock_state", S.query("SELECT symbol, ts, " + S.rounded({"st_a": S.percent_rank("volume") + " - 0.5", "st_b": S.percent_rank("m") + " - 0.5"}) + " FROM (SELECT *, abs(close / nullif(open, 0) - 1) AS m FROM bars)"))
def i26(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trade_bars(spark, sf_dir).withColumn("move", win.ratio("close", "open") - 1)
    return state.stock_state(df, (("a", "volume", False), ("b", "move", True)), 2).select("symbol", "ts", *rs(["st_a", "st_b"]))


# A mixture of independent dimensions over the state columns, whose posterior SQL can write out.
_WEIGHTS, _CENTRES, _SPREADS = (0.5, 0.3, 0.2), ((-0.2, -0.2, -0.3), (0.2, 0.0, 0.1), (0.1, 0.3, 0.4)), ((0.2, 0.3, 0.2), (0.3, 0.2, 0.3), (0.25, 0.25, 0.15))
_STATES = {"st_size": "volume", "st_month": f"(close / {S.shifted('close', 4)} - 1)", "st_quarter": f"(close / {S.shifted('close', 13)} - 1)"}


def _state_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three state columns; the first sessions of a symbol lack two, then one of them."""
    df = trade_bars(spark, sf_dir).withColumns({"month": win.ratio("close", win.lag("close", 4)) - 1, "quarter": win.ratio("close", win.lag("close", 13)) - 1})
    return state.stock_state(df, (("size", "volume", False), ("month", "month", False), ("quarter", "quarter", False)), 3).select("symbol", "ts", *_STATES)


def _log_density(k: int) -> str:
    return " + ".join([f"ln({_WEIGHTS[k]})", *(f"coalesce(-0.5 * (({c} - {_CENTRES[k][i]}) / {_SPREADS[k][i]}) ** 2 - ln({_SPREADS[k][i]}), 0)" for i, c in enumerate(_STATES))])


@register("i23_posterior", S.query(
    "SELECT symbol, ts, " + S.rounded({f"p{k}": f"exp(l{k} - top) / (exp(l0 - top) + exp(l1 - top) + exp(l2 - top))" for k in range(3)}) + " FROM (SELECT *, greatest(l0, l1, l2) AS top FROM (SELECT symbol, ts, " + ", ".join(f"{_log_density(k)} AS l{k}" for k in range(3)) + " FROM ranked))",
    "moves AS (SELECT symbol, ts, " + ", ".join(f"{x} AS v_{c}" for c, x in _STATES.items()) + " FROM bars)", "ranked AS (SELECT symbol, ts, " + ", ".join(f"{S.percent_rank(f'v_{c}')} - 0.5 AS {c}" for c in _STATES) + " FROM moves)",
))
def i23(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = mixture.Mixture(np.array(_WEIGHTS), np.array(_CENTRES), np.stack([np.diag(np.square(s)) for s in _SPREADS]))
    df = mixture.add_posterior(_state_columns(spark, sf_dir), list(_STATES), model)
    return df.select("symbol", "ts", *(r(F.get("posterior", k)).alias(f"p{k}") for k in range(3)))


@register("i24_components")
def i24(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _state_columns(spark, sf_dir)
    return mixture.choices_table(df, mixture.fit(df, list(_STATES), range(1, 7), rounds=30))


@register("i25_carried_components")
def i25b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fit on the sessions before the last fold's training end less a year and one on all before it: per component, its share of all rows under both, and the rows that it keeps."""
    df = materialised(_state_columns(spark, sf_dir))
    ends = selection.tested_folds(sessions(df)).agg(F.max("train_end").alias("late"), F.add_months(F.max("train_end"), -12).alias("early")).first()
    fits = [mixture.fit(df.filter(F.col("ts") <= F.lit(ends[e])), list(_STATES), [3], rounds=30) for e in ("early", "late")]
    if not all(fits):
        return spark.createDataFrame([], "component int, rows long, before double, carried double, kept long")
    early, late = (f[3].mixture for f in fits)
    order, _ = state.align_components(early.means, late.means)
    both = state.carried(mixture.add_posterior(mixture.add_posterior(df, list(_STATES), early, "first"), list(_STATES), late), order)
    likeliest = lambda c: F.array_position(c, F.array_max(c)).cast("int") - 1
    rows = both.withColumns({"component": likeliest("first"), "new": likeliest("posterior")})
    shares = rows.select(F.posexplode(F.arrays_zip("first", "posterior")).alias("component", "p"), "component", "new").toDF("place", "p", "component", "new")
    kept = F.col("component") == F.col("place")
    return shares.groupBy(F.col("place").alias("component")).agg(F.sum(kept.cast("long")).alias("rows"), F.avg("p.first").alias("before"), F.avg("p.posterior").alias("carried"), F.sum((kept & (F.col("new") == F.col("place"))).cast("long")).alias("kept"))


@register("l13_timing_contract", S.query(f"SELECT round(corr(ky, ks), 6) + 0.0 AS rho_same, round(corr(ky, kn), 6) + 0.0 AS rho_next, count(*) AS n, abs(corr(ky, ks)) <= 0.1 AND corr(ky, kn) >= 0.15 AS ok FROM (SELECT {S.rank('y', 'one')} AS ky, {S.rank('s', 'one')} AS ks, {S.rank('x', 'one')} AS kn FROM (SELECT *, 1 AS one FROM (SELECT {_LEAD('close', -5)} / close - 1 AS y, close / {S.shifted('close')} - 1 AS s, {_LEAD('close', -1)} / close - 1 AS x FROM bars) WHERE y IS NOT NULL AND s IS NOT NULL AND x IS NOT NULL))"))
def l13(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = state.timing(trade_bars(spark, sf_dir), win.ratio(win.lead("close", 5), "close") - 1)
    return df.select(r("rho_same").alias("rho_same"), r("rho_next").alias("rho_next"), "n", "ok")


_NESTED = (
    "nf AS (SELECT fold, train_end FROM folds WHERE train_end IS NOT NULL), ic AS (SELECT fold || '|' || feature AS feature, target, ts, ic, fold, feature AS name FROM ic0 JOIN nf ON ts <= train_end)"
)


@register("i11_nested_screen", S.query(
    "SELECT fold::INT AS fold, a.name AS feature, a.target, n, same_sign, coalesce(same_sign >= 4, false) AS stable, coalesce(q <= 0.1 AND same_sign >= 4, false) AS passes, " + S.rounded({"mean": "mean", "t": "t", "p": "p", "q": "q"}, 4) + " FROM (SELECT *, split_part(feature, '|', 1) AS fold, split_part(feature, '|', 2) AS name, least(1, min(p * m / i) OVER (PARTITION BY split_part(feature, '|', 1) ORDER BY i DESC)) AS q FROM (SELECT *, count(*) OVER (PARTITION BY split_part(feature, '|', 1)) AS m, row_number() OVER (PARTITION BY split_part(feature, '|', 1) ORDER BY p) AS i FROM tested)) a "
    "LEFT JOIN (SELECT feature, target, sum((sign(ri) = sign(pi))::INT)::BIGINT AS same_sign FROM (SELECT feature, target, run, avg(ic) AS ri FROM ic JOIN ru USING (fold, ts) GROUP BY 1, 2, 3) JOIN (SELECT feature, target, avg(ic) AS pi FROM ic GROUP BY 1, 2) USING (feature, target) GROUP BY 1, 2) USING (feature, target)",
    *_SCREEN[:-1], _IC.replace("ic AS (", "ic0 AS (", 1).replace(">= 15)", ">= 8)"), _FOLDS, _NESTED, "ru AS (SELECT fold, ts, ntile(5) OVER (PARTITION BY fold ORDER BY ts) AS run FROM sess JOIN nf ON ts <= train_end)", _HAC, f"tested AS (SELECT *, {S.two_sided_p('t')} AS p FROM hac WHERE n >= 60)",
))
def i11(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = selection.tested_folds(sessions(trade_bars(spark, sf_dir)))
    # There are 25 names, and on many sessions of the smallest table fewer than 15.
    out = state.nested_screen(screen_panel(spark, sf_dir), list(_FEATURES), ["label_oc_1", "label_oc_5"], folds, least_names=8)
    return out.select("fold", "feature", "target", "n", "same_sign", "stable", "passes", *(r(c, 4).alias(c) for c in ("mean", "t", "p", "q")))


# --- features ------------------------------------------------------------------------------------

_M = (S.BASE, S.MARKET)
_A = {f"C_{n}_sum_{k}": S.roll(c, k, "sum") for n, c in (("on", "lon"), ("id", "lid")) for k in (5, 20, 60)}
_A |= {f"C_tug_{k}": f"{S.roll('lon', k, 'sum')} - {S.roll('lid', k, 'sum')}" for k in (20, 60)}
_A |= {"C_on_absshare_20": f"{S.roll('abs(lon)', 20, 'sum')} / nullif({S.roll('abs(lon)', 20, 'sum')} + {S.roll('abs(lid)', 20, 'sum')}, 0)", "C_on_id_volratio_60": f"{S.roll('lon', 60, 'std')} / nullif({S.roll('lid', 60, 'std')}, 0)", "C_on_posfrac_20": S.roll("(lon > 0)::INT", 20), "C_id_posfrac_20": S.roll("(lid > 0)::INT", 20), "C_on_excess_20": f"{S.roll('lon', 20, 'sum')} - {S.roll('m_on', 20, 'sum')}", "C_id_excess_20": f"{S.roll('lid', 20, 'sum')} - {S.roll('m_id', 20, 'sum')}"}


def feature_query(name: str, build: Callable[[DataFrame], DataFrame], expressions: dict[str, str], *ctes: str, source: str = "bm", digits: int = 6) -> None:
    @register(name, S.query(f"SELECT symbol, ts, {S.rounded(expressions, digits)} FROM {source}", *_M, *ctes))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(based(spark, sf_dir)).select("symbol", "ts", *rs(list(expressions), digits))


feature_query("f_a_overnight", features.overnight, _A)


def _ols(y: str, x: str, n: int, out: str) -> str:
    w = S.frame(n)
    both = f"count({y} + {x}) {w} >= {n}"
    return f"CASE WHEN {both} AND regr_sxx({y}, {x}) {w} / {n} > 1e-12 THEN regr_{out}({y}, {x}) {w} END"


_B1 = f"o AS (SELECT *, {_ols('lr', 'm', 60, 'slope')} AS beta, {_ols('lr', 'm', 60, 'intercept')} AS alpha, {_ols('lr', 'm', 60, 'r2')} AS r2, {S.roll('lr', 60, 'std')} AS sdl FROM bm), q AS (SELECT *, lr - alpha - beta * m AS e, sqrt(greatest(var_pop(lr) {S.frame(60)} * (1 - r2), 0)) AS iv FROM o)"
_B = {"C_beta_60": "beta", "C_r2_60": "r2", "C_idio_vol_60": "iv", "C_beta_on_60": _ols("lon", "m_on", 60, "slope"), "C_beta_id_60": _ols("lid", "m_id", 60, "slope"), "C_resid_1d": "e", "C_resid_5d": S.roll("e", 5, "sum"), "C_resid_20d": S.roll("e", 20, "sum"), "C_max1_resid_21": S.roll("e", 21, "max"), "C_idio_skew_60": f"CASE WHEN count(e) {S.frame(60)} >= 60 THEN skewness(e) {S.frame(60)} END", "C_resid_5d_z": f"CASE WHEN iv > 1e-12 THEN {S.roll('e', 5, 'sum')} / (iv * sqrt(5)) END", "C_resid_20d_z": f"CASE WHEN iv > 1e-12 THEN {S.roll('e', 20, 'sum')} / (iv * sqrt(20)) END", "C_resid_mom_z": f"CASE WHEN {S.roll('e', 230, 'std', lag=21)} > 1e-12 THEN {S.roll('e', 230, 'sum', lag=21)} / ({S.roll('e', 230, 'std', lag=21)} * sqrt(230)) END"}


def _cond(sign: str) -> str:
    w = S.frame(120)
    y, x = f"(CASE WHEN m {sign} 0 THEN lr END)", f"(CASE WHEN m {sign} 0 AND lr IS NOT NULL THEN m END)"
    return f"CASE WHEN count({y} + {x}) {w} >= 20 AND count(lr + m) {w} = 120 AND regr_sxx({y}, {x}) {w} / count({y} + {x}) {w} > 1e-12 THEN regr_slope({y}, {x}) {w} END"


_B |= {"C_beta_down_120": _cond("<"), "C_beta_updown_120": f"({_cond('>')}) - ({_cond('<')})"}
feature_query("f_b_market_beta", features.market_beta, _B, _B1, source="q", digits=4)

_top5 = f"CASE WHEN count(r) {S.frame(21)} >= 21 THEN list_avg(list_slice(list_reverse_sort(list(r) {S.frame(21)}), 1, 5)) END"
feature_query("f_c_lottery", features.lottery, {"C_max1_21": S.roll("r", 21, "max"), "C_max5_21": _top5, "C_min1_21": S.roll("r", 21, "min"), "C_maxmin_21": f"{S.roll('r', 21, 'max')} + {S.roll('r', 21, 'min')}", "C_max_to_vol": S.over(S.roll("r", 21, "max"), S.roll("r", 60, "std"))})

_D1 = (
    "d1 AS (SELECT *, lag(high) OVER s AS h1, lag(low) OVER s AS l1, greatest(low - cp, 0) - greatest(cp - high, 0) AS gap, ln(tv) AS ltv, 4 * (ln(cp) - (ln(lag(high) OVER s) + ln(lag(low) OVER s)) / 2) * (ln(cp) - (ln(high) + ln(low)) / 2) AS ar FROM bm WINDOW s AS (PARTITION BY symbol ORDER BY ts)), "
    "d2 AS (SELECT *, pow(ln(h1 / l1), 2) + pow(ln((high - gap) / (low - gap)), 2) AS be, pow(ln(greatest(h1, high - gap) / least(l1, low - gap)), 2) AS ga FROM d1), "
    "d3 AS (SELECT *, (sqrt(2 * be) - sqrt(be)) / (3 - 2 * sqrt(2)) - sqrt(ga / (3 - 2 * sqrt(2))) AS al FROM d2), "
    f"d4 AS (SELECT *, CASE WHEN cp IS NOT NULL THEN greatest(2 * (exp(al) - 1) / (1 + exp(al)), 0) END AS cs, {S.roll('(abs(r) / tv)', 20)} AS ami FROM d3)"
)
_D = {f"C_cs_spread_{k}": S.roll("cs", k) for k in (20, 60)} | {f"C_ar_spread_{k}": f"sqrt(greatest({S.roll('ar', k)}, 0))" for k in (20, 60)}
_D |= {"C_zero_ret_frac_60": S.roll("(close = cp)::INT", 60), "C_frozen_frac_20": S.roll("(open = high AND high = low AND low = close)::INT", 20), "C_turn_shock_1": f"ln(tv / {S.roll('tv', 20, 'median', lag=1)})", "C_turn_shock_5": f"ln({S.roll('tv', 5)} / {S.roll('tv', 60, 'median', lag=5)})", "C_turn_cv_20": f"{S.roll('tv', 20, 'std')} / {S.roll('tv', 20)}", "C_amihud_shock": f"ln(ami / {S.roll('ami', 250, 'median')})", "C_pv_corr_20": f"CASE WHEN count(r + ltv) {S.frame(20)} >= 20 THEN corr(r, ltv) {S.frame(20)} END", "C_absret_turn_corr_20": f"CASE WHEN count(r + ltv) {S.frame(20)} >= 20 THEN corr(abs(r), ltv) {S.frame(20)} END"}
feature_query("f_d_liquidity", features.liquidity, _D, _D1, source="d4")


def _since(flag: str) -> str:
    return f"coalesce(least(idx - max(CASE WHEN {flag} = 1 THEN idx END) OVER (PARTITION BY symbol ORDER BY ts), 250), 250)"


_E1 = "e1 AS (SELECT *, sum(1 - lock_dn) OVER s AS gd, sum(1 - lock_up) OVER s AS gu FROM bm WINDOW s AS (PARTITION BY symbol ORDER BY ts))"
_E = {"C_lock_up": "lock_up", "C_lock_dn": "lock_dn", "C_n_lock_up_20": S.roll("lock_up", 20, "sum"), "C_n_lock_dn_20": S.roll("lock_dn", 20, "sum"), "C_n_lock_dn_60": S.roll("lock_dn", 60, "sum"), "C_open_lock_dn_20": S.roll("open_lock_dn", 20, "sum"), "C_days_since_lock_dn": _since("lock_dn"), "C_days_since_lock_up": _since("lock_up"), "C_streak_lock_dn": "sum(lock_dn) OVER (PARTITION BY symbol, gd ORDER BY ts)", "C_streak_lock_up": "sum(lock_up) OVER (PARTITION BY symbol, gu ORDER BY ts)", "C_band_proxy_250": S.roll("abs(r)", 250, "max"), "C_ret_to_band": S.over("r", S.roll("abs(r)", 250, "max"))}
feature_query("f_e_locks", features.lock_history, _E, _E1, source="e1")

_F1 = f"f1 AS (SELECT *, greatest(high - low, coalesce(abs(high - cp), 0), coalesce(abs(low - cp), 0)) AS tr, (high + low + close) / 3 AS typ, CASE WHEN high - low > 1e-12 THEN ((close - low) - (high - close)) / (high - low) ELSE 0 END AS clv, (high - low) / close AS rg FROM bm), f2 AS (SELECT *, {S.roll('tr', 14)} AS atr FROM f1)"
_F = {f"C_dist_sma{k}_atr": S.over(f"close - {S.roll('close', k)}", "atr") for k in (50, 200)}
_F |= {f"C_dist_vwap{k}_atr": S.over(f"close - {S.roll('typ * volume', k, 'sum')} / {S.roll('volume', k, 'sum')}", "atr") for k in (20, 60)}
_F |= {f"C_eff_{k}": S.over(f"abs(close - {S.shifted('close', k)})", S.roll("abs(close - cp)", k, "sum")) for k in (10, 20)}
_F |= {"C_close_typical_atr": S.over("close - typ", "atr"), "C_clv": "clv", "C_clv_mean_5": S.roll("clv", 5), "C_clv_mean_20": S.roll("clv", 20), "C_upper_shadow_atr": S.over("high - greatest(open, close)", "atr"), "C_lower_shadow_atr": S.over("least(open, close) - low", "atr"), "C_ret_z_60": S.over("r", S.roll("r", 60, "std")), "C_on_z_60": S.over("lon", S.roll("lon", 60, "std")), "C_id_z_60": S.over("lid", S.roll("lid", 60, "std"))}
_F |= {f"C_{n}_pctile_250": f"CASE WHEN count({x}) {S.frame(250)} >= 250 THEN len(list_filter(list({x}) {S.frame(250)}, lambda v: v < {x})) / 250.0 END" for n, x in (("range", "rg"), ("turn", "tv"), ("absret", "abs(r)"))}
_F |= {f"C_days_since_{n}250": f"CASE WHEN count(close) {S.frame(250)} >= 250 THEN (idx - arg_max(idx, ROW({x}, idx)) {S.frame(250)}) / 250.0 END" for n, x in (("hi", "close"), ("lo", "-close"))}


def _with_means(df: DataFrame) -> DataFrame:
    """The group without its two recursive columns, which no SQL here has."""
    return features.location(df.withColumns({"ema20": F.lit(None).cast("double"), "ema50": F.lit(None).cast("double")}))


feature_query("f_f_location", _with_means, _F, _F1, source="f2", digits=4)

_G = {"C_mom_12_1": f"ln({S.shifted('close', 21)} / {S.shifted('close', 252)})", "C_mom_6_1": f"ln({S.shifted('close', 21)} / {S.shifted('close', 126)})", "C_ret_2_5": f"ln({S.shifted('close', 1)} / {S.shifted('close', 5)})", "C_fip_id": f"sign(ln({S.shifted('close', 21)} / {S.shifted('close', 251)})) * ({S.roll('(r < 0)::INT', 230, lag=21)} - {S.roll('(r > 0)::INT', 230, lag=21)})", "C_season_month": "sm"}
_G1 = "mo AS (SELECT *, ln(c / lag(c) OVER (PARTITION BY symbol ORDER BY y, mm)) AS mr FROM (SELECT symbol, year(ts) AS y, month(ts) AS mm, arg_max(close, ts) AS c FROM bars GROUP BY 1, 2, 3)), se AS (SELECT a.symbol, a.y, a.mm, avg(b.mr) AS sm FROM mo a JOIN mo b ON a.symbol = b.symbol AND a.mm = b.mm AND b.y BETWEEN a.y - 5 AND a.y - 1 WHERE b.mr IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 2), g AS (SELECT bm.*, sm FROM bm LEFT JOIN se ON bm.symbol = se.symbol AND year(bm.ts) = se.y AND month(bm.ts) = se.mm)"
feature_query("f_g_momentum", features.momentum, _G, _G1, source="g")


def _day_roll(x: str, n: int, f: str) -> str:
    w = f"OVER (ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} >= {n} THEN {f}({x}) {w} END"


_I = {c: c for c in ("M_disp_1d", "M_breadth_up", "M_share_lock_dn", "M_share_lock_up", "M_on_1d", "M_id_1d", "m")} | {"M_on_sum_20": _day_roll("M_on_1d", 20, "sum"), "M_id_sum_20": _day_roll("M_id_1d", 20, "sum"), "M_disp_z_60": f"(M_disp_1d - {_day_roll('M_disp_1d', 60, 'avg')}) / nullif({_day_roll('M_disp_1d', 60, 'stddev_samp')}, 0)", "M_cal_days_to_month_end": "last_day(ts) - ts"}


@register("f_i_market_state", S.query(f"SELECT ts, {S.rounded(_I)} FROM mk", *_M))
def fi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.market(features.base(trade_bars(spark, sf_dir))).select("ts", *rs(list(_I)))


_H1 = f"h AS (SELECT *, {S.percent_rank('tug')} AS pr_tug, {S.percent_rank('ts1')} AS pr_ts1, {S.percent_rank('mx')} AS pr_mx FROM (SELECT *, {S.roll('lon', 20, 'sum')} - {S.roll('lid', 20, 'sum')} AS tug, ln(tv / {S.roll('tv', 20, 'median', lag=1)}) AS ts1, {S.roll('r', 21, 'max')} AS mx FROM bm))"
_H = {"PR_C_tug_20": "pr_tug", "PR_C_turn_shock_1": "pr_ts1", "PR_C_max1_21": "pr_mx", "I_cgw_1": "r * ts1", "I_gap_turn": "lon * ts1", "I_id_turn": "lid * ts1", "I_lockdn_turn": "lock_dn * ts1", "I_rev_disp": "r * M_disp_1d"}


def _all_products(df: DataFrame) -> DataFrame:
    for group in ("A", "B", "C", "D", "E"):
        df = features.GROUPS[group](df)
    return features.interactions(df)


feature_query("f_h_interactions", _all_products, _H, _H1, source="h")


def _ema(n: int) -> str:
    return f"CASE WHEN idx >= {n} THEN list_reduce(list(close) OVER (PARTITION BY symbol ORDER BY ts), lambda y, x: {1 - 2 / (n + 1)!r} * y + {2 / (n + 1)!r} * x) END"


def _delay(lags: int = 4, window: int = 120) -> tuple[str, ...]:
    """The factorisation of the lags' covariances, written out; each name may use those before it."""
    x = [f"m{k}" for k in range(lags + 1)]
    over = S.frame(window)
    lagged = "lagged AS (SELECT symbol, ts, idx, lr, " + ", ".join(f"lag(m, {k}) OVER (PARTITION BY symbol ORDER BY ts) AS m{k}" for k in range(lags + 1)) + " FROM bm)"
    whole = " AND ".join(f"{c} IS NOT NULL" for c in ("lr", *x))
    parts = {f"s{i}{j}": f"covar_pop(m{i}, m{j}) {over}" for i in range(lags + 1) for j in range(i + 1)} | {f"c{i}": f"covar_pop(m{i}, lr) {over}" for i in range(lags + 1)} | {"var": f"var_pop(lr) {over}"}
    covered = f"covered AS MATERIALIZED (SELECT symbol, ts, idx, count(*) FILTER ({whole}) {over} = {window} AS whole, " + ", ".join(f"{e} AS {n}" for n, e in parts.items()) + " FROM lagged)"
    steps = []
    for i in range(lags + 1):
        for j in range(i):
            steps.append((f"l{i}{j}", f"({' - '.join([f's{i}{j}', *(f'l{i}{k} * l{j}{k}' for k in range(j))])}) / nullif(l{j}{j}, 0)"))
        left = " - ".join([f"s{i}{i}", *(f"l{i}{k} * l{i}{k}" for k in range(i))])
        steps.append((f"l{i}{i}", f"CASE WHEN whole AND {left} > 1e-10 * s{i}{i} THEN sqrt({left}) END"))
        steps.append((f"z{i}", f"({' - '.join([f'c{i}', *(f'l{i}{k} * z{k}' for k in range(i))])}) / nullif(l{i}{i}, 0)"))
    for i in reversed(range(lags + 1)):
        steps.append((f"b{i}", f"({' - '.join([f'z{i}', *(f'l{k}{i} * b{k}' for k in range(i + 1, lags + 1))])}) / nullif(l{i}{i}, 0)"))
    fitted = " + ".join(f"z{i} * z{i}" for i in range(lags + 1))
    steps.append(("delay", f"CASE WHEN var * {window} > 1e-12 AND ({fitted}) / nullif(var, 0) > 1e-12 THEN 1 - z0 * z0 / nullif({fitted}, 0) END"))
    steps.append(("lagbeta", f"CASE WHEN var * {window} > 1e-12 THEN {' + '.join(f'b{i}' for i in range(1, lags + 1))} END"))
    # A step in a query of its own is worked out once, however often its name is used.
    levels = [f"d{k + 1} AS MATERIALIZED (SELECT *, {e} AS {n} FROM {f'd{k}' if k else 'covered'})" for k, (n, e) in enumerate(steps)]
    return lagged, covered, *levels, f"factored AS (SELECT * FROM d{len(steps)})"


@register("f_recursive_means_and_delay", S.query("SELECT symbol, ts, " + S.rounded({"ema20": "ema20", "ema50": "ema50", "C_delay_120": "delay", "C_lagbeta_120": "lagbeta"}, 4) + f" FROM factored JOIN (SELECT symbol, ts, {_ema(20)} AS ema20, {_ema(50)} AS ema50 FROM p) USING (symbol, ts)", *_M, *_delay()))
def frec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.recursive(based(spark, sf_dir)).select("symbol", "ts", *rs(["ema20", "ema50", "C_delay_120", "C_lagbeta_120"], 4))


# --- drawdown ------------------------------------------------------------------------------------


@register("w22_drawdown", S.query("SELECT symbol, ts, " + S.rounded({"drawdown": "close / max(close) OVER (PARTITION BY symbol ORDER BY ts) - 1"}) + " FROM bars"))
def w22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade_bars(spark, sf_dir).select("symbol", "ts", r(win.ratio("close", F.max("close").over(win.past())) - 1).alias("drawdown"))


# --- audits --------------------------------------------------------------------------------------


@register("q01_label_rules", S.query("SELECT * FROM (VALUES ('mae_not_above_mfe'), ('return_within_excursions'), ('buyable_is_flag'), ('entries_agree')) v(\"check\") CROSS JOIN (SELECT 0::BIGINT AS failed, count(*) AS seen FROM bars)"))
def q01(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = labels.next_open_bracket(labels.with_atr(labels.excursions(labels.open_to_close(trade_bars(spark, sf_dir)))))
    return audit.checks(df, audit.label_rules())


@register("q02_compare_panels", S.query("SELECT count(*) FILTER (WHERE a.ts IS NOT NULL AND b.ts IS NOT NULL) AS shared, count(*) FILTER (WHERE b.ts IS NULL) AS only_old, count(*) FILTER (WHERE a.ts IS NULL) AS only_new, count(*) FILTER (WHERE a.ts IS NOT NULL AND b.ts IS NOT NULL AND a.symbol = 'Brand#22') AS differ FROM (SELECT * FROM bars WHERE symbol <> 'Brand#11') a FULL JOIN (SELECT * FROM bars WHERE symbol <> 'Brand#33') b ON a.symbol = b.symbol AND a.ts = b.ts"))
def q02(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = trade_bars(spark, sf_dir)
    new = bars.filter("symbol <> 'Brand#33'").withColumn("close", F.when(F.col("symbol") == "Brand#22", F.col("close") + 1).otherwise(F.col("close")))
    return audit.compare(bars.filter("symbol <> 'Brand#11'"), new, ["symbol", "ts"], "close")


@register("q04_rederived_outcomes", S.query(f"SELECT count(*) AS picks, avg(found::INT) AS share, coalesce(avg(found::INT) >= 0.995, false) AS ok FROM (SELECT coalesce(abs(a.outcome - t.outcome) <= 1e-6, a.outcome IS NULL AND t.outcome IS NULL) AS found FROM ({_top('scored', 3)}) a LEFT JOIN (SELECT x.symbol, x.ts, z.close / nullif(y.open, 0) - 1 AS outcome FROM b x LEFT JOIN b y ON y.symbol = x.symbol AND y.idx = x.idx + 1 LEFT JOIN b z ON z.symbol = x.symbol AND z.idx = x.idx + 2) t USING (symbol, ts))", S.BASE, _SCORED))
def q04(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = labels.locked_exit(trade_bars(spark, sf_dir), 2)
    return audit.rederived(selection.picks(scored(spark, sf_dir), 3), truth, ["symbol", "ts"])
