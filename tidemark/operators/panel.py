"""From bars to a panel: universe, liquidity, cross-section, outside series, incremental rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions.windows import percent_rank, ratio, roll, z_score

# Funds are named by these endings, beginnings and parts.
FUND_PATTERN = "(BEES|ETF)$|^SETF|ETF"


def is_fund(symbol: Column, extra: list[str] | None = None) -> Column:
    by_name = F.upper(symbol).rlike(FUND_PATTERN)
    return by_name | F.upper(symbol).isin([s.upper() for s in extra]) if extra else by_name


def classify(symbols: DataFrame, isin: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Adds is_fund and where that is known from: the ISIN where there is one, else the user's list, else the name."""
    joined = symbols.join(isin, "symbol", "left")
    known, named = F.col("isin").isNotNull(), F.upper("symbol").isin([s.upper() for s in extra or []])
    return joined.withColumns({"is_fund": F.when(known, F.col("isin").startswith("INF")).otherwise(is_fund(F.col("symbol"), extra)), "source": F.when(known, "isin").when(named, "user_list").otherwise("name")})


def dedupe_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in a total order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def long_enough(bars: DataFrame, least: int) -> DataFrame:
    """Symbols with ``least`` rows or more."""
    return bars.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("symbol"))).filter(F.col("_n") >= least).drop("_n")


def liquidity_floor(panel: DataFrame, floor: float, window: int = 60, least: int = 40, turnover: Column | None = None) -> DataFrame:
    """Keeps rows whose trailing median turnover, as of the row, reaches the floor; adds turnover_med.

    Rows with too little history to tell are dropped.  Comes before any ranking per date.
    """
    value = turnover if turnover is not None else F.col("close") * F.col("volume")
    return panel.withColumn("turnover_med", roll(value, window, "median", least)).filter(F.col("turnover_med") >= floor)


def thin_dates(panel: DataFrame, least: int = 20) -> DataFrame:
    """Drops dates with fewer than ``least`` rows."""
    return panel.withColumn("universe_size", F.count(F.lit(1)).over(W.partitionBy("ts")).cast("int")).filter(F.col("universe_size") >= least)


def add_cross_section(panel: DataFrame, columns: list[str]) -> DataFrame:
    """Adds X_rank_ and X_z_ of each column, and X_universe_size, all within the date."""
    out = {f"X_rank_{c}": percent_rank(c) for c in columns} | {f"X_z_{c}": z_score(c) for c in columns}
    return panel.withColumns(out | {"X_universe_size": F.count(F.lit(1)).over(W.partitionBy("ts")).cast("int")})


def add_market_relative(panel: DataFrame, index: DataFrame) -> DataFrame:
    """Joins the index's state by date; excess return and relative volatility against it."""
    joined = panel.join(F.broadcast(index), "ts", "left")  # a row per date
    return joined.withColumns({"X_excess_ret_1d": F.col("ret_1d") - F.col("MKT_ret_1d"), "X_relvol_20": ratio("realvol_20", F.nullif(F.col("MKT_realvol_20"), F.lit(0.0)))})


def as_of_sessions(series: DataFrame, calendar: DataFrame, lag_sessions: int, value: str = "value") -> DataFrame:
    """(ts, value, stale) on every session: the last value known ``lag_sessions`` sessions before.

    ``stale`` says that the series had no observation of its own on that earlier session.
    """
    w = W.orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    own = calendar.select("ts", F.lit(True).alias("is_session")).join(series.select("ts", value), "ts", "full")
    filled = own.withColumn("last", F.last(value, True).over(w)).withColumn("own", F.col(value).isNotNull()).filter("is_session")
    order = W.orderBy("ts")
    return filled.select("ts", F.lag("last", lag_sessions).over(order).alias(value), (~F.coalesce(F.lag("own", lag_sessions).over(order), F.lit(False))).alias("stale"))


def as_of(left: DataFrame, right: DataFrame, by: str, value: str) -> DataFrame:
    """Last value of ``right`` at or before each row of ``left``, within ``by``; by union and one window."""
    rows = left.withColumns({"_value": F.lit(None).cast(right.schema[value].dataType), "_left": F.lit(1)})
    marks = right.select(by, "ts", F.col(value).alias("_value"), F.lit(0).alias("_left"))
    w = W.partitionBy(by).orderBy("ts", "_left").rowsBetween(W.unboundedPreceding, 0)
    return rows.unionByName(marks, allowMissingColumns=True).withColumn(value, F.last("_value", True).over(w)).filter("_left = 1").drop("_value", "_left")


def universe_hash(symbols: DataFrame) -> DataFrame:
    """One row: a hash that does not depend on the order of the symbols."""
    return symbols.agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_set("symbol")), "|"), 256), 1, 16).alias("universe_hash"))


def upsert_tail(old: DataFrame, new: DataFrame, calendar: DataFrame, rebuild: int) -> DataFrame:
    """Replaces the last ``rebuild`` sessions, and whatever symbols are gone, by the new rows.

    ``tidemark.sources.store`` commits such a result to a panel kept by months.
    """
    first = calendar.orderBy(F.desc("ts")).limit(rebuild).agg(F.min("ts").alias("first"))
    kept = old.join(F.broadcast(first), F.col("ts") < F.col("first")).drop("first").join(new.select("symbol").distinct(), "symbol", "left_semi")
    tail = new.join(F.broadcast(first), F.col("ts") >= F.col("first")).drop("first")
    return kept.unionByName(tail)
