"""Bars, sessions and other inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Total order of trades inside a session.
TRADE_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean(df: DataFrame, *columns: str) -> DataFrame:
    """NaN and infinite values become NULL, once, where data come in."""
    return df.withColumns({c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)) for c in columns})


def trade_bars(spark: SparkSession, sf_dir: str, symbol: str = "p_brand") -> DataFrame:
    """Weekly bars (symbol, ts, open, high, low, close, volume) of the line items of each brand.

    A hash aggregate cannot hold a struct's minimum, and sorting all line items would be most of the work. So numbers alone give each
    bar's first and last order, and only the bar's trades of these two orders are compared in full.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", F.col(symbol).alias("symbol"))
    trades = table(spark, sf_dir, "lineitem").select(*TRADE_ORDER)
    price = F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))
    on_part = F.col("l_partkey") == F.col("p_partkey")
    day, order = F.col("l_shipdate"), F.col("l_orderkey")
    monday = F.date_trunc("week", day).cast("date")
    days = trades.join(part, on_part).groupBy("symbol", "l_shipdate").agg(
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.sum("l_quantity").alias("volume"),
        F.when(~F.max(order.isNull()), F.min(order)).alias("least"),  # an unknown order comes before all others
        F.max(order).alias("most"),
    )
    week = days.groupBy("symbol", monday.alias("ts")).agg(
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.sum("volume").alias("volume"),
        F.min(F.struct(day.alias("day"), F.col("least").alias("order"))).alias("first"),
        F.max(F.struct(day.alias("day"), F.col("most").alias("order"))).alias("last"),
    )
    ends = week.select("*", F.explode(F.array("first.order", "last.order")).alias("order"))  # two rows a bar
    # One number is the key, of an unknown order that of its week, so that those of a week meet only its bars; it may meet others too, as
    # all trades of a bar may be compared.
    known = lambda c, ts: F.coalesce(c, -1 - F.unix_date(ts), F.lit(-1))
    inside = day.between(F.col("first.day"), F.col("last.day")) | (day.isNull() & F.col("first.day").isNull())
    found = trades.join(F.broadcast(ends), (known(order, monday) == known(F.col("order"), F.col("ts"))) & inside)
    found = found.join(part.withColumnRenamed("symbol", "_symbol"), on_part).filter(F.col("symbol").eqNullSafe(F.col("_symbol")))
    key = F.struct(*TRADE_ORDER)
    return found.groupBy("symbol", "ts").agg(
        F.min_by(price, key).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by(price, key).alias("close"),
        F.max("volume").alias("volume"),
    )


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the values of each event type; volume is the number of events."""
    key = F.struct("ts", "event_id")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("symbol"), F.col("ts").cast("date").alias("day")).agg(
        F.min_by("value", key).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", key).alias("close"), F.count("*").cast("double").alias("volume")
    ).withColumnRenamed("day", "ts")


def sessions(bars: DataFrame) -> DataFrame:
    """(ts, session_idx) of all dates; as many rows as dates."""
    return bars.select("ts").distinct().withColumn("session_idx", (F.row_number().over(W.orderBy("ts")) - 1).cast("int"))


def with_sessions(bars: DataFrame) -> DataFrame:
    return bars.join(F.broadcast(sessions(bars)), "ts")  # a row per date: thousands in a lifetime of sessions


def symbol_list(spark: SparkSession, path: str) -> DataFrame:
    """One symbol a line; blank lines and comments after # go."""
    line = F.upper(F.trim(F.split("value", "#")[0]))
    return spark.read.text(path).select(line.alias("symbol")).filter("symbol <> ''").distinct()
