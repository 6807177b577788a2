"""Intervals for daily series, and the decisions that rest on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import demean
from tidemark.operators import boosting
from tidemark.operators.boosting import Rules

LEVEL, REPLICATES, BLOCK, SEED = 0.9875, 10_000, 10, 7
RECENT = "2024-01-01"


def finite(value: str | Column) -> Column:
    """A number, or NULL where it is unknown or not finite."""
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    return F.when(F.abs(x) < float("inf"), x)  # NaN is larger than infinity


def block_start(replicate: Column, place: Column, n: Column, seed: int) -> Column:
    """Where a block begins, from 0 to n - 1: 32 bits of a digest of seed, replicate and the block's place.

    Series of equal length get equal blocks, so their intervals are of the same resampled dates.
    """
    digest = F.md5(F.concat_ws(":", F.lit(seed), replicate, place).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n


def resampled(daily: DataFrame, by: list[str], value: str, replicates: int, block: int, seed: int) -> DataFrame:
    """A row for each series and replicate: the mean of a circular moving-block resample; with n and the series' own mean.

    A series has a row per date and is held as one array; the sums of all blocks, and of all last, shorter ones, are
    taken once for each of its dates, and a replicate adds some of them. A series with fewer values
    than two blocks has one row without a replicate.
    """
    dated = F.sort_array(F.collect_list(F.when(finite(value).isNotNull(), F.struct("ts", finite(value).alias("x")))))
    n, values = F.col("_n"), F.col("_v")
    series = daily.groupBy(*by).agg(F.transform(dated, lambda s: s["x"]).alias("_v")).withColumn("_n", F.size("_v").cast("long"))
    sums = lambda size: F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.aggregate(F.slice(F.concat(values, F.slice(values, 1, block)), i, size), F.lit(0.0), lambda a, x: a + x))
    enough = n >= 2 * block
    rest = (n % block).cast("int")
    series = series.withColumns({"mean": F.when(n > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n), "_full": F.when(enough, sums(F.lit(block))), "_last": F.when(enough & (rest > 0), sums(rest))})
    rows = series.withColumn("replicate", F.explode_outer(F.when(enough, F.sequence(F.lit(0), F.lit(replicates - 1)))))
    at = lambda place: block_start(F.col("replicate"), place, n, seed).cast("int")
    whole = F.floor(n / block).cast("int")
    total = F.aggregate(F.sequence(F.lit(0), whole - 1), F.lit(0.0), lambda a, k: a + F.get("_full", at(k))) + F.coalesce(F.get("_last", at(whole)), F.lit(0.0))
    return rows.select(*by, F.col("_n").alias("n"), "mean", "replicate", F.when(F.col("replicate").isNotNull(), total / n).alias("resampled"))


def intervals(daily: DataFrame, by: list[str], value: str, level: float = LEVEL, replicates: int = REPLICATES, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """Per series: n, mean and the interval of the mean from circular moving blocks; none for fewer values than two blocks."""
    low = (1 - level) / 2
    ends = F.percentile("resampled", F.array(F.lit(low), F.lit(1 - low)))
    out = resampled(daily.select(*by, "ts", value), by, value, replicates, block, seed).groupBy(*by).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), ends.alias("_ends"))
    return out.select(*by, "n", "mean", F.get("_ends", 0).alias("lo"), F.get("_ends", 1).alias("hi"))


def gate(daily: DataFrame, by: list[str], net: str = "top3_net", excess: str = "top3_excess", recent: str = RECENT, **how: float) -> DataFrame:
    """Per series: net interval above zero, recent mean above zero, excess interval above zero, and all three."""
    a = intervals(daily, by, net, **how).select(*by, "n", F.col("mean").alias("net_mean"), F.col("lo").alias("net_lo"), F.col("hi").alias("net_hi"))
    b = intervals(daily, by, excess, **how).select(*by, F.col("mean").alias("excess_mean"), F.col("lo").alias("excess_lo"), F.col("hi").alias("excess_hi"))
    late = daily.filter(F.col("ts") >= F.lit(recent).cast("date")).groupBy(*by).agg(F.avg(net).alias("recent_mean"))
    met = a.join(b, by).join(late, by, "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    met = met.withColumns({"net_clears": yes(F.col("net_lo") > 0), "recent_clears": yes(F.col("recent_mean") > 0), "excess_clears": yes(F.col("excess_lo") > 0)})
    return met.withColumn("passes", F.col("net_clears") & F.col("recent_clears") & F.col("excess_clears"))


def paired(a: DataFrame, b: DataFrame, by: list[str], value: str, **how: float) -> DataFrame:
    """Interval of the daily difference b - a over shared dates, and whether b is clearly better."""
    met = a.select(*by, "ts", F.col(value).alias("_a")).join(b.select(*by, "ts", F.col(value).alias("_b")), [*by, "ts"]).withColumn("difference", F.col("_b") - F.col("_a"))
    return intervals(met, by, "difference", **how).withColumn("switch", F.coalesce(F.col("lo") > 0, F.lit(False)))


def tail_share(trades: DataFrame, by: list[str], value: str, share: float = 0.05) -> DataFrame:
    """Share of a total that its best ``share`` of rows (one at least) carries."""
    from pyspark.sql.window import Window as W

    ranked = trades.filter(F.col(value).isNotNull()).withColumns({"_i": F.row_number().over(W.partitionBy(*by).orderBy(F.desc(value), "ts", "symbol")), "_n": F.count(F.lit(1)).over(W.partitionBy(*by))})
    top = F.col("_i") <= F.greatest(F.floor(F.col("_n") * share), F.lit(1))
    return ranked.groupBy(*by).agg(F.try_divide(F.sum(F.when(top, F.col(value))), F.sum(value)).alias("tail_share"), F.count("*").alias("n"))


def walk_forward(panel: DataFrame, features: list[str], target: str, folds: DataFrame, rules: Rules = Rules(), cut: float = 0.01) -> DataFrame:
    """(ts, symbol, fold, score, outcome): each fold's test rows, scored by boosted trees trained on the sessions before its embargo.

    The outcome is taken off its date's mean and cut at the 1st and 99th percentile of the training rows. Folds are a handful; all are
    trained in the same passes. Features are used as they are: what is unknown has a bin of its own.
    """
    base = panel.select("ts", "symbol", target, *(F.col(c).try_cast("double").alias(c) for c in features)).withColumn("_y", demean(target))
    spans = F.broadcast(folds.filter("train_end IS NOT NULL").select("fold", "train_end", "test_start", "test_end"))
    train = base.filter("_y IS NOT NULL").join(spans, F.col("ts") <= F.col("train_end")).select("fold", "_y", *features)
    ends = train.groupBy("fold").agg(F.percentile("_y", F.array(F.lit(cut), F.lit(1 - cut))).alias("_ends"))  # a row per fold
    train = train.join(F.broadcast(ends), "fold").withColumn("_y", F.greatest(F.get("_ends", 0), F.least(F.get("_ends", 1), F.col("_y"))))
    model = boosting.fit(train, "fold", "_y", features, rules)
    test = base.join(spans, F.col("ts").between(F.col("test_start"), F.col("test_end"))).withColumn("outcome", F.col(target))
    return boosting.predict(test, model, "fold", ["ts", "symbol", "fold", "outcome"])
