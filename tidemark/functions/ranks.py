"""Ranks over a whole table, without a task that holds it.

Values are counted first, then cut into runs by approximate quantiles of each group; running
counts are taken inside a run and shifted by the sizes of the runs before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

RUNS = 64
#: A value with more rows than this is joined by broadcast; there are fewer such values than rows over it.
HEAVY = 100_000


def _runs(counted: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Adds ``_run`` to distinct values; the cuts are a short list per group and are kept on the driver."""
    cuts = counted.groupBy(*keys).agg(F.percentile_approx(value, [k / RUNS for k in range(1, RUNS)], 1000).alias("_cuts")).collect()
    kinds = ", ".join([*(f"{k} {counted.schema[k].dataType.simpleString()}" for k in keys), f"_cuts array<{counted.schema[value].dataType.simpleString()}>"])
    table = counted.sparkSession.createDataFrame([tuple(r) for r in cuts], kinds)
    met = counted.join(F.broadcast(table), keys) if keys else counted.crossJoin(F.broadcast(table))  # cuts of no group are one row
    return met.withColumn("_run", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")


def counted_values(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, value, n, below) of the values that are known: how many rows have one, and how many a smaller one."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    placed = _runs(counted, value, keys)
    order = W.partitionBy(*keys).orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    before = placed.groupBy(*keys, "_run").agg(F.sum("n").alias("_size")).withColumn("_before", F.coalesce(F.sum("_size").over(order), F.lit(0))).drop("_size")
    inside = W.partitionBy(*keys, "_run").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    return placed.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(before), [*keys, "_run"]).select(*keys, value, "n", (F.col("_in") + F.col("_before")).alias("below"), "_run")


def join_values(df: DataFrame, values: DataFrame, on: list[str]) -> DataFrame:
    """Joins rows to a table of values with their numbers of rows ``n``; the commonest values are sent to all tasks."""
    heavy = values.filter(F.col("n") > HEAVY).withColumn("_heavy", F.lit(True)).drop("n")
    names = [c for c in heavy.columns if c not in on]
    marked = df.join(F.broadcast(heavy), on, "left")
    rest = marked.filter("_heavy IS NULL").drop(*names).join(values.drop("n"), on, "left")
    return marked.filter("_heavy").drop("_heavy").unionByName(rest)


def pooled_rank(df: DataFrame, columns: list[str], keys: list[str], prefix: str = "r_") -> DataFrame:
    """Adds the average rank of each column within the keys, as ``prefix`` + name; unknown values have none."""

    def add(rows: DataFrame, c: str) -> DataFrame:
        values = counted_values(df, c, keys)
        ranks = values.select(*keys, c, "n", (F.col("below") + (F.col("n") + 1) / 2).alias(prefix + c))
        return join_values(rows, ranks, [*keys, c])

    return reduce(add, columns, df)


def reverse_minimum(values: DataFrame, value: str, of: Column, name: str) -> DataFrame:
    """Adds to ``counted_values`` without keys the least of ``of`` over this value and all larger ones."""
    df = values.withColumn("_of", of)
    later = W.orderBy("_run").rowsBetween(1, W.unboundedFollowing)  # a row per run
    ends = df.groupBy("_run").agg(F.min("_of").alias("_least")).withColumn("_after", F.min("_least").over(later)).drop("_least")
    inside = W.partitionBy("_run").orderBy(value).rowsBetween(0, W.unboundedFollowing)
    return df.withColumn("_min", F.min("_of").over(inside)).join(F.broadcast(ends), "_run").withColumn(name, F.least("_min", "_after")).drop("_of", "_min", "_after")
