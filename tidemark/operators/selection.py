"""Walk-forward folds, daily selection by score, and comparison of selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions.windows import average_rank, correlation, percent_rank


def by_score(score: str = "score", *per: str) -> W:
    """Best score first, ties to the smaller symbol, unknown scores last."""
    return W.partitionBy(*(per or ("ts",))).orderBy(F.desc_nulls_last(score), "symbol")


def tested_folds(calendar: DataFrame, n: int = 5, embargo: int = 5, first_share: float = 0.35) -> DataFrame:
    """Cuts the last part of the sessions into n runs; training ends ``embargo`` + 1 sessions before each.

    ``calendar`` has (ts, session_idx); the first runs are one longer where the cut is uneven.
    """
    total = F.count("*").over(W.partitionBy())
    start = F.floor(total * first_share)
    days = calendar.withColumn("_start", start).filter(F.col("session_idx") >= F.col("_start"))
    days = days.withColumn("fold", F.ntile(n).over(W.orderBy("ts")))
    runs = days.groupBy("fold").agg(F.min("ts").alias("test_start"), F.max("ts").alias("test_end"), F.min("session_idx").alias("_first"), F.count("*").alias("n_sessions"))
    ends = calendar.select(F.col("ts").alias("train_end"), (F.col("session_idx") + embargo + 1).alias("_first"))
    return runs.join(ends, "_first", "left").select("fold", "train_end", "test_start", "test_end", "n_sessions")


def expanding_folds(calendar: DataFrame, n: int = 5, embargo: int = 5) -> DataFrame:
    """Cuts all sessions into n + 1 runs; each but the first is tested on what came before it, less the embargo."""
    days = calendar.withColumn("fold", F.ntile(n + 1).over(W.orderBy("ts")) - 1)
    runs = days.groupBy("fold").agg(F.min("ts").alias("test_start"), F.max("ts").alias("test_end"), F.min("session_idx").alias("_first"), F.count("*").alias("n_sessions")).filter("fold > 0")
    ends = calendar.select(F.col("ts").alias("train_end"), (F.col("session_idx") + embargo + 1).alias("_first"))
    return runs.join(ends, "_first", "left").select("fold", "train_end", "test_start", "test_end", "n_sessions")


def picks(scored: DataFrame, depth: int = 10) -> DataFrame:
    """The first ``depth`` of each date, with rank; rows without a score are not ranked."""
    known = scored.filter(F.col("score").isNotNull())
    return known.withColumn("rank", F.row_number().over(by_score())).filter(F.col("rank") <= depth)


def daily_top(scored: DataFrame, sizes: tuple[int, ...] = (1, 3, 5, 10), cost: float = 0.0035, tie_at: int = 3) -> DataFrame:
    """Per date: gross, net and excess of the first n, how many of them have no outcome, and a tie at rank 3.

    An unknown outcome leaves the mean to the others.
    """
    known = scored.filter(F.col("score").isNotNull()).withColumn("rank", F.row_number().over(by_score()))
    y = F.col("outcome")
    out: list[Column] = [F.count("*").alias("n_names"), F.avg(y).alias("market")]
    for n in sizes:
        inside = F.col("rank") <= n
        out += [F.avg(F.when(inside, y)).alias(f"top{n}_gross"), F.sum((inside & y.isNull()).cast("int")).alias(f"top{n}_missing")]
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("score")))
    day = known.groupBy("ts").agg(*out, F.coalesce(at(tie_at) == at(tie_at + 1), F.lit(False)).cast("int").alias(f"tie_at_{tie_at}"))
    return day.withColumns({f"top{n}_net": F.col(f"top{n}_gross") - cost for n in sizes} | {f"top{n}_excess": F.col(f"top{n}_gross") - F.col("market") for n in sizes})


def with_replacement(wanted: DataFrame, bars: DataFrame, n: int) -> DataFrame:
    """The first n of each entry day that have a bar on it, by rank, with their place."""
    there = wanted.join(bars.select("symbol", "ts"), ["symbol", "ts"], "left_semi")
    return there.withColumn("place", F.row_number().over(W.partitionBy("ts").orderBy("rank", "symbol"))).filter(F.col("place") <= n)


def watchlists(scored: DataFrame, depth: int = 20) -> DataFrame:
    """(ts, symbols): the ordered list of each date."""
    ranked = picks(scored, depth)
    return ranked.groupBy("ts").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "symbol"))), lambda x: x["symbol"]).alias("symbols"))


#: Ranges that draws are counted in.
RANGES = 1 << 12


def draw_number(keys: list[str], seed: int) -> Column:
    """32 bits of a digest of the seed and a row's keys."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *(F.col(k).cast("string") for k in keys)).cast("binary")), 1, 8), 16, 10).cast("long")


def drawn(df: DataFrame, keys: list[str], n: int, seed: int, by: tuple[str, ...] = ()) -> DataFrame:
    """n rows, of each ``by`` if given, without replacement: those with the least draw numbers, the same on every run and partitioning.

    Numbers are counted in ranges first. Of a group, all rows below the range in which the n-th lies are taken, and only
    rows inside that range are put in order; so no group is sorted whole. ``keys`` tell rows apart.
    """
    numbered = df.withColumn("_d", draw_number(keys, seed)).withColumn("_range", F.shiftright("_d", 20).cast("int"))
    counts = numbered.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    so_far = F.sum("_n").over(W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, 0))  # at most RANGES rows a group
    edge = counts.withColumn("_to", so_far).withColumn("_below", F.col("_to") - F.col("_n")).filter((F.col("_below") < n) & (F.col("_to") >= n))
    edge = edge.select(*(F.col(c).alias(f"_g{k}") for k, c in enumerate(by)), F.col("_range").alias("_edge"), (F.lit(n) - F.col("_below")).alias("_need"))
    same = [F.col(c).eqNullSafe(F.col(f"_g{k}")) for k, c in enumerate(by)]
    met = numbered.join(edge, same, "left") if by else numbered.join(F.broadcast(edge), F.lit(True), "left")  # without groups it is one row
    inside = W.partitionBy(*by, "_range").orderBy("_d", *keys)
    # A group with fewer rows than n has no edge and is taken whole.
    whole = met.filter(F.col("_edge").isNull() | (F.col("_range") < F.col("_edge")))
    last = met.filter(F.col("_range") == F.col("_edge")).withColumn("_i", F.row_number().over(inside)).filter(F.col("_i") <= F.col("_need")).drop("_i")
    return whole.unionByName(last).select(*df.columns)


def random_lists(universe: DataFrame, seed: int, depth: int = 20) -> DataFrame:
    """A repeatable random order of each date's names, as far as ``depth``."""
    kept = drawn(universe, ["symbol", "ts"], depth, seed, ("ts",))
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("ts").orderBy(draw_number(["symbol", "ts"], seed), "symbol", "ts")))


def ensemble(a: DataFrame, b: DataFrame, weight: float = 0.5) -> DataFrame:
    """Mean of the percent ranks of two scores, on rows that both have."""
    met = a.filter("score IS NOT NULL").select("ts", "symbol", F.col("score").alias("_a"), "outcome").join(b.filter("score IS NOT NULL").select("ts", "symbol", F.col("score").alias("_b")), ["ts", "symbol"])
    return met.withColumn("score", weight * percent_rank("_a") + (1 - weight) * percent_rank("_b")).drop("_a", "_b")


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per date: picks in both, only in the first, only in the second."""
    one, two = a.select("ts", "symbol", F.lit(1).alias("in_a")), b.select("ts", "symbol", F.lit(1).alias("in_b"))
    met = one.join(two, ["ts", "symbol"], "full")
    case = lambda c: F.sum(F.when(c, 1).otherwise(0))
    a_, b_ = F.col("in_a").isNotNull(), F.col("in_b").isNotNull()
    return met.groupBy("ts").agg(case(a_ & b_).alias("both"), case(a_ & ~b_).alias("only_a"), case(b_ & ~a_).alias("only_b"))


def score_correlation(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per date: rank correlation of two scores over the shared names."""
    met = a.select("ts", "symbol", F.col("score").alias("x")).join(b.select("ts", "symbol", F.col("score").alias("y")), ["ts", "symbol"]).filter("x IS NOT NULL AND y IS NOT NULL")
    return met.withColumns({"rx": average_rank("x"), "ry": average_rank("y")}).groupBy("ts").agg(correlation("rx", "ry").alias("rho"), F.count("*").alias("n"))


def tie_report(scored: DataFrame, n: int = 3) -> DataFrame:
    """One row: on how many dates the n-th best score is shared past n names, and by how many at most."""
    known = scored.filter(F.col("score").isNotNull()).withColumn("rank", F.row_number().over(by_score()))
    edge = known.filter(F.col("rank") == n).select("ts", F.col("score").alias("edge"))
    shared = known.join(edge, "ts").groupBy("ts").agg(F.sum((F.col("score") >= F.col("edge")).cast("int")).alias("reach"))
    return shared.agg(F.count("*").alias("days"), F.sum((F.col("reach") > n).cast("int")).alias("tied_days"), F.max("reach").alias("widest"))
