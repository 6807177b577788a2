"""State of names and of the market, session windows that research may use, and checks of timing."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions.ranks import pooled_rank
from tidemark.functions.windows import percent_rank, ratio, session_runs
from tidemark.operators.screen import CELL, LEAST_DATES, LEAST_NAMES, MARKET_SHARE, bh_q, cells, constant_dates, daily_ic, families_of, family_pairs, hac_t, mean_sign, ranked, spearman, two_sided_p
from tidemark.sources.tables import materialised

#: Dimension, the column that gives it, and whether its size counts, not its sign.
STOCK_DIMENSIONS = (
    ("trend", "ema20_angle", False),
    ("trend_strength", "adx14", False),
    ("vol_level", "realvol_20", False),
    ("vol_change", "realvol_ratio", False),
    ("momentum", "rsi14", False),
    ("participation", "dvol_z20", False),
    ("location", "pos_in_52w", False),
    ("shock", "intraday_ret", True),
)
LEAST_DIMENSIONS = 6


def stock_state(panel: DataFrame, dimensions: tuple = STOCK_DIMENSIONS, least: int = LEAST_DIMENSIONS) -> DataFrame:
    """Adds st_ columns: each dimension's rank within the date, centred on zero; absent inputs are left out."""
    have = [d for d in dimensions if d[1] in panel.columns]
    if len(have) < least:
        raise ValueError(f"{len(have)} of {len(dimensions)} inputs are there, {least} are needed")
    return panel.withColumns({f"st_{name}": percent_rank(F.abs(c) if size else c) - 0.5 for name, c, size in have})


def missing_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: rows, and how many of them are unknown."""
    counts = df.agg(F.count("*").alias("rows"), *(F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns))
    return counts.unpivot(["rows"], columns, "column", "missing")


def market_state(bars: DataFrame, window: int = 20) -> DataFrame:
    """One row per session: median return, breadth and dispersion of the names, and their trailing forms.

    ``bars`` has session_idx.  Returns are taken inside unbroken runs of sessions only.
    """
    runs = session_runs(bars)
    ret = ratio("close", F.lag("close").over(W.partitionBy("symbol", "run_id").orderBy("ts"))) - 1
    day = runs.withColumn("_r", ret).groupBy("ts").agg(F.percentile("_r", 0.5).alias("mk_ret1"), F.avg((F.col("_r") > 0).cast("double")).alias("mk_breadth"), F.stddev_samp("_r").alias("mk_disp"))
    w = W.orderBy("ts").rowsBetween(-(window - 1), 0)  # a row per session
    least = max(3, window // 2)
    full = lambda c, f: F.when(F.count(c).over(w) >= least, f(F.col(c)).over(w))
    return day.withColumns({"mk_trend20": full("mk_ret1", F.sum), "mk_vol20": full("mk_ret1", F.stddev_samp), "mk_breadth20": full("mk_breadth", F.avg), "mk_disp20": full("mk_disp", F.avg)})


def lockbox(calendar: DataFrame, share: float = 0.2, horizon: int = 5) -> DataFrame:
    """One row: the last session that research may use, whose outcome ends before the lockbox, and where that begins."""
    n = F.count("*").over(W.partitionBy())
    first = F.floor(n * (1 - share))
    marked = calendar.withColumns({"_n": n, "_first": first})
    return marked.agg(F.max(F.when(F.col("session_idx") < F.col("_first") - horizon, F.col("ts"))).alias("research_end"), F.min(F.when(F.col("session_idx") >= F.col("_first"), F.col("ts"))).alias("lockbox_start"))


def timing(bars: DataFrame, outcome: Column, most_same: float = 0.10, least_next: float = 0.15) -> DataFrame:
    """One row: pooled rank correlation of an outcome with the same day's and the next day's return, and whether that fits.

    An outcome that is known from the same day's move alone gives itself away here.
    """
    order = W.partitionBy("symbol").orderBy("ts")
    df = bars.withColumns({"_y": outcome, "_same": ratio("close", F.lag("close").over(order)) - 1, "_next": ratio(F.lead("close").over(order), "close") - 1}).filter("_y IS NOT NULL AND _same IS NOT NULL AND _next IS NOT NULL")
    df = pooled_rank(df.select("_y", "_same", "_next"), ["_y", "_same", "_next"], [])
    out = df.agg(spearman("r__y", "r__same").alias("rho_same"), spearman("r__y", "r__next").alias("rho_next"), F.count("*").alias("n"))
    return out.withColumn("ok", (F.abs("rho_same") <= most_same) & (F.col("rho_next") >= least_next))


def before_folds(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows by fold: those of the sessions that the fold trains on. Folds are a handful."""
    return rows.join(F.broadcast(folds.filter("train_end IS NOT NULL").select("fold", "train_end")), F.col("ts") <= F.col("train_end")).drop("train_end")


def nested_screen(panel: DataFrame, features: list[str], targets: list[str], folds: DataFrame, blocks: int = 5, least_sign: int = 4, q: float = 0.10, least_dates: int = LEAST_DATES, least_names: int = LEAST_NAMES) -> DataFrame:
    """Per fold, the screen's rule on the training sessions alone: q over the fold's cells of all targets together, and the sign in ``least_sign`` of ``blocks`` runs.

    Ranks and correlations of a date do not depend on the fold, so they are made once, and the folds are one more key of what follows.
    Market-level features are those of the fold's own rows and are left out.
    """
    panel = materialised(panel.select("symbol", "ts", *(F.col(c).try_cast("double").alias(c) for c in (*features, *targets))))
    by = ("fold", *CELL)
    daily = materialised(daily_ic(ranked(cells(panel, features, targets)), least_names))  # a row per cell and date
    level = before_folds(constant_dates(panel, features), folds).groupBy("fold", "feature").agg(F.avg("constant").alias("share")).filter(F.col("share") >= MARKET_SHARE)
    train = before_folds(daily, folds).join(F.broadcast(level), ["fold", "feature"], "left_anti")  # a row per fold and feature
    run = F.ntile(blocks).over(W.partitionBy("fold").orderBy("ts"))
    runs = before_folds(panel.select("ts").distinct(), folds).withColumn("run", run)  # a row per fold and session
    signs = train.join(F.broadcast(runs), ["fold", "ts"])
    per_run = signs.groupBy(*by, "run").agg(F.avg("ic").alias("run_ic"))
    pooled = signs.groupBy(*by).agg(F.avg("ic").alias("pooled_ic"))
    same = per_run.join(pooled, list(by)).groupBy(*by).agg(F.sum((mean_sign("run_ic") == mean_sign("pooled_ic")).cast("int")).alias("same_sign"))
    stats = hac_t(train, by=by).filter(F.col("n") >= least_dates).withColumn("p", two_sided_p(F.col("t")))
    met = bh_q(stats, by=("fold",)).join(same, list(by), "left")
    stable = F.coalesce(F.col("same_sign") >= least_sign, F.lit(False))
    return met.select(*by, "mean", "n", "t", "p", "q", "same_sign", stable.alias("stable"), F.coalesce((F.col("q") <= q) & stable, F.lit(False)).alias("passes"))


def nested_leaders(panel: DataFrame, screened: DataFrame, folds: DataFrame, features: list[str], limit: float = 0.8) -> DataFrame:
    """(fold, feature, target, family): the leaders among each fold's passing cells, by correlations within its own sessions."""
    parts = []
    for fold in folds.filter("train_end IS NOT NULL").select("fold", "train_end").collect():  # a handful
        pairs = family_pairs(panel.filter(F.col("ts") <= F.lit(fold["train_end"])), features)
        parts.append(pairs.withColumn("fold", F.lit(fold["fold"])))
    if not parts:
        return panel.sparkSession.createDataFrame([], f"fold {folds.schema['fold'].dataType.simpleString()}, feature string, target string, family string")
    led = families_of(screened.filter("passes"), reduce(DataFrame.unionByName, parts), limit, ("fold", "target"))
    return led.select("fold", "feature", "target", "family")


def assignment(cost: np.ndarray) -> np.ndarray:
    """The column of each row, all different, at the least total cost; in cubic time.

    Rows join one after the other. A row that comes in looks for the cheapest chain of swaps that ends in a free column, by Dijkstra's
    search over reduced costs, which the prices of rows and columns keep from falling below zero.
    """
    n = len(cost)
    row_price, column_price = np.zeros(n), np.zeros(n)
    row_of = np.full(n, -1)
    for new in range(n):
        far = np.full(n, np.inf)
        before = np.full(n, -1)  # the column from whose row a column was reached
        done = np.zeros(n, bool)
        row, reached, base = new, -1, 0.0
        while True:
            through = base + cost[row] - row_price[row] - column_price
            nearer = ~done & (through < far)
            far[nearer], before[nearer] = through[nearer], reached
            reached = int(np.argmin(np.where(done, np.inf, far)))
            base, row = far[reached], row_of[reached]
            if row < 0:
                break
            done[reached] = True
        row_price[new] += base
        row_price[row_of[done]] += base - far[done]
        column_price[done] -= base - far[done]
        while reached >= 0:
            row_of[reached] = row_of[before[reached]] if before[reached] >= 0 else new
            reached = before[reached]
    return np.argsort(row_of)


def align_components(reference: np.ndarray, means: np.ndarray) -> tuple[list[int], float]:
    """Which new component stands for each reference one, at the smallest total distance, and that distance's mean."""
    cost = np.sqrt(((reference[:, None] - means[None]) ** 2).sum(2))
    order = assignment(cost)
    return [int(k) for k in order], float(cost[np.arange(len(cost)), order].mean())


def carried(df: DataFrame, order: list[int], column: str = "posterior") -> DataFrame:
    """A posterior's entries in the places of the reference's components, as ``align_components`` gives them."""
    return df.withColumn(column, F.array(*(F.get(column, k) for k in order)))
