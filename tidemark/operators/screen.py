"""Screening features by their daily rank correlation with outcomes.

The unit of work is a cell (feature, target): features are unpivoted, so one plan ranks,
correlates and aggregates all cells at once.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions import ranks
from tidemark.functions.products import rank_correlations
from tidemark.functions.windows import average_rank, correlation, quantile_bucket
from tidemark.sources.tables import materialised

CELL = ("feature", "target")
LEAST_NAMES, LEAST_DATES, HAC_LAG, QUANTILES = 15, 60, 20, 5
COST = 0.0035
#: Share of dates with one value only from which a feature is the market's.
MARKET_SHARE = 0.95
#: Cells whose false-discovery q is taken in one window; a table of more goes through counted values, with equal results.
FEW_CELLS = 100_000


def cells(panel: DataFrame, features: list[str], targets: list[str]) -> DataFrame:
    """(symbol, ts, feature, x, target, y) of all rows on which both are known."""
    long = panel.select("symbol", "ts", *(F.col(c).try_cast("double").alias(c) for c in (*features, *targets)))
    long = long.unpivot(["symbol", "ts", *targets], features, "feature", "x").filter("x IS NOT NULL")
    return long.unpivot(["symbol", "ts", "feature", "x"], targets, "target", "y").filter("y IS NOT NULL")


def ranked(pairs: DataFrame) -> DataFrame:
    """Adds average ranks within the date, and the number of names."""
    per = (*CELL, "ts")
    return pairs.withColumns({"rx": average_rank("x", *per), "ry": average_rank("y", *per), "n": F.count(F.lit(1)).over(W.partitionBy(*per))})


def spearman(rx: str = "rx", ry: str = "ry") -> Column:
    """Correlation of ranks, NULL where one side has no spread."""
    return F.when((F.max(rx) > F.min(rx)) & (F.max(ry) > F.min(ry)), correlation(rx, ry))


def daily_ic(rows: DataFrame, least: int = LEAST_NAMES) -> DataFrame:
    return rows.groupBy(*CELL, "ts").agg(spearman().alias("ic"), F.count("*").alias("n")).filter(F.col("n") >= least)


def hac_t(daily: DataFrame, value: str = "ic", by: tuple[str, ...] = CELL, lags: int = HAC_LAG) -> DataFrame:
    """Mean, number and Newey-West t (Bartlett weights) of a dated series; from lagged products, in one pass.

    Where the weighted variance is not positive, the plain one stands in.
    """
    order = W.partitionBy(*by).orderBy("ts")
    e = F.col(value) - F.avg(value).over(W.partitionBy(*by))
    known = daily.filter(F.col(value).isNotNull()).withColumn("_e", e)
    known = known.withColumns({f"_g{k}": F.col("_e") * F.lag("_e", k).over(order) for k in range(1, lags + 1)})
    sums = known.groupBy(*by).agg(F.avg(value).alias("mean"), F.count("*").alias("n"), F.sum(F.col("_e") * F.col("_e")).alias("_g0"), *(F.coalesce(F.sum(f"_g{k}"), F.lit(0.0)).alias(f"_g{k}") for k in range(1, lags + 1)))
    weighted = F.col("_g0") + sum((2 * (1 - k / (lags + 1)) * F.col(f"_g{k}") for k in range(1, lags + 1)), F.lit(0.0))
    var = F.when(weighted > 0, weighted).otherwise(F.col("_g0")) / F.col("n")
    t = F.try_divide(F.col("mean"), F.sqrt(var / F.col("n")))
    return sums.select(*by, "mean", "n", t.alias("t"))


def two_sided_p(t: Column) -> Column:
    """Normal two-sided p, accurate relative to p also in the tail (to about 1e-12); NULL where t is unknown or not finite.

    With z = |t| / sqrt(2): the power series of the error function up to z = 3, and the continued
    fraction of its complement beyond.
    """
    z = F.abs(t) / 2**0.5
    down = lambda n: F.sequence(F.lit(n), F.lit(1), F.lit(-1))
    inner = F.when(z <= 3, z).otherwise(0.0)
    # exp(-z^2) * sum of z^(2k+1) 2^k / (1 3 5 ... (2k+1)), innermost term first.
    series = F.aggregate(down(70), F.lit(1.0), lambda s, k: 1 + s * (2 * inner * inner) / (2 * k + 1))
    near = 1 - 2 / math.pi**0.5 * inner * F.exp(-inner * inner) * series
    outer = F.when(z > 3, z).otherwise(3.0)
    fraction = F.aggregate(down(40), outer, lambda s, k: outer + (k / 2) / s)
    far = F.exp(-outer * outer) / math.pi**0.5 / fraction
    return F.when(z <= 3, F.greatest(near, F.lit(0.0))).when(z < float("inf"), far)


def bh_q(df: DataFrame, p: str = "p", by: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """Adds q: the false-discovery-adjusted p over all rows with one, or over those of each ``by``.

    Equal p have one q: that of the last of them in order, so only distinct p are put in order. Where the caller knows a bound ``most`` of
    the rows and it is up to ``FEW_CELLS``, or gives ``by``, one window of a group does it.
    """
    if by or (most is not None and most <= FEW_CELLS):
        group = [F.col(c) for c in by] + [F.col(p).isNull()]
        here = W.partitionBy(*group)
        place = F.count("*").over(here.orderBy(p).rangeBetween(W.unboundedPreceding, 0))  # that of the last of equals
        ordered = df.withColumn("_raw", F.col(p) * F.count("*").over(here) / place)
        least = F.min("_raw").over(here.orderBy(F.desc(p)).rangeBetween(W.unboundedPreceding, 0))
        return ordered.withColumn("q", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), least))).drop("_raw")
    values = ranks.counted_values(df.select(p), p, [])
    m = values.agg(F.sum("n").alias("_m"))  # one row
    raw = values.crossJoin(F.broadcast(m)).withColumn("_raw", F.col(p) * F.col("_m") / (F.col("below") + F.col("n")))
    q = ranks.reverse_minimum(raw, p, F.col("_raw"), "q").select(p, "n", F.least(F.lit(1.0), "q").alias("q"))
    return ranks.join_values(df, q, [p])


def daily_cells(rows: DataFrame, least: int = LEAST_NAMES) -> DataFrame:
    """Per cell and date: IC, names, the mean outcome of each bucket and of all, in one pass over the ranks."""
    bucket = quantile_bucket(F.col("rx"), F.col("n"), QUANTILES)
    means = (F.avg(F.when(F.col("bucket") == k, F.col("y"))).alias(f"q{k + 1}") for k in range(QUANTILES))
    return rows.filter(F.col("n") >= least).withColumn("bucket", bucket).groupBy(*CELL, "ts").agg(spearman().alias("ic"), F.count("*").alias("n"), *means, F.avg("y").alias("market"))


def economics(daily: DataFrame, cost: float = COST) -> DataFrame:
    """Per cell, from ``daily_cells``: mean outcome of each bucket, the spread of the ends, and the favoured end after cost."""
    mean = daily.groupBy(*CELL).agg(*(F.avg(f"q{k + 1}").alias(f"q{k + 1}") for k in range(QUANTILES)), F.avg(F.col(f"q{QUANTILES}") - F.col("q1")).alias("spread"), F.avg("market").alias("market"))
    best = F.when(F.col("spread") >= 0, F.col(f"q{QUANTILES}")).otherwise(F.col("q1"))
    return mean.withColumns({"gross": best, "net": best - cost, "excess": best - F.col("market")})


def quintiles(rows: DataFrame, least: int = LEAST_NAMES, cost: float = COST) -> DataFrame:
    """``economics`` of ranked rows."""
    return economics(daily_cells(rows, least), cost)


def mean_sign(c: str) -> Column:
    """Sign of a mean of correlations. Correlations of ranks often cancel; what their sum's order then leaves, some 1e-17, is no sign."""
    return F.signum(F.round(c, 12))


def fold_signs(daily: DataFrame, folds: DataFrame) -> DataFrame:
    """Per cell: in how many folds the mean IC has the sign of the pooled mean."""
    inside = daily.join(F.broadcast(folds.select("fold", "test_start", "test_end")), F.col("ts").between(F.col("test_start"), F.col("test_end")))  # a handful of folds
    per_fold = inside.groupBy(*CELL, "fold").agg(F.avg("ic").alias("fold_ic"))
    pooled = inside.groupBy(*CELL).agg(F.avg("ic").alias("pooled_ic"))
    same = F.sum((mean_sign("fold_ic") == mean_sign("pooled_ic")).cast("int"))
    return per_fold.join(pooled, list(CELL)).groupBy(*CELL).agg(same.alias("same_sign"), F.count("*").alias("n_folds"))


def constant_dates(panel: DataFrame, features: list[str]) -> DataFrame:
    """(feature, ts, constant): whether a feature has one value on a date with two values or more."""
    long = panel.select("ts", *(F.col(c).try_cast("double").alias(c) for c in features)).unpivot(["ts"], features, "feature", "x").filter("x IS NOT NULL")
    day = long.groupBy("feature", "ts").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).filter("n >= 2")
    return day.select("feature", "ts", (F.col("low") == F.col("high")).cast("double").alias("constant"))


def market_level(panel: DataFrame, features: list[str], share: float = MARKET_SHARE) -> DataFrame:
    """Features that are one value a date on nearly all dates with two values or more."""
    return constant_dates(panel, features).groupBy("feature").agg(F.avg("constant").alias("constant_share")).withColumn("is_market", F.col("constant_share") >= share)


def market_correlation(daily: DataFrame, by: tuple[str, ...] = (), x: str = "x", y: str = "y", lags: int = HAC_LAG) -> DataFrame:
    """Correlation of two dated series, and the HAC t of the products of their z-scores, per ``by``."""
    both = daily.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    w = W.partitionBy(*by)  # a row per date
    z = lambda c: F.try_divide(F.col(c) - F.avg(c).over(w), F.stddev_pop(c).over(w))
    return hac_t(both.select(*by, "ts", (z(x) * z(y)).alias("product")).withColumn("_one", F.lit(1)), "product", (*by, "_one"), lags).drop("_one")


def market_screen(panel: DataFrame, features: list[str], targets: list[str], least_dates: int = LEAST_DATES) -> DataFrame:
    """Market-level features as series against each target's daily mean: (feature, target, mean, n, t), where there are dates enough."""
    if not features:
        return panel.sparkSession.createDataFrame([], "feature string, target string, mean double, n long, t double")
    day = panel.groupBy("ts").agg(*(F.avg(F.col(c).try_cast("double")).alias(c) for c in (*features, *targets)))
    long = day.unpivot(["ts", *targets], features, "feature", "x").filter("x IS NOT NULL").unpivot(["ts", "feature", "x"], targets, "target", "y").filter("y IS NOT NULL")
    return market_correlation(long, CELL).filter(F.col("n") >= least_dates)


def drawn_dates(panel: DataFrame, dates: int, by: tuple[str, ...] = ()) -> DataFrame:
    """``dates`` of the panel's dates (of each ``by``), the same ones on every run: those with the least digests."""
    every = panel.select(*by, "ts").distinct()
    order = W.partitionBy(*by).orderBy(F.md5(F.concat(F.col("ts").cast("string"), F.lit(":0")).cast("binary")), "ts")  # a row per date
    return every.withColumn("_i", F.row_number().over(order)).filter(F.col("_i") <= dates).drop("_i")


def family_pairs(panel: DataFrame, features: list[str], dates: int = 60, least: int = 50) -> DataFrame:
    """Correlation of the percent ranks of two features over a fixed draw of dates, with ``least`` shared rows."""
    drawn = drawn_dates(panel, dates)
    return rank_correlations(panel.join(F.broadcast(drawn), "ts"), features).filter(F.col("n") >= least)


def families(ordered: list[str], close: set[tuple[str, str]]) -> dict[str, str]:
    """Leader of each feature: the first before it, by strength, that it is close to; a pair in ``close`` is in order."""
    leaders: list[str] = []
    out: dict[str, str] = {}
    for name in ordered:
        lead = next((x for x in leaders if (min(x, name), max(x, name)) in close), None)
        out[name] = lead or name
        if lead is None:
            leaders.append(name)
    return out


def leak_table(panel: DataFrame, features: list[str], close: str = "close", horizons: int = 5, limit: float = 0.15) -> DataFrame:
    """Pooled rank correlation of each feature with each of the next single-day returns."""
    order = W.partitionBy("symbol").orderBy("ts")
    price = lambda k: F.lead(close, k).over(order) if k else F.col(close)
    future = panel.withColumns({f"fwd_{k}": F.try_divide(price(k), price(k - 1)) - 1 for k in range(1, horizons + 1)})
    pairs = cells(future, features, [f"fwd_{k}" for k in range(1, horizons + 1)])
    # Ranks over all dates at once: a cell holds the whole table, so no task may hold a cell.
    both = ranks.pooled_rank(pairs.select(*CELL, "x", "y"), ["x", "y"], list(CELL))
    rho = both.groupBy(*CELL).agg(spearman("r_x", "r_y").alias("rho"))
    return rho.groupBy("feature").agg(*(F.max(F.when(F.col("target") == f"fwd_{k}", F.col("rho"))).alias(f"rho_{k}") for k in range(1, horizons + 1)), F.max(F.abs("rho")).alias("max_abs_rho")).withColumn("suspect", F.col("max_abs_rho") >= limit)


def families_of(passing: DataFrame, pairs: DataFrame, limit: float = 0.8, by: tuple[str, ...] = ("target",)) -> DataFrame:
    """(by, feature, family): the leader of each passing cell's feature, in each ``by`` on its own, the strongest |t| first.

    ``pairs`` may have columns of ``by`` too; then each group has its own close pairs. Features are few, so a group and its pairs are small.
    """
    own = [c for c in by if c in pairs.columns]
    close = pairs.filter(F.abs("rho") >= limit).groupBy(*own).agg(F.collect_list(F.struct("feature_a", "feature_b")).alias("close"))
    met = passing.select(*by, "feature", "t")
    met = met.join(F.broadcast(close), own, "left") if own else met.crossJoin(F.broadcast(close))  # without groups it is one row
    kinds = ", ".join(f"{c} {passing.schema[c].dataType.simpleString()}" for c in by)

    def lead(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        names = [n for _, n in sorted((-abs(t), n) for t, n in zip(rows["t"].to_pylist(), rows["feature"].to_pylist(), strict=True))]
        near = {(x["feature_a"], x["feature_b"]) for x in rows["close"][0].as_py() or ()}
        found = families(names, near)
        groups = {c: pa.array([k.as_py()] * len(names), k.type) for c, k in zip(by, key, strict=True)}
        return pa.table(groups | {"feature": pa.array(names), "family": pa.array([found[n] for n in names])})

    return met.groupBy(*by).applyInArrow(lead, f"{kinds}, feature string, family string")


def screen(panel: DataFrame, features: list[str], targets: list[str], folds: DataFrame, q: float = 0.10, stable: int = 4) -> DataFrame:
    """One row per cell: mean IC, t, p, q, stability, bucket economics, the verdict and the family's leader.

    Market-level features have no spread within a date; they are tested as series (``kind`` is
    ``market``), get no q and never pass.
    """
    panel = materialised(panel.select("symbol", "ts", *(F.col(c).try_cast("double").alias(c) for c in (*features, *targets))))
    level = {r["feature"] for r in market_level(panel, features).filter("is_market").collect()}  # features are few
    names = [f for f in features if f not in level]
    series = market_screen(panel, [f for f in features if f in level], targets).withColumn("kind", F.lit("market"))
    if not names:
        return series
    # A row per cell and date; the ranks below it are made once, and all that follows is small.
    daily = materialised(daily_cells(ranked(cells(panel, names, targets))))
    stats = hac_t(daily).filter(F.col("n") >= LEAST_DATES).withColumn("p", two_sided_p(F.col("t")))
    out = bh_q(stats, most=len(names) * len(targets)).join(fold_signs(daily, folds), list(CELL), "left").join(economics(daily), list(CELL), "left")
    out = out.withColumns({"kind": F.lit("ranked"), "passes": F.coalesce((F.col("q") <= q) & (F.col("same_sign") >= stable), F.lit(False))})
    out = materialised(out)  # a row per cell
    led = families_of(out.filter("passes"), family_pairs(panel, names))
    return out.join(F.broadcast(led), list(CELL), "left").unionByName(series, allowMissingColumns=True)
