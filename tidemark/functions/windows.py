"""Trailing windows per symbol and ranks per date, as columns.

All functions expect the columns ``symbol`` and ``ts``.  Missing values are NULL, never NaN:
comparisons with NULL are filtered, aggregates skip it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.sql.window import WindowSpec

EPS = 1e-12


def by_symbol() -> WindowSpec:
    """A symbol's rows in the order of time."""
    return W.partitionBy("symbol").orderBy("ts")


def past() -> WindowSpec:
    """A symbol's rows up to this one."""
    return by_symbol().rowsBetween(W.unboundedPreceding, 0)


_AGGREGATES = {"mean": F.avg, "sum": F.sum, "std": F.stddev_samp, "max": F.max, "min": F.min, "median": lambda c: F.percentile(c, 0.5)}


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trailing(n: int, lag: int = 0) -> WindowSpec:
    """The n rows of a symbol that end ``lag`` rows before this one."""
    return by_symbol().rowsBetween(-(n - 1) - lag, -lag)


def roll(x: str | Column, n: int, how: str = "mean", least: int | None = None, lag: int = 0) -> Column:
    """Aggregate of a trailing window; NULL with fewer than ``least`` values (all n unless said)."""
    w = trailing(n, lag)
    return F.when(F.count(col(x)).over(w) >= (least or n), _AGGREGATES[how](col(x)).over(w))


def lag(x: str | Column, k: int = 1) -> Column:
    return F.lag(col(x), k).over(by_symbol())


def lead(x: str | Column, k: int = 1) -> Column:
    return F.lead(col(x), k).over(by_symbol())


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, NULL where b is zero."""
    return F.try_divide(col(a), col(b))


def over(a: str | Column, b: str | Column) -> Column:
    """a / b where b is clearly positive, else NULL."""
    return F.when(col(b) > EPS, F.try_divide(col(a), col(b)))


def finite(x: str | Column) -> Column:
    """NULL for NaN and infinite values."""
    return F.when(~F.isnan(col(x)) & (F.abs(col(x)) < float("inf")), col(x))


def average_rank(x: str | Column, *per: str) -> Column:
    """Ranks 1..n within ``per``, ties sharing their mean rank; NULL values take no rank."""
    x, per = col(x), per or ("ts",)
    within = W.partitionBy(*per, x.isNull())
    equal = W.partitionBy(*per, x)
    return F.when(x.isNotNull(), F.rank().over(within.orderBy(x)) + (F.count(F.lit(1)).over(equal) - 1) / 2)


def percent_rank(x: str | Column, *per: str) -> Column:
    """Average rank as a share of the values present."""
    return average_rank(x, *per) / F.count(col(x)).over(W.partitionBy(*(per or ("ts",))))


def z_score(x: str | Column, limit: float = 5.0, per: str = "ts") -> Column:
    w = W.partitionBy(per)
    z = ratio(col(x) - F.avg(col(x)).over(w), F.nullif(F.stddev_samp(col(x)).over(w), F.lit(0.0)))
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), z)) if limit else z


def demean(x: str | Column, per: str = "ts") -> Column:
    return col(x) - F.avg(col(x)).over(W.partitionBy(per))


def quantile_bucket(rank: Column, n: Column, buckets: int) -> Column:
    """0-based bucket of an average rank; unlike ntile, equal values share a bucket."""
    return F.least(F.floor((rank - 0.5) / n * buckets), F.lit(buckets - 1)).cast("int")


def moments(y: Column, x: Column, n: int, w: WindowSpec | None = None) -> dict[str, Column]:
    """Population moments over the pairs of a trailing window, NULL unless all n pairs are there."""
    y, x = F.when(x.isNotNull(), y), F.when(y.isNotNull(), x)
    return {"my": roll(y, n), "mx": roll(x, n), "mxy": roll(x * y, n), "mxx": roll(x * x, n), "myy": roll(y * y, n)}


def rolling_ols(df: DataFrame, y: str, x: str, n: int, prefix: str) -> DataFrame:
    """Adds alpha, beta, r2 and var (of y) of the trailing regression of y on x."""
    for name, c in moments(F.col(y), F.col(x), n).items():
        df = df.withColumn(f"{prefix}_{name}", c)
    at = lambda name: F.col(f"{prefix}_{name}")
    cov, vx, vy = at("mxy") - at("mx") * at("my"), at("mxx") - at("mx") * at("mx"), at("myy") - at("my") * at("my")
    beta = over(cov, vx)
    df = df.withColumns({f"{prefix}_beta": beta, f"{prefix}_r2": F.when((vx > EPS) & (vy > EPS), F.try_divide(cov * cov, vx * vy)), f"{prefix}_var": vy})
    df = df.withColumn(f"{prefix}_alpha", at("my") - at("beta") * at("mx"))
    return df.drop(*(f"{prefix}_{k}" for k in ("my", "mx", "mxy", "mxx", "myy")))


def conditional_slope(y: Column, x: Column, n: int, where: Column, least: int = 20) -> Column:
    """Slope over the days of a trailing window on which ``where`` holds; the window itself must be complete."""
    both = y.isNotNull() & x.isNotNull()
    use = both & where
    w = trailing(n)
    s = F.sum(F.when(use, 1).otherwise(0)).over(w)
    sx, sy = (F.sum(F.when(use, c).otherwise(0.0)).over(w) for c in (x, y))
    sxx, sxy = (F.sum(F.when(use, c).otherwise(0.0)).over(w) for c in (x * x, x * y))
    full = F.sum(F.when(both, 1).otherwise(0)).over(w) == n
    mx = F.try_divide(sx, s)
    var = F.try_divide(sxx, s) - mx * mx
    cov = F.try_divide(sxy, s) - mx * F.try_divide(sy, s)
    return F.when((s >= least) & full & (var > EPS), F.try_divide(cov, var))


def adjusted_skew(x: str | Column, n: int) -> Column:
    """Bias-adjusted skewness of a complete trailing window."""
    w = trailing(n)
    return F.when(F.count(col(x)).over(w) >= n, F.skewness(col(x)).over(w) * (n * (n - 1)) ** 0.5 / (n - 2))


def correlation(x: str | Column, y: str | Column, w: WindowSpec | None = None) -> Column:
    """Pearson correlation of two columns known on the same rows, NULL where one has no spread."""
    at = (lambda c: c.over(w)) if w is not None else (lambda c: c)
    return F.try_divide(at(F.covar_pop(col(x), col(y))), at(F.stddev_pop(col(x))) * at(F.stddev_pop(col(y))))


def values_in_window(x: str | Column, n: int) -> Column:
    """The n values as an array, NULL unless all are there."""
    w = trailing(n)
    return F.when(F.count(col(x)).over(w) >= n, F.collect_list(col(x)).over(w))


def share_below(x: str | Column, n: int) -> Column:
    """Share of the window strictly below the present value."""
    now = col(x)
    return F.size(F.filter(values_in_window(x, n), lambda v: v < now)) / F.lit(float(n))


def mean_of_top(x: str | Column, n: int, k: int) -> Column:
    top = F.slice(F.sort_array(values_in_window(x, n), False), 1, k)
    return F.aggregate(top, F.lit(0.0), lambda a, v: a + v) / k


def bars_since_extreme(x: str | Column, n: int, index: str, highest: bool) -> Column:
    """Rows since the most recent maximum (or minimum) of a complete window, as a share of n."""
    w = trailing(n)
    value = col(x) if highest else -col(x)
    last = F.max(F.when(col(x).isNotNull(), F.struct(value.alias("v"), F.col(index).alias("i")))).over(w)["i"]
    return F.when(F.count(col(x)).over(w) >= n, (F.col(index) - last) / F.lit(float(n)))


def bars_since_flag(flag: Column, index: str, cap: int = 250) -> Column:
    """Rows since the flag was last up, ``cap`` at most and also where it never was."""
    last = F.max(F.when(flag, F.col(index))).over(past())
    return F.coalesce(F.least(F.col(index) - last, F.lit(cap)), F.lit(cap)).cast("double")


def flag_streak(df: DataFrame, flag: str, out: str) -> DataFrame:
    """Length of the run of ones that ends here."""
    island = F.sum(1 - F.col(flag)).over(past())
    w = W.partitionBy("symbol", "_island").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("_island", island).withColumn(out, F.sum(flag).over(w).cast("double")).drop("_island")


def signed_streak(df: DataFrame, x: str, out: str) -> DataFrame:
    """Length of the run of equal signs that ends here, with that sign; zero for zero."""
    df = df.withColumn("_sign", F.coalesce(F.signum(F.col(x)), F.lit(0.0)))
    df = df.withColumn("_turn", F.when(F.col("_sign") == lag("_sign"), 0).otherwise(1)).withColumn("_island", F.sum("_turn").over(past()))
    w = W.partitionBy("symbol", "_island").orderBy("ts")
    return df.withColumn(out, F.col("_sign") * F.row_number().over(w)).drop("_sign", "_turn", "_island")


def session_runs(df: DataFrame, session: str = "session_idx", out: str = "run_id") -> DataFrame:
    """Numbers a symbol's unbroken runs of consecutive sessions."""
    new = F.when(F.col(session) - lag(session) == 1, 0).otherwise(1)
    return df.withColumn("_new", new).withColumn(out, F.sum("_new").over(past())).drop("_new")
