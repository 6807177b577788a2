"""Building blocks of the DuckDB queries that the Spark results are held against."""

from __future__ import annotations

from tidemark.sources.bars import TRADE_ORDER

BARS = f"""bars AS (
  SELECT symbol, ts, arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close, sum(q) AS volume
  FROM (SELECT p_brand AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS ts, l_extendedprice / nullif(l_quantity, 0) AS px, l_quantity AS q, ROW({', '.join(TRADE_ORDER)}) AS k
        FROM lineitem JOIN part ON l_partkey = p_partkey)
  GROUP BY symbol, ts)"""

SESSIONS = "sess AS (SELECT ts, (row_number() OVER (ORDER BY ts) - 1)::INTEGER AS session_idx FROM (SELECT DISTINCT ts FROM bars))"

_BAND = "(abs({m} - 0.02) <= {t} OR abs({m} - 0.05) <= {t} OR abs({m} - 0.10) <= {t} OR abs({m} - 0.20) <= {t})"


def at_band(move: str, ref: str, tick: str = "0.05") -> str:
    return f"coalesce({_BAND.format(m=f'({move})', t=f'greatest(0.0015, 1.02 * {tick} / nullif({ref}, 0))')} AND {ref} > 0, false)"


def tick(ts: str, price: str) -> str:
    return (
        f"(CASE WHEN {ts} < DATE '2024-06-10' THEN 0.05 WHEN {ts} < DATE '2025-04-15' THEN CASE WHEN {price} < 250 THEN 0.01 ELSE 0.05 END "
        f"WHEN {price} < 250 THEN 0.01 WHEN {price} <= 1000 THEN 0.05 WHEN {price} <= 5000 THEN 0.1 WHEN {price} <= 10000 THEN 0.5 WHEN {price} <= 20000 THEN 1.0 ELSE 5.0 END)"
    )


BASE = f"""p AS (SELECT *, lag(close) OVER s AS cp, row_number() OVER s AS idx FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
b AS (SELECT *, close / cp - 1 AS r, ln(close / cp) AS lr, ln(open / cp) AS lon, ln(close / open) AS lid, CASE WHEN close * volume > 0 THEN close * volume END AS tv,
  open / cp - 1 AS on_r, close / open - 1 AS id_r,
  CASE WHEN {at_band('close / cp - 1', 'cp', tick('ts', 'cp'))} AND close > cp AND close >= high * (1 - 1e-9) THEN 1.0::DOUBLE ELSE 0.0 END AS lock_up,
  CASE WHEN {at_band('1 - close / cp', 'cp', tick('ts', 'cp'))} AND close < cp AND close <= low * (1 + 1e-9) THEN 1.0::DOUBLE ELSE 0.0 END AS lock_dn,
  CASE WHEN {at_band('1 - open / cp', 'cp', tick('ts', 'cp'))} AND open < cp AND open <= low * (1 + 1e-9) THEN 1.0::DOUBLE ELSE 0.0 END AS open_lock_dn
  FROM p)"""

MARKET = """mk AS (SELECT ts, stddev_samp(r) AS M_disp_1d, avg((r > 0)::INT) AS M_breadth_up, avg(lock_dn) AS M_share_lock_dn, avg(lock_up) AS M_share_lock_up,
  avg(on_r) AS M_on_1d, avg(id_r) AS M_id_1d, ln(1 + avg(r)) AS m, ln(1 + avg(on_r)) AS m_on, ln(1 + avg(id_r)) AS m_id FROM b WHERE r IS NOT NULL GROUP BY ts),
bm AS (SELECT b.*, m, m_on, m_id, M_disp_1d FROM b LEFT JOIN mk USING (ts))"""

_FUNCTION = {"mean": "avg({})", "sum": "sum({})", "std": "stddev_samp({})", "max": "max({})", "min": "min({})", "median": "quantile_cont({}, 0.5)"}


def frame(n: int, lag: int = 0) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1 + lag} PRECEDING AND {lag} PRECEDING)"


def roll(x: str, n: int, how: str = "mean", least: int | None = None, lag: int = 0) -> str:
    w = frame(n, lag)
    return f"(CASE WHEN count({x}) {w} >= {least or n} THEN {_FUNCTION[how].format(x)} {w} END)"


def shifted(x: str, k: int = 1) -> str:
    """k rows back, or forward for a negative k."""
    return f"({'lag' if k >= 0 else 'lead'}({x}, {abs(k)}) OVER (PARTITION BY symbol ORDER BY ts))"


def over(a: str, b: str) -> str:
    return f"(CASE WHEN {b} > 1e-12 THEN ({a}) / ({b}) END)"


def rank(x: str, *per: str) -> str:
    by = ", ".join(per or ("ts",))
    return f"(CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {by}, {x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0 END)"


def percent_rank(x: str, *per: str) -> str:
    return f"({rank(x, *per)} / count({x}) OVER (PARTITION BY {', '.join(per or ('ts',))}))"


def rounded(expressions: dict[str, str], digits: int = 6) -> str:
    return ", ".join(f"round(({e})::DOUBLE, {digits}) + 0.0 AS {name}" for name, e in expressions.items())


def query(select: str, *ctes: str) -> str:
    return f"WITH {', '.join((BARS, *ctes))} {select}"


def resampled(name: str, source: str, by: str, value: str, replicates: int = 10_000, block: int = 10, seed: int = 7, level: float = 0.9875) -> str:
    """CTEs that end in ``name`` (by, n, mean, lo, hi): circular moving-block intervals of the mean of each series of ``source``."""
    low = (1 - level) / 2
    return f"""{name}_v AS (SELECT {by}, coalesce(list({value} ORDER BY ts) FILTER ({value} IS NOT NULL), []) AS v FROM {source} GROUP BY {by}),
{name}_w AS (SELECT {by}, v, len(v) AS n, list_concat(v, v[1:{block}]) AS vv FROM {name}_v),
{name}_f AS (SELECT {by}, n, list_transform(range(1, n + 1), lambda i: list_sum(vv[i:i + {block} - 1])) AS f, list_transform(range(1, n + 1), lambda i: coalesce(list_sum(vv[i:i + n % {block} - 1]), 0)) AS l FROM {name}_w WHERE n >= {2 * block}),
{name}_r AS (SELECT {by}, (list_sum(list_transform(range(n // {block}), lambda b: f[(('0x' || substr(md5('{seed}:' || k || ':' || b), 1, 8))::BIGINT % n + 1)::BIGINT]))
  + CASE WHEN n % {block} > 0 THEN l[(('0x' || substr(md5('{seed}:' || k || ':' || (n // {block})), 1, 8))::BIGINT % n + 1)::BIGINT] ELSE 0 END) / n AS m FROM {name}_f, range({replicates}) AS r(k)),
{name}_q AS (SELECT {by}, quantile_cont(m, {low!r}) AS lo, quantile_cont(m, {1 - low!r}) AS hi FROM {name}_r GROUP BY {by}),
{name} AS (SELECT * EXCLUDE (v, vv), list_avg(v) AS mean FROM {name}_w LEFT JOIN {name}_q USING ({by}))"""


def two_sided_p(t: str) -> str:
    """The normal two-sided p: a power series near zero, a continued fraction in the tail."""
    z = f"(abs({t}) / sqrt(2))"
    near = f"1 - 2 / sqrt(pi()) * {z} * exp(-{z} * {z}) * list_reduce(list_prepend(1.0::DOUBLE, range(70, 0, -1)::DOUBLE[]), lambda s, k: 1 + s * 2 * {z} * {z} / (2 * k + 1))"
    far = f"exp(-{z} * {z}) / sqrt(pi()) / list_reduce(list_prepend({z}::DOUBLE, range(40, 0, -1)::DOUBLE[]), lambda s, k: {z} + k / 2 / s)"
    return f"(CASE WHEN {z} <= 3 THEN greatest({near}, 0) ELSE {far} END)"
