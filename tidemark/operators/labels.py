"""Forward outcomes of a bar, and what a path does on the way."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.bands import at_band, locks, opens_at_upper_band, tick_size
from tidemark.functions.windows import by_symbol, lag, lead, ratio, roll

HORIZON = 5
#: Name, target, stop, and whether both are in units of the average true range.
VARIANTS = (("5p3", 0.05, 0.03, False), ("3p2", 0.03, 0.02, False), ("atr1p5_1p0", 1.5, 1.0, True), ("atr2p0_1p0", 2.0, 1.0, True), ("atr1p0_1p0", 1.0, 1.0, True))
PRIMARY = "atr1p5_1p0"


def open_to_close(bars: DataFrame, horizons: tuple[int, ...] = (1, 2, 3, 5)) -> DataFrame:
    """Adds label_oc_h (next open to the close h bars on) and label_buyable_o1."""
    entry = lead("open")
    good = F.when(entry > 0, entry)
    out = {f"label_oc_{h}": F.when(lead("close", h) > 0, ratio(lead("close", h), good) - 1) for h in horizons}
    known = good.isNotNull() & lead("high").isNotNull() & (F.col("close") > 0)
    out["label_buyable_o1"] = F.when(known, F.when(opens_at_upper_band(entry, lead("high"), F.col("close")), 0.0).otherwise(1.0))
    return bars.withColumns(out)


def true_range() -> Column:
    """NULL without a previous close."""
    h, l, before = F.col("high"), F.col("low"), lag("close")  # noqa: E741
    return F.when(before.isNotNull() & h.isNotNull() & l.isNotNull(), F.greatest(h - l, F.abs(h - before), F.abs(l - before)))


def with_atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """Adds atr_pct, the plain mean true range of n bars over the close."""
    return bars.withColumn("_tr", true_range()).withColumn("atr_pct", ratio(roll("_tr", n), "close")).drop("_tr")


def _ahead(x: str, k: int, highest: bool) -> Column:
    w = by_symbol().rowsBetween(1, k)
    return (F.max if highest else F.min)(F.col(x)).over(w)


def excursions(bars: DataFrame, horizon: int = HORIZON, touch: float = 0.05) -> DataFrame:
    """Adds fwd_ret, mfe, mae and touch over complete windows of the next bars."""
    whole = F.count("close").over(by_symbol().rowsBetween(1, horizon)) == horizon
    c = F.col("close")
    up, down = ratio(_ahead("high", horizon, True), c) - 1, ratio(_ahead("low", horizon, False), c) - 1
    return bars.withColumns({"label_fwd_ret": F.when(whole, ratio(lead("close", horizon), c) - 1), "label_mfe": F.when(whole, up), "label_mae": F.when(whole, down), "label_touch": F.when(whole, (up >= touch).cast("double"))})


def _first(flags: list[Column], none: int) -> Column:
    return F.coalesce(*(F.when(f, k) for k, f in enumerate(flags, 1)), F.lit(none))


def first_touch(bars: DataFrame, variants: tuple = VARIANTS, horizon: int = HORIZON) -> DataFrame:
    """Adds, for each bracket around the close, which side is touched first, when, and the trade's return.

    A bar that touches both counts as the stop.  Needs atr_pct for brackets in its units.
    """
    whole = F.count("close").over(by_symbol().rowsBetween(1, horizon)) == horizon
    base = {f"_up{k}": ratio(_ahead("high", k, True), "close") - 1 for k in range(1, horizon + 1)}
    base |= {f"_dn{k}": ratio(_ahead("low", k, False), "close") - 1 for k in range(1, horizon + 1)}
    df = bars.withColumns(base | {"_end": ratio(lead("close", horizon), "close") - 1, "_whole": whole})
    out: dict[str, Column] = {}
    for name, up, down, scaled in variants:
        size = F.col("atr_pct") if scaled else F.lit(1.0)
        tp, sl = up * size, down * size
        k_tp = _first([F.col(f"_up{k}") >= tp for k in range(1, horizon + 1)], horizon + 1)
        k_sl = _first([F.col(f"_dn{k}") <= -sl for k in range(1, horizon + 1)], horizon + 1)
        known = F.col("_whole") & tp.isNotNull() & sl.isNotNull()
        side = F.when(k_tp < k_sl, 1).when(k_sl <= horizon, -1).otherwise(0)
        out[f"label_first_{name}"] = F.when(known, side)
        out[f"label_days_tp_{name}"] = F.when(known & (k_tp <= horizon), k_tp)
        out[f"label_days_sl_{name}"] = F.when(known & (k_sl <= horizon), k_sl)
        out[f"label_tie_{name}"] = F.when(known, ((k_tp == k_sl) & (k_tp <= horizon)).cast("int"))
        out[f"label_exit_{name}"] = F.when(known, F.when(side == 1, tp).when(side == -1, -sl).otherwise(F.col("_end")))
    return df.withColumns(out).drop(*base, "_end", "_whole")


def next_open_bracket(bars: DataFrame, tp: float = 1.5, sl: float = 1.0, horizon: int = HORIZON) -> DataFrame:
    """Adds the outcome of a bracket entered at the next open; from the second bar on a gap fills at the open.

    The order inside a bar is: gap through the stop, gap through the target, stop, target.
    """
    entry = F.when(lead("open") > 0, lead("open"))
    move = lambda x, k: ratio(lead(x, k), entry) - 1
    df = bars.withColumns({f"_{x[0]}{k}": move(x, k) for k in range(1, horizon + 1) for x in ("open", "high", "low")} | {"_end": move("close", horizon), "_tp": tp * F.col("atr_pct"), "_sl": sl * F.col("atr_pct")})
    steps: list[tuple[Column, int, Column]] = []
    t, s = F.col("_tp"), F.col("_sl")
    for k in range(1, horizon + 1):
        if k > 1:
            steps += [(F.col(f"_o{k}") <= -s, -1, F.col(f"_o{k}")), (F.col(f"_o{k}") >= t, 1, F.col(f"_o{k}"))]
        steps += [(F.col(f"_l{k}") <= -s, -1, -s), (F.col(f"_h{k}") >= t, 1, t)]
    known = F.col("_end").isNotNull() & t.isNotNull()
    side = F.coalesce(*(F.when(hit, v) for hit, v, _ in steps), F.lit(0))
    result = F.coalesce(*(F.when(hit, r) for hit, _, r in steps), F.col("_end"))
    best = reduce(F.greatest, (F.col(f"_h{k}") for k in range(1, horizon + 1)))
    worst = reduce(F.least, (F.col(f"_l{k}") for k in range(1, horizon + 1)))
    out = {"label_o1_first": F.when(known, side), "label_o1_exit": F.when(known, result), "label_o1_mfe": F.when(known, best), "label_o1_mae": F.when(known, worst), "label_gap1": ratio(lead("open"), "close") - 1}
    return df.withColumns(out).drop(*(f"_{x}{k}" for k in range(1, horizon + 1) for x in "ohl"), "_end", "_tp", "_sl")


def locked_exit(bars: DataFrame, horizon: int, search: int = 20) -> DataFrame:
    """Re-scores the outcome where the exit close is locked at the lower band.

    The sale then moves to the first later open that is not locked, within ``search`` bars, or
    else to the last close looked at.
    """
    prev = lag("close")
    df = bars.withColumn("_prev", prev).withColumn("_tick", tick_size(F.col("ts"), F.col("_prev")))
    flags = locks(F.col("_prev"), F.col("_tick"))
    o, h, c = F.col("open"), F.col("high"), F.col("close")
    up = F.try_divide(c, F.col("_prev")) - 1
    df = df.withColumns(
        {
            "_locked": flags["lock_dn"],
            "_open_locked": flags["open_lock_dn"],
            "_at_upper": F.coalesce(at_band(up, F.col("_prev"), F.col("_tick")) & (c >= h * (1 - 1e-9)), F.lit(False)),
            "_open_band": at_band(1 - F.try_divide(o, F.col("_prev")), F.col("_prev"), F.col("_tick")),
            "_one_price": (F.abs(o - h) <= 1e-9 * h) & (F.abs(o - F.col("low")) <= 1e-9 * o) & (F.abs(o - c) <= 1e-9 * F.greatest(o, c)),
        }
    )
    # Seen from the exit bar: the rows after it, nearest first.
    later = F.collect_list(F.struct((~F.col("_open_locked")).alias("ok"), "open", "close")).over(by_symbol().rowsBetween(1, search))
    df = df.withColumn("_later", later).withColumn("_n", F.size("_later"))
    shift = F.array_position(F.transform("_later", lambda x: x["ok"]), True).cast("int")
    df = df.withColumn("_shift", F.when(shift > 0, shift).otherwise(F.col("_n")))
    # element_at counts from one and is only read where the list has an element
    at = F.when(F.col("_n") > 0, F.element_at("_later", F.greatest(F.col("_shift"), F.lit(1))))
    price = F.when(~F.col("_locked") | (F.col("_n") == 0), F.col("close")).when(shift > 0, at["open"]).otherwise(at["close"])
    df = df.withColumns({"_price": price, "_still": F.col("_locked") & (F.col("_n") > 0) & (shift == 0)})
    entry = F.when(lead("open") > 0, lead("open"))
    at_exit = lambda x: lead(x, horizon)
    known = entry.isNotNull() & at_exit("close").isNotNull()
    out = {
        "entry": lead("open"),
        "outcome": F.when(known, ratio(at_exit("close"), entry) - 1),
        "outcome_lock": F.when(known, ratio(at_exit("_price"), entry) - 1),
        "locked_exit": F.coalesce(known & at_exit("_locked"), F.lit(False)),
        "still_locked": F.coalesce(known & at_exit("_still"), F.lit(False)),
        "no_later_bar": F.coalesce(known & at_exit("_locked") & (at_exit("_n") == 0), F.lit(False)),
        "exit_upper_band": F.coalesce(known & at_exit("_at_upper"), F.lit(False)),
        "exit_shift": F.when(known & at_exit("_locked"), at_exit("_shift")).otherwise(0),
        "frozen_entry": F.coalesce(lead("_one_price"), F.lit(False)),
        "entry_lower_band": F.coalesce(lead("_open_band"), F.lit(False)),
    }
    return df.withColumns(out).drop("_prev", "_tick", "_locked", "_open_locked", "_at_upper", "_open_band", "_one_price", "_later", "_n", "_shift", "_price", "_still")
