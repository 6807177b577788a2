"""Orders from daily lists, scenarios, and the cash book that trades them.

Everything that does not depend on the money is worked out in Spark for all scenarios at once: the
session on which a list is bought, whether there is a bar, where a position ends, and the tick
part of slippage.  Only the book itself runs in sequence, one scenario to a group, as an order's
size depends on the equity before; it gets candidates, and closes of the days on which one of
them may be held.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions.bands import tick_size
from tidemark.operators.simulate import path_at, plan_exit

# Charges as shares of value, and per stock and selling day; the flat convention.
STT, STAMP, TURNOVER_FEE, REGULATOR_FEE, TAX_ON_FEES, DEPOSITORY, FLAT = 0.001, 0.00015, 0.0000322, 0.000001, 0.18, 15.93, 0.0035
# By kind of cost, the impact coefficient and the ticks lost at entry and exit.
SLIPPAGE = {"flat": (0.0, 0, 0), "base": (0.5, 0, 1), "stress": (1.0, 1, 1)}
#: What is kept back for charges when cash limits an order.
RESERVE = 1.0025
DEPTH = 20

SCENARIO = "scenario string, engine string, n int, hold int, capital double, costs string, cap double, stop double, duplicates boolean, whole boolean"


def fees(value):
    """Exchange and regulator fees with their tax; of a number or a column."""
    return value * (TURNOVER_FEE + REGULATOR_FEE) * (1 + TAX_ON_FEES)


def buy_cost(value):
    return value * (STT + STAMP) + fees(value)


def sell_cost(value):
    """Without the depository's charge, which is due once per stock and selling day."""
    return value * STT + fees(value)


def impact(k: float, value: float, adv: float, vol: float) -> float:
    """Square-root market impact, as a share of the price; none of a value below zero, which a sale has when slippage passes the price."""
    return k * vol * (max(value, 0.0) / adv) ** 0.5


def impact_column(k: Column | float, value: Column, adv: Column, vol: Column) -> Column:
    """Impact; none where turnover or volatility is unknown."""
    known = (adv > 0) & vol.isNotNull()
    share = F.greatest(value, F.lit(0.0)) / F.when(known, adv)
    return F.when(known, k * vol * F.sqrt(share)).otherwise(0.0)


def tick_slip(costs: Column, side: str, ts: Column, price: Column) -> Column:
    """Ticks that a kind of cost loses at the entry or the exit, as a share of the price."""
    at = {"entry": 1, "exit": 2}[side]
    ticks = F.coalesce(*(F.when(costs == k, F.lit(v[at])) for k, v in SLIPPAGE.items()), F.lit(0))
    return F.coalesce(F.when(price > 0, ticks * F.try_divide(tick_size(ts, price), price)), F.lit(0.0))


def scenario_set(
    spark: SparkSession,
    capital: float = 1e6,
    stops: tuple[float, ...] = (0.05, 0.08, 0.12),
    capitals: tuple[float, ...] = (2e5, 5e5, 1e6, 2.5e6, 5e6, 1e7, 2.5e7, 5e7),
    sizes: tuple[int, ...] = (1, 2, 3, 5, 10),
    holds: tuple[int, ...] = (1, 2, 3, 5, 7, 10),
    draws: int = 10,
) -> DataFrame:
    """The primary rule and what is varied around it, one row each.

    ``split_a`` and ``split_b`` are halves whose sum (``combined``) is one scenario.
    """
    base = dict(scenario="primary", engine="main", n=3, hold=5, capital=capital, costs="base", cap=0.02, stop=None, duplicates=True, whole=True)
    changes: list[dict] = [{}, {"scenario": "second", "engine": "second"}]
    changes += [{"scenario": f"split_{k}", "engine": e, "capital": capital / 2} for k, e in (("a", "main"), ("b", "second"))]
    changes += [{"scenario": "flat", "costs": "flat", "whole": False, "cap": None}, {"scenario": "stress", "costs": "stress"}, {"scenario": "once", "duplicates": False}]
    changes += [{"scenario": f"stop_{round(s * 100)}", "stop": s} for s in stops]
    changes += [{"scenario": f"capital_{int(c)}", "capital": c} for c in capitals]
    changes += [{"scenario": f"grid_{n}_{h}", "n": n, "hold": h} for n in sizes for h in holds]
    changes += [{"scenario": f"random_{k}", "engine": f"random_{k}"} for k in range(draws)]
    names = [c.split()[0] for c in SCENARIO.split(", ")]
    return spark.createDataFrame([tuple((base | c)[k] for k in names) for c in changes], SCENARIO)


def on_next_session(lists: DataFrame, calendar: DataFrame) -> DataFrame:
    """Lists (engine, ts, ...) with ``signal`` and the session after it as ``ts``; the last session's list is never bought."""
    after = calendar.select((F.col("session_idx") - 1).alias("session_idx"), F.col("ts").alias("_entry"))
    dated = calendar.join(after, "session_idx").select(F.col("ts").alias("signal"), F.col("_entry").alias("ts"))
    return lists.withColumnRenamed("ts", "signal").join(F.broadcast(dated), "signal")  # a row per session


def orders(lists: DataFrame, bars: DataFrame, calendar: DataFrame, scenarios: DataFrame, depth: int = DEPTH, search: int = 20) -> DataFrame:
    """Candidates of every scenario by entry day and rank, with their planned exit.

    ``lists``: engine, ts, rank, symbol, adv (as known on the signal day).  A candidate without a bar on
    the next session keeps a null open: the book takes the next one instead.
    """
    plans = [(r["hold"], r["stop"]) for r in scenarios.select("hold", "stop").distinct().collect()]  # a few dozen
    ahead = max(h for h, _ in plans) + search
    wanted = on_next_session(lists.filter(F.col("rank") <= depth), calendar)
    met = path_at(wanted.select("symbol", "ts").distinct(), bars, ahead)
    exits = F.array(*(F.struct(F.lit(h).alias("hold"), F.lit(s).cast("double").alias("stop"), plan_exit(h, s, search).alias("exit")) for h, s in plans))
    priced = met.select("symbol", "ts", "open", "vol", F.explode(exits).alias("p")).select("symbol", "ts", "open", "vol", "p.*")
    fan = F.broadcast(scenarios.select("scenario", "engine", "hold", "stop", "costs"))
    asked = wanted.join(fan, "engine")
    same = (F.col("a.symbol") == F.col("b.symbol")) & (F.col("a.ts") == F.col("b.ts")) & (F.col("a.hold") == F.col("b.hold")) & F.col("a.stop").eqNullSafe(F.col("b.stop"))
    out = asked.alias("a").join(priced.alias("b"), same, "left").select("a.scenario", "a.signal", "a.ts", "a.rank", "a.symbol", "a.adv", "a.costs", "b.open", "b.vol", "b.exit")
    slips = {"entry_tick": tick_slip(F.col("costs"), "entry", F.col("ts"), F.col("open")), "exit_tick": tick_slip(F.col("costs"), "exit", F.col("exit.day"), F.col("exit.price"))}
    return out.withColumns(slips).select("scenario", "signal", "ts", "rank", "symbol", "adv", "open", "vol", "entry_tick", "exit_tick", "exit.*")


_DAY = "scenario string, what string, ts date, equity double, cash double, invested double, positions int"
_TRADE = "symbol string, signal date, entry_day date, rank int, shares double, entry_fill double, exit_price double, exit_fill double, kind string, buy_value double, buy_cost double, sell_value double, sell_cost double, pnl double, ret double, raw_ret double, locked_exit boolean, stopped boolean, data_end boolean, capped boolean"
_COUNT = "orders long, filled long, replaced long, capped_orders long, cash_limited long"
BOOK = f"{_DAY}, {_TRADE}, {_COUNT}"


@dataclass
class Ledger:
    """Money, open lots by the moment of their planned sale, and what happened."""

    rules: dict
    cash: float
    due: dict[tuple, list[dict]] = field(default_factory=lambda: defaultdict(list))
    shares: Counter = field(default_factory=Counter)
    lots: Counter = field(default_factory=Counter)
    price: dict[str, float] = field(default_factory=dict)
    counts: Counter = field(default_factory=Counter)
    trades: list[dict] = field(default_factory=list)

    def slip(self, value: float, c: dict, ticks: float) -> float:
        known = c["adv"] is not None and c["vol"] is not None and c["adv"] > 0 and self.rules["k"] > 0
        return ticks + (impact(self.rules["k"], value, c["adv"], c["vol"]) if known else 0.0)

    def size(self, share: float, c: dict) -> tuple[float, bool] | None:
        """Value of an order and whether turnover caps it; None where the candidate cannot be bought."""
        if c["open"] is None or c["open"] <= 0:
            return None
        if self.rules["cap"] is None:
            return share, False
        most = self.rules["cap"] * (c["adv"] or 0.0)
        return (min(share, most), most < share) if most > 0 else None

    def buy(self, share: float, c: dict) -> bool:
        sized = self.size(share, c)
        if sized is None:
            return False
        value, capped = sized
        fill = c["open"] * (1 + self.slip(value, c, c["entry_tick"]))
        budget = min(value, self.cash / RESERVE)
        self.counts["cash_limited"] += budget < value
        shares = math.floor(budget / fill) if self.rules["whole"] else budget / fill
        if shares <= 0:
            return False
        paid = shares * fill
        cost = 0.0 if self.rules["costs"] == "flat" else buy_cost(paid)
        self.cash -= paid + cost
        lot = c | {"shares": float(shares), "entry_fill": fill, "buy_value": paid, "buy_cost": cost, "capped": capped, "entry_day": c["ts"]}
        self.due[c["day"], c["kind"] == "open"].append(lot)
        self.shares[c["symbol"]] += shares
        self.lots[c["symbol"]] += 1
        self.price.setdefault(c["symbol"], fill)
        self.counts["capped_orders"] += capped
        return True

    def sell(self, day: object, at_open: bool, charged: set[str]) -> None:
        for lot in self.due.pop((day, at_open), ()):
            fill = lot["price"] * (1 - self.slip(lot["buy_value"], lot, lot["exit_tick"]))
            value = lot["shares"] * fill
            cost = FLAT * lot["buy_value"] if self.rules["costs"] == "flat" else sell_cost(value) + (0.0 if lot["symbol"] in charged else DEPOSITORY)
            charged.add(lot["symbol"])
            self.cash += value - cost
            self.lots[lot["symbol"]] -= 1
            self.shares[lot["symbol"]] -= lot["shares"]
            if not self.lots[lot["symbol"]]:
                del self.lots[lot["symbol"]], self.shares[lot["symbol"]]
            put_in = lot["buy_value"] + lot["buy_cost"]
            gain = value - cost - put_in
            sale = {"what": "trade", "ts": day, "exit_price": lot["price"], "exit_fill": fill, "sell_value": value, "sell_cost": cost, "pnl": gain, "ret": gain / put_in, "raw_ret": lot["price"] / lot["open"] - 1}
            self.trades.append(lot | sale)

    def worth(self) -> float:
        return sum(n * self.price[s] for s, n in self.shares.items())


def _run(rules: dict, days: list, candidates: dict[object, list[dict]], closes: dict[object, dict[str, float]]) -> Iterator[dict]:
    book = Ledger(rules, rules["capital"])
    equity = book.cash
    for day in days:
        charged: set[str] = set()
        book.sell(day, True, charged)
        queue = [(c["rank"], c["symbol"], k, c) for k, c in enumerate(candidates.get(day, ()))]
        heapq.heapify(queue)
        left = rules["n"]
        while queue and left:
            c = heapq.heappop(queue)[-1]
            if rules["duplicates"] or c["symbol"] not in book.lots:
                got = book.buy(equity / (rules["n"] * rules["hold"]), c)
                book.counts.update(orders=1, filled=got, replaced=not got)
                left -= got
        book.sell(day, False, charged)
        for s in book.shares.keys() & closes.get(day, {}).keys():
            book.price[s] = closes[day][s]
        # A price is forgotten with the last lot, so that the next purchase starts at its own.
        book.price = {s: p for s, p in book.price.items() if s in book.shares}
        equity = book.cash + book.worth()
        yield {"what": "day", "ts": day, "equity": equity, "cash": book.cash, "invested": equity - book.cash, "positions": sum(book.lots.values())}
    yield from book.trades
    yield {"what": "count", **{c.split()[0]: int(book.counts[c.split()[0]]) for c in _COUNT.split(", ")}}


def simulate(candidates: DataFrame, bars: DataFrame, calendar: DataFrame, scenarios: DataFrame) -> DataFrame:
    """The book of every scenario: rows of days, trades and counts (column ``what``; see ``days``, ``trades``, ``counts``)."""
    held = candidates.filter("open IS NOT NULL").select("scenario", "symbol", "ts", "day").withColumn("_until", F.coalesce("day", "ts"))
    # One row for each symbol and entry day would repeat closes; a symbol's overlapping holdings are joined first.
    order = W.partitionBy("scenario", "symbol").orderBy("ts").rowsBetween(W.unboundedPreceding, -1)
    first = F.coalesce(F.col("ts") > F.max("_until").over(order), F.lit(True)).cast("int")
    spans = held.withColumn("_new", first).withColumn("_span", F.sum("_new").over(W.partitionBy("scenario", "symbol").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)))
    spans = spans.groupBy("scenario", "symbol", "_span").agg(F.min("ts").alias("_from"), F.max("_until").alias("_to"))
    marks = spans.join(bars.select("symbol", "ts", "close"), "symbol").filter(F.col("ts").between(F.col("_from"), F.col("_to"))).select("scenario", F.lit("mark").alias("row"), "ts", "symbol", "close")
    every = calendar.select("ts").crossJoin(F.broadcast(scenarios.select("scenario"))).select("scenario", F.lit("day").alias("row"), "ts")  # scenarios are a few dozen
    rows = candidates.withColumn("row", F.lit("order")).unionByName(marks, allowMissingColumns=True).unionByName(every, allowMissingColumns=True)
    known = scenarios.drop("engine")
    # A scenario without a single row in these tables does not trade.
    return rows.join(F.broadcast(known.withColumnRenamed("stop", "_stop")), "scenario").drop("_stop").groupBy("scenario").applyInPandas(_book, BOOK)


def _book(rows: pd.DataFrame) -> pd.DataFrame:
    names = [c.split()[0] for c in BOOK.split(", ")]
    one = rows.iloc[0]
    rules = {"n": int(one["n"]), "hold": int(one["hold"]), "capital": float(one["capital"]), "cap": None if pd.isna(one["cap"]) else float(one["cap"]), "costs": one["costs"], "k": SLIPPAGE[one["costs"]][0], "duplicates": bool(one["duplicates"]), "whole": bool(one["whole"])}
    asked = rows[rows["row"] == "order"]
    asked = asked.astype(object).where(asked.notna(), None)
    fields = ["signal", "ts", "rank", "symbol", "adv", "open", "vol", "entry_tick", "exit_tick", "day", "kind", "price", "locked_exit", "stopped", "data_end"]
    candidates: dict[object, list[dict]] = defaultdict(list)
    for values in asked[fields].itertuples(index=False, name=None):
        candidates[values[1]].append(dict(zip(fields, values, strict=True)))
    closes: dict[object, dict[str, float]] = defaultdict(dict)
    for day, symbol, close in rows.loc[rows["row"] == "mark", ["ts", "symbol", "close"]].dropna().itertuples(index=False, name=None):
        closes[day][symbol] = close
    out = pd.DataFrame(list(_run(rules, sorted(rows.loc[rows["row"] == "day", "ts"].unique()), candidates, closes)), columns=[*names[1:]])
    out.insert(0, "scenario", one["scenario"])
    for c in (c.split() for c in BOOK.split(", ")):
        kind = {"long": "Int64", "int": "Int32", "boolean": "boolean"}.get(c[1])
        if kind:
            out[c[0]] = out[c[0]].astype(kind)
    return out[names]


def _part(book: DataFrame, what: str, columns: str) -> DataFrame:
    names = [c.split()[0] for c in columns.split(", ") if c.split()[0] != "what"]
    return book.filter(F.col("what") == what).select(*dict.fromkeys(["scenario", *names]))


def days(book: DataFrame) -> DataFrame:
    """Equity by scenario and day."""
    return _part(book, "day", _DAY)


def trades(book: DataFrame) -> DataFrame:
    """Closed trades; ``ts`` is the day of the sale."""
    return _part(book, "trade", f"ts date, {_TRADE}")


def counts(book: DataFrame) -> DataFrame:
    """Per scenario: orders, filled, replaced, capped and cash-limited ones."""
    return _part(book, "count", _COUNT)


def combined(equity: DataFrame, name: str, members: list[str]) -> DataFrame:
    """The sum of several scenarios as one."""
    parts = equity.filter(F.col("scenario").isin(members)).groupBy("ts").agg(*(F.sum(c).alias(c) for c in ("equity", "cash", "invested")), F.sum("positions").cast("int").alias("positions"))
    return parts.select(F.lit(name).alias("scenario"), *[c for c in equity.columns if c != "scenario"])
