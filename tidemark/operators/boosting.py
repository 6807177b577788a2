"""Boosted regression trees on quantile bins, grown best leaf first from sums that Spark adds up.

Rows are binned once and kept as blocks of bytes. A pass over the blocks sums gradients by (group, node, feature, bin)
within each task; the sums are added in one shuffle, running sums over the bins give each split's gain, and a row a node comes
back. All groups (folds, targets) grow in the same passes. Nodes whose split may be asked for next are worked out ahead, so that a
tree takes a few passes and not one a split. Gradients are whole numbers of a small unit, so sums, and with
them the trees, do not depend on the order of rows or tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.sources.tables import materialised

UNIT = float(1 << 30)
#: Rounds after which the predictions of all rows are written anew.
HOLD = 10


@dataclass(frozen=True)
class Rules:
    """200 rounds of trees of 31 leaves with 200 rows each at least, shrunk by 0.05, with L2 1.0, on 255 bins and one for what is missing."""

    rounds: int = 200
    rate: float = 0.05
    leaves: int = 31
    least: int = 200
    l2: float = 1.0
    bins: int = 255


@dataclass
class Split:
    gain: float
    feature: int
    bin: int
    missing_left: bool
    sums: tuple[tuple[float, int], tuple[float, int]]  # (gradient, rows) on the left and right


@dataclass
class Tree:
    """Nodes by number; ``splits`` has those worked out (None: no split), ``children`` those in the tree."""

    splits: dict[int, Split | None] = field(default_factory=dict)
    children: dict[int, tuple[int, int]] = field(default_factory=dict)
    sums: dict[int, tuple[float, int]] = field(default_factory=dict)
    chosen: set[int] = field(default_factory=set)
    values: dict[int, float] = field(default_factory=dict)

    def leaves(self) -> list[int]:
        return [n for k in self.chosen for n in self.children[k] if n not in self.chosen] or [0]

    def grow(self, rules: Rules) -> list[int]:
        """Takes the best splits that are known, and gives the nodes whose splits are needed before the next (none: the tree is whole)."""
        while len(self.chosen) + 1 < rules.leaves:
            leaves = self.leaves()
            if any(n not in self.splits for n in leaves):
                break
            best = max((n for n in leaves if self.splits[n]), key=lambda n: (self.splits[n].gain, -n), default=None)
            if best is None:
                return []
            self.chosen.add(best)
            self._open(best)
        else:
            return []
        # The children of the best splits that are known may be asked for next.
        ahead = [n for n, s in self.splits.items() if s and n not in self.children]
        for n in sorted(ahead, key=lambda n: (-self.splits[n].gain, n))[: rules.leaves]:
            self._open(n)
        return [n for n in self.sums if n not in self.splits]

    def _open(self, node: int) -> None:
        if node not in self.children:
            first = len(self.sums)
            self.children[node] = (first, first + 1)
            self.sums[first], self.sums[first + 1] = self.splits[node].sums

    def places(self, bins: np.ndarray, rules: Rules, only_chosen: bool) -> np.ndarray:
        """The node of each row of bins."""
        at = np.zeros(len(bins), np.int32)
        for node in sorted(self.children):  # a child's number is larger than its parent's
            if only_chosen and node not in self.chosen:
                continue
            here = np.flatnonzero(at == node)
            s = self.splits[node]
            b = bins[here, s.feature]
            left = np.where(b == rules.bins, s.missing_left, b <= s.bin)
            at[here] = np.where(left, *self.children[node])
        return at

    def predict(self, bins: np.ndarray, rules: Rules) -> np.ndarray:
        table = np.zeros(len(self.sums))
        for n, v in self.values.items():
            table[n] = v
        return table[self.places(bins, rules, True)]


@dataclass
class Model:
    """Of each group: cuts of the features, the first prediction and the trees; its size does not follow the rows."""

    features: list[str]
    rules: Rules
    cuts: dict[object, list[np.ndarray]]
    start: dict[object, float]
    trees: dict[object, list[Tree]]

    def binned(self, group: object, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint8)
        for k, c in enumerate(self.cuts[group]):
            out[:, k] = np.where(np.isnan(x[:, k]), self.rules.bins, np.searchsorted(c, x[:, k], "left"))
        return out


def _values(batch: pa.RecordBatch, first: int) -> np.ndarray:
    return np.stack([np.asarray(c.cast(pa.float64()).fill_null(np.nan)) for c in batch.columns[first:]], 1)


def _by_group(keys: list) -> Iterator[tuple[object, np.ndarray]]:
    codes = {k: n for n, k in enumerate(dict.fromkeys(keys))}
    at = np.array([codes[k] for k in keys])
    for k, n in codes.items():
        yield k, np.flatnonzero(at == n)


def fit(rows: DataFrame, group: str, target: str, features: list[str], rules: Rules = Rules()) -> Model:
    """Trains a model of each group on its rows with a target; unknown features have a bin of their own, which goes where it helps."""
    spark = rows.sparkSession
    known = rows.filter(F.col(target).isNotNull()).select(F.col(group).alias("g"), F.col(target).cast("double").alias("y"), *(F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(features)))
    known = materialised(known)
    at = [k / rules.bins for k in range(1, rules.bins)]
    quantiles = [F.percentile_approx(f"x{k}", at, 10_000).alias(f"q{k}") for k in range(len(features))]
    mean = F.sum(F.round(F.col("y") * UNIT).cast("long")) / F.count("*") / UNIT
    first = known.groupBy("g").agg(mean.alias("start"), *quantiles).collect()  # a row a group
    model = Model(features, rules, {r["g"]: [np.unique([v for v in r[f"q{k}"] or [] if v == v]) for k in range(len(features))] for r in first}, {r["g"]: r["start"] for r in first}, {r["g"]: [] for r in first})
    shape = spark.sparkContext.broadcast(model)
    kind = known.schema["g"].dataType.simpleString()
    schema = f"g {kind}, bins binary, y binary, p binary"
    types = pa.schema([("g", known.select("g").limit(0).toArrow().schema.field(0).type), ("bins", pa.binary()), ("y", pa.binary()), ("p", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shape.value
        for batch in batches:
            y, x = np.asarray(batch.column(1)), _values(batch, 2)
            parts = [(k, m.binned(k, x[use]).tobytes(), y[use].tobytes(), np.full(len(use), m.start[k]).tobytes()) for k, use in _by_group(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*parts, strict=True), types.types, strict=True)], types.names)

    blocks = materialised(known.mapInArrow(pack, schema))
    many = len(features)
    since = {g: 0 for g in model.trees}  # trees that the written predictions have

    def each(batch: pa.RecordBatch, state: dict) -> Iterator[tuple[object, np.ndarray, np.ndarray, np.ndarray]]:
        """(group, bins, y, prediction) of each block."""
        for g, bins, y, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            b = np.frombuffer(bins, np.uint8).reshape(-1, many)
            yield g, b, np.frombuffer(y), np.frombuffer(p) + sum((t.predict(b, rules) for t in state[g][0]), np.zeros(len(b)))

    def sums(wanted: dict[object, tuple[list[Tree], Tree, list[int]]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(wanted)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state = sent.value
            width = rules.bins + 1
            held = {g: np.zeros((len(s[2]), many, width, 2), np.int64) for g, s in state.items() if s[2]}
            for batch in batches:
                for g, bins, y, p in each(batch, state):
                    if g not in held:
                        continue
                    gradient = np.rint((p - y) * UNIT).astype(np.int64)
                    order = np.full(len(state[g][1].sums), -1)
                    order[state[g][2]] = np.arange(len(state[g][2]))
                    node = order[state[g][1].places(bins, rules, False)]
                    use = np.flatnonzero(node >= 0)
                    for k in range(many):
                        slot = node[use] * width + bins[use, k]
                        total = np.zeros(len(state[g][2]) * width, np.int64)
                        np.add.at(total, slot, gradient[use])
                        held[g][:, k, :, 0] += total.reshape(-1, width)
                        held[g][:, k, :, 1] += np.bincount(slot, minlength=len(total)).reshape(-1, width)
            for g, table in held.items():
                node, feature, b = np.nonzero(table[..., 1])
                for begin in range(0, len(node), 1 << 16):
                    s = slice(begin, begin + (1 << 16))
                    t = table[node[s], feature[s], b[s]]
                    yield pa.RecordBatch.from_arrays([pa.array([g] * len(t), types.field(0).type), *(pa.array(v.astype(np.int32)) for v in (np.asarray(state[g][2])[node[s]], feature[s], b[s])), pa.array(t[:, 0]), pa.array(t[:, 1])], ["g", "node", "feature", "bin", "d", "n"])

        # Each task has added up its own; one shuffle serves the sums and the running sums after them.
        parts = blocks.mapInArrow(run, f"g {kind}, node int, feature int, bin int, d long, n long").repartition("g", "node", "feature")
        return parts.groupBy("g", "node", "feature", "bin").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))

    for _ in range(rules.rounds):
        growing = {g: Tree() for g in model.trees}
        for t in growing.values():
            t.sums[0] = (0.0, 0)
        while any(needed := {g: t.grow(rules) for g, t in growing.items()}.values()):
            wanted = {g: (model.trees[g][since[g] :], t, need) for (g, t), need in zip(growing.items(), needed, strict=True)}
            for r in best_splits(sums(wanted), rules).collect():  # a row a group and node
                t = growing[r["g"]]
                t.splits[r["node"]] = Split(r["gain"], r["feature"], r["bin"], r["missing_left"], ((r["dl"] / UNIT, r["nl"]), (r["dr"] / UNIT, r["nr"]))) if r["gain"] is not None else None
                t.sums[r["node"]] = (r["d"] / UNIT, r["n"])
            for (g, t), need in zip(growing.items(), needed, strict=True):
                for n in need:
                    t.splits.setdefault(n, None)
        for g, t in growing.items():
            t.values = {n: -rules.rate * t.sums[n][0] / (t.sums[n][1] + rules.l2) for n in t.leaves()}
            model.trees[g].append(t)
        if model.trees and len(next(iter(model.trees.values()))) % HOLD == 0:
            sent = spark.sparkContext.broadcast({g: (trees[since[g] :],) for g, trees in model.trees.items()})

            def renew(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    yield batch.set_column(3, "p", pa.array([p.tobytes() for *_, p in each(batch, sent.value)], pa.binary()))

            blocks = materialised(blocks.mapInArrow(renew, schema))
            since = {g: len(trees) for g, trees in model.trees.items()}
    return model


def best_splits(sums: DataFrame, rules: Rules) -> DataFrame:
    """Per group and node: all gradients d and rows n, and the split of the largest gain (null where no split leaves enough rows on both sides).

    Of equal gains the first feature counts, then the first bin, then what is missing on the left.
    """
    per = W.partitionBy("g", "node", "feature")
    known = F.col("bin") < rules.bins
    part = lambda c: F.coalesce(F.sum(F.when(~known, F.col(c))).over(per), F.lit(0))
    so_far = lambda c: F.sum(F.when(known, F.col(c)).otherwise(0)).over(per.orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    cut = sums.select("g", "node", "feature", "bin", known.alias("known"), *(x for c in "dn" for x in (F.sum(c).over(per).alias(c), part(c).alias(f"{c}m"), so_far(c).alias(f"{c}k"))))
    # A split lies after each bin of known values, and what is missing goes to either side.
    side = cut.withColumn("missing_left", F.explode(F.array(F.lit(True), F.lit(False)))).withColumns({f"{c}l": F.col(f"{c}k") + F.when(F.col("missing_left"), F.col(f"{c}m")).otherwise(0) for c in "dn"})
    side = side.withColumns({f"{c}r": F.col(c) - F.col(f"{c}l") for c in "dn"})
    score = lambda d, n: F.pow(F.col(d) / UNIT, 2) / (F.col(n) + rules.l2)
    gain = score("dl", "nl") + score("dr", "nr") - score("d", "n")
    allowed = F.col("known") & (F.col("nl") >= rules.least) & (F.col("nr") >= rules.least) & (gain > 1e-12)
    order = F.when(allowed, F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), F.col("missing_left"), "dl", "nl", "dr", "nr"))
    best = side.groupBy("g", "node").agg(F.max(order).alias("s"), F.max(F.struct("feature", "d", "n")).alias("all"))
    return best.select("g", "node", F.col("all.d").alias("d"), F.col("all.n").alias("n"), "s.gain", (-F.col("s.f")).alias("feature"), (-F.col("s.b")).alias("bin"), "s.missing_left", "s.dl", "s.nl", "s.dr", "s.nr")


def predict(rows: DataFrame, model: Model, group: str, carry: list[str], name: str = "score") -> DataFrame:
    """Adds each row's prediction by its group's model; null where the group has none."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carry), f"`{name}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            out = np.full(len(batch), np.nan)
            x = _values(batch, len(carry) + 1)
            for g, use in _by_group(batch.column(len(carry)).to_pylist()):
                if g in m.trees:
                    bins = m.binned(g, x[use])
                    out[use] = m.start[g] + sum((t.predict(bins, m.rules) for t in m.trees[g]), np.zeros(len(use)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(out, mask=np.isnan(out))], [*carry, name])

    return rows.select(*carry, F.col(group).alias("_g"), *(F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(model.features))).mapInArrow(run, fields)
