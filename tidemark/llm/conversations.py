"""Repair of a conversation's structure by weighted finite-state composition.

Three machines are composed: the conversation's rows as an acceptor, a transducer of edits (keep,
give another role, delete, insert), and an acceptor of the legal order of roles,
``(s?(ua)+)?``. A composed state is a place in the rows and a state of the grammar; its arcs are made when they are first met.
The shortest path goes back from the end in topological order. Weights are pairs of cost and
label string, compared in this order; a label is kept as its first edits and the rank of what follows
among the labels of the next place, so comparing takes no time in the label's length.

A conversation may have any number of rows. Rows are sorted by range, so a long one is cut into the
runs of several tasks. A run gives its cheapest path between each two states of the grammar, and
these products are joined from the right. That is exact: labels of a run end with the edit
of its last row and hold equally many edits of rows, so none is the beginning of another, and the least of
each pair of states stays the least whatever comes before or after.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import Tables

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"
NAMES = {"u": "user", "a": "assistant"}
#: The grammar: state -> initial -> next state; 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
STATES = range(len(GRAMMAR))
INITIALS = "sua"
_NONE = 1 << 62


class Composed:
    """Arcs of the composed machine, made and kept when a symbol is first read in a state.

    Symbols: 0 must be deleted; else 1 + 2 * (place of the initial in ``INITIALS``, or 3) + truncated.
    """

    def __init__(self) -> None:
        self._arcs: dict[tuple[int, int], list[tuple[int, str, int]]] = {}
        self._inserted: dict[int, list[tuple[int, str, int]]] = {}

    def inserted(self, state: int) -> list[tuple[int, str, int]]:
        """(cost, label, state) after insertions; a path that comes back to a state would only cost more."""
        found = self._inserted.get(state)
        if found is None:
            found, seen, cost, label, ahead = [], set(), 0, "", [state]
            while ahead:
                seen |= set(ahead)
                found += [(cost, label, q) for q in ahead]
                ahead = sorted({GRAMMAR[q][r] for q in ahead for r in NAMES if r in GRAMMAR[q]} - seen)
                cost, label = cost + INSERT, label + "I"
            self._inserted[state] = found
        return found

    @staticmethod
    def edits(symbol: int) -> Iterator[tuple[int, str, str]]:
        """(cost, label, initial of what is left, empty if nothing)."""
        yield DELETE, "D", ""
        if symbol:
            extra = TRUNCATED * ((symbol - 1) & 1)
            yield KEEP + extra, "K", (*INITIALS, "?")[(symbol - 1) >> 1]
            for role in NAMES:
                yield REROLE + extra, "R", role

    def arcs(self, symbol: int, state: int) -> list[tuple[int, str, int]]:
        """(cost, label, next state) over one row, with the insertions before it."""
        found = self._arcs.get((symbol, state))
        if found is None:
            found = []
            for cost, label, q in self.inserted(state):
                for more, edit, role in self.edits(symbol):
                    if not role or role in GRAMMAR[q]:
                        found.append((cost + more, label + edit, GRAMMAR[q][role] if role else q))
            self._arcs[symbol, state] = found
        return found

    def end(self) -> tuple[list[int], list[str]]:
        """Cost and label from each state to the end of a conversation."""
        best = [min((cost, label) for cost, label, q in self.inserted(state) if q in ENDS) for state in STATES]
        return [b[0] for b in best], [b[1] for b in best]

    def paths(self, symbols: bytes, cost: list[int], label: list[str], starts: Iterator[int] = STATES) -> list[tuple[int, str] | None]:
        """The cheapest path from each of ``starts`` through the rows and on to the given weights of the states behind them."""
        rank = _ranks(label)
        picks = [bytearray(len(symbols)) for _ in STATES]
        for place in range(len(symbols) - 1, -1, -1):
            costs, keys = [_NONE] * len(STATES), [("", 0)] * len(STATES)
            for state in STATES:
                best = None
                for number, (more, edit, q) in enumerate(self.arcs(symbols[place], state)):
                    if cost[q] < _NONE:
                        weight = (more + cost[q], edit, rank[q])
                        if best is None or weight < best:
                            best, picks[state][place] = weight, number
                if best is not None:
                    costs[state], keys[state] = best[0], best[1:]
            cost, rank = costs, _ranks(keys)
        found: list[tuple[int, str] | None] = []
        for state in starts:
            if cost[state] >= _NONE:
                found.append(None)
                continue
            edits, q = [], state
            for place, symbol in enumerate(symbols):
                _, edit, q = self.arcs(symbol, q)[picks[q][place]]
                edits.append(edit)
            found.append((cost[state], "".join(edits) + label[q]))
        return found

    def product(self, symbols: bytes) -> list[tuple[int, str] | None]:
        """The cheapest path between each two states, by start and end."""
        ends = [self.paths(symbols, [0 if q == end else _NONE for q in STATES], [""] * len(STATES)) for end in STATES]
        return [ends[end][start] for start in STATES for end in STATES]

    def joined(self, products: list[list[tuple[int, str] | None]]) -> tuple[int, str]:
        """The cheapest path from the start through consecutive runs to the end."""
        cost, label = self.end()
        rank, last = _ranks(label), label
        picks: list[list[int]] = []
        for product in reversed(products):
            costs, keys, picked = [_NONE] * len(STATES), [("", 0)] * len(STATES), [0] * len(STATES)
            for state in STATES:
                ways = [(part[0] + cost[q], part[1], rank[q], q) for q in STATES if (part := product[state * len(STATES) + q]) and cost[q] < _NONE]
                if ways:
                    costs[state], edit, r, picked[state] = min(ways)
                    keys[state] = (edit, r)
            cost, rank = costs, _ranks(keys)
            picks.append(picked)
        parts, q = [], 0
        for product, picked in zip(products, reversed(picks), strict=True):
            parts.append(product[q * len(STATES) + picked[q]][1])
            q = picked[q]
        return cost[0], "".join(parts) + last[q]


def _ranks(keys: list) -> list[int]:
    order = {k: n for n, k in enumerate(sorted(set(keys)))}
    return [order[k] for k in keys]


def _illegal(a: str, b: str) -> bool:
    return a + b not in ("su", "ua", "au")


#: Columns that order the rows of all conversations.
ORDER = ["conv_id", "turn", "role", "head", "key"]


def keyed(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text without nulls, the number of ``copies``, and what orders rows and tells them apart.

    Rows of one turn go by role, then text (by its first 32 characters, then its digest). Role and text of equal digest are equal.
    """
    filled = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "copies")
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return filled.withColumns({"head": F.substring("text", 1, 32), "key": digest})


def _counted(rows: DataFrame) -> DataFrame:
    """One row for each conversation, turn, role and text: its number ``m``, and whether its first copy is the first of its role and text."""
    solid = F.rtrim("text", F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    facts = {
        "initial": F.when(initial.isin(*INITIALS), initial).otherwise("?"),
        "blank": solid == "",
        "truncated": ~F.substring(solid, -1, 1).isin(".", "!", "?"),
    }
    held = ["conv_id", "role", "head", "key", *facts]
    each = rows.withColumns(facts).groupBy(*held, "turn").agg(F.sum("copies").alias("m"))
    first = each.filter("m > 0").groupBy(*held).agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("at"))
    marks = first.select(*held, F.col("at.turn").alias("turn"), F.lit(0).cast("long").alias("m"), F.lit(1).alias("first"))
    return each.withColumn("first", F.lit(0)).unionByName(marks).groupBy(*held, "turn").agg(F.sum("m").alias("m"), F.max("first").alias("first"))


def _statistics(counted: DataFrame) -> DataFrame:
    """gaps, blank, duplicate and truncated of every conversation, those without rows left included."""
    there = F.col("m") > 0
    turn = F.when(there, F.col("turn"))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    span = F.try_subtract(F.max(turn), F.min(turn)) + 1 - F.count_distinct(turn)
    return counted.groupBy("conv_id").agg(
        F.when(F.count(turn) > 0, span).otherwise(0).cast("long").alias("gaps"),
        total(F.when(F.col("blank"), F.col("m"))).alias("blank"),
        total(F.when(~F.col("blank"), F.col("m") - F.col("first"))).alias("duplicate"),
        total(F.when(~F.col("blank") & F.col("truncated"), F.col("first"))).alias("truncated"),
    )


_RUN = "conv_id {kind}, run long, illegal long, initial string, final string, costs array<long>, labels array<string>"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to one row a conversation, or its part that is in this task.

    A conversation that begins and ends here has one cost and label; the first and the last one of the task may go on elsewhere
    and have a product.
    """
    machine = Composed()
    end = machine.end()
    task = TaskContext.get().partitionId()
    out: dict[str, list] = {k: [] for k in ("conv_id", "run", "illegal", "initial", "final", "costs", "labels")}
    kind = None

    def put(whole: bool) -> None:
        paths = [machine.paths(bytes(symbols), *end, starts=[0])[0]] if whole else machine.product(bytes(symbols))
        values = (conv, task, illegal, initial, before, [p and p[0] for p in paths], [p and p[1] for p in paths])
        for column, v in zip(out.values(), values, strict=True):
            column.append(v)

    def table() -> pa.RecordBatch:
        types = [kind, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string())]
        made = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))
        for column in out.values():
            column.clear()
        return made

    conv, number = object(), -1
    symbols, illegal, initial, before = bytearray(), 0, "", ""
    for batch in batches:
        kind = batch.schema.field(0).type
        for now, mark, m, first, blank, truncated in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if number < 0 or now != conv:
                if number >= 0:
                    put(whole=number > 0)
                conv, number = now, number + 1
                symbols, illegal, initial, before = bytearray(), 0, mark, ""
                if len(out["run"]) >= 1000:
                    yield table()
            illegal += m - 1 + bool(before and _illegal(before, mark))  # copies stand side by side, and no role may follow itself
            before = mark
            real = first and not blank
            if real:
                symbols.append(1 + 2 * "sua?".index(mark) + truncated)
            symbols += bytes(m - bool(real))
    if number >= 0:
        put(whole=False)
        yield table()


def _join_runs(key: tuple[pa.Scalar, ...], runs: pa.Table) -> pa.Table:
    """The runs of one conversation, at most one a task, to its number of illegal neighbours, cost and label."""
    runs = runs.sort_by("run")
    machine = Composed()
    products = [[None if c is None else (c, t) for c, t in zip(*pair, strict=True)] for pair in zip(runs["costs"].to_pylist(), runs["labels"].to_pylist(), strict=True)]
    initials, finals = runs["initial"].to_pylist(), runs["final"].to_pylist()
    illegal = sum(runs["illegal"].to_pylist()) + sum(_illegal(a, b) for a, b in zip(finals, initials[1:], strict=False))
    cost, label = machine.joined(products)
    return pa.table({"conv_id": runs["conv_id"].slice(0, 1), "illegal": pa.array([illegal], pa.int64()), "cost": pa.array([cost], pa.int64()), "audit": pa.array([label])})


def _edits(counted: DataFrame, tables: Tables) -> DataFrame:
    """illegal, cost and audit of every conversation that has rows."""
    kind = counted.schema["conv_id"].dataType.simpleString()
    rows = counted.filter("m > 0").repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    runs = tables.write("runs", rows.select("conv_id", "initial", "m", "first", "blank", F.col("truncated").cast("int")).mapInArrow(_runs, _RUN.format(kind=kind)))
    whole = runs.filter(F.size("costs") == 1).select("conv_id", "illegal", F.col("costs")[0].alias("cost"), F.col("labels")[0].alias("audit"))
    split = runs.filter(F.size("costs") > 1).groupBy("conv_id").applyInArrow(_join_runs, f"conv_id {kind}, illegal long, cost long, audit string")
    return whole.unionByName(split)


def _in_order(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Each conversation's audit and then its rows, in order, in one task."""
    sent = rows.select(*ORDER, "text", "copies", F.lit(None).cast("string").alias("audit"), F.lit(1).alias("kind"))
    heads = edits.select(*(F.lit(None).cast(sent.schema[c].dataType).alias(c) if c not in ("conv_id", "audit") else F.col(c) for c in sent.columns if c != "kind"), F.lit(0).alias("kind"))
    sorted_rows = sent.filter("copies > 0").unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER[1:])
    return sorted_rows.select("conv_id", "kind", "audit", "role", "text", "copies")


def _turns(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, place, edit, role, text) of each turn kept or inserted; (conv_id, -1, ...) begins a conversation."""
    audit, at, left, conv, place = "", 0, 0, None, 0

    def roled() -> str:
        # The last role is the assistant's, and they take turns back from there.
        return "assistant" if (left - 1 - place) % 2 == 0 else "user"

    for now, kind, found, role, text, copies in rows:
        if kind == 0:
            while at < len(audit):  # insertions after the last row
                yield conv, place, "I", roled(), ""
                at, place = at + 1, place + 1
            conv, audit, at, place = now, found, 0, 0
            left = len(audit) - audit.count("D")
            yield conv, -1, "", "", ""
            continue
        for _ in range(copies):
            while audit[at] == "I":
                yield conv, place, "I", roled(), ""
                at, place = at + 1, place + 1
            if audit[at] != "D":
                yield conv, place, audit[at], role if audit[at] == "K" else roled(), text
                place += 1
            at += 1
    while at < len(audit):
        yield conv, place, "I", roled(), ""
        at, place = at + 1, place + 1


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for begin in range(0, len(batch), 256):
            yield from zip(*(c.slice(begin, 256).to_pylist() for c in batch.columns), strict=True)


def _digests(conv_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found, state = [], [], None
        for conv, place, _, role, text in _turns(_rows_of(batches)):
            if place < 0:
                if state is not None:
                    found.append(state.hexdigest())
                if len(found) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, conv_type), pa.array(found)], ["conv_id", "repaired_sha256"])
                    ids, found = [], []
                ids.append(conv)
                state = hashlib.sha256()
                continue
            state.update(f"{chr(10) if place else ''}{role}:".encode())
            state.update(text.encode())
        if state is not None:
            found.append(state.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, conv_type), pa.array(found)], ["conv_id", "repaired_sha256"])

    return run


def _repaired(conv_type: pa.DataType):
    names = ["conv_id", "place", "edit", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in _turns(_rows_of(batches)):
            if row[1] < 0:
                continue
            rows.append(row)
            size += len(row[4])
            if len(rows) >= 1000 or size > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (conv_type, pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (conv_type, pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names)

    return run


def _arrow_type(table: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(table.schema[column].dataType)


def repair(conversations: DataFrame, turns: bool = False) -> DataFrame:
    """Finds the cheapest edits that make every conversation's roles ``(s?(ua)+)?``, and applies them.

    Reads conv_id, turn, role, text and, if there, ``copies`` (how often a row counts, 1 without it); other columns are left alone.
    Keeping a row costs 0, another role 1, deleting 2, inserting an empty turn 5; a truncated row that stays costs 5 more; blank rows and
    repeated ones (role and text seen earlier in the conversation) must go. Of edits of equal cost, those whose initials come first in ASCII are taken.

    Returns a row for each conversation: gaps, blank, duplicate, truncated, illegal, cost, audit (initials of the edits) and
    repaired_sha256; or, with ``turns``, the repaired turns themselves: conv_id, place, edit, role, text.

    A null role or text counts as one blank; rows without conv_id are one conversation; rows without a turn come first. Rows of one turn go by
    role and text; equal rows stand side by side, and all but one are repeated. A conversation whose rows all have 0 copies keeps
    its row, with zeros, an empty audit and the digest of nothing. A gap that does not fit a long is null. No rows: none.

    Texts are shuffled once, at the end; what finds the edits has digests and flags only. A very long conversation is cut over tasks, but for
    the one stream that its digest needs, whose memory is its audit (a letter a row) and one text at a time.
    """
    tables = Tables(conversations.sparkSession)
    copies = F.col("copies").cast("long") if "copies" in conversations.columns else F.lit(1).cast("long")
    rows = keyed(conversations.select("conv_id", "turn", "role", "text", copies.alias("copies")))
    counted = tables.write("counted", _counted(rows))
    edits = tables.write("edits", _edits(counted, tables))
    kind = conversations.schema["conv_id"].dataType.simpleString()
    ordered = _in_order(rows, edits)
    conv_type = _arrow_type(conversations, "conv_id")
    if turns:
        result = ordered.mapInArrow(_repaired(conv_type), f"conv_id {kind}, place long, edit string, role string, text string")
    else:
        digests = ordered.mapInArrow(_digests(conv_type), f"conv_id {kind}, repaired_sha256 string")
        parts = _statistics(counted).unionByName(edits, allowMissingColumns=True).unionByName(digests, allowMissingColumns=True)
        names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
        rest = [F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256")]
        result = parts.groupBy("conv_id").agg(F.max("gaps").alias("gaps"), *(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in names[1:]), *rest)
    result = tables.write("result", result)
    tables.drop_all("result")
    return result


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with faults put in by a checksum of conversation and turn: ``copies`` is 0 where a row is dropped and 2 where it is repeated."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), code.alias("code"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("code") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, F.lit("")).when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1).alias("copies"),
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
