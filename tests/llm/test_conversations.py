"""Repair of conversations against all possible edits of short ones, in one run and in many."""

import hashlib
import itertools
import os
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversations, registry, sql

SCHEMA = "conv_id long, turn long, role string, text string"
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def slow_faults(rows):
    """Forced deletion and truncation of each row of (role, text), with the counts."""
    seen, out, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        out.append((fault in ("blank", "duplicate"), fault == "truncated"))
    return out, counts


def slow_repair(rows):
    """(cost, audit, repaired rows): the least of all ways that cost no more than deleting everything."""
    faults, _ = slow_faults(rows)
    best = (2 * len(rows), "D" * len(rows), [])

    def walk(k, cost, audit, kept):
        nonlocal best
        if cost > best[0]:
            return
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in kept)) and (cost, audit) < best[:2]:
            best = (cost, audit, list(kept))
        for role in ("user", "assistant"):
            walk(k, cost + 5, audit + "I", [*kept, (role, "")])
        if k < len(rows):
            forced, truncated = faults[k]
            walk(k + 1, cost + 2, audit + "D", kept)
            if not forced:
                walk(k + 1, cost + 5 * truncated, audit + "K", [*kept, rows[k]])
                for role in ("user", "assistant"):
                    walk(k + 1, cost + 1 + 5 * truncated, audit + "R", [*kept, (role, rows[k][1])])

    walk(0, 0, "", [])
    return best


def slow(rows):
    """The whole result of one conversation's rows (turn, role, text)."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    plain = [(r, x) for _, r, x in rows]
    _, counts = slow_faults(plain)
    cost, audit, kept = slow_repair(plain)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for r, _ in plain]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest()


def slow_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        shown = [" " if x is None else x for x in (conv, turn, role, text)]
        code = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role = "user" if code == 4 else shown[2]
        text = "" if code == 1 else re.sub("[.!?]", "", shown[3]) if code == 2 else shown[3]
        out += [(conv, turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
ROLES = ["user", "assistant", "system", "tool", "", None, "User"]
TEXTS = ["Hello.", "Yes!", "cut off", " ", "", None, "a?\n", "no ", "\x0b\t", "Hi. ", "x" * 50 + ".", "x" * 50 + "!"]


def random_rows(seed, convs, most=5):
    rng = random.Random(seed)
    rows = []
    for c in [None, *range(convs)]:
        n = rng.randint(0, most)
        for k in range(n):
            rows.append((c, rng.choice([None, k, k, k, k + 3]), rng.choice(ROLES[:3] * 4 + ROLES), rng.choice(TEXTS[:2] * 6 + TEXTS)))
    return rows


def check(got, rows, ids):
    assert sorted(got, key=str) == sorted(ids, key=str)
    for c in ids:
        assert tuple(got[c][f] for f in FIELDS) == slow([r[1:] for r in rows if r[0] == c]), [r for r in rows if r[0] == c]


def test_paths_equal_all_edits():
    machine = conversations.Composed()
    rng = random.Random(4)
    for _ in range(400):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Yes.", f"t{k}.", f"t{k}", ""])) for k in range(rng.randint(0, 6))]
        faults, _ = slow_faults(rows)
        symbols = bytes(0 if forced else 1 + 2 * "suat".index(r[0]) + truncated for (r, _), (forced, truncated) in zip(rows, faults, strict=True))
        want = slow_repair(rows)[:2]
        assert machine.paths(symbols, *machine.end(), starts=[0])[0] == want
        cuts = sorted(rng.choices(range(len(symbols) + 1), k=rng.randint(0, 4)))
        runs = [symbols[a:b] for a, b in zip([0, *cuts], [*cuts, len(symbols)], strict=True)]
        assert machine.joined([machine.product(r) for r in runs]) == want


def test_runs_of_long_conversations_join_to_the_whole():
    machine = conversations.Composed()
    rng = random.Random(9)
    for _ in range(60):
        symbols = bytes(rng.choices(range(9), k=rng.randint(20, 200)))
        cuts = sorted(rng.sample(range(len(symbols)), 5))
        runs = [symbols[a:b] for a, b in zip([0, *cuts], [*cuts, len(symbols)], strict=True)]
        assert machine.joined([machine.product(r) for r in runs]) == machine.paths(symbols, *machine.end(), starts=[0])[0]


def test_every_short_sequence_of_roles():
    machine = conversations.Composed()
    for n in range(5):
        for roles in itertools.product(["user", "assistant", "system", "tool"], repeat=n):
            rows = [(r, f"{k}.") for k, r in enumerate(roles)]
            assert machine.paths(bytes(1 + 2 * "suat".index(r[0]) for r in roles), *machine.end(), starts=[0])[0] == slow_repair(rows)[:2]


def test_repair_of_odd_rows(spark):
    rows = random_rows(1, 150)
    got = {r["conv_id"]: r for r in conversations.repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    check(got, rows, {r[0] for r in rows})


def test_query_on_odd_rows(spark, tables):
    rows = list(dict.fromkeys(random_rows(2, 200)))
    got = registry.QUERIES["op13_conversation_repair"](spark, tables("conversations", rows, SCHEMA))
    assert [n for n, _ in got.dtypes] == ["conv_id", *FIELDS] and {t for n, t in got.dtypes if n not in ("audit", "repaired_sha256")} == {"bigint"}
    check({r["conv_id"]: r for r in got.collect()}, slow_damage(rows), {r[0] for r in rows})


def test_dropped_conversation_and_empty_table(spark, tables):
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = registry.QUERIES["op13_conversation_repair"](spark, tables("conversations", [(gone, 0, "user", "Hello.")], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert registry.QUERIES["op13_conversation_repair"](spark, tables("conversations", [], SCHEMA)).collect() == []


def test_a_conversation_over_many_tasks(spark):
    """A third of the rows in one conversation, one row repeated very often, and a very long text."""
    rng = random.Random(8)
    rows = [(7, k, rng.choice(["user", "assistant", "system"]), rng.choice([f"t{k}.", f"t{k}", "often.", ""])) for k in range(4000)]
    rows += [(7, 2000, "user", "often.")] * 1000 + [(7, 4000, "user", "long text. " * 200_000)]
    rows += [(c, k, "user" if k % 2 == 0 else "assistant", f"t{k}.") for c in range(8, 500) for k in range(4)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = spark.createDataFrame(rows, SCHEMA).repartition(6).persist()
        got = {r["conv_id"]: r for r in conversations.repair(table).collect()}
        turns = conversations.repair(table, turns=True).filter("conv_id = 7").orderBy("place").collect()
        ends = conversations._counted(conversations.keyed(table.withColumn("copies", F.lit(1)))).repartitionByRange(*conversations.ORDER).filter("conv_id = 7").select(F.spark_partition_id()).distinct().count()
        table.unpersist()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ends > 1  # else this would test nothing
    plain = [r[2:] for r in sorted((r for r in rows if r[0] == 7), key=lambda r: (r[1], r[2], r[3]))]
    faults, counts = slow_faults(plain)
    machine = conversations.Composed()
    symbols = bytes(0 if forced else 1 + 2 * "sua".index(r[0]) + truncated for (r, _), (forced, truncated) in zip(plain, faults, strict=True))
    assert (got[7]["cost"], got[7]["audit"]) == machine.paths(symbols, *machine.end(), starts=[0])[0]
    assert {f: got[7][f] for f in counts} == counts
    assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in turns))
    assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in turns).encode()).hexdigest() == got[7]["repaired_sha256"]
    assert all(got[c]["cost"] == 0 and got[c]["audit"] == "KKKK" for c in range(8, 500))


def test_extra_columns_and_kinds(spark):
    rows = [("a", 1, "user", "Hi.", 5, "k"), ("a", 2, "assistant", "Yes.", 6, "k"), (None, 1, "assistant", "No.", 7, "k")]
    table = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string, head int, key string")
    got = {r["conv_id"]: (r["cost"], r["audit"]) for r in conversations.repair(table).collect()}
    assert got == {"a": (0, "KK"), None: (2, "D")}
    turns = conversations.repair(table, turns=True).orderBy("place").collect()
    assert [tuple(r) for r in turns] == [("a", 0, "K", "user", "Hi."), ("a", 1, "K", "assistant", "Yes.")]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
def test_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from read_parquet('{SF}/conversations.parquet')")
    want = con.sql(sql.CONVERSATION_REPAIR).df().sort_values("conv_id", ignore_index=True)
    got = registry.QUERIES["op13_conversation_repair"](spark, SF).toPandas().sort_values("conv_id", ignore_index=True)
    assert got[want.columns].equals(want)
