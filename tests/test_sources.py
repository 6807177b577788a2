"""Packed listing files, and a panel whose commits are whole or not there."""

import datetime
import gzip
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.operators import panel
from tidemark.sources import bars, listings, store


def test_listings_of_all_kinds_of_files(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.csv", "﻿SYMBOL, isin_number ,Series\n abc ,INE000000001,BE\nabc,INE000000009,EQ\n\nshort\nbad,INE1,EQ\n,INE000000002,EQ\n")
        z.writestr("sub/two.csv", 'TckrSymb,ISIN\r\n"de,f",inf00000000a\r\nABC,INE000000000\r\n')
    (tmp_path / "b.csv.gz").write_bytes(gzip.compress(b"ISIN,SCTYSRS,SYMBOL\nINE000000003,EQ,GHI\n"))
    (tmp_path / "c.csv").write_text("ISINNUMBER,SYMBOL\nINE000000007,GHI\nINE000000004,JKL\nINE000000003,JKL\n")
    got = {r["symbol"]: (r["isin"], r["series"], r["source"]) for r in listings.read_listings(spark, str(tmp_path)).collect()}
    assert got == {
        "ABC": ("INE000000009", "EQ", "a.zip/one.csv"),
        "DE,F": ("INF00000000A", "", "a.zip/sub/two.csv"),
        "GHI": ("INE000000003", "EQ", "b.csv.gz"),
        "JKL": ("INE000000003", "", "c.csv"),
    }


def test_listing_without_its_columns_is_named(spark, tmp_path):
    for content in (b"A,B\n1,2\n", b""):
        files = spark.createDataFrame([("x/bad.csv", content)], "path string, content binary")
        with pytest.raises(Exception, match="bad.csv has no symbol"):
            listings.unpacked(files).collect()
    none = spark.createDataFrame([(None, None)], "path string, content binary")
    assert listings.unpacked(none).count() == 0 and listings.best_listing(listings.unpacked(none)).count() == 0


def test_classes_say_where_they_come_from(spark):
    isin = spark.createDataFrame([("AETF", "INE000000001"), ("B", "INF000000001")], "symbol string, isin string")
    got = {r["symbol"]: (r["is_fund"], r["source"]) for r in panel.classify(spark.createDataFrame([("AETF",), ("B",), ("CETF",), ("D",), ("E",)], "symbol string"), isin, ["d"]).collect()}
    assert got == {"AETF": (False, "isin"), "B": (True, "isin"), "CETF": (True, "name"), "D": (True, "user_list"), "E": (False, "name")}


def days(n):
    return [datetime.date(2021, 1, 4) + datetime.timedelta(days=7 * k) for k in range(n)]


def rows(n, symbols="ABC", factor=1.0):
    return [(s, d, factor * (k + 1)) for s in symbols for k, d in enumerate(days(n))]


PANEL = "symbol string, ts date, `a b` double"


def content(df):
    return sorted(map(tuple, df.collect()))


def test_commit_of_a_tail_equals_a_rebuild(spark, tmp_path):
    path = str(tmp_path / "panel")
    wrong = [(s, d, v * 2 if d > days(30)[20] else v) for s, d, v in rows(26)]
    assert store.commit_all(spark.createDataFrame(wrong, PANEL), path) == 1
    new = spark.createDataFrame(rows(30, factor=1.0), PANEL)
    before = store.manifest(spark, path)
    assert store.commit_tail(new, path, new.select("ts"), 10) == 2
    after = store.manifest(spark, path)
    assert content(store.read(spark, path)) == sorted(rows(30))
    assert content(store.read(spark, path, number=1)) == sorted(wrong)
    # Months before the tail keep their folders.
    first = days(30)[20]
    for k, m in before["months"].items():
        assert (after["months"][k]["version"] == m["version"]) == (int(k) < first.year * 100 + first.month)
    assert (after["rows"], after["symbols"], after["first_session"], after["last_session"]) == (90, 3, str(days(30)[0]), str(days(30)[-1]))
    assert content(store.read(spark, path, days(30)[9], days(30)[12])) == sorted(r for r in rows(30) if days(30)[9] <= r[1] <= days(30)[12])


def test_symbols_that_go_are_taken_out_of_all_months(spark, tmp_path):
    path = str(tmp_path / "panel")
    short = [("Z", days(30)[2], 7.0)]
    store.commit_all(spark.createDataFrame(rows(30) + short, PANEL), path)
    before = store.manifest(spark, path)
    new = spark.createDataFrame([(v, s, d) for s, d, v in rows(30)], "`a b` double, symbol string, ts date")
    store.commit_tail(new, path, new.select("ts"), 2)
    after = store.manifest(spark, path)
    assert content(store.read(spark, path)) == sorted(rows(30))
    assert [k for k in before["months"] if after["months"][k] != before["months"][k]] == ["202101", "202107"]
    assert before["universe_hash"] != after["universe_hash"]


def test_a_killed_commit_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "panel")
    store.commit_all(spark.createDataFrame(rows(10), PANEL), path)
    new = spark.createDataFrame(rows(12, factor=3.0), PANEL)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(store, "publish", killed)
        with pytest.raises(KeyboardInterrupt):
            store.commit_tail(new, path, new.select("ts"), 5)
    assert content(store.read(spark, path)) == sorted(rows(10)) and store.manifests(spark, path) == [1]
    assert store.vacuum(spark, path) == 1
    assert store.commit_tail(new, path, new.select("ts"), 12) == 2
    assert content(store.read(spark, path)) == sorted(rows(12, factor=3.0))
    assert store.vacuum(spark, path, keep=1) == 1
    assert content(store.read(spark, path)) == sorted(rows(12, factor=3.0))


def test_a_second_writer_is_refused(spark, tmp_path):
    path = str(tmp_path / "panel")
    df = spark.createDataFrame(rows(3), PANEL)
    store.commit_all(df, path)
    record = store.manifest(spark, path)
    store.commit_all(df.withColumn("a b", F.lit(0.0)), path)
    with pytest.raises(RuntimeError, match="another writer"):
        store.publish(spark, path, record, 1)
    assert {r[2] for r in store.read(spark, path).collect()} == {0.0}


def test_empty_panels_and_no_panel(spark, tmp_path):
    path = str(tmp_path / "panel")
    with pytest.raises(ValueError, match="no commit"):
        store.read(spark, path)
    empty = spark.createDataFrame([], PANEL)
    assert store.commit_all(empty, path) == 1 and store.read(spark, path).count() == 0
    assert store.commit_tail(empty, path, empty.select("ts"), 5) == 1
    full = spark.createDataFrame(rows(2), PANEL)
    assert store.commit_tail(full, path, full.select("ts"), 5) == 2 and store.read(spark, path).count() == 6


ITEMS = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp"


def item(order, part, line, quantity, price, day, supplier=1, discount=0.0):
    return order, part, supplier, line, quantity, price, discount, 0.0, day and datetime.datetime.fromisoformat(day)


def test_bars_of_odd_line_items(spark, tables):
    """One order on several days, weeks and brands, unknown orders, days and brands, equal orders down to the discount, hours, no quantity."""
    rows = [item(k % 7 if k % 11 else None, k % 5, k % 3, float(k % 4), 100.0 + k * 37 % 101, f"2024-01-{1 + k * 5 % 23:02d} {k % 2 * 9:02d}:00:00" if k % 13 else None, k % 2, k % 3 / 10) for k in range(400)]
    rows += [item(-1, 1, 1, 1.0, 5000.0, "2024-01-08"), item(None, 1, 1, 1.0, 6000.0, "2024-01-08"), item(3, 9, 1, 1.0, 1.0, "2024-01-09"), item(900, 0, 2, 2.0, 7.0, "2024-03-04")]
    sf_dir = tables("lineitem", rows, ITEMS)
    tables("part", [(0, "A"), (1, "B"), (2, "A"), (3, None), (4, "C")], "p_partkey long, p_brand string")
    got = {(r["symbol"], r["ts"]): (r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in bars.trade_bars(spark, sf_dir).collect()}
    brands, groups = {0: "A", 1: "B", 2: "A", 3: None, 4: "C"}, {}
    for o, part, supplier, line, q, price, discount, tax, day in rows:
        if part in brands:
            week = day and day.date() - datetime.timedelta(day.weekday())
            key = [(x is not None, x or 0) if not isinstance(x, datetime.datetime) else (True, x) for x in (day, o)] + [line, part, supplier, price, q, discount, tax]
            groups.setdefault((brands[part], week), []).append((key, price / q if q else None, q))
    want = {}
    for k, found in groups.items():
        found.sort(key=lambda x: x[0])
        known = [p for _, p, _ in found if p is not None]
        want[k] = (found[0][1], max(known, default=None), min(known, default=None), found[-1][1], sum(q for *_, q in found))
    assert len(got) == len(want) > 15 and got == want


def test_bars_do_not_sort_all_line_items(spark, tables):
    sf_dir = tables("lineitem", [item(1, 1, 1, 1.0, 2.0, "2024-01-08")], ITEMS)
    tables("part", [(1, "B")], "p_partkey long, p_brand string")
    plan = bars.trade_bars(spark, sf_dir)._jdf.queryExecution().executedPlan().toString().splitlines()
    place = lambda line: re.search(r"[A-Z]", line).start()
    scans = [k for k, line in enumerate(plan) if "FileScan" in line and "l_orderkey" in line]
    assert scans
    for k in scans:
        above, at = [], place(plan[k])
        for line in reversed(plan[:k]):
            if re.search(r"[A-Z]", line) and place(line) < at:
                above.append(line)
                at = place(line)
        first = next(x for x in above if "Aggregate" in x or "Sort" in x or "BroadcastHashJoin [coalesce(l_orderkey" in x)
        assert "Sort" not in first


def test_bars_of_more_parts_than_are_sent(spark, tables):
    """As on large tables, where the line items are shuffled to their parts: the same bars, and still numbers alone in a hash aggregate."""
    rows = [item(k % 7, k % 5, k % 3, float(k % 4), 100.0 + k * 37 % 101, f"2024-01-{1 + k * 5 % 23:02d}") for k in range(200)]
    sf_dir = tables("lineitem", rows, ITEMS)
    tables("part", [(k, "ABABC"[k]) for k in range(5)], "p_partkey long, p_brand string")
    want = sorted(bars.trade_bars(spark, sf_dir).collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = bars.trade_bars(spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        got = sorted(df.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Join [l_partkey" in plan and "BroadcastHashJoin [l_partkey" not in plan
    assert re.findall(r"(\w+Aggregate)\(keys=\[symbol#\d+, l_shipdate#", plan) == ["HashAggregate", "HashAggregate"]
    assert got == want and len(got) > 5


def test_unknown_orders_meet_only_bars_of_their_week(spark, tables):
    """Where every bar starts with an unknown order, a trade without one is compared with its week's bars, not with those of all weeks."""
    days = [f"2024-{1 + k % 12:02d}-{1 + k % 28:02d}" for k in range(84)]
    sf_dir = tables("lineitem", [item(None if k % 3 else k, k % 2, k % 4, 1.0 + k % 5, 10.0 + k * 7 % 31, day) for k, day in enumerate(days)], ITEMS)
    tables("part", [(0, "A"), (1, "B")], "p_partkey long, p_brand string")
    df = bars.trade_bars(spark, sf_dir)
    plan = df._jdf.queryExecution().optimizedPlan()
    join = next(line for line in plan.toString().splitlines() if "Join" in line and "coalesce(l_orderkey" in line)
    left = re.search(r"coalesce\(l_orderkey#\d+L, (.*?)\) = ", join)[1]
    assert "unix_date(" in left and "l_shipdate" in left
    assert df.count() == len({(k % 2, datetime.date.fromisoformat(day).isocalendar()[:2]) for k, day in enumerate(days)})
