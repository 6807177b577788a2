"""Assertion queries over a panel and its results, ledgers and file manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.operators.selection import drawn

CHECK = "check string, failed long, seen long"


def same(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """Equal up to a tolerance; two unknowns are equal, one is not."""
    return (a.isNull() & b.isNull()) | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))


def checks(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per rule: how many rows break it; a rule that is NULL counts as broken.  One pass over the data."""
    bad = df.agg(F.count("*").alias("_n"), *(F.sum((~F.coalesce(rule, F.lit(False))).cast("long")).alias(name) for name, rule in rules.items()))
    return bad.unpivot(["_n"], list(rules), "check", "failed").select("check", F.coalesce("failed", F.lit(0)).alias("failed"), F.col("_n").alias("seen"))


def unique_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def label_rules() -> dict[str, Column]:
    """What holds for labels on every row: ranges, order of excursions, and the identity of the two entries."""
    c = F.col
    known = lambda x, rule: c(x).isNull() | rule
    identity = F.abs((1 + c("label_fwd_ret")) - (1 + c("label_gap1")) * (1 + c("label_oc_5"))) <= 1e-9 * (1 + c("label_fwd_ret"))
    return {
        "mae_not_above_mfe": known("label_mfe", c("label_mae") <= c("label_mfe")),
        "return_within_excursions": known("label_fwd_ret", (c("label_fwd_ret") <= c("label_mfe") + 1e-12) & (c("label_fwd_ret") >= c("label_mae") - 1e-12)),
        "buyable_is_flag": known("label_buyable_o1", c("label_buyable_o1").isin(0.0, 1.0)),
        "entries_agree": c("label_fwd_ret").isNull() | c("label_oc_5").isNull() | identity,
    }


def compare(old: DataFrame, new: DataFrame, keys: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """One row: shared keys, keys of one side only, and values that differ."""
    a = old.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_in_a"))
    b = new.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_in_b"))
    met = a.join(b, keys, "full")
    both = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    case = lambda x: F.sum(F.when(x, 1).otherwise(0))
    return met.agg(case(both).alias("shared"), case(F.col("_in_b").isNull()).alias("only_old"), case(F.col("_in_a").isNull()).alias("only_new"), case(both & ~same(F.col("_a"), F.col("_b"), tolerance)).alias("differ"))


def rederived(picks: DataFrame, truth: DataFrame, keys: list[str], least: float = 0.995, tolerance: float = 1e-6) -> DataFrame:
    """One row: share of picks whose outcome is found again in ``truth``, and whether that is enough."""
    met = picks.select(*keys, F.col("outcome").alias("_a")).join(truth.select(*keys, F.col("outcome").alias("_b")), keys, "left")
    share = F.avg(same(F.col("_a"), F.col("_b"), tolerance).cast("double"))
    return met.agg(F.count("*").alias("picks"), share.alias("share")).withColumn("ok", F.coalesce(F.col("share") >= least, F.lit(False)))


def global_outcome(bars: DataFrame, horizon: int) -> DataFrame:
    """(symbol, ts, outcome) with entry and exit on exact later sessions of all symbols, not on the symbol's next bars.

    ``bars`` has session_idx.
    """
    entry = bars.select("symbol", (F.col("session_idx") - 1).alias("session_idx"), F.col("open").alias("_in"))
    last = bars.select("symbol", (F.col("session_idx") - horizon).alias("session_idx"), F.col("close").alias("_out"))
    met = bars.select("symbol", "ts", "session_idx").join(entry, ["symbol", "session_idx"], "left").join(last, ["symbol", "session_idx"], "left")
    return met.select("symbol", "ts", (F.try_divide(F.col("_out"), F.when(F.col("_in") > 0, F.col("_in"))) - 1).alias("outcome"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of the files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def verify(frozen: DataFrame, present: DataFrame) -> DataFrame:
    """(path, status) of files that are missing, new or changed."""
    met = frozen.select("path", F.col("sha256").alias("_a")).join(present.select("path", F.col("sha256").alias("_b")), "path", "full")
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "new").when(F.col("_a") != F.col("_b"), "changed")
    return met.select("path", status.alias("status")).filter("status IS NOT NULL")


def source_findings(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """(path, pattern, found) of the places where source files match a pattern."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("pattern"), F.regexp_extract_all("value", F.lit(v), F.lit(0)).alias("found")) for k, v in patterns.items())))
    return files.select("path", rows.alias("r")).select("path", "r.pattern", F.explode("r.found").alias("found"))


def ledger_append(spark: SparkSession, path: str, record: dict) -> int:
    """Appends one record as a JSON line and returns how many there are; many writers may append at once."""
    import json
    from datetime import datetime, timezone

    line = json.dumps({"at": datetime.now(timezone.utc).isoformat(), **record}, sort_keys=True)
    spark.range(1).select(F.lit(line).alias("value")).write.mode("append").text(path)
    return spark.read.text(path).count()


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """(at, kind, run_id, record): the entries in the order of time, the rest of each as text."""
    raw = spark.read.text(path)
    field = lambda k: F.get_json_object("value", f"$.{k}")
    return raw.select(field("at").alias("at"), field("kind").alias("kind"), field("run_id").alias("run_id"), F.col("value").alias("record")).orderBy("at")


def next_run_id(entries: DataFrame, prefix: str, day: str) -> str:
    """PREFIX_YYYYMMDD_NNN, the next one free."""
    last = entries.filter(F.col("run_id").startswith(f"{prefix}_{day}_")).agg(F.max(F.substring_index("run_id", "_", -1).cast("int"))).first()[0]
    return f"{prefix}_{day}_{(last or 0) + 1:03d}"


class Refused(ValueError):
    """A precondition does not hold."""


def is_forward(name: str, known: tuple[str, ...] = ()) -> bool:
    """Whether a column looks ahead: a label, or one of the ``known`` ones."""
    return name.startswith("label_") or name in known


def refuse_forward(columns: list[str], known: tuple[str, ...] = ()) -> None:
    bad = sorted(c for c in columns if is_forward(c, known))
    if bad:
        raise Refused(f"columns that look ahead among the features: {bad}")


def join_one_to_one(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of tables that each have a key once; refuses others, and so keeps the left side's rows as they are."""
    for name, side in (("left", a), ("right", b)):
        worst = unique_keys(side, keys).limit(1).collect()
        if worst:
            raise Refused(f"the {name} side has {worst[0].asDict()}")
    return a.join(b, keys, "left")


def recomputed_labels(bars: DataFrame, horizons: tuple[int, ...] = (1, 2, 3, 5)) -> DataFrame:
    """(symbol, ts, re_oc_h, re_gap1): the labels again, by joins on the number of the bar and not by windows that look ahead."""
    numbered = bars.select("symbol", "ts", "open", "close", F.row_number().over(W.partitionBy("symbol").orderBy("ts")).alias("_k"))
    out = numbered
    at = lambda k, c, name: numbered.select("symbol", (F.col("_k") - k).alias("_k"), F.col(c).alias(name))
    out = out.join(at(1, "open", "_in"), ["symbol", "_k"], "left")
    paid = F.when(F.col("_in") > 0, F.col("_in"))
    for h in horizons:
        out = out.join(at(h, "close", f"_out_{h}"), ["symbol", "_k"], "left")
    sold = {f"re_oc_{h}": F.try_divide(F.when(F.col(f"_out_{h}") > 0, F.col(f"_out_{h}")), paid) - 1 for h in horizons}
    return out.select("symbol", "ts", *(c.alias(n) for n, c in sold.items()), (F.try_divide(paid, F.when(F.col("close") > 0, F.col("close"))) - 1).alias("re_gap1"))


def label_audit(panel: DataFrame, bars: DataFrame, horizons: tuple[int, ...] = (1, 2, 3, 5), tolerance: float = 1e-9) -> DataFrame:
    """(check, failed, seen): consistency of the labels and their independent recomputation, on every row."""
    met = panel.join(recomputed_labels(bars, horizons), ["symbol", "ts"], "left")
    again = {f"recomputed_oc_{h}": same(F.col(f"label_oc_{h}"), F.col(f"re_oc_{h}"), tolerance) for h in horizons} | {"recomputed_gap1": same(F.col("label_gap1"), F.col("re_gap1"), tolerance)}
    return checks(met, label_rules() | again)


def exclusions(panel: DataFrame, by: Column, name: str) -> DataFrame:
    """Per value: rows, and how many cannot be bought, are not known to be buyable, or have no outcome."""
    b, y = F.col("label_buyable_o1"), F.col("label_oc_5")
    n = lambda c: F.sum(c.cast("long"))
    return panel.groupBy(by.alias(name)).agg(F.count("*").alias("rows"), n(F.coalesce(b == 0, F.lit(False))).alias("unbuyable"), n(b.isNull()).alias("unknown"), n(y.isNull()).alias("without_outcome"))


def market_terciles(panel: DataFrame, value: str) -> DataFrame:
    """(ts, tercile): the third, from 0, that a date's mean falls into among all dates."""
    day = panel.groupBy("ts").agg(F.avg(value).alias("_m")).filter("_m IS NOT NULL")
    return day.select("ts", (F.ntile(3).over(W.orderBy("_m", "ts")) - 1).alias("tercile"))  # a row per session


def panel_verdict(old: DataFrame, new: DataFrame, keys: list[str], value: str, skip: int = 20, most: float = 0.01, tolerance: float = 1e-9) -> DataFrame:
    """One row: shared rows of two panels before the last ``skip`` sessions, how many differ, and the verdict (same, warn, fail)."""
    last = new.select("ts").distinct().orderBy(F.desc("ts")).limit(skip).agg(F.min("ts").alias("_cut"))  # one row
    met = old.select(*keys, F.col(value).alias("_a")).join(new.select(*keys, F.col(value).alias("_b")), keys).crossJoin(F.broadcast(last)).filter(F.col("ts") < F.col("_cut"))
    out = met.agg(F.count("*").alias("shared"), F.coalesce(F.sum((~same(F.col("_a"), F.col("_b"), tolerance)).cast("long")), F.lit(0)).alias("differ"))
    share = F.coalesce(F.try_divide("differ", "shared"), F.lit(0.0))
    return out.withColumn("verdict", F.when(share > most, "fail").when(F.col("differ") > 0, "warn").otherwise("same"))


def check_order(entries: DataFrame, run: str, needs: dict[str, str], built_at: str | None = None, sha: str | None = None, reason: str | None = None) -> None:
    """Refuses a run out of order: ``needs`` names, for each kind, the kind that must have passed before it.

    ``entries`` is ``ledger``.  The last needed entry must have passed, not be older than the build, and
    carry the same hash of the settings; a run that is on record already needs a reason.
    """
    field = lambda k: F.get_json_object("record", f"$.{k}").alias(k)
    known = entries.select("at", "kind", "run_id", field("passed"), field("manifest_sha"))
    if run in needs:
        last = known.filter(F.col("kind") == needs[run]).orderBy(F.desc("at")).first()
        if last is None:
            raise Refused(f"{needs[run]} is not on record")
        if last["passed"] != "true":
            raise Refused(f"the latest {needs[run]} did not pass")
        if built_at is not None and last["at"] < built_at:
            raise Refused(f"the panel was built after its latest {needs[run]}")
        if sha is not None and last["manifest_sha"] != sha:
            raise Refused(f"the settings changed after the latest {needs[run]}")
    before = known.filter(F.col("kind") == run).orderBy(F.desc("at")).first()
    if before is not None and not reason:
        raise Refused(f"{run} is on record as {before['run_id']}; another run needs a reason")


def reproduced_ranking(scored: DataFrame, daily: DataFrame, sizes: tuple[int, ...] = (1, 3, 5, 10), tolerance: float = 1e-9) -> DataFrame:
    """(check, failed, seen): the daily table's gross returns and missing counts, again from the scores, by counting better rows and not by a row number."""
    known = scored.filter("score IS NOT NULL").select("ts", "symbol", "score", "outcome")
    # An array per date of its names in order; dates hold the names of one day.
    best = known.groupBy("ts").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "symbol", "outcome"))).alias("_o"))
    first = lambda n: F.transform(F.slice("_o", 1, n), lambda x: x["outcome"])
    total = lambda n: F.aggregate(F.filter(first(n), lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x)
    seen = lambda n: F.size(F.filter(first(n), lambda x: x.isNotNull()))
    again = best.select("ts", *(F.try_divide(total(n), seen(n)).alias(f"_g{n}") for n in sizes), *((F.least(F.size("_o"), F.lit(n)) - seen(n)).alias(f"_m{n}") for n in sizes))
    rules = {f"top{n}_gross": same(F.col(f"top{n}_gross"), F.col(f"_g{n}"), tolerance) for n in sizes} | {f"top{n}_missing": F.col(f"top{n}_missing") == F.col(f"_m{n}") for n in sizes}
    return checks(daily.join(again, "ts", "full"), rules)


def pick_eligibility(picks: DataFrame, panel: DataFrame) -> DataFrame:
    """One row: picks, and how many are not in the panel or not known to be buyable."""
    met = picks.select("symbol", "ts").join(panel.select("symbol", "ts", F.col("label_buyable_o1").alias("_b"), F.lit(1).alias("_in")), ["symbol", "ts"], "left")
    return met.agg(F.count("*").alias("picks"), F.sum(F.col("_in").isNull().cast("long")).alias("not_in_panel"), F.sum((F.col("_in").isNotNull() & ~F.coalesce(F.col("_b") == 1, F.lit(False))).cast("long")).alias("unbuyable"))


def missing_outcomes(daily: DataFrame, n: int = 3) -> DataFrame:
    """One row: how many of the first n have no outcome, and what the mean comes to if these are trades without a return."""
    gross, lost = F.col(f"top{n}_gross"), F.col(f"top{n}_missing")
    out = daily.agg(F.count("*").alias("days"), F.sum(lost).cast("long").alias("missing_slots"), F.avg(gross).alias("headline"), F.avg(gross * (n - lost) / n).alias("with_zero_returns"))
    return out.withColumn("impact_bp", (F.col("headline") - F.col("with_zero_returns")) * 1e4)


def fold_rules(folds: DataFrame, calendar: DataFrame, horizon: int) -> DataFrame:
    """(fold, gap, ok): sessions between training and test, which must be more than the horizon, in the right order."""
    at = lambda c: calendar.select(F.col("ts").alias(c), F.col("session_idx").alias(f"_{c}"))
    met = folds.join(F.broadcast(at("train_end")), "train_end", "left").join(F.broadcast(at("test_start")), "test_start", "left")
    gap = F.col("_test_start") - F.col("_train_end")
    return met.select("fold", gap.alias("gap"), F.coalesce((F.col("train_end") < F.col("test_start")) & (gap > horizon), F.lit(False)).alias("ok"))


def winsor_cuts(panel: DataFrame, target: str, folds: DataFrame, share: float = 0.01) -> DataFrame:
    """(fold, rows, low, high): cut points of the outcome less its date's mean, over the buyable training rows of each fold."""
    known = panel.filter((F.col("label_buyable_o1") == 1) & F.col(target).isNotNull()).select("ts", F.col(target).alias("_y"))
    less = known.withColumn("_y", F.col("_y") - F.avg("_y").over(W.partitionBy("ts")))
    inside = less.join(F.broadcast(folds.select("fold", "train_end")), F.col("ts") <= F.col("train_end"))  # a handful of folds
    cuts = F.percentile("_y", F.array(F.lit(share), F.lit(1 - share)))
    return inside.groupBy("fold").agg(F.count("*").alias("rows"), cuts.alias("_c")).select("fold", "rows", F.get("_c", 0).alias("low"), F.get("_c", 1).alias("high"))


def sample_table(bars: DataFrame, horizon: int, n: int = 25) -> DataFrame:
    """A fixed draw of rows with prices, outcome and the arithmetic in words; the same rows on every run and partitioning."""
    order = W.partitionBy("symbol").orderBy("ts")
    df = bars.withColumns({"entry": F.lead("open").over(order), "exit": F.lead("close", horizon).over(order)}).filter("entry > 0 AND exit IS NOT NULL")
    formula = F.format_string("%.8f / %.8f - 1", F.col("exit"), F.col("entry"))
    return drawn(df, ["symbol", "ts"], n, 7).select("symbol", "ts", "entry", "exit", (F.col("exit") / F.col("entry") - 1).alias("outcome"), formula.alias("formula"))
