"""A panel kept by months, of which a commit rewrites some; readers see the panel before it or after it, never between."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.panel import universe_hash, upsert_tail


def month_of(ts: str | Column = "ts") -> Column:
    return (F.year(ts) * 100 + F.month(ts)).cast("int")


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _child(spark: SparkSession, path: str):  # noqa: ANN202
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def manifests(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the commits, in order."""
    folder, system = _files(spark, f"{path}/manifests")
    if not system.exists(folder):
        return []
    names = [f.getPath().getName() for f in system.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, path: str, number: int | None = None) -> dict | None:
    """What the last commit, or an earlier one, says of the panel; None where there is none."""
    known = manifests(spark, path)
    if not known:
        return None
    return json.loads(spark.read.text(f"{path}/manifests/{known[-1] if number is None else number:08d}.json", wholetext=True).first()[0])


def read(spark: SparkSession, path: str, since: date | None = None, until: date | None = None, number: int | None = None) -> DataFrame:
    """The panel of a commit, the last unless said; of the months between two dates only these folders are opened."""
    found = manifest(spark, path, number)
    if found is None:
        raise ValueError(f"{path} has no commit")
    schema = spark.createDataFrame([], found["schema"]).schema
    low, high = ((d.year * 100 + d.month) if d else edge for d, edge in ((since, 0), (until, 999_999)))
    folders = [f"{path}/data/version={m['version']}/month={k}" for k, m in found["months"].items() if low <= int(k) <= high]
    df = spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
    if since:
        df = df.filter(F.col("ts") >= F.lit(since))
    return df.filter(F.col("ts") <= F.lit(until)) if until else df


def write_months(df: DataFrame, path: str) -> str:
    """Writes rows by month into a folder of their own, which no reader knows of yet; gives its name."""
    version = uuid.uuid4().hex
    # A month's rows are dealt to some tasks by symbol, so that no month is one task's.
    month = month_of()
    df.withColumn("month", month).repartition("month", F.pmod(F.xxhash64("symbol"), F.lit(16))).write.partitionBy("month").parquet(f"{path}/data/version={version}")
    return version


def _describe(spark: SparkSession, path: str, base: dict | None, touched: list[int] | None, version: str, columns: str) -> dict:
    written = spark.read.schema(f"{columns}, month int").parquet(f"{path}/data/version={version}")
    new = {str(r["month"]): {"version": version, "rows": r["rows"], "first": str(r["first"]), "last": str(r["last"])} for r in written.groupBy("month").agg(F.count("*").alias("rows"), F.min("ts").alias("first"), F.max("ts").alias("last")).collect()}  # a row per month
    kept = {k: m for k, m in base["months"].items() if int(k) not in touched} if base and touched is not None else {}
    months = dict(sorted((kept | new).items()))
    return {
        "months": months,
        "schema": columns,
        "rows": sum(m["rows"] for m in months.values()),
        "first_session": min((m["first"] for m in months.values()), default=None),
        "last_session": max((m["last"] for m in months.values()), default=None),
        "built_at": datetime.now(UTC).isoformat(),
    }


def publish(spark: SparkSession, path: str, record: dict, after: int) -> int:
    """Puts a manifest in place by renaming it, the one step that readers notice; refuses if another commit came in since ``after``."""
    number = after + 1
    target, system = _files(spark, f"{path}/manifests/{number:08d}.json")
    if system.exists(target):
        raise RuntimeError(f"{path} has a commit {number} of another writer")
    draft = _child(spark, f"{path}/manifests/.{uuid.uuid4().hex}")
    out = system.create(draft)
    out.write(bytearray(json.dumps(record | {"number": number}, sort_keys=True).encode()))
    out.close()
    if not system.rename(draft, target):
        raise RuntimeError(f"commit {number} of {path} could not be put in place")
    return number


def commit_all(df: DataFrame, path: str) -> int:
    """Commits a whole panel (symbol, ts, any other columns) in place of what was there; gives the commit's number, from 1."""
    spark = df.sparkSession
    after = max(manifests(spark, path), default=0)
    version = write_months(df, path)
    columns = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema)
    return publish(spark, path, _describe(spark, path, None, None, version, columns) | _universe(df), after)


def _universe(df: DataFrame) -> dict:
    names = df.select("symbol").distinct()
    return {"symbols": names.count(), "universe_hash": universe_hash(names).first()[0]}


def commit_tail(new: DataFrame, path: str, calendar: DataFrame, rebuild: int) -> int:
    """Commits the last ``rebuild`` sessions of the calendar from ``new``, and takes out symbols that it does not have.

    Only months with such sessions, and months in which a symbol goes, are written; the others keep their folders. Killed at any point before the
    manifest is in place, it leaves the panel as it was, and a folder that ``vacuum`` removes. ``new`` may hold earlier rows, which are not
    taken; it must have the columns of the panel, in any order.
    """
    spark = new.sparkSession
    base = manifest(spark, path)
    if base is None:
        return commit_all(new, path)
    old = read(spark, path)
    new = new.select(*(F.col(f"`{c}`").cast(old.schema[c].dataType).alias(c) for c in old.columns))
    first = calendar.select("ts").distinct().orderBy(F.desc("ts")).limit(rebuild).agg(F.min("ts")).first()[0]
    if first is None:
        return base["number"]
    tail = [int(k) for k in base["months"] if int(k) >= first.year * 100 + first.month]
    gone = old.join(new.select("symbol").distinct(), "symbol", "left_anti").select(month_of().alias("month")).distinct()
    touched = sorted({*tail, *(r["month"] for r in gone.collect())})  # months
    mine = old.filter(month_of().isin(touched)) if touched else old.limit(0)
    version = write_months(upsert_tail(mine, new, calendar.select("ts").distinct(), rebuild).select(*old.columns), path)
    return publish(spark, path, _describe(spark, path, base, touched, version, base["schema"]) | _universe(new), base["number"])


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Removes manifests but the last ``keep``, and folders that none of these names; gives how many folders went. No commit may be going on."""
    known = manifests(spark, path)
    used = {m["version"] for n in known[-keep:] for m in manifest(spark, path, n)["months"].values()}
    for n in known[:-keep]:
        found, system = _files(spark, f"{path}/manifests/{n:08d}.json")
        system.delete(found, False)
    folder, system = _files(spark, f"{path}/data")
    gone = [f.getPath() for f in system.listStatus(folder) if f.getPath().getName().removeprefix("version=") not in used]
    for p in gone:
        system.delete(p, True)
    return len(gone)
