"""Result files: tables in text formats, settings with their hash, and the latest run on record."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str, **options: object) -> DataFrame:
    """A CSV table with a header; dates are parsed by the schema, and bad cells become NULL."""
    return spark.read.options(header=True, mode="PERMISSIVE", **options).schema(schema).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """A folder of CSV files with headers; it is written in parallel."""
    df.write.mode(mode).option("header", True).csv(path)


def panel_labels(spark: SparkSession, path: str, columns: list[str], entry: str = "", where: Column | None = None) -> DataFrame:
    """Columns of a panel under their plain names, read from those of an entry mode (``label_fwd_ret`` + ``entry``), filtered at the scan.

    The filter speaks of the plain names; Spark pushes it to the file under the physical ones.
    """
    there = set(spark.read.parquet(path).columns)
    at = {c: f"{c}{entry}" if c.startswith("label_") and f"{c}{entry}" in there else c for c in columns}
    df = spark.read.parquet(path).select(*(F.col(p).alias(c) for c, p in at.items()))
    return df if where is None else df.filter(where)


def with_external(panel: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of a second table beside the panel's, by symbol and date, never by the place of a row."""
    return panel.join(other.select("symbol", "ts", *columns), ["symbol", "ts"], "left")


def schema_difference(a: list[str], b: list[str]) -> dict[str, list[str]]:
    """Names that only one of two lists has."""
    return {"only_a": sorted(set(a) - set(b)), "only_b": sorted(set(b) - set(a))}


def _whole(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]  # a settings file


def settings(spark: SparkSession, path: str, expected: dict | None = None) -> tuple[dict, str]:
    """A JSON object and the first 16 hexadecimal digits of its text's SHA-256; refuses one whose ``config`` is not as expected."""
    text = _whole(spark, path)
    found = json.loads(text)
    if expected is not None:
        as_json = json.loads(json.dumps(expected))
        have = found.get("config", {})
        differ = sorted(k for k in as_json.keys() | have.keys() if as_json.get(k) != have.get(k))
        if differ:
            raise ValueError(f"settings differ from {path} on {differ}")
    return found, hashlib.sha256(text.encode()).hexdigest()[:16]


def write_json(spark: SparkSession, path: str, record: dict) -> None:
    """One JSON object as a one-line text file."""
    spark.createDataFrame([(json.dumps(record, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def latest_run(entries: DataFrame, kind: str) -> str | None:
    """The run on record last, of a kind; None where there is none."""
    return entries.filter(F.col("kind") == kind).agg(F.max_by("run_id", F.struct("at", "run_id"))).first()[0]
