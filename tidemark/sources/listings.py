"""Listing files of exchanges: symbols with their identifiers, in CSV files, packed or not, whose headers differ."""

from __future__ import annotations

import csv
import gzip
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Headers under which the columns are found, in any case and with spaces or underscores.
SYMBOL_NAMES = ("SYMBOL", "TCKRSYMB")
ISIN_NAMES = ("ISIN", "ISIN NUMBER", "ISINNUMBER", "ISIN CODE")
SERIES_NAMES = ("SERIES", "SCTYSRS")
#: Rows that a task gives on at once.
ROWS = 10_000


def place_of(header: list[str], names: tuple[str, ...]) -> int | None:
    """Where the first of ``names`` that a header has stands in it."""
    found = {h.strip().upper().replace("_", " "): k for k, h in reversed(list(enumerate(header)))}
    return next((found[n] for n in names if n in found), None)


def members(path: str, content: bytes) -> Iterator[tuple[str, io.TextIOBase]]:
    """The texts of a file: all members of a ZIP archive, what a gzip file holds, or the file itself."""
    name = path.rsplit("/", 1)[-1]
    if zipfile.is_zipfile(io.BytesIO(content)):
        with zipfile.ZipFile(io.BytesIO(content)) as packed:
            for member in packed.infolist():
                if not member.is_dir():
                    with packed.open(member) as f:
                        yield f"{name}/{member.filename}", io.TextIOWrapper(f, "utf-8-sig", "replace", newline="")
    elif content[:2] == b"\x1f\x8b":
        with gzip.open(io.BytesIO(content)) as f:
            yield name, io.TextIOWrapper(f, "utf-8-sig", "replace", newline="")
    else:
        yield name, io.TextIOWrapper(io.BytesIO(content), "utf-8-sig", "replace", newline="")


def listed(text: io.TextIOBase, source: str) -> Iterator[tuple[str, str, str, str]]:
    """(symbol, isin, series, source) of a CSV text, in capitals without space around; rows without a symbol or a whole ISIN are no listings."""
    lines = csv.reader(text)
    header = next(lines, [])
    symbol, isin, series = (place_of(header, n) for n in (SYMBOL_NAMES, ISIN_NAMES, SERIES_NAMES))
    if symbol is None or isin is None:
        raise ValueError(f"{source} has no symbol or no ISIN column: {header}")
    for line in lines:
        cell = lambda k: line[k].strip().upper() if k is not None and k < len(line) else ""  # noqa: E731, B023
        if cell(symbol) and len(cell(isin)) == 12:
            yield cell(symbol), cell(isin), cell(series), source


def unpacked(files: DataFrame) -> DataFrame:
    """(symbol, isin, series, source) of all rows of files, given as (path, content).

    A file is read by one task, a row at a time; listing files have some megabytes. Null content gives no rows; an empty file, or one whose
    header has no symbol or no ISIN column, is an error that names it.
    """
    names = ["symbol", "isin", "series", "source"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                held: list[tuple] = []
                for source, text in members(path.as_py() or "", content.as_py()) if content.is_valid else ():
                    for row in listed(text, source):
                        held.append(row)
                        if len(held) == ROWS:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], names)
                            held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], names)

    return files.select("path", "content").mapInArrow(run, "symbol string, isin string, series string, source string")


def best_listing(rows: DataFrame) -> DataFrame:
    """A row for each symbol: that of series EQ first, then of the smallest ISIN; a symbol of any number of rows is combined where they lie."""
    first = F.min(F.struct((F.coalesce("series", F.lit("")) != "EQ").alias("other"), "isin", "series", "source")).alias("_it")
    return rows.filter("symbol IS NOT NULL AND symbol <> '' AND length(isin) = 12").groupBy("symbol").agg(first).select("symbol", "_it.isin", "_it.series", "_it.source")


def read_listings(spark: SparkSession, *paths: str) -> DataFrame:
    """(symbol, isin, series, source), a row for each symbol, of CSV files, gzip files and ZIP archives of CSV files; a path may be a pattern."""
    return best_listing(unpacked(spark.read.format("binaryFile").load(list(paths))))
