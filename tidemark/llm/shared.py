"""What several operators share: tables in the common folder, and columns worked out beside carried ones."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.textblock import plain


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one where none is set and all runs in one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tables-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 2000) -> SparkSession:
    """Sends fewer rows to Python at once, where the session has no setting of its own: whole texts are long.

    A query is run after it was made, so the setting stays with the session.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, rows)
    return spark


#: The folder of the run that is going on, below which its steps put theirs.
_around: ContextVar[str | None] = ContextVar("around", default=None)


class Tables:
    """Names tables of one run, and removes those that are no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{_around.get() or folder(spark)}/{uuid.uuid4().hex}"

    @contextmanager
    def around(self) -> Iterator[None]:
        """What is written inside goes below this run's folder, and so goes with it."""
        token = _around.set(self.root)
        try:
            yield
        finally:
            _around.reset(token)

    def write(self, name: str, table: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        table.write.parquet(path)
        return self.spark.read.schema(table.schema).parquet(path)

    def drop(self, name: str) -> None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)

    def drop_all(self, but: str) -> None:
        """Removes every table of the run but one."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        system = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if system.exists(path):
            for found in system.listStatus(path):
                if found.getPath().getName() != but:
                    system.delete(found.getPath(), True)


def beside(docs: DataFrame, carry: list[str], column: str, added: dict[str, str], work: Callable[[pa.Array], Iterator[tuple[int, int, list[pa.Array]]]]) -> DataFrame:
    """The ``carry`` columns with ``added`` ones that ``work`` makes of the texts in ``column``, in Arrow batches.

    ``work`` gets a string array without nulls and gives (first row, last row + 1, arrays) of parts
    in order.  Columns go by their places, so no name in ``docs`` can clash with what is used
    here; a carried column with the name of an added one is left out for it.
    """
    carry = [c for c in dict.fromkeys(carry) if c not in added]
    fields = [f"`{c.replace('`', '``')}` {docs.schema[c].dataType.simpleString()}" for c in carry]
    own = column in carry  # then it need not be sent twice
    at = carry.index(column) if own else len(carry)
    names = [*carry, *added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, arrays in work(plain(batch.column(at))):
                kept = [batch.column(k).slice(begin, end - begin) for k in range(len(carry))]
                yield pa.RecordBatch.from_arrays([*kept, *arrays], names)

    quoted = [F.col(f"`{c.replace('`', '``')}`") for c in ([*carry] if own else [*carry, column])]
    placed = docs.select(*(q.alias(f"c{k}") for k, q in enumerate(quoted)))
    return placed.mapInArrow(run, ", ".join([*fields, *(f"{n} {kind}" for n, kind in added.items())]))


#: Rows of one key that a task gets in ``join_hot``, as expected at most.
HEAVY = 100_000


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], how: str = "inner") -> DataFrame:
    """Joins a table with any number of rows a key to one with a row a key.

    A key with more than ``HEAVY`` rows is dealt by a hash of the ``spread`` columns, and its one
    row on the right repeated as often.  There are fewer such keys than rows of ``left`` over
    ``HEAVY``, so they are sent to all executors.
    """
    heavy = left.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > HEAVY)
    heavy = F.broadcast(heavy.select(*keys, F.ceil(F.col("_n") / HEAVY).cast("int").alias("_parts")))
    dealt = left.join(heavy, keys, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*spread), "_parts"), F.lit(0)).cast("int")).drop("_parts")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    repeated = right.join(heavy, keys, "left").withColumn("_salt", every).drop("_parts")
    return dealt.join(repeated, [*keys, "_salt"], how).drop("_salt")
