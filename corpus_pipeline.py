"""The training-text pipeline: quality rules, language, near copies, personal data, packing.

Each stage reads what its predecessor wrote; all but the last return the columns of
``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard, language, packing, private, quality
from tidemark.llm.shared import Tables, small_batches

#: The stages hold trained models, a tokeniser and keyed pseudonyms; SQL cannot express them.
ORACLE_SQL: str | None = None
#: Keys of kept documents are sent to all executors up to this number.
MOST_IDS = 2_000_000
#: The session setting that holds the key of the pseudonyms; without it the library's example key is used.
KEY = "tidemark.pseudonyms.key"


def _judged(docs: DataFrame, judge: Callable[[DataFrame, list[str], str], DataFrame], keep: str) -> DataFrame:
    """Rows of ``docs`` that ``judge`` adds a passing verdict to; columns of any name go through unharmed."""
    names = docs.columns
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))
    judged = judge(plain, plain.columns, f"c{names.index('text')}").filter(keep)
    return judged.select(*(F.col(f"c{k}").alias(name) for k, name in enumerate(names)))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what fails the base rules or the classifier.

    The classifier learns from the rows of ``docs`` that are labelled.  A null, empty or very short
    text fails the base rules; equal rows share their verdict; an empty table gives no rows; other
    columns go through, whatever their names.
    """
    small_batches(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _judged(docs, lambda plain, carry, text: quality.score(plain, model, carry, column=text), "kept")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter, and those whose language is not clear.

    The network learns from the rows of ``docs`` that have a language; without such rows nothing is
    clear.  Null and empty texts go; equal rows share their verdict; an empty table gives no rows;
    other columns go through, whatever their names.
    """
    small_batches(spark)
    model = language.train(docs)
    return _judged(docs, lambda plain, carry, text: language.predict(plain, model, carry, column=text), f"lang_pred <> '{language.UNKNOWN}' AND score >= {language.KEEP}")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that with the smallest id.

    Rows get numbers of their own, in a table, and the numbers are joined; so rows of one id with different texts, rows without an
    id (a null id counts as the largest) and rows alike in all columns are documents of their own, and none
    is taken for another. Of rows of the smallest id, the first by number stays. Rows without a word are linked to nothing, and
    all stay. An empty table gives no rows; other columns go through, whatever their names.
    """
    small_batches(spark)
    tables = Tables(spark)
    names = docs.columns
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))
    own, text = (f"c{names.index(n)}" for n in ("doc_id", "text"))
    keyed = tables.write("keyed", plain.withColumn("row_key", F.monotonically_increasing_id()))
    with tables.around():
        joined = jaccard.join(keyed.select(F.col("row_key").alias("doc_id"), F.col(text).alias("text")))
    met = joined.select(F.col("doc_id").alias("row_key"), "n_shingles", "component_id").join(keyed.select("row_key", F.col(own).alias("id")), "row_key")
    least = F.min(F.struct(F.col("id").isNull(), "id", "row_key")).alias("it")
    # A group of any size is combined where its rows lie; rows without a word are groups of one.
    chosen = met.filter("n_shingles > 0").groupBy("component_id").agg(least).select("it.row_key")
    kept = tables.write("kept", chosen.unionByName(met.filter("n_shingles = 0").select("row_key")))
    kept = F.broadcast(kept) if kept.count() <= MOST_IDS else kept
    return keyed.join(kept, "row_key").select(*plain.columns).toDF(*names)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str, key: bytes | None = None) -> DataFrame:
    """Replaces personal data in the texts, with ``key``, or that of the session, or the example key.

    A null or empty text stays as it is; n_chars, if there, follows the text; equal rows stay equal;
    an empty table gives no rows; other columns go through, whatever their names.
    """
    small_batches(spark)
    if key is None:
        found = spark.conf.get(KEY, None)
        key = found.encode() if found else private.DEFAULT_KEY
    names = docs.columns
    hidden = private.pseudonymise(docs.toDF(*(n if n == "text" else f"c{k}" for k, n in enumerate(names))), key)
    back = hidden.select(*(F.col("text" if n == "text" else f"c{k}").alias(n) for k, n in enumerate(names)))
    return back.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else back


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of all documents into sequences.

    A null or empty text is one token, the end; equal rows are documents of their own; an empty table
    gives no rows.  Of the columns only doc_id goes on.
    """
    small_batches(spark)
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("n-gram Jaccard join", near_copies),
    ("PII", pseudonyms),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        with tables.around():
            docs = tables.write(f"stage_{number}", stage(spark, docs, sf_dir))
        tables.drop_all(f"stage_{number}")  # the stage before, and all that this one has written besides
    return docs
