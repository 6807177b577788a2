"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length: a bucket holds lengths within a factor of 2 ** (1 / 16), split into
parts of bounded size.  A query first gets the k-th best score among the longest vectors of the
whole table; that score, over the query's own length, is the least length that can still
matter, so the query asks only the buckets from there on.  The queries that ask a bucket are split
into parts too, and every (part of vectors, part of queries) of a bucket is one task's work.

In a cell the k-th best score becomes a local cosine threshold for each run of vectors of similar
length: a run whose longest vector cannot reach it is skipped; with a low threshold it is pruned
by length (a prefix of it, as it is sorted), with a high one by coordinates (the feasible range
of the query's largest coordinate).  What is left is verified by exact products.  A cell gives at
most k rows per query, which are merged in two steps.

Driver and broadcasts hold the longest ``SEED`` vectors and a row per length bucket, whose number
follows the range of lengths, not the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.llm.shared import Tables

#: Vectors in a run of a cell; longest vectors that give the first thresholds.
BUCKET = 2048
SEED = 2048
#: Vectors and queries in a cell, as expected at most, for up to ``WIDTH`` components; fewer in proportion for more. As many of both send the
#: fewest rows for the work of a cell: a vector goes to one cell for each ``QUERIES`` queries, a query to one for each ``VECTORS`` vectors.
VECTORS, QUERIES, WIDTH = 65_536, 65_536, 64
#: Length buckets in a doubling of length, and the bucket of length 0.
STEPS, ZERO = 16, -1
#: Tasks that the cells of a width are dealt to at most.
MOST_TASKS = 20_000
#: Parts of the first step of merging.
MERGE = 16
#: Local cosine threshold from which coordinates prune better than lengths.
COORDINATE_FROM = 0.5
#: Products of integers up to this bound are exact in floating point for any usual dimension.
_EXACT = 2.0**53


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, ints, norm): components times ``scale``, rounded down; rows with a null or non-finite part are left out."""
    c = F.col("embedding")
    ok = c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ints = F.transform(c, lambda x: F.floor(x.cast("double") * scale))
    return vectors.filter(ok & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), ints.alias("ints")).withColumn("norm", F.sqrt(F.aggregate("ints", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of exactly ``width`` components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(-1, width)


def _fits(values: DataFrame) -> str:
    """The narrowest type that holds all components; they are sent in it, 16 bits each as a rule."""
    low, high = values.agg(F.min(F.array_min("ints")), F.max(F.array_max("ints"))).first()
    return next((kind for kind, bits in (("smallint", 15), ("int", 31)) if low is None or -(1 << bits) <= low and high < 1 << bits), "bigint")


def _largest(a: np.ndarray) -> float:
    return max(float(a.max()), -float(a.min())) if a.size else 0.0


def _small(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether inner products of rows of both are exact in floating point, whatever the order of adding up."""
    return _largest(a) * _largest(b) * a.shape[-1] < _EXACT


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of a with the row b, exact."""
    if not _small(a, b):
        exact = a.astype(object) @ b.astype(object)
        if max(map(abs, exact)) >= 1 << 63:
            raise OverflowError("a score does not fit into 64 bits")
        return exact.astype(np.int64)
    return (a.astype(float) @ b.astype(float)).astype(np.int64)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to the smaller id."""
    if len(score) > 4 * k:
        floor = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= floor)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def first_floor(ids: np.ndarray, ints: np.ndarray, own: int, query: np.ndarray, k: int) -> float:
    """The k-th best score among some vectors, without the query's own; no bound if there are fewer."""
    score = _products(ints, query)[ids != own]
    return float(np.partition(score, len(score) - k)[len(score) - k]) if len(score) >= k else -np.inf


def search(ids: np.ndarray, ints: np.ndarray, asked: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of what a cell's vectors may add to each query's best k."""
    floor = floor.copy()  # rises as the search goes on
    small = _small(ints, queries)
    norm, size = (np.sqrt((x.astype(float) ** 2).sum(1)) for x in (ints, queries))
    order = np.argsort(-norm, kind="stable")
    ids, ints, norm = ids[order], ints[order], norm[order]
    real = ints.astype(float)  # turned once for all queries
    unit = real / np.maximum(norm, 1e-300)[:, None]
    kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for begin in range(0, len(ids), BUCKET):
        at = slice(begin, begin + BUCKET)
        longest = norm[begin]
        # Rounded outwards, so that no candidate is lost to floating point.
        reach = size * longest * (1 + 1e-9) + 1e-6
        for q in np.flatnonzero(reach >= floor):
            least = floor[q]
            pick: np.ndarray | slice = at
            local = least / (size[q] * longest) if size[q] * longest > 0 and np.isfinite(least) else -1.0
            if local > COORDINATE_FROM:
                # Only the part of a unit vector along the query's largest coordinate is looked at.
                f = int(np.abs(queries[q]).argmax())
                x = queries[q, f] / size[q]
                t = min(local, 1.0)
                swing = np.sqrt(max(0.0, (1 - t * t) * (1 - x * x)))
                low = t * x - swing if x > -t else -1.0
                high = t * x + swing if x < t else 1.0
                u = unit[at, f]
                pick = begin + np.flatnonzero((u >= low - 1e-9) & (u <= high + 1e-9))
            elif local > 0:
                # Lengths fall along the run: a prefix can reach the threshold.
                enough = int(np.searchsorted(-norm[at], -(least / size[q]) * (1 - 1e-9) + 1e-9, "right"))
                pick = slice(begin, begin + enough)
            score = (real[pick] @ queries[q].astype(float)).astype(np.int64) if small else _products(ints[pick], queries[q])
            found = ids[pick]
            use = (score >= least) & (found != asked[q])
            if not use.any():
                continue
            score, found = score[use], found[use]
            if q in kept:
                score, found = np.concatenate([kept[q][1], score]), np.concatenate([kept[q][0], found])
            top = _best(score, found, k)
            kept[q] = (found[top], score[top])
            if len(top) == k:
                floor[q] = max(least, score[top[-1]])
    for q, (found, score) in kept.items():
        yield q, found, score


def _bucket(length: Column) -> Column:
    return F.when(length > 0, F.floor(F.log2(length) * STEPS)).otherwise(ZERO).cast("int")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """The k best inner products of each query with all rows but those of its own vec_id.

    Both tables have vec_id and embedding; other columns are not read.  Returns query_id, rank,
    vec_id, score.  Vectors that are null, or hold a null or non-finite component, take no part;
    vectors are compared with queries of the same dimension only.  A vec_id that occurs in several
    query rows gives one answer per row; equal vectors under several ids each count, ties go to the
    smaller id.  Without vectors or queries there are no rows.
    """
    spark = vectors.sparkSession
    tables = Tables(spark)
    base = tables.write("base", integers(vectors, scale).withColumns({"width": F.size("ints"), "row": F.monotonically_increasing_id()}))
    mine = tables.write("queries", integers(queries, scale).withColumns({"width": F.size("ints"), "number": F.monotonically_increasing_id()}))
    widths = sorted(r[0] for r in mine.select("width").distinct().collect())  # dimensions, a handful
    out = spark.createDataFrame([], "number long, query_id long, rank int, vec_id long, score long")
    for width in widths:
        out = out.unionByName(_of_width(base.filter(F.col("width") == width), mine.filter(F.col("width") == width), width, k, tables))
    result = tables.write("result", out.drop("number"))
    tables.drop_all("result")
    return result


def _of_width(base: DataFrame, mine: DataFrame, width: int, k: int, tables: Tables) -> DataFrame:
    spark = base.sparkSession
    kind = _fits(base.select("ints").unionByName(mine.select("ints")))
    most, asked_most = (max(1, x * WIDTH // max(width, WIDTH)) for x in (VECTORS, QUERIES))
    base, mine = (x.withColumn("ints", F.col("ints").cast(f"array<{kind}>")) for x in (base, mine))
    longest = base.orderBy(F.desc("norm"), "vec_id").limit(SEED).select("vec_id", "ints").toArrow()
    sent = spark.sparkContext.broadcast((np.asarray(longest["vec_id"], np.int64), _matrix(longest["ints"], width)))

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ints = sent.value
        for batch in batches:
            own, asked = np.asarray(batch.column(1), np.int64), _matrix(batch.column(2), width)
            floor = [first_floor(ids, ints, a, q, k) for a, q in zip(own, asked, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(4)), pa.array(floor, pa.float64())], ["number", "query_id", "ints", "norm", "floor"])

    asked = mine.select("number", F.col("vec_id").alias("query_id"), "ints", "norm").mapInArrow(seeded, f"number long, query_id long, ints array<{kind}>, norm double, floor double")
    # Queries without a positive threshold ask every bucket; rounding is outwards by a bucket.
    need = F.when((F.col("floor") > 0) & (F.col("norm") > 0), _bucket(F.col("floor") / F.col("norm")) - 1).otherwise(ZERO)
    asked = tables.write(f"asked_{width}", asked.withColumn("need", F.greatest(need, F.lit(ZERO))))

    # A row per length bucket: lengths are finite doubles, so there are at most some tens of thousands, and usually dozens.
    own = base.withColumn("bucket", _bucket(F.col("norm")))
    lengths = own.groupBy("bucket").count().collect()
    wants = asked.groupBy("need").count().collect()
    parts = {r["bucket"]: -(-r["count"] // most) for r in lengths}
    # A bucket's cells are shared by all queries that ask it, whatever the least length that each of them needs.
    sides = {b: -(-sum(r["count"] for r in wants if r["need"] <= b) // asked_most) for b in parts}
    if not any(sides.values()):
        return spark.createDataFrame([], "number long, query_id long, rank int, vec_id long, score long")
    split = spark.createDataFrame([(b, parts[b], sides[b]) for b in parts if sides[b]], "bucket int, parts int, sides int")
    asks = [(r["need"], b, parts[b], sides[b]) for r in wants for b in parts if r["need"] <= b]
    asked_of = spark.createDataFrame(asks, "need int, bucket int, parts int, sides int")
    # Vectors go once to each part of the queries that ask their bucket, and queries once to each part of its vectors.
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    left = own.join(F.broadcast(split), "bucket").withColumn("part", dealt("row", "parts")).select("bucket", "part", every("sides").alias("side"), "vec_id", "ints")
    right = asked.join(F.broadcast(asked_of), "need").withColumn("side", dealt("number", "sides")).select("bucket", every("parts").alias("part"), "side", "number", "query_id", "ints", "floor")

    def cell(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        number, found, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if vectors.num_rows and queries.num_rows:
            ids, asks = np.asarray(vectors["vec_id"], np.int64), np.asarray(queries["query_id"], np.int64)
            for q, i, s in search(ids, _matrix(vectors["ints"], width), asks, _matrix(queries["ints"], width), np.asarray(queries["floor"], float), k):
                number.append(np.full(len(i), q))
                found.append(i)
                score.append(s)
        rows = queries.select(["number", "query_id"]).take(pa.array(np.concatenate(number)))
        return rows.append_column("vec_id", pa.array(np.concatenate(found))).append_column("score", pa.array(np.concatenate(score)))

    cells = ["bucket", "part", "side"]
    # A cell's work does not follow its bytes, so cells are not put together by these: a task for each, as far as hashes allow.
    tasks = min(MOST_TASKS, sum(parts[b] * sides[b] for b in parts))
    left, right = left.repartition(tasks, *cells), right.repartition(tasks, *cells)
    near = left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInArrow(cell, "number long, query_id long, vec_id long, score long")
    near = near.withColumn("turn", F.pmod(F.xxhash64("vec_id", "score"), F.lit(MERGE)))
    for keys in (["number", "turn"], ["number"]):
        rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
        near = near.withColumn("rank", rank).filter(F.col("rank") <= k)
    return near.select("number", "query_id", "rank", "vec_id", "score")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS ints FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.ints, v.ints), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v AS q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
