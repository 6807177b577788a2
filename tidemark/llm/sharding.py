"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``CELLS`` cells.  Every shard has ``vnodes`` virtual nodes on it, and a row
belongs to the first virtual node at or after its cell.  Each shard takes at most its
capacity (row counts that differ by one at most, all places together as many as rows); the
rows past that continue clockwise, and each virtual node offers them an equal part of its
shard's free places.  Only per-cell counts, a table of fixed size, are needed to decide
which ranks of a cell go where.  Rows alike are counted where they lie, and a row a group is shuffled by its cell.

Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

CELLS = 1 << 16


def ring(spark: SparkSession, shards: int, vnodes: int) -> DataFrame:
    """One row per cell: the shard that owns it, and the virtual nodes that stand in it (usually none)."""
    nodes = (
        spark.range(shards * vnodes)
        .select((F.col("id") % shards).cast("int").alias("node_shard"), F.floor(F.col("id") / shards).cast("int").alias("vnode"))
        .withColumn("cell", F.pmod(F.xxhash64(F.lit("virtual node"), "node_shard", "vnode"), F.lit(CELLS)).cast("int"))
    )
    placed = nodes.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("node_shard", "vnode"))).alias("nodes"))
    cells = spark.range(CELLS).select(F.col("id").cast("int").alias("cell")).join(placed, "cell", "left")
    ahead = W.orderBy(F.desc("cell")).rowsBetween(W.unboundedPreceding, 0)
    whole = W.orderBy("cell").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first = F.col("nodes")[0]["node_shard"]
    # Past the last virtual node the ring goes on at the first one.
    return cells.select("cell", "nodes", F.coalesce(F.last(first, True).over(ahead), F.first(first, True).over(whole)).alias("shard"))


def plan(counts: DataFrame, shards: int, vnodes: int) -> DataFrame:
    """Where each rank of each cell goes, as pieces (cell, from_rank, n, shard, slot).

    ``counts`` has (cell, n_rows).  All tables here have at most CELLS + shards * vnodes rows.
    """
    spark = counts.sparkSession
    cells = ring(spark, shards, vnodes).join(counts, "cell", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)).cast("long"))
    total = F.sum("n_rows").over(W.partitionBy())
    own = W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    room = F.floor(F.col("total") / shards) + F.when(F.col("shard") < F.col("total") % shards, 1).otherwise(0)
    cells = (
        cells.withColumn("total", total)
        .withColumn("before", F.coalesce(F.sum("n_rows").over(own), F.lit(0)))
        .withColumn("capacity", room)
        .withColumn("kept", F.greatest(F.lit(0), F.least("n_rows", F.col("capacity") - F.col("before"))))
        .withColumn("over", F.col("n_rows") - F.col("kept"))
    )
    loads = cells.groupBy("shard").agg(F.sum("kept").alias("home"), F.first("capacity").alias("capacity"))
    # A shard none of whose cells is on the ring (its nodes are covered by others) still has places.
    every = spark.range(shards).select(F.col("id").cast("int").alias("shard")).join(loads, "shard", "left").crossJoin(counts.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("total")))
    every = every.select("shard", F.coalesce("home", F.lit(0)).alias("home"), room.alias("capacity")).withColumn("spare", F.col("capacity") - F.col("home"))
    part = F.floor(F.col("spare") / vnodes)
    offers = (
        cells.filter("nodes IS NOT NULL")
        .select("cell", F.explode("nodes").alias("node"))
        .select("cell", F.col("node.node_shard").alias("shard"), F.col("node.vnode").alias("vnode"))
        .join(F.broadcast(every), "shard")  # one row per shard
        .withColumn("extra", F.col("spare") % vnodes)
        .select(
            "cell",
            "shard",
            "vnode",
            (part + F.when(F.col("vnode") < F.col("extra"), 1).otherwise(0)).alias("offer"),
            (F.col("home") + part * F.col("vnode") + F.least("vnode", "extra")).alias("slot"),
        )
        .filter("offer > 0")
    )
    # Rows that move on and free places, along the ring; a cell's rows come before the places in it.
    events = (
        cells.filter("over > 0")
        .select("cell", F.lit(0).alias("kind"), F.lit(None).cast("int").alias("shard"), F.lit(-1).alias("vnode"), F.col("over").alias("n"), F.col("kept").alias("at"))
        .unionByName(offers.select("cell", F.lit(1).alias("kind"), "shard", "vnode", F.col("offer").alias("n"), F.col("slot").alias("at")))
    )
    along = W.orderBy("cell", "kind", "shard", "vnode").rowsBetween(W.unboundedPreceding, 0)
    events = events.withColumn("net", F.sum(F.when(F.col("kind") == 0, F.col("n")).otherwise(-F.col("n"))).over(along))
    # Start where the waiting rows are fewest: from there on no place comes before the row that takes it.
    lowest = F.min(F.struct("net", "cell", "kind", "shard", "vnode")).over(W.partitionBy())
    here = F.struct("cell", "kind", F.coalesce("shard", F.lit(-1)), "vnode")
    start = F.struct("low.cell", "low.kind", F.coalesce("low.shard", F.lit(-1)), "low.vnode")
    events = events.withColumn("low", lowest).withColumn("lap", F.when(here > start, 0).otherwise(1))
    turn = W.partitionBy("kind").orderBy("lap", "cell", "shard", "vnode").rowsBetween(W.unboundedPreceding, -1)
    events = events.withColumn("first", F.coalesce(F.sum("n").over(turn), F.lit(0)))
    # The k-th waiting row takes the k-th place: cut both sequences at all their starts.
    marks = events.groupBy("first").agg(
        F.max(F.when(F.col("kind") == 0, F.struct("first", "cell", "at", "n"))).alias("rows"),
        F.max(F.when(F.col("kind") == 1, F.struct("first", "shard", "at", "n"))).alias("places"),
    )
    so_far = W.orderBy("first").rowsBetween(W.unboundedPreceding, 0)
    moved = (
        marks.withColumn("rows", F.last("rows", True).over(so_far))
        .withColumn("places", F.last("places", True).over(so_far))
        .withColumn("end", F.least(F.lead("first").over(W.orderBy("first")), F.col("rows.first") + F.col("rows.n"), F.col("places.first") + F.col("places.n")))
        .select(
            F.col("rows.cell").alias("cell"),
            (F.col("rows.at") + F.col("first") - F.col("rows.first")).alias("from_rank"),
            (F.col("end") - F.col("first")).alias("n"),
            F.col("places.shard").alias("shard"),
            (F.col("places.at") + F.col("first") - F.col("places.first")).alias("slot"),
        )
    )
    stay = cells.filter("kept > 0").select("cell", F.lit(0).cast("long").alias("from_rank"), F.col("kept").alias("n"), "shard", F.col("before").alias("slot"))
    return stay.unionByName(moved)


#: Rows of one group that a task writes out, at most.
CHUNK = 100_000


def assign(groups: DataFrame, order: list[str | Column], shards: int = 40, vnodes: int = 64) -> DataFrame:
    """Adds shard and slot to groups of rows alike, which have ``cell`` and a number of rows ``copies``; gives one row for each of them.

    Within a cell groups rank by ``order``. A group takes consecutive ranks, so its rows need no order of their own: they are
    cut where a shard ends, and written out in chunks that are dealt to all tasks.
    """
    pieces = plan(groups.groupBy("cell").agg(F.sum("copies").alias("n_rows")), shards, vnodes)
    before = W.partitionBy("cell").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    ranked = groups.withColumn("rank", F.coalesce(F.sum("copies").over(before), F.lit(0)))
    # At most CELLS + 2 * shards * vnodes pieces, whatever the data.
    pieces = F.broadcast(pieces.select(F.col("cell").alias("piece_cell"), "from_rank", "n", "shard", F.col("slot").alias("piece_slot")))
    where = (F.col("cell") == F.col("piece_cell")) & (F.col("rank") < F.col("from_rank") + F.col("n")) & (F.col("rank") + F.col("copies") > F.col("from_rank"))
    met = ranked.join(pieces, where).withColumns({"low": F.greatest("rank", "from_rank"), "high": F.least(F.col("rank") + F.col("copies"), F.col("from_rank") + F.col("n"))})
    met = met.withColumn("first_slot", F.col("piece_slot") + F.col("low") - F.col("from_rank")).withColumn("many", F.col("high") - F.col("low"))
    met = met.drop("piece_cell", "from_rank", "n", "piece_slot", "rank", "cell", "low", "high", "copies")
    each = lambda df: df.withColumn("slot", F.explode(F.sequence("first_slot", F.col("first_slot") + F.col("many") - 1))).drop("first_slot", "many")
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1, F.lit(CHUNK).cast("long")))
    large = met.filter(F.col("many") > CHUNK).withColumn("chunk", chunk).withColumns({"first_slot": F.col("first_slot") + F.col("chunk"), "many": F.least(F.col("many") - F.col("chunk"), F.lit(CHUNK).cast("long"))}).drop("chunk")
    return each(met.filter(F.col("many") <= CHUNK)).unionByName(each(large.repartition("shard", "first_slot")))


def shard(docs: DataFrame, shards: int = 40, vnodes: int = 64) -> DataFrame:
    """Puts every row into one of ``shards`` shards under the law ``rows``: counts at most one apart.

    Returns doc_id, size (UTF-8 bytes of the text plus 16), text_crc32, law, shard, slot and
    grown_shard (null under this law).  A null text has no bytes and checksum 0.  A row's place
    on the ring follows from its id and its text's checksum and size, so many rows of one id, or without
    one, still spread; rows alike in all three give equal results but for their slots, so they are counted where they lie and
    given consecutive places.  An empty table gives no rows.  Only doc_id and text are read, whatever other columns there
    are; a very long text is read where it lies and not shuffled.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    groups = keyed.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    groups = groups.withColumn("place", F.xxhash64("doc_id", "text_crc32", "size")).withColumn("cell", F.pmod("place", F.lit(CELLS)).cast("int"))
    placed = assign(groups, ["place", "doc_id", "text_crc32", "size"], shards, vnodes)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
