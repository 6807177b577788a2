"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import HEAVY, Tables, join_hot


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())


def components(edges: DataFrame, tables: Tables, name: str) -> DataFrame:
    """(node, label) for all nodes of the edges (u, v); label is the smallest node of the component.

    Each step joins the edges with one minimum per node (which combines where the rows lie); a
    node with very many edges is dealt to several tasks.
    """
    now = tables.write(f"{name}_0", edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now)
    step = 0
    while state[0]:
        # With fewer edges no node has enough of them to be dealt.
        meet = join_hot if 2 * state[0] > HEAVY else (lambda left, right, keys, spread: left.join(right, keys))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = meet(both.filter("v > u"), least, ["u"], ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = meet(large, low, ["u"], ["v"])
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        step += 1
        after = tables.write(f"{name}_{step}", small)
        tables.drop(f"{name}_{step - 1}")
        new = _state(after)
        now, same, state = after, new == state, new
        if same:
            break
    # Now every edge goes from a node to the smallest of its component.
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
