"""Connected components by alternating star contractions, in DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``edges`` (long columns a, b); component is the smallest node reachable.

    Rows that hold a null or join a node to itself are ignored. Each round hangs all larger neighbours of a node on
    its smallest one (large star), then hangs a node and its smaller neighbours on the smallest (small star); the
    rounds needed grow with the logarithm of the nodes. Only minima are aggregated, so a hub with very many
    neighbours is combined before the shuffle, and the joins back are joins of two shuffles which adaptive execution can split.
    Nodes without an edge are not in the result.
    """
    now = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").cast("long").alias("hi"), F.least("a", "b").cast("long").alias("lo")
    )
    now, before = materialize(now.distinct(), "components"), None
    for _ in range(max_rounds):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
        if state == before or state["n"] == 0:
            break
        before = state
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(large, least).select(F.explode(F.array(F.struct(F.col("v").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("u").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        now = materialize(small.select("e.hi", "e.lo").where("hi <> lo").distinct(), "components")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select("lo", "lo").distinct())


def _with_least(rows: DataFrame, least: DataFrame) -> DataFrame:
    """``rows`` (u, v) with ``m`` of u. The key is spelled anew, so that both sides are dealt for the join and a hub can be split."""
    spelled = F.col("u").bitwiseXOR(F.lit(1).cast("long")).alias("__k")
    return rows.select(spelled, "u", "v").join(least.select(spelled, "m"), "__k")
