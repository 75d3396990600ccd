"""Connected components of a link table, as rounds of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import cut

#: Rounds grow with the logarithm of a component's length; reaching this bound is an error, never a cut.
MAX_ROUNDS = 60


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the links: component is its smallest reachable node.

    Alternates two steps until nothing changes: every node's larger neighbours are linked to its
    smallest neighbour, then its smaller ones. Each step is one aggregate and one join on the node,
    whose skewed keys adaptive execution splits; each round is checkpointed, so a lost executor costs
    one round. Self links and repeated links are harmless; null ends are dropped; no link gives no row.
    """
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    ordered = cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(MAX_ROUNDS):
        both = ordered.union(ordered.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large step: v > u hangs on the smallest of u and its neighbours
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small step: u and its smaller neighbours hang on the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        ordered = cut(small.where("u <> v").distinct())
        now = ordered.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == (now["n"], now["h"]):
            break
        state = (now["n"], now["h"])
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return ordered.select(F.col("u").alias("node"), F.col("v").alias("component")).union(ordered.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
