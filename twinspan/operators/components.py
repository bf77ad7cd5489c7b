"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspan.session import cut


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``node, component`` (smallest node of its component) of all linked nodes.

    Rounds halve distances, so their number grows with the logarithm of the
    longest path. A hub costs its degree: minima are partial aggregates and
    each round keeps at most as many edges as before. Edges with a null end
    and loops do not count.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    state, mark = cut(links), None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u is linked to u's smallest neighbour
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: every smaller neighbour and u itself are linked to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        state = cut(small)
        before, mark = mark, state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = state.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
