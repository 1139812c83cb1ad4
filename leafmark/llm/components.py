"""Connected components of an edge table, by alternating stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leafmark.llm.common import staged

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that is reachable, for every node with an edge.

    Each round hangs every node's larger neighbours below its smallest one, then every node and
    its smaller neighbours below the smallest of those. Depths shrink like logarithms; rounds
    end when the edges no longer change. Rounds are written tables, so a lost executor costs one.
    """
    ends = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    current, mark = staged(ends, "edges"), None
    for _ in range(MAX_ROUNDS):
        both = current.unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        hung = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = hung.groupBy("u").agg(F.min("v").alias("m"))
        below = hung.join(least, "u").select("u", "v", "m")
        following = below.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(below.select("u", F.col("m").alias("v")))
        current = staged(following.filter("u <> v").distinct(), "edges")
        now = current.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == mark:
            return current.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionAll(
                current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        mark = now
    raise RuntimeError(f"components are not found after {MAX_ROUNDS} rounds")
