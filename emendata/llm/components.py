"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is one aggregation (combined before its shuffle) and one join on the vertex, so no task needs a
whole component; the number of rounds grows with the logarithm of a component's width.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_back, materialise, packed


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"), F.expr("bit_xor(xxhash64(v, u, 7))").alias("y")).first()
    return row["n"], row["x"], row["y"]


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return packed(join_back(both.filter("v > u"), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v"), rows).distinct()


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = join_back(edges, least, ["u"]).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return packed(linked.union(least.select("u", F.col("m").alias("v"))).filter("u != v"), rows).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(u, v) for each vertex u of ``edges`` (columns u > v) that is not the least of its component v."""
    now = materialise(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _digest(now)
    now = packed(now, seen[0])
    for _ in range(most_rounds):
        if not seen[0]:
            return now
        large = packed(_large_star(now, seen[0]), seen[0])
        now = materialise(packed(_small_star(large, seen[0]), 2 * seen[0]))
        before, seen = seen, _digest(now)
        if before == seen:
            return now
    raise RuntimeError("the components did not settle")
