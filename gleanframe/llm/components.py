"""Connected components of an edge table, by alternating large and small stars.

Every step is joins and combinable minima, so a node with very many edges is split like any
other skewed join key, and only two numbers per step reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanframe.llm.tables import kept


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every node of ``edges (a, b)``; a component is its least id."""
    pair = [F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")]
    stars = kept(edges.where("a <> b").select(*pair).distinct())
    before = _state(stars)
    while before[0]:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        stars = kept(moved.unionByName(lower.select("a", F.col("m").alias("b"))).distinct())
        after = _state(stars)
        if after == before:
            break
        before = after
    roots = stars.select(F.col("b").alias("id")).distinct()
    return stars.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        roots.select("id", F.col("id").alias("component"))
    )
