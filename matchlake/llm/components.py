"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.scratch import Scratch


def _large_star(edges: DataFrame, scratch: Scratch, rows: int) -> DataFrame:
    """Each node links its larger neighbours to the smallest of itself and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "cc-least", rows=2 * rows)
    up = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    return up.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, scratch: Scratch, rows: int) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of these."""
    least = scratch.save(edges.groupBy("a").agg(F.min("b").alias("m")), "cc-least", rows=rows)
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """``(node, component)`` for every node of ``edges (a, b)``; a component is named by its smallest node.

    Self-links, repeated links and either direction are allowed; an empty input gives an empty result. Every
    round is written to the scratch folder; no step makes more links than it is given, which bounds its tasks. Both steps pre-aggregate the minimum before the shuffle and write it,
    so that the join that follows is a plain equi-join of two shuffles, whose hot keys can be split at run time.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = scratch.save(edges, f"{name}-0")
    step, before, rows = 0, None, edges.count()
    while True:
        step += 1
        large = scratch.save(_large_star(edges, scratch, rows).distinct(), f"{name}-large", rows=rows)
        edges = scratch.save(_small_star(large, scratch, rows).distinct(), f"{name}-{step}", rows=rows)
        scratch.drop(f"{name}-{step - 1}")
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
