"""Connected components of a graph too large for one machine: alternating large-star and small-star steps.

Each step sends every node's neighbours to the smallest one among them, by a partial aggregate and an equi-join, so that
a node with very many neighbours is neither collected nor the key of a window; the number of steps grows with the
logarithm of the longest path. Each step's edges are a written table, so the lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folialis.sources.storage import written


def _fingerprint(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).head()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of edges (a, b); the component is its smallest id. Loops, repeats and either order are fine."""
    e = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    state = _fingerprint(e)
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours above u are tied to the smallest
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        # small star: neighbours below and b itself are tied to the smallest
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b").union(least.select(F.col("m").alias("a"), "b"))
        e = written(small.distinct(), "edges")
        new = _fingerprint(e)
        if new == state:
            break
        state = new
    return e.select(F.col("b").alias("id"), F.col("a").alias("component")).union(e.select("a", "a").distinct())
