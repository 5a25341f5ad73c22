"""Counts by category, tag, collection and state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folialis.functions.text import fold_ascii
from folialis.operators.library import live


def facet(dims: DataFrame, counted: DataFrame, key: str) -> DataFrame:
    """(id, name, paper_count) of every dimension row, 0 if nothing has it. counted: one row for each use, with the key.

    The uses are counted before the join, so a key that a tenth of the rows share is no hot key of the join.
    """
    n = counted.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"))
    return dims.join(n, dims["id"] == n["k"], "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("paper_count")).orderBy(fold_ascii("name"), "id")


def category_facet(categories: DataFrame, papers: DataFrame) -> DataFrame:
    """Live papers of each category."""
    return facet(categories, live(papers), "category_id")


def link_facet(dims: DataFrame, links: DataFrame, key: str, papers: DataFrame | None = None) -> DataFrame:
    """Papers of each tag or collection: also those in the trash, or only live ones if papers are given."""
    pairs = links.dropDuplicates(["paper_id", key])
    if papers is not None:
        pairs = pairs.join(live(papers).select(F.col("id").alias("paper_id")), "paper_id", "left_semi")
    return facet(dims, pairs, key)


def stats(papers: DataFrame, categories: DataFrame, tags: DataFrame, collections: DataFrame | None = None) -> DataFrame:
    """One row: total, read, unread, starred, share of read, and how many categories, tags and collections there are."""
    one = live(papers).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "read").alias("n_read"), F.count_if("starred").alias("n_starred"))
    for name, dims in (("n_categories", categories), ("n_tags", tags), ("n_collections", collections)):
        # one row each, so this joins single rows
        one = one.withColumn(name, F.lit(0).cast("long")) if dims is None else one.join(dims.agg(F.count("*").alias(name)))
    percent = F.when(F.col("total") == 0, 0).otherwise(F.round(F.col("n_read") * 100 / F.col("total"))).cast("long")
    return one.withColumns({"n_unread": F.col("total") - F.col("n_read"), "read_percent": percent})


def annotation_counts(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("paper_id").agg(F.count("*").alias("n"))


def newest_by_link(papers: DataFrame, links: DataFrame, key: str, most: int = 100) -> DataFrame:
    """(key, papers): the newest live papers, as many as a list shows, by tag or collection, in the list's order."""
    newest = live(papers).orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(most).select("id", "created_at")
    pairs = links.dropDuplicates(["paper_id", key]).join(newest, links["paper_id"] == newest["id"])
    # at most ``most`` rows in a group
    ordered = F.array_sort(F.collect_list(F.struct(F.col("created_at"), F.col("id"))))
    return pairs.groupBy(key).agg(F.transform(F.reverse(ordered), lambda s: s["id"]).alias("papers"))


def name_taken(dims: DataFrame, name: str, besides: int | None = None) -> DataFrame:
    """One row: whether another row has the name."""
    same = dims.where(F.col("name") == name)
    if besides is not None:
        same = same.where(F.col("id") != besides)
    return same.agg((F.count("*") > 0).alias("taken"))
