"""The citation graph: library papers and the works that they cite, under caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: References taken from a paper, and works outside the library that are shown.
REFS_PER_PAPER, MOST_EXTERNAL = 15, 150


def edges(refs: DataFrame, own: DataFrame | None = None, per_paper: int = REFS_PER_PAPER, most: int | None = MOST_EXTERNAL) -> DataFrame:
    """(source, target) of distinct references (paper_id, pos, ref): of each paper the first ``per_paper`` by position, in all the first
    ``most`` works (None: all), first come by paper and position. own (paper_id, ref): a paper's own number, which it does not cite.

    Works come first by the least (paper, place) at which they are cited: a partial aggregate and a top-k, no global sort.
    """
    taken = refs.withColumn("n", F.row_number().over(Window.partitionBy("paper_id").orderBy("pos", "ref"))).where(F.col("n") <= per_paper)
    if own is not None:
        taken = taken.join(own, ["paper_id", "ref"], "left_anti")
    kept = taken
    if most is not None:
        first = taken.groupBy("ref").agg(F.min(F.struct("paper_id", "n")).alias("at")).orderBy("at", "ref").limit(most).select("ref")
        kept = taken.join(F.broadcast(first) if most <= 10_000 else first, "ref", "left_semi")
    return kept.select(F.concat(F.lit("lib-"), "paper_id").alias("source"), F.concat(F.lit("ext-"), "ref").alias("target")).distinct()


def cached(cache: DataFrame, found: DataFrame, now: str) -> DataFrame:
    """The cache (doi, refs, fetched_at) after a fetch: what was found (doi, refs) now replaces a DOI's entry, other entries stay, also old ones. Blank DOIs are not kept."""
    new = found.where(F.trim("doi") != "").groupBy("doi").agg(F.min("refs").alias("refs")).withColumn("fetched_at", F.lit(now).cast(cache.schema["fetched_at"].dataType))
    return cache.join(new, "doi", "left_anti").select("doi", "refs", "fetched_at").unionByName(new)


def cited(papers: DataFrame, cache: DataFrame) -> DataFrame:
    """(paper_id, pos, ref) of the papers (id, doi) whose references are known: edges() and, by their ids, nodes() take them."""
    return papers.join(cache.where("doi <> ''").select("doi", "refs"), "doi").select(F.col("id").alias("paper_id"), F.posexplode("refs").alias("pos", "ref"))


def nodes(papers: DataFrame, links: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(id, title, year, venue, doi, in_library): papers (those whose references are known, as the caller gives them) and the targets of the links; titles: (ref, title)."""
    lib = papers.select(F.concat(F.lit("lib-"), "id").alias("id"), "title", "year", "venue", "doi", F.lit(True).alias("in_library"))
    ext = links.select(F.col("target").alias("id")).distinct()
    named = ext.withColumn("title", F.lit("")) if titles is None else ext.join(titles.select(F.concat(F.lit("ext-"), "ref").alias("id"), "title"), "id", "left").withColumn("title", F.coalesce("title", F.lit("")))
    outside = named.select("id", "title", F.lit(0).alias("year"), F.lit("").alias("venue"), F.lit("").alias("doi"), F.lit(False).alias("in_library"))
    return lib.union(outside)


def fresh(cache: DataFrame, now: str, days: int = 7) -> DataFrame:
    """The entries of a cache (doi, refs, fetched_at) that are not older than some days; each entry has its own time."""
    return cache.where((F.col("doi") != "") & (F.col("fetched_at") >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))))
