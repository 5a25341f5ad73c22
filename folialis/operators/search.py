"""Recall by tokens, and the material of an answer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folialis.functions import text as T
from folialis.operators.library import live


def recall(papers: DataFrame, question: str, most: int = 3) -> DataFrame:
    """Live papers that hold any token of the question, the latest year first; at most 10 (3 for any other number)."""
    conditions = [c for t in T.tokens_of(question) if (c := T.matches(t)) is not None]
    if not conditions:
        return papers.where(F.lit(False))
    k = most if 1 <= most <= 10 else 3
    found = live(papers).where(reduce(lambda a, b: a | b, conditions))
    # the limit comes before the wide text is joined
    ids = found.select("id", "year").orderBy(F.col("year").desc(), F.col("id").desc()).limit(k).select("id")
    return papers.join(F.broadcast(ids), "id", "left_semi").orderBy(F.col("year").desc(), F.col("id").desc())


def newest(papers: DataFrame, most: int = 3) -> DataFrame:
    """The newest live papers, the newest first."""
    order = (F.col("created_at").desc(), F.col("id").desc())
    ids = live(papers).select("id", "created_at").orderBy(*order).limit(most).select("id")
    return papers.join(F.broadcast(ids), "id", "left_semi").orderBy(*order)


#: How many windows of how many characters make an excerpt, how it begins without one, and how much of it and of a summary is kept.
WINDOWS, WINDOW, BEGINNING, EXCERPT, QUOTED, SUMMARY = 3, 500, 800, 1800, 1000, 800


def sources(papers: DataFrame, question: str, most: int = 3) -> DataFrame:
    """(rank, id, title, excerpt, block, fallback): what an answer may quote, best first; the newest papers where nothing is found.

    excerpt: windows around hits, else the beginning; block: the part of the prompt.
    """
    hits = recall(papers, question, most)
    # both sides have at most ten rows
    rest = newest(papers, most).join(hits.agg(F.count("*").alias("hits"))).where("hits = 0").drop("hits")
    ranked = lambda rows, *order: rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    rows = ranked(hits.withColumn("fallback", F.lit(False)), F.col("year").desc(), F.col("id").desc()).unionByName(ranked(rest.withColumn("fallback", F.lit(True)), F.col("created_at").desc(), F.col("id").desc()))
    body = F.coalesce("fulltext", F.lit(""))
    around = F.array_join(T.excerpts(body, question, WINDOWS, WINDOW), "\n…\n")
    excerpt = T.truncated(F.when(around != "", around).otherwise(T.truncated(body, BEGINNING)), EXCERPT)
    return rows.select("rank", "id", "title", T.truncated(excerpt, QUOTED).alias("excerpt"), _block(excerpt).alias("block"), "fallback")


def _block(excerpt: Column) -> Column:
    year = F.when(F.col("year") > 0, F.concat(F.lit(" ("), F.col("year").cast("string"), F.lit(")"))).otherwise("")
    summary = T.truncated(F.coalesce("summary", F.lit("")), SUMMARY)
    return F.concat(F.lit("["), F.col("id").cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), year, F.lit("\n"), F.coalesce("authors", F.lit("")), F.when(summary != "", F.concat(F.lit("\n"), summary)).otherwise(""), F.when(excerpt != "", F.concat(F.lit("\n"), excerpt)).otherwise(""))


def prompt(papers: DataFrame, question: str, most: int = 3) -> DataFrame:
    """One row with the prompt for a question and the ids that it cites, best first."""
    s = sources(papers, question, most)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "id", "block")))
    return s.agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n").alias("context"), F.transform(ordered, lambda x: x["id"]).alias("cited")).select(F.concat(F.col("context"), F.lit("\n\n"), F.lit(question)).alias("prompt"), "cited")
