"""From files to library rows: extract, enrich, leave out what is there already, load."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folialis.functions import jsonx, text as T
from folialis.operators import mutate, resolve
from folialis.sources import pdf

#: Characters of full text that are stored, and characters that a model is shown for a record's fields and for its summary.
STORED, SHOWN_META, SHOWN_SUMMARY = 200_000, 6_000, 8_000


class Answers(Protocol):
    """A language model behind a batch interface: (id, prompt) to (id, answer). None is built in."""

    def __call__(self, prompts: DataFrame) -> DataFrame: ...


def meta_prompts(records: DataFrame, shown: int = SHOWN_META) -> DataFrame:
    """(id, prompt) that asks for a record's bibliographic fields as one JSON object."""
    ask = F.lit(f"Give {', '.join(jsonx.META_KEYS)} of this document as one JSON object.\n\n")
    return records.select("id", F.concat(ask, F.coalesce("title", F.lit("")), F.lit("\n"), T.truncated(F.coalesce("fulltext", F.lit("")), shown)).alias("prompt"))


def described(records: DataFrame, catalogue: DataFrame | None = None, answers: Answers | None = None, searched: DataFrame | None = None) -> DataFrame:
    """records (id, title, authors, year, venue, doi, keywords, fulltext) with blanks filled from a catalogue, then from a model's answers.

    What the user or the file says goes before the catalogue, and that before the model. A record whose DOI gives nothing is looked for by its title in
    searched (see resolve.enrich_by_title), and a DOI that names another work than a plausible title is dropped.
    """
    others = []
    if catalogue is not None:
        found = resolve.enrich_by_doi(records.select("id", "title", "doi"), catalogue).select("id", F.col("found_title").alias("title"), F.col("found_year").alias("year"), F.col("found_venue").alias("venue"))
        got = found.where("title is not null")
        others.append(got)
        # a DOI that gave nothing, or another work, is no source of a plausible title
        kept = F.when((F.trim("doi") != "") & F.col("_known").isNull() & T.title_plausible("title"), F.lit("")).otherwise(F.col("doi"))
        records = records.join(got.select("id", F.lit(True).alias("_known")), "id", "left").withColumn("doi", kept).drop("_known")
    if searched is not None:
        asked = records.join(others[0], "id", "left_anti") if others else records
        by_title = resolve.enrich_by_title(asked.select("id", "title"), searched)
        others.append(by_title.select("id", F.col("found_title").alias("title"), F.col("found_year").alias("year"), F.col("found_venue").alias("venue"), F.col("found_doi").alias("doi")))
    if answers is not None:
        got = answers(meta_prompts(records)).select("id", jsonx.decode_meta(F.col("answer")).alias("m"))
        others.append(got.select("id", *(F.expr(f"try_cast(m['{k}'] as int)").alias("year") if k == "year" else F.col("m")[k].alias(k) for k in ("title", "authors", "year", "venue", "doi", "keywords"))))
    return resolve.filled(records, *others)


def incoming(pdfs: DataFrame, catalogue: DataFrame | None = None, answers: Answers | None = None, searched: DataFrame | None = None) -> DataFrame:
    """The rows that files would become, without loading them (a dry run)."""
    rows = pdf.described(pdf.extracted(pdfs)).select(
        F.xxhash64("path").alias("id"), "title", "authors", F.lit(0).alias("year"), F.lit("").alias("venue"), "doi", F.lit("").alias("keywords"), F.substring("fulltext", 1, STORED).alias("fulltext"),
        F.col("path").alias("pdf_path"), F.col("size").alias("pdf_size"),
    )
    return described(rows, catalogue, answers, searched)


def ingested(papers: DataFrame, pdfs: DataFrame, now: str, catalogue: DataFrame | None = None, answers: Answers | None = None, force: bool = False, searched: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(papers with the new rows, rows left out with the paper that each duplicates). force loads duplicates too."""
    new = incoming(pdfs, catalogue, answers, searched)
    same = resolve.duplicate_of(papers, new.select(F.col("id").alias("key"), "doi", "title", "authors"))
    fresh = new if force else new.join(same, new["id"] == same["key"], "left_anti")
    return mutate.inserted(papers, fresh.drop("id"), now), same.join(new, same["key"] == new["id"]).select("pdf_path", "paper_id", "by")


def reread(papers: DataFrame, pdfs: DataFrame, now: str) -> DataFrame:
    """papers with title, doi and full text read again from their files. An extraction without text changes nothing."""
    again = pdf.described(pdf.extracted(pdfs)).where(F.trim("fulltext") != "")
    keep = lambda c: F.when(F.trim(c) != "", F.col(c))
    patch = again.join(papers.select("id", F.col("pdf_path").alias("path")), "path").select("id", keep("title").alias("title"), keep("doi").alias("doi"), F.substring("fulltext", 1, STORED).alias("fulltext"))
    return mutate.patched(papers, patch, now)


def summary_prompts(papers: DataFrame, shown: int = SHOWN_SUMMARY) -> DataFrame:
    """(id, prompt) that asks for a summary from the stored text."""
    return papers.where(F.trim(F.coalesce("fulltext", F.lit(""))) != "").select("id", F.concat(F.lit("Summarise this document.\n\n"), F.coalesce("title", F.lit("")), F.lit("\n"), T.truncated("fulltext", shown)).alias("prompt"))


def summarised(papers: DataFrame, answers: Answers, now: str) -> DataFrame:
    got = answers(summary_prompts(papers)).where(F.trim("answer") != "").select("id", F.trim("answer").alias("summary"))
    return mutate.patched(papers, got, now)


def feed_entries(atom: DataFrame, body: str) -> DataFrame:
    """(title, year, link, authors) of each entry of Atom feeds in a column; the year is that of publication."""
    entry = "struct<title:string,published:string,id:string,author:array<struct<name:string>>>"
    parsed = F.from_xml(F.col(body), f"entry array<{entry}>")
    e = atom.select(F.explode(parsed["entry"]).alias("e"))
    return e.select(T.normalize_text(F.col("e.title")).alias("title"), F.expr("try_cast(substring(e.published, 1, 4) as int)").alias("year"), F.col("e.id").alias("link"), F.array_join(F.col("e.author.name"), ", ").alias("authors"))
