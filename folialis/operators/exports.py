"""Exports as text columns: one row for each entry, so that a large export is written by all executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folialis.functions import text as T
from folialis.operators.library import noted


def bib_entry() -> Column:
    """The BibTeX entry of a paper: @article with a venue, else @misc."""
    s = lambda c: F.coalesce(F.col(c), F.lit(""))

    def line(name: str, value: Column, given: Column) -> Column:
        return F.when(given, F.concat(F.lit(f"  {name} = {{"), value, F.lit("},\n"))).otherwise("")

    kind = F.when(s("venue") != "", "article").otherwise("misc")
    year = F.coalesce(F.col("year"), F.lit(0))
    return F.concat(
        F.lit("@"), kind, F.lit("{"), T.bib_key(s("authors"), year, F.col("id")), F.lit(",\n"), line("title", T.bib_escape(s("title")), F.lit(True)),
        line("author", T.bib_escape(T.bib_authors(s("authors"))), F.trim(s("authors")) != ""), line("year", year.cast("string"), year > 0),
        line("journal", T.bib_escape(s("venue")), s("venue") != ""), line("doi", T.bib_escape(s("doi")), s("doi") != ""), F.lit("}\n"),
    )


def bibtex(papers: DataFrame) -> DataFrame:
    """(id, entry) of every paper given: an export has no pages."""
    return papers.select("id", bib_entry().alias("entry"))


def note_sections(papers: DataFrame) -> DataFrame:
    """(id, updated_at, section): a Markdown section for each paper with notes."""
    authors = F.trim(F.coalesce("authors", F.lit("")))
    head = F.concat(F.lit("## "), F.trim(F.coalesce("title", F.lit(""))), F.lit("\n\n"), F.when(authors != "", F.concat(authors, F.lit("  \n"))).otherwise(""))
    when = F.concat(F.lit("> 最后修改："), F.coalesce(F.date_format("updated_at", "yyyy-MM-dd HH:mm"), F.lit("")), F.lit("\n\n"))
    return noted(papers).select("id", "updated_at", F.concat(head, when, F.trim("notes"), F.lit("\n\n---\n\n")).alias("section"))


def notes_header(papers: DataFrame, now: str) -> DataFrame:
    """One row: the head of the export, with the time and the number of papers."""
    return noted(papers).agg(F.concat(F.lit(f"# 论文笔记\n\n> 导出时间：{now} · 共 "), F.count("*").cast("string"), F.lit(" 篇\n\n")).alias("header"))


def notes_file(papers: DataFrame, now: str) -> DataFrame:
    """(part, text): the whole export in its order, head first, then the sections, the latest change first. A distributed sort: write_text keeps the order over its parts."""
    head = notes_header(papers, now).select(F.lit(0).alias("rank"), F.lit(None).cast(papers.schema["updated_at"].dataType).alias("updated_at"), F.lit(None).cast("long").alias("id"), F.col("header").alias("text"))
    body = note_sections(papers).select(F.lit(1).alias("rank"), "updated_at", "id", F.col("section").alias("text"))
    ordered = head.union(body).orderBy("rank", F.col("updated_at").desc(), F.col("id").desc())
    return ordered.select(F.when(F.col("rank") == 0, "head").otherwise("section").alias("part"), "id", "text")


def single_note(papers: DataFrame) -> DataFrame:
    """(id, markdown): a paper's notes as a file of its own."""
    s = lambda c: F.nullif(F.col(c), F.lit(""))
    meta = F.concat_ws(" · ", s("authors"), F.when(F.col("year") > 0, F.col("year").cast("string")), s("venue"))
    text = F.trim(F.coalesce("notes", F.lit("")))
    return papers.select(
        "id",
        F.concat(
            F.lit("# "), F.coalesce(s("title"), F.lit("未命名论文")), F.lit("\n\n"), F.when(meta != "", F.concat(meta, F.lit("\n\n"))).otherwise(""),
            F.lit("> 最后修改："), F.coalesce(F.date_format("updated_at", "yyyy-MM-dd HH:mm"), F.lit("未知")), F.lit("\n\n"), F.when(text != "", text).otherwise("（空）"),
        ).alias("markdown"),
    )


def annotation_lines(annotations: DataFrame) -> DataFrame:
    """(id, paper_id, page, line): a bullet for each annotation, blanks of the quote collapsed.

    The lines of a paper are to be read in the order of page and id. They are not gathered into one value, as a few papers hold very many.
    """
    quote = F.trim(F.regexp_replace(F.coalesce("quote", F.lit("")), r"\s+", " "))
    note = F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit("\n  - 备注："), F.col("note"))).otherwise("")
    return annotations.select("id", "paper_id", "page", F.concat(F.lit("- （第 "), F.greatest(F.coalesce("page", F.lit(1)), F.lit(1)).cast("string"), F.lit(" 页）> "), quote, note).alias("line"))


def as_json(df: DataFrame) -> DataFrame:
    """(json): each row as an object."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def write_text(df: DataFrame, column: str, path: str) -> None:
    """The column as text files, one part for each partition."""
    df.select(column).write.text(path)
