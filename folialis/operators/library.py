"""The library's list: filters, order, pages, relations.

Nothing is filtered here that Catalyst cannot push to the scan: conditions on columns become pushed filters, "has any of these
tags" a semi join and "has none of these collections" an anti join. Wide text is joined to a page after its limit, so
that a page of twenty rows reads the full text of twenty rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folialis.functions import text as T

#: Columns of a list row (the full text is left out), sort keys, bounds of a page.
LIST_COLUMNS = (
    "id", "title", "authors", "year", "venue", "doi", "keywords", "link", "summary", "notes", "category_id", "read", "status", "starred",
    "pdf_path", "pdf_size", "created_at", "updated_at", "notes_updated_at", "deleted_at",
)
SORTS = {"title": "title", "year": "year", "authors": "authors", "created": "created_at", "updated": "updated_at"}
PAGE_SIZE, PAGE_MOST = 20, 100
TRUE, FALSE = ("1", "true", "yes"), ("0", "false", "no")


@dataclass(frozen=True)
class PaperQuery:
    """What a list asks for; None or empty means no condition."""

    search: str = ""
    strict_search: bool = False
    category_id: int | None = None
    tag_ids: Sequence[int] = ()
    #: names, or a table of them (name)
    tag_names: Sequence[str] | DataFrame = ()
    collection_ids: Sequence[int] = ()
    collection_names: Sequence[str] | DataFrame = ()
    exclude_collection_ids: Sequence[int] = ()
    year_from: int | None = None
    year_to: int | None = None
    read: bool | None = None
    status: str = ""
    starred: bool | None = None
    sort: str = "created"
    order: str = "desc"
    page: int = 1
    page_size: int = PAGE_SIZE

    @property
    def offset(self) -> int:
        return (max(1, self.page) - 1) * self.limit

    @property
    def limit(self) -> int:
        return PAGE_SIZE if self.page_size < 1 else min(self.page_size, PAGE_MOST)


def _whole(s: str | None) -> int | None:
    try:
        return int(s.strip()) if s else None
    except ValueError:
        return None


def parse_query(p: Mapping[str, str]) -> PaperQuery:
    """The query of request parameters. What cannot be read is left out, never an error.

    Lists are ids if any of their values is a whole number (the others are dropped), else names.
    """
    ids: dict[str, list] = {}
    for key, kind in (("tags", "tag"), ("collections", "collection"), ("exclude", "exclude_collection")):
        values = [v.strip() for v in p.get(key, "").split(",") if v.strip()]
        numbers = [n for v in values if (n := _whole(v)) is not None]
        if numbers:
            ids[f"{kind}_ids"] = numbers
        elif values and kind != "exclude_collection":
            ids[f"{kind}_names"] = values
    flag = lambda s: True if s.lower() in TRUE else False if s.lower() in FALSE else None
    return PaperQuery(
        search=p.get("search", "").strip(), category_id=_whole(p.get("category")), year_from=_whole(p.get("yearFrom")), year_to=_whole(p.get("yearTo")),
        read=flag(p.get("read", "")), starred=flag(p.get("starred", "")), status=p.get("status", ""), sort=p.get("sort", "created"), order=p.get("order", "desc"),
        page=_whole(p.get("page")) or 1, page_size=_whole(p.get("pageSize")) or PAGE_SIZE, **ids,
    )


@dataclass(frozen=True)
class Library:
    """The tables of a library. A table that is not there counts as empty where it is optional."""

    papers: DataFrame
    categories: DataFrame | None = None
    tags: DataFrame | None = None
    paper_tags: DataFrame | None = None
    collections: DataFrame | None = None
    paper_collections: DataFrame | None = None
    annotations: DataFrame | None = None
    extra: dict[str, DataFrame] = field(default_factory=dict)

    def with_tables(self, **tables: DataFrame) -> Library:
        return replace(self, **tables)


def live(papers: DataFrame) -> DataFrame:
    return papers.where(F.col("deleted_at").isNull())


def with_state(papers: DataFrame) -> DataFrame:
    """read as status says, whatever the flag, and whether there is a file."""
    return papers.withColumns({"read": F.coalesce(F.col("status") == "read", F.lit(False)), "has_pdf": F.coalesce(F.col("pdf_path") != "", F.lit(False))})


def _having(papers: DataFrame, links: DataFrame | None, key: str, dims: DataFrame | None, ids: Sequence[int], names: Sequence[str] | DataFrame) -> DataFrame:
    if ids:
        papers = papers.join(links.where(F.col(key).isin(list(ids))), papers["id"] == links["paper_id"], "left_semi")
    if isinstance(names, DataFrame) or names:
        named = dims.join(names, "name", "left_semi") if isinstance(names, DataFrame) else dims.where(F.col("name").isin(list(names)))
        wanted = named.select(F.col("id").alias(key))
        papers = papers.join(links.join(wanted, key, "left_semi"), papers["id"] == links["paper_id"], "left_semi")
    return papers


def filtered(lib: Library, q: PaperQuery) -> DataFrame:
    """The live papers that meet every condition of the query."""
    p = live(lib.papers)
    conditions: list[Column | None] = [
        T.matches(q.search, strict=q.strict_search),
        F.col("category_id") == q.category_id if q.category_id is not None else None,
        F.col("year") >= q.year_from if q.year_from is not None else None,
        F.col("year") <= q.year_to if q.year_to is not None else None,
        (F.col("status") == "read" if q.read else F.col("status") != "read") if q.read is not None else None,
        F.col("status") == q.status if q.status not in ("", "all") else None,
        F.col("starred") == q.starred if q.starred is not None else None,
    ]
    for c in conditions:
        if c is not None:
            p = p.where(c)
    p = _having(p, lib.paper_tags, "tag_id", lib.tags, q.tag_ids, q.tag_names)
    p = _having(p, lib.paper_collections, "collection_id", lib.collections, q.collection_ids, q.collection_names)
    if q.exclude_collection_ids:
        out = lib.paper_collections.where(F.col("collection_id").isin(list(q.exclude_collection_ids)))
        p = p.join(out, p["id"] == out["paper_id"], "left_anti")
    return p


def ordering(sort: str, order: str) -> list[Column]:
    """The sort columns, ended by the id in the same direction; an unknown key sorts by time of creation, case of A to Z doesn't count."""
    c = SORTS.get(sort, "created_at")
    key = T.fold_ascii(c) if c in ("title", "authors") else F.col(c)
    return [key.asc(), F.col("id").asc()] if order.lower() == "asc" else [key.desc(), F.col("id").desc()]


def page(lib: Library, q: PaperQuery) -> DataFrame:
    """One page of the list in its order: list columns, has_pdf, category_name, and snippet if there is a search.

    A search reads the full text anyway: it goes through the top-k with its row, so the snippets of a page are computed after the limit.
    """
    searched = bool(q.search.strip())
    order = ordering(q.sort, q.order)
    rows = filtered(lib, q).select(*LIST_COLUMNS, *(["fulltext"] if searched else [])).orderBy(*order).offset(q.offset).limit(q.limit)
    # the place in the page outlives the joins; a second sort by the same keys may be taken for granted and left out when the plan is made anew at run time
    rows = rows.withColumn("_place", F.row_number().over(Window.orderBy(*order)))
    out = with_category(with_state(rows), lib.categories)
    if searched:
        out = out.withColumn("snippet", T.snippet(F.coalesce("fulltext", F.lit("")), q.search)).drop("fulltext")
    # a shuffled join loses the order of the page, whose rows are at most those of one page
    return out.coalesce(1).sortWithinPartitions("_place").drop("_place")


def total(lib: Library, q: PaperQuery) -> DataFrame:
    """One row with the number of papers that the query has without pages, and the number of its pages."""
    n = filtered(lib, q).agg(F.count("*").alias("total"))
    return n.withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / q.limit)).cast("long"))


def with_category(papers: DataFrame, categories: DataFrame | None) -> DataFrame:
    """category_name, '' where there is none."""
    if categories is None:
        return papers.withColumn("category_name", F.lit(""))
    names = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    return papers.join(names, "category_id", "left").withColumn("category_name", F.coalesce("category_name", F.lit("")))


def live_counts(links: DataFrame, papers: DataFrame, key: str) -> DataFrame:
    """(key, n_papers): the live papers of each tag or collection."""
    return links.dropDuplicates(["paper_id", key]).join(live(papers).select(F.col("id").alias("paper_id")), "paper_id", "left_semi").groupBy(key).agg(F.count("*").alias("n_papers"))


def related(links: DataFrame, dims: DataFrame, key: str, papers: DataFrame | None = None) -> DataFrame:
    """(paper_id, <key without _id>s): array of (name, id, n_papers) of each paper, by name. papers: those of a page, all if None."""
    own = links.dropDuplicates(["paper_id", key])
    if papers is not None:
        own = own.join(papers.select(F.col("id").alias("paper_id")), "paper_id", "left_semi")
    named = own.join(dims.select(F.col("id").alias(key), "name", *(["n_papers"] if "n_papers" in dims.columns else [])), key)
    parts = ["name", F.col(key).alias("id"), *(["n_papers"] if "n_papers" in dims.columns else [])]
    return named.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct(*parts))).alias(f"{key.removesuffix('_id')}s"))


def hydrated(papers: DataFrame, lib: Library) -> DataFrame:
    """Papers (of a page) with their tags and collections, [] where there are none."""
    out = papers
    for links, dims, key in ((lib.paper_tags, lib.tags, "tag_id"), (lib.paper_collections, lib.collections, "collection_id")):
        name = f"{key.removesuffix('_id')}s"
        if links is None or dims is None:
            out = out.withColumn(name, F.array().cast("array<struct<name:string,id:bigint>>"))
            continue
        sets = related(links, dims, key, papers).withColumnRenamed("paper_id", "_pid")
        out = out.join(sets, out["id"] == sets["_pid"], "left").drop("_pid").withColumn(name, F.coalesce(name, F.array()))
    return out


def paper(lib: Library, id: int) -> DataFrame:
    """A live paper with its category, tags and collections."""
    return hydrated(with_category(with_state(live(lib.papers).where(F.col("id") == id).select(*LIST_COLUMNS)), lib.categories), lib)


def by_ids(papers: DataFrame, ids: DataFrame) -> DataFrame:
    """The live papers of a batch of ids (id); ids that come twice or are not there are no matter."""
    return live(papers).join(ids.select("id"), "id", "left_semi")


def trash(lib: Library) -> DataFrame:
    """What is in the trash, latest first."""
    rows = lib.papers.where(F.col("deleted_at").isNotNull()).select(*LIST_COLUMNS)
    return with_category(with_state(rows), lib.categories).orderBy(F.col("deleted_at").desc(), F.col("id").desc())


def noted(papers: DataFrame) -> DataFrame:
    """Live papers with notes of more than blanks (other white space counts as a note), latest first."""
    return live(papers).where(F.trim("notes") != "").select("id", "title", "authors", "notes", "updated_at").orderBy(F.col("updated_at").desc(), F.col("id").desc())


def annotations_of(annotations: DataFrame) -> DataFrame:
    """The annotations with the place of each in the list of its paper, by page and id, then as they came.

    Places are counted within each page of a paper and offset by the pages before, so a paper with very many annotations is no single task.
    """
    page = F.coalesce("page", F.lit(-1))
    a = annotations.withColumn("_page", page)
    sizes = a.groupBy("paper_id", "_page").agg(F.count("*").alias("_n"))
    # a row for each page of a paper
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("paper_id").orderBy("_page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("paper_id").alias("_paper"), F.col("_page").alias("_p"), before.alias("_before"))
    at = F.row_number().over(Window.partitionBy("paper_id", "_page").orderBy("id", "created_at", F.col("quote").asc_nulls_last(), F.col("note").asc_nulls_last()))
    placed = a.withColumn("_at", at).join(offsets, F.col("paper_id").eqNullSafe(F.col("_paper")) & (F.col("_page") == F.col("_p")))
    return placed.withColumn("place", F.col("_at") + F.col("_before")).select(*annotations.columns, "place")


def backfilled(papers: DataFrame) -> DataFrame:
    """An older store's rows: status from read, and the time of notes from that of the row where it is missing."""
    return papers.withColumns(
        {"status": F.when(F.col("read") & (F.coalesce("status", F.lit("")) != "read"), "read").otherwise(F.col("status")), "notes_updated_at": F.when(F.col("notes_updated_at").isNull() & (F.coalesce("notes", F.lit("")) != ""), F.col("updated_at")).otherwise(F.col("notes_updated_at"))}
    )


def candidates(papers: DataFrame, members: DataFrame, needle: str) -> DataFrame:
    """Live papers that are not among members (paper_id) and hold the needle in title or authors."""
    found = T.matches(needle, ("title", "authors"))
    p = live(papers) if found is None else live(papers).where(found)
    return p.join(members, p["id"] == members["paper_id"], "left_anti")


def unused(dims: DataFrame, links: DataFrame, key: str, most: int) -> DataFrame:
    """The first tags or collections by name that no paper has."""
    return dims.join(links, dims["id"] == links[key], "left_anti").orderBy(T.fold_ascii("name"), "id").limit(most)
