"""Registered queries of requests, changes and what is found outside the library, each over whole tables, with the SQL of the same result."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folialis.functions import text as T
from folialis.operators import exports, facets, graph, library, mutate, resolve
from folialis.operators.library import Library, PaperQuery, parse_query
from folialis.plans.library_queries import _COLS, _FOLD, NOW, lib
from folialis.plans.registry import query
from folialis.sources import model_list, pdf
from folialis.sources.snapshots import Snapshots
from folialis.sources.storage import shared_folder
from folialis.sources.tables import table


def shelves(spark: SparkSession, d: str) -> Library:
    """The library with collections of its own: one for each category, holding the papers of the category."""
    x = lib(spark, d)
    links = x.papers.where("category_id is not null").select(F.col("id").alias("paper_id"), F.col("category_id").alias("collection_id"))
    return x.with_tables(collections=x.categories, paper_collections=links)


def _placed(page: DataFrame) -> DataFrame:
    """With the place of each row in the page as it comes."""
    return page.withColumn("place", F.monotonically_increasing_id() + 1)


_HIT = " OR ".join(f"lower({c}) LIKE '%graph%'" for c in _COLS)


@query("list_search_page", f"""WITH p AS (SELECT id, title, fulltext, row_number() OVER (ORDER BY year DESC, id DESC) AS n FROM papers WHERE deleted_at IS NULL AND ({_HIT})), t AS (SELECT *, coalesce(fulltext, '') AS ft, nullif(instr(lower(coalesce(fulltext, '')), 'graph'), 0) AS hit FROM p WHERE n BETWEEN 16 AND 30)
SELECT id, n - 15 AS place, title, CASE WHEN hit IS NULL THEN '' ELSE trim((CASE WHEN hit > 81 THEN '…' ELSE '' END) || substr(ft, greatest(hit - 81, 0) + 1, 160) || (CASE WHEN greatest(hit - 81, 0) + 160 < length(ft) THEN '…' ELSE '' END), ' ') END AS snippet FROM t""")
def list_search_page(spark: SparkSession, d: str) -> DataFrame:
    return _placed(library.page(lib(spark, d), PaperQuery(search="Graph", sort="year", page=2, page_size=15))).select("id", "place", "title", "snippet")


@query("list_request", f"""SELECT id, row_number() OVER (ORDER BY {_FOLD.format('title')}, id) AS place, title FROM papers p WHERE deleted_at IS NULL AND year >= 2001 AND status <> 'read' AND NOT starred
AND EXISTS (SELECT 1 FROM paper_tags t WHERE t.paper_id = p.id AND t.tag_id IN (5, 6, 7)) AND category_id IN (1, 2) ORDER BY {_FOLD.format('title')}, id LIMIT 100""")
def list_request(spark: SparkSession, d: str) -> DataFrame:
    """A list as a client asks for it; what cannot be read is left out."""
    asked = parse_query({"tags": "5,x,6, 7", "collections": "1,2", "yearFrom": "2001", "yearTo": "soon", "category": "none", "read": "No", "starred": "0", "sort": "title", "order": "ASC", "pageSize": "9999", "page": "-3"})
    return _placed(library.page(shelves(spark, d), asked)).select("id", "place", "title")


@query("list_collections", "SELECT id FROM papers WHERE deleted_at IS NULL AND category_id IN (2, 3, 5) AND (category_id IS NULL OR category_id NOT IN (3))")
def list_collections(spark: SparkSession, d: str) -> DataFrame:
    return library.filtered(shelves(spark, d), PaperQuery(collection_ids=(2, 3, 5), exclude_collection_ids=(3,))).select("id")


@query("list_collection_names", "SELECT p.id FROM papers p JOIN categories c ON c.id = p.category_id WHERE p.deleted_at IS NULL AND c.name IN ('Imaging', 'Robotics')")
def list_collection_names(spark: SparkSession, d: str) -> DataFrame:
    return library.filtered(shelves(spark, d), PaperQuery(collection_names=("Imaging", "Robotics"))).select("id")


@query("collection_facet", "SELECT c.id, c.name, (SELECT count(*) FROM papers p WHERE p.category_id = c.id) AS paper_count FROM categories c")
def collection_facet(spark: SparkSession, d: str) -> DataFrame:
    x = shelves(spark, d)
    return facets.link_facet(x.collections, x.paper_collections, "collection_id")


_TAG_NAMES = "(SELECT string_agg(name, '|' ORDER BY name, t.id) FROM (SELECT DISTINCT tag_id FROM paper_tags pt WHERE pt.paper_id = p.id) l JOIN tags t ON t.id = l.tag_id)"


@query("hydrated_page", f"SELECT id, coalesce({_TAG_NAMES}, '') AS tags, coalesce((SELECT name FROM categories c WHERE c.id = p.category_id), '') AS collections FROM papers p WHERE deleted_at IS NULL ORDER BY created_at DESC, id DESC LIMIT 100")
def hydrated_page(spark: SparkSession, d: str) -> DataFrame:
    x = shelves(spark, d)
    names = lambda c: F.array_join(F.transform(c, lambda t: t["name"]), "|").alias(c)
    return library.hydrated(library.page(x, PaperQuery(page_size=100)), x).select("id", names("tags"), names("collections"))


@query("paper_detail", f"SELECT id, title, coalesce(status = 'read', false) AS read, coalesce((SELECT name FROM categories c WHERE c.id = p.category_id), '') AS category_name, coalesce({_TAG_NAMES}, '') AS tags FROM papers p WHERE id = 7 AND deleted_at IS NULL")
def paper_detail(spark: SparkSession, d: str) -> DataFrame:
    one = library.paper(shelves(spark, d), 7)
    return one.select("id", "title", "read", "category_name", F.array_join(F.transform("tags", lambda t: t["name"]), "|").alias("tags"))


@query("papers_by_id", "SELECT id, title FROM papers WHERE deleted_at IS NULL AND id IN (SELECT category_id FROM papers)")
def papers_by_id(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papers")
    return library.by_ids(p, p.select(F.col("category_id").alias("id"))).select("id", "title")


@query("names_taken", "SELECT (SELECT count(*) > 0 FROM tags WHERE name = (SELECT name FROM tags WHERE id = 3)) AS any_row, (SELECT count(*) > 0 FROM tags WHERE name = (SELECT name FROM tags WHERE id = 3) AND id <> 3) AS another")
def names_taken(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tags")
    name = t.where("id = 3").head()["name"]
    return facets.name_taken(t, name).withColumnRenamed("taken", "any_row").join(facets.name_taken(t, name, 3).withColumnRenamed("taken", "another"))


@query("tags_ensured", """WITH n AS (SELECT DISTINCT trim(keywords, ' ') AS name FROM papers WHERE trim(keywords, ' ') <> '' UNION SELECT name FROM tags)
SELECT n.name, t.id IS NULL AS new, (SELECT count(DISTINCT paper_id) FROM paper_tags l WHERE l.tag_id = t.id) AS paper_count FROM n LEFT JOIN tags t ON t.name = n.name""")
def tags_ensured(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tags")
    names = table(spark, d, "papers").select(F.col("keywords").alias("name")).union(t.select("name"))
    last = t.agg(F.max("id")).head()[0]
    return mutate.ensured_with_counts(t, names, table(spark, d, "paper_tags"), "tag_id").select("name", (F.col("id") > last).alias("new"), "paper_count")


@query("paper_inputs", """SELECT id, trim(coalesce(title, ''), ' ') AS title, trim(coalesce(venue, ''), ' ') AS venue, coalesce(notes, '') AS notes, coalesce(year, 0) AS year, category_id, CASE WHEN status IN ('unread', 'reading', 'read') THEN status WHEN coalesce(read, false) AND coalesce(status, '') = '' THEN 'read' ELSE 'unread' END AS status, coalesce(starred, false) AS starred FROM papers""")
def paper_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Every paper as the request that would write it, read back."""
    p = table(spark, d, "papers")
    body = F.to_json(F.struct("title", "authors", "venue", "doi", "notes", "year", F.col("category_id").alias("categoryId"), "read", "status", "starred"))
    return mutate.paper_of(p.select(F.col("id").alias("key"), body.alias("body"))).select(F.col("key").alias("id"), "title", "venue", "notes", "year", "category_id", "status", "starred")


@query("paper_requests", """SELECT p.id, title, notes, read, coalesce((SELECT string_agg(CAST(tag_id AS VARCHAR), ',' ORDER BY t.name, tag_id) FROM (SELECT DISTINCT tag_id FROM paper_tags pt WHERE pt.paper_id = p.id) l JOIN tags t ON t.id = tag_id), '') AS tags FROM papers p""")
def paper_requests(spark: SparkSession, d: str) -> DataFrame:
    x = shelves(spark, d)
    return mutate.input_of(library.hydrated(x.papers, x)).select("id", "title", "notes", "read", F.array_join(F.col("tags").cast("array<string>"), ",").alias("tags"))


@query("papers_inserted", """SELECT title, venue, status, read, year, pdf_size, created_at, notes_updated_at, count(*) AS n FROM (SELECT title, venue, status, read, year, pdf_size, created_at, notes_updated_at FROM papers
UNION ALL SELECT trim(name, ' '), '', 'unread', false, 0, 0, TIMESTAMP '2025-06-30 00:00:00', NULL FROM tags) x GROUP BY ALL""")
def papers_inserted(spark: SparkSession, d: str) -> DataFrame:
    out = mutate.inserted(table(spark, d, "papers"), table(spark, d, "tags").select(F.concat(F.lit(" "), "name", F.lit("  ")).alias("title")), NOW)
    keys = ("title", "venue", "status", "read", "year", "pdf_size", "created_at", "notes_updated_at")
    return out.groupBy(*keys).agg(F.count("*").alias("n"))


@query("updated_guarded", """SELECT id, CASE WHEN hit THEN trim(upper(coalesce(title, '')), ' ') ELSE title END AS title, CASE WHEN hit THEN 'seen' ELSE notes END AS notes, CASE WHEN hit THEN '' ELSE venue END AS venue, CASE WHEN hit THEN 'read' ELSE status END AS status, CASE WHEN hit THEN true ELSE read END AS read,
CASE WHEN hit AND coalesce(notes, '') IS DISTINCT FROM 'seen' THEN TIMESTAMP '2025-06-30 00:00:00' ELSE notes_updated_at END AS notes_updated_at, CASE WHEN hit THEN TIMESTAMP '2025-06-30 00:00:00' ELSE updated_at END AS updated_at, created_at FROM (SELECT *, coalesce(category_id = 4, false) AS hit FROM papers)""")
def updated_guarded(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papers")
    new = p.where("category_id = 4").select("id", F.col("notes_updated_at").alias("seen_notes_at"), F.upper("title").alias("title"), F.lit("seen").alias("notes"), F.lit("read").alias("status"))
    return mutate.updated(p, new, NOW).select("id", "title", "notes", "venue", "status", "read", "notes_updated_at", "updated_at", "created_at")


@query("metadata_updated", """SELECT id, CASE WHEN hit THEN 'Found ' || coalesce(venue, '') ELSE venue END AS venue, notes, status, starred, CASE WHEN hit THEN TIMESTAMP '2025-06-30 00:00:00' ELSE updated_at END AS updated_at FROM (SELECT *, doi LIKE '10.%' AS hit FROM papers)""")
def metadata_updated(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papers")
    found = p.where("doi like '10.%'").select("id", F.concat(F.lit("Found "), F.coalesce("venue", F.lit(""))).alias("venue"))
    return mutate.metadata_updated(p, found, NOW).select("id", "venue", "notes", "status", "starred", "updated_at")


@query("saved", """SELECT 'paper_tags' AS part, paper_id AS a, tag_id AS b, count(*) AS n FROM (SELECT paper_id, tag_id FROM paper_tags WHERE paper_id NOT IN (SELECT id FROM papers WHERE category_id = 5) UNION ALL SELECT id, category_id FROM papers WHERE category_id = 5) GROUP BY 2, 3
UNION ALL SELECT 'paper_collections', id, category_id, 1 FROM papers WHERE category_id IS NOT NULL AND category_id <> 5 UNION ALL SELECT 'papers', id, CASE WHEN category_id = 5 THEN 1 ELSE 0 END, 1 FROM papers""")
def saved(spark: SparkSession, d: str) -> DataFrame:
    """The papers of a collection saved with the collection's number as their one tag and without collections."""
    x = shelves(spark, d)
    rows = x.papers.where("category_id = 5").select("id", "notes", "category_id", F.lit("saved").alias("title"))
    tables = {"papers": x.papers, "tags": x.tags, "collections": x.collections, "paper_tags": x.paper_tags, "paper_collections": x.paper_collections}
    none = rows.where(F.lit(False)).select("id", F.col("category_id").alias("collection_id"))
    out = mutate.saved(tables, rows, rows.select("id", F.col("category_id").alias("tag_id")), none, NOW)
    links = [out[n].groupBy(F.col("paper_id").alias("a"), F.col(k).alias("b")).agg(F.count("*").alias("n")).select(F.lit(n).alias("part"), "a", "b", "n") for n, k in (("paper_tags", "tag_id"), ("paper_collections", "collection_id"))]
    papers = out["papers"].select(F.lit("papers").alias("part"), F.col("id").alias("a"), (F.col("title") == "saved").cast("long").alias("b"), F.lit(1).cast("long").alias("n"))
    return links[0].union(links[1]).union(papers.withColumn("b", F.coalesce("b", F.lit(0))))


@query("tags_replaced", "SELECT paper_id, tag_id, count(*) AS n FROM (SELECT paper_id, tag_id FROM paper_tags WHERE paper_id <> 3 UNION ALL SELECT 3, 8 UNION ALL SELECT 3, 9) GROUP BY ALL")
def tags_replaced(spark: SparkSession, d: str) -> DataFrame:
    return mutate.related_set(table(spark, d, "paper_tags"), 3, "tag_id", [8, 9, 8], table(spark, d, "tags")).groupBy("paper_id", "tag_id").agg(F.count("*").alias("n"))


@query("patch_request", "SELECT id, CASE WHEN id = 5 THEN NULL ELSE category_id END AS category_id, CASE WHEN id = 5 THEN 'read' ELSE status END AS status, CASE WHEN id = 5 THEN true ELSE starred END AS starred FROM papers")
def patch_request(spark: SparkSession, d: str) -> DataFrame:
    sets = mutate.patch_of({"read": True, "starred": True, "category_name": "", "unknown": 1, "title": None})
    patch = spark.createDataFrame([(5, *sets.values())], f"id long, {', '.join(f'{k} {"string" if isinstance(v, str) else "boolean" if isinstance(v, bool) else "long"}' for k, v in sets.items())}")
    return mutate.patched(table(spark, d, "papers"), patch, NOW).select("id", "category_id", "status", "starred")


_ON_PAGE = "page >= 1 AND x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1"


@query("annotations_changed", f"""WITH a AS (SELECT paper_id, kind, color, note, page, created_at FROM annotations WHERE id <> 2 AND id <> 3 UNION ALL SELECT paper_id, kind, 'pink', 'moved', page, created_at FROM annotations WHERE id = 3
UNION ALL SELECT paper_id, kind, CASE WHEN color IN ('yellow', 'green', 'blue', 'pink') THEN color ELSE 'yellow' END, note, page, TIMESTAMP '2025-06-30 00:00:00' FROM annotations WHERE kind = 'note' AND {_ON_PAGE}) SELECT paper_id, kind, color, note, page, created_at, count(*) AS n FROM a GROUP BY ALL""")
def annotations_changed(spark: SparkSession, d: str) -> DataFrame:
    """All notes that lie on a page added once more, one annotation changed, one deleted."""
    a = table(spark, d, "annotations")
    out = mutate.annotations_added(a, a.where(f"kind = 'note' and {_ON_PAGE}"), NOW)
    out = mutate.annotation_deleted(mutate.annotation_patched(out, 3, note="moved", color="pink", x=0.5, y=0.5), 2)
    return out.groupBy("paper_id", "kind", "color", "note", "page", "created_at").agg(F.count("*").alias("n"))


@query("notes_file", r"""WITH n AS (SELECT *, row_number() OVER (ORDER BY updated_at DESC NULLS LAST, id DESC) AS r FROM papers WHERE deleted_at IS NULL AND trim(notes, ' ') <> '')
SELECT 1 AS place, '# 论文笔记' || chr(10) || chr(10) || '> 导出时间：2025-06-30 00:00 · 共 ' || (SELECT count(*) FROM n) || ' 篇' || chr(10) || chr(10) AS text UNION ALL
SELECT r + 1, '## ' || trim(coalesce(title, ''), ' ') || chr(10) || chr(10) || (CASE WHEN trim(coalesce(authors, ''), ' ') <> '' THEN trim(authors, ' ') || '  ' || chr(10) ELSE '' END) || '> 最后修改：' || coalesce(strftime(updated_at, '%Y-%m-%d %H:%M'), '') || chr(10) || chr(10) || trim(notes, ' ') || chr(10) || chr(10) || '---' || chr(10) || chr(10) FROM n""")
def notes_file(spark: SparkSession, d: str) -> DataFrame:
    """The export in its order; places are counted over the rows as they come."""
    text = exports.notes_file(table(spark, d, "papers"), "2025-06-30 00:00")
    # the order is that of the sort, whose parts are numbered in their order; a row's place is the rows of earlier parts and of its own before it
    part = text.withColumn("at", F.monotonically_increasing_id())
    return part.select("text", F.row_number().over(_all("at")).alias("place"))


def _all(*columns: str):
    from pyspark.sql import Window

    return Window.orderBy(*columns)


@query("json_rows", """SELECT '{"id":' || id || ',"year":' || year || ',"starred":' || (CASE WHEN starred THEN 'true' ELSE 'false' END) || (CASE WHEN category_id IS NULL THEN '' ELSE ',"category_id":' || category_id END) || '}' AS json FROM papers WHERE year IS NOT NULL AND starred IS NOT NULL""")
def json_rows(spark: SparkSession, d: str) -> DataFrame:
    return exports.as_json(table(spark, d, "papers").where("year is not null and starred is not null").select("id", "year", "starred", "category_id"))


@query("snapshots", "SELECT 'categories' AS part, 2 AS version, count(*) AS n FROM categories WHERE id <> 1 UNION ALL SELECT 'categories', 1, count(*) FROM categories UNION ALL SELECT 'tags', 2, count(*) FROM tags UNION ALL SELECT 'backup', 2, count(*) FROM categories WHERE id <> 1")
def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Two versions of a library and a backup of the second."""
    import uuid

    root = f"{shared_folder(spark)}/folialis/{uuid.uuid4().hex}-versions"
    store, c = Snapshots(spark, f"{root}/library"), table(spark, d, "categories")
    base = store.publish(0, categories=c, tags=table(spark, d, "tags"))
    store.publish(base, categories=c.where("id <> 1"))
    store.backup(f"{root}/backup")
    parts = [("categories", 2, store.read("categories")), ("categories", 1, store.read("categories", 1)), ("tags", 2, store.read("tags")), ("backup", 2, spark.read.parquet(f"{root}/backup/categories.parquet"))]
    out = None
    for name, v, df in parts:
        n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), F.lit(v).alias("version"), "n")
        out = n if out is None else out.union(n)
    return out


@query("graph_cache", """SELECT doi, ref, updated_at < TIMESTAMP '2025-06-23 00:00:00' AS old FROM (SELECT doi, category_id AS ref, max(updated_at) AS updated_at FROM papers WHERE doi <> '' AND category_id IS NOT NULL AND updated_at IS NOT NULL GROUP BY 1, 2) WHERE NOT (doi LIKE '10.%') AND updated_at >= TIMESTAMP '2025-06-23 00:00:00'
UNION ALL SELECT doi, 0, false FROM (SELECT DISTINCT doi FROM papers WHERE doi LIKE '10.%')""")
def graph_cache(spark: SparkSession, d: str) -> DataFrame:
    """A cache of references after a fetch, without what is over a week old."""
    p = table(spark, d, "papers")
    old = p.where("doi <> '' and category_id is not null and updated_at is not null").groupBy("doi", "category_id").agg(F.max("updated_at").cast("timestamp").alias("fetched_at")).select("doi", F.array("category_id").alias("refs"), "fetched_at")
    found = p.where("doi like '10.%'").select("doi", F.array(F.lit(0).cast("long")).alias("refs"))
    kept = graph.fresh(graph.cached(old, found, NOW), NOW)
    return kept.select("doi", F.explode("refs").alias("ref"), (F.col("fetched_at") < F.lit("2025-06-23 00:00:00").cast("timestamp")).alias("old"))


_BARE = "lower(regexp_replace(trim({}, ' '), '(?i)^(https?://(dx\\.)?doi\\.org/|doi:\\s*)', ''))"
_TOKENS = "list_distinct(regexp_extract_all(lower(trim({}, ' ')), '[\\p{{L}}\\p{{N}}]+'))"


@query("references", f"""WITH p AS (SELECT id, title, {_BARE.format('doi')} AS k FROM papers), w AS (SELECT k, min(id) AS ref FROM p WHERE k <> '' GROUP BY k), d AS (SELECT p.id, w.ref FROM p JOIN w ON w.k = p.k),
h AS (SELECT p.id, t.tag_id AS ref, lower(trim(p.title, ' ')) AS a, lower(trim(g.name, ' ')) AS b, {_TOKENS.format('p.title')} AS x, {_TOKENS.format('g.name')} AS y FROM p JOIN (SELECT DISTINCT paper_id, tag_id FROM paper_tags) t ON t.paper_id = p.id JOIN tags g ON g.id = t.tag_id WHERE p.id NOT IN (SELECT id FROM d) AND g.name <> '')
SELECT id AS paper_id, ref AS own_ref, CAST(ref AS VARCHAR) AS refs FROM d UNION ALL SELECT id, min(ref), CAST(min(ref) AS VARCHAR) FROM h WHERE CASE WHEN a = '' OR b = '' THEN 0 WHEN contains(a, b) OR contains(b, a) THEN 1 WHEN len(x) = 0 THEN 0 ELSE len(list_intersect(x, y)) / len(x) END >= 0.6 GROUP BY id""")
def references(spark: SparkSession, d: str) -> DataFrame:
    """Works by DOI are the library's own rows; the hits of a title search are the names of a paper's tags."""
    p = table(spark, d, "papers")
    works = p.select("doi", F.col("id").alias("ref"), F.array("id").alias("refs"))
    tags = table(spark, d, "paper_tags").distinct().join(table(spark, d, "tags").withColumnRenamed("id", "tag_id"), "tag_id")
    hits = tags.select(F.col("paper_id").alias("id"), F.col("tag_id").alias("pos"), F.col("tag_id").alias("ref"), F.col("name").alias("title"), F.array("tag_id").alias("refs"))
    return resolve.references(p.select("id", "doi", "title"), works, hits).withColumn("refs", F.array_join(F.col("refs").cast("array<string>"), ","))


_PLAUSIBLE = """length(trim({0}, ' ')) BETWEEN 8 AND 300 AND NOT (contains(lower({0}), 'http://') OR contains(lower({0}), 'https://') OR contains(lower({0}), 'www.') OR contains(lower({0}), 'doi.org') OR contains(lower({0}), 'arxiv:')) AND length(regexp_replace(trim({0}, ' '), '[^\\p{{L}}\\p{{Nd}}]', '', 'g')) >= length(trim({0}, ' ')) * 0.45"""
_ASKED = f"SELECT id, {_TOKENS.format('title')} AS t FROM papers WHERE id % 50 = 0 AND {_PLAUSIBLE.format('title')} AND len({_TOKENS.format('title')}) >= 3"


@query("enriched_by_title", f"""WITH q AS ({_ASKED}), r AS (SELECT id, starred, year, title, {_TOKENS.format('title')} AS t FROM papers WHERE title <> ''), p AS (SELECT q.id, r.id AS entry, r.title, r.year, r.starred, len(list_intersect(q.t, r.t)) AS c, len(q.t) + len(r.t) AS n FROM q JOIN r ON len(list_intersect(q.t, r.t)) > 0),
f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY starred DESC, entry) AS k FROM p WHERE (starred AND c / (n - c) >= 0.55) OR (NOT starred AND year >= 2000 AND c / (n - c) >= 0.7)) SELECT id, title AS found_title, year AS found_year FROM f WHERE k = 1""")
def enriched_by_title(spark: SparkSession, d: str) -> DataFrame:
    """A stated query set (every id divisible by 50) against all rows: starred ones stand for the first source, the others for the second, scored by their year."""
    p = table(spark, d, "papers")
    found = p.select(F.when(F.col("starred"), "arxiv").when(~F.col("starred"), "crossref").alias("source"), F.col("id").alias("pos"), (F.col("year") - 1950.0).alias("score"), "title", "year", "venue", "doi")
    return resolve.enrich_by_title(p.where("id % 50 = 0").select("id", "title"), found).select("id", "found_title", "found_year")


@query("title_search", f"""WITH q AS ({_ASKED}), r AS (SELECT id, {_TOKENS.format('title')} AS t FROM papers), p AS (SELECT q.id, r.id AS entry, len(list_intersect(q.t, r.t)) AS c, len(q.t) + len(r.t) AS n FROM q JOIN r ON r.id <> q.id AND len(list_intersect(q.t, r.t)) > 0)
SELECT id, entry AS entry_id, round(c / (n - c), 9) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c / (n - c) DESC, entry) AS k FROM p WHERE c / (n - c) >= 0.7) WHERE k = 1""")
def title_search(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set of titles against all others: the best entry of each."""
    p = table(spark, d, "papers").select("id", "title")
    return resolve.search_by_title(p.where("id % 50 = 0"), p).withColumn("overlap", F.round("overlap", 9))


@query("model_bases", """SELECT id, CASE WHEN link <> '' THEN lower(regexp_extract(u, '^([a-zA-Z]+)://', 1)) || '://' || lower(regexp_extract(u, '^[A-Za-z]+://([^/]*)', 1)) || regexp_replace(regexp_extract(u, '^[A-Za-z]+://[^/]*(.*)$', 1), '/+$', '') END AS base, NULL AS refused FROM (SELECT id, link, trim(link, ' ') || '/V1//' AS u FROM papers)""")
def model_bases(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of models in their normal form; with a query or a user they are refused."""
    p = table(spark, d, "papers").select("id", F.when(F.col("link") != "", F.trim("link")).alias("u"))
    bad = F.coalesce(T.model_base(F.concat("u", F.lit("?a=1"))), T.model_base(F.regexp_replace("u", "://", "://me@")), T.model_base(F.concat(F.lit("ftp:"), "u")))
    return p.select("id", T.model_base(F.concat(F.upper(F.substring("u", 1, 5)), F.substring("u", 6, 10_000), F.lit("/V1//"))).alias("base"), bad.cast("int").alias("refused"))


@query("clean_abstracts", "SELECT id, trim(summary, ' ') AS abstract FROM papers WHERE summary IS NOT NULL AND summary NOT LIKE '%<%'")
def clean_abstracts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papers").where("summary is not null and not contains(summary, '<')")
    record = F.concat(F.lit(" <jats:abstract><jats:title></jats:title>"), F.trim("summary"), F.lit("</jats:abstract> "))
    return p.select("id", T.clean_abstract(record).alias("abstract"))


@query("truncated", "SELECT id, left(coalesce(fulltext, ''), 800) AS beginning FROM papers")
def truncated(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select("id", T.truncated(F.coalesce("fulltext", F.lit("")), 800).alias("beginning"))


@query("file_titles", r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(left(text, 8192), chr(10)), lambda s: trim(s, ' ')), lambda s: length(s) BETWEEN 8 AND 200 AND NOT regexp_matches(s, '^[0-9]') AND NOT regexp_matches(lower(s), '^(http|arxiv|doi:|©)') AND NOT regexp_matches(s, '(?i)\b10\.[0-9]{4,9}/[^\s"''<>()\[\]{}]+')
AND NOT (contains(lower(s), 'arxiv:') OR contains(lower(s), 'doi:') OR contains(lower(s), 'doi.org') OR contains(lower(s), 'http://') OR contains(lower(s), 'https://') OR contains(lower(s), 'www.') OR contains(lower(s), '©') OR contains(lower(s), 'copyright') OR contains(lower(s), 'isbn') OR contains(lower(s), 'issn'))
AND NOT regexp_matches(lower(s), '^(abstract|contents|table of contents|references|acknowledg|keywords|index terms|vol\.|no\. |introduction|conclusion|related work|摘要|关键词|参考文献|目录|附录|page [0-9])')
AND length(regexp_replace(s, '[^a-zA-Z0-9\x{80}-\x{10FFFF}]', '', 'g')) >= length(s) * 0.5) AS k FROM documents WHERE text IS NOT NULL) SELECT doc_id, coalesce(k[1], '') AS title FROM l""")
def file_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.sniff_file_title("text").alias("title"))


def _as_pdf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, content, size): a file for each (id, title, authors), the title in 18 points, the authors in 10, with codes of two bytes and a map to Unicode for each font."""
    import zlib

    for b in batches:
        paths, files = [], []
        for i, title, authors in zip(*(c.to_pylist() for c in b.columns), strict=True):
            objects = []
            shown = []
            for k, (text, size, shift) in enumerate(((title, 18, 1), (authors, 10, 7))):
                letters = sorted(set(text))
                # both fonts use the same codes for other letters
                code = {c: n + shift for n, c in enumerate(letters)}
                pairs = "".join(f"<{code[c]:04X}> <{c.encode('utf-16-be').hex()}> " for c in letters)
                chars = f"begincmap {len(letters)} beginbfchar {pairs}endbfchar endcmap"
                objects += [(10 + k, f"<< /Type /Font /ToUnicode {20 + k} 0 R >>", None), (20 + k, "", chars)]
                shown.append(f"/F{k} {size} Tf 0 -20 Td <{''.join(f'{code[c]:04X}' for c in text)}> Tj")
            objects += [(3, "<< /Type /Page /Resources << /Font << /F0 10 0 R /F1 11 0 R >> >> /Contents 4 0 R >>", None), (4, "", f"BT {' '.join(shown)} ET")]
            out = b"%PDF-1.5\n"
            for n, text, stream in objects:
                if stream is None:
                    out += f"{n} 0 obj {text} endobj\n".encode()
                else:
                    body = zlib.compress(stream.encode())
                    out += f"{n} 0 obj << /Length {len(body)} /Filter /FlateDecode >>\nstream\n".encode() + body + b"\nendstream endobj\n"
            paths.append(f"/{i}.pdf")
            files.append(out)
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(files, pa.binary()), pa.array(list(map(len, files)), pa.int64())], names=["path", "content", "size"])


_ONE_LINE = "trim(regexp_replace({}, '\\s+', ' ', 'g'), ' ')"


@query("pdf_texts", f"""SELECT CAST(id AS VARCHAR) AS id, {_ONE_LINE.format('title')} || chr(10) || {_ONE_LINE.format('authors')} AS text FROM papers WHERE regexp_matches(title, '^[\\x21-\\x7E][\\x20-\\x7E\\x{{A1}}-\\x{{FFFC}}]*$') AND regexp_matches(authors, '^[\\x21-\\x7E][\\x20-\\x7E\\x{{A1}}-\\x{{FFFC}}]*$')
AND NOT regexp_matches(title || authors, '[\\x{{2000}}-\\x{{200F}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{2060}}\\x{{3000}}\\x{{1680}}\\x{{D800}}-\\x{{DFFF}}]')""")
def pdf_texts(spark: SparkSession, d: str) -> DataFrame:
    """Titles and authors written to files with fonts of their own codes, and read again."""
    line = r"^[\x21-\x7E][\x20-\x7E\x{A1}-\x{FFFC}]*$"
    odd = r"[\x{2000}-\x{200F}\x{2028}\x{2029}\x{202F}\x{205F}\x{2060}\x{3000}\x{1680}\x{D800}-\x{DFFF}]"
    rows = table(spark, d, "papers").where(F.col("title").rlike(line) & F.col("authors").rlike(line) & ~F.concat("title", "authors").rlike(odd)).select("id", "title", "authors")
    files = rows.mapInArrow(_as_pdf, "path string, content binary, size long")
    return pdf.extracted(files).select(F.regexp_extract("path", r"(\d+)\.pdf", 1).alias("id"), "text")


@query("model_answers", "SELECT coalesce(list_distinct(list(trim(id, ' '))), []) IS NOT NULL AS any, count(DISTINCT trim(id, ' ')) AS n FROM models WHERE trim(id, ' ') <> '' AND (supported_protocols IS NULL OR len(supported_protocols) = 0 OR len(list_filter(supported_protocols, lambda p: trim(p, ' ') = 'chat')) > 0)")
def model_answers(spark: SparkSession, d: str) -> DataFrame:
    """The list of models as a gateway answers it."""
    m = table(spark, d, "models")
    body = m.agg(F.to_json(F.struct(F.collect_list(F.struct(*m.columns)).alias("data"))).alias("body"))
    answer = body.select(F.regexp_replace("body", '"chat"', '"openai:chat"').alias("body"))
    return model_list.parsed(answer, "body").agg((F.count("*") >= 0).alias("any"), F.count("*").alias("n"))

