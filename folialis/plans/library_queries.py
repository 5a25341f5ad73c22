"""Registered queries of the library's own operators, each over whole tables, with the SQL of the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folialis.functions import jsonx, markdown, rects, text as T
from folialis.operators import exports, facets, graph, library, mutate, resolve, search
from folialis.operators.library import Library, PaperQuery
from folialis.plans.registry import query
from folialis.sources import model_list
from folialis.sources.tables import table

NOW = "2025-06-30 00:00:00"


def lib(spark: SparkSession, d: str) -> Library:
    """The tables of a directory. Tags serve as collections too, as the test tables have none."""
    t = {n: table(spark, d, n) for n in ("papers", "categories", "tags", "paper_tags", "annotations")}
    return Library(t["papers"], t["categories"], t["tags"], t["paper_tags"], t["tags"], t["paper_tags"].withColumnRenamed("tag_id", "collection_id"), t["annotations"])


LIST = PaperQuery(tag_ids=(1, 2, 3, 5, 8, 13, 21, 34), exclude_collection_ids=(4, 9), year_from=2005, year_to=2022, sort="title", order="asc", page=2)
_LIST_WHERE = """FROM papers p WHERE p.deleted_at IS NULL AND p.year >= 2005 AND p.year <= 2022
 AND EXISTS (SELECT 1 FROM paper_tags t WHERE t.paper_id = p.id AND t.tag_id IN (1,2,3,5,8,13,21,34))
 AND NOT EXISTS (SELECT 1 FROM paper_tags t WHERE t.paper_id = p.id AND t.tag_id IN (4,9))"""
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("list_page", f"""SELECT x.id, x.title, x.year, coalesce(c.name, '') AS category_name, coalesce(x.pdf_path <> '', false) AS has_pdf, coalesce(x.status = 'read', false) AS read, place
FROM (SELECT p.*, row_number() OVER (ORDER BY {_FOLD.format('p.title')}, p.id) - 20 AS place {_LIST_WHERE} ORDER BY {_FOLD.format('p.title')}, p.id LIMIT 20 OFFSET 20) x LEFT JOIN categories c ON c.id = x.category_id""")
def list_page(spark: SparkSession, d: str) -> DataFrame:
    """With the place of each row in the page as it comes."""
    return library.page(lib(spark, d), LIST).select("id", "title", "year", "category_name", "has_pdf", "read", (F.monotonically_increasing_id() + 1).alias("place"))


@query("list_total", f"SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 20.0) AS BIGINT)) AS pages {_LIST_WHERE}")
def list_total(spark: SparkSession, d: str) -> DataFrame:
    return library.total(lib(spark, d), LIST)


@query("list_by_state", """SELECT id, status, starred, category_id FROM papers WHERE deleted_at IS NULL AND category_id = 1 AND status <> 'read' AND NOT starred
ORDER BY created_at DESC, id DESC LIMIT 100""")
def list_by_state(spark: SparkSession, d: str) -> DataFrame:
    return library.page(lib(spark, d), PaperQuery(category_id=1, read=False, starred=False, sort="nonsense", page_size=500)).select("id", "status", "starred", "category_id")


@query("list_status", "SELECT id, year FROM papers WHERE deleted_at IS NULL AND status = 'reading' ORDER BY year DESC, id DESC LIMIT 20")
def list_status(spark: SparkSession, d: str) -> DataFrame:
    return library.page(lib(spark, d), PaperQuery(status="reading", sort="year")).select("id", "year")


@query("semi_by_name", """SELECT p.id FROM papers p WHERE p.deleted_at IS NULL AND EXISTS (SELECT 1 FROM paper_tags pt JOIN tags t ON t.id = pt.tag_id
WHERE pt.paper_id = p.id AND t.name IN (SELECT name FROM tags WHERE id IN (7, 11, 200)))""")
def semi_by_name(spark: SparkSession, d: str) -> DataFrame:
    x = lib(spark, d)
    names = x.tags.where("id in (7, 11, 200)").select("name")
    return library.filtered(x, PaperQuery(tag_names=names)).select("id")


_COLS = ("title", "authors", "venue", "doi", "keywords", "summary", "fulltext")
_ANY = lambda pat: " OR ".join(f"lower({c}) LIKE '{pat}'" for c in _COLS)


@query("search_sub", f"SELECT id FROM papers WHERE deleted_at IS NULL AND ({_ANY('%fusion%')})")
def search_sub(spark: SparkSession, d: str) -> DataFrame:
    return library.filtered(lib(spark, d), PaperQuery(search=" Fusion ")).select("id")


@query("search_wild", f"SELECT id FROM papers WHERE deleted_at IS NULL AND ({_ANY('%gra_h k%nel%')})")
def search_wild(spark: SparkSession, d: str) -> DataFrame:
    return library.filtered(lib(spark, d), PaperQuery(search="gra_h k%nel")).select("id")


@query("search_unicode", f"SELECT id FROM papers WHERE deleted_at IS NULL AND ({_ANY('%étape%')})")
def search_unicode(spark: SparkSession, d: str) -> DataFrame:
    return library.filtered(lib(spark, d), PaperQuery(search="ÉTAPE")).select("id")


@query("search_strict", "SELECT id FROM papers WHERE deleted_at IS NULL AND (" + " OR ".join(f"{_FOLD.format(c)} LIKE '%étape%'" for c in _COLS) + ")")
def search_strict(spark: SparkSession, d: str) -> DataFrame:
    return library.filtered(lib(spark, d), PaperQuery(search="ÉTAPE", strict_search=True)).select("id")


@query("search_documents", "SELECT doc_id, n_chars FROM documents WHERE lower(text) LIKE '%quantization%' OR lower(text) LIKE '%calibration gap%'")
def search_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(T.matches("quantization", ("text",)) | T.matches("calibration gap", ("text",))).select("doc_id", "n_chars")


@query("recall_top", f"""SELECT id, year FROM papers WHERE deleted_at IS NULL AND ({_ANY('%zelta%')} OR {_ANY('%glacier%')} OR {_ANY('%雪%')}) ORDER BY year DESC, id DESC LIMIT 5""")
def recall_top(spark: SparkSession, d: str) -> DataFrame:
    return search.recall(table(spark, d, "papers"), "Zelta-glacier 雪", 5).select("id", "year")


_SNIP = """SELECT id, CASE WHEN hit IS NULL THEN '' ELSE trim((CASE WHEN st > 0 THEN '…' ELSE '' END) || substr(ft, st + 1, 160) || (CASE WHEN st + 160 < length(ft) THEN '…' ELSE '' END)) END AS snippet
FROM (SELECT id, ft, hit, greatest(hit - 81, 0) AS st FROM (SELECT id, coalesce(fulltext, '') AS ft, least(nullif(instr(lower(coalesce(fulltext, '')), 'graph'), 0), nullif(instr(lower(coalesce(fulltext, '')), 'pooling'), 0)) AS hit FROM papers))"""


@query("snippet", _SNIP)
def snippet(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select("id", T.snippet(F.coalesce("fulltext", F.lit("")), "Graph pooling").alias("snippet"))


_EXC = """WITH t AS (SELECT doc_id, text, lower(text) AS low FROM documents WHERE text IS NOT NULL),
a AS (SELECT *, nullif(instr(low, 'scheme'), 0) AS h FROM t), b AS (SELECT *, greatest(h - 101, 0) AS s1, least(greatest(h - 101, 0) + 200, length(text)) AS e1 FROM a),
c AS (SELECT *, nullif(instr(substr(low, e1 + 1), 'scheme'), 0) + e1 AS h2 FROM b), e AS (SELECT *, greatest(h2 - 101, 0) AS s2, least(greatest(h2 - 101, 0) + 200, length(text)) AS e2 FROM c)
SELECT doc_id, CASE WHEN h IS NULL THEN '' ELSE trim(substr(text, s1 + 1, e1 - s1), ' ') END AS first, CASE WHEN h IS NULL OR h2 IS NULL THEN '' ELSE trim(substr(text, s2 + 1, e2 - s2), ' ') END AS second FROM e"""


@query("excerpts", _EXC)
def excerpts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", T.excerpts("text", "scheme", 2, 200).alias("two"))
    return rows.select("doc_id", *(F.coalesce(F.try_element_at("two", F.lit(k)), F.lit("")).alias(n) for k, n in ((1, "first"), (2, "second"))))


@query("query_tokens", r"""SELECT doc_id, CAST(len(k) AS BIGINT) AS n, array_to_string(k, '|') AS tokens
FROM (SELECT doc_id, regexp_extract_all(regexp_replace(lower(trim(text, ' ')), '([\x{2E81}-\x{10FFFF}])', ' \1 ', 'g'), '[\p{L}\p{N}]+') AS k FROM documents WHERE text IS NOT NULL)""")
def query_tokens(spark: SparkSession, d: str) -> DataFrame:
    k = T.query_tokens("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(k).cast("long").alias("n"), F.array_join(k, "|").alias("tokens"))


@query("api_tokens", r"""SELECT doc_id, CAST(len(k) AS BIGINT) AS n, array_to_string(k, '|') AS tokens
FROM (SELECT doc_id, regexp_extract_all(lower(trim(text, ' ')), '[a-z0-9]+|[\x{2E81}-\x{10FFFF}]') AS k FROM documents WHERE text IS NOT NULL)""")
def api_tokens(spark: SparkSession, d: str) -> DataFrame:
    k = T.api_tokens("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(k).cast("long").alias("n"), F.array_join(k, "|").alias("tokens"))


_TAGS = """SELECT paper_id, string_agg(name, '|' ORDER BY name, id) AS names, count(*) AS n, CAST(sum(n_papers) AS BIGINT) AS uses FROM (SELECT DISTINCT pt.paper_id, t.id, t.name FROM paper_tags pt JOIN tags t ON t.id = pt.tag_id) x
JOIN (SELECT tag_id, count(*) AS n_papers FROM (SELECT DISTINCT paper_id, tag_id FROM paper_tags) y WHERE paper_id IN (SELECT id FROM papers WHERE deleted_at IS NULL) GROUP BY tag_id) u ON u.tag_id = x.id GROUP BY paper_id"""


@query("hydrate_tags", _TAGS)
def hydrate_tags(spark: SparkSession, d: str) -> DataFrame:
    x = lib(spark, d)
    counted = x.tags.join(library.live_counts(x.paper_tags, x.papers, "tag_id").withColumnRenamed("tag_id", "id"), "id")
    sets = library.related(x.paper_tags, counted, "tag_id")
    uses = F.aggregate("tags", F.lit(0).cast("long"), lambda a, t: a + t["n_papers"])
    return sets.select("paper_id", F.array_join(F.transform("tags", lambda t: t["name"]), "|").alias("names"), F.size("tags").cast("long").alias("n"), uses.alias("uses"))


@query("category_facet", "SELECT c.id, c.name, (SELECT count(*) FROM papers p WHERE p.category_id = c.id AND p.deleted_at IS NULL) AS paper_count FROM categories c")
def category_facet(spark: SparkSession, d: str) -> DataFrame:
    return facets.category_facet(table(spark, d, "categories"), table(spark, d, "papers"))


@query("tag_facet", "SELECT t.id, t.name, (SELECT count(DISTINCT paper_id) FROM paper_tags p WHERE p.tag_id = t.id) AS paper_count FROM tags t")
def tag_facet(spark: SparkSession, d: str) -> DataFrame:
    return facets.link_facet(table(spark, d, "tags"), table(spark, d, "paper_tags"), "tag_id")


@query("tag_facet_live", "SELECT t.id, t.name, (SELECT count(DISTINCT paper_id) FROM paper_tags p WHERE p.tag_id = t.id AND paper_id IN (SELECT id FROM papers WHERE deleted_at IS NULL)) AS paper_count FROM tags t")
def tag_facet_live(spark: SparkSession, d: str) -> DataFrame:
    return facets.link_facet(table(spark, d, "tags"), table(spark, d, "paper_tags"), "tag_id", table(spark, d, "papers"))


@query("stats", """SELECT count(*) AS total, count(*) FILTER (status = 'read') AS n_read, count(*) FILTER (starred) AS n_starred, (SELECT count(*) FROM categories) AS n_categories, (SELECT count(*) FROM tags) AS n_tags,
CAST(0 AS BIGINT) AS n_collections, count(*) - count(*) FILTER (status = 'read') AS n_unread, CAST(round(count(*) FILTER (status = 'read') * 100 / count(*)) AS BIGINT) AS read_percent FROM papers WHERE deleted_at IS NULL""")
def stats(spark: SparkSession, d: str) -> DataFrame:
    return facets.stats(*(table(spark, d, n) for n in ("papers", "categories", "tags")))


@query("annotation_counts", "SELECT paper_id, count(*) AS n FROM annotations GROUP BY paper_id")
def annotation_counts(spark: SparkSession, d: str) -> DataFrame:
    return facets.annotation_counts(table(spark, d, "annotations"))


@query("newest_by_tag", """SELECT tag_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY created_at DESC, id DESC) AS papers FROM (SELECT id, created_at FROM papers WHERE deleted_at IS NULL ORDER BY created_at DESC, id DESC LIMIT 100) n
JOIN (SELECT DISTINCT paper_id, tag_id FROM paper_tags) pt ON pt.paper_id = n.id GROUP BY tag_id""")
def newest_by_tag(spark: SparkSession, d: str) -> DataFrame:
    return facets.newest_by_link(table(spark, d, "papers"), table(spark, d, "paper_tags"), "tag_id").withColumn("papers", F.array_join("papers", ","))


@query("candidates", "SELECT id FROM papers p WHERE deleted_at IS NULL AND (lower(title) LIKE '%index%' OR lower(authors) LIKE '%index%') AND NOT EXISTS (SELECT 1 FROM paper_tags t WHERE t.paper_id = p.id AND t.tag_id = 1)")
def candidates(spark: SparkSession, d: str) -> DataFrame:
    return library.candidates(table(spark, d, "papers"), table(spark, d, "paper_tags").where("tag_id = 1"), "Index").select("id")


@query("unused_tags", f"SELECT id, name FROM tags t WHERE NOT EXISTS (SELECT 1 FROM paper_tags p WHERE p.tag_id = t.id) ORDER BY {_FOLD.format('name')}, id LIMIT 12")
def unused_tags(spark: SparkSession, d: str) -> DataFrame:
    return library.unused(table(spark, d, "tags"), table(spark, d, "paper_tags"), "tag_id", 12).select("id", "name")


@query("trash", "SELECT p.id, deleted_at, coalesce(c.name, '') AS category_name FROM papers p LEFT JOIN categories c ON c.id = p.category_id WHERE deleted_at IS NOT NULL")
def trash(spark: SparkSession, d: str) -> DataFrame:
    return library.trash(lib(spark, d)).select("id", "deleted_at", "category_name")


@query("notes_rows", "SELECT id, title, authors, notes, updated_at FROM papers WHERE deleted_at IS NULL AND trim(notes, ' ') <> ''")
def notes_rows(spark: SparkSession, d: str) -> DataFrame:
    return library.noted(table(spark, d, "papers"))


@query("annotations_sorted", "SELECT paper_id, id, page, row_number() OVER (PARTITION BY paper_id ORDER BY page, id, created_at, quote, note) AS place FROM annotations")
def annotations_sorted(spark: SparkSession, d: str) -> DataFrame:
    return library.annotations_of(table(spark, d, "annotations")).select("paper_id", "id", "page", F.col("place").cast("long").alias("place"))


@query("backfilled", """SELECT id, CASE WHEN read AND coalesce(status, '') <> 'read' THEN 'read' ELSE status END AS status,
CASE WHEN notes_updated_at IS NULL AND coalesce(notes, '') <> '' THEN updated_at ELSE notes_updated_at END AS notes_updated_at FROM papers""")
def backfilled(spark: SparkSession, d: str) -> DataFrame:
    return library.backfilled(table(spark, d, "papers")).select("id", "status", "notes_updated_at")


_NORM = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}} ]', '', 'g'), ' +', ' ', 'g'), ' ')"


@query("title_keys", f"SELECT id, {_NORM.format('title')} AS title_key, trim(split_part(authors, ',', 1), ' ') AS first_author FROM papers")
def title_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select("id", T.normalize_title("title").alias("title_key"), T.first_author("authors").alias("first_author"))


@query("duplicates", f"""WITH l AS (SELECT id, lower(regexp_replace(trim(doi, ' '), '(?i)^(https?://(dx\\.)?doi\\.org/|doi:\\s*)', '')) AS doi, {_NORM.format('title')} AS t, trim(split_part(authors, ',', 1), ' ') AS a FROM papers WHERE deleted_at IS NULL),
x AS (SELECT l.id, min(m.id) AS other, 1 AS rank, 'doi' AS how FROM l JOIN l m ON l.doi = m.doi AND l.id <> m.id WHERE l.doi <> '' GROUP BY l.id
UNION ALL SELECT l.id, min(m.id), 2, 'title' FROM l JOIN l m ON l.t = m.t AND l.a = m.a AND l.id <> m.id WHERE l.t <> '' AND l.a <> '' GROUP BY l.id)
SELECT id, arg_min(other, rank) AS duplicate_of, arg_min(how, rank) AS "by" FROM x GROUP BY id""")
def duplicates(spark: SparkSession, d: str) -> DataFrame:
    return resolve.duplicates(table(spark, d, "papers"))


_SET = "list_distinct(regexp_extract_all(lower(trim(title, ' ')), '[\\p{L}\\p{N}]+'))"


@query("similar_titles", f"""WITH s AS (SELECT id, {_SET} AS t FROM papers WHERE title IS NOT NULL), q AS (SELECT * FROM s WHERE id % 50 = 0 AND len(t) > 0), r AS (SELECT * FROM s WHERE len(t) > 0),
p AS (SELECT q.id AS id_a, r.id AS id_b, len(list_intersect(q.t, r.t)) AS c, len(q.t) + len(r.t) AS n FROM q JOIN r ON q.id <> r.id AND len(list_intersect(q.t, r.t)) > 0)
SELECT id_a, id_b, round(c / (n - c), 9) AS overlap FROM p WHERE c / (n - c) >= 0.7""")
def similar_titles(spark: SparkSession, d: str) -> DataFrame:
    """A stated query set (every id divisible by 50) against all rows."""
    p = table(spark, d, "papers")
    return resolve.similar_titles(p.where("id % 50 = 0"), p, 0.7).withColumn("overlap", F.round("overlap", 9))


@query("title_scores", f"""WITH s AS (SELECT id, lower(trim(title, ' ')) AS a, lower(trim(summary, ' ')) AS b FROM papers WHERE title IS NOT NULL AND summary IS NOT NULL), k AS (SELECT *, list_distinct(regexp_extract_all(a, '[\\p{{L}}\\p{{N}}]+')) AS x, list_distinct(regexp_extract_all(b, '[\\p{{L}}\\p{{N}}]+')) AS y FROM s)
SELECT id, round(CASE WHEN len(x) + len(y) = 0 THEN 0 ELSE len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) END, 9) AS jaccard,
round(CASE WHEN a = '' OR b = '' THEN 0 WHEN contains(a, b) OR contains(b, a) THEN 1 WHEN len(x) = 0 THEN 0 ELSE len(list_intersect(x, y)) / len(x) END, 9) AS contained FROM k""")
def title_scores(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papers").where("title is not null and summary is not null")
    return p.select("id", F.round(T.title_overlap("title", "summary"), 9).alias("jaccard"), F.round(T.title_contained("title", "summary"), 9).alias("contained"))


@query("title_plausible", """SELECT id, length(trim(title, ' ')) BETWEEN 8 AND 300 AND NOT (contains(lower(title), 'http://') OR contains(lower(title), 'https://') OR contains(lower(title), 'www.') OR contains(lower(title), 'doi.org') OR contains(lower(title), 'arxiv:'))
AND length(regexp_replace(trim(title, ' '), '[^\\p{L}\\p{Nd}]', '', 'g')) >= length(trim(title, ' ')) * 0.45 AS plausible, CAST(len(list_distinct(regexp_extract_all(lower(trim(title, ' ')), '[\\p{L}\\p{N}]+'))) AS INTEGER) AS n_tokens FROM papers WHERE title IS NOT NULL""")
def title_plausible(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").where("title is not null").select("id", T.title_plausible("title").alias("plausible"), F.size(T.title_tokens("title")).alias("n_tokens"))


_BOTH = "coalesce(doi, '') || ' ' || coalesce(summary, '')"


@query("sniff_doi", f"""WITH t AS (SELECT id, substr({_BOTH}, 1, 16384) AS h FROM papers), m AS (SELECT id, regexp_extract(h, '(?i)(?:https?://doi\\.org/|doi:\\s*)(10\\.[0-9]{{4,9}}/[^\\s]+)', 1) AS a, regexp_extract(h, '10\\.[0-9]{{4,9}}/[^\\s]+') AS b FROM t)
SELECT id, regexp_replace(CASE WHEN a <> '' THEN a ELSE b END, '[.,;:)\\]}}"'']+$', '') AS found FROM m""")
def sniff_doi(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select("id", T.sniff_doi(F.concat(F.coalesce("doi", F.lit("")), F.lit(" "), F.coalesce("summary", F.lit("")))).alias("found"))


_LINE = """length(s) BETWEEN 4 AND 300 AND NOT (contains(lower(s), 'arxiv:') OR contains(lower(s), 'doi:') OR contains(lower(s), 'doi.org') OR contains(lower(s), 'http://') OR contains(lower(s), 'https://') OR contains(lower(s), 'www.') OR contains(lower(s), '©') OR contains(lower(s), 'copyright') OR contains(lower(s), 'isbn') OR contains(lower(s), 'issn'))
AND NOT regexp_matches(lower(s), '^(abstract|contents|table of contents|references|acknowledg|keywords|index terms|vol\\.|no\\. |introduction|conclusion|related work|摘要|关键词|参考文献|目录|附录|page [0-9])') AND length(regexp_replace(s, '[^a-zA-Z0-9\\x{80}-\\x{10FFFF}]', '', 'g')) >= length(s) * """


@query("sniff_title", f"""WITH l AS (SELECT doc_id, coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s, ' ')), lambda s: length(s) BETWEEN 8 AND 200 AND NOT regexp_matches(s, '^\\p{{Nd}}') AND NOT regexp_matches(lower(s), '^(doi|copyright|abstract|http|www|arxiv:|@|©)')
AND NOT (contains(lower(s), 'http://') OR contains(lower(s), 'https://') OR contains(lower(s), 'www.') OR contains(lower(s), 'doi.org') OR contains(lower(s), 'arxiv:')) AND length(regexp_replace(s, '[^\\p{{L}}\\p{{Nd}}]', '', 'g')) >= length(s) * 0.45)[1], '') AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_id, s AS title, {_LINE}0.5 AS is_line, CASE WHEN NOT regexp_matches(lower(s), 'appendix|untitled|unknown|microsoft word|powerpoint|layout|print|slide|\\.doc|\\.pdf|\\.tex') AND (contains(s, ' ') OR length(s) >= 12) AND {_LINE}0.4 THEN s ELSE '' END AS info FROM l""")
def sniff_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.sniff_title("text").alias("title"), T.plausible_line(T.sniff_title("text")).alias("is_line"), T.info_title(T.sniff_title("text")).alias("info"))


@query("clean_names", r"SELECT id, trim(translate(regexp_replace(regexp_extract(pdf_path, '([^/]*)/*$', 1), '\.[^.]*$', ''), '_-.', '   '), ' ') AS name FROM papers")
def clean_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select("id", T.clean_title("pdf_path").alias("name"))


@query("clean_text", r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\s+-\s*', '-', 'g'), '\(\s+', '(', 'g'), '\s+\)', ')', 'g'), '\[\s+([^\]]+?)\s+\]', '[\1]', 'g'), '\s+([,.;!?])', '\1', 'g'), '\s+:([^:]|$)', ':\1', 'g'), '[ \t]+', ' ', 'g') AS cleaned FROM documents WHERE text IS NOT NULL""")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.clean_text("text").alias("cleaned"))


@query("normalize_text", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \t\r\f\v]+', ' ', 'g'), '\n[ \n]*', chr(10), 'g'), '^\s+|\s+$', '', 'g'), ' ') AS normalised FROM documents WHERE text IS NOT NULL""")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.normalize_text("text").alias("normalised"))


@query("csv_lists", r"""SELECT id, array_to_string(list_filter(list_transform(string_split(keywords, ','), lambda x: trim(x, ' ')), lambda x: x <> ''), '|') AS vals, CAST(len(list_filter(list_transform(string_split(doi, ','), lambda x: trim(x, ' ')), lambda x: regexp_full_match(x, '[+-]?\d{1,18}'))) AS INTEGER) AS n_ids FROM papers WHERE keywords IS NOT NULL AND doi IS NOT NULL""")
def csv_lists(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").where("keywords is not null and doi is not null").select("id", F.array_join(T.csv_values("keywords"), "|").alias("vals"), F.size(T.csv_ids("doi")).alias("n_ids"))


@query("html_escaped", """SELECT id, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped, CASE WHEN regexp_matches(trim(link, ' '), '(?i)^(https?://|mailto:|/|#)') THEN trim(link, ' ') ELSE '' END AS url FROM papers WHERE title IS NOT NULL AND link IS NOT NULL""")
def html_escaped(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").where("title is not null and link is not null").select("id", T.html_escape("title").alias("escaped"), T.safe_url("link").alias("url"))


_MARKED = "replace(replace(replace(regexp_replace(translate({0}, '~^' || chr(92), chr(1) || chr(2) || chr(3)), '([&%$#_{{}}])', chr(92) || chr(92) || chr(92) || '1', 'g'), chr(1), '{{' || chr(92) || '~}}'), chr(2), '{{' || chr(92) || '^{{}}}}'), chr(3), chr(92) || 'textbackslash{{}}')"
_WORDS = "list_filter(string_split_regex(trim({0}, ' '), '\\s+'), lambda x: x <> '')"
_TURNED = f"CASE WHEN len({_WORDS}) <= 1 THEN trim({{0}}, ' ') ELSE {_WORDS}[-1] || ', ' || array_to_string({_WORDS}[1:-2], ' ') END"
_NAMES = f"array_to_string(list_transform(list_filter(list_transform(string_split(a, ','), lambda n: trim(n, ' ')), lambda n: n <> ''), lambda n: {_TURNED.format('n')}), ' and ')"


@query("bibtex", f"""WITH p AS (SELECT id, coalesce(title, '') AS t, coalesce(authors, '') AS a, coalesce(year, 0) AS y, coalesce(venue, '') AS v, coalesce(doi, '') AS d FROM papers WHERE deleted_at IS NULL),
k AS (SELECT *, CASE WHEN trim(a, ' ') <> '' THEN regexp_replace(split_part({_TURNED.format("split_part(a, ',', 1)")}, ',', 1), '[^A-Za-z0-9]', '', 'g') ELSE '' END AS family, {_NAMES} AS names FROM p)
SELECT id, '@' || (CASE WHEN v <> '' THEN 'article' ELSE 'misc' END) || '{{' || (CASE WHEN family <> '' THEN family ELSE 'paper' || id END) || (CASE WHEN y > 0 THEN CAST(y AS VARCHAR) ELSE '' END) || ',' || chr(10)
|| '  title = {{' || {_MARKED.format('t')} || '}},' || chr(10) || (CASE WHEN trim(a, ' ') <> '' THEN '  author = {{' || {_MARKED.format('names')} || '}},' || chr(10) ELSE '' END)
|| (CASE WHEN y > 0 THEN '  year = {{' || y || '}},' || chr(10) ELSE '' END) || (CASE WHEN v <> '' THEN '  journal = {{' || {_MARKED.format('v')} || '}},' || chr(10) ELSE '' END) || (CASE WHEN d <> '' THEN '  doi = {{' || {_MARKED.format('d')} || '}},' || chr(10) ELSE '' END) || '}}' || chr(10) AS entry FROM k""")
def bibtex(spark: SparkSession, d: str) -> DataFrame:
    return exports.bibtex(library.live(table(spark, d, "papers")))


@query("note_sections", r"""SELECT id, '## ' || trim(coalesce(title, ''), ' ') || chr(10) || chr(10) || (CASE WHEN trim(coalesce(authors, ''), ' ') <> '' THEN trim(authors, ' ') || '  ' || chr(10) ELSE '' END) || '> 最后修改：' || coalesce(strftime(updated_at, '%Y-%m-%d %H:%M'), '') || chr(10) || chr(10) || trim(notes, ' ') || chr(10) || chr(10) || '---' || chr(10) || chr(10) AS section
FROM papers WHERE deleted_at IS NULL AND trim(notes, ' ') <> ''""")
def note_sections(spark: SparkSession, d: str) -> DataFrame:
    return exports.note_sections(table(spark, d, "papers")).select("id", "section")


@query("single_notes", """WITH p AS (SELECT *, concat_ws(' · ', nullif(authors, ''), CASE WHEN year > 0 THEN CAST(year AS VARCHAR) END, nullif(venue, '')) AS meta, trim(coalesce(notes, ''), ' ') AS n FROM papers)
SELECT id, '# ' || coalesce(nullif(title, ''), '未命名论文') || chr(10) || chr(10) || (CASE WHEN meta <> '' THEN meta || chr(10) || chr(10) ELSE '' END) || '> 最后修改：' || coalesce(strftime(updated_at, '%Y-%m-%d %H:%M'), '未知') || chr(10) || chr(10) || (CASE WHEN n <> '' THEN n ELSE '（空）' END) AS markdown FROM p""")
def single_notes(spark: SparkSession, d: str) -> DataFrame:
    return exports.single_note(table(spark, d, "papers"))


@query("annotation_lines", r"""SELECT id, paper_id, page, '- （第 ' || CAST(greatest(coalesce(page, 1), 1) AS VARCHAR) || ' 页）> ' || trim(regexp_replace(coalesce(quote, ''), '\s+', ' ', 'g'), ' ') || (CASE WHEN coalesce(note, '') <> '' THEN chr(10) || '  - 备注：' || note ELSE '' END) AS line FROM annotations""")
def annotation_lines(spark: SparkSession, d: str) -> DataFrame:
    return exports.annotation_lines(table(spark, d, "annotations"))


_REFS = "(SELECT paper_id, tag_id AS ref, tag_id AS pos FROM (SELECT DISTINCT paper_id, tag_id FROM paper_tags))"


def _refs(spark: SparkSession, d: str) -> DataFrame:
    """Tags stand for cited works: the test tables have no references."""
    return table(spark, d, "paper_tags").distinct().select("paper_id", F.col("tag_id").alias("ref"), F.col("tag_id").alias("pos"))


@query("graph_edges", f"""WITH r AS (SELECT paper_id, ref, row_number() OVER (PARTITION BY paper_id ORDER BY pos, ref) AS n FROM {_REFS}), t AS (SELECT * FROM r WHERE n <= 2),
f AS (SELECT ref FROM (SELECT ref, min((paper_id, n)) AS came FROM t GROUP BY ref) ORDER BY came, ref LIMIT 60) SELECT DISTINCT 'lib-' || paper_id AS source, 'ext-' || ref AS target FROM t WHERE ref IN (SELECT ref FROM f)""")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(_refs(spark, d), per_paper=2, most=60)


@query("graph_nodes", f"""WITH r AS (SELECT paper_id, ref, row_number() OVER (PARTITION BY paper_id ORDER BY pos, ref) AS n FROM {_REFS}), t AS (SELECT * FROM r WHERE n <= 15), f AS (SELECT ref FROM (SELECT ref, min((paper_id, n)) AS came FROM t GROUP BY ref) ORDER BY came, ref LIMIT 150)
SELECT 'lib-' || id AS id, title, year, venue, doi, true AS in_library FROM papers WHERE deleted_at IS NULL UNION ALL SELECT 'ext-' || f.ref, coalesce(tags.name, ''), 0, '', '', false FROM f LEFT JOIN tags ON tags.id = f.ref""")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    titles = table(spark, d, "tags").select(F.col("id").alias("ref"), F.col("name").alias("title"))
    return graph.nodes(library.live(table(spark, d, "papers")), graph.edges(_refs(spark, d)), titles)


@query("refs_per_paper", f"SELECT paper_id, ref FROM (SELECT paper_id, ref, row_number() OVER (PARTITION BY paper_id ORDER BY pos, ref) AS n FROM {_REFS}) WHERE n <= 15")
def refs_per_paper(spark: SparkSession, d: str) -> DataFrame:
    e = graph.edges(_refs(spark, d), most=None)
    return e.select(F.substring("source", 5, 30).cast("long").alias("paper_id"), F.substring("target", 5, 30).cast("long").alias("ref"))


@query("rects_valid", """SELECT id, paper_id, created_at, coalesce(len(rects) > 0 AND len(list_filter(rects, lambda r: NOT (r.p >= 1 AND r.w > 0 AND r.h > 0 AND r.x >= 0 AND r.y >= 0 AND r.x + r.w <= 1.001 AND r.y + r.h <= 1.001))) = 0, false) AS ok,
CASE WHEN color IN ('yellow','green','blue','pink') THEN color ELSE 'yellow' END AS color, CASE WHEN kind IN ('highlight','note') THEN kind ELSE 'highlight' END AS kind FROM annotations""")
def rects_valid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "annotations").select("id", "paper_id", "created_at", rects.valid(F.col("rects")).alias("ok"), rects.colour(F.col("color")).alias("color"), rects.kind(F.col("kind")).alias("kind"))


@query("rects_merged", """WITH RECURSIVE a AS (SELECT row_number() OVER () AS k, id, rects FROM annotations), u AS (SELECT k, id, unnest(rects) AS r FROM a), o AS (SELECT k, id, r.p AS p, r.y AS y, r.x AS x, r.w AS w, r.h AS h, row_number() OVER (PARTITION BY k ORDER BY r.p, r.y, r.x, r.w, r.h) AS n FROM u),
s AS (SELECT k, id, n, p, y, x, w, h, 1 AS run FROM o WHERE n = 1 UNION ALL SELECT o.k, o.id, o.n, o.p, CASE WHEN j THEN s.y ELSE o.y END, CASE WHEN j THEN least(s.x, o.x) ELSE o.x END, CASE WHEN j THEN greatest(s.x + s.w, o.x + o.w) - least(s.x, o.x) ELSE o.w END, CASE WHEN j THEN s.h ELSE o.h END, CASE WHEN j THEN s.run ELSE s.run + 1 END
FROM s JOIN o ON o.k = s.k AND o.n = s.n + 1, LATERAL (SELECT s.p = o.p AND abs(s.y - o.y) < 0.004 AND abs(s.h - o.h) < 0.004 AND o.x <= s.x + s.w + 0.01 AS j) z), f AS (SELECT *, row_number() OVER (PARTITION BY k, run ORDER BY n DESC) AS last FROM s)
SELECT id, CAST(run AS INTEGER) AS place, p, round(x, 9) AS x, round(y, 9) AS y, round(w, 9) AS w, round(h, 9) AS h FROM f WHERE last = 1""")
def rects_merged(spark: SparkSession, d: str) -> DataFrame:
    """The rectangles of each annotation after joining, also those that leave the page, through their JSON."""
    merged = table(spark, d, "annotations").select("id", F.posexplode(rects.merge(rects.from_json(F.to_json("rects")))).alias("n", "r"))
    return merged.select("id", (F.col("n") + 1).alias("place"), "r.p", *(F.round(f"r.{c}", 9).alias(c) for c in "xywh"))


@query("json_values", """SELECT event_id, props AS object, props AS repaired, json_extract_string(props, '$.k') AS k FROM events""")
def json_values(spark: SparkSession, d: str) -> DataFrame:
    """Values of events.props, also from answers that wrap or cut the object."""
    e = table(spark, d, "events")
    wrapped = F.concat(F.lit("Here it is: "), F.col("props"), F.lit(" - done}"))
    cut = F.concat(F.rtrim(F.expr("substring(props, 1, length(props) - 1)")), F.lit(', "rest": "cu'))
    return e.select("event_id", jsonx.extract_object(wrapped).alias("object"), jsonx.repair_object(cut).alias("repaired"), jsonx.flex_string(F.get_json_object("props", "$.k")).alias("k"))


@query("json_roundtrip", """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events""")
def json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", jsonx.flex_string(F.get_json_object("props", "$.k")).try_cast("double").alias("k"))


@query("model_list", """SELECT id, CASE WHEN trim(coalesce(name, ''), ' ') <> '' THEN trim(name, ' ') ELSE id END AS name, context_length FROM (SELECT trim(id, ' ') AS id, name, context_length, row_number() OVER (PARTITION BY trim(id, ' ') ORDER BY context_length, name) AS n FROM models
WHERE trim(id, ' ') <> '' AND (supported_protocols IS NULL OR len(supported_protocols) = 0 OR len(list_filter(supported_protocols, lambda p: trim(p, ' ') = 'chat')) > 0)) WHERE n = 1""")
def model_list_(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "models").withColumn("place", F.struct("context_length", F.col("name")))
    return model_list.usable(m, "place", ("chat",))


@query("markdown_html")
def markdown_html(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", markdown.to_html(F.col("text")).alias("html"))


@query("soft_deleted", "SELECT id, CASE WHEN category_id = 3 AND deleted_at IS NULL THEN TIMESTAMP '2025-06-30 00:00:00' ELSE deleted_at END AS deleted_at FROM papers")
def soft_deleted(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papers")
    return mutate.soft_deleted(p, library.live(p).where("category_id = 3").select("id"), NOW).select("id", "deleted_at")


@query("restored", "SELECT id, CASE WHEN starred THEN NULL ELSE deleted_at END AS deleted_at FROM papers")
def restored(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papers")
    return mutate.restored(p, p.where("deleted_at is not null and starred").select("id")).select("id", "deleted_at")


@query("purged", """SELECT 'paper_tags' AS part, paper_id AS id, count(*) AS n FROM paper_tags WHERE paper_id NOT IN (SELECT id FROM papers WHERE deleted_at IS NOT NULL) GROUP BY paper_id
UNION ALL SELECT 'annotations', paper_id, count(*) FROM annotations WHERE paper_id NOT IN (SELECT id FROM papers WHERE deleted_at IS NOT NULL) GROUP BY paper_id
UNION ALL SELECT 'papers', id, 1 FROM papers WHERE deleted_at IS NULL UNION ALL SELECT 'files', 0, count(*) FROM papers WHERE deleted_at IS NOT NULL AND pdf_path <> ''""")
def purged(spark: SparkSession, d: str) -> DataFrame:
    p, children, files = mutate.purged(table(spark, d, "papers"), {n: table(spark, d, n) for n in ("paper_tags", "annotations")})
    out = p.select(F.lit("papers").alias("part"), "id", F.lit(1).cast("long").alias("n"))
    for n, c in children.items():
        out = out.union(c.groupBy("paper_id").agg(F.count("*")).select(F.lit(n), "paper_id", "count(1)"))
    return out.union(files.agg(F.count("*")).select(F.lit("files"), F.lit(0).cast("long"), "count(1)"))


@query("patched", """SELECT id, CASE WHEN hit THEN upper(title) ELSE title END AS title, CASE WHEN hit AND year % 2 = 0 THEN 'seen' ELSE notes END AS notes, CASE WHEN hit THEN 'reading' ELSE status END AS status, CASE WHEN hit THEN false ELSE read END AS read,
CASE WHEN hit AND year % 2 = 0 AND 'seen' IS DISTINCT FROM notes THEN TIMESTAMP '2025-06-30 00:00:00' ELSE notes_updated_at END AS notes_updated_at, CASE WHEN hit THEN TIMESTAMP '2025-06-30 00:00:00' ELSE updated_at END AS updated_at
FROM (SELECT *, coalesce(category_id = 2, false) AND title IS NOT NULL AS hit FROM papers)""")
def patched(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papers")
    patch = p.where("category_id = 2 and title is not null").select("id", F.upper("title").alias("title"), F.when(F.col("year") % 2 == 0, "seen").alias("notes"), F.lit("reading").alias("status"))
    return mutate.patched(p, patch, NOW).select("id", "title", "notes", "status", "read", "notes_updated_at", "updated_at")


@query("next_states", "SELECT id, CASE status WHEN 'unread' THEN 'reading' WHEN 'reading' THEN 'read' ELSE 'unread' END AS status FROM papers")
def next_states(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select("id", mutate.next_state(F.col("status")).alias("status"))


@query("tags_changed", """SELECT paper_id, tag_id FROM (SELECT paper_id, tag_id FROM paper_tags UNION SELECT id, 1 FROM papers WHERE starred) WHERE NOT (tag_id = 2 AND paper_id IN (SELECT id FROM papers WHERE deleted_at IS NOT NULL))""")
def tags_changed(spark: SparkSession, d: str) -> DataFrame:
    p, links = table(spark, d, "papers"), table(spark, d, "paper_tags")
    added = mutate.related_added(links, p.where("starred").select(F.col("id").alias("paper_id"), F.lit(1).cast("long").alias("tag_id")))
    return mutate.related_removed(added, p.where("deleted_at is not null").select(F.col("id").alias("paper_id"), F.lit(2).cast("long").alias("tag_id")))


@query("category_deleted", "SELECT id, CASE WHEN category_id IS DISTINCT FROM 1 THEN category_id END AS category_id FROM papers")
def category_deleted(spark: SparkSession, d: str) -> DataFrame:
    return mutate.category_deleted(table(spark, d, "categories"), table(spark, d, "papers"), 1)[1].select("id", "category_id")


@query("tag_deleted", "SELECT paper_id, tag_id FROM paper_tags WHERE tag_id <> 1")
def tag_deleted(spark: SparkSession, d: str) -> DataFrame:
    return mutate.dimension_deleted(table(spark, d, "tags"), table(spark, d, "paper_tags"), "tag_id", 1)[1]


@query("settings_upserted", "SELECT event_type AS key, arg_max(props, ts) AS value, max(ts) AS updated_at FROM (SELECT event_type, props, ts, row_number() OVER (PARTITION BY event_type, ts ORDER BY props DESC) AS n FROM events) WHERE n = 1 GROUP BY event_type")
def settings_upserted(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").groupBy(F.col("event_type").alias("key"), F.col("ts").alias("updated_at")).agg(F.max("props").alias("value")).select("key", "value", "updated_at")
    return mutate.upserted(s.where(F.lit(False)), s)


@query("enriched", """WITH d AS (SELECT *, lower(regexp_replace(trim(doi, ' '), '(?i)^(https?://(dx\\.)?doi\\.org/|doi:\\s*)', '')) AS k FROM papers), c AS (SELECT k, min((id, title, year, venue)) AS e FROM d WHERE title <> '' GROUP BY 1), j AS (SELECT p.id, p.title, c.e[1] AS eid, c.e[2] AS ft, c.e[3] AS fy, c.e[4] AS fv,
list_distinct(regexp_extract_all(lower(trim(p.title, ' ')), '[\\p{L}\\p{N}]+')) AS x, list_distinct(regexp_extract_all(lower(trim(c.e[2], ' ')), '[\\p{L}\\p{N}]+')) AS y FROM d p LEFT JOIN c ON c.k = p.k AND c.k <> ''),
m AS (SELECT *, ft IS NOT NULL AND coalesce(length(trim(title, ' ')) BETWEEN 8 AND 300 AND length(regexp_replace(trim(title, ' '), '[^\\p{L}\\p{Nd}]', '', 'g')) >= length(trim(title, ' ')) * 0.45 AND len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) < 0.5, false) AS bad FROM j)
SELECT id, CASE WHEN bad THEN NULL ELSE ft END AS found_title, CASE WHEN bad THEN NULL ELSE fy END AS found_year FROM m""")
def enriched(spark: SparkSession, d: str) -> DataFrame:
    """The library's own rows serve as the catalogue: the smallest id of a DOI is its entry."""
    p = table(spark, d, "papers")
    return resolve.enrich_by_doi(p.select("id", "title", "doi"), p.select("doi", "title", "year", "venue", F.col("id").alias("source_rank"))).select("id", "found_title", "found_year")


@query("filled", "SELECT id, CASE WHEN trim(coalesce(venue, ''), ' ') <> '' THEN venue ELSE coalesce(nullif(trim(c.name, ' '), ''), venue) END AS venue FROM papers LEFT JOIN (SELECT id AS cid, name FROM categories) c ON c.cid = category_id")
def filled(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papers")
    names = library.with_category(p.select("id", "category_id"), table(spark, d, "categories")).select("id", F.col("category_name").alias("venue"))
    return resolve.filled(p.select("id", "venue"), names, fields=("venue",))


@query("abstract_rebuilt", "SELECT id, array_to_string(string_split_regex(trim(summary, ' '), ' +'), ' ') AS abstract FROM papers WHERE trim(summary, ' ') <> ''")
def abstract_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Summaries as inverted indexes, as catalogues give abstracts, and back."""
    words = table(spark, d, "papers").where(F.trim("summary") != "").select("id", F.posexplode(F.split(F.trim("summary"), " +")).alias("pos", "word"))
    index = words.groupBy("id", "word").agg(F.collect_list("pos").alias("places")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("word", "places"))).alias("index"))
    return index.select("id", T.abstract_of_index("index").alias("abstract"))


@query("times_parsed", "SELECT id, created_at AS iso, created_at AS plain, TIMESTAMP '2000-01-01' + INTERVAL 1 DAY > created_at AS old FROM papers")
def times_parsed(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papers")
    at = lambda f: T.parse_time(F.date_format("created_at", f)).cast("timestamp_ntz")
    return p.select("id", at("yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), at("yyyy-MM-dd HH:mm:ss").alias("plain"), (at("yyyy-MM-dd HH:mm:ss") < F.lit("2000-01-02").cast("timestamp_ntz")).alias("old"))


@query("unique_names", "SELECT name, count(*) > 1 AS taken FROM tags GROUP BY name")
def unique_names(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tags")
    return mutate.ensured(t, t.select(F.concat(F.lit(" "), "name").alias("name"))).groupBy("name").agg((F.count("*") > 1).alias("taken"))


_ASKED = ("how", "does", "a", "graph", "kernel", "handle", "glaciers")
_NEXT = lambda at: "(SELECT min(x) FROM (VALUES " + ", ".join(f"(nullif(instr(substr(low, {at} + 1), '{t}'), 0) + {at})" for t in _ASKED) + ") v(x))"
_WINDOW = lambda h: f"greatest({h} - 251, 0)"
_ANSWER = f"""WITH f AS (SELECT *, row_number() OVER (ORDER BY year DESC, id DESC) AS rank FROM papers WHERE deleted_at IS NULL AND ({' OR '.join(_ANY(f'%{t}%') for t in _ASKED)})), b AS (SELECT *, coalesce(fulltext, '') AS ft, lower(coalesce(fulltext, '')) AS low FROM f WHERE rank <= 3),
h1 AS (SELECT *, {_NEXT('0')} AS a FROM b), h2 AS (SELECT *, {_NEXT(f"least({_WINDOW('a')} + 500, length(ft))")} AS b2 FROM h1), h3 AS (SELECT *, {_NEXT(f"least({_WINDOW('b2')} + 500, length(ft))")} AS c FROM h2),
e AS (SELECT *, concat_ws(chr(10) || '…' || chr(10), {', '.join(f"CASE WHEN {h} IS NOT NULL THEN trim(substr(ft, {_WINDOW(h)} + 1, least({_WINDOW(h)} + 500, length(ft)) - {_WINDOW(h)}), ' ') END" for h in ('a', 'b2', 'c'))}) AS win FROM h3), x AS (SELECT *, left(CASE WHEN win <> '' THEN win ELSE left(ft, 800) END, 1800) AS excerpt FROM e),
s AS (SELECT CAST(rank AS INTEGER) AS rank, id, title, left(excerpt, 1000) AS excerpt, '[' || id || '] ' || coalesce(title, '') || (CASE WHEN year > 0 THEN ' (' || year || ')' ELSE '' END) || chr(10) || coalesce(authors, '') || (CASE WHEN coalesce(summary, '') <> '' THEN chr(10) || left(summary, 800) ELSE '' END) || (CASE WHEN excerpt <> '' THEN chr(10) || excerpt ELSE '' END) AS block, false AS fallback FROM x)"""


@query("answer_sources", f"{_ANSWER} SELECT * FROM s")
def answer_sources(spark: SparkSession, d: str) -> DataFrame:
    return search.sources(table(spark, d, "papers"), "How does a graph kernel handle glaciers?", 3)


@query("answer_prompt", f"{_ANSWER} SELECT string_agg(block, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'How does a graph kernel handle glaciers?' AS prompt, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS cited FROM s")
def answer_prompt(spark: SparkSession, d: str) -> DataFrame:
    return search.prompt(table(spark, d, "papers"), "How does a graph kernel handle glaciers?", 3).withColumn("cited", F.array_join(F.col("cited").cast("array<string>"), ","))
