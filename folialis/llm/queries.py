"""The registered queries of this subpackage: each takes (spark, directory of the tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folialis.llm.bpe import token_ids
from folialis.llm.components import components
from folialis.llm.mojibake import find
from folialis.llm.names import link_papers
from folialis.llm.near_dup import NearDuplicates
from folialis.llm.packing import context_length, context_lengths, pack
from folialis.llm.survivor import FILLERS, choose, credible, doi_edges, usable_doi, usable_venue
from folialis.llm.truncation import rates, score
from folialis.operators.multivalue import split_values
from folialis.sources.storage import written
from folialis.sources.tables import table

#: When the library was copied (a fixed value of the test tables).
COPIED = "2025-06-30 00:00:00"


def near_papers(papers: DataFrame) -> NearDuplicates:
    """Papers by runs of three words of title and full text, half of them in common."""
    return NearDuplicates(papers, "id", "fulltext", "title", shingle=3, threshold=0.5)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return near_papers(table(spark, d, "papers")).pairs().select(F.col("a").alias("paper_id_a"), F.col("b").alias("paper_id_b"))


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    """The links between different texts: pairs of class representatives."""
    return near_papers(table(spark, d, "papers")).links.select(F.col("a").alias("rep_a"), F.col("b").alias("rep_b"))


def p1_members(spark: SparkSession, d: str) -> DataFrame:
    """Each paper with a text, with its class: the smallest id of the same words in the same order."""
    return near_papers(table(spark, d, "papers")).members.select(F.col("id").alias("paper_id"), "rep")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return find(table(spark, d, "papers"), "id", ["title", "fulltext"]).select(F.col("id").alias("paper_id"), "field_name")


def p3_restored(spark: SparkSession, d: str) -> DataFrame:
    """The right text of each garbled field, as far as nothing was lost."""
    return find(table(spark, d, "papers"), "id", ["title", "fulltext"]).withColumnRenamed("id", "paper_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    papers = table(spark, d, "papers")
    authors = split_values(papers, "id", ["authors"]).select(F.col("id").alias("paper_id"), F.lit("author").alias("kind"), F.col("item").alias("name"))
    venues = papers.select(F.col("id").alias("paper_id"), F.lit("venue").alias("kind"), F.col("venue").alias("name"))
    registers = [table(spark, d, f"{k}_register").select(F.lit(k).alias("kind"), "ref_id", "full_name") for k in ("author", "venue")]
    return link_papers(written(authors.union(venues).where(F.trim("name") != ""), "named"), registers[0].union(registers[1]))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    papers = table(spark, d, "papers")
    # values are read once, for the edges and for the choice
    records = written(papers.select("id", usable_doi(F.col("doi")).alias("doi"), usable_venue(F.col("venue")).alias("venue"), "created_at", "updated_at"), "records")
    groups = components(near_papers(papers).edges().union(doi_edges(records.select("id", "doi"))))
    rows = records.join(groups, "id")
    values = {"doi": F.col("doi"), "venue": F.col("venue")}
    trust = credible(F.col("updated_at"), F.col("created_at"), COPIED)
    return choose(rows, "component", "id", values, F.col("updated_at"), trust, now=COPIED).withColumnRenamed("component", "group_id")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return token_ids(table(spark, d, "documents"), "doc_id", "text")


def p7_prompts(spark: SparkSession, d: str, entry: str | None = None) -> DataFrame:
    """The documents in prompts for the entries of models, each prompt for the first entry of its context length; or for one entry alone."""
    models = table(spark, d, "models")
    entries = {context_length(models, entry): entry} if entry else context_lengths(models)
    names = F.create_map(*(F.lit(x) for pair in entries.items() for x in pair))
    return pack(table(spark, d, "documents"), "doc_id", "text", list(entries)).withColumn("model", F.element_at(names, F.col("context_length")))


def p7_held(spark: SparkSession, d: str) -> DataFrame:
    """One row: what holds of p7_prompts for any documents: each is there once and whole, none is split that a prompt could hold, no prompt is over its model's length, and little room is left."""
    rows = written(p7_prompts(spark, d), "prompts")
    documents = table(spark, d, "documents")
    models = table(spark, d, "models").select(F.trim("id").alias("model"), F.col("context_length").alias("own"))
    longest = models.agg(F.max("own")).head()[0]
    per = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("piece").alias("last"), F.sum("n_tokens").alias("tokens"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"), F.countDistinct("piece").alias("pieces"))
    prompts = rows.groupBy("prompt_id", "model", "context_length").agg(F.sum("n_tokens").alias("tokens"))
    full = prompts.join(models.distinct(), ["model"]).where("own = context_length")
    # a window of each length may stay nearly empty
    tokens = prompts.agg(F.count("*").alias("n_prompts"), F.sum("context_length").alias("room"), F.sum("tokens").alias("tokens"), F.count_if(F.col("tokens") > F.col("context_length")).alias("n_over"))
    wasted = (F.col("room") - F.col("tokens")) > 0.03 * F.col("tokens") + 2 * longest
    one = per.agg(F.count("*").alias("n_documents"), F.count_if((F.col("n") != F.col("last")) | (F.col("pieces") != F.col("n")) | (F.col("tokens") != F.col("end"))).alias("n_broken"), F.count_if((F.col("n") > 1) & (F.col("tokens") <= longest)).alias("n_split"))
    missing = documents.select("doc_id").join(rows, "doc_id", "left_anti").agg(F.count("*").alias("n_missing"))
    # one row each, so this joins single rows
    joined = one.join(missing).join(tokens).join(full.agg(F.count("*").alias("n_fitting")))
    return joined.select("n_documents", "n_missing", "n_broken", "n_split", "n_over", (F.col("n_fitting") != F.col("n_prompts")).alias("wrong_model"), wasted.alias("wasteful"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return score(table(spark, d, "documents"), "doc_id", "text", "source").where("is_cut").select(F.col("id").alias("doc_id"))


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each source cuts its texts."""
    return rates(score(table(spark, d, "documents"), "doc_id", "text", "source"))


QUERIES = {"p1_found": p1_found, "p1_links": p1_links, "p1_members": p1_members, "p3_found": p3_found, "p3_restored": p3_restored, "p4_found": p4_found, "p5_found": p5_found, "p6_ids": p6_ids, "p7_prompts": p7_prompts, "p7_held": p7_held, "p8_found": p8_found, "p8_rates": p8_rates}
# Brute force: every pair of texts that share a run of words. It is for the small tables on which the results are compared.
_PAIRS = r"""w AS (SELECT id, regexp_extract_all(regexp_replace(lower(coalesce(title, '') || ' ' || fulltext), '([\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}])', ' \1 ', 'g'), '[\p{L}\p{N}]+') AS k FROM papers WHERE trim(fulltext, ' ') <> ''),
s AS (SELECT id, unnest(list_distinct(list_transform(range(1, len(k) - 1), lambda i: k[i] || ' ' || k[i + 1] || ' ' || k[i + 2]))) AS g FROM w), n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
c AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.id < y.id GROUP BY ALL), pairs AS (SELECT a, b FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 3 * shared >= x.n + y.n)"""
_DOI = r"""d0 AS (SELECT id, regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(doi, '[\x{200B}-\x{200F}\x{2060}\x{FEFF}\x{AD}]', '', 'g'), '(?i)%2f', '/', 'g')), '\s*/\s*', '/', 'g'), '', '') AS t FROM papers),
d1 AS (SELECT id, regexp_replace(regexp_extract(t, '(10\.[0-9][0-9.]*)/([^\s<>"''\[\]{}|?&#]+)'), '[.,;:!)\]>]+$', '') AS doi FROM d0),
dois AS (SELECT id, doi FROM d1 WHERE doi <> '' AND regexp_extract(doi, '^[^/]+/(.*)$', 1) <> '' AND NOT regexp_matches(doi, '^[^/]+/[0x?*._-]*$|^10\.0*/|/to[._-]?be[._-]?(assigned|announced|determined)'))"""
SQL: dict[str, str] = {
    "p7_held": "SELECT count(DISTINCT doc_id) AS n_documents, 0 AS n_missing, 0 AS n_broken, 0 AS n_split, 0 AS n_over, false AS wrong_model, false AS wasteful FROM documents",
    "p1_found": f"WITH {_PAIRS} SELECT a AS paper_id_a, b AS paper_id_b FROM pairs",
    "p1_members": f"WITH {_PAIRS} SELECT id AS paper_id, min(id) OVER (PARTITION BY array_to_string(k, ' ')) AS rep FROM w WHERE len(k) >= 3",
    "p1_links": f"WITH {_PAIRS}, r AS (SELECT min(id) AS rep FROM w GROUP BY array_to_string(k, ' ')) SELECT a AS rep_a, b AS rep_b FROM pairs WHERE a IN (SELECT rep FROM r) AND b IN (SELECT rep FROM r)",
    "p5_found": f"""WITH RECURSIVE {_PAIRS}, {_DOI}, e AS (SELECT a, b FROM pairs UNION SELECT x.id, y.id FROM dois x JOIN dois y ON x.doi = y.doi AND x.id < y.id), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS id, a AS m FROM u UNION SELECT u.b, r.m FROM r JOIN u ON u.a = r.id WHERE r.m < u.b), g AS (SELECT id, min(m) AS group_id FROM r GROUP BY id),
p AS (SELECT g.group_id, p.id, dois.doi, lower(regexp_replace(venue, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS v, CASE WHEN updated_at >= created_at AND updated_at <= TIMESTAMP '{COPIED}' THEN updated_at END AS t FROM g JOIN papers p ON p.id = g.id LEFT JOIN dois ON dois.id = p.id)
SELECT group_id, arg_max(id, (t, -id)) FILTER (t IS NOT NULL AND doi IS NOT NULL) AS doi_from, arg_max(id, (t, -id)) FILTER (t IS NOT NULL AND v <> '' AND v NOT IN ({", ".join(f"'{x}'" for x in FILLERS)})) AS venue_from FROM p GROUP BY group_id""",
}
