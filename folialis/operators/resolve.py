"""Which records are one work, and what a catalogue of works knows about a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folialis.functions import text as T
from folialis.operators.library import live


def duplicates(papers: DataFrame) -> DataFrame:
    """(id, duplicate_of, by): for each live paper the smallest other live paper with the same DOI (case and address aside), else the same title and
    first author. Blank DOIs, titles and authors match nothing.

    The smallest and second smallest id of a key are a partial aggregate, so no pair within a key is formed.
    """
    p = live(papers).select("id", T.bare_doi("doi").alias("doi"), T.normalize_title("title").alias("title"), T.first_author("authors").alias("author"))
    found = None
    for rank, by, keys in ((1, "doi", ["doi"]), (2, "title", ["title", "author"])):
        rows = p
        for k in keys:
            rows = rows.where(F.col(k) != "")
        first = rows.groupBy(*keys).agg(F.min("id").alias("low"), F.count("*").alias("n")).where("n > 1")
        second = rows.join(first, keys).where("id <> low").groupBy(*keys).agg(F.min("id").alias("next"))
        hit = rows.join(first, keys).join(second, keys).select("id", F.when(F.col("id") == F.col("low"), F.col("next")).otherwise(F.col("low")).alias("duplicate_of"), F.lit(by).alias("by"), F.lit(rank).alias("rank"))
        found = hit if found is None else found.union(hit)
    return found.groupBy("id").agg(F.min(F.struct("rank", "duplicate_of", "by")).alias("x")).select("id", "x.duplicate_of", "x.by")


def duplicate_of(papers: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming (key, doi, title, authors) with the live paper that each would duplicate: (key, paper_id, by)."""
    known = live(papers).select(F.col("id").alias("paper_id"), T.bare_doi("doi").alias("d"), T.normalize_title("title").alias("t"), T.first_author("authors").alias("a"))
    new = incoming.select("key", T.bare_doi("doi").alias("d"), T.normalize_title("title").alias("t"), T.first_author("authors").alias("a"))
    by_doi = new.where("d <> ''").join(known.where("d <> ''").groupBy("d").agg(F.min("paper_id").alias("paper_id")), "d").select("key", "paper_id", F.lit("doi").alias("by"), F.lit(1).alias("rank"))
    full = "t <> '' and a <> ''"
    by_title = new.where(full).join(known.where(full).groupBy("t", "a").agg(F.min("paper_id").alias("paper_id")), ["t", "a"]).select("key", "paper_id", F.lit("title").alias("by"), F.lit(2).alias("rank"))
    return by_doi.union(by_title).groupBy("key").agg(F.min(F.struct("rank", "paper_id", "by")).alias("x")).select("key", "x.paper_id", "x.by")


#: Cells in which tokens are counted; titles with one token that meet in one part of a join.
CELLS, HOT = 1 << 16, 50_000


def _keyed(*tables: DataFrame) -> tuple[Column, list[DataFrame]]:
    """The counts of tokens of all tables (title, ...) by cells, and each table with k, its tokens from the rarest on; rows without tokens are left out.

    Tokens of one cell count together and follow the alphabet, so the order is the same everywhere, and the counts are an array of one size for any input.
    """
    sets = [d.withColumn("k", T.title_tokens("title")).where(F.size("k") > 0) for d in tables]
    n = tables[0].sparkSession.range(CELLS).select(F.col("id").alias("cell"), F.lit(0).cast("long").alias("n"))
    for s in sets:
        n = n.union(s.select(F.explode("k").alias("w")).groupBy(_cell("w").cast("long").alias("cell")).agg(F.count("*").alias("n")))
    counts = n.groupBy("cell").agg(F.sum("n").alias("n")).agg(F.array_sort(F.collect_list(F.struct("cell", "n"))).alias("x")).select("x.n").scalar()
    # by a column, as a lambda takes no subquery; the optimizer puts it there, so no row carries the counts
    ranked = F.array_sort(F.transform("k", lambda w: F.struct(F.get("_n", _cell(w)).alias("n"), w.alias("w"))))
    return counts, [s.withColumn("_n", counts).withColumn("k", F.array_join(F.transform(ranked, lambda x: x["w"]), " ")).drop("_n") for s in sets]


def _cell(w: Column | str) -> Column:
    return F.pmod(F.xxhash64(w), F.lit(CELLS)).cast("int")


def _near(left: DataFrame, right: DataFrame, counts: Column, threshold: float) -> DataFrame:
    """(ka, kb, overlap): the pairs of keys k of two keyed tables with a Jaccard similarity of tokens from the threshold, equal keys too, each pair once.

    A prefix join: two sets that reach the threshold share one of the first n - ceil(threshold * n) + 1 tokens of each. A pair is weighed where it meets and
    kept at the first token that both have, so candidates are never written, shuffled or told apart. Bits of the tokens bound the overlap before sets are compared.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies in (0, 1]")
    n = F.size("t")

    def prefixes(d: DataFrame) -> DataFrame:
        bits = F.expr("aggregate(t, 0L, (b, w) -> b | shiftleft(1L, cast(pmod(xxhash64(w), 64L) as int)))")
        first = F.slice("t", F.lit(1), (n - F.ceil(n * F.lit(threshold) - 1e-9) + 1).cast("int"))
        sets = d.select("k").distinct().withColumn("t", F.split("k", " "))
        return sets.select("k", n.alias("n"), bits.alias("bits"), F.explode(first).alias("w")).withColumn("parts", F.floor(F.get(counts, _cell("w")) / HOT).cast("int") + 1)

    # a hot token's right rows are dealt to parts, its left rows go to each
    a = prefixes(left).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("a")
    b = prefixes(right).withColumn("part", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int")).alias("b")

    def ratio(shared: Column) -> Column:
        return shared / (F.col("a.n") + F.col("b.n") - shared)

    only_a, only_b = (F.bit_count(F.col(f"{x}.bits").bitwiseAND(F.bitwise_not(F.col(f"{y}.bits")))) for x, y in ("ab", "ba"))
    most = F.least(F.col("a.n") - only_a, F.col("b.n") - only_b)
    both = F.array_intersect(F.split("a.k", " "), F.split("b.k", " "))
    # in this order: the bound is cheap and leaves few
    meet = (F.col("a.w") == F.col("b.w")) & (F.col("a.part") == F.col("b.part")) & (ratio(most) >= threshold) & (ratio(F.size(both)) >= threshold) & (F.get(both, F.lit(0)) == F.col("a.w"))
    return b.join(a, meet).select(F.col("a.k").alias("ka"), F.col("b.k").alias("kb"), ratio(F.size(both)).alias("overlap"))


def similar_titles(left: DataFrame, right: DataFrame, threshold: float = 0.7, apart: bool = True) -> DataFrame:
    """(id_a, id_b, overlap): pairs of titles (id, title) with a Jaccard similarity of tokens from the threshold; apart: id_a <> id_b.

    Titles of the same tokens are one set while pairs are sought; the pairs of rows come out of the last join.
    """
    counts, (l, r) = _keyed(left.select("id", "title"), right.select("id", "title"))
    pairs = _near(l, r, counts, threshold).join(l.select(F.col("id").alias("id_a"), F.col("k").alias("ka")), "ka").join(r.select(F.col("id").alias("id_b"), F.col("k").alias("kb")), "kb")
    return pairs.where(F.col("id_a") != F.col("id_b") if apart else F.lit(True)).select("id_a", "id_b", "overlap")


def enrich_by_doi(records: DataFrame, catalogue: DataFrame) -> DataFrame:
    """records (id, title, doi) with the catalogue's entry of that DOI (doi, title, year, venue, source_rank).

    Of several entries the lowest source_rank with a title wins. An entry whose title is unlike a plausible title of
    the record is another work's and is left out: null.
    """
    entries = catalogue.where(F.col("title") != "").groupBy(T.bare_doi("doi").alias("k")).agg(F.min(F.struct("source_rank", F.col("title").alias("found_title"), F.col("year").alias("found_year"), F.col("venue").alias("found_venue"))).alias("e"))
    out = records.withColumn("k", T.bare_doi("doi")).join(entries.where("k <> ''"), "k", "left").drop("k")
    unlike = T.title_plausible("title") & (T.title_overlap("title", "e.found_title") < 0.5)
    keep = F.when(~F.coalesce(unlike, F.lit(False)), F.col("e"))
    return out.withColumn("e", keep).select(*records.columns, "e.found_title", "e.found_year", "e.found_venue")


#: The sources that are searched by title, in their order, with the least overlap of an entry and the least score that the source gives it.
TITLE_SOURCES = (("arxiv", 0.55, 0.0), ("crossref", 0.7, 50.0))


def search_by_title(records: DataFrame, catalogue: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(id, entry_id, overlap): the best entry (id, title) for each record (id, title) with a plausible title of three words or more."""
    asked = records.where(T.title_plausible("title") & (F.size(T.title_tokens("title")) >= 3)).select("id", "title")
    counts, (asked, known) = _keyed(asked, catalogue.select("id", "title"))
    # a record leaves out one entry at most, its own, so the two smallest of a set of tokens are enough
    low = known.where("id is not null").select(F.col("id").alias("id_b"), F.col("k").alias("kb"), F.dense_rank().over(Window.partitionBy("k").orderBy("id")).alias("place")).where("place <= 2").drop("place")
    pairs = _near(asked, known, counts, threshold).join(asked.select(F.col("id").alias("id_a"), F.col("k").alias("ka")), "ka").join(low, "kb").where("id_a <> id_b")
    best = pairs.groupBy("id_a").agg(F.min(F.struct((-F.col("overlap")).alias("o"), F.col("id_b").alias("b"))).alias("x"))
    return best.select(F.col("id_a").alias("id"), F.col("x.b").alias("entry_id"), (-F.col("x.o")).alias("overlap"))


def enrich_by_title(records: DataFrame, catalogue: DataFrame, sources: tuple = TITLE_SOURCES) -> DataFrame:
    """(id, found_title, found_year, found_venue, found_doi) of each record (id, title) that a source knows.

    catalogue: (source, pos, score, title, year, venue, doi), pos the order in which a source lists its entries. The first source with an entry of enough
    overlap and score wins, of its entries the first. A record without a plausible title of three words asks nothing.
    """
    asked = records.where(T.title_plausible("title") & (F.size(T.title_tokens("title")) >= 3)).select("id", "title")
    entries = catalogue.withColumn("entry", F.struct("source", "pos"))
    counts, (asked, known) = _keyed(asked, entries.where(F.col("title") != "").select("entry", "source", "score", "title"))
    found = None
    for rank, (source, overlap, score) in enumerate(sources):
        own = known.where((F.col("source") == source) & (F.coalesce("score", F.lit(0.0)) >= score))
        low = own.groupBy(F.col("k").alias("kb")).agg(F.min("entry").alias("entry"))
        near = _near(asked, own, counts, overlap).join(low, "kb").groupBy("ka").agg(F.min("entry").alias("entry"))
        hit = near.join(asked.select("id", F.col("k").alias("ka")), "ka").select("id", F.lit(rank).alias("rank"), "entry")
        found = hit if found is None else found.union(hit)
    first = found.groupBy("id").agg(F.min(F.struct("rank", "entry")).alias("x")).select("id", F.col("x.entry").alias("entry"))
    return first.join(entries, "entry").select("id", F.col("title").alias("found_title"), F.col("year").alias("found_year"), F.col("venue").alias("found_venue"), F.col("doi").alias("found_doi"))


#: Fixed value: the share of a record's title words that a work found by title must have.
REFERENCE_OVERLAP = 0.6


def references(records: DataFrame, works: DataFrame, hits: DataFrame) -> DataFrame:
    """(paper_id, own_ref, refs): what each record (id, doi, title) cites: by its DOI, else by the first fitting hit of a search for its title.

    works: (doi, ref, refs); hits: (id, pos, ref, title, refs), what a search for a record's title gave, in the source's order. Blank DOIs and titles find nothing.
    """
    by_doi = works.where(T.bare_doi("doi") != "").groupBy(T.bare_doi("doi").alias("k")).agg(F.min(F.struct("ref", "refs")).alias("w"))
    r = records.select("id", T.bare_doi("doi").alias("k"), F.col("title").alias("own_title")).join(by_doi, "k", "left")
    # at most a page of hits for a record
    fits = r.where("w is null").join(hits, "id").where((F.col("title") != "") & (T.title_contained("own_title", "title") >= REFERENCE_OVERLAP))
    first = fits.groupBy("id").agg(F.min(F.struct("pos", "ref", "refs")).alias("h")).select("id", "h.ref", "h.refs")
    found = r.where("w is not null").select("id", "w.ref", "w.refs").union(first)
    return found.select(F.col("id").alias("paper_id"), F.col("ref").alias("own_ref"), "refs")


def filled(local: DataFrame, *others: DataFrame, fields: tuple[str, ...] = ("title", "authors", "year", "venue", "doi", "keywords")) -> DataFrame:
    """local (id, fields) with blank fields filled from the others in their order (what was found online, then what a model said)."""
    out = local
    for n, o in enumerate(others):
        given = o.select(F.col("id"), *(F.col(f).alias(f"_{n}_{f}") for f in fields if f in o.columns))
        out = out.join(given, "id", "left")
    blank = lambda c, f: F.nullif(F.col(c), F.lit(0)) if f == "year" else F.nullif(F.trim(F.col(c)), F.lit(""))

    def value(f: str):
        own = F.when(blank(f, f).isNotNull(), F.col(f))
        rest = [blank(f"_{n}_{f}", f) for n, o in enumerate(others) if f in o.columns]
        return F.coalesce(own, *rest, F.col(f)).alias(f)

    return out.select(*(value(c) if c in fields else F.col(c) for c in local.columns))
