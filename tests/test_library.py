from datetime import datetime

import pytest
from pyspark.sql import functions as F

from folialis.operators import exports, facets, graph, library, mutate, resolve, search
from folialis.operators.library import Library, PaperQuery, parse_query
from folialis.operators.mutate import Conflict
from folialis.sources.snapshots import Snapshots

NOW = "2025-01-01 00:00:00"


@pytest.fixture
def lib(spark, make_papers):
    p = make_papers(
        {"title": "Image fusion", "authors": "A. One", "category_id": 1, "year": 2001, "keywords": "fusion", "fulltext": "novel distillation"},
        {"title": "图像融合", "authors": "B. Two", "year": 2010, "status": "read", "read": True, "starred": True},
        {"title": "Gone", "year": 2005, "deleted_at": datetime(2024, 5, 5), "pdf_path": "gone.pdf"},
    )
    tags = spark.createDataFrame([(1, "fusion"), (2, "蒸馏"), (3, "unused")], "id long, name string")
    links = spark.createDataFrame([(1, 1), (2, 1), (2, 2), (2, 2), (3, 1)], "paper_id long, tag_id long")
    cats = spark.createDataFrame([(1, "cv"), (2, "nlp")], "id long, name string")
    return Library(p, cats, tags, links, tags, links.withColumnRenamed("tag_id", "collection_id"))


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize(
    ("q", "want"),
    [
        ({}, [1, 2]), ({"search": "FUSION"}, [1]), ({"search": "融合"}, [2]), ({"search": "novel distillation"}, [1]), ({"search": 'a"b(c) -x%'}, []), ({"search": "\\"}, []), ({"search": "f_sion"}, [1]),
        ({"category_id": 1}, [1]), ({"tag_ids": (1,)}, [1, 2]), ({"tag_names": ("蒸馏",)}, [2]), ({"tag_names": ("x",)}, []), ({"collection_ids": (2,)}, [2]), ({"exclude_collection_ids": (2,)}, [1]),
        ({"year_from": 2002}, [2]), ({"year_to": 2001}, [1]), ({"read": True}, [2]), ({"read": False}, [1]), ({"status": "all"}, [1, 2]), ({"status": "odd"}, []), ({"starred": True}, [2]),
    ],
)
def test_filters(lib, q, want):
    assert ids(library.filtered(lib, PaperQuery(**q))) == want


def test_parse_query():
    q = parse_query({"tags": "1,foo", "collections": "a, b", "yearFrom": "x", "read": "yes", "starred": "maybe", "page": "-1", "pageSize": "500", "category": "3"})
    assert q.tag_ids == [1] and q.collection_names == ["a", "b"] and q.year_from is None and q.read is True and q.starred is None
    assert q.offset == 0 and q.limit == 100 and q.category_id == 3 and PaperQuery(page=3, page_size=0).offset == 40


@pytest.mark.parametrize("n", [0, 1, 20, 21, 101])
def test_paging_with_ties(spark, make_papers, n):
    same = datetime(2024, 1, 1)
    p = make_papers(*({"title": "t", "created_at": same} for _ in range(n))) if n else make_papers({}).where("false")
    x = Library(p)
    seen = [r["id"] for k in range(1, 8) for r in library.page(x, PaperQuery(page=k)).collect()]
    assert seen == list(range(n, 0, -1))
    assert tuple(library.total(x, PaperQuery()).first()) == (n, max(1, -(-n // 20)))


def test_hydration(lib):
    rows = {r["id"]: r for r in library.hydrated(library.live(lib.papers), lib).collect()}
    assert [t["name"] for t in rows[2]["tags"]] == ["fusion", "蒸馏"] and len(rows[1]["tags"]) == 1
    assert library.paper(lib, 3).count() == 0 and library.paper(lib, 1).first()["category_name"] == "cv"


def test_facets(lib):
    assert [(r.name, r.paper_count) for r in facets.category_facet(lib.categories, lib.papers).collect()] == [("cv", 1), ("nlp", 0)]
    assert [r.paper_count for r in facets.link_facet(lib.tags, lib.paper_tags, "tag_id").collect()] == [3, 0, 1]
    assert [r.paper_count for r in facets.link_facet(lib.tags, lib.paper_tags, "tag_id", lib.papers).collect()] == [2, 0, 1]
    s = facets.stats(lib.papers, lib.categories, lib.tags).first()
    assert (s.total, s.n_read, s.n_unread, s.n_starred, s.read_percent) == (2, 1, 1, 1, 50)
    assert facets.stats(lib.papers.where("false"), lib.categories, lib.tags).first().read_percent == 0
    assert facets.name_taken(lib.tags, "fusion", 1).first()[0] is False and facets.name_taken(lib.tags, "fusion").first()[0] is True


def test_recall_and_prompt(lib):
    assert [r["id"] for r in search.recall(lib.papers, "fusion 融", 0).collect()] == [2, 1]
    s = search.sources(lib.papers, "zzz").collect()
    assert {r.id for r in s} == {1, 2} and all(r.fallback for r in s)
    assert search.sources(lib.papers.where("false"), "zzz").count() == 0
    assert search.prompt(lib.papers, "distillation").first()["cited"] == [1]


def test_duplicates(make_papers):
    p = make_papers(
        {"doi": "10.1/A", "title": "x"}, {"doi": "10.1/a", "title": "y"}, {"title": "Same: Title", "authors": "A, B"}, {"title": "same title", "authors": "A"}, {"title": "same title", "authors": "C"},
        {"title": "same title", "authors": ""}, {"doi": "10.1/a", "deleted_at": datetime(2024, 1, 1)}, {"doi": None, "title": None, "authors": None},
    )
    assert {r.id: (r.duplicate_of, r.by) for r in resolve.duplicates(p).collect()} == {1: (2, "doi"), 2: (1, "doi"), 3: (4, "title"), 4: (3, "title")}
    new = p.sparkSession.createDataFrame([("k", "10.1/A", "", ""), ("l", "", "Same title", "A, Z"), ("m", "", "", "")], "key string, doi string, title string, authors string")
    assert {r.key: (r.paper_id, r.by) for r in resolve.duplicate_of(p, new).collect()} == {"k": (1, "doi"), "l": (3, "title")}


def test_similar_titles_against_all_pairs(spark):
    import random

    r = random.Random(4)
    words = [f"w{i}" for i in range(14)]
    titles = [(i, " ".join(r.choices(words, k=r.randint(0, 6)))) for i in range(80)]
    df = spark.createDataFrame(titles, "id long, title string")
    for t in (0.4, 0.7, 1.0):
        got = {(x.id_a, x.id_b) for x in resolve.similar_titles(df, df, t).collect()}
        s = {i: set(x.split()) for i, x in titles if x}
        assert got == {(a, b) for a in s for b in s if a != b and len(s[a] & s[b]) / len(s[a] | s[b]) >= t}


def test_enrich(spark):
    rec = spark.createDataFrame([(1, "A long plausible title", "https://doi.org/10.1/X"), (2, "Wholly other words here", "10.1/x"), (3, "?", "10.1/x"), (4, "t", "")], "id long, title string, doi string")
    cat = spark.createDataFrame([("10.1/x", "A long plausible title", 2000, "V", 2), ("10.1/X", "", 1, "", 1)], "doi string, title string, year int, venue string, source_rank int")
    assert {r.id: r.found_year for r in resolve.enrich_by_doi(rec, cat).collect()} == {1: 2000, 2: None, 3: 2000, 4: None}
    filled = resolve.filled(spark.createDataFrame([(1, "", 0)], "id long, venue string, year int"), spark.createDataFrame([(1, "  ", 5)], "id long, venue string, year int"), spark.createDataFrame([(1, "M", 9)], "id long, venue string, year int"))
    assert tuple(filled.first()) == (1, "M", 5)


def test_graph_caps(spark):
    refs = spark.createDataFrame([(p, k, p * 20 + k if k else 999) for p in range(1, 21) for k in range(16)] + [(1, 0, 999), (1, 1, 21)], "paper_id long, pos int, ref long")
    e = graph.edges(refs)
    assert e.select("target").distinct().count() == 150 and e.groupBy("source").count().agg(F.max("count")).first()[0] <= 15
    own = spark.createDataFrame([(1, 999)], "paper_id long, ref long")
    assert e.where("source = 'lib-1' and target = 'ext-999'").count() == 1 and graph.edges(refs, own).where("source = 'lib-1' and target = 'ext-999'").count() == 0
    assert graph.edges(refs.where("false")).count() == 0


def test_changes(spark, lib):
    p = lib.papers
    new = mutate.inserted(p, spark.createDataFrame([(" T ", " n ", "odd")], "title string, notes string, status string"), NOW).where("id > 3").first()
    assert (new.title, new.notes, new.status, new.notes_updated_at) == ("T", " n ", "unread", datetime(2025, 1, 1))
    patch = spark.createDataFrame([(1, "v2", "read")], "id long, notes string, status string")
    row = mutate.patched(p, patch, NOW).where("id = 1").first()
    assert row.notes == "v2" and row.read and row.notes_updated_at == datetime(2025, 1, 1)
    same = mutate.patched(p, spark.createDataFrame([(1, "")], "id long, notes string"), NOW).where("id = 1").first()
    assert same.notes_updated_at is None
    with pytest.raises(ValueError, match="unknown"):
        mutate.patched(p, spark.createDataFrame([(1, "x")], "id long, hacker string"), NOW)
    with pytest.raises(Conflict):
        mutate.patched(p, spark.createDataFrame([(999, "x")], "id long, notes string"), NOW)
    with pytest.raises(Conflict):
        mutate.patched(p, spark.createDataFrame([(1, "x", "other")], "id long, notes string, expected_notes string"), NOW, expected_notes=True)
    assert mutate.patch_of({"read": True, "category_name": "", "hacker": 1, "title": None}) == {"status": "read", "category_id": 0}


def test_trash_life_cycle(spark, lib):
    one = spark.createDataFrame([(1,)], "id long")
    p = mutate.soft_deleted(lib.papers, one, NOW)
    assert ids(library.live(p)) == [2]
    with pytest.raises(Conflict):
        mutate.soft_deleted(p, one, NOW)
    assert ids(library.live(mutate.restored(p, one))) == [1, 2]
    left, children, files = mutate.purged(lib.papers, {"paper_tags": lib.paper_tags})
    assert ids(left) == [1, 2] and [r[0] for r in files.collect()] == ["gone.pdf"] and children["paper_tags"].where("paper_id = 3").count() == 0
    with pytest.raises(Conflict):
        mutate.purged(left, {}, one)


def test_relations_and_dimensions(spark, lib):
    with pytest.raises(ValueError, match="unknown"):
        mutate.related_set(lib.paper_tags, 1, "tag_id", [99999], lib.tags)
    assert mutate.related_set(lib.paper_tags, 1, "tag_id", [2, 3, 3], lib.tags).where("paper_id = 1").count() == 2
    assert mutate.ensured(lib.tags, spark.createDataFrame([(" fusion ",), ("new",), ("",)], "name string")).count() == 4
    with pytest.raises(Conflict):
        mutate.renamed(lib.tags, 1, "unused")
    cats, papers = mutate.category_deleted(lib.categories, lib.papers, 1)
    assert cats.count() == 1 and papers.where("category_id is not null").count() == 0
    assert mutate.dimension_deleted(lib.tags, lib.paper_tags, "tag_id", 1)[1].where("tag_id = 1").count() == 0


def test_annotations(spark):
    from folialis.functions.rects import TYPE

    s = f"id long, paper_id long, kind string, page int, rects {TYPE}, x double, y double, quote string, color string, note string, created_at timestamp_ntz"
    none = spark.createDataFrame([], s)
    box = [{"p": 1, "x": 0.1, "y": 0.1, "w": 0.2, "h": 0.1}]
    new = spark.createDataFrame([(None, 1, "", 5, box, None, None, "q", "rainbow", "", None), (None, 1, "note", 1, [], 0.5, 0.5, "", "blue", "n", None)], s)
    got = mutate.annotations_added(none, new, NOW).orderBy("page").collect()
    assert [(r.kind, r.color) for r in got] == [("note", "blue"), ("highlight", "yellow")]
    for bad in ((None, 1, "note", 1, [], 1.4, 0.5, "", "", "", None), (None, 1, "highlight", 1, [], None, None, "", "", "", None)):
        with pytest.raises(ValueError, match="rectangles"):
            mutate.annotations_added(none, spark.createDataFrame([bad], s), NOW)
    a = mutate.annotations_added(none, new, NOW)
    i = a.first().id
    with pytest.raises(ValueError, match="together"):
        mutate.annotation_patched(a, i, x=0.5)
    with pytest.raises(Conflict):
        mutate.annotation_deleted(a, 10**15)


def test_snapshots(spark, lib, tmp_path):
    s = Snapshots(spark, f"file://{tmp_path}/lib")
    v1 = s.publish(0, papers=lib.papers, paper_tags=lib.paper_tags)
    p = mutate.soft_deleted(s.read("papers"), spark.createDataFrame([(1,)], "id long"), NOW)
    v2 = s.publish(v1, papers=p)
    assert ids(library.live(s.read("papers"))) == [2] and ids(library.live(s.read("papers", v1))) == [1, 2] and s.read("paper_tags", v2).count() == 5
    with pytest.raises(Conflict):
        s.publish(v1, papers=lib.papers)
    s.backup(f"file://{tmp_path}/copy")
    assert spark.read.parquet(f"file://{tmp_path}/copy/papers.parquet").count() == 3


def test_exports(lib, tmp_path):
    e = {r.id: r.entry for r in exports.bibtex(lib.papers).collect()}
    assert e[1].startswith("@misc{One2001,\n  title = {Image fusion},\n  author = {One, A.},\n  year = {2001},\n}")
    exports.write_text(exports.as_json(lib.papers.select("id")), "json", f"file://{tmp_path}/j")
    assert len(list((tmp_path / "j").glob("part-*"))) > 0


def test_unused_tags_reads_all_links(spark, tmp_path):
    from folialis.plans.library_queries import unused_tags

    spark.createDataFrame([(1, "early"), (2, "late"), (3, "never")], "id long, name string").write.parquet(f"{tmp_path}/tags.parquet")
    spark.createDataFrame([(1, 1), (51, 2)], "paper_id long, tag_id long").write.parquet(f"{tmp_path}/paper_tags.parquet")
    assert [tuple(r) for r in unused_tags(spark, str(tmp_path)).collect()] == [(3, "never")]


def test_refs_of_more_works_than_a_million(spark, tmp_path):
    from folialis.plans.library_queries import refs_per_paper

    spark.range(1_000_050).selectExpr("id as paper_id", "id as tag_id").write.parquet(f"{tmp_path}/paper_tags.parquet")
    assert refs_per_paper(spark, str(tmp_path)).count() == 1_000_050


def test_pages_keep_their_order_without_broadcasts(spark, make_papers):
    p = make_papers(*({"title": f"graph {i * 37 % 60:02d}", "category_id": i % 3 + 1, "fulltext": "x" * i + " graph"} for i in range(60)))
    c = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, name string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for search in ("", "graph"):
            q = PaperQuery(search=search, sort="title", order="asc", page=2, page_size=15)
            page = library.page(Library(p, c), q)
            assert [r.title for r in page.collect()] == [f"graph {i:02d}" for i in range(15, 30)]
            if search:
                # snippets are made after the limit, and the papers are scanned once
                plan = page._jdf.queryExecution().optimizedPlan().toString()
                assert all("graph" in r.snippet for r in page.collect()) and plan.index("AS snippet") < plan.index("GlobalLimit 15") and plan.count("GlobalLimit 15") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ids_that_come_twice(spark, make_papers):
    p = make_papers({}, {}, {})
    twice = spark.createDataFrame([(1,), (1,)], "id long")
    gone = mutate.soft_deleted(p, twice, NOW)
    assert gone.count() == 3 and mutate.restored(gone, twice).where("deleted_at is null").count() == 3
    with pytest.raises(ValueError, match="twice"):
        mutate.patched(p, spark.createDataFrame([(1, "a"), (1, "b")], "id long, title string"), NOW)


def test_whole_rows_are_written_under_a_guard(spark, make_papers):
    p = make_papers({"title": "old", "notes": "mine", "venue": "V", "status": "read", "notes_updated_at": datetime(2024, 5, 1)}, {"title": "other", "notes": None})
    kind = "id long, seen_notes_at timestamp_ntz, title string, notes string, year int"
    got = mutate.updated(p, spark.createDataFrame([(1, datetime(2024, 5, 1), " new ", "changed", None)], kind), NOW).orderBy("id").collect()
    assert (got[0].title, got[0].notes, got[0].venue, got[0].status, got[0].read, got[0].year, str(got[0].notes_updated_at)) == ("new", "changed", "", "unread", False, 0, NOW) and got[1].title == "other"
    # the same notes are a good guard as well, and their time stays
    same = mutate.updated(p, spark.createDataFrame([(1, None, "t", "mine", 1999)], kind), NOW).orderBy("id").first()
    assert (same.year, same.notes_updated_at) == (1999, datetime(2024, 5, 1))
    assert mutate.updated(p, spark.createDataFrame([(2, None, "t", None, 1)], kind), NOW).where("id = 2").first().title == "t"
    for bad, what in (((1, datetime(2024, 5, 2), "t", "lost", 1), "notes"), ((9, None, "t", "", 1), "row")):
        with pytest.raises(Conflict, match=what):
            mutate.updated(p, spark.createDataFrame([bad], kind), NOW)


def test_metadata_leaves_notes_alone(spark, make_papers):
    p = make_papers({"title": "old", "notes": "mine", "status": "reading"})
    got = mutate.metadata_updated(p, spark.createDataFrame([(1, "found", None)], "id long, title string, venue string"), NOW).first()
    assert (got.title, got.notes, got.status, got.venue) == ("found", "mine", "reading", "")
    with pytest.raises(ValueError, match="notes"):
        mutate.metadata_updated(p, spark.createDataFrame([(1, "x")], "id long, notes string"), NOW)


def test_saving_is_one_unit(spark, make_papers, tmp_path):
    p = make_papers({"title": "a"}, {"title": "b"})
    dims = spark.createDataFrame([(1, "x"), (2, "y")], "id long, name string")
    links = lambda k: spark.createDataFrame([(1, 1), (2, 1)], f"paper_id long, {k} long")
    t = {"papers": p, "tags": dims, "collections": dims, "paper_tags": links("tag_id"), "paper_collections": links("collection_id")}
    rows = spark.createDataFrame([(1, "new", "")], "id long, title string, notes string")
    rel = lambda k, *ids: spark.createDataFrame([(1, i) for i in ids], f"id long, {k} long")
    out = mutate.saved(t, rows, rel("tag_id", 2, 2), rel("collection_id"), NOW)
    store = Snapshots(spark, f"{tmp_path}/lib")
    base = store.publish(0, **t)
    store.publish(base, **out)
    assert sorted(map(tuple, store.read("paper_tags").collect())) == [(1, 2), (2, 1)] and sorted(map(tuple, store.read("paper_collections").collect())) == [(2, 1)]
    assert {r.title for r in store.read("papers").collect()} == {"new", "b"} and {r.title for r in store.read("papers", base).collect()} == {"a", "b"}
    with pytest.raises(ValueError, match="tag_id"):
        mutate.saved(t, rows, rel("tag_id", 7), rel("collection_id"), NOW)
    with pytest.raises(Conflict):
        store.publish(base, **out)
    made = mutate.saved(t, spark.createDataFrame([(10, "made")], "id long, title string"), spark.createDataFrame([(10, 1)], "id long, tag_id long"), rel("collection_id"), NOW, create=True)
    assert made["papers"].where("title = 'made' and id = 10").count() == 1 and made["paper_tags"].where("paper_id = 10").count() == 1
    with pytest.raises(Conflict, match="taken"):
        mutate.saved(t, rows, rel("tag_id"), rel("collection_id"), NOW, create=True)


def test_references_by_doi_then_by_title(spark):
    r = spark.createDataFrame([(1, "https://doi.org/10.1/A", "any"), (2, "", "Deep graph kernels"), (3, None, "Deep graph kernels"), (4, "10.9/none", "")], "id long, doi string, title string")
    works = spark.createDataFrame([("10.1/a", "W1", ["W8", "W9"]), ("", "W0", [])], "doi string, ref string, refs array<string>")
    hits = spark.createDataFrame([(2, 1, "W2", "Shallow trees", ["W3"]), (2, 2, "W4", "Deep graph kernels again", ["W5"]), (3, 1, "W6", "Deep kernels", []), (1, 1, "W7", "any", [])], "id long, pos int, ref string, title string, refs array<string>")
    got = {x.paper_id: (x.own_ref, x.refs) for x in resolve.references(r, works, hits).collect()}
    assert got == {1: ("W1", ["W8", "W9"]), 2: ("W4", ["W5"]), 3: ("W6", [])}


def test_titles_are_looked_for_in_the_order_of_sources(spark):
    r = spark.createDataFrame([(1, "Deep graph kernels at scale"), (2, "Sparse image retrieval by night"), (3, "Short"), (4, "Plain methods for nothing known")], "id long, title string")
    c = spark.createDataFrame(
        [
            ("crossref", 1, 90.0, "Deep graph kernels at scale", 2001, "C", "d1"), ("arxiv", 5, None, "Deep graph kernels on scale", 2000, "A", "d2"), ("arxiv", 6, None, "Deep graph kernels at scale", 1999, "A", "d3"),
            ("crossref", 3, 10.0, "Sparse image retrieval by night", 2002, "low score", ""), ("crossref", 4, 60.0, "Sparse image retrieval at night", 2003, "too far", ""), ("crossref", 2, 60.0, "Sparse image retrieval by day night", 2004, "C", ""),
        ],
        "source string, pos int, score double, title string, year int, venue string, doi string",
    )
    assert {x.id: (x.found_year, x.found_venue) for x in resolve.enrich_by_title(r, c).collect()} == {1: (2000, "A"), 2: (2004, "C")}


def test_places_of_annotations(spark):
    rows = [(i, 1, i % 5 if i % 7 else None) for i in range(40)] + [(3, 2, 1), (2, 2, 1), (9, 2, 0)]
    a = spark.createDataFrame([(i, p, g, datetime(2024, 1, 1), None, "n") for i, p, g in rows], "id long, paper_id long, page int, created_at timestamp_ntz, quote string, note string")
    got = {(r.paper_id, r.place): r.id for r in library.annotations_of(a).collect()}
    for paper in (1, 2):
        own = sorted((-1 if g is None else g, i) for i, p, g in rows if p == paper)
        assert [got[paper, k] for k in range(1, len(own) + 1)] == [i for _, i in own]


def test_notes_file_and_backup(spark, make_papers, tmp_path):
    p = make_papers({"title": "a", "notes": "x"}, {"title": "b", "notes": "y"}, {"title": "none"})
    rows = exports.notes_file(p, NOW).collect()
    assert [r.part for r in rows] == ["head", "section", "section"] and [r.id for r in rows] == [None, 2, 1] and "共 2 篇" in rows[0].text
    (tmp_path / "up").mkdir()
    for n in range(3):
        (tmp_path / f"up/{n} a%20.pdf").write_bytes(b"%PDF-" + bytes(n))
    store = Snapshots(spark, f"{tmp_path}/lib")
    store.publish(0, papers=p)
    done = store.backup(f"{tmp_path}/out", uploads=str(tmp_path / "up"), note="how to restore").collect()
    assert sorted(r["size"] for r in done) == [5, 6, 7] and (tmp_path / "out/uploads/2 a%20.pdf").read_bytes() == b"%PDF-\0\0"
    assert spark.read.parquet(f"{tmp_path}/out/papers.parquet").count() == 3 and (tmp_path / "out/RESTORE.txt").read_text() == "how to restore"
