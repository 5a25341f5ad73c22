from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folialis.llm import names as N
from folialis.llm.survivor import choose, credible, doi_edges, usable_doi, usable_venue

AUTHORS = [(1, "Noémie S. Rînorv"), (2, "Matthew von Corjasdal"), (3, "棠知澄"), (4, "Pelvekfell Wintering Working Group"), (5, "Michael O'Rinlacalrg"), (6, "Deborah Têrlenck"), (7, "Richard Yorkatorsk"), (8, "Radka Yorkatorsk"), (9, "Hélène Marbrupern")]
VENUES = [(1, "Journal of Porous Optics"), (2, "International Conference on Nomadic Robotics"), (3, "Nomadic Imaging Review"), (4, "Nomadic Imaging Letters"), (5, "Workshop on Quartz Cartography")]


@pytest.mark.parametrize(
    ("kind", "name", "ref"),
    [
        ("author", "Rînorv, N.S.", 1), ("author", "N. S. Rinorv", 1), ("author", "RÎNORV Noémie", 1), ("author", "Noémie Rînrov", 1), ("author", "Rînorv NS", 1), ("author", "Noémie K. Rînorv", None), ("author", "Matt von Corjadsal", 2), ("author", "von Corjasdal M", 2),
        ("author", "VON CORJASDAL Matthew", 2), ("author", "棠　知澄", 3), ("author", "PWWG", 4), ("author", "Pelvekfell Wintering Working Gruop", 4), ("author", "MATTHEW VON CORJASDAL", 2), ("author", "The Pelvekfell Wintering WG", 4), ("author", "Pelvekfell Wintering W. Group", 4), ("author", "Mike O'Rinlacalrg*", 5), ("author", "ORINLACALRG, Michael", 5),
        ("author", "Debbie Terlenck", 6), ("author", "DA Têrlenck", 6), ("author", "R. Yorkatorsk", None), ("author", "Rihcard Yorkatrosk", 7), ("author", "Casper Yorkatorsk", None), ("author", "Nadja Marbrupern", None), ("author", "?", None),
        ("venue", "J. of Porous Optics", 1), ("venue", "JPO 2020", 1), ("venue", "Porous Optics, Journal of", 1), ("venue", "Journal of Porous Optics, vol. 3", 1), ("venue", "Proceedings of the 9th International Conference on Nomadic Robotics", 2), ("venue", "Int'l Conf Nomadic Robot", 2),
        ("venue", "ICNR'19", 2), ("venue", "Nomadic Imaging Rev.", 3), ("venue", "NOMADIC IMAGING LETTERS", 4), ("venue", "Nomadic Imaging Lettesr", 4), ("venue", "Wksp. on Quartz Cartogr.", 5), ("venue", "Workshop n Quartz Cartography", 5), ("venue", "Journal of Porous Museology", None), ("venue", "none", None),
    ],
)
def test_spellings(linked, kind, name, ref):
    assert linked.get((kind, name)) == ref


@pytest.fixture(scope="module")
def linked(spark):
    cases = [(m.args[1]) for m in test_spellings.pytestmark if m.name == "parametrize"][0]
    rows = [(i, k, n) for i, (k, n, _) in enumerate(cases)] + [(900, "author", None), (901, "venue", ""), (902, "author", "Hélène Marbrupern"), (903, "author", "x" * 5000)]
    items = spark.createDataFrame(rows, "paper_id long, kind string, name string").selectExpr("*", "'c' as full_name2", "1 as key")
    register = spark.createDataFrame([("author", *a) for a in AUTHORS] + [("venue", *v) for v in VENUES], "kind string, ref_id long, full_name string")
    out = {r.paper_id: r.ref_id for r in N.link_papers(items.select("paper_id", "kind", "name"), register).collect()}
    assert not {900, 901, 902, 903} & set(out)
    return {(k, n): out.get(i) for i, k, n in rows if n}


def test_empty(spark):
    none = spark.createDataFrame([], "kind string, name string")
    reg = spark.createDataFrame([], "kind string, ref_id long, full_name string")
    assert N.link(none, reg).count() == 0


def test_short_forms_are_learned(spark):
    given = ["Theodora", "Radomir", "Isolde"]
    register = [(i, f"{g} {f}") for i, (g, f) in enumerate((given[k % 3], f"{w}kelmost") for k, w in enumerate(["Bar", "Cor", "Dul", "Fen", "Gal", "Hol", "Jas", "Kel", "Lun", "Mor", "Nar", "Pol"]))]
    # Mirko is met under families of Radomir, Otto under any
    names = [f"Mirko {n.split()[1]}" for _, n in register if n.startswith("Rad")] + [f"Otto {n.split()[1]}" for _, n in register] + ["Mirko Zelten"]
    items = spark.createDataFrame([(i, "author", n) for i, n in enumerate(names)], "paper_id long, kind string, name string")
    reg = spark.createDataFrame([("author", *r) for r in register], "kind string, ref_id long, full_name string")
    got = {r.name: r.full_name for r in N.link(items, reg).collect()}
    assert got == {n: f"Radomir {n.split()[1]}" for n in names[:4]}


@pytest.mark.parametrize(
    ("words", "full", "slips"),
    [("j porous opt", "journal porous optics", 0), ("wksp quartz crtgrphy", "workshop quartz cartography", 0), ("pelv wintering wg", "pelvekfell wintering working group", 0), ("jurnal optics", "journal optics", 0), ("jouornal optics", "journal optics", 1), ("jouornal optcis", "journal optics", None), ("journal", "journal optics", None), ("review optics", "journal optics", None)],
)
def test_shortened(words, full, slips):
    assert N.shortened(words, full) == slips


def test_hot_names_are_spread(spark, monkeypatch):
    monkeypatch.setattr(N, "HOT", 10)
    items = spark.createDataFrame([(i, "venue", "J. of Porous Optics" if i % 3 else f"Letters {i}") for i in range(120)], "paper_id long, kind string, name string")
    reg = spark.createDataFrame([("venue", *v) for v in VENUES], "kind string, ref_id long, full_name string")
    assert sorted(tuple(r) for r in N.link_papers(items.union(items), reg).collect()) == [(i, "venue", 1) for i in range(120) if i % 3]


def osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


word = st.text("abc", min_size=6, max_size=18)


@settings(max_examples=300, deadline=None)
@given(word, word, st.integers(0, 3))
def test_banded_distance(a, b, k):
    assert N.slips(a, b, k) == min(osa(a, b), k + 1)


@settings(max_examples=300, deadline=None)
@given(word, st.data())
def test_segments_miss_no_slip(entry, data):
    s = list(entry)
    for _ in range(data.draw(st.integers(0, 2))):
        i = data.draw(st.integers(0, len(s) - 2))
        how = data.draw(st.sampled_from("idrs"))
        if how == "i":
            s.insert(i, "x")
        elif how == "d" and len(s) > 6:
            del s[i]
        elif how == "r":
            s[i] = "y"
        else:
            s[i], s[i + 1] = s[i + 1], s[i]
    key = "".join(s)
    k = min(N.allowed(key), N.allowed(entry))
    if osa(key, entry) <= k and len(entry) >= N.SHORT:
        assert set(N.index_segments(entry)) & set(N.probe_segments(key))


@pytest.mark.parametrize(
    ("raw", "doi"),
    [
        ("10.99364 / kdu.3966", "10.99364/kdu.3966"), ("https://x.example/go?doi=10.1/A.B", "10.1/a.b"), ("10.9%2Fq.1", "10.9/q.1"), ("[10.9/X.1].", "10.9/x.1"), ("<10.9/x1>", "10.9/x1"), ("DOI10.9/x1;", "10.9/x1"), ("\u200b10.9/x1", "10.9/x1"),
        ("10.", None), ("10.99/", None), ("10.0000/000000", None), ("10.0000/XXXXX", None), ("10.99999/to.be.assigned", None), ("doi:", None), ("tba", None), ("", None), (None, None),
    ],
)
def test_usable_doi(spark, raw, doi):
    assert spark.createDataFrame([(raw,)], "d string").select(usable_doi(F.col("d"))).first()[0] == doi


def test_choose(spark):
    t = lambda d: datetime(2024, 1, d)
    rows = spark.createDataFrame(
        [
            (1, 10, "10.9/a", "V", t(1), t(5)), (1, 11, "", "W", t(1), t(9)), (1, 12, "10.9/b", "N/A", t(1), datetime(2030, 1, 1)), (1, 13, "10.9/c", "?", t(8), t(7)), (2, 20, None, None, t(1), None), (2, 21, "10.", "tbd", t(1), t(2)),
            (3, 30, "10.9/x", "v", t(1), t(3)), (3, 31, "10.9/y", "V.", t(1), t(3)), (3, 31, "10.9/y", "V.", t(1), t(3)),
        ],
        "g long, id long, doi string, venue string, created_at timestamp_ntz, updated_at timestamp_ntz",
    )
    trust = credible(F.col("updated_at"), F.col("created_at"), "2025-06-30 00:00:00")
    values = {"doi": usable_doi(F.col("doi")), "venue": usable_venue(F.col("venue"))}
    got = {r.g: (r.doi_from, r.venue_from) for r in choose(rows, "g", "id", values, F.col("updated_at"), trust).collect()}
    assert got == {1: (10, 11), 2: (None, None), 3: (31, 30)}
    votes = choose(rows.union(rows.where("id = 10").selectExpr("g", "14L", "doi", "venue", "created_at", "updated_at")), "g", "id", values, F.col("updated_at"), trust, by_votes=True)
    assert {r.g: r.venue_from for r in votes.collect()}[1] == 10
    assert choose(rows.where("false"), "g", "id", values, F.col("updated_at"), trust).count() == 0


def test_doi_edges(spark):
    e = doi_edges(spark.createDataFrame([(3, "a"), (1, "a"), (2, "a"), (4, None), (5, None), (6, "b")], "id long, doi string"))
    assert sorted((r.a, r.b) for r in e.collect()) == [(1, 2), (1, 3)]
