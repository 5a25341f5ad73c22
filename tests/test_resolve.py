"""Titles that are alike, at sizes where candidates outnumber rows: right results, and no shuffle of the candidates."""

import random

import pytest

from folialis.operators import resolve


@pytest.fixture(scope="module")
def titles():
    """2,500 titles of 8 of 60 words: most pairs share a rare word, few are alike; one in five is the last with a word changed, one in ten the same words again."""
    r = random.Random(7)
    words = [f"word{i}" for i in range(60)]
    out = []
    for i in range(1, 2501):
        t = out[-1].split() if out and r.random() < 0.3 else r.sample(words, 8)
        if r.random() < 0.67:
            t[r.randrange(8)] = r.choice(words)
        r.shuffle(t)
        out.append(" ".join(t))
    return list(enumerate(out, 1))


@pytest.fixture(scope="module")
def overlaps(titles):
    """{(a, b): overlap} of all pairs of 0.55 and more, by brute force."""
    s = [(i, set(t.split())) for i, t in titles]
    return {(a, b): n / (len(x) + len(y) - n) for a, x in s for b, y in s if (n := len(x & y)) > 4 and n / (len(x) + len(y) - n) >= 0.55}


def run(spark, df):
    """The rows of df, and how many its stages shuffled where no side is small enough to be broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    sc = spark.sparkContext._jsc.sc()

    def stages():
        sc.listenerBus().waitUntilEmpty(30_000)
        found = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return {x.stageId(): x.shuffleWriteRecords() for x in (found.apply(k) for k in range(found.size()))}

    last = max(stages(), default=-1)
    try:
        rows = df.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return rows, sum(n for i, n in stages().items() if i > last)


@pytest.mark.parametrize("hot", [50_000, 10])
def test_enrich_by_title_shuffles_no_candidates(spark, titles, overlaps, monkeypatch, hot):
    monkeypatch.setattr(resolve, "HOT", hot)
    records = spark.createDataFrame(titles, "id long, title string")
    rows = [("arxiv" if i % 3 == 0 else "crossref", i, float(i % 100), t, i) for i, t in titles]
    catalogue = spark.createDataFrame(rows, "source string, pos long, score double, title string, year int").selectExpr("*", "'' as venue", "'' as doi")
    got, moved = run(spark, resolve.enrich_by_title(records, catalogue))
    want = {}
    for (a, b), o in overlaps.items():
        rank = 0 if b % 3 == 0 else 1 if o >= 0.7 and b % 100 >= 50 else None
        if rank is not None:
            want[a] = min(want.get(a, (9, 0)), (rank, b))
    assert {r.id: r.found_year for r in got} == {a: b for a, (_, b) in want.items()} and len(got) == len(want)
    assert moved < 300_000 or hot == 10


@pytest.mark.parametrize("hot", [50_000, 10])
def test_similar_titles_shuffles_no_candidates(spark, titles, overlaps, monkeypatch, hot):
    monkeypatch.setattr(resolve, "HOT", hot)
    d = spark.createDataFrame(titles, "id long, title string")
    got, moved = run(spark, resolve.similar_titles(d, d, 0.7))
    want = {k: o for k, o in overlaps.items() if o >= 0.7 and k[0] != k[1]}
    assert {(r.id_a, r.id_b): r.overlap for r in got} == want and len(got) == len(want)
    assert moved < 300_000 or hot == 10


@pytest.mark.parametrize("hot", [50_000, 10])
def test_search_by_title_shuffles_no_candidates(spark, titles, overlaps, monkeypatch, hot):
    monkeypatch.setattr(resolve, "HOT", hot)
    d = spark.createDataFrame(titles, "id long, title string")
    got, moved = run(spark, resolve.search_by_title(d, d))
    want = {}
    for (a, b), o in overlaps.items():
        if a != b and o >= 0.7:
            want[a] = min(want.get(a, (0, 0)), (-o, b))
    assert {r.id: (-r.overlap, r.entry_id) for r in got} == want and len(got) == len(want)
    assert moved < 300_000 or hot == 10
