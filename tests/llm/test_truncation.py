import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folialis.llm import truncation as T

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def sentence(r):
    return f"The {r.choice(['gated', 'sparse', 'joint'])} model {r.choice(['wins', 'fails', 'trains'])} on set {r.randint(1, 9)}.{r.randint(10, 99)} near the {r.choice(['lake', 'coast', 'bay'])}, i.e. {r.randint(2, 90)} % of {r.choice(['cases', 'rows'])}."


@pytest.fixture(scope="module")
def scored(spark):
    r = random.Random(5)
    rows, cut = [], set()
    for i in range(600):
        text = " ".join(sentence(r) for _ in range(r.randint(1, 8)))
        source = ["cap", "mail", "free"][i % 3]
        if source == "cap" and len(text) > 300:
            text = text[:300]
            if not text.endswith("rows.") and not text.endswith("cases."):
                cut.add(i)
        if source == "free" and i % 30 == 2:
            text, _ = text[: len(text) - 9], cut.add(i)
        rows.append((i, text + ("\n\n--\nSent by the mailer" if source == "mail" else ""), source))
    extra = [
        (1000, None, "free", False), (1001, "", "free", False), (1002, " \n\t", None, False), (1003, "@article{a,\n title = {x}", "free", True), (1004, "@article{a,\n title = {x}\n}", "free", False), (1005, "Text is here.\n\nKeywords: one; two", "free", False),
        (1006, "Text is here.\n| a | b |\n|---|---|\n| 1 | 2 |", "free", False), (1007, "Text is here.\n| a | b", "free", True), (1008, "Text is here.\nhttps://x.example/p/1", "free", False), (1009, "Text goes on …", "free", True), (1010, "Text goes on [...]\n\n--\nSent by the mailer", "mail", True),
        (1011, "[1] Lee A. Title. 2005, pp. 10-31", None, False), (1012, "本文研究夜间分割。", "free", False), (1013, "本文研究夜间分", "free", True), (1014, "It took 40 %, i.e.", "free", True), (1015, "Text is here.\n\nSources: [1], [2", "free", True), (1016, "Text.\n\n— reading group, 13 March", "free", False),
        (1017, "```\nrun --seed", "free", True), (1018, "Is it so?", "free", False), (1019, "word " * 60_000 + "ends here.", "free", False), (1020, "He said “it ends.”", "free", False),
    ]
    df = spark.createDataFrame(rows + [x[:3] for x in extra], "doc_id long, text string, source string").selectExpr("*", "1 as id", "'x' as body", "'y' as footers")
    got = T.score(df, "doc_id", "text", "source")
    return {r.id: r for r in got.collect()}, cut, {x[0]: x[3] for x in extra}, {x.source: x for x in T.rates(got).collect()}


def test_planted_cuts(scored):
    got, cut, _, _ = scored
    found = {i for i, r in got.items() if i < 1000 and r.is_cut}
    assert len(found & cut) >= 0.98 * len(cut) and len(found - cut) <= 3


def test_forms(scored):
    got, _, want, _ = scored
    assert {i: i in got and got[i].is_cut for i in want} == want


def test_limit_and_rates(scored):
    got, cut, _, rates = scored
    at = [r for r in got.values() if r.source == "cap" and r.posterior > 0.5]
    assert len(at) > 50 and rates["cap"].share > 0.3 and rates["cap"].n_texts == 200 and None in rates


def test_censored_fit_finds_the_distribution():
    r = np.random.default_rng(3)
    x = np.exp(r.normal(6.0, 0.5, 20000))
    under = np.log(x[x < 500])
    mu, sd = T._fit(len(under), under.sum(), (under**2).sum(), (x >= 500).sum(), 500)
    assert abs(mu - 6.0) < 0.03 and abs(sd - 0.5) < 0.03


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert T.score(df, "doc_id", "text", "source").count() == 0 and T.rates(T.score(df, "doc_id", "text", "source")).count() == 0


def test_footers_of_rare_sources_and_long_ones(spark):
    long = "\n\n--\nThis text was sent by the mailer of the library and may hold errors for which nobody answers in any way at all"
    r = random.Random(8)
    # one text of the rare source in each task
    rows = [(k * 100 + i, " ".join(sentence(r) for _ in range(3)) + (("\n\nSent by mailer" if i == 0 else long) if i < 20 else ""), "rare" if i == 0 else "long" if i < 20 else "free") for k in range(8) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartitionByRange(8, "doc_id")
    got = T.score(df, "doc_id", "text", "source")
    assert [x.source for x in T.rates(got).collect() if x.n_cut] == []
    assert sorted(T.footers(T.common_ends(df.select("source", "text")))) == [("long", long), ("rare", "\n\nSent by mailer")]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_same_in_any_layout(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    got = [{r.id for r in T.score(d.repartition(n), "doc_id", "text", "source").where("is_cut").collect()} for n in (1, 150)]
    assert got[0] == got[1] and len(got[0]) > 100


def test_shares_are_learned():
    counts = np.zeros((T.STEPS + 1, len(T.CLASSES)))
    counts[0] = [300, 8000, 1500, 200]
    counts[-1] = [970, 25, 5, 0]
    cut, whole, rate = T.learn_shares(counts)
    assert 0.02 < rate < 0.04 and cut[0] > 0.95 and whole[0] < 0.01 and whole[1] > 0.75


def test_length_decides_what_endings_leave_open(spark):
    cut, whole = np.array([0.97, 0.02, 0.005, 0.005]), np.array([0.001, 0.8, 0.15, 0.049])
    rows = spark.createDataFrame([("stop", 0.3, 0.03), ("stop", 0.3, 0.99), ("stop", 0.99, 0.99), ("line", 0.0, 0.03), ("line", 0.0, 0.99), ("open", 0.0, 0.03), ("closed", 0.0, 0.99)], "kind string, b double, p double")
    odds = [r[0] for r in rows.select(T.case_odds(F.col("kind"), F.col("b"), F.col("p"), cut, whole, 0.8)).collect()]
    assert [x > 0 for x in odds] == [False, True, False, False, True, True, False]


def test_rates_of_planted_cuts(spark):
    r = random.Random(11)
    rows, planted = [], {"a": 0, "b": 0, "c": 0}
    for i in range(900):
        text, source = " ".join(sentence(r) for _ in range(4)), "abc"[i % 3]
        if i % {"a": 5, "b": 20, "c": 1000}[source] == 0 and source != "c":
            text = text[: len(text) - 15]
            planted[source] += 1
        rows.append((i, text, source))
    got = T.rates(T.score(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "text", "source"))
    assert {x.source: (x.n_texts, x.n_cut) for x in got.collect()} == {s: (300, n) for s, n in planted.items()}
