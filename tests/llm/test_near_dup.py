import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folialis.llm import words as W
from folialis.llm.components import components
from folialis.llm.near_dup import NearDuplicates

WORD = re.compile(r"[㐀-䶿一-鿿豈-﫿]|[^\W_㐀-䶿一-鿿豈-﫿]+")


def shingles(s, k):
    w = WORD.findall(s.lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def corpus(n, seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + list("图像融合研究")
    base = [[r.choice(vocabulary) for _ in range(r.randint(40, 160))] for _ in range(n)]
    out = []
    for i, b in enumerate(base):
        out.append(b)
        for _ in range(r.choice([0, 0, 1, 3])):
            c = list(b)
            for _ in range(r.randint(0, len(c) // 6)):
                c[r.randrange(len(c))] = r.choice(vocabulary)
            out.append(c)
    return [(i, " ".join(x)) for i, x in enumerate(out, 1)]


@pytest.mark.parametrize(("k", "t"), [(3, 0.5), (5, 0.8)])
def test_against_all_pairs(spark, k, t):
    rows = corpus(60)
    rows += [(1000, rows[0][1]), (1001, rows[0][1].upper()), (1002, None), (1003, ""), (1004, "  \n"), (1005, "two words"), (1006, rows[1][1] + " end" * 3)]
    df = spark.createDataFrame(rows, "id long, text string").selectExpr("*", "'x' as a", "2 as rep", "text as set", "1L as key")
    got = {(r.a, r.b) for r in NearDuplicates(df, "id", "text", shingle=k, threshold=t).pairs().collect()}
    s = {i: x for i, text in rows if text and text.strip() and (x := shingles(text, k))}
    want = {(a, b) for a in s for b in s if a < b and len(s[a] & s[b]) >= t * len(s[a] | s[b])}
    assert not got - want and len(want - got) <= len(want) // 100 and len(want) > 5


def test_title_counts_and_long_text(spark):
    long = " ".join(f"q{i}" for i in range(120_000))
    df = spark.createDataFrame([(1, "one title here", long), (2, None, long + " more"), (3, "other", "short text of five words")], "id long, title string, body string")
    nd = NearDuplicates(df, "id", "body", "title", 3, 0.5)
    assert [(r.a, r.b) for r in nd.pairs().collect()] == [(1, 2)] and nd.members.count() == 3


def test_hot_copies_make_no_pairs_of_classes(spark):
    text = "the same words again and again in many rows of one table"
    nd = NearDuplicates(spark.range(500).select("id", F.lit(text).alias("t")), "id", "t", shingle=3, threshold=0.5)
    assert nd.links.count() == 0 and nd.edges().count() == 499 and nd.members.where("rep = 0").count() == 500


def test_empty_and_bad(spark):
    empty = spark.createDataFrame([], "id long, t string")
    assert NearDuplicates(empty, "id", "t").pairs().count() == 0
    with pytest.raises(ValueError, match="0.5"):
        NearDuplicates(empty, "id", "t", threshold=0.3)


@pytest.mark.parametrize("text", ["Ab cd", "", "图像 fusion-2", "é_x ½ ﬁ", "a\nb", "x" * 50, "İstanbul"])
def test_words(text):
    h, first = W.word_hashes([text, "pad", text])
    n = len(WORD.findall(text.lower()))
    assert np.diff(first).tolist() == [n, 1, n] and h[:n].tolist() == h[n + 1 :].tolist()


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(r.randint(200, 400), r.randint(200, 400)) for _ in range(120)] + [(7, 7), (500, 501), (501, 500)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("hot", [1, 3, 7])
def test_hot_keys_and_classes_give_all_pairs(spark, monkeypatch, hot):
    from folialis.llm import near_dup as D

    monkeypatch.setattr(D, "HOT", hot)
    r = random.Random(9)
    keys = [(i, k) for k in range(12) for i in r.sample(range(100), r.choice([1, 2, 3, 5, 8, 20]))]
    table = spark.createDataFrame(keys, "id long, key long")
    arrow = [b for lo in range(0, len(keys), 7) for b in [pa.RecordBatch.from_pandas(table.orderBy("key").toPandas().iloc[lo : lo + 7], preserve_index=False)]]
    out = pa.Table.from_batches(list(D._runs(iter(arrow)))).to_pylist()
    large = spark.createDataFrame([(x["a"], x["b"], x["part"]) for x in out if x["part"] >= 0] or [(0, 0, 0)], "id long, key long, part int")
    got = {(x["a"], x["b"]) for x in out if x["part"] < 0} | {tuple(x) for x in D._across(large.join(large.groupBy("key").agg(F.max("part").alias("last")), "key")).collect()}
    of = {}
    for i, k in keys:
        of.setdefault(k, set()).add(i)
    assert got == {(a, b) for x in of.values() for a in x for b in x if a < b}


def test_pairs_within_large_classes(spark, monkeypatch):
    from folialis.llm import near_dup as D

    monkeypatch.setattr(D, "HOT", 6)
    text = "the same words again and again in many rows of one table"
    nd = NearDuplicates(spark.range(30).select("id", F.lit(text).alias("t")), "id", "t", shingle=3, threshold=0.5)
    assert sorted((r.a, r.b) for r in nd.pairs().collect()) == [(a, b) for a in range(30) for b in range(a + 1, 30)]
