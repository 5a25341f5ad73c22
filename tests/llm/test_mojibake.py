import os

import numpy as np
import pytest

from folialis.llm.mojibake import SINGLE, byte_table, find

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
CLEAN = [
    "Près du lac, l’équipe a étudié la détection d’échos à grande échelle.", "Die größenbeschränkte Prüfsumme überträgt sich gleichmäßig auf Straßenschilder.", "The range 10–20 was searched near Brévalle Bay at 20 °C, with ±3 and “quotes”.",
    "本文研究人流计数，并讨论半数标签缺失的情形。实验表明，图中的结果可靠。", "Un essai « différé » coûte 5 £ près de la forêt, où l’été s’étend.",
]
RARE = ["ANGLES Â AND Ê DENOTE SÃO BREVAL", "КРАТКИЙ ОБЗОР МЕТОДОВ» и краткий обзор методов»", "The signs ½ ¾ √2 α β Δ © Å ﬁ", "Zażółć gęślą jaźń, ışık ölçümü", "图3与表5以A为例", "plain ascii", "краткий обзор методов» и обзор"]


def misread(s, x):
    return "".join(byte_table(x)[b] for b in s.encode())


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, CLEAN[i % len(CLEAN)], CLEAN[(i + 1) % len(CLEAN)] + f" No. {i}") for i in range(150)]
    rows += [(1000 + i, s, "x") for i, s in enumerate(RARE)]
    k = 2000
    expect = {}
    for n, s in enumerate(CLEAN):
        for x in SINGLE[:7]:
            rows.append((k, misread(s, x), "x"))
            expect[k] = s
            k += 1
    rows.append((3000, "x", misread(misread(CLEAN[0], "cp1252"), "cp1252")))
    rows.append((3001, CLEAN[3].encode("gbk").decode("latin-1"), None))
    rows.append((3002, "", CLEAN[2] + " " + misread(CLEAN[2], "cp1252")))
    rows.append((3003, "na�ve", None))
    rows.append((3004, CLEAN[3].encode().decode("gbk", "replace"), ""))
    rows.append((3005, "lost â€? here", misread("ï", "cp1252").replace("Ã", "&Atilde;") + " nave naïve"))
    df = spark.createDataFrame(rows, "id long, title string, fulltext string").selectExpr("*", "'c' as field_name", "true as whole", "1 as cell")
    return {(r.id, r.field_name): (r.restored, r.whole) for r in find(df, "id", ["title", "fulltext"]).collect()}, expect


def test_no_false_alarm(found):
    assert not [k for k in found[0] if k[0] < 2000]


def test_single_byte_misreadings(found):
    got, expect = found
    missed = [k for k in expect if (k, "title") not in got]
    assert not missed
    right = sum(got[k, "title"][0] == s for k, s in expect.items())
    assert right >= 0.9 * len(expect)


def test_other_ways(found):
    got, _ = found
    assert got[3000, "fulltext"][0] == CLEAN[0]
    assert got[3001, "title"][0] == CLEAN[3]
    assert got[3002, "fulltext"][0].count("“quotes”") == 2 and (3002, "title") not in got
    assert got[3003, "title"][1] is False and (3004, "title") in got and (3005, "title") in got and (3005, "fulltext") in got


def test_empty(spark):
    assert find(spark.createDataFrame([], "id long, title string, fulltext string"), "id", ["title", "fulltext"]).count() == 0


def test_margin_counts_all_records(spark):
    from folialis.llm import mojibake as J

    # a model that knows the Chinese reading of two accented letters better than the letters, which only late records hold
    text = f"x {'éà'.encode('latin-1').decode('gbk')} y " * 1000
    model = J.Model(np.concatenate([np.bincount(c, minlength=J.CELLS) for c in J._codes(J._points(text))]).astype(np.float32))
    rows = [(i, "x plain y" if i < 2000 else "x éà y") for i in range(2050)]
    df = spark.createDataFrame(rows, "id long, title string").coalesce(1)
    assert J.validated_margin(df.where("id < 2000"), ["title"], model) == J.LEAST_MARGIN
    assert J.validated_margin(df, ["title"], model) > J.LEAST_MARGIN


def test_labelled_spans():
    from folialis.llm import mojibake as J

    got = list(J.labelled("краткий обзор методов» и обзор"))
    assert any(case == 0 and J.CHAINS[k] == "utf-8 as cp1251" for case, k, *_ in got) and any(case for case, *_ in got)
    model = J.Model(np.ones(3 * J.CELLS, np.float32))
    spans = [x for s in CLEAN + RARE for x in J.labelled(s)]
    alone = [model.gain(a + s + z, len(a), len(a + s), r) for _, _, a, s, r, z in spans]
    assert np.allclose(J.gains(spans, model), alone)


def test_margin_of_each_chain():
    from folialis.llm import mojibake as J

    table = np.zeros((2, len(J.CHAINS), J.BINS), np.int64)
    table[0, 0, 0], table[0, 1, J.BINS // 2 + 20] = 1_000_000, 10
    # the few spans of one chain are not lost among the many of another
    assert J.margin_of(table) == 21 * J.WIDE
    table[1, 2, J.BINS // 2 + 8] = 50
    assert J.margin_of(table) == 8 * J.WIDE


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_planted_records_are_restored(spark):
    """Clean records of the tables garbled by every chain: what held no loss must come back as it was."""
    from folialis.llm import mojibake as J

    rows = spark.read.parquet(f"{SF}/papers.parquet").select("id", "title", "summary").where("title is not null").collect()
    clean = [(r.id, r.title, r.summary or "") for r in rows if not any(J.suspect(x) and J.suspicious(x) for x in (r.title, r.summary or ""))]
    planted, k = {}, 1_000_000
    for n, (_, title, summary) in enumerate(clean):
        text = f"{title}. {summary}"
        wrong = J.garble(text, J.CHAINS[n % len(J.CHAINS)])
        # control characters that a page would not keep are losses
        if not text.isascii() and wrong and wrong != text and not J._LOSS.search(wrong):
            planted[k] = (text, wrong, J.CHAINS[n % len(J.CHAINS)])
            k += 1
    df = spark.createDataFrame([*clean, *((i, "x", wrong) for i, (_, wrong, _) in planted.items())], "id long, title string, summary string")
    got = {(r.id, r.field_name): r.restored for r in find(df, "id", ["title", "summary"]).collect()}
    right = [got.get((i, "summary")) == text for i, (text, _, _) in planted.items()]
    assert len(planted) > 20 and sum(right) >= 0.9 * len(right)
    assert not [key for key in got if key[0] < 1_000_000]
