import pytest
from pyspark.sql import functions as F

from folialis.functions import jsonx, markdown, rects, text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(("text", "tokens"), [("图像 Fusion-2 é", ["图", "像", "fusion", "2", "é"]), ("", []), ("  ，。 ", []), ("a_b", ["a", "b"])])
def test_query_tokens(spark, text, tokens):
    assert one(spark, text, T.query_tokens) == tokens == T.tokens_of(text)


def test_api_tokens(spark):
    assert one(spark, "Go，图x1", T.api_tokens) == ["go", "，", "图", "x1"]


def test_snippet(spark):
    long = "a" * 300 + " Needle " + "b" * 300
    s = one(spark, long, lambda c: T.snippet(c, "needle"))
    assert "Needle" in s and s[0] == s[-1] == "…" and len(s) == 162
    assert one(spark, "short needle", lambda c: T.snippet(c, "needle")) == "short needle"
    assert one(spark, "none", lambda c: T.snippet(c, "needle")) == "" == one(spark, "x", lambda c: T.snippet(c, "  "))


def test_excerpts_resume_after_the_window(spark):
    s = "x hit " + "y" * 50 + " hit " + "z" * 50 + " hit"
    assert len(one(spark, s, lambda c: T.excerpts(c, "hit", 3, 20))) == 3
    assert len(one(spark, s, lambda c: T.excerpts(c, "hit", 3, 500))) == 1
    assert one(spark, "nothing", lambda c: T.excerpts(c, "hit")) == []


@pytest.mark.parametrize(("title", "key"), [(" A - B:\t图  c ", "a b图 c"), ("É", ""), ("x\ty", "xy")])
def test_normalize_title(spark, title, key):
    assert one(spark, title, T.normalize_title) == key


def test_title_scores(spark):
    df = spark.createDataFrame([("Image fusion nets", "Image fusion nets now"), ("a b", "c d"), ("", "x"), ("one two", "two three")], "a string, b string")
    got = [tuple(r) for r in df.select(T.title_overlap("a", "b"), T.title_contained("a", "b")).collect()]
    assert got == [(0.75, 1.0), (0.0, 0.0), (0.0, 0.0), (pytest.approx(1 / 3), 0.5)]


@pytest.mark.parametrize(("text", "doi"), [("see 10.1000/abc). and DOI: 10.1234/x.y,", "10.1234/x.y"), ("https://doi.org/10.5555/q;", "10.5555/q"), ("bare 10.1000/abc).", "10.1000/abc"), ("none 10.1/x", ""), ("", "")])
def test_sniff_doi(spark, text, doi):
    assert one(spark, text, T.sniff_doi) == doi


def test_titles(spark):
    assert one(spark, "1 Introduction\narXiv:1\nA plausible title here\nmore", T.sniff_title) == "A plausible title here"
    assert one(spark, "Microsoft Word - draft.doc", T.info_title) == "" == one(spark, "Thesis", T.info_title)
    assert one(spark, "/a/b/my_paper-v1.final.pdf", T.clean_title) == "my paper v1 final"
    assert one(spark, "see www.x.org for the title", T.title_plausible) is False


@pytest.mark.parametrize(("raw", "clean"), [("encoder -decoder", "encoder-decoder"), ("( x )", "(x)"), ("[ 13 ]", "[13]"), ("word , word", "word, word"), ("a : b", "a: b")])
def test_clean_text(spark, raw, clean):
    assert one(spark, raw, T.clean_text) == clean


def test_bib(spark):
    assert one(spark, "a&b_c~^\\{", T.bib_escape) == r"a\&b\_c{\~}{\^{}}\textbackslash{}\{"
    assert one(spark, "Ann B. Lee, Plato,  ", T.bib_authors) == "Lee, Ann B. and Plato"
    df = spark.createDataFrame([("Ann O'Lee", 2020, 7), ("", 0, 8), ("图像", 1999, 9)], "a string, y int, i long")
    assert [r[0] for r in df.select(T.bib_key("a", "y", "i")).collect()] == ["OLee2020", "paper8", "paper91999"]


def test_lists_and_addresses(spark):
    assert one(spark, "1, x, 3,,", T.csv_ids) == [1, 3] and one(spark, " a ,,b", T.csv_values) == ["a", "b"]
    assert one(spark, " HTTPS://Api.Example/v1// ", T.model_base) == "https://api.example/v1"
    for bad in ("ftp://x", "https://u:p@x/", "https://x/?q=1", "https://x/#f", "", "x"):
        assert one(spark, bad, T.model_base) is None
    assert one(spark, "<a href='x'>&", T.html_escape) == "&lt;a href=&#39;x&#39;&gt;&amp;" and one(spark, "javascript:x", T.safe_url) == ""


def test_inverted_index(spark):
    assert one(spark, {"b": [1], "a": [0, 2]}, T.abstract_of_index, "map<string,array<int>>") == "a b a"


def test_json():
    assert jsonx.first_object('x {"a": "}"} y') == '{"a": "}"}' and jsonx.first_object("none") == ""
    assert jsonx.repaired('{"a": 1, "b": [1, 2], "c": "cu') == '{"a": 1, "b": [1, 2]}'
    assert jsonx.repaired('{"a": 1}') == "" == jsonx.repaired('{"a') == jsonx.repaired(None)
    assert jsonx.record('{"year": 2020, "authors": ["A", " ", "B"], "doi": null, "keywords": ["Image Fusion", 123, "LLM"]}', ("year", "authors", "doi", "keywords", "x")) == {"year": "2020", "authors": "A, B", "doi": "", "keywords": "Image Fusion, 123, LLM", "x": ""}
    assert [jsonx.flexible(x) for x in ("true", "false", "1.50", '" a "', "{", "")] == ["true", "", "1.50", "a", "", ""]


def test_json_columns(spark):
    assert one(spark, 'x {"title": " T ", "year": 3', jsonx.decode_meta)["title"] == "T"
    assert one(spark, None, jsonx.extract_object) == ""


def test_rects(spark):
    r = rects.TYPE
    ok = [{"p": 1, "x": 0.1, "y": 0.1, "w": 0.2, "h": 0.02}]
    assert one(spark, ok, rects.valid, r) is True
    for bad in ([], None, [{**ok[0], "p": 0}], [{**ok[0], "w": 0.0}], [{**ok[0], "x": 0.4, "w": 1.0}], [{**ok[0], "x": -0.1}]):
        assert one(spark, bad, rects.valid, r) is False
    line = [{"p": 1, "x": 0.31, "y": 0.101, "w": 0.1, "h": 0.02}, *ok, {"p": 2, "x": 0.1, "y": 0.1, "w": 0.1, "h": 0.02}, {"p": 1, "x": 0.1, "y": 0.2, "w": 0.1, "h": 0.02}]
    got = one(spark, line, rects.merge, r)
    assert [(g.p, round(g.w, 3)) for g in got] == [(1, 0.31), (1, 0.1), (2, 0.1)]
    assert one(spark, "bad json", rects.from_json) == [] and one(spark, [], rects.merge, r) == []


def test_markdown():
    html = markdown.render("# T *x*\n\n- a\n- `b<`\n\n1. one\n\n| h | i |\n|---|---|\n| 1 | 2 |\n\n> q\n\n```py\n<x>\n```\n---\np [t](javascript:1) [u](https://x)\nq")
    assert "<h1>T <em>x</em></h1>" in html and "<ul><li>a</li><li><code>b&lt;</code></li></ul>" in html and "<ol><li>one</li></ol>" in html
    assert "<td>1</td><td>2</td>" in html and "<blockquote>q</blockquote>" in html and '<pre><code class="lang-py">&lt;x&gt;</code></pre>' in html and "<hr>" in html
    assert "javascript" not in html and 'href="https://x"' in html and "<br>q</p>" in html
    assert markdown.render(None) == ""


def test_markdown_html_of_all_kinds(spark, tmp_path):
    from folialis.plans.library_queries import markdown_html

    rows = [(1, "note", "# a"), (2, "summary", "# b"), (3, None, "c"), (4, "excerpt", None)]
    spark.createDataFrame(rows, "doc_id long, kind string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.html for r in markdown_html(spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 2, 3] and got[2] == got[1].replace("a", "b")
