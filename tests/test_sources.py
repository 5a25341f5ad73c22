import zlib

import pytest
from pyspark.sql import functions as F

from folialis.plans import ingest
from folialis.sources import model_list, pdf
from folialis.sources.snapshots import Snapshots  # noqa: F401


def make_pdf(*pages: str, info: str = "", encrypt: str = "", squeeze: bool = True) -> bytes:
    out = b"%PDF-1.4\n" + encrypt.encode()
    for p in pages:
        body = zlib.compress(p.encode("latin-1")) if squeeze else p.encode("latin-1")
        out += b"1 0 obj <<" + (b"/Filter /FlateDecode " if squeeze else b"") + b"/Length %d>>\nstream\n" % len(body) + body + b"\nendstream\nendobj\n"
    return out + info.encode("latin-1") + b"\n%%EOF"


PAGE = "BT /F1 18 Tf 72 700 Td (A Study of \\(Plain\\) Files for) Tj 0 -20 Td (Careful Readers) Tj /F1 10 Tf 0 -30 Td [(Wor) -20 (ds) -300 (apart)] TJ 0 -12 Td (doi: 10.1234/abc.) Tj ET"


def test_lines_and_title():
    for squeeze in (True, False):
        lines = pdf.lines_of(make_pdf(PAGE, squeeze=squeeze))
        assert [t for *_, t in lines] == ["A Study of (Plain) Files for", "Careful Readers", "Words apart", "doi: 10.1234/abc."]
        assert pdf.title_by_size(lines) == "A Study of (Plain) Files for Careful Readers"
    assert pdf.lines_of(b"no pdf") == [] == pdf.lines_of(make_pdf(PAGE, encrypt="/Encrypt 3 0 R\n"))


def test_title_tiers():
    assert pdf.title_by_size([(1, 14.3, "Deep Methods in Reading"), (1, 14.3, "Ann Lee Bob Ray"), (1, 9.0, "body text follows here")]) == "Deep Methods in Reading"
    assert pdf.title_by_size([(1, 20.0, c) for c in "图像融合研究方法综述"]) == "图像融合研究方法综述"
    assert pdf.title_by_size([(1, 30.0, "@@@@ !!!! ****"), (1, 12.0, "the second tier wins here")]) == "the second tier wins here" and pdf.title_by_size([]) == ""


def test_vertical_runs_compare_with_the_head():
    lines = [(1, 10.0, "图"), (1, 10.15, "像"), (1, 10.3, "融"), (1, 8.0, "word")]
    assert [t for *_, t in pdf.joined_vertical(lines)] == ["图像", "融", "word"]


def test_cmap_and_decoding():
    m = pdf.cmap(b"2 beginbfchar <0001> <0041> <0002> <4E2D> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange")
    assert m == {b"\0\1": "A", b"\0\2": "中", b"\0\x10": "a", b"\0\x11": "b", b"\0\x12": "c"}
    assert pdf.decode(b"\0\1\0\2", m) == "A中" and pdf.decode(b"caf\xe9") == "café" and pdf.decode(b"\xfe\xff\x4e\x2d") == "中"


def test_ingest(spark, make_papers, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a_b.pdf").write_bytes(make_pdf(PAGE, info="<< /Title (The Own Title of This File) /Author (Ann Lee) >>"))
    (tmp_path / "in/empty.pdf").write_bytes(b"")
    (tmp_path / "in/not.pdf").write_bytes(b"text")
    (tmp_path / "in/scan_of-page.pdf").write_bytes(make_pdf())
    got = {r.title: r for r in ingest.incoming(pdf.files(spark, str(tmp_path / "in"))).collect()}
    assert set(got) == {"The Own Title of This File", "scan of page"} and got["The Own Title of This File"].doi == "10.1234/abc"
    old = make_papers({"doi": "10.1234/ABC"})
    papers, same = ingest.ingested(old, pdf.files(spark, str(tmp_path / "in")), "2025-01-01 00:00:00")
    assert papers.count() == 2 and [r.paper_id for r in same.collect()] == [1]
    assert ingest.ingested(old, pdf.files(spark, str(tmp_path / "in")), "2025-01-01 00:00:00", force=True)[0].count() == 3


def test_answers(spark, make_papers):
    p = make_papers({"title": "t", "fulltext": "body"}, {"title": "u"})
    answers = lambda prompts: prompts.select("id", F.lit('Sure: {"venue": "V", "year": 1999, "keywords": ["a", "b"], "ti').alias("answer"))
    r = ingest.described(p.select("id", "title", "authors", "year", "venue", "doi", "keywords", "fulltext"), answers=answers).orderBy("id").first()
    assert (r.title, r.year, r.venue, r.keywords) == ("t", 1999, "V", "a, b")
    done = ingest.summarised(p, lambda x: x.select("id", F.lit(" short ").alias("answer")), "2025-01-01 00:00:00").orderBy("id").collect()
    assert [x.summary for x in done] == ["short", ""]


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ('{"data": [{"id": "zeta"}, {"id": " alpha ", "name": "A"}, {"id": "alpha"}, {"id": " "}, {"id": "vec", "supported_protocols": ["openai:embeddings"]}, {"id": "chat2", "supported_protocols": ["openai:chat"]}]}', ["alpha", "chat2", "zeta"]),
        ('[{"id": "b"}, {"id": "a"}]', ["a", "b"]), ('{"models": [{"id": "m"}]}', ["m"]), ("{}", []), ("bad", []),
    ],
)
def test_model_list(spark, body, want):
    assert [r.id for r in model_list.parsed(spark.createDataFrame([(body,)], "b string"), "b").collect()] == want


def test_feed(spark):
    atom = '<feed><entry><title>A  b</title><published>2020-01-02T00:00:00Z</published><id>u</id><author><name>X</name></author><author><name>Y</name></author></entry><entry><title>C</title><published>n</published><id>v</id><author><name>Z</name></author></entry></feed>'
    assert [tuple(r) for r in ingest.feed_entries(spark.createDataFrame([(atom,)], "b string"), "b").collect()] == [("A b", 2020, "u", "X, Y"), ("C", None, "v", "Z")]


def test_streaming(spark, tmp_path):
    from folialis.streaming.arrivals import arriving, counted

    rows = spark.sql("select id, 'note' as kind, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(id as int)) as created_at from range(10) union all select 3, 'note', timestamp_ntz'2024-01-04 00:00:00'")
    rows.write.parquet(f"{tmp_path}/in")
    q = counted(arriving(spark, f"{tmp_path}/in", rows.schema)).writeStream.format("memory").queryName("arrived").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("arrived").agg(F.sum("n")).first()[0] == 10
