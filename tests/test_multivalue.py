import pytest

from folialis.operators.multivalue import Model, lex, split_values, viterbi


def items(kind, s):
    return viterbi(kind, *lex(s), Model())


@pytest.mark.parametrize(
    ("s", "want"),
    [
        ("Ann Lee; Bob Ray", ["Ann Lee", "Bob Ray"]), ("Lee, A.; Ray, Bob", ["Lee, A.", "Ray, Bob"]), ("Verkel, M., Selga, J.K., von Dasel, Z.", ["Verkel, M.", "Selga, J.K.", "von Dasel, Z."]),
        ('["Lee, Ann", "O\'Ray, B."]', ["Lee, Ann", "O'Ray, B."]), ("['Ann Lee', \"B. O'Ray\"]", ["Ann Lee", "B. O'Ray"]), ('"Lee, Ann", "Ray, Bob"', ["Lee, Ann", "Ray, Bob"]), ("Ann Lee\r\n\r\nBob Ray", ["Ann Lee", "Bob Ray"]),
        ("Ann Lee, Bob Ray and Cy Day", ["Ann Lee", "Bob Ray", "Cy Day"]), ("Lee, A., Ray, B., and Day, C.", ["Lee, A.", "Ray, B.", "Day, C."]), ("Ann Lee, Bob Ray et al.", ["Ann Lee", "Bob Ray"]), ("Lee A, Ray BC", ["Lee A", "Ray BC"]),
        ("Ann Lee*, Bob Ray2", ["Ann Lee*", "Bob Ray2"]), ("Ann Lee,, Bob Ray,", ["Ann Lee", "Bob Ray"]), ("Bawen, Isabella", ["Bawen, Isabella"]), ("棠远怀, 翎 若舟", ["棠远怀", "翎 若舟"]), ("Ray, U. A.", ["Ray, U. A."]), ("Ann Lee u. a.", ["Ann Lee"]), ("Ray, B. ; vn Lee, D.", ["Ray, B.", "vn Lee, D."]), ("Ann Lee, BIC", ["Ann Lee", "BIC"]), ("EJOT, Lensto O", ["EJOT", "Lensto O"]), ("Ann Lee / Bob Ray", ["Ann Lee", "Bob Ray"]), ("", []), (" ; , ", []), ("et al.", []),
    ],
)
def test_authors(s, want):
    assert items("authors", s) == want


@pytest.mark.parametrize(
    ("s", "want"),
    [
        ("Keywords: a b; c", ["a b", "c"]), ('"maps, tidal"; "so-called ""dark"" data"; """cold"" starts"', ["maps, tidal", 'so-called "dark" data', '"cold" starts']), ("(a) x; (b) y", ["x", "y"]), ("1) x y 2) z", ["x y", "z"]), ("• a • b", ["a", "b"]), ("- a\n- b", ["a", "b"]),
        ("{client/server}, {b}", ["client/server", "b"]), ("“a b” “c”", ["a b", "c"]), ("a<br/>b", ["a", "b"]), ("a — b // c -- d", ["a", "b", "c", "d"]), ("C++; R&D tooling; on/off control", ["C++", "R&D tooling", "on/off control"]), ('["a \\"b\\" c", "d"]', ['a "b" c', "d"]), ("x, y;z | w", ["x", "y", "z", "w"]), ("a,a", ["a", "a"]),
    ],
)
def test_keywords(s, want):
    assert items("keywords", s) == want


def test_learns_values_with_separators_inside(spark):
    rows = [(i, "", f'["search and rescue", "t{i % 7}", "maps, tidal"]') for i in range(20)]
    rows += [(100 + i, "", f"t{i % 7}, t{(i + 1) % 7} and t{(i + 2) % 7}") for i in range(20)]
    rows += [(200, "Lee, A.; Ray, B.", "t1, search and rescue, maps, tidal, t2"), (201, None, None), (202, " ", ""), (203, "Ann Lee" + ", Bob Ray" * 2000, "x")]
    df = spark.createDataFrame(rows, "id long, authors string, keywords string").selectExpr("*", "'clash' as item", "1 as pos")
    got = {}
    for r in split_values(df, "id", ["authors", "keywords"]).collect():
        got.setdefault((r.id, r.field_name), {})[r.pos] = r.item
    listed = lambda k: [got[k][p] for p in sorted(got[k])]
    assert listed((200, "keywords")) == ["t1", "search and rescue", "maps, tidal", "t2"] and listed((200, "authors")) == ["Lee, A.", "Ray, B."]
    assert listed((101, "keywords")) == ["t1", "t2", "t3"] and len(listed((203, "authors"))) == 2001
    assert not any(k[0] in (201, 202) for k in got)


def test_empty_table(spark):
    assert split_values(spark.createDataFrame([], "id long, authors string, keywords string"), "id", ["authors", "keywords"]).count() == 0


def test_terms_with_several_separators_inside(spark):
    rows = [(i, "A. Lee", f"term {i % 9}, research, development and innovation, other {i % 7}") for i in range(60)] + [(100 + i, "B. Ray", f"term {i % 9}, innovation {i % 5}") for i in range(40)]
    out = {}
    for r in split_values(spark.createDataFrame(rows, "id long, authors string, keywords string"), "id", ["authors", "keywords"]).where("field_name = 'keywords'").collect():
        out.setdefault(r.id, {})[r.pos] = r["item"]
    assert [out[3][k] for k in sorted(out[3])] == ["term 3", "research, development and innovation", "other 3"] and list(out[103].values()) == ["term 3", "innovation 3"]
