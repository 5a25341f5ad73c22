"""Text functions as column expressions: they stay inside the JVM and in code generation."""

from __future__ import annotations

import string
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The columns that a search looks into.
SEARCHED = ("title", "authors", "venue", "doi", "keywords", "summary", "fulltext")
#: What a title may not contain, and what may not begin a title line.
TITLE_BARRED = ("http://", "https://", "www.", "doi.org", "arxiv:")
LINE_BARRED = ("arxiv:", "doi:", "doi.org", "http://", "https://", "www.", "©", "copyright", "isbn", "issn")
LINE_JUNK = (
    "abstract", "contents", "table of contents", "references", "acknowledg", "keywords", "index terms", "vol.", "no. ",
    "introduction", "conclusion", "related work", "摘要", "关键词", "参考文献", "目录", "附录",
)
FIRST_LINE_JUNK = ("doi", "copyright", "abstract", "http", "www", "arxiv:", "@", "©")
INFO_TITLE_BARRED = ("appendix", "untitled", "unknown", "microsoft word", "powerpoint", "layout", "print", "slide", ".doc", ".pdf", ".tex")
ELLIPSIS = "…"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold_ascii(x: Column | str) -> Column:
    """Lower case of A to Z only, as a store without Unicode folding compares."""
    return F.translate(_c(x), string.ascii_uppercase, string.ascii_lowercase)


def matches(needle: str, columns: Sequence[str] = SEARCHED, strict: bool = False) -> Column | None:
    """Whether any column holds the needle; % and _ in it are wildcards. None for a blank needle.

    strict folds only ASCII in the columns, though the needle is folded wholly.
    """
    n = needle.strip().lower()
    if not n:
        return None
    pattern = "%" + n.replace("\\", "\\\\") + "%"
    fold = fold_ascii if strict else (lambda x: F.lower(_c(x)))
    return reduce(lambda a, b: a | b, (F.coalesce(fold(c).like(pattern), F.lit(False)) for c in columns))


def tokens_of(query: str) -> list[str]:
    """The tokens of a query on the driver, as query_tokens gives them."""
    out: list[str] = []
    run = ""
    for ch in query.strip().lower():
        if not (ch.isalpha() or ch.isnumeric()) or ch > "⺀":
            out += [run] if run else []
            run = ""
            out += [ch] if ch > "⺀" and (ch.isalpha() or ch.isnumeric()) else []
        else:
            run += ch
    return out + ([run] if run else [])


def query_tokens(x: Column | str) -> Column:
    """Runs of letters and numbers in lower case; each character above U+2E80 is a token by itself."""
    apart = F.regexp_replace(F.lower(F.trim(_c(x))), r"([\x{2E81}-\x{10FFFF}])", " $1 ")
    return F.regexp_extract_all(apart, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def api_tokens(x: Column | str) -> Column:
    """Runs of a-z and 0-9 in lower case; any character above U+2E80 is a token, marks included."""
    return F.regexp_extract_all(F.lower(F.trim(_c(x))), F.lit(r"[a-z0-9]+|[\x{2E81}-\x{10FFFF}]"), F.lit(0))


def first_hit(low: Column, tokens: Sequence[str], start: Column | int = 1) -> Column:
    """The first place (from 1) of any token at or after start, null if there is none."""
    at = F.lit(start) if isinstance(start, int) else start
    places = F.array(*(F.call_function("locate", F.lit(t), low, at) for t in tokens))
    return F.array_min(F.filter(places, lambda p: p > 0))


def snippet(text: Column | str, query: str, size: int = 160) -> Column:
    """A window around the first hit of any token, with an ellipsis where it is cut; '' without a hit. Counts characters."""
    t, toks = _c(text), tokens_of(query)
    if not toks:
        return F.lit("")
    hit = first_hit(F.lower(t), toks)
    start = F.greatest(hit - 1 - size // 2, F.lit(0))
    body = F.substring(t, start + 1, F.lit(size))
    cut = F.concat(F.when(start > 0, ELLIPSIS).otherwise(""), body, F.when(start + size < F.length(t), ELLIPSIS).otherwise(""))
    return F.when(hit.isNull(), "").otherwise(F.trim(cut))


def excerpts(text: Column | str, query: str, count: int = 3, size: int = 500) -> Column:
    """Up to ``count`` windows around hits, each search resumed at the end of the window before. Counts characters."""
    t, toks = _c(text), tokens_of(query)
    if not toks:
        return F.array().cast("array<string>")
    low = F.lower(t)
    start = lambda hit: F.greatest(hit - 1 - size // 2, F.lit(0))
    # an array of hits grows by one element at a time; each element is written once
    hits = F.array(first_hit(low, toks, 1))
    for _ in range(count - 1):
        hits = F.flatten(F.transform(F.array(hits), lambda h: F.concat(h, F.array(first_hit(low, toks, F.least(start(F.element_at(h, -1)) + size, F.length(t)) + 1)))))
    return F.transform(F.filter(hits, lambda h: h.isNotNull()), lambda h: F.trim(F.substring(t, start(h) + 1, F.least(start(h) + size, F.length(t)) - start(h))))


def truncated(x: Column | str, most: int) -> Column:
    """The first characters of a text."""
    return F.substring(_c(x), 1, most)


def normalize_title(x: Column | str) -> Column:
    """A key for equal titles: letters a-z, digits, Chinese characters and single blanks. Tabs and line ends are dropped."""
    kept = F.regexp_replace(F.lower(_c(x)), r"[^a-z0-9\x{4e00}-\x{9fff} ]", "")
    return F.trim(F.regexp_replace(kept, " +", " "))


def first_author(x: Column | str) -> Column:
    """The text before the first comma, without blanks around."""
    return F.trim(F.split_part(_c(x), F.lit(","), F.lit(1)))


def title_tokens(x: Column | str) -> Column:
    """The distinct runs of letters and numbers of a title in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.trim(_c(x))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def title_overlap(a: Column | str, b: Column | str) -> Column:
    """Jaccard similarity of the tokens of two titles, 0 if one has none."""
    x, y = title_tokens(a), title_tokens(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y)).cast("double")), F.lit(0.0))


def title_contained(a: Column | str, b: Column | str) -> Column:
    """1 if either title holds the other, else the share of a's tokens that b has; 0 if one is blank."""
    x, y = F.lower(F.trim(_c(a))), F.lower(F.trim(_c(b)))
    share = F.coalesce(F.try_divide(F.size(F.array_intersect(title_tokens(x), title_tokens(y))).cast("double"), F.size(title_tokens(x)).cast("double")), F.lit(0.0))
    return F.when((x == "") | (y == ""), 0.0).when(F.contains(x, y) | F.contains(y, x), 1.0).otherwise(share)


def _holds(low: Column, words: Sequence[str]) -> Column:
    return reduce(lambda p, q: p | q, (F.contains(low, F.lit(w)) for w in words))


def _begins(low: Column, words: Sequence[str]) -> Column:
    return reduce(lambda p, q: p | q, (F.startswith(low, F.lit(w)) for w in words))


def title_plausible(x: Column | str) -> Column:
    """8 to 300 characters, no address or DOI mark, at least 45 % letters and digits."""
    t = F.trim(_c(x))
    kept = F.length(F.regexp_replace(t, r"[^\p{L}\p{Nd}]", ""))
    return F.length(t).between(8, 300) & ~_holds(F.lower(t), TITLE_BARRED) & (kept >= F.length(t) * F.lit(0.45))


def plausible_text(x: Column | str, least: int, most: int, ratio: float) -> Column:
    """A line that may belong to a title: length, no junk, enough letters (whatever is not ASCII counts as one)."""
    t = F.trim(_c(x))
    low = F.lower(t)
    kept = F.length(F.regexp_replace(t, r"[^a-zA-Z0-9\x{80}-\x{10FFFF}]", ""))
    return F.length(t).between(least, most) & ~_holds(low, LINE_BARRED) & ~_begins(low, LINE_JUNK) & ~low.rlike(r"^page \d") & (kept >= F.length(t) * F.lit(ratio))


def plausible_line(x: Column | str) -> Column:
    return plausible_text(x, 4, 300, 0.5)


def plausible_title(x: Column | str) -> Column:
    return plausible_text(x, 8, 300, 0.45)


def info_title(x: Column | str) -> Column:
    """The title that a file states about itself, '' if it is a file name, a stock word or a single short word."""
    t = F.trim(_c(x))
    good = ~_holds(F.lower(t), INFO_TITLE_BARRED) & (F.contains(t, F.lit(" ")) | (F.length(t) >= 12)) & plausible_text(t, 4, 300, 0.4)
    return F.when(good, t).otherwise("")


def clean_title(x: Column | str) -> Column:
    """A title from a file name: the last part of the path without its ending, with blanks for _ - and dots."""
    base = F.regexp_extract(_c(x), r"([^/]*)/*$", 1)
    return F.trim(F.translate(F.regexp_replace(base, r"\.[^.]*$", ""), "_-.", "   "))


def bare_doi(x: Column | str) -> Column:
    """A DOI as it is compared: trimmed, in lower case, without an address or a label before it."""
    return F.lower(F.regexp_replace(F.trim(_c(x)), r"(?i)^(https?://(dx\.)?doi\.org/|doi:\s*)", ""))


def sniff_doi(x: Column | str, scanned: int = 16384) -> Column:
    """The first DOI after doi.org/ or doi:, else the first bare one, without marks at its end; '' if there is none."""
    head = F.substring(_c(x), 1, scanned)
    stated = F.regexp_extract(head, r"(?i)(?:https?://doi\.org/|doi:\s*)(10\.[0-9]{4,9}/[^\s]+)", 1)
    bare = F.regexp_extract(head, r"10\.[0-9]{4,9}/[^\s]+", 0)
    return F.regexp_replace(F.when(stated != "", stated).otherwise(bare), r"""[.,;:)\]}"']+$""", "")


#: What a title line of a file may not begin with, and the form of a DOI in it.
FILE_LINE_JUNK, LINE_DOI = ("http", "arxiv", "doi:", "©"), r"(?i)\b10\.\d{4,9}/[^\s\"'<>()\[\]{}]+"


def sniff_file_title(x: Column | str, scanned: int = 8192) -> Column:
    """The first line near the start of a file's text that may be its title: 8 to 200 characters, begun by no digit or junk, no DOI in it; '' if there is none."""
    lines = F.transform(F.split(F.substring(_c(x), 1, scanned), "\n"), lambda s: F.trim(s))
    good = F.filter(lines, lambda s: F.length(s).between(8, 200) & ~s.rlike("^[0-9]") & ~_begins(F.lower(s), FILE_LINE_JUNK) & ~s.rlike(LINE_DOI) & plausible_line(s))
    return F.coalesce(F.try_element_at(good, F.lit(1)), F.lit(""))


def sniff_title(x: Column | str) -> Column:
    """The first line that may be a title, '' if there is none."""
    lines = F.transform(F.split(_c(x), "\n"), lambda s: F.trim(s))
    good = F.filter(lines, lambda s: F.length(s).between(5, 200) & ~s.rlike(r"^\p{Nd}") & ~_begins(F.lower(s), FIRST_LINE_JUNK) & title_plausible(s))
    return F.coalesce(F.try_element_at(good, F.lit(1)), F.lit(""))


def normalize_text(x: Column | str) -> Column:
    """Runs of blanks and of line ends as one; no blank after a line end."""
    one = F.regexp_replace(_c(x), r"[ \t\r\f\x0B]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(one, r"\n[ \n]*", "\n"), r"^\s+|\s+$", ""))


#: Repairs of spacing in extracted text, in the order in which they apply.
SPACING = ((r"\s+-\s*", "-"), (r"\(\s+", "("), (r"\s+\)", ")"), (r"\[\s+([^\]]+?)\s+\]", "[$1]"), (r"\s+([,.;!?])", "$1"), (r"\s+:([^:]|$)", ":$1"), (r"[ \t]+", " "))


def clean_text(x: Column | str) -> Column:
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), SPACING, _c(x))


def clean_abstract(x: Column | str) -> Column:
    """An abstract without the markup of its record."""
    t = F.regexp_replace(F.regexp_replace(F.trim(_c(x)), "^<jats:abstract>", ""), "</jats:abstract>$", "")
    return F.trim(F.replace(F.replace(t, F.lit("<jats:title>")), F.lit("</jats:title>")))


def abstract_of_index(x: Column | str) -> Column:
    """The text of an inverted index map<word, places>."""
    pairs = F.flatten(F.transform(F.map_entries(_c(x)), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda s: s["w"]), " ")


def bib_escape(x: Column | str) -> Column:
    """Marks that a BibTeX value must escape, each once."""
    escaped = {"~": "{\\~}", "^": "{\\^{}}", "\\": "\\textbackslash{}"} | {c: "\\" + c for c in "&%$#_{}"}
    table = F.create_map(*(F.lit(v) for kv in escaped.items() for v in kv))
    # only fields with such a mark are taken apart
    apart = F.transform(F.split(_c(x), ""), lambda c: F.coalesce(F.try_element_at(table, c), c))
    return F.when(_c(x).rlike(r"[&%$#_{}~^\\]"), F.array_join(apart, "")).otherwise(_c(x))


def bib_author(x: Column) -> Column:
    """'First Last' as 'Last, First'; with a comma or a single word as it is."""
    words = F.filter(F.split(F.trim(x), r"\s+"), lambda w: w != "")
    turned = F.concat(F.element_at(words, -1), F.lit(", "), F.array_join(F.slice(words, 1, F.size(words) - 1), " "))
    return F.when(F.contains(x, F.lit(",")) | (F.size(words) <= 1), F.trim(x)).otherwise(turned)


def bib_authors(x: Column | str) -> Column:
    """Comma-separated authors, joined by 'and'. A name with a comma counts as two, as the field is split at commas."""
    names = F.filter(F.transform(F.split(_c(x), ","), lambda s: F.trim(s)), lambda s: s != "")
    return F.array_join(F.transform(names, bib_author), " and ")


def bib_key(authors: Column | str, year: Column | str, id: Column | str) -> Column:
    """The first author's family name, else paper<id>, and the year if it is known."""
    family = F.split_part(bib_author(F.split_part(_c(authors), F.lit(","), F.lit(1))), F.lit(","), F.lit(1))
    name = F.regexp_replace(F.when(F.trim(_c(authors)) != "", family).otherwise(""), "[^A-Za-z0-9]", "")
    y = _c(year)
    return F.concat(F.when(F.coalesce(name, F.lit("")) != "", name).otherwise(F.concat(F.lit("paper"), _c(id).cast("string"))), F.when(y > 0, y.cast("string")).otherwise(""))


def csv_values(x: Column | str) -> Column:
    """The values of a comma-separated parameter, without blank ones."""
    return F.filter(F.transform(F.split(_c(x), ","), lambda s: F.trim(s)), lambda s: s != "")


def csv_ids(x: Column | str) -> Column:
    """The whole numbers of a comma-separated parameter; the rest is ignored."""
    return F.filter(F.transform(csv_values(x), lambda s: F.when(s.rlike(r"^[+-]?\d{1,18}$"), s.cast("long"))), lambda n: n.isNotNull())


def model_base(x: Column | str) -> Column:
    """A base address in its normal form; null unless http(s), without user, query and fragment."""
    u = F.trim(_c(x))
    part = lambda k: F.try_parse_url(u, F.lit(k))
    ok = F.lower(part("PROTOCOL")).isin("http", "https") & part("HOST").isNotNull() & part("USERINFO").isNull() & ~u.rlike("[?#]")
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z]+://([^/]*)", 1))
    return F.when(ok, F.concat(F.lower(part("PROTOCOL")), F.lit("://"), host, F.regexp_replace(F.coalesce(part("PATH"), F.lit("")), "/+$", "")))


def html_escape(x: Column | str) -> Column:
    c = F.replace(_c(x), F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def safe_url(x: Column | str) -> Column:
    """An address with an allowed scheme, else ''."""
    u = F.trim(_c(x))
    return F.when(u.rlike(r"(?i)^(https?://|mailto:|/|#)"), u).otherwise("")


def parse_time(x: Column | str) -> Column:
    """ISO 8601, then 'YYYY-MM-DD HH:MM:SS'; null if it is neither."""
    return F.coalesce(F.try_to_timestamp(_c(x)), F.try_to_timestamp(_c(x), F.lit("yyyy-MM-dd HH:mm:ss")))
