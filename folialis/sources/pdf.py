"""Text and titles of PDF files, without a library: streams are inflated and their text operators read.

Reads what a Spark binaryFile scan gives (path, content), one file at a time within a task. Files that are not PDF, encrypted ones
and those without text give an empty text; a broken stream is skipped.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import accumulate, pairwise

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folialis.functions import text as T

#: Bounds of a file that is scanned and of the text that is kept.
ENCRYPT_WITHIN, MOST_TEXT, MOST_STREAM = 2048, 5 << 20, 64 << 20
#: Kerning (thousandths of the font's size) from which a move is a blank.
KERN_BLANK = -150.0
#: Sizes that are tried for a title, how near to one of them a line's size is, the words of a title after which no line is added, and
#: how many words a line of names has and how long they are at most.
TIERS, NEAR_SIZE, TITLE_WORDS, NAMES, NAME_LENGTH = 3, 0.5, 40, range(2, 15), 14
#: Words after which a title line goes on.
FUNCTION_WORDS = frozenset("for of and with in on to by a an the via using from as at into onto over under".split())

_STREAM = re.compile(rb"stream\r?\n")
_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b")
_REFERENCE = re.compile(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R\b")
_TOKEN = re.compile(rb"""\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<<|>>|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]*|[-+]?\d*\.?\d+|[A-Za-z'"*]+""", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_BF = re.compile(rb"begin(bfchar|bfrange)(.*?)endbf", re.S)
_HEX = re.compile(rb"<([0-9A-Fa-f\s]*)>")


def _unescape(s: bytes) -> bytes:
    def one(m: re.Match) -> bytes:
        c = m[1]
        if c[:1].isdigit():
            return bytes([int(c, 8) & 0xFF])
        return b"" if c in (b"\n", b"\r\n", b"\r") else _ESCAPES.get(c, c)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, s, flags=re.S)


def _hex(s: bytes) -> bytes:
    d = re.sub(rb"\s", b"", s)
    return bytes.fromhex((d + b"0" * (len(d) % 2)).decode())


def cmap(data: bytes) -> dict[bytes, str]:
    """The codes of a ToUnicode map."""
    out: dict[bytes, str] = {}
    u = lambda b: b.decode("utf-16-be", "replace")
    for kind, body in _BF.findall(data):
        if kind == b"bfchar":
            codes = [_hex(h) for h in _HEX.findall(body)]
            out.update((k, u(v)) for k, v in zip(codes[::2], codes[1::2], strict=False))
            continue
        for m in re.finditer(rb"<([^>]*)>\s*<([^>]*)>\s*(?:<([^>]*)>|\[([^\]]*)\])", body):
            lo, hi = _hex(m[1]), _hex(m[2])
            first, n = int.from_bytes(lo), int.from_bytes(hi) - int.from_bytes(lo) + 1
            if not 0 < n <= 65536:
                continue
            if m[4] is not None:
                texts = [u(_hex(h)) for h in _HEX.findall(m[4])][:n]
            else:
                base = _hex(m[3])
                last = int.from_bytes(base[-2:])
                texts = [u(base[:-2] + ((last + k) & 0xFFFF).to_bytes(2)) for k in range(n)]
            out.update(((first + k).to_bytes(len(lo)), t) for k, t in enumerate(texts))
    return out


def decode(raw: bytes, *maps: dict[bytes, str]) -> str:
    """A string operand: by the first map that covers it, as UTF-16 with a mark or by its look, else as WinAnsi."""
    for codes in filter(None, maps):
        width = max(len(k) for k in codes)
        if len(raw) % width == 0:
            parts = [codes.get(raw[i : i + width]) for i in range(0, len(raw), width)]
            if parts and all(p is not None for p in parts):
                return "".join(parts)
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace")
    if len(raw) >= 2 and len(raw) % 2 == 0 and raw[::2].count(0) * 2 > len(raw) // 2:
        return raw.decode("utf-16-be", "replace")
    return raw.decode("cp1252", "replace")


def _streams(data: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(object number, dictionary, content) of each stream."""
    for m in _STREAM.finditer(data):
        end = data.find(b"endstream", m.end())
        body = data[m.end() : end if end >= 0 else len(data)]
        before = data[max(0, m.start() - 400) : m.start()]
        numbers = list(_OBJECT.finditer(before))
        head = before[numbers[-1].end() :] if numbers else before[before.rfind(b"<<") :] if b"<<" in before else before
        if b"FlateDecode" in head or body[:1] == b"x":
            try:
                body = zlib.decompressobj().decompress(body, MOST_STREAM)
            except zlib.error:
                continue
        yield int(numbers[-1][1]) if numbers else -1, head, body


def _objects(data: bytes, streams: list[tuple[int, bytes, bytes]]) -> dict[int, bytes]:
    """The text of each object outside streams, those packed in object streams included."""
    out: dict[int, bytes] = {}
    for m in _OBJECT.finditer(data):
        ends = [e for e in (data.find(b"endobj", m.end()), data.find(b"stream", m.end())) if e >= 0]
        out[int(m[1])] = data[m.end() : min(ends, default=len(data))]
    for _, head, body in streams:
        first = re.search(rb"/First\s+(\d+)", head) if b"/ObjStm" in head else None
        if first:
            start = int(first[1])
            index = [int(x) for x in re.findall(rb"\d+", body[:start])]
            places = [*index[1::2], len(body) - start]
            out.update((n, body[start + a : start + z]) for n, a, z in zip(index[::2], places, places[1:], strict=False))
    return out


def font_maps(data: bytes, streams: list[tuple[int, bytes, bytes]]) -> dict[bytes, list[dict[bytes, str]]]:
    """The code maps of each font name. A name that means several fonts on several pages has several, in the order of the file."""
    by_number = {n: body for n, _, body in streams if b"begincmap" in body}
    if not by_number:
        return {}
    objects = _objects(data, streams)
    of_font = {n: int(m[1]) for n, text in objects.items() if (m := re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", text)) and int(m[1]) in by_number}
    parsed = {n: cmap(by_number[n]) for n in set(of_font.values())}
    out: dict[bytes, list[dict[bytes, str]]] = {}
    for text in objects.values():
        for name, ref in _REFERENCE.findall(text):
            codes = parsed.get(of_font.get(int(ref), -1))
            if codes and codes not in out.setdefault(name, []):
                out[name].append(codes)
    return {k: v for k, v in out.items() if v}


def lines_of(data: bytes) -> list[tuple[int, float, str]]:
    """(page, size, text) of each line that the text operators show; a stream with text counts as a page."""
    if data[:5] != b"%PDF-" or b"/Encrypt" in data[:ENCRYPT_WITHIN]:
        return []
    streams = list(_streams(data))
    fonts = font_maps(data, streams)
    # for text whose font has no map of its own
    loose: dict[bytes, str] = {}
    for _, _, s in streams if not fonts else ():
        if b"begincmap" in s:
            loose |= cmap(s)
    out: list[tuple[int, float, str]] = []
    page = total = 0
    for _, _, s in streams:
        if b"BT" not in s or b"begincmap" in s:
            continue
        page += 1
        stack: list = []
        size, line = 0.0, ""
        codes = [loose]

        def flush() -> None:
            nonlocal line
            if line.strip():
                out.append((page, size, " ".join(line.split())))
            line = ""

        array: list | None = None
        for m in _TOKEN.finditer(s):
            t = m[0]
            c = t[:1]
            if c == b"(" or c == b"<" and t not in (b"<<",):
                value = decode(_unescape(t[1:-1]) if c == b"(" else _hex(t[1:-1]), *codes)
                (stack if array is None else array).append(value)
            elif t == b"[":
                array = []
            elif t == b"]":
                stack.append(array or [])
                array = None
            elif re.fullmatch(rb"[-+]?\d*\.?\d+", t):
                (stack if array is None else array).append(float(t))
            elif c == b"/" or t in (b"<<", b">>"):
                stack.append(t)
            else:
                if t == b"Tf" and stack and isinstance(stack[-1], float):
                    if stack[-1] != size:
                        flush()
                    size = stack[-1]
                    if len(stack) > 1 and isinstance(stack[-2], bytes):
                        codes = fonts.get(stack[-2][1:], [loose])
                elif t in (b"Td", b"TD", b"T*", b"Tm", b"ET"):
                    if t != b"Td" or len(stack) < 2 or stack[-1] != 0.0:
                        flush()
                elif t == b"Tj" and stack:
                    line += stack[-1] if isinstance(stack[-1], str) else ""
                elif t in (b"'", b'"') and stack:
                    flush()
                    line += stack[-1] if isinstance(stack[-1], str) else ""
                elif t == b"TJ" and stack and isinstance(stack[-1], list):
                    line += "".join(x if isinstance(x, str) else " " if x < KERN_BLANK else "" for x in stack[-1])
                stack.clear()
        flush()
        total = sum(len(x[2]) for x in out)
        if total > MOST_TEXT:
            break
    return out


def info_value(data: bytes, key: str) -> str:
    """A string of the file's Info entry, as it stands uncompressed; '' if it is not there."""
    m = re.search(rb"/" + key.encode() + rb"\s*(\((?:\\.|[^\\()]|\([^()]*\))*\)|<[0-9A-Fa-f\s]*>)", data, re.S)
    if not m:
        return ""
    t = m[1]
    return decode(_unescape(t[1:-1]) if t[:1] == b"(" else _hex(t[1:-1])).strip()


def _cjk(c: str) -> bool:
    return "⺀" <= c <= "鿿" or "＀" <= c <= "￯" or "\U00020000" <= c <= "\U0002fa1f"


def joined_vertical(lines: list[tuple[int, float, str]]) -> list[tuple[int, float, str]]:
    """Lines with runs of Chinese lines of one or two characters joined, while the size stays within 0.2 of the run's first."""
    out: list[tuple[int, float, str]] = []
    head: float | None = None
    for p, size, t in lines:
        short = 0 < len(t) <= 2 and any(map(_cjk, t))
        if short and head is not None and abs(size - head) <= 0.2:
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + t)
        else:
            out.append((p, size, t))
            head = size if short else None
    return out


def _plausible(s: str, least: int, ratio: float) -> bool:
    low = s.strip().lower()
    n = len(low)
    kept = sum(c > "\x7f" or c.isalnum() for c in low)
    return least <= n <= 300 and not any(x in low for x in T.LINE_BARRED) and not low.startswith(T.LINE_JUNK) and not re.match(r"page \d", low) and kept >= n * ratio


#: A word as it counts for shapes: its first letter, if that is in lower case, and its length.
_WORD = re.compile(r"[^\s.,;:·](?:\S*[^\s.,;:·])?")


def nameness(line: str) -> float:
    """The share of words that may be part of a name: not begun in lower case (single letters aside) and not long. 0 for lines that are too short or long for names."""
    words = _WORD.findall(line)
    if len(line.split()) not in NAMES or not words:
        return 0.0
    return sum(len(w) <= NAME_LENGTH and (len(w) == 1 or not w[0].islower()) for w in words) / len(words)


def openness(line: str) -> float:
    """1 if the line's last word, marks aside, asks for more, else 0."""
    last = re.findall(r"\w+", line.lower())[-1:]
    return float(bool(last) and last[0] in FUNCTION_WORDS)


def title_by_size(lines: list[tuple[int, float, str]]) -> str:
    """The title of a file, from how large its lines are and what their words look like.

    Each of the largest sizes of a page gives a column of lines. Every joint of two lines is scored: nameness of the lower less
    openness of the upper line; the title reaches down to the first joint that scores 1, or until it has its words.
    """
    pages = [joined_vertical([(p, s, " ".join(t.split())) for p, s, t in lines if p == page and t.strip()]) for page in (1, 2)]
    for rows in pages:
        good = [(s, t) for _, s, t in rows if _plausible(t, 4, 0.5)]
        for top in heapq.nlargest(TIERS, {s for s, _ in good}):
            column = [t for s, t in good if s >= top - NEAR_SIZE]
            scores = [nameness(low) - openness(up) for up, low in pairwise(column)]
            sizes = accumulate(len(t.split()) for t in column)
            ends = [k + 1 for k, x in enumerate(scores) if x >= 1] + [k + 1 for k, n in enumerate(sizes) if n > TITLE_WORDS]
            title = " ".join(column[: min(ends, default=len(column))])
            if _plausible(title, 8, 0.45):
                return title
    return ""


def files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(path, content, size) of the PDF files under a path: by their first bytes, not only by their names."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return raw.where((F.col("length") > 0) & (F.substring("content", 1, 5) == F.lit(b"%PDF-"))).select("path", "content", F.col("length").alias("size"))


def extracted(pdfs: DataFrame) -> DataFrame:
    """(path, size, info_title, info_author, sized_title, lines, text) of (path, content, size)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content, size in zip(b["path"], b["content"], b["size"], strict=True):
                data = bytes(content)
                lines = lines_of(data)
                rows.append((path, size, info_value(data, "Title"), info_value(data, "Author"), title_by_size(lines), [{"page": p, "size": s, "text": t} for p, s, t in lines], "\n".join(t for *_, t in lines)[:MOST_TEXT]))
            yield pd.DataFrame(rows, columns=["path", "size", "info_title", "info_author", "sized_title", "lines", "text"])

    schema = "path string, size long, info_title string, info_author string, sized_title string, lines array<struct<page:int,size:double,text:string>>, text string"
    return pdfs.select("path", "content", "size").mapInPandas(run, schema)


def described(files: DataFrame) -> DataFrame:
    """(path, size, title, authors, doi, fulltext): the title from the file's own entry, else by size, else the first plausible line, else the file's name."""
    text = T.clean_text(T.normalize_text("text"))
    own, line = T.info_title("info_title"), T.sniff_file_title("text")
    some = lambda c: F.nullif(c, F.lit(""))
    return files.select(
        "path", "size", F.coalesce(some(own), some(F.col("sized_title")), some(line), T.clean_title("path")).alias("title"), F.col("info_author").alias("authors"),
        T.sniff_doi("text").alias("doi"), text.alias("fulltext"),
    )
