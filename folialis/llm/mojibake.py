"""Texts decoded with the wrong encoding: finding them, and restoring them where nothing was lost.

Method. A character model (smoothed trigrams over bigrams over single characters, in lower case) is trained on all clean records: those in
which no chain of encodings applies anywhere. In every other record each span to which a chain (bytes of encoding Y read as X) applies is
scored as it stands and as the chain restores it, with its neighbours; the likeliest reading wins if it is better than
the stored one by a margin. The margin is set on all clean records, as they are, in capitals and garbled by us, as the smallest that keeps the false alarms
on untouched ones under a stated rate in every chain. Chains are applied again to their own result, so text garbled twice is
restored in two steps. A replacement character, which only a decoder that failed leaves, and a C1 control character left over are losses of their own, whatever the model says.

Scale. The model's counts are kept in tables of a fixed number of hashed cells, whatever the input: only these are shuffled and broadcast (a few MB). Training, the choice of the margin (a histogram of fixed size for each chain) and scoring are
one pass each over the texts, and a record without a suspicious character costs one search.

Edge cases. Null and empty texts are no case. Characters that are rare but right stay, as the model has met them in clean records or the chain's reading is no likelier.
Very long texts are searched whole. Repeated rows are scored alike.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folialis.sources.storage import spread

CELLS = 1 << 20
#: Share of spans of clean records that may be taken for garbled when the margin is chosen, and the least margin (in nats).
FALSE_ALARMS, LEAST_MARGIN = 0.0005, 1.0
#: Bins of the histogram of gains of a chain, and their width (in nats): from -64 to 64, gains beyond in the outer ones.
BINS, WIDE = 512, 0.25
CONTEXT = 2

#: Encodings of one byte as which UTF-8 is misread.
SINGLE = ("cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp1254", "iso8859-15")
CHAINS = (*(f"utf-8 as {e}" for e in SINGLE), "gbk as latin-1", "utf-8 as gbk")


@lru_cache(None)
def byte_table(encoding: str) -> tuple[str, ...]:
    """The character of each byte; a byte without one is the control character of its number, as browsers have it."""
    return tuple(bytes([b]).decode(encoding, "replace").replace("�", chr(b)) for b in range(256))


@lru_cache(None)
def byte_of(encoding: str) -> dict[str, int]:
    return {c: b for b, c in reversed(list(enumerate(byte_table(encoding))))}


def _any(encoding: str, lo: int, hi: int) -> str:
    return "[" + "".join(re.escape(c) for c in byte_table(encoding)[lo : hi + 1]) + "]"


@lru_cache(None)
def utf8_seen_as(encoding: str) -> re.Pattern:
    """Runs of UTF-8 sequences of several bytes as they look in an encoding of one byte. A last byte may have become '?'."""
    tail = _any(encoding, 0x80, 0xBF)
    lost = tail[:-1] + r"?�]"
    one = f"{_any(encoding, 0xC2, 0xDF)}{tail}|{_any(encoding, 0xE0, 0xEF)}{tail}{lost}|{_any(encoding, 0xF0, 0xF4)}{tail}{tail}{lost}"
    return re.compile(f"(?:{one})+")


@lru_cache(None)
def gbk_seen_as(encoding: str) -> re.Pattern:
    return re.compile(f"(?:{_any(encoding, 0xA1, 0xF7)}{_any(encoding, 0xA1, 0xFE)})+")


#: Bytes of Chinese script: UTF-8 sequences within text that was read as GBK.
_UTF8_BYTES = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2})+")
_WIDE = re.compile(r"[^\x00-\x7f�]+[\x00-\x7f]?")
#: What UTF-8 may restore to here: accented Latin, Greek and Cyrillic letters, punctuation, signs, Chinese. A reading with
#: anything else (as Armenian from an apostrophe before an accent) is chance.
_PLAUSIBLE = re.compile(r"[\x00-\u017f\u0192\u02c6\u02dc\u0386-\u03ce\u03d5\u03f5\u0400-\u045f\u0490\u0491\u1e00-\u1eff\u2000-\u2bff\u3000-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\ufb00-\ufb06\ufe30-\ufe4f\uff00-\uffee\ufffd\U00020000-\U000323af]*")
#: A character that may begin a misread sequence and one that may follow it, in any of the encodings.
_LEADS = "".join(sorted({c for e in SINGLE for c in byte_table(e)[0xC2:0xF5]}))
_TAILS = "".join(sorted({c for e in SINGLE for c in byte_table(e)[0x80:0xC0]}))
_PAIR = re.compile(f"[{re.escape(_LEADS)}][{re.escape(_TAILS)}]")
_HIGH = re.compile("[¡-÷][¡-þ]")
_SUSPECT = re.compile(f"{_PAIR.pattern}|{_HIGH.pattern}|[\x80-\x9f]|�|&[A-Za-z]{{2,8}};|[㐀-鿿]")
_LOSS = re.compile("[\x80-\x9f�]")
_ENTITY = re.compile(r"&[A-Za-z]{2,8};")
_RUN = re.compile(r"(?:[^\x00-\x7f]\??)+[\x00-\x7f]?")
_BEYOND = re.compile(r"[^\x00-\x7f]+")


def _from_utf8(span: str, encoding: str) -> str | None:
    table = byte_of(encoding)
    raw = bytes(table[c] if c in table else 0x3F for c in span)
    return raw.decode("utf-8", "replace")


def readings(s: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, restored, chain) of every span to which a chain applies."""
    # no span goes beyond a run of characters outside ASCII, with '?' as a lost byte and the ASCII character behind the run
    for m in _RUN.finditer(s):
        run, at = m.group(), m.start()
        if run[0] >= "㐀" or len(run) > 1 and not run[1].isascii() or "?" in run:
            for a, z, r, c in _readings(run):
                yield at + a, at + z, r, c


def _readings(s: str) -> Iterator[tuple[int, int, str, str]]:
    if _PAIR.search(s):
        met = set()
        for e in SINGLE:
            for m in utf8_seen_as(e).finditer(s):
                r = _from_utf8(m.group(), e)
                if (m.span(), r) not in met and _PLAUSIBLE.fullmatch(r):
                    met.add((m.span(), r))
                    yield m.start(), m.end(), r, f"utf-8 as {e}"
    for m in gbk_seen_as("latin-1").finditer(s) if _HIGH.search(s) else ():
        try:
            yield m.start(), m.end(), m.group().encode("latin-1").decode("gbk"), "gbk as latin-1"
        except UnicodeError:
            continue
    for m in _WIDE.finditer(s):
        run = m.group()
        try:
            raw = run.encode("gbk")
        except UnicodeError:
            continue
        # where each character begins, as a place among the bytes
        at = {0: 0}
        n = 0
        for i, c in enumerate(run, 1):
            n += 1 if c < "\x80" else 2
            at[n] = i
        for u in _UTF8_BYTES.finditer(raw):
            x, z = u.span()
            # the last byte may have taken the ASCII character behind it into its pair
            tail = b"" if z in at else raw[z : z + 1]
            if x not in at or tail >= b"\x80" or z + len(tail) not in at:
                continue
            body = raw[x:z].decode("utf-8", "ignore")
            # sequences of two bytes within a longer run of Chinese are chance
            if (sum(b >= 0xE0 for b in raw[x:z]) >= 2 or x == 0 and z + len(tail) >= n - (run[-1] < "\x80")) and _PLAUSIBLE.fullmatch(body):
                yield m.start() + at[x], m.start() + at[z + len(tail)], body + tail.decode(), "utf-8 as gbk"


_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _codes(cp: np.ndarray, place: np.ndarray | None = None) -> list[np.ndarray]:
    """The cells of the single characters, pairs and triples that end at each place; place: that within its text, where cp holds several."""
    c = cp.astype(np.uint64) + np.uint64(3)
    p1 = np.concatenate((np.full(1, 1, np.uint64), c[:-1]))
    p2 = np.concatenate((np.full(2, 1, np.uint64), c[:-2])) if len(c) > 1 else np.full(len(c), 1, np.uint64)
    if place is not None:
        p1, p2 = np.where(place > 0, p1, np.uint64(1)), np.where(place > 1, p2, np.uint64(1))
    out, h = [], np.zeros(len(c), np.uint64)
    for part, k in zip((c, p1, p2), _MIX, strict=True):
        h = (h ^ (part * k)) * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(33))
        out.append((h % np.uint64(CELLS)).astype(np.int64))
    return out


def _short_codes(s: str) -> tuple[list[int], list[int], list[int]]:
    """_codes of a short text, without arrays."""
    full, ks = (1 << 64) - 1, [int(k) for k in _MIX]
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    p1 = p2 = 1
    for ch in s.lower():
        c, h = ord(ch) + 3, 0
        for cells, part, k in zip(out, (c, p1, p2), ks, strict=True):
            h = ((h ^ (part * k & full)) * 0xFF51AFD7ED558CCD) & full
            h ^= h >> 33
            cells.append(h % CELLS)
        p1, p2 = c, p1
    return out


def _points(s: str) -> np.ndarray:
    return np.frombuffer(s.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


class Model:
    """Smoothed log-probabilities from the hashed counts of characters, pairs and triples."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.reshape(3, CELLS)
        self.rows = [memoryview(np.ascontiguousarray(r)) for r in self.counts]
        self.total = max(1.0, float(self.counts[0].sum()))
        self.score = lru_cache(100_000)(self._score)

    def _score(self, s: str, skip: int) -> float:
        """The log-probability of s after its first ``skip`` characters."""
        one, two, three = _short_codes(s) if len(s) < 40 else (c.tolist() for c in _codes(_points(s)))
        n1, n2, n3 = self.rows
        total = 0.0
        for i in range(skip, len(one)):
            p = (n1[one[i]] + 0.01) / (self.total + 20_000)
            before = n1[one[i - 1]] if i else 0.0
            p = (n2[two[i]] + 2.0 * p) / (max(before, n2[two[i]]) + 2.0)
            pair = n2[two[i - 1]] if i > 1 else 0.0
            p = (n3[three[i]] + 2.0 * p) / (max(pair, n3[three[i]]) + 2.0)
            total += math.log(p)
        return total

    def scores(self, texts: list[str], skips: np.ndarray) -> np.ndarray:
        """score of many texts at once."""
        low = [s.lower() for s in texts]
        size = np.array([len(s) for s in low], np.int64)
        cp, first = _points("".join(low)), np.concatenate(([0], size.cumsum()[:-1])).astype(np.int64)
        place = np.arange(len(cp)) - np.repeat(first, size)
        one, two, three = _codes(cp, place)
        n1, n2, n3 = (r[c].astype(np.float64) for r, c in zip(self.counts, (one, two, three), strict=True))
        p = (n1 + 0.01) / (self.total + 20_000)
        p = (n2 + 2.0 * p) / (np.maximum(np.where(place > 0, np.roll(n1, 1), 0.0), n2) + 2.0)
        p = (n3 + 2.0 * p) / (np.maximum(np.where(place > 1, np.roll(n2, 1), 0.0), n3) + 2.0)
        logs = np.where(place >= np.repeat(skips, size), np.log(p), 0.0)
        return np.bincount(np.repeat(np.arange(len(low)), size), logs, len(low))

    def gain(self, s: str, start: int, end: int, restored: str) -> float:
        """By how much a reading of a span is likelier than what is stored, with its neighbours."""
        a, z = s[max(0, start - CONTEXT) : start], s[end : end + CONTEXT]
        return self.score(a + restored + z, len(a)) - self.score(a + s[start:end] + z, len(a))

    def _deeper(self, s: str, a: int, z: int, r: str) -> tuple[float, str]:
        """The gain of a reading, or of that reading read once more by a chain that covers it, if this is likelier."""
        found = (self.gain(s, a, z, r), r)
        if r.isascii() or not _SUSPECT.search(r):
            return found
        return max([found, *((self.gain(s, a, z, x), x) for i, j, y, _ in readings(r) if y and (x := r[:i] + y + r[j:]))])

    def best(self, s: str, margin: float) -> list[tuple[int, int, str, str]]:
        """The spans whose readings are likelier by the margin; of those that overlap, the likeliest."""
        found = sorted(((*self._deeper(s, a, z, r), a, z, c) for a, z, r, c in readings(s) if r), key=lambda x: (-x[0], x[2], -x[3]))
        out: list[tuple[int, int, str, str]] = []
        for g, r, a, z, c in found:
            if g < margin:
                break
            if all(z <= x or a >= y for x, y, *_ in out):
                out.append((a, z, r, c))
        return sorted(out)

    def restore(self, s: str, margin: float) -> tuple[str, bool, bool]:
        """(restored text, whether a part was garbled, whether nothing was lost)."""
        hit, text = False, s
        if _ENTITY.search(text):
            plain = html.unescape(text)
            if plain != text and self.best(plain, margin):
                text, hit = plain, True
        for _ in range(3):
            spans = self.best(text, margin)
            if not spans:
                break
            hit, at, parts = True, 0, []
            for a, z, r, _c in spans:
                parts += [text[at:a], r]
                at = z
            text = "".join(parts) + text[at:]
        lost = bool(_LOSS.search(text))
        return text, hit or lost, not lost


def suspect(s: str) -> bool:
    """Whether anything in a text may be garbled; plain ASCII is seen at once."""
    return not (s.isascii() and "&" not in s) and _SUSPECT.search(s) is not None


def suspicious(s: str) -> bool:
    """Whether a record is not clean for training: a chain applies somewhere, or something was lost.

    Two accented letters side by side are a Chinese character to a chain, as is one Chinese character among Latin
    letters; the first is common in clean records.
    """
    if _LOSS.search(s):
        return True
    if _ENTITY.search(s):
        s = html.unescape(s)
    return any(c != "gbk as latin-1" or z - a > 3 or not s[a:z].isalpha() for a, z, _, c in readings(s))


def train(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, float]:
    """(counts, margin) from all clean records of the columns."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(3 * CELLS, np.int64)

        def add(texts: list[str]) -> None:
            cp = _points("\n\n".join(texts))
            for k, cells in enumerate(_codes(cp)):
                sums[k * CELLS : (k + 1) * CELLS] += np.bincount(cells, minlength=CELLS)

        for b in batches:
            for c in range(len(columns)):
                clean, size = [], 0
                for s in b.column(c).to_pylist():
                    if s and not (suspect(s) and suspicious(s)):
                        clean.append(s)
                        size += len(s)
                        if size > 500_000:
                            add(clean)
                            clean, size = [], 0
                if clean:
                    add(clean)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["cell", "n"])

    # at most 3 * CELLS rows, whatever the input
    got = df.select(*columns).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(3 * CELLS, np.float32)
    counts[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return counts, validated_margin(df, columns, Model(counts))


def garble(s: str, chain: str) -> str | None:
    """s as a chain stores it; None where the chain cannot hold it."""
    written, read = chain.split(" as ")
    try:
        raw = s.encode(written)
        return raw.decode(read) if read == "gbk" else raw.decode("latin-1").translate(byte_table(read))
    except UnicodeError:
        return None


#: (case, number of the chain, neighbours before, stored, restored, neighbours after)
Span = tuple[int, int, str, str, str, str]


def labelled(s: str) -> Iterator[Span]:
    """The labelled spans of a clean record.

    Untouched (0): where a chain applies by chance to the record or to the record in capitals. The UTF-8 chains apply to no clean record as it stands, but accented capitals
    before quotes and signs look like them, and the model knows no case. Cases (1): every run beyond ASCII as one chain garbles it, the chain chosen by the text itself.
    """
    for x in {s, s.upper()}:
        if _PAIR.search(x) or _HIGH.search(x):
            yield from ((0, CHAINS.index(c), x[max(0, a - CONTEXT) : a], x[a:z], r, x[z : z + CONTEXT]) for a, z, r, c in readings(x))
    k = zlib.crc32(s.encode("utf-8", "surrogatepass")) % len(CHAINS)
    for m in _BEYOND.finditer(s):
        run, (a, z) = m.group(), m.span()
        if _PLAUSIBLE.fullmatch(run) and (wrong := garble(run, CHAINS[k])):
            yield 1, k, s[max(0, a - CONTEXT) : a], wrong, run, s[z : z + CONTEXT]


def gains(spans: list[Span], model: Model) -> np.ndarray:
    """Model.gain of many spans."""
    skips = np.array([len(x[2]) for x in spans], np.int64)
    stored, restored = (model.scores([x[2] + x[k] + x[5] for x in spans], skips) for k in (3, 4))
    return restored - stored


def validated_margin(df: DataFrame, columns: list[str], model: Model) -> float:
    """The margin from the gains of the labelled spans of all clean records, counted by chain in bins."""
    shared = df.sparkSession.sparkContext.broadcast(model.counts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = Model(shared.value), np.zeros(2 * len(CHAINS) * BINS, np.int64)

        def add(spans: list[Span]) -> None:
            at = np.array([(case * len(CHAINS) + k) * BINS for case, k, *_ in spans], np.int64)
            np.add.at(sums, at + bins(gains(spans, own)), 1)

        for b in batches:
            for c in range(len(columns)):
                spans, size = [], 0
                for s in b.column(c).to_pylist():
                    if s and not s.isascii() and not (suspect(s) and suspicious(s)):
                        spans += labelled(s)
                        size += len(s)
                        if spans and size > 100_000:
                            add(spans)
                            spans, size = [], 0
                if spans:
                    add(spans)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["bin", "n"])

    # at most 2 * chains * BINS rows, whatever the input
    got = df.select(*columns).mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(2 * len(CHAINS) * BINS, np.int64)
    table[got.column("bin").to_numpy()] = got.column("n").to_numpy()
    return margin_of(table.reshape(2, len(CHAINS), BINS))


def bins(gain: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(gain / WIDE).astype(np.int64) + BINS // 2, 0, BINS - 1)


def margin_of(table: np.ndarray) -> float:
    """The smallest margin that keeps the share of false alarms of every chain under the stated rate, from the counts of gains by (case, chain, bin).

    The margin stays under the gains of 99.9 % of the cases.
    """
    edges = (np.arange(BINS + 1) - BINS // 2) * WIDE
    alarm = -math.inf
    for n in table[0]:
        # spans at or above the lower edge of each bin
        above = np.append(n[::-1].cumsum()[::-1], 0)
        alarm = max(alarm, edges[int(np.argmax(above <= FALSE_ALARMS * n.sum()))])
    cases = table[1].sum(0)
    least = edges[int(np.argmax(cases.cumsum() > cases.sum() // 1000))] if cases.any() else math.inf
    return max(LEAST_MARGIN, float(min(alarm, least)))


def find(df: DataFrame, id: str, columns: list[str]) -> DataFrame:
    """(id, field_name, restored, whole) of every field of which a part was decoded with the wrong encoding; whole: nothing was lost."""
    df = spread(df.select(F.col(id).cast("long").alias("id"), *columns))
    shared = df.sparkSession.sparkContext.broadcast(train(df, columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, margin = shared.value
        model = Model(counts)
        for b in batches:
            out: list[list] = [[], [], [], []]
            ids = b.column(0).to_pylist()
            for c, name in enumerate(columns, 1):
                for i, s in zip(ids, b.column(c).to_pylist(), strict=True):
                    if s and suspect(s):
                        text, hit, whole = model.restore(s, margin)
                        if hit:
                            for col, x in zip(out, (i, name, text, whole), strict=True):
                                col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.string(), pa.string(), pa.bool_()), strict=True)], names=["id", "field_name", "restored", "whole"])

    return df.mapInArrow(run, "id long, field_name string, restored string, whole boolean")
