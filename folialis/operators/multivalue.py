"""Several values packed in one field: one row for each value, with its place.

Method. A field is cut into atoms at everything that may separate values; lists in brackets, quoted and braced spans are atoms that
are never cut or joined. The atoms with the separators between them form a lattice, whose segments are the possible values:
one atom, ``Family, Given``, or a term of up to MOST atoms that weak separators join (``research, development and innovation``). Expectation
maximisation over all fields learns how often each value and each shape of value occurs (expected counts, from the
posterior of each segment by a forward and a backward pass), and Viterbi then takes the likeliest path. Of names, a family name and given names or initials may be one value;
which of them are is a matter of shapes, and the column's counts only weigh the paths. Of terms, the column decides: one with separators inside is considered if it is met oftener than half as often as
its rarest part.

The counts are kept in a sketch (ROWS rows, the smaller cell counts) whose width follows the number of different values, from the least to
the greatest of WIDTHS, so the model that is sent to the executors is bounded at any size of the input. Only the sketch and the shapes are shuffled.

Edge cases. Null, empty and blank fields give no rows, nor do fields of separators only. "et al." and blank values take
no place. Equal values in one field stay, each with its place. Fields without a weak separator have one path. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import ast
import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folialis.sources.storage import spread

ROWS = 3
#: Least and greatest number of cells of a row; between them about sixteen cells for each different field, so that a value that was never met is seldom taken for one that was.
WIDTHS = (1 << 18, 1 << 21)
ROUNDS = 2
#: Atoms that a value has at most.
MOST = 4
#: Concentration: how many counts the shape of an unseen value is worth.
ALPHA = 200.0
#: Occurrences from which a value with a separator inside is known.
KNOWN = 3
#: How much likelier than its count says a known value is where it may stand, so that in a small table it does not lose to two frequent shapes.
KNOWN_PRIOR = 100.0

# What separates, labels and ends lists of values.
LABEL = re.compile(r"^\s*(?:key\s?words?|index terms|tags?|topics|subjects?|authors?|by|schlagw(?:ö|oe)rter|autoren|mots[- ]cl(?:é|e)s|auteurs|关键词|关键字|作者)\s*[:：]\s*", re.I)
ET_AL = re.compile(r"(?:^|[\s,;|&/·、，；]+)(?:(?:and|&)\s+)?(?:et\.?\s*al\b\.?|et coll\b\.?|(?-i:u\.\s?a\.)|and others\b\.?|等)\s*$", re.I)
TAIL = 20
NUMBERING = (
    re.compile(r"(?:^|(?<=[\s,;|/]))\(?[a-z]\)\s+"), re.compile(r"(?:^|(?<=[\s,;|/]))\(\d{1,3}\)\s+"), re.compile(r"(?:^|(?<=[\s,;|/]))\d{1,3}\)\s+"),
    re.compile(r"(?:^|(?<=[\s,;|/]))\[\d{1,3}\]\s*"), re.compile(r"(?:^|(?<=[\s,;|/]))\d{1,3}\.\s+"), re.compile(r"(?:^|(?<=\s))[•▪‣●◦∙*]\s*"), re.compile(r"(?:^|(?<=[\r\n]))\s*[-–—]\s+"),
)
SEPARATOR = re.compile(
    r"(?=[\s,，;；|、•<\x00])(?:"
    r"\s*(?:(?:<br\s*/?>|[;；|\t\r\n、•]|\s(?:[·—–]|-{2,3}|/{2,3})\s|\x00)\s*)+(?:(?:and|&)\s+)?"  # strong
    r"|\s*[,，]\s*(?:[,，]\s*)+|\s*[,，]\s*(?:and|&)\s+"
    r"|\s*[,，]\s*|\s+/\s+|\s+and\s+|\s+&\s+)",  # weak
    re.I,
)
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "{": "}", "”": "”", "「": "」", "『": "』"}
_ANY_QUOTE = re.compile("[" + "".join(QUOTES) + "]")
PARTICLES = frozenset("van von de la le der den del della di da du dos das zu zur ter ten el al bin ibn".split())
#: How likely a weak separator stands inside a value before anything is learned, by kind of field.
INSIDE = {"authors": {",": 0.5, "a": 0.0, "/": 0.0}, "keywords": {",": 0.1, "a": 0.3, "/": 0.1}}

_INITIALS = re.compile(r"^(?:[^\W\d_]\.[-\s]?)+$|^[A-ZÀ-ÖØ-Þ]{1,3}$")
_HAN = re.compile(r"[㐀-鿿]")


def _weak(sep: str) -> str | None:
    """',', 'a' (and, &) or '/' for a weak separator, None for a strong one."""
    core = sep.strip().lower()
    return {",": ",", "，": ",", "/": "/", "and": "a", "&": "a"}.get(core)


_WEAK = {x: _weak(x) for x in (",", ", ", " , ", " and ", " & ", " / ")}


def _listed(s: str) -> list[str] | None:
    """The values of a JSON or Python list."""
    if not (s.startswith("[") and s.endswith("]") and len(s) > 2 and s[1:].lstrip()[:1] in ('"', "'")):
        return None
    for parse in (json.loads, ast.literal_eval):
        try:
            v = parse(s)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            continue
        if isinstance(v, list):
            return [x for x in v if isinstance(x, str)]
    return None


def _quoted(s: str, i: int) -> tuple[str, int] | None:
    """(content, end) of a quoted span that starts at i and after which a separator or the end follows."""
    close = QUOTES[s[i]]
    out, j = [], i + 1
    while j < len(s):
        c = s[j]
        if c == "\\" and j + 1 < len(s) and s[j + 1] in '"\\':
            out.append(s[j + 1])
            j += 2
        elif c == close:
            if close == '"' and s[j + 1 : j + 2] == '"':
                out.append('"')
                j += 2
                continue
            rest = s[j + 1 :]
            if not rest.strip() or SEPARATOR.match(rest) or (rest[0].isspace() and rest.lstrip()[0] in QUOTES) or ET_AL.match(rest):
                return "".join(out), j + 1
            out.append(c)
            j += 1
        else:
            out.append(c)
            j += 1
    return None


def lex(s: str) -> tuple[list[str], list[str], list[bool]]:
    """Atoms of a field, the separators between them as written, and which atoms are closed (quoted or listed)."""
    if ":" in s or "：" in s:
        s = LABEL.sub("", s)
    s = s.strip().strip("﻿​").strip()
    values = _listed(s)
    if values is not None:
        return values, ["\n"] * max(0, len(values) - 1), [True] * len(values)
    if not s[:1].isalpha():
        for n in NUMBERING:
            if n.match(s):
                s = n.sub("\0", s).strip()
                break
    # the end of a list is looked for in its last characters only, where it stands
    s = s[:-TAIL] + ET_AL.sub("", s[-TAIL:])
    atoms: list[str] = []
    seps: list[str] = []
    closed: list[bool] = []
    i = start = 0
    pending = ""

    def put(text: str, quoted: bool) -> None:
        nonlocal pending
        if text.strip():
            if atoms:
                seps.append(pending or "\n")
            atoms.append(text.strip())
            closed.append(quoted)
            pending = ""

    if not _ANY_QUOTE.search(s):
        for m in SEPARATOR.finditer(s):
            put(s[start : m.start()], False)
            pending = m.group() if not pending else "\n"
            start = m.end()
        i = len(s)
    while i < len(s):
        if s[i] in QUOTES and not s[start:i].strip() and (q := _quoted(s, i)):
            put(q[0], True)
            i = start = q[1]
            continue
        m = SEPARATOR.match(s, i) if not s[i].isalnum() else None
        if m and m.end() > i:
            put(s[start:i], False)
            # blank values take no place: what stands between two values is one separator, strong if it is more than one
            pending = m.group() if not pending else "\n"
            i = start = m.end()
        else:
            i += 1
    put(s[start:], False)
    return atoms, seps, closed


@lru_cache(200_000)
def _atom_shape(atom: str) -> str:
    out = []
    for t in atom.split()[:8]:
        if _HAN.search(t):
            out.append("H")
        elif t.lower() in PARTICLES and t[0].islower():
            out.append("P")
        elif _INITIALS.match(t):
            out.append("I")
        else:
            out.append("W")
    return "".join(out)


_FAMILY = re.compile(r"^P*W$")
_ACRONYM = re.compile(r"^[A-Z]{3,6}$")
_GIVEN = re.compile(r"^(?:I+|WI*)P*$")


@lru_cache(200_000)
def _shape(kind: str, atom: str) -> str:
    return _atom_shape(atom) if kind == "authors" else str(min(9, len(atom.split())))


@lru_cache(400_000)
def _cells(kind: str, value: str, width: int) -> tuple[int, ...]:
    key = f"{kind}\0{' '.join(value.casefold().split())}".encode()
    return tuple(r * width + zlib.crc32(key, 0x9E37 * r) % width for r in range(ROWS))


class Model:
    """Expected counts of values (a sketch) and of shapes."""

    def __init__(self, sketch: np.ndarray | None = None, shapes: dict[str, float] | None = None, width: int = WIDTHS[0]):
        self.width, self.sketch, self.shapes = width, sketch, shapes or {}
        self.total = {k: max(1.0, sum(v for s, v in self.shapes.items() if s.startswith(k))) for k in INSIDE}
        self.seen = lru_cache(400_000)(self._seen)
        # what chance puts into a cell
        self.noise = 0.0 if sketch is None else float(sketch.sum()) / ROWS / width

    def _seen(self, kind: str, value: str) -> float:
        return float(max(0.0, min(self.sketch[c] for c in _cells(kind, value, self.width)) - self.noise))

    def weigh(self, kind: str, value: str, shape: str, prior: float, own: float) -> float:
        """The probability of a value, without what its own field adds to its count."""
        if self.sketch is None:
            return prior * (0.01 if len(shape) == 1 and kind == "authors" else 0.05)
        n = self.total[kind]
        base = self.shapes.get(f"{kind} {shape}", 0.0) / n
        return prior * (max(0.0, self.seen(kind, value) - own) + ALPHA * base + 1e-9) / (n + ALPHA)

    def known(self, kind: str, value: str, parts: list[str]) -> bool:
        """Whether a value with a separator inside is met often enough elsewhere, and oftener than its rarest part is."""
        if self.sketch is None:
            return False
        n = self.seen(kind, value)
        return n >= KNOWN and n > 2 * min(self.seen(kind, x) for x in parts)


#: (from, to, value, shape, prior) of a possible value.
Segment = tuple[int, int, str, str, float]


def joined(kind: str, atoms: list[str], seps: list[str], closed: list[bool], model: Model) -> list[Segment]:
    """The possible values of more than one atom: a family name and what may be given names or their initials; or a term of up to MOST atoms that is known as a whole."""
    inside, out = INSIDE[kind], []
    for i in range(len(seps)):
        value, shape, prior = atoms[i], _shape(kind, atoms[i]), 1.0
        for j in range(i, min(len(seps), i + (1 if kind == "authors" else MOST - 1))):
            if (w := _WEAK.get(seps[j])) is None and (w := _weak(seps[j])) is None or closed[j] or closed[j + 1] or not inside[w]:
                break
            left, right = value, atoms[j + 1]
            value, b = value + seps[j] + right, _shape(kind, right)
            prior *= inside[w]
            if kind == "authors":
                # dotted initials are no name by themselves, whatever stands before them
                good = _FAMILY.match(shape) and not _ACRONYM.match(left) and _GIVEN.match(b) or "." in right and b.strip("I") == "" and "I" not in shape and "H" not in shape
                weight = prior if good else 0.0
            else:
                weight = KNOWN_PRIOR if model.known(kind, value, atoms[i : j + 2]) else prior if model.sketch is None and "a" in (w, *(c for c in shape if c == "a")) else 0.0
            shape += w + b
            if weight:
                out.append((i, j + 2, value, shape, weight))
    return out


def _lattice(kind: str, atoms: list[str], more: list[Segment]) -> list[Segment]:
    return sorted([*((i, i + 1, a, _shape(kind, a), 1.0) for i, a in enumerate(atoms)), *more], key=lambda x: x[:2])


def viterbi(kind: str, atoms: list[str], seps: list[str], closed: list[bool], model: Model) -> list[str]:
    more = joined(kind, atoms, seps, closed, model)
    if not more:
        return atoms
    segs = _lattice(kind, atoms, more)
    best, back = [-math.inf] * (len(atoms) + 1), [-1] * (len(atoms) + 1)
    best[0] = 0.0
    for k, (i, j, v, s, prior) in enumerate(segs):
        score = best[i] + math.log(model.weigh(kind, v, s, prior, float(j - i > 1)))
        if score > best[j]:
            best[j], back[j] = score, k
    out, at = [], len(atoms)
    while at:
        at, _, v, *_ = segs[back[at]]
        out.append(v)
    return out[::-1]


def expected(kind: str, atoms: list[str], seps: list[str], closed: list[bool], model: Model, add) -> None:
    """add(value, shape, posterior) for every possible value, by a forward and a backward pass."""
    more = joined(kind, atoms, seps, closed, model)
    if not more:
        for a in atoms:
            add(a, _shape(kind, a), 1.0)
        return
    segs, n = _lattice(kind, atoms, more), len(atoms)
    p = [model.weigh(kind, v, s, prior, float(j - i > 1)) for i, j, v, s, prior in segs]
    into: list[list[int]] = [[] for _ in range(n + 1)]
    for k, seg in enumerate(segs):
        into[seg[1]].append(k)
    f = [0.0] + [-math.inf] * n
    b = [-math.inf] * n + [0.0]
    logs = [math.log(x) for x in p]
    for j in range(1, n + 1):
        terms = [f[segs[k][0]] + logs[k] for k in into[j]]
        top = max(terms)
        f[j] = top + math.log(sum(math.exp(t - top) for t in terms))
    for j in range(n, 0, -1):
        for k in into[j]:
            i, t = segs[k][0], b[j] + logs[k]
            hi, lo = (b[i], t) if b[i] > t else (t, b[i])
            b[i] = hi + (math.log1p(math.exp(lo - hi)) if lo > -math.inf else 0.0)
    for k, (i, j, v, s, _) in enumerate(segs):
        if (q := math.exp(f[i] + logs[k] + b[j] - f[n])) > 1e-4:
            add(v, s, q)


def _fields(batch: pa.RecordBatch, kinds: list[str]) -> Iterator[tuple[int, str, tuple]]:
    for c, kind in enumerate(kinds, 1):
        for row, s in enumerate(batch.column(c).to_pylist()):
            if s and s.strip():
                yield row, kind, lex(s)


def learn(fields: DataFrame, kinds: list[str], rounds: int = ROUNDS) -> Model:
    """The model after some rounds of expectation maximisation over all rows of (id, *kinds)."""
    # different fields, of which each holds a few values
    distinct = fields.agg(*(F.approx_count_distinct(k).alias(k) for k in kinds)).head()
    width = 1 << max(WIDTHS[0], min(WIDTHS[1], 16 * sum(distinct))).bit_length() - 1
    model = Model(width=width)
    for _ in range(rounds):
        shared = fields.sparkSession.sparkContext.broadcast((model.sketch, model.shapes, width))

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = Model(*shared.value)
            sums, shapes, values = np.zeros(ROWS * width), Counter(), Counter()

            def spend() -> None:
                for (kind, v), q in values.items():
                    for c in _cells(kind, v, width):
                        sums[c] += q
                values.clear()

            for b in batches:
                for _, kind, (atoms, seps, closed) in _fields(b, kinds):

                    def add(v: str, s: str, q: float, kind=kind) -> None:
                        values[kind, v] += q
                        shapes[kind, s] += q

                    expected(kind, atoms, seps, closed, m, add)
                if len(values) > 300_000:
                    spend()
            spend()
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*at.tolist(), *[-1] * len(shapes)], pa.int64()), pa.array([None] * len(at) + [" ".join(x) for x in shapes], pa.string()), pa.array([*sums[at].tolist(), *shapes.values()], pa.float64())],
                names=["cell", "shape", "n"],
            )

        # at most ROWS * width cells and the shapes, whatever the input
        got = fields.mapInArrow(count, "cell long, shape string, n double").groupBy("cell", "shape").agg(F.sum("n").alias("n")).toArrow()
        cell, shape, n = got.column("cell").to_numpy(), got.column("shape").to_pylist(), got.column("n").to_numpy()
        sketch = np.zeros(ROWS * width, np.float32)
        sketch[cell[cell >= 0]] = n[cell >= 0]
        model = Model(sketch, {s: float(x) for s, x in zip(shape, n, strict=True) if s is not None}, width)
    return model


def split_values(df: DataFrame, id: str, columns: list[str]) -> DataFrame:
    """(id, field_name, pos, item) for each value of the columns, which are named as kinds of INSIDE."""
    fields = spread(df.select(F.col(id).cast("long").alias("id"), *columns))
    model = learn(fields, columns)
    shared = fields.sparkSession.sparkContext.broadcast((model.sketch, model.shapes, model.width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for b in batches:
            ids = b.column(0).to_pylist()
            out: tuple[list, list, list, list] = ([], [], [], [])
            for row, kind, (atoms, seps, closed) in _fields(b, columns):
                for pos, item in enumerate(viterbi(kind, atoms, seps, closed, m), 1):
                    for col, x in zip(out, (ids[row], kind, pos, item), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.string())], names=["id", "field_name", "pos", "item"])

    return fields.mapInArrow(run, "id long, field_name string, pos int, item string")
