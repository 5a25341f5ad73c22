"""Byte-level BPE of a public tokenizer over a whole corpus, by merge replay.

Method. The words of a batch of documents are taken once each. An inverted index from token pair to the positions where it stands
is built over all these words at once, and the merges are applied to the whole batch in rank order: a merge touches only
the positions in its list, and puts the pairs with the new neighbours into theirs. Documents are then spelled out of
their words' ids.

Scale. A document's ids depend on nothing but itself and the vocabulary, so the corpus replayed together is the slice that
a task holds, and nothing is shuffled: one pass from scan to result, in proportion to the text. The vocabulary is sent
to the executors as arrays of a size fixed by the tokenizer file (under 1 MB). A worker keeps the ids of words that it has met; the store is emptied when it
holds KEPT words, which changes the time and not the result.

Edge cases. Null and empty texts give an empty list. Blanks, line ends and special tokens' strings are ordinary text. Rows that
are repeated stay repeated. A lone surrogate cannot occur in a Spark string.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folialis.sources.storage import spread

#: Fixed value: how a byte-level BPE of this family cuts text into words before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEPT = 300_000
CHUNK = 300_000


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """A file of the public tokenizers: in FOLIALIS_TOKENIZERS, or where the package with them lies."""
    if folder := os.environ.get("FOLIALIS_TOKENIZERS"):
        return f"{folder}/{name}"
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"/opt/tokenizers/{name}"


def _alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in vocabulary files: a printable byte is itself, the others follow from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """The byte ids and ranked merges of a vocabulary file, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids, letters = model["vocab"], _alphabet()
        self.byte_ids = np.zeros(256, np.int32)
        for c, b in letters.items():
            self.byte_ids[b] = ids[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = np.array([(ids[a], ids[b], ids[a + b]) for a, b in pairs], np.int32)


class Replay:
    """Encodes words by replaying the merges over all of them together."""

    def __init__(self, byte_ids: np.ndarray, merges: np.ndarray):
        import regex

        self.words_of = regex.compile(PATTERN).findall
        self.byte_ids = byte_ids.tolist()
        self.left, self.right, self.made = (merges[:, j].tolist() for j in range(3))
        self.rank = {a << 20 | b: r for r, (a, b) in reversed(list(enumerate(zip(self.left, self.right, strict=True))))}
        self.known: dict[str, list[int]] = {}

    def replay(self, words: list[str]) -> list[list[int]]:
        byte_ids, rank = self.byte_ids, self.rank
        sym: list[int] = [-1]
        starts = []
        for w in words:
            starts.append(len(sym))
            sym.extend([byte_ids[b] for b in w.encode()])
            sym.append(-1)
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        where: dict[int, list[int]] = {}
        prev = -1
        for p in range(1, n):
            s = sym[p]
            if prev >= 0 and s >= 0 and (r := rank.get(prev << 20 | s)) is not None:
                where.setdefault(r, []).append(p - 1)
            prev = s
        queue = list(where)
        heapq.heapify(queue)
        while queue:
            r = heapq.heappop(queue)
            a, b, new = self.left[r], self.right[r], self.made[r]
            places = where.pop(r)
            if a == b:
                places.sort()
            for p in places:
                if sym[p] != a:
                    continue
                q = after[p]
                if sym[q] != b:
                    continue
                sym[p], sym[q] = new, -2
                q = after[q]
                after[p] = q
                before[q] = p
                s = sym[q]
                if s >= 0 and (x := rank.get(new << 20 | s)) is not None:
                    if x in where:
                        where[x].append(p)
                    else:
                        where[x] = [p]
                        heapq.heappush(queue, x)
                o = before[p]
                s = sym[o]
                if s >= 0 and (x := rank.get(s << 20 | new)) is not None:
                    if x in where:
                        where[x].append(o)
                    else:
                        where[x] = [o]
                        heapq.heappush(queue, x)
        out = []
        for s, w in zip(starts, words, strict=True):
            ids, p = [], s
            while sym[p] >= 0:
                ids.append(sym[p])
                p = after[p]
            out.append(ids)
        return out

    def encode(self, texts: list[str | None]) -> Iterator[list[int]]:
        """The ids of each text."""
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= CHUNK):
                size += len(texts[hi] or "")
                hi += 1
            split = [self.words_of(t) if t else [] for t in texts[lo:hi]]
            if len(self.known) > KEPT:
                self.known.clear()
            new = list({w for words in split for w in words} - self.known.keys())
            fresh = dict(zip(new, self.replay(new), strict=True))
            self.known.update((w, i) for w, i in fresh.items() if len(w) <= 24)
            known = self.known
            for words in split:
                ids: list[int] = []
                for w in words:
                    ids += known[w] if w in known else fresh[w]
                yield ids
            lo = hi


_ready: dict[int, Replay] = {}


def _encoder(shared) -> Replay:
    """One encoder for each worker process and broadcast vocabulary."""
    if shared.jid not in _ready:
        _ready.clear()
        _ready[shared.jid] = Replay(*shared.value)
    return _ready[shared.jid]


class _Shared:
    """A broadcast that also carries a key for the worker's cache."""

    def __init__(self, spark, path: str):
        v = Vocabulary(path)
        self._b = spark.sparkContext.broadcast((v.byte_ids, v.merges))
        self.jid = self._b._jbroadcast.id()

    @property
    def value(self):
        return self._b.value

    def __getstate__(self):
        return {"_b": self._b, "jid": self.jid}


def token_ids(df: DataFrame, id: str, text: str, path: str | None = None) -> DataFrame:
    """(id, ids array<int>) for each row."""
    shared = _Shared(df.sparkSession, path or tokenizer_file())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared).encode
        for b in batches:
            for part in _slices(b):
                ids = list(encode(part.column(1).to_pylist()))
                offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.fromiter((x for i in ids for x in i), np.int32, offsets[-1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[id, "ids"])

    kind = df.schema[id].dataType.simpleString()
    return spread(df.select(F.col(id), F.col(text))).mapInArrow(run, f"`{id}` {kind}, ids array<int>")


def token_counts(df: DataFrame, id: str, text: str, path: str | None = None) -> DataFrame:
    """(id, n_tokens int) for each row; null and empty texts have 0."""
    shared = _Shared(df.sparkSession, path or tokenizer_file())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared).encode
        for b in batches:
            n = np.fromiter((len(i) for i in encode(b.column(1).to_pylist())), np.int32, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n)], names=[id, "n_tokens"])

    kind = df.schema[id].dataType.simpleString()
    return spread(df.select(F.col(id), F.col(text))).mapInArrow(run, f"`{id}` {kind}, n_tokens int")


def _slices(b: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for i in range(0, b.num_rows, rows):
        yield b.slice(i, rows)
