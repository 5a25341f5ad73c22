"""Near-duplicate texts: minwise fingerprints cut into blocks, joined on equal blocks, verified.

Method. The fingerprint of a text has one symbol for each of BLOCKS * WIDTH minwise hashes of its word shingles; two
texts of similarity s differ in a share 1 - s of the symbols. It is split into BLOCKS blocks. Two fingerprints that
differ in fewer symbols than there are blocks share a block for certain, by the pigeonhole principle; at the lowest
similarity asked for, 0.5, a block is shared with probability 1 - (1 - 0.5**5)**96 = 0.953, at 0.55 with 0.992, at 0.6 with
0.9995. Shorter blocks would find those as well with fewer of them, but texts that share stock phrases (similarity 0.05) then meet
so often by chance that the candidates grow as the square of the input. The join on blocks gives candidates; the Hamming distance of a sketch of two bits of each symbol
drops those that are clearly apart; those not clearly close are then compared exactly by their sets of shingles.

Scale. Texts of one word sequence form a class, and only the smallest id of a class is compared, so that copies cost
nothing. No text is moved but those of pairs near the threshold. Block keys are shuffled and sorted once, and the pairs of each key's run are formed while its rows stream by. A key (or, for
the pairs within a class, a class) of more than HOT rows is cut into parts of HOT, and every two parts meet in a task of their own, so all its pairs come out without one task that holds them.

Edge cases. Null or blank text: the row takes part in no pair. Fewer words than a shingle: likewise. Rows with the
same id twice: one of them counts. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folialis.llm import words as W
from folialis.sources.storage import spread, written

BLOCKS, WIDTH = 96, 5
#: Symbols of the sketch.
M = 256
#: Standard deviations of the sketch's estimate within which a pair is compared exactly.
SIGMAS = 4.5

#: Ids (of 8 bytes) up to which those of texts to compare exactly are sent to all executors.
FEW = 1_000_000
#: Rows of one block key or class of which the pairs are formed in one task.
HOT = 2_000
#: 64-bit words of a sketch.
SKETCH = M * 2 // 64
_PRINT = "id long, c1 long, c2 long, " + "".join(f"s{j} long, " for j in range(SKETCH)) + "blocks array<long>"


def _fingerprints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*((c, pa.int64()) for c in ("id", "c1", "c2", *(f"s{j}" for j in range(SKETCH)))), ("blocks", pa.list_(pa.int64()))])
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            for lo, hi in W.chunks(texts):
                words, first = W.word_hashes(texts[lo:hi])
                h, at = W.shingle_hashes(words, first, k)
                has = np.flatnonzero(np.diff(at))
                if not len(has):
                    continue
                sig = W.minwise(h, at, BLOCKS * WIDTH)
                c1, c2 = (W.sequence_hash(words, first, s)[has].view(np.int64) for s in (1, 2))
                # the symbols are minima, so their own high bits are mostly 0: bits are taken after mixing
                two = (W.mix(sig[:, :M].astype(np.uint64))[:, :, None] >> np.array([40, 41], np.uint64)) & np.uint64(1)
                bits = np.packbits(two.reshape(len(has), 2 * M).astype(np.uint8), axis=1).view(np.int64)
                # a block's key: its number and 57 bits of its symbols
                sym = sig.reshape(len(has), BLOCKS, WIDTH).astype(np.uint64)
                key = np.zeros((len(has), BLOCKS), np.uint64)
                for j in range(WIDTH):
                    key = W.mix(key * np.uint64(31) + sym[:, :, j])
                key = (key >> np.uint64(7)) << np.uint64(7) | np.arange(BLOCKS, dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[lo:hi][has]), pa.array(c1), pa.array(c2), *(pa.array(np.ascontiguousarray(bits[:, j])) for j in range(SKETCH)),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, len(has) * BLOCKS + 1, BLOCKS, dtype=np.int32)), pa.array(key.view(np.int64).ravel()))],
                    schema=schema,
                )

    return run


def _shingle_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            for lo, hi in W.chunks(texts):
                h, at = W.shingle_hashes(*W.word_hashes(texts[lo:hi]), k)
                sets = [np.unique(h[at[i] : at[i + 1]] >> np.uint64(32)).astype(np.uint32).view(np.int32) for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi]), pa.array(sets, pa.list_(pa.int32()))], names=["id", "set"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, -1) for each pair of ids of one key, from rows (id, key) sorted by key; of a key of more than HOT rows (id, key, number of its part) for each row."""
    hot = HOT
    ids, keys = np.zeros(0, np.int64), np.zeros(0, np.int64)
    large, seen = None, 0

    def parts(i: np.ndarray, key: int, first: int) -> pa.RecordBatch:
        return _rows(i, np.full(len(i), key, np.int64), (np.arange(first, first + len(i)) // hot).astype(np.int32))

    def pairs(i: np.ndarray, k: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(k)))
        for n in np.unique(sizes[sizes > 1]).tolist():
            if n > hot:
                for at in starts[sizes == n].tolist():
                    yield parts(i[at : at + n], int(k[at]), 0)
                continue
            x, y = np.triu_indices(n, 1)
            # as many runs at once as give about a million pairs
            of_size = starts[sizes == n]
            step = max(1, 1_000_000 // len(x))
            for lo in range(0, len(of_size), step):
                block = i[of_size[lo : lo + step, None] + np.arange(n)]
                a, b = block[:, x].ravel(), block[:, y].ravel()
                low, high = np.minimum(a, b), np.maximum(a, b)
                keep = low < high
                yield _rows(low[keep], high[keep], np.full(int(keep.sum()), -1, np.int32))

    for batch in batches:
        i, k = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if large is not None:
            # a large key goes on
            n = int(np.searchsorted(k != large, True)) if len(k) and k[0] == large else 0
            if n:
                yield parts(i[:n], large, seen)
                seen += n
            if n == len(k):
                continue
            i, k, large = i[n:], k[n:], None
        ids, keys = np.concatenate((ids, i)), np.concatenate((keys, k))
        # the last run may go on in the next batch
        last = int(np.flatnonzero(keys[:-1] != keys[1:])[-1]) + 1 if len(keys) > 1 and (keys[:-1] != keys[1:]).any() else 0
        yield from pairs(ids[:last], keys[:last])
        ids, keys = ids[last:], keys[last:]
        if len(ids) > hot:
            large, seen = int(keys[0]), len(ids)
            yield parts(ids, large, 0)
            ids, keys = ids[:0], keys[:0]
    yield from pairs(ids, keys)


def _rows(a: np.ndarray, b: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(part)], names=["a", "b", "part"])


def _across(rows: DataFrame) -> DataFrame:
    """(a, b): the pairs of ids within each key of rows (id, key, part, last), part from 0 to last: every two parts of a key are joined by themselves."""
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), "last"))).select("id", "key", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    left = met.where("part = low").select(F.col("id").alias("x"), "key", "low", "high")
    right = met.where("part = high").select(F.col("id").alias("y"), "key", "low", "high")
    both = left.join(right, ["key", "low", "high"]).where((F.col("x") < F.col("y")) | (F.col("low") < F.col("high")) & (F.col("x") != F.col("y")))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _text(title: str | None, body: str) -> Column:
    return F.col(body) if title is None else F.concat_ws(" ", F.coalesce(F.col(title), F.lit("")), F.col(body))


class NearDuplicates:
    """The pairs of texts with a Jaccard similarity of word shingles of at least ``threshold``.

    ``links``: (a, b), a < b, between representatives of different word sequences; ``members``: (id, rep), one row
    for each row that has a shingle, rep the smallest id with the same word sequence.
    """

    def __init__(self, df: DataFrame, id: str, body: str, title: str | None = None, shingle: int = 5, threshold: float = 0.8):
        if not 0.5 <= threshold <= 1:
            raise ValueError("the blocks are cut for similarities from 0.5 up")
        rows = df.where(F.trim(F.col(body)) != "").select(F.col(id).cast("long").alias("id"), _text(title, body).alias("text"))
        prints = written(spread(rows).mapInArrow(_fingerprints(shingle), _PRINT), "prints")
        classes = prints.groupBy("c1", "c2").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
        copies = written(prints.join(classes.where("n > 1"), ["c1", "c2"]).where("id <> rep").select("id", "rep").distinct(), "copies")
        self.members = prints.select("id").distinct().join(copies, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))
        self.links = self._links(rows, prints.join(copies.select("id"), "id", "left_anti"), shingle, threshold)

    @staticmethod
    def _links(rows: DataFrame, reps: DataFrame, shingle: int, threshold: float) -> DataFrame:
        keyed = reps.select("id", F.explode("blocks").alias("key"))
        runs = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_runs, "a long, b long, part int")
        candidates = written(runs.distinct(), "candidates")
        pairs = candidates.where("part < 0").select("a", "b")
        large = candidates.where("part >= 0").select(F.col("a").alias("id"), F.col("b").alias("key"), "part")
        if not large.isEmpty():
            pairs = pairs.union(_across(large.join(large.groupBy("key").agg(F.max("part").alias("last")), "key"))).distinct()
        sketch = reps.select("id", *(f"s{j}" for j in range(SKETCH))).dropDuplicates(["id"])
        for side in ("a", "b"):
            pairs = pairs.join(sketch.select(F.col("id").alias(side), *(F.col(f"s{j}").alias(f"{side}{j}") for j in range(SKETCH))), side)
        # symbols of two bits: a symbol differs if either bit does
        apart = [F.col(f"a{j}").bitwiseXOR(F.col(f"b{j}")) for j in range(SKETCH)]
        differ = sum((F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))) for x in apart), F.lit(0))
        # one of four values is equal by chance
        p = (1 - threshold) * 3 / 4
        slack = SIGMAS * (max(p * (1 - p), 0.05) / M) ** 0.5
        share = differ / F.lit(float(M))
        near = written(pairs.where(share <= p + slack).select("a", "b", (share <= max(p - slack, 0.0)).alias("sure")), "near")
        doubt = near.where("not sure").select("a", "b")
        wanted = written(doubt.select(F.col("a").alias("id")).union(doubt.select(F.col("b").alias("id"))).distinct(), "wanted")
        if wanted.count() <= FEW:
            # else the texts are shuffled by id to meet theirs
            wanted = F.broadcast(wanted)
        sets = rows.join(wanted, "id", "left_semi").mapInArrow(_shingle_sets(shingle), "id long, set array<int>").dropDuplicates(["id"])
        exact = (
            doubt.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
            .withColumn("both", F.size(F.array_intersect("x", "y")))
            .where(F.col("both") >= F.lit(threshold) * (F.size("x") + F.size("y") - F.col("both")))
            .select("a", "b")
        )
        return written(near.where("sure").select("a", "b").union(exact), "links")

    def pairs(self) -> DataFrame:
        """Every pair of rows: links between classes and pairs within a class, by way of the members."""
        m = self.members
        left, right = m.select(F.col("id").alias("x"), F.col("rep").alias("a")), m.select(F.col("id").alias("y"), F.col("rep").alias("b"))
        across = self.links.join(left, "a").join(right, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        sizes = m.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select("rep", F.ceil(F.col("n") / HOT).cast("int").alias("parts"))
        copies = m.join(sizes, "rep").select("id", F.col("rep").alias("key"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), (F.col("parts") - 1).alias("last"))
        return across.union(_across(copies))

    def edges(self) -> DataFrame:
        """The same groups with the fewest edges: links, and each copy tied to its representative."""
        return self.links.select("a", "b").union(self.members.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")))
