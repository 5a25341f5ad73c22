"""Packing of documents into prompts of fixed numbers of tokens.

Method: hierarchical multi-length packing. There are several context lengths, as the entries of a list of models have them. A document is routed to
the shortest that holds it; one that exceeds the longest is cut into full windows of the longest and a rest. The lengths are packed from the longest to the shortest: while
documents routed to a length are left, a window of it is opened by the longest of them, and its gap is filled from the same and the shorter tiers: by two lengths that fit it
exactly if such are found in a few tries, else by the longest that fits, as often as it fits. What long windows take from shorter tiers needs no window there. Prompts are then dealt to steps
of ``group`` in a snake over their tokens, so that steps hold nearly the same number.

Scale. The plan depends only on how many items there are of each length, a table of at most as many rows as the longest context has tokens, whatever the
number of documents; windows of one pattern are planned together with their multiplicity. The next lower length that is left is found by
a forest of links (union-find), so planning is nearly linear in the number of different lengths. An item finds its place by its rank among the items of its length. The rank is counted
within salted parts and offset by the parts' sizes, so a length that a third of the documents have is no single task; the place is then looked up in the plan by bisection.

Edge cases. Null and empty texts have 0 tokens and take no room: they are spread over the prompts. A document over
the longest context is the only one that is split. Repeated rows are items of their own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folialis.llm.bpe import token_counts
from folialis.sources import model_list
from folialis.sources.storage import written

#: Parts into which the items of each length are ranked: at least SALTS, and so many that PART rows of one length are one part on average.
SALTS, PART = 64, 500_000
#: Pairs that are tried to fill a gap exactly.
TRIES = 12


def tier_of(length: int, capacity: int) -> int:
    """0 over half of the capacity, 1 over a quarter, ..."""
    t = 0
    while length * 2 <= capacity and length:
        length *= 2
        t += 1
    return t


class Plan:
    """Windows for items given as {length: count}, each length over 0 and at most the longest capacity."""

    def __init__(self, counts: dict[int, int], capacities: int | Sequence[int]):
        self.capacities = sorted({capacities} if isinstance(capacities, int) else set(capacities), reverse=True)
        top = self.capacities[0]
        self.left = [0] * (top + 1)
        for s, n in counts.items():
            self.left[s] = n
        # lower[s] leads to the longest length up to s that is left, 0 if there is none
        self.lower = [s if self.left[s] else s - 1 for s in range(top + 1)]
        self.lower[0] = 0
        #: (capacity, windows, {length: uses in a window})
        self.windows_of: list[tuple[int, int, dict[int, int]]] = []
        for capacity, floor in zip(self.capacities, [*self.capacities[1:], 0], strict=True):
            while (longest := self._upto(capacity)) > floor:
                self._open(capacity, longest)
        # fullest first, so that the snake over them balances the steps
        self.windows_of.sort(key=lambda x: (-sum(s * u for s, u in x[2].items()), -x[0]))
        self.patterns = [(m, used) for _, m, used in self.windows_of]
        self.windows = sum(m for _, m, _ in self.windows_of)

    def _upto(self, s: int) -> int:
        lower = self.lower
        while lower[s] != s:
            lower[s] = lower[lower[s]]
            s = lower[s]
        return s

    def _free(self, s: int, used: dict[int, int]) -> int:
        """The longest length up to s of which the pattern leaves an item."""
        s = self._upto(s)
        while s and self.left[s] == used.get(s, 0):
            s = self._upto(s - 1)
        return s

    def _open(self, capacity: int, longest: int) -> None:
        used = {longest: 1}
        gap = capacity - longest
        while gap and (s := self._free(gap, used)):
            if s < gap and (pair := self._pair(gap, s, used)):
                for x in pair:
                    used[x] = used.get(x, 0) + 1
                break
            n = min(gap // s, self.left[s] - used.get(s, 0))
            used[s] = used.get(s, 0) + n
            gap -= n * s
        m = min(self.left[s] // u for s, u in used.items())
        self.windows_of.append((capacity, m, used))
        for s, u in used.items():
            self.left[s] -= m * u
            if not self.left[s]:
                self.lower[s] = s - 1

    def _pair(self, gap: int, s: int, used: dict[int, int]) -> tuple[int, int] | None:
        """Two lengths that fill a gap together."""
        for _ in range(TRIES):
            if not s:
                return None
            rest = gap - s
            if rest > s:
                return None
            if self.left[rest] - used.get(rest, 0) > (rest == s):
                return s, rest
            s = self._free(s - 1, used)
        return None

    def rows(self) -> list[tuple[int, int, int, int, int, int, int]]:
        """(length, first rank, end rank, first window, uses in a window, first slot, capacity)."""
        out, at, window = [], {}, 0
        for capacity, m, used in self.windows_of:
            slot = 0
            for s in sorted(used, reverse=True):
                u, first = used[s], at.get(s, 0)
                out.append((s, first, first + m * u, window, u, slot, capacity))
                at[s] = first + m * u
                slot += u
            window += m
        return out


class Places:
    """A plan as arrays, for looking up many items at once."""

    def __init__(self, plan: Plan):
        rows = np.array(sorted(plan.rows()) or [(0, 0, 0, 0, 1, 0, 0)], np.int64)
        self.key, (self.first, self.window, self.uses, self.slot) = rows[:, 0] << 40 | rows[:, 1], rows[:, [1, 3, 4, 5]].T.copy()
        runs = [(m, c) for c, m, _ in plan.windows_of] or [(1, plan.capacities[-1])]
        self.starts = np.cumsum([0, *(m for m, _ in runs[:-1])])
        self.capacity = np.array([c for _, c in runs])
        self.windows = max(1, plan.windows)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(prompt, slot from 1 or 0 for items without tokens, capacity of the prompt)."""
        k = np.searchsorted(self.key, length << 40 | rank, "right") - 1
        inner = rank - self.first[k]
        some = length > 0
        prompt = np.where(some, self.window[k] + inner // self.uses[k], rank % self.windows)
        return prompt, np.where(some, self.slot[k] + inner % self.uses[k] + 1, 0), self.capacity[np.searchsorted(self.starts, prompt, "right") - 1]


def pack(df: DataFrame, id: str, text: str, capacity: int | Sequence[int], group: int = 8, path: str | None = None) -> DataFrame:
    """(id, piece, first_token, n_tokens, tier, prompt_id, slot, step_id, context_length): the place of each document or piece of one.

    capacity: the context length, or several; context_length: that of the prompt; tier: of the item within the longest, by halves.
    """
    longest = capacity if isinstance(capacity, int) else max(capacity, default=0)
    if longest < 1 or not isinstance(capacity, int) and min(capacity) < 1:
        raise ValueError("a prompt must hold at least one token")
    spark = df.sparkSession
    counted = written(token_counts(df, id, text, path), "counts")
    pieces = F.greatest(F.lit(1), F.expr(f"cast(ceil(n_tokens / {longest}) as int)"))
    items = (
        counted.select(id, "n_tokens", F.posexplode(F.sequence(F.lit(1), pieces)).alias("k", "piece"))
        .withColumn("first_token", F.col("k") * longest)
        .select(F.col(id).alias("item"), "piece", "first_token", F.least(F.lit(longest), F.col("n_tokens") - F.col("first_token")).alias("len"))
    )
    salts = max(SALTS, counted.count() // PART)
    salted = items.withColumn("salt", F.pmod(F.xxhash64("item", "piece"), F.lit(salts)))
    parts = written(salted.groupBy("len", "salt").agg(F.count("*").alias("n")), "lengths")
    before = Window.partitionBy("len").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("len", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    # at most longest + 1 rows
    counts = {r["len"]: r["n"] for r in parts.groupBy("len").agg(F.sum("n").alias("n")).collect()}
    counts.pop(0, None)
    places = Places(Plan(counts, capacity))
    n_steps = -(-places.windows // group)
    rank = F.row_number().over(Window.partitionBy("len", "salt").orderBy("item", "piece")) - 1
    ranked = salted.withColumn("in_part", rank).join(offsets, ["len", "salt"])
    shared = spark.sparkContext.broadcast(places)
    kind = df.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            item, piece, first, length, rank = b.columns
            n = length.to_numpy().astype(np.int64)
            prompt, slot, size = shared.value.find(n, rank.to_numpy())
            turn, at = prompt // n_steps, prompt % n_steps
            tier = np.where(n > 0, np.floor(np.log2(longest / np.maximum(n, 1))).astype(np.int64), np.floor(np.log2(longest)).astype(np.int64) + 1)
            out = [item, piece, first, length, pa.array(tier, pa.int32()), pa.array(prompt), pa.array(slot, pa.int32(), mask=n == 0), pa.array(np.where(turn % 2 == 0, at, n_steps - 1 - at)), pa.array(size, pa.int32())]
            yield pa.RecordBatch.from_arrays(out, names=[id, "piece", "first_token", "n_tokens", "tier", "prompt_id", "slot", "step_id", "context_length"])

    placed = ranked.select("item", "piece", "first_token", F.col("len").cast("int"), (F.col("in_part") + F.col("offset")).cast("long").alias("rank"))
    return placed.mapInArrow(run, f"`{id}` {kind}, piece int, first_token int, n_tokens int, tier int, prompt_id long, slot int, step_id long, context_length int")


def context_lengths(models: DataFrame, protocols: tuple[str, ...] = ("chat",)) -> dict[int, str]:
    """{context length: first model} of the usable entries of a gateway's list."""
    # the list of a gateway's models is no corpus: a few rows
    rows = model_list.usable(models.withColumn("place", F.struct("context_length", F.col("name"))), "place", protocols).where("context_length > 0").collect()
    return {n: min(r["id"] for r in rows if r["context_length"] == n) for n in sorted({r["context_length"] for r in rows})}


def context_length(models: DataFrame, entry: str) -> int:
    """The context length of the first entry of that name, as a gateway's list is read: ids trimmed, blank ones left out."""
    # the list of a gateway's models is no corpus: a few rows
    row = models.where((F.trim("id") == entry) & (F.col("context_length") > 0)).select("context_length").head()
    if row is None:
        raise ValueError(f"no model {entry!r} with a context length")
    return row[0]
