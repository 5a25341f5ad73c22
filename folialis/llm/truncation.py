"""Texts cut off by field limits or broken transfers, and how often each source cuts.

Method. (1) Footers: suffixes that a large share of a source's texts have in common are taken off, then marks of a cut. (2) Limits: lengths, in characters or
bytes, at which a source has a spike. To each a right-censored log-normal length distribution is fitted by maximum likelihood
(what stands at the limit counts as "at least this long"), and the posterior that a text at the limit was cut is 1 minus the number of
texts that the distribution expects there, by the number there are. (3) Endings: each text ends in one of four kinds: open (within a word, a bracket, an entry, or with a mark of
a cut), a full stop, a line that is whole without one (a reference, a link, a list of terms), or closed. How often texts that were cut and whole ones end in each kind is learned by expectation maximisation over all texts, with
the censoring posteriors as the priors of texts at limits and a rate, learned as well, for all others; each source then has a rate of its own. Before a full stop the token counts too: how often it is followed by the start of a
sentence or line, and how often by more of the same sentence (as after "i.e." or the first half of a decimal). (4) A text is a case if the odds
of its prior (posterior at its limit, else its source's rate) times the ratio of its ending's two shares are over 1. by_length tells the rows in which the length decided.

Scale. Counts of tokens are kept in a table of fixed size with two cells for each token, of which the emptier counts, lengths and suffixes are aggregated before they are shuffled, and the
limits are a few rows for each source, joined by source and length. Texts are never moved; they are read once for tokens, once for suffixes, once more
for each time the length of the longest footer doubles, and once for lengths and endings, which are then a small table. What goes to the driver is a table of posteriors by kinds, of fixed size.

Edge cases. Null, empty and blank texts are no case. A null source is a source of its own. A text of footer only is no
case. Small tables have no spikes, and endings alone decide, by the shares that are assumed before any text is seen.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folialis.sources.storage import spread, written

CELLS = 1 << 18
#: Share of a source's texts that must end alike for a footer, its least length, and the characters by which it is grown in the first pass (twice as long ones in later ones).
FOOTER, SHORTEST, STEP = 0.25, 6, 64
#: A spike: at least so many texts of one length, so large a share of the source, and so many times the density around.
SPIKE_N, SPIKE_SHARE, SPIKE_RATIO, AROUND = 5, 0.008, 4.0, 50

#: Footers up to which they are sent to all executors.
MANY = 100_000

# Marks of a cut, closing marks after a full stop, and lines that are whole without one.
_MARK = re.compile(r"(?:…|\.\.\.|\[\s*(?:…|\.\.\.)\s*\]|\((?:…|\.\.\.)\))$")
_BLANK = " \t\n\x0b\f\r"
_CLOSERS = "\"'”’»)]）】》」』*_`~"
_STOPS = ".!?。！？"
_WHOLE = {
    "table": re.compile(r"^\|.*\|$"), "fence end": re.compile(r"^(?:```|~~~)$"), "rule": re.compile(r"^(?:-{3,}|\*{3,}|={3,})$"), "link": re.compile(r"^(?:\S+:\s+)?<?(?:https?://|www\.)[^\s/]+\.[a-z]{2,}(?:/\S+)?>?$", re.I),
    "reference": re.compile(r"(?:pp?|S)\.\s?\d+\s?[-–]\s?\d+$|\b(?:doi:\s*)?10\.\d{4,}/\S+$", re.I), "page": re.compile(r"^[(\[]?(?:p|pp|page|S|Seite|第)\.?\s?\d+(?:\s?[-–/]\s?\d+)?\s?页?[)\]]?$", re.I),
    "terms": re.compile(r"^(?:key\s?words?|index terms|tags?|topics?|schlagw(?:ö|oe)rter|stichw(?:ö|oe)rter|mots[- ]cl(?:é|e)s|关键词|关键字|标签)\s*[:：]\s*\S.*[^\s,;，；、:：]$", re.I),
    "sources": re.compile(r"^(?:sources?|quellen?|来源|references?)\s*[:：]\s*(?:\[\d+\][,;]?\s*)*\[\d+\]$", re.I), "signature": re.compile(r"^(?:[—–]|--)\s?\S.{2,}$"), "date": re.compile(r"(?:19|20)\d\d-\d\d-\d\d$|\b\d{1,2}:\d\d$"),
}
#: The kinds of endings: within something that goes on; a full stop; a line that is whole without one; what is closed, so that no cut lies inside.
KINDS = {
    "open": ("mark", "entry", "fence", "bracket", "row", "word", "number", "sign"), "stop": ("stop",), "line": ("table", "fence end", "rule", "link", "reference", "page", "terms", "sources", "signature", "date"), "closed": ("whole entry", "wide stop"),
}
CLASSES = tuple(KINDS)
KIND_OF = {x: k for k, xs in KINDS.items() for x in xs}
#: Shares of cut and of whole texts that end in each kind, before any text is seen.
SHARES = {"open": (0.965, 0.001), "stop": (0.015, 0.65), "line": (0.01, 0.145), "closed": (0.01, 0.2)}
#: Texts that the assumed shares count as, the assumed rate of cuts off the limits, rounds, and the steps in which posteriors are counted.
ASSUMED, RATE, ROUNDS, STEPS = 50.0, 0.03, 50, 50


@lru_cache(100_000)
def _cells(token: str) -> tuple[int, int]:
    """The token's cell in each row of the table."""
    raw = token.encode()
    return zlib.crc32(raw) % CELLS, CELLS + zlib.adler32(raw[::-1], zlib.crc32(raw, 0x9E3779B9)) * 0x9E3779B1 % 0xFFFFFFFB % CELLS


def _shape(token: str) -> str:
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"\d", "9", token))


def endings(text: str) -> Iterator[tuple[str, bool]]:
    """(token before a full stop, digits as 9, whether a sentence or line begins after it) for each full stop but the last."""
    for m in re.finditer(r"[.!?]", text):
        i = m.end()
        if i >= len(text):
            return
        a = i - 1
        while a > 0 and i - a < 14 and not text[a - 1].isspace():
            a -= 1
        while i < len(text) and text[i] in _CLOSERS:
            i += 1
        j = i
        while j < len(text) and text[j].isspace():
            j += 1
        if j >= len(text):
            return
        new = j > i and (("\n" in text[i:j]) or text[j].isupper() or text[j] in "“„«\"[#-*>‘" or text[j] > "⺀") or text[j] > "⺀"
        yield _norm(text[a : m.end()]), new


def _norm(token: str) -> str:
    return re.sub(r"\d", "9", token).lower().lstrip("([{\"'“„«")


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of endings by cell."""
    counts = np.zeros((2, 2 * CELLS), np.int64)
    cells: Counter = Counter()
    for b in batches:
        for text in b.column(0).to_pylist():
            if text and text.strip():
                cells.update(endings(text))
        if len(cells) > 200_000:
            _spend(cells, counts)
    _spend(cells, counts)
    flat = counts.ravel()
    at = np.flatnonzero(flat)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["cell", "n"])


def _spend(cells: Counter, counts: np.ndarray) -> None:
    for (token, new), n in cells.items():
        for key in (token, "\0" + _shape(token)):
            for c in _cells(key):
                counts[int(new), c] += n
    cells.clear()


def _ended() -> Column:
    return F.rtrim("text", F.lit(_BLANK))


def common_ends(rows: DataFrame) -> list[tuple[str | None, str]]:
    """(source, suffix): the ends that a share of a source's texts have in common, grown while nine tenths of these agree.

    Suffixes are counted over all tasks before any is dropped for its share.
    """
    ends = rows.select("source", _ended().alias("ended"))
    totals = ends.groupBy("source").agg(F.count("*").alias("total")).withColumnRenamed("source", "t_source")
    short = ends.where(F.length("ended") >= SHORTEST).groupBy("source", F.right("ended", F.lit(SHORTEST)).alias("s")).agg(F.count("*").alias("n")).where("n >= 5")
    seeds = short.join(totals, F.col("source").eqNullSafe(F.col("t_source"))).where(F.col("n") >= FOOTER * F.col("total")).select("source", "s", "n", "total")
    growing, out = [tuple(r) for r in seeds.collect()], []
    while growing:
        step = max(STEP, max(len(s) for _, s, *_ in growing))
        known = rows.sparkSession.createDataFrame(growing, "f_source string, s string, n long, total long").drop("n")
        if len(growing) <= MANY:
            known = F.broadcast(known)
        tails = (
            ends.join(known, F.col("source").eqNullSafe(F.col("f_source"))).where(F.col("ended").endswith(F.col("s")) & (F.length("ended") > F.length("s")))
            .groupBy("source", "s", "total", F.right("ended", F.length("s") + step).alias("tail")).agg(F.count("*").alias("n"))
        )
        longer = F.transform(F.sequence(F.length("s") + 1, F.length("tail")), lambda k: F.right(F.col("tail"), k))
        counted = tails.select("source", "s", "total", F.explode(longer).alias("x"), "n").groupBy("source", "s", "total", "x").agg(F.sum("n").alias("n"))
        # at most ten of each length
        got: dict = defaultdict(dict)
        for r in counted.where((F.col("n") >= 2) & (F.col("n") >= 0.1 * F.col("total"))).select("source", "s", "x", "n").collect():
            got[r.source, r.s][r.x] = r.n
        more = []
        for source, s, n, total in growing:
            by_rest: dict[str, list] = defaultdict(list)
            for x, m in got[source, s].items():
                by_rest[x[1:]].append((m, x))
            x = s
            while (best := max(by_rest[x], default=(0, ""))) and best[0] >= 0.9 * n:
                n, x = best
            if len(x) == len(s) + step:
                more.append((source, x, n, total))
            else:
                out.append((source, x))
        growing = more
    return out


def footers(ends: list[tuple[str | None, str]]) -> list[tuple[str | None, str]]:
    """(source, footer) from the common ends, without leading full stops."""
    out = []
    for source, s in ends:
        s = s.lstrip(_STOPS + _CLOSERS.replace("[", "").replace("(", "") + "…")
        # a footer begins at a line end, else at a blank or a bracket, not within a word of the text
        m = re.search(r"\n", s) or re.search(r"[\s<\[(]", s)
        s = s[m.start() :] if m else s
        # a common end of sentences is no footer, unless it stands in a line of its own
        own_line = "\n" in s or s.rstrip()[-1:] not in _STOPS
        if own_line and len(s.strip()) >= SHORTEST - 1 and any(c.isalpha() for c in s):
            out.append((source, s))
    return out


def boundary(token: str, counts: np.ndarray) -> float:
    """The probability that a text may end in a token with a full stop."""
    p = 0.9
    for key, weight in (("\0" + _shape(token), 4.0), (token, 2.0)):
        # of the two cells the one that fewer tokens share
        no, yes = min(((counts[c], counts[2 * CELLS + c]) for c in _cells(key)), key=sum)
        p = (yes + weight * p) / (no + yes + weight)
    return float(min(max(p, 1e-6), 1 - 1e-6))


def ending(body: str, counts: np.ndarray) -> tuple[str, float] | None:
    """(the ending of a text without its footer, probability that a text may end in its last token); None for a blank one."""
    if not body.strip():
        return None
    text = body.rstrip()
    if unmarked(text) is not text:
        return "mark", 0.0
    if text.lstrip().startswith("@") and "{" in text[:40]:
        return ("entry" if text.count("{") > text.count("}") else "whole entry"), 0.0
    if "```" in text and sum(line.lstrip().startswith("```") for line in text.split("\n")) % 2:
        return "fence", 0.0
    line = text[text.rfind("\n") + 1 :].strip()
    if line.startswith("|"):
        return ("table" if _WHOLE["table"].match(line) and len(line) > 2 else "row"), 0.0
    opened = max(line.rfind("("), line.rfind("["))
    if opened >= 0 and not re.search(r"[)\]]", line[opened:]):
        return "bracket", 0.0
    for kind, pattern in _WHOLE.items():
        if kind != "table" and pattern.search(line):
            return kind, 0.0
    end = text.rstrip(_CLOSERS).rstrip()
    if end and end[-1] in "。！？":
        return "wide stop", 1.0
    if end and end[-1] in ".!?":
        a = len(end) - 1
        while a > 0 and len(end) - a < 13 and not end[a - 1].isspace():
            a -= 1
        return "stop", boundary(_norm(end[a:]), counts)
    return ("word" if text[-1].isalpha() else "number" if text[-1].isdigit() else "sign"), 0.0


def unmarked(text: str) -> str:
    """A text without a mark of a cut at its end and the blanks around it; the text itself if there is none."""
    end = text.rstrip()
    if not end.endswith(("…", "...", "]", ")")):
        return text
    m = _MARK.search(end, max(0, max(end.rfind(x) for x in ("…", "...")) - 3))
    return end[: m.start()].rstrip() if m else text


def learn_shares(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(share of cut texts by kind of ending, of whole texts, rate of cuts off the limits) from the texts counted by step of their posterior (0: at no limit) and kind."""
    assumed = np.array(list(SHARES.values())).T
    assumed /= assumed.sum(1, keepdims=True)
    cut, whole, rate = assumed[0], assumed[1], RATE
    at = (np.arange(1, STEPS + 1) - 0.5) / STEPS
    for _ in range(ROUNDS):
        prior = np.concatenate(([rate], at))[:, None]
        was_cut = prior * cut / (prior * cut + (1 - prior) * whole)
        n_cut, n_whole = (counts * was_cut).sum(0), (counts * (1 - was_cut)).sum(0)
        rate = float((counts[0] * was_cut[0]).sum() + ASSUMED * RATE) / (counts[0].sum() + ASSUMED)
        cut, whole = ((n + ASSUMED * p) / (n.sum() + ASSUMED) for n, p in ((n_cut, assumed[0]), (n_whole, assumed[1])))
    return cut, whole, rate


def case_odds(kind: Column, boundary: Column, prior: Column, cut: np.ndarray, whole: np.ndarray, ends: float) -> Column:
    """The log-odds that a text is a case, from the kind of its ending, its token and its prior. ends: the share of full stops of running text that end a sentence.

    A cut falls behind any full stop alike, so of the cuts of kind "stop" those within a sentence are cases; whole texts end in tokens as sentences do.
    """
    ratios = F.create_map(*(F.lit(x) for k, a, w in zip(CLASSES, cut, whole, strict=True) for x in (k, float(a / w))))
    ratio = prior / (1 - prior) * F.element_at(ratios, kind)
    inside = F.log(ratio * (1 - boundary) / (boundary / F.lit(ends) + ratio * boundary))
    return F.when(kind == "closed", F.lit(-math.inf)).when(kind == "stop", inside).otherwise(F.log(ratio))


def _fit(n: float, s1: float, s2: float, n_at: float, limit: float) -> tuple[float, float]:
    """Mean and deviation of the logarithm of a length, of which n_at are only known to be at least the limit, by EM."""
    if n < 2:
        return math.log(limit), 1.0
    a = math.log(limit)
    mu, sd = s1 / n, math.sqrt(max(1e-4, s2 / n - (s1 / n) ** 2))
    for _ in range(60):
        z = (a - mu) / sd
        tail = max(1e-12, 0.5 * math.erfc(z / math.sqrt(2)))
        h = math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / tail
        m1 = mu + sd * h
        m2 = mu * mu + sd * sd + sd * (a + mu) * h
        mu_new = (s1 + n_at * m1) / (n + n_at)
        sd = math.sqrt(max(1e-4, (s2 + n_at * m2) / (n + n_at) - mu_new**2))
        if abs(mu_new - mu) < 1e-6:
            break
        mu = mu_new
    return mu, sd


def _posteriors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for g in batches:
        out = []
        for r in g.itertuples():
            mu, sd = _fit(r.n_under, r.s1, r.s2, r.n + r.n_over, r.length)
            z = (math.log(r.length) - mu) / sd
            expected = (r.n_under + r.n + r.n_over) * math.exp(-z * z / 2) / (sd * r.length * math.sqrt(2 * math.pi))
            out.append(min(max(1 - expected / r.n, 0.0), 0.999))
        yield pd.DataFrame({"source": g["source"], "unit": g["unit"], "length": g["length"], "posterior": out})


def _limits(ends: DataFrame) -> DataFrame:
    """(source, unit, length, posterior) of each length at which a source has a spike."""
    units = F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("octets").alias("length")))
    counts = written(ends.select("source", F.explode(units).alias("u")).where("u.length > 0").groupBy("source", "u.unit", "u.length").agg(F.count("*").alias("n")), "lengths")
    key = ["source", "unit"]
    bucket = F.floor(F.col("length") / AROUND)
    near = counts.groupBy(*key, bucket.alias("b")).agg(F.sum("n").alias("m"))
    around = near.select(*key, F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("b"), "m").groupBy(*key, "b").agg(F.sum("m").alias("m"))
    totals = counts.groupBy(*key).agg(F.sum("n").alias("total"))
    same = lambda a, b, ks: F.expr(" AND ".join(f"{a}.{k} <=> {b}.{k}" for k in ks))
    spikes = (
        counts.withColumn("b", bucket).alias("c").join(around.alias("a"), same("c", "a", [*key, "b"])).join(totals.alias("t"), same("c", "t", key))
        .where((F.col("n") >= SPIKE_N) & (F.col("n") >= SPIKE_SHARE * F.col("total")) & (F.col("n") > SPIKE_RATIO * (F.col("m") - F.col("n")) / (3 * AROUND) + 1))
        .select("c.source", "c.unit", "c.length", "c.n")
    )
    spikes = written(spikes, "spikes")
    log = F.log("o.length")
    fitted = (
        spikes.alias("s").join(counts.alias("o"), same("s", "o", key))
        .groupBy("s.source", "s.unit", "s.length", "s.n")
        .agg(
            F.sum(F.when(F.col("o.length") < F.col("s.length"), F.col("o.n")).otherwise(0)).cast("double").alias("n_under"),
            F.sum(F.when(F.col("o.length") < F.col("s.length"), F.col("o.n") * log).otherwise(0.0)).alias("s1"),
            F.sum(F.when(F.col("o.length") < F.col("s.length"), F.col("o.n") * log * log).otherwise(0.0)).alias("s2"),
            F.sum(F.when(F.col("o.length") > F.col("s.length"), F.col("o.n")).otherwise(0)).cast("double").alias("n_over"),
        )
    )
    return fitted.mapInPandas(_posteriors, "source string, unit string, length int, posterior double")


def score(df: DataFrame, id: str, text: str, source: str) -> DataFrame:
    """(id, source, ending, boundary, posterior, odds, is_cut, by_length): the evidence for each text that is not blank.

    posterior: that its length was cut at a limit of the source, 0 at none; odds: of a case, as logarithm; by_length: without its length the text would be judged otherwise.
    """
    spark = df.sparkSession
    rows = spread(df.select(F.col(id).alias("id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text")).where(F.col("text").rlike(r"\S")))
    learned = rows.select("text").mapInArrow(_learn, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    # at most 4 * CELLS cells
    got = learned.toPandas()
    counts = np.zeros(4 * CELLS, np.float32)
    counts[got["cell"]] = got["n"]
    found = footers(common_ends(rows))
    marks = spark.createDataFrame(found, "f_source string, footer string")
    longest = marks.groupBy("f_source").agg(F.collect_list("footer").alias("footers"))
    if len(found) <= MANY:
        # else the texts are shuffled by source to meet theirs
        longest = F.broadcast(longest)
    with_footers = rows.join(longest, F.col("source").eqNullSafe(F.col("f_source")), "left").select("id", "source", "text", "footers")
    shared = spark.sparkContext.broadcast(counts)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            chars, octets, kinds, stops = [], [], [], []
            for t, ends in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if ends:
                    whole = t.rstrip(_BLANK)
                    # the longest footer of the source in which the text ends
                    off = max((len(f) for f in ends if whole.endswith(f)), default=0)
                    t = whole[: len(whole) - off] if off else t
                e = ending(t, table)
                bare = unmarked(t)
                chars.append(len(bare))
                octets.append(len(bare.encode()))
                kinds.append(e and e[0])
                stops.append(e and e[1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(chars, pa.int32()), pa.array(octets, pa.int32()), pa.array(kinds, pa.string()), pa.array(stops, pa.float64())], names=["id", "source", "chars", "octets", "ending", "boundary"])

    kind = df.schema[id].dataType.simpleString()
    ends = written(with_footers.mapInArrow(judge, f"id {kind}, source string, chars int, octets int, ending string, boundary double"), "ends")
    best = written(_limits(ends).groupBy("source", "unit", "length").agg(F.max("posterior").alias("p")), "limits")
    by_chars, by_octets = (best.where(F.col("unit") == u).select(F.col("source").alias(f"{u}_source"), F.col("length").alias(f"{u}_length"), F.col("p").alias(f"{u}_p")) for u in ("chars", "bytes"))
    placed = (
        ends.join(by_chars, F.col("source").eqNullSafe(F.col("chars_source")) & (F.col("chars") == F.col("chars_length")), "left")
        .join(by_octets, F.col("source").eqNullSafe(F.col("bytes_source")) & (F.col("octets") == F.col("bytes_length")), "left")
        .select("id", "source", "ending", "boundary", F.greatest(F.coalesce("chars_p", F.lit(0.0)), F.coalesce("bytes_p", F.lit(0.0))).alias("posterior"))
    )
    kind_of = F.element_at(F.create_map(*(F.lit(x) for pair in KIND_OF.items() for x in pair)), F.col("ending"))
    # at most (STEPS + 1) times the number of kinds rows
    step = F.when(F.col("posterior") > 0, F.least(F.lit(STEPS), F.floor(F.col("posterior") * STEPS) + 1)).otherwise(0)
    table = np.zeros((STEPS + 1, len(CLASSES)))
    for r in placed.where("ending is not null").groupBy(step.alias("step"), kind_of.alias("kind")).count().collect():
        table[r["step"], CLASSES.index(r["kind"])] = r["count"]
    cut, whole, rate = learn_shares(table)
    no, yes = counts[: 2 * CELLS].sum(), counts[2 * CELLS :].sum()
    odds = lambda prior: case_odds(kind_of, F.col("boundary"), prior, cut, whole, float((yes + 1) / (no + yes + 1)))
    # each source's own rate off its limits, drawn to the common one where it has few texts
    share = rate * cut / (rate * cut + (1 - rate) * whole)
    expected = F.sum(F.element_at(F.create_map(*(F.lit(x) for k, x in zip(CLASSES, share.tolist(), strict=True) for x in (k, x))), kind_of))
    own = placed.where("posterior = 0 and ending is not null").groupBy(F.col("source").alias("r_source")).agg(((expected + ASSUMED * rate) / (F.count("*") + ASSUMED)).alias("own"))
    placed = placed.join(own, F.col("source").eqNullSafe(F.col("r_source")), "left").withColumn("rate", F.coalesce("own", F.lit(rate))).drop("own", "r_source")
    p = F.when(F.col("posterior") > 0, F.least(F.greatest(F.col("posterior"), F.lit(0.001)), F.lit(0.999))).otherwise(F.col("rate"))
    judged = placed.withColumns({"odds": odds(p), "without": odds(F.col("rate"))})
    is_cut = F.coalesce(F.col("odds") > 0, F.lit(False))
    return judged.withColumns({"is_cut": is_cut, "by_length": is_cut != F.coalesce(F.col("without") > 0, F.lit(False))}).drop("without", "rate")


def rates(scored: DataFrame) -> DataFrame:
    """(source, n_texts, n_cut, share) of each source."""
    return scored.groupBy("source").agg(F.count("*").alias("n_texts"), F.count_if("is_cut").alias("n_cut")).withColumn("share", F.round(F.col("n_cut") / F.col("n_texts"), 6))
