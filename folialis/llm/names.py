"""Linking names written by people to a register.

Method: a pigeonhole segment join. A name gives one or more keys (family and given name, family and initial, the whole name, its letters; folded of case, blanks and
marks). Names without an equal key are joined by segments: each key of the register is cut into K + 1 segments, and as
K slips cannot touch all of them, a key within K slips holds one segment unchanged, moved by at most K places. The
segments, with the key's length and their number, are the inverted index; a name looks up its substrings at the places
where such a segment may stand. Candidates are verified by a banded edit distance that counts two swapped neighbours as one slip.

Short forms. Words may be shortened to a beginning, to a skeleton with the same first and last letter, or several words to their initials; names of equal letters are compared
word by word for that. Short forms of given names are learned: a written given name stands for a registered one if the families under which it is met, and of which the register has one
person only, are mostly those of that given name (LEAST_FAMILIES, SHARE). What a small table cannot teach is taken from a list of common English, German and French short forms.

Scale. Only distinct names are linked, and papers are joined to the links of their names, so a venue that a tenth of the
rows share is looked up once; the rows of a name that more than HOT rows hold are spread over as many tasks as they need. A name has a bounded number of keys and substrings, by its length; nothing is compared with
the whole register. The register is a table like any other: the planner broadcasts it if its size allows.

A name is linked to the entry with the fewest slips, and to none if two entries are as near. Null, empty and blank names link to nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folialis.operators.multivalue import PARTICLES
from folialis.sources.storage import written

#: Slips (one character inserted, left out or replaced, or two swapped) within which keys are alike.
K = 2
#: Keys shorter than this must be equal, and those shorter than TWICE may have one slip.
SHORT, TWICE = 6, 12

#: Families of one registered person under which a short form of a given name must be met, and the share of them that must have the same given name.
LEAST_FAMILIES, SHARE = 3, 0.5
#: Rows of one name up to which they are joined to its link in one task.
HOT = 1_000_000

# Common short forms of given names, from general knowledge of names and not from any table; they hold where there is too little to learn from.
COMMON = {
    "albert": "al bert", "alexander": "alex al sandy sasha", "alexandra": "alex sandra sasha", "alfred": "alf fred", "andreas": "andi", "andrew": "andy drew", "anthony": "tony", "antonia": "toni", "barbara": "babs", "benjamin": "ben benny", "bernard": "bernie", "caroline": "caro carrie", "catherine": "cathy kate katie", "charles": "charlie chuck",
    "charlotte": "lotte lottie", "christian": "chris", "christina": "chris tina", "christopher": "chris kit", "cynthia": "cindy", "daniel": "dan danny", "david": "dave", "deborah": "deb debbie", "donald": "don", "dorothy": "dot dolly", "eberhard": "hardy", "edward": "ed eddie ned ted", "eleanor": "ellie nell", "elisabeth": "lisa lisbeth sissi", "elizabeth": "liz beth betty eliza lisa",
    "emily": "em", "eugene": "gene", "frances": "fran", "francis": "frank", "franziska": "franzi", "frederick": "fred freddie", "friedrich": "fritz", "gabriel": "gabe", "gabriele": "gabi", "gerald": "gerry jerry", "gregory": "greg", "hannelore": "lore", "harold": "hal harry", "heinrich": "heinz", "helene": "lena", "henry": "hank harry", "hubert": "bert", "isabella": "bella izzy",
    "jacob": "jake", "james": "jim jimmy jamie", "jeffrey": "jeff", "jennifer": "jen jenny", "jessica": "jess", "johannes": "hannes hans", "john": "jack johnny", "jonathan": "jon", "josef": "sepp", "joseph": "joe joey", "joshua": "josh", "judith": "judy", "katharina": "kathi kati", "katherine": "kate kathy katie", "kenneth": "ken", "lawrence": "larry", "leonard": "len lenny leo", "louis": "lou",
    "margaret": "maggie meg peggy marge", "margarete": "grete gretel", "martin": "marty", "matthew": "matt", "matthias": "matze", "maximilian": "max", "michael": "mike mick micha", "nathaniel": "nate nat", "nicholas": "nick", "nicolas": "nico", "nikolaus": "klaus niko", "pamela": "pam", "patricia": "pat patty tricia", "patrick": "pat paddy", "peter": "pete", "philip": "phil", "rachel": "rae",
    "raymond": "ray", "rebecca": "becky", "richard": "rick rich dick", "robert": "bob bobby rob", "ronald": "ron", "rudolf": "rudi", "samantha": "sam", "samuel": "sam", "sarah": "sally", "sebastian": "basti seb", "stefan": "steff", "stephen": "steve", "steven": "steve", "susan": "sue susie", "susanne": "susi", "theodore": "ted theo", "theresa": "terry tess", "thomas": "tom tommy", "timothy": "tim",
    "ulrich": "uli ulli", "ulrike": "ulli uli", "veronika": "vroni", "victor": "vic", "victoria": "vicky", "vincent": "vince", "virginia": "ginny", "walter": "walt", "wilhelm": "willi", "william": "bill billy will", "zachary": "zach",
}
LINKING = frozenset("of on in for the and & a an de la le des du für fur der die das proc proceedings".split())

_OF_COMMON: dict[str, list[str]] = {}
for _full, _short in COMMON.items():
    for _s in _short.split():
        _OF_COMMON.setdefault(_s, []).append(_full)
#: (kind of key, key, initials after the first)
Key = tuple[str, str, str]

_FOLD = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i", "æ": "ae", "œ": "oe", "'": "", "’": "", "‘": "", "ʼ": "", "`": "", "´": ""})
_MARKS = re.compile(r"[\s*†‡§¶#^⁎∗\d¹²³⁰-₟]+$")
_INITIALS = re.compile(r"^(?:[^\W\d_]\.-?)+$|^[A-ZÀ-ÖØ-Þ]{1,3}$")
_HAN = re.compile(r"[㐀-鿿]")


@lru_cache(200_000)
def fold(s: str) -> str:
    """Lower case without accents and apostrophes; other marks become blanks."""
    s = unicodedata.normalize("NFKD", s.casefold().translate(_FOLD)).translate(_FOLD)
    return " ".join(re.sub(r"[^\w]|_", " ", "".join(c for c in s if not unicodedata.combining(c))).split())


def _tight(tokens: list[str]) -> str:
    return fold(" ".join(tokens)).replace(" ", "")


def _is_initials(t: str, following: str = "") -> bool:
    if not _INITIALS.match(t):
        return False
    # VAN ORTORLM is a family name, DA Ortorlm has two initials
    return not (t.lower() in PARTICLES and (following.lower() in PARTICLES or len(following) > 3 and following.isupper()))


def _letters(words: list[str], raw: list[str]) -> list[Key]:
    """The letters of a name of several words: one for each word that counts, and all of a word in capitals, which may stand for several words."""
    content = [(w, r) for w, r in zip(words, raw, strict=True) if w not in LINKING]
    text = " ".join(w for w, _ in content)
    plain = "".join(w[0] for w, _ in content)
    spelled = "".join(w if r.isupper() and 2 <= len(w) <= 3 else w[0] for w, r in content)
    return [("letters", k, text) for k in dict.fromkeys((plain, spelled))]


def _whole(name: str) -> tuple[list[str], list[str]]:
    """(folded words, the same words as written)."""
    raw = [t for t in re.split(r"\s+", name) if fold(t)]
    if raw and raw[0].lower() == "the":
        raw = raw[1:]
    # a mark within a word may part it
    pairs = [(w, t) for t in raw for w in fold(t).split()]
    while len(pairs) > 3 and pairs[-1][0] == pairs[-2][0]:
        pairs.pop()
    return [w for w, _ in pairs], [t for _, t in pairs]


def person_keys(name: str, register: bool = False) -> list[Key]:
    """The ways in which a name may be read."""
    name = _MARKS.sub("", name).strip()
    if _HAN.search(name):
        return [("han", "".join(name.split()), "")]
    if not fold(name):
        return []
    keys: list[Key] = []
    words, raw = _whole(name)
    shout = name.isupper()
    if len(words) >= 3 and "," not in name and not any(t.lower() in PARTICLES for t in raw):
        full = [not _INITIALS.match(t) for t in raw]
        # a group: three words and more, of which the last may be initials of several
        if all(full) or not register and full[0] and not shout and (sum(full) >= 3 or sum(full) >= 2 and raw[-1].isalpha() and len(raw[-1]) > 1 and all(full[:-1])):
            keys += [("whole", " ".join(words), ""), *_letters(words, raw)]
    if re.fullmatch(r"(?:[A-Z]\.?){3,8}", name):
        keys.append(("acronym", name.replace(".", "").lower(), ""))
    readings: list[tuple[list[str], list[str]]] = []
    if "," in name:
        family, _, given = name.partition(",")
        g = given.split()
        tail = [t for t in g if t.lower() in PARTICLES]
        readings.append((tail + family.split(), [t for t in g if t not in tail]))
    else:
        t = name.split()
        if t[0].lower() == "the":
            t = t[1:]
        lead = 0
        while lead < len(t) - 1 and _is_initials(t[lead], t[lead + 1]):
            lead += 1
        end = len(t)
        while end > 1 and _is_initials(t[end - 1]):
            end -= 1
        if lead:
            readings.append((t[lead:], t[:lead]))
        elif end < len(t):
            readings.append((t[:end], t[end:]))
            if end >= 2:
                readings.append((t[: end - 1], t[end - 1 :]))
        elif len(t) > 1:
            k = 1
            while k < len(t) - 1 and _is_initials(t[k], t[k + 1]):
                k += 1
            readings.append((t[k:], t[:k]))
            readings.append((t[:-1], t[-1:]))
    for family, given in readings:
        f = _tight(family)
        if not f or not given or not (first := fold(given[0]).replace(" ", "")):
            continue
        letters = "".join(fold(x).replace(" ", "") for x in given if _is_initials(x))
        if _is_initials(given[0]):
            keys.append(("initial", f"{letters[0]} {f}", letters[1:2]))
            letters = letters[1:]
        # three capitals among capitals may be a given name as well
        if not _is_initials(given[0]) or shout and len(first) == 3 and first in _OF_COMMON:
            keys.extend(("person", f"{f} {g}", letters[:1]) for g in (first, *_OF_COMMON.get(first, ())))
    return list(dict.fromkeys(keys))


def venue_keys(name: str) -> list[Key]:
    s = re.sub(r"(?:\s*[(\[][^()\[\]]*[a-z][^()\[\]]*[)\]])+\s*$", " ", name.strip(), flags=re.I)
    s = re.sub(r"[,;]?\s*\b(?:vol(?:ume)?|no|nr|bd|issue|pp?)\b\.?\s*\d.*$", " ", s, flags=re.I)
    s = re.sub(r"\s+\d+\s*\(\d+\)\s*$", " ", s)
    s = re.sub(r"[\s,]*(?:\(?(?:19|20)\d\d\)?|['’]\d\d)\s*$", " ", s)
    s = re.sub(r"^\s*(?:proc(?:eedings)?\.?)\s+(?:of\s+)?(?:the\s+)?(?:\d+(?:st|nd|rd|th)\s+)?", " ", s, flags=re.I)
    s = re.sub(r"^\s*(?:the\s+)?\d+(?:st|nd|rd|th)\s+", " ", s, flags=re.I).strip()
    if m := re.match(r"^(.*),\s*([^,]*\b(?:of|on))\s*$", s):
        s = f"{m[2]} {m[1]}"
    words, raw = _whole(s)
    if not words:
        return []
    if re.fullmatch(r"[A-Z]{2,6}", s):
        return [("acronym", s.lower(), "")]
    if all(w in LINKING for w in words):
        return []
    return [("venue", " ".join(words), ""), *_letters(words, [""] * len(words) if s.isupper() else raw)]


def keys_of(kind: str, name: str, register: bool) -> list[Key]:
    """The keys of a name; of an entry of the register also those by which shorter spellings find it."""
    keys = person_keys(name, register) if kind == "author" else venue_keys(name)
    if not register:
        return keys
    # an entry is spelled in full, so the first of its readings as a person is the right one
    person = [k for k in keys if k[0] in ("person", "initial")][:1]
    out = [k for k in keys if k[0] not in ("person", "initial")] + person
    for what, key, more in list(out):
        if what == "person":
            f, _, g = key.rpartition(" ")
            out.append(("initial", f"{g[0]} {f}", more))
        elif what == "letters":
            out.append(("acronym", key, ""))
    return out


def slips(a: str, b: str, most: int) -> int:
    """The edit distance with swaps of neighbours, in a band of ``most`` beside the diagonal; most + 1 if it is more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    before, row = None, [j if j <= most else far for j in range(len(b) + 1)]
    for i in range(1, len(a) + 1):
        new = [far] * (len(b) + 1)
        if i <= most:
            new[0] = i
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            c = min(row[j - 1] + (a[i - 1] != b[j - 1]), row[j] + 1, new[j - 1] + 1)
            if before and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                c = min(c, before[j - 2] + 1)
            new[j] = min(c, far)
        before, row = row, new
    return row[-1]


def shortens(x: str, y: str) -> bool:
    """Whether x is a beginning of y, or a skeleton of it with the same first letter and, if it has over three letters, the same last one."""
    if y.startswith(x):
        return True
    if len(x) < 2 or x[0] != y[0] or len(x) > 3 and x[-1] != y[-1]:
        return False
    rest = iter(y)
    return all(c in rest for c in x)


def shortened(words: str, full: str) -> int | None:
    """Whether words abbreviate full in order, each a word or, by its letters, two or three; the number of words with a slip (at most one), None if they don't."""
    a, b = words.split(), full.split()
    # places in full that the words so far lead to, with the slips
    at = {0: 0}
    for x in a:
        new: dict[int, int] = {}
        for j, n in at.items():
            if j < len(b):
                y = b[j]
                wrong = 0 if shortens(x, y) else 1 if len(x) > 4 and slips(x, y, 1) <= 1 or len(x) >= 3 and slips(x, y[: len(x)], 1) <= 1 else 2
                if n + wrong <= 1:
                    new[j + 1] = min(new.get(j + 1, 2), n + wrong)
            if len(x) in (2, 3) and x == "".join(y[0] for y in b[j : j + len(x)]):
                new[j + len(x)] = min(new.get(j + len(x), 2), n)
        at = new
    return at.get(len(b))


def allowed(key: str) -> int:
    """The slips that a key of this length may have."""
    return 0 if len(key) < SHORT else 1 if len(key) < TWICE else K


def distance(what: str, key: str, more: str, entry: str, entry_more: str) -> int:
    """The slips between a key and one of the register; K + 1 for too many."""
    if what == "letters":
        d = shortened(more, entry_more)
        return K + 1 if d is None else d
    # an initial must be right, and second initials must not contradict each other
    if what == "initial" and key[0] != entry[0] or what in ("person", "initial") and more and entry_more and more != entry_more:
        return K + 1
    if key == entry:
        return 0
    k = min(allowed(key), allowed(entry))
    d = slips(key, entry, k)
    if d > k:
        return K + 1
    if d > 1 and len(words := key.split()) == len(others := entry.split()):
        # two slips lie in two words
        return d if all(slips(x, y, 1) <= 1 for x, y in zip(words, others, strict=True)) else K + 1
    return d


def _segments(n: int) -> list[tuple[int, int]]:
    """(start, length) of the segments of a key of n characters: two for each slip, as a swap may touch two, and one more."""
    k = 2 * (1 if n < TWICE else K) + 1
    size, extra = divmod(n, k)
    out, at = [], 0
    for i in range(k):
        m = size + (i < extra)
        out.append((at, m))
        at += m
    return out


def index_segments(key: str) -> list[str]:
    """The segments of a key of the register, each with the key's length and its number."""
    return [f"{len(key)}:{i}:{key[s : s + m]}" for i, (s, m) in enumerate(_segments(len(key)))]


def probe_segments(key: str) -> list[str]:
    """The substrings of a key that may stand unchanged in a key of the register."""
    out, k = set(), allowed(key)
    for n in range(max(SHORT, len(key) - k), len(key) + k + 1):
        grown = len(key) - n
        for i, (s, m) in enumerate(_segments(n)):
            # what is inserted before the segment, less what is left out, at most k slips in all
            for shift in range(-((k - grown) // 2), (k + grown) // 2 + 1):
                if 0 <= s + shift <= len(key) - m:
                    out.add(f"{n}:{i}:{key[s + shift : s + shift + m]}")
    return list(out)


#: Keys that may have slips.
FUZZY = ("person", "initial", "whole", "venue")


def _with_keys(names: DataFrame, id: str, register: bool) -> DataFrame:
    """(kind, id, name, what, key, more) for each key of each name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for kind, i, name in zip(*(b.column(j).to_pylist() for j in range(3)), strict=True):
                for what, key, more in keys_of(kind, name, register):
                    for c, x in zip(cols, (kind, i, name, what, key, more), strict=True):
                        c.append(x)
            types = [pa.string(), b.schema.field(1).type, *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["kind", id, "name", "what", "key", "more"])

    t = names.schema[id].dataType.simpleString()
    return names.select("kind", id, "name").mapInArrow(run, f"kind string, {id} {t}, name string, what string, key string, more string")


def _probes(key: pd.Series) -> pd.Series:
    return key.map(probe_segments)


def _indexes(key: pd.Series) -> pd.Series:
    return key.map(index_segments)


def short_forms(keyed: DataFrame, entries: DataFrame) -> DataFrame:
    """(short, given): written given names that stand for a registered one, told by the families under which they are met.

    keyed: (what, key), entries: (e_what, e_key). Only families of which the register has one given name tell anything.
    """
    split = lambda c, a, b: (F.substring_index(c, " ", 1).alias(a), F.substring_index(c, " ", -1).alias(b))
    own = entries.where("e_what = 'person'").select(*split("e_key", "family", "given")).distinct()
    telling = own.groupBy("family").agg(F.min("given").alias("given"), F.count("*").alias("n")).where("n = 1").drop("n")
    met = keyed.where("what = 'person'").select(*split("key", "family", "short")).distinct().join(own.select(F.col("given").alias("short")).distinct(), "short", "left_anti")
    pairs = met.join(telling, "family").groupBy("short", "given").agg(F.count("*").alias("n"))
    all_of = pairs.groupBy("short").agg(F.sum("n").alias("total"))
    return pairs.join(all_of, "short").where((F.col("n") >= LEAST_FAMILIES) & (F.col("n") > SHARE * F.col("total"))).select("short", "given")


def _distances(what: pd.Series, key: pd.Series, more: pd.Series, entry: pd.Series, entry_more: pd.Series) -> pd.Series:
    return pd.Series([distance(*x) for x in zip(what, key, more, entry, entry_more, strict=True)], dtype="int32")


def _distance() -> Column:
    return F.pandas_udf(_distances, "int")("what", "key", "more", "e_key", "e_more")


def link(names: DataFrame, register: DataFrame) -> DataFrame:
    """(kind, name, ref_id, full_name): the entry of the register that each distinct name means.

    names: (kind, name), register: (kind, ref_id, full_name).
    """
    distinct = names.where(F.trim("name") != "").select("kind", "name").distinct()
    # reading names is dear and the distinct ones are few bytes, so they are spread whatever their size
    tasks = max(names.sparkSession.sparkContext.defaultParallelism, int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = written(_with_keys(distinct.repartition(tasks).withColumn("n", F.lit(0)), "n", False), "name-keys")
    entries = written(_with_keys(register.select("kind", "ref_id", F.col("full_name").alias("name")), "ref_id", True), "register-keys").select(
        "kind", "ref_id", F.col("name").alias("full_name"), F.col("what").alias("e_what"), F.col("key").alias("e_key"), F.col("more").alias("e_more")
    )
    forms = written(short_forms(keyed, entries), "short-forms")
    family, given = F.substring_index("key", " ", 1), F.substring_index("key", " ", -1)
    meant = keyed.where("what = 'person'").withColumn("short", given).join(forms.withColumnRenamed("given", "meant"), "short").withColumn("key", F.concat(family, F.lit(" "), "meant")).select(*keyed.columns)
    keyed = keyed.union(meant)
    # an acronym that two entries have means neither
    entries = entries.withColumn("alike", F.count("*").over(Window.partitionBy("kind", "e_what", "e_key"))).where("e_what <> 'acronym' or alike = 1").drop("alike")
    same = keyed.join(entries, (keyed.kind == entries.kind) & (F.col("what") == F.col("e_what")) & (F.col("key") == F.col("e_key")))
    equal = written(_best(same.drop(entries.kind).withColumn("slips", _distance())), "equal")
    fuzzy = lambda what, key: F.col(what).isin(*FUZZY) & (F.length(key) >= SHORT)
    segments = lambda f, key: F.explode(F.pandas_udf(f, "array<string>")(key))
    rest = keyed.where(fuzzy("what", "key")).join(equal, ["kind", "name"], "left_anti")
    probe = rest.select("kind", "name", "what", "key", "more", segments(_probes, "key").alias("segment"))
    index = entries.where(fuzzy("e_what", "e_key")).select(F.col("kind").alias("e_kind"), "ref_id", "full_name", "e_what", "e_key", "e_more", segments(_indexes, "e_key").alias("e_segment"))
    near = (
        probe.join(index, (F.col("kind") == F.col("e_kind")) & (F.col("what") == F.col("e_what")) & (F.col("segment") == F.col("e_segment")))
        .drop("segment", "e_segment", "e_kind")
        # a swap counts twice here, so this only spares the exact measure
        .where(F.levenshtein("key", "e_key", 2 * K) >= 0)
        .dropDuplicates(["kind", "name", "ref_id", "key", "e_key"])
    )
    return equal.unionByName(_best(near.withColumn("slips", _distance())))


def _best(candidates: DataFrame) -> DataFrame:
    """The one entry with the fewest slips of each name, if there is one."""
    per = candidates.where(F.col("slips") <= K).groupBy("kind", "name", "ref_id", "full_name").agg(F.min("slips").alias("slips"))
    # few candidates for a name: the entries within K slips of it
    ranked = per.groupBy("kind", "name").agg(F.min(F.struct("slips", "ref_id", "full_name")).alias("best"), F.collect_list("slips").alias("all"))
    return ranked.where(F.size(F.filter("all", lambda x: x == F.col("best.slips"))) == 1).select("kind", "name", "best.ref_id", "best.full_name")


def link_papers(items: DataFrame, register: DataFrame) -> DataFrame:
    """(paper_id, kind, ref_id): entries that a paper names in another spelling than full_name. items: (paper_id, kind, name)."""
    linked = written(link(items, register).where("name <> full_name"), "linked")
    # at most one name for HOT rows, so this table is small at any size
    hot = written(items.groupBy("kind", "name").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("kind", "name", F.ceil(F.col("n") / HOT).cast("int").alias("parts")), "hot")
    if hot.isEmpty():
        return items.join(linked, ["kind", "name"]).select("paper_id", "kind", "ref_id").distinct()
    parts = F.coalesce("parts", F.lit(1))
    left = items.join(F.broadcast(hot), ["kind", "name"], "left").withColumn("part", F.pmod(F.xxhash64("paper_id"), parts))
    right = linked.join(F.broadcast(hot), ["kind", "name"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return left.drop("parts").join(right.drop("parts"), ["kind", "name", "part"]).select("paper_id", "kind", "ref_id").distinct()
