"""One surviving record of each group of duplicates, field by field.

Method. The fields are unpivoted to long rows (group, field, row, value). A value's vote is the sum over the group's rows
that hold it, however written, of trust times a decay with age; trust is 1 where updated_at is credible and 0 where not. The winner of a
field is chosen by max_by, and the fields are pivoted back. By default the latest credible row wins and the votes
decide between rows of one time, then the smaller id; with ``by_votes`` the value with most votes wins, from its latest row.

Scale. Everything is a partial aggregate by (group, field, value), then by group: a group of any size is never collected.

Edge cases. No usable value, or none in a row with a credible time: null. Null created_at sets no lower bound. Repeated rows count as often as they come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is written in place of a venue or a DOI that is not known.
FILLERS = (
    "", "none", "null", "nil", "na", "nan", "unknown", "notgiven", "notavailable", "notapplicable", "notknown", "unspecified", "undefined", "missing", "tba", "tbd", "tbc", "tobeassigned", "tobeannounced", "tobedetermined",
    "pending", "venue", "journal", "doi", "todo", "xxx", "xxxx", "xxxxx", "xxxxxx", "unbekannt", "ka", "inconnu", "sansobjet", "待定", "未知", "暂无", "无", "不详",
)


def _plain(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))


def usable_doi(c: Column) -> Column:
    """The bare DOI in lower case, null if there is no prefix and suffix or they only stand in for one."""
    s = F.regexp_replace(c, r"[​-‏﻿­]", "")
    s = F.regexp_replace(F.lower(F.regexp_replace(s, "(?i)%2f", "/")), r"\s*/\s*", "/")
    found = F.regexp_extract(s, r"(10\.[0-9][0-9.]*)\s*/\s*([^\s<>\"'\[\]{}|?&#]+)", 0)
    bare = F.regexp_replace(F.regexp_replace(found, r"\s+", ""), r"[.,;:!)\]>]+$", "")
    prefix, suffix = F.regexp_extract(bare, r"^([^/]+)/", 1), F.regexp_extract(bare, r"^[^/]+/(.*)$", 1)
    stand_in = _plain(suffix).isin(*FILLERS) | suffix.rlike(r"^[0x?*._-]*$") | prefix.rlike(r"^10\.0*$") | suffix.rlike(r"to[._-]?be[._-]?(assigned|announced|determined)")
    return F.when((bare != "") & ~stand_in, bare)


def usable_venue(c: Column) -> Column:
    """The venue folded of case and marks, null if it is blank or a filler."""
    p = _plain(c)
    return F.when(c.isNotNull() & ~p.isin(*FILLERS), p)


def credible(updated: Column, created: Column, copied: str) -> Column:
    """Whether a time of change is neither null, nor before the row was made, nor after the library was copied."""
    return updated.isNotNull() & (created.isNull() | (updated >= created)) & (updated <= F.lit(copied).cast("timestamp_ntz"))


def choose(rows: DataFrame, group: str, id: str, values: dict[str, Column], updated: Column, trust: Column, by_votes: bool = False, half_life_days: float = 365.0, now: str = "2025-06-30 00:00:00") -> DataFrame:
    """(group, <field>_from for each field of values): the row from which each field is taken; values give the normalised value, null if unusable."""
    stack = F.array(*(F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in values.items()))
    long = rows.select(F.col(group).alias("g"), F.col(id).alias("i"), updated.alias("at"), trust.alias("trusted"), F.explode(stack).alias("x"))
    age = F.datediff(F.lit(now).cast("date"), F.col("at")) / F.lit(half_life_days)
    vote = F.when(F.col("trusted"), F.pow(F.lit(0.5), age)).otherwise(0.0)
    # the latest trusted row of each value, and the value's votes
    when = F.when(F.col("trusted"), F.struct(F.col("at"), (-F.col("i")).alias("first")))
    per_value = (
        long.where("x.value is not null").groupBy("g", "x.field", "x.value")
        .agg(F.sum(vote).alias("votes"), F.max(when).alias("last"))
        .where("last is not null")
    )
    order = F.struct("votes", "last.at", "last.first") if by_votes else F.struct("last.at", "votes", "last.first")
    won = per_value.groupBy("g", "field").agg((-F.max_by("last.first", order)).alias("row"))
    picked = won.groupBy("g").agg(*(F.max(F.when(F.col("field") == k, F.col("row"))).alias(f"{k}_from") for k in values))
    return rows.select(F.col(group).alias("g")).distinct().join(picked, "g", "left").withColumnRenamed("g", group)


#: Rows of one DOI that are tied to its smallest id in one task.
HOT = 100_000


def doi_edges(rows: DataFrame) -> DataFrame:
    """(a, b): every row of (id, doi) tied to the smallest id with the same DOI. A DOI of more than HOT rows is spread over as many tasks as it needs."""
    known = rows.where("doi is not null")
    first = known.groupBy("doi").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / HOT).cast("int"))
    # at most one DOI for HOT rows
    hot = F.broadcast(first.where("parts > 1").select("doi", "parts"))
    left = known.join(hot, "doi", "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1)))).drop("parts")
    right = first.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("doi", "part", "a")
    return left.join(right, ["doi", "part"]).where("id <> a").select("a", F.col("id").alias("b"))
