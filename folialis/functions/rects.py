"""Rectangles of annotations: array<struct<p, x, y, w, h>> with coordinates relative to the page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE = "array<struct<p:int,x:double,y:double,w:double,h:double>>"
#: How far a rectangle may leave the page, and how near two of one line are.
BEYOND, LEVEL, GAP = 1.001, 0.004, 0.01
COLOURS, KINDS = ("yellow", "green", "blue", "pink"), ("highlight", "note")


def from_json(x: Column) -> Column:
    """Rectangles from their JSON; bad JSON and null give none."""
    return F.coalesce(F.from_json(x, TYPE), F.array().cast(TYPE))


def valid(rects: Column) -> Column:
    """At least one, and each on a page, with a size, inside the page."""
    ok = F.forall(rects, lambda r: (r["p"] >= 1) & (r["w"] > 0) & (r["h"] > 0) & (r["x"] >= 0) & (r["y"] >= 0) & (r["x"] + r["w"] <= BEYOND) & (r["y"] + r["h"] <= BEYOND))
    return F.coalesce((F.size(rects) > 0) & ok, F.lit(False))


def merge(rects: Column) -> Column:
    """Rectangles of one line joined: by page, then by y and x, each compared with the head of the run before it."""
    ordered = F.array_sort(F.transform(rects, lambda r: F.struct(r["p"].alias("p"), r["y"].alias("y"), r["x"].alias("x"), r["w"].alias("w"), r["h"].alias("h"))))

    def step(done: Column, r: Column) -> Column:
        head = F.element_at(done, -1)
        joins = (head["p"] == r["p"]) & (F.abs(head["y"] - r["y"]) < LEVEL) & (F.abs(head["h"] - r["h"]) < LEVEL) & (r["x"] <= head["x"] + head["w"] + GAP)
        left = F.least(head["x"], r["x"])
        right = F.greatest(head["x"] + head["w"], r["x"] + r["w"])
        joined = F.struct(head["p"].alias("p"), head["y"].alias("y"), left.alias("x"), (right - left).alias("w"), head["h"].alias("h"))
        return F.when((F.size(done) > 0) & joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(r)))

    none = F.array().cast("array<struct<p:int,y:double,x:double,w:double,h:double>>")
    # the head is looked at only where there is one
    def guarded(done: Column, r: Column) -> Column:
        return F.when(F.size(done) == 0, F.array(r)).otherwise(step(done, r))

    runs = F.aggregate(ordered, none, guarded)
    return F.transform(runs, lambda r: F.struct(r["p"].alias("p"), r["x"].alias("x"), r["y"].alias("y"), r["w"].alias("w"), r["h"].alias("h")))


def colour(x: Column) -> Column:
    """One of the four colours, else yellow."""
    return F.when(x.isin(*COLOURS), x).otherwise(COLOURS[0])


def kind(x: Column) -> Column:
    return F.when(x.isin(*KINDS), x).otherwise(KINDS[0])
