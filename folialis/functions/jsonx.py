"""Tolerant JSON: what a language model answers is often wrapped, cut or of another type than asked for."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def first_object(s: str | None) -> str:
    """The first balanced {...} of a text, braces in strings aside; '' if there is none."""
    start = s.find("{") if s else -1
    if start < 0:
        return ""
    depth, quoted, skip = 0, False, False
    for i in range(start, len(s)):
        c = s[i]
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return s[start : i + 1]
    return ""


def repaired(s: str | None) -> str:
    """A cut object ended after its last whole member; '' if it is whole already or has no whole member.

    The members are decoded one by one from the front, so the first that does not decode marks the cut.
    """
    start = s.find("{") if s else -1
    if start < 0 or first_object(s):
        return ""
    decode = json.JSONDecoder(strict=False).raw_decode
    members, at = [], start + 1
    blank = " \t\r\n"
    while True:
        while at < len(s) and s[at] in blank:
            at += 1
        try:
            _, key_end = decode(s, at)
            colon = key_end + len(s[key_end:]) - len(s[key_end:].lstrip(blank))
            if s[at] != '"' or s[colon : colon + 1] != ":":
                break
            value = colon + 1 + len(s[colon + 1 :]) - len(s[colon + 1 :].lstrip(blank))
            _, end = decode(s, value)
        except (ValueError, IndexError):
            break
        members.append(s[at:end].strip())
        rest = end + len(s[end:]) - len(s[end:].lstrip(blank))
        if s[rest : rest + 1] != ",":
            break
        at = rest + 1
    return "{" + ", ".join(members) + "}" if members else ""


def as_text(v) -> str:
    """A JSON value as text: strings trimmed, numbers as written, lists joined by ', ' without blanks, true as 'true', else ''."""
    if isinstance(v, str):
        return v.strip()
    if v is True:
        return "true"
    if isinstance(v, list):
        return ", ".join(t for t in map(as_text, v) if t)
    return ""


class _Number(str):
    """A number as it is written."""


def flexible(s: str | None) -> str:
    try:
        return as_text(json.loads(s, parse_int=_Number, parse_float=_Number)) if s else ""
    except ValueError:
        return ""


def record(s: str | None, keys: tuple[str, ...]) -> dict[str, str]:
    """The members of the first object of a text, repaired if it is cut, as texts; '' for what is missing."""
    body = first_object(s) or repaired(s)
    try:
        got = json.loads(body, parse_int=_Number, parse_float=_Number, strict=False) if body else {}
    except ValueError:
        got = {}
    return {k: as_text(got.get(k)) for k in keys}


def _udf(f):
    def run(x: pd.Series) -> pd.Series:
        return x.map(f, na_action=None)

    return F.pandas_udf(run, "string")


def extract_object(x: Column) -> Column:
    return _udf(lambda s: first_object(s if isinstance(s, str) else None))(x)


def repair_object(x: Column) -> Column:
    return _udf(lambda s: repaired(s if isinstance(s, str) else None))(x)


def flex_string(x: Column) -> Column:
    return _udf(lambda s: flexible(s if isinstance(s, str) else None))(x)


#: The fields that are asked of a language model about a document.
META_KEYS = ("title", "authors", "year", "venue", "doi", "keywords", "summary", "category")


def decode_meta(x: Column) -> Column:
    """map<field, text> of an answer."""

    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda s: record(s if isinstance(s, str) else None, META_KEYS), na_action=None)

    return F.pandas_udf(run, "map<string,string>")(x)
