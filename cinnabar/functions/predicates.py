"""Field predicates: terms, ranges with open and closed ends, and the command line's filter language."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textquery

_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
_WHOLE = r"^[+-]?[0-9]+$"
_RANGE = re.compile(r"(-?[0-9]*\.?[0-9]*):(-?[0-9]*\.?[0-9]*)")
KINDS = {"int": (_WHOLE, "int"), "long": (_WHOLE, "bigint"), "double": (_NUMBER, "double")}


def typed(text: Column, kind: str) -> Column:
    """A text value under one numeric type, null where it isn't written as such: a value is whatever types it reads as."""
    pattern, cast = KINDS[kind]
    return F.when(text.rlike(pattern), text.try_cast(cast))


def numeric(df: DataFrame, name: str, kind: str) -> Column:
    """A stored column by its name, else a property of ``props``."""
    if name in df.columns:
        have = dict(df.dtypes)[name]
        return typed(F.col(name), kind) if have == "string" else F.col(name)
    return typed(F.get_json_object("props", f"$.{name}") if dict(df.dtypes).get("props") == "string" else F.try_element_at("props", F.lit(name)), kind)


def term(df: DataFrame, name: str, value: str) -> Column:
    """A term as it is indexed: the whole value of a stored field (its name begins with ``_``) or number, one word of an analysed text.

    The value is no text to analyse: capital letters and stop words find nothing in an analysed field.
    """
    if name in df.columns:
        text = F.col(name)
        if name.startswith("_") or dict(df.dtypes)[name] != "string":
            return text.cast("string") == value
    else:
        text = F.try_element_at("props", F.lit(name))
    return F.array_contains(textquery.tokens(text), value)


def between(x: Column, lo: float | None = None, hi: float | None = None, lo_inc: bool = True, hi_inc: bool = True) -> Column:
    """An open side is None. Without either, the value only has to be there."""
    out = x.isNotNull()
    if lo is not None:
        out = out & (x >= lo if lo_inc else x > lo)
    if hi is not None:
        out = out & (x <= hi if hi_inc else x < hi)
    return out


def int_range(df: DataFrame, name: str, lo=None, hi=None, lo_inc: bool = True, hi_inc: bool = True) -> Column:
    return between(numeric(df, name, "int"), lo, hi, lo_inc, hi_inc)


def long_range(df: DataFrame, name: str, lo=None, hi=None, lo_inc: bool = True, hi_inc: bool = True) -> Column:
    return between(numeric(df, name, "long"), lo, hi, lo_inc, hi_inc)


def double_range(df: DataFrame, name: str, lo=None, hi=None, lo_inc: bool = True, hi_inc: bool = True) -> Column:
    return between(numeric(df, name, "double"), lo, hi, lo_inc, hi_inc)


class BadFilter(ValueError):
    pass


def parse_filter(df: DataFrame, name: str, value: str) -> Column:
    """``=v`` equals a number, ``lo:hi`` is a closed range with ends that may be missing, anything else a term.

    Both ends count whatever they are written as; a bound with a point makes the range one of doubles.
    """
    if value.startswith("="):
        try:
            v = float(value[1:]) if "." in value else int(value[1:])
        except ValueError as e:
            raise BadFilter(f"not a number: {value[1:]}") from e
        return between(numeric(df, name, "double" if "." in value else "long"), v, v)
    found = _RANGE.search(value)
    if not found:
        return term(df, name, value)
    kind = "double" if "." in found.group() or not (found[1] or found[2]) else "long"
    ends = []
    for x in found.groups():
        try:
            ends.append(None if x in ("", "-") else float(x) if kind == "double" else int(x))
        except ValueError:
            ends.append(None)
    if None not in ends and ends[0] > ends[1]:
        raise BadFilter(f"the range {value} is empty")
    return between(numeric(df, name, kind), *ends)


def all_of(*filters: Column) -> Column:
    out = F.lit(True)
    for f in filters:
        out = out & f
    return out
