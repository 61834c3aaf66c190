"""Fingerprints as native expressions: ARRAY<BIGINT> words, compared word by word inside generated code.

The builders return SQL text, so that an expression over eight words reaches the planner in one piece; ``column`` makes a
column of it. Higher-order functions would leave generated code, so none is used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = 8
_TOP_BITS = -0x7F7F7F7F7F7F7F80  #: the highest bit of each byte, as a signed word


def column(sql: str) -> Column:
    return F.expr(sql)


def word(name: str, i: int) -> str:
    return f"coalesce(get({name}, {i}), 0L)"


def words_of(name: str, words: int = WORDS) -> list[str]:
    return [word(name, i) for i in range(words)]


def literal(words: list[int]) -> list[str]:
    return [f"cast('{int(w)}' as bigint)" for w in words]


def bits_of(words: list[str]) -> str:
    return "(" + " + ".join(f"bit_count({w})" for w in words) + ")"


def popcount(name: str, words: int = WORDS) -> str:
    """Bits set; null for a null fingerprint."""
    return f"case when {name} is not null then {bits_of(words_of(name, words))} end"


def common(a: list[str], b: list[str]) -> str:
    return bits_of([f"{x} & {y}" for x, y in zip(a, b)])


def either(a: list[str], b: list[str]) -> str:
    return bits_of([f"{x} | {y}" for x, y in zip(a, b)])


def tanimoto(a: list[str], b: list[str], pa: str | None = None, pb: str | None = None) -> str:
    """Common bits over bits of either; null where neither has any. ``pa`` and ``pb``: numbers of bits that are known.

    The bits of either are counted as those of both less the common ones: half the operations, which keeps the generated
    method small enough to be compiled to machine code.
    """
    inter = common(a, b)
    pa, pb = pa or bits_of(a), pb or bits_of(b)
    ratio = f"cast({inter} as double) / ({pa} + {pb} - {inter})"
    return ratio if pb.isdigit() and int(pb) else f"case when {pa} + {pb} > 0 then {ratio} end"


def tanimoto_legacy(a: list[str], b: list[str]) -> str:
    """As arithmetic on sign-extended bytes has it: the highest bit of every byte counts 25 times."""
    top = f"cast('{_TOP_BITS}' as bigint)"
    inter = f"({common(a, b)} + 24 * {bits_of([f'{x} & {y} & {top}' for x, y in zip(a, b)])})"
    union = f"({either(a, b)} + 24 * {bits_of([f'({x} | {y}) & {top}' for x, y in zip(a, b)])})"
    return f"case when {union} > 0 then cast({inter} as double) / {union} end"


def contains(target: list[str], query: list[str]) -> str:
    return "(" + " and ".join(f"({t} & {q}) = {q}" for t, q in zip(target, query)) + ")"


def popcount_window(p: int, threshold: float) -> tuple[int, int | None]:
    """Numbers of bits that a record as similar as ``threshold`` to one of ``p`` bits can have; None: no upper end."""
    if threshold <= 0:
        return 0, None
    return math.ceil(p * threshold - 1e-9), math.floor(p / threshold + 1e-9)


def in_window(popcnt: str, p: int, threshold: float) -> str:
    lo, hi = popcount_window(p, threshold)
    return f"{popcnt} >= {lo}" if hi is None else f"{popcnt} between {lo} and {hi}"


def bit(name: str, i: int) -> str:
    """Bit ``i``, lowest first."""
    return f"bit_get({word(name, i // 64)}, {i % 64})"


def to_hex(name: str, words: int = WORDS) -> str:
    return "concat(" + ", ".join(f"lpad(hex({w}), 16, '0')" for w in words_of(name, words)) + ")"
