"""Whether a text is a well-formed SMILES or MOL V2000 block. Valence is not looked at."""

from __future__ import annotations

import re

from .elements import SYMBOLS

_ELEMENT = "|".join(sorted(SYMBOLS, key=len, reverse=True))
_TOKEN = re.compile(
    rf"(?P<atom>Cl|Br|[BCNOPSFIbcnops]|\[[0-9]*(?:{_ELEMENT}|[bcnops])(?:@@?)?(?:H[0-9]*)?(?:[+-][0-9]*)?\])"
    r"|(?P<bond>[-=#:/\\~])|(?P<ring>[0-9]|%[0-9]{2})|(?P<open>\()|(?P<close>\))|(?P<dot>\.)"
)
_COUNT = re.compile(r" *[0-9]+")
_DECIMAL = re.compile(r" *[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+) *")
_SYMBOLS = frozenset(SYMBOLS)


def is_smiles(text: str) -> bool:
    at, n = 0, len(text)
    rings: set[int] = set()
    depth = 0
    last = "start"
    match = _TOKEN.match
    while at < n:
        m = match(text, at)
        if m is None:
            return False
        at, kind = m.end(), m.lastgroup
        if kind == "atom":
            pass
        elif kind == "ring":
            if last not in ("atom", "ring", "bond", "close") or (last == "bond" and before not in ("atom", "ring", "close")):
                return False
            rings ^= {int(m.group().lstrip("%"))}
        elif kind == "open":
            if last not in ("atom", "ring", "close"):
                return False
            depth += 1
        elif kind == "close":
            if last not in ("atom", "ring", "close") or not depth:
                return False
            depth -= 1
        elif last not in ("atom", "ring", "close", "open"):  # a bond or dot
            return False
        before, last = last, kind
    return last in ("atom", "ring", "close") and not depth and not rings


def _count(field: str) -> int:
    return int(field) if len(field) == 3 and _COUNT.fullmatch(field) else -1


def is_mol_block(text: str) -> bool:
    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    lines = [x[:-1] if x.endswith("\r") else x for x in lines]
    if len(lines) < 5:
        return False
    head = lines[3]
    atoms, bonds = _count(head[:3]), _count(head[3:6])
    if atoms < 0 or bonds < 0 or not head.endswith("V2000") or len(lines) < 4 + atoms + bonds + 1:
        return False
    for x in lines[4 : 4 + atoms]:
        if not all(_DECIMAL.fullmatch(x[i : i + 10]) and len(x[i : i + 10]) == 10 for i in (0, 10, 20)) or x[30:31] != " " or x[31:34].strip(" ") not in _SYMBOLS:
            return False
    for x in lines[4 + atoms : 4 + atoms + bonds]:
        a, b, kind = _count(x[:3]), _count(x[3:6]), _count(x[6:9])
        if not (1 <= a <= atoms and 1 <= b <= atoms and 1 <= kind <= 8):
            return False
    rest = lines[4 + atoms + bonds :]
    return rest[-1] == "M  END" and all(x.startswith("M  ") for x in rest)


def is_structure(text: str) -> bool:
    return is_mol_block(text) if "\n" in text or "\r" in text else is_smiles(text)
