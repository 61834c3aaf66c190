"""SMILES in and out, with the query marks ``*``, ``~`` and ``[#n]``. Stereo marks are read over."""

from __future__ import annotations

import re

from . import graph as g
from .elements import NUMBER, SYMBOLS

_TOKEN = re.compile(r"(\[[^\]]*\]|Br|Cl|[BCNOPSFI*bcnops]|%[0-9]{2}|[0-9]|[-=#$:/\\~]|[().])")
_ELEMENT = "|".join(sorted(SYMBOLS, key=len, reverse=True))
_BRACKET = re.compile(rf"\[(?P<iso>[0-9]*)(?:(?P<el>{_ELEMENT}|as|se|[bcnops])|\#(?P<num>[0-9]+)|(?P<any>\*|A))(?:@+(?:[A-Z]{{2}}[0-9]+)?)?(?P<h>H[0-9]*)?(?P<q>[+-]+[0-9]*)?(?::[0-9]+)?\]")
_KIND = {"-": g.SINGLE, "=": g.DOUBLE, "#": g.TRIPLE, ":": g.AROMATIC, "~": g.ANY, "/": g.SINGLE, "\\": g.SINGLE}
_ORGANIC = {**{s: (NUMBER[s], False) for s in ("B", "C", "N", "O", "P", "S", "F", "Cl", "Br", "I")}, **{s: (NUMBER[s.upper()], True) for s in "bcnops"}, "*": (g.ANY_ATOM, False)}
_PLAIN = {"B", "C", "N", "O", "P", "S", "F", "Cl", "Br", "I"}


def _atom(m: g.Mol, t: str) -> int:
    if t in _ORGANIC:
        z, low = _ORGANIC[t]
        return m.add_atom(z, aromatic=low, h=None if z else 0)
    b = _BRACKET.fullmatch(t)
    if not b:
        raise g.BadStructure(f"bad atom {t}")
    el = b["el"]
    z = int(b["num"]) if b["num"] else NUMBER[el.capitalize() if el.islower() else el] if el else g.ANY_ATOM
    sign = b["q"] or ""
    charge = (1 if sign[0] == "+" else -1) * (int(sign.strip("+-")) if sign.strip("+-") else len(sign)) if sign else 0
    h = int(b["h"][1:] or 1) if b["h"] else None if b["num"] else 0
    return m.add_atom(z, charge, int(b["iso"] or 0), bool(el and el.islower()), h)


def parse(text: str) -> g.Mol:
    body, _, name = text.strip().partition(" ")
    m = g.Mol(name=name.strip())
    stack: list[int] = []
    last, kind = -1, None
    open_: dict[str, tuple[int, str | None]] = {}

    def join(a: int, b: int, mark: str | None) -> None:
        if mark is None:
            k = g.AROMATIC if m.aromatic[a] and m.aromatic[b] else g.SINGLE
        else:
            k = _KIND[mark]
        m.add_bond(a, b, k)

    tokens = _TOKEN.findall(body)
    if "".join(tokens) != body:
        tokens, at = [], 0
        while t := _TOKEN.match(body, at):
            tokens.append(t.group())
            at = t.end()
        tokens.append("")
    for t in tokens:
        if t in _ORGANIC or t[:1] == "[":
            i = _atom(m, t)
            if last >= 0:
                join(last, i, kind)
            last, kind = i, None
        elif t == "(":
            stack.append(last)
        elif t == ")":
            if not stack:
                raise g.BadStructure("a parenthesis closes nothing")
            last = stack.pop()
        elif t == ".":
            last, kind = -1, None
        elif t in _KIND:
            kind = t
        elif t[:1] == "%" or t.isdigit():
            n = t.lstrip("%").lstrip("0") or "0"
            if last < 0:
                raise g.BadStructure("a ring number without an atom")
            if n in open_:
                other, mark = open_.pop(n)
                join(other, last, mark or kind)
            else:
                open_[n] = (last, kind)
            kind = None
        else:
            raise g.BadStructure(f"bad atom {t}" if t else f"bad character at {at}")
    if open_ or stack or not m.z:
        raise g.BadStructure("unfinished")
    # a bond drawn between two rings' aromatic atoms is single unless it is in a ring
    shared = [k for k, x in enumerate(m.bonds) if x[2] == g.AROMATIC]
    ringed = g.ring_bonds(m) if shared else ()
    for k in shared:
        if k not in ringed:
            m.bonds[k] = (*m.bonds[k][:2], g.SINGLE)
    g.fill_hydrogens(m)
    return m


def write(m: g.Mol, kekule: bool = True) -> str:
    kinds = g.kekulized(m) if kekule else [k for _, _, k in m.bonds]
    aromatic = [not kekule and a or any(kinds[k] == g.AROMATIC for k in m.near[i].values()) for i, a in enumerate(m.aromatic)]
    marks = {g.SINGLE: "", g.DOUBLE: "=", g.TRIPLE: "#", g.AROMATIC: "", g.ANY: "~"}
    seen: set[int] = set()
    closing: dict[tuple[int, int], int] = {}
    out = []

    def plain(i: int) -> str:
        s = m.symbol(i)
        if s == "*":
            return s
        probe = g.Mol()
        simple = s in _PLAIN and not m.charge[i] and not m.isotope[i]
        if simple:
            order = sum({g.DOUBLE: 2, g.TRIPLE: 3}.get(kinds[k], 1) for k in m.near[i].values())
            probe.add_atom(m.z[i], aromatic=False)
            usual = g._VALENCES[m.z[i]]
            want = next((v - order for v in (usual[:1] if aromatic[i] else usual) if v >= order), 0) if not aromatic[i] else max(0, usual[0] - order - 1)
            simple = want == (m.h[i] or 0)
        t = s.lower() if aromatic[i] else s
        if simple:
            return t
        h = m.h[i] or 0
        q = m.charge[i]
        return f"[{m.isotope[i] or ''}{t}{'H' + (str(h) if h > 1 else '') if h else ''}{('+' if q > 0 else '-') + (str(abs(q)) if abs(q) > 1 else '') if q else ''}]"

    for root in range(len(m)):
        if root in seen:
            continue
        # depth first, without recursion: which bonds close rings
        order: list[tuple[int, int]] = []
        children: dict[int, list[int]] = {}
        rings: dict[int, list[int]] = {}
        todo = [(root, -1)]
        while todo:
            i, p = todo.pop()
            if i in seen:
                continue
            seen.add(i)
            order.append((i, p))
            if p >= 0:
                children.setdefault(p, []).append(i)
            for j in sorted(m.near[i], reverse=True):
                if j not in seen:
                    todo.append((j, i))
        place = {i: n for n, (i, _) in enumerate(order)}
        parent = dict(order)
        for i, _ in order:
            for j in m.near[i]:
                if parent.get(i) != j and parent.get(j) != i and place[j] < place[i]:
                    rings.setdefault(j, []).append(i)
                    rings.setdefault(i, []).append(j)
        free = list(range(99, 0, -1))

        def emit() -> str:
            text: list[str] = []
            stack: list = [root]
            while stack:
                x = stack.pop()
                if isinstance(x, str):
                    text.append(x)
                    continue
                p = parent[x]
                if p >= 0:
                    k = kinds[m.near[p][x]]
                    text.append("-" if k == g.SINGLE and aromatic[p] and aromatic[x] else marks.get(k, "~"))
                text.append(plain(x))
                for j in sorted(rings.get(x, ()), key=place.get):
                    key = (min(x, j), max(x, j))
                    if key in closing:
                        n = closing.pop(key)
                        free.append(n)
                        mark = ""
                    else:
                        n = closing[key] = free.pop()
                        k = kinds[m.near[x][j]]
                        mark = "-" if k == g.SINGLE and aromatic[x] and aromatic[j] else marks.get(k, "~")
                    text.append(mark + (str(n) if n < 10 else f"%{n}"))
                for n, c in enumerate(reversed(children.get(x, []))):
                    stack += [c] if n == 0 else [")", c, "("]
            return "".join(text)

        out.append(emit())
    return ".".join(out)
