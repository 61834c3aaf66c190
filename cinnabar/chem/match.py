"""Subgraph search: which atoms of a target a query can lie on.

Backtracking over the query's atoms, each next to one already placed where there is one, the rarest element first. An atom
goes on one of its element (or list, or on any), of the same aromaticity unless it is an end of the query, with the
query's hydrogens; a bond on one of its kind. The match need not be induced. Mode ``auto`` is for symmetries: an atom goes
on one of equal invariant, whatever the kinds of the bonds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

from . import graph as g

_BONDS = {
    g.SINGLE: {g.SINGLE},
    g.DOUBLE: {g.DOUBLE},
    g.TRIPLE: {g.TRIPLE},
    g.AROMATIC: {g.AROMATIC},
    g.SINGLE_DOUBLE: {g.SINGLE, g.DOUBLE},
    g.SINGLE_AROMATIC: {g.SINGLE, g.AROMATIC},
    g.DOUBLE_AROMATIC: {g.DOUBLE, g.AROMATIC},
    g.ANY: {g.SINGLE, g.DOUBLE, g.TRIPLE, g.AROMATIC},
}


def _folded(m: g.Mol) -> tuple[list[int], list[int]]:
    """Heavy atoms, and by atom the hydrogens drawn at it that are plain ones."""
    drawn = [0] * len(m)
    heavy = []
    for i, z in enumerate(m.z):
        if z == 1 and not m.isotope[i] and not m.charge[i] and not m.choices[i] and len(m.near[i]) == 1 and m.z[next(iter(m.near[i]))] != 1:
            drawn[next(iter(m.near[i]))] += 1
        else:
            heavy.append(i)
    return heavy, drawn


def invariants(m: g.Mol) -> list[int]:
    """A number for each atom, equal for atoms that a symmetry can exchange: its own features, then those of its neighbours, over and over."""
    own = [hash((m.z[i], m.charge[i] + 16, m.isotope[i], len(m.near[i]))) for i in range(len(m))]
    kinds = 0
    while len(set(own)) > kinds:
        kinds = len(set(own))
        own = [hash((own[i], tuple(sorted(own[j] for j in m.near[i])))) for i in range(len(m))]
    return own


class Query:
    """A query prepared for many targets. ``mode``: sub, exact (all atoms and bonds of the target) or auto (symmetries)."""

    def __init__(self, m: g.Mol, mode: str = "sub"):
        self.m, self.mode = m, mode
        self.heavy, self.drawn = _folded(m)
        keep = set(self.heavy)
        self.near = {i: [j for j in m.near[i] if j in keep] for i in self.heavy}
        count = Counter(m.z[i] for i in self.heavy)
        self.need = Counter(m.z[i] for i in self.heavy if m.z[i] and not m.choices[i])
        left, order = set(self.heavy), []
        rank = lambda i: (not m.z[i], m.z[i] == 6, count[m.z[i]], -len(self.near[i]), i)
        while left:
            edge = [i for i in left if any(j in order for j in self.near[i])]
            order.append(min(edge or left, key=rank))
            left.discard(order[-1])
        self.order = order
        self.back = [[j for j in self.near[i] if j in order[:n]] for n, i in enumerate(order)]
        # atoms that differ in nothing but their names: (the other one, whether it is the later one) for those placed before
        alike: dict[tuple, list[int]] = {}
        for i in order:
            bonds = tuple(sorted((j, m.kind(i, j)) for j in self.near[i]))
            alike.setdefault((m.z[i], m.isotope[i], m.aromatic[i], m.choices[i], self.drawn[i], bonds), []).append(i)
        twins = {i: [j for j in some if j != i] for some in alike.values() for i in some}
        self.twins = [[(j, j > i) for j in twins[i] if j in order[:n]] for n, i in enumerate(order)]
        self.invariants = invariants(m) if mode == "auto" else []
        # kinds of bonds between two elements, one of which a target has before it is made aromatic, if it has the query
        plain = lambda i: m.z[i] and not m.choices[i]
        wanted = [(frozenset((m.z[i], m.z[j])), _BONDS[m.kind(i, j)]) for i in self.near for j in self.near[i] if i < j and plain(i) and plain(j) and m.kind(i, j) in _BONDS] if mode != "auto" else []
        self.wanted = {(pair, None if g.AROMATIC in kinds else frozenset(kinds)) for pair, kinds in wanted}

    def possible(self, t: g.Mol) -> bool:
        """Whether a target that ``prepared`` hasn't seen yet has the query's elements and the bonds between them; False is certain."""
        if not self.need.keys() <= set(t.z):
            return False
        for pair, kinds in self.wanted:
            a, b = min(pair), max(pair)
            if not any((t.z[x] == a and t.z[y] == b or t.z[x] == b and t.z[y] == a) and (kinds is None or k in kinds) for x, y, k in t.bonds):
                return False
        return True

    def find(self, t: g.Mol, once: bool = False) -> Iterator[list[int | None]]:
        """Places of the query's atoms in the target, one after the other; None for a hydrogen drawn at an atom.

        With ``once`` atoms that are alike (the fluorines of a CF3) are placed in one order only, not in all.
        """
        m, exact, auto = self.m, self.mode == "exact", self.mode == "auto"
        heavy, drawn = _folded(t)
        if len(heavy) < len(self.heavy) or exact and len(heavy) != len(self.heavy):
            return
        have = Counter(t.z[i] for i in heavy)
        if any(have[z] < n for z, n in self.need.items()):
            return
        total = [(t.h[i] or 0) + drawn[i] for i in range(len(t))]
        keep = set(heavy)
        same = invariants(t) if auto else []
        at: dict[int, int] = {}
        used: set[int] = set()

        def fits(q: int, x: int) -> bool:
            if auto:
                return self.invariants[q] == same[x] and all(at[j] in t.near[x] for j in self.near[q] if j in at)
            if m.choices[q]:
                some, negated = m.choices[q]
                if (t.z[x] in some) == negated:
                    return False
            elif m.z[q] and (m.z[q] != t.z[x] or m.isotope[q] and m.isotope[q] != t.isotope[x]):
                return False
            degree = len(self.near[q])
            other = sum(j in keep for j in t.near[x])
            if degree > other or exact and degree != other or self.drawn[q] > total[x]:
                return False
            if m.z[q] and degree > 1 and not m.choices[q] and m.aromatic[q] != t.aromatic[x]:
                return False
            for j in self.near[q]:
                if j in at:
                    k = t.near[x].get(at[j])
                    if k is None or t.bonds[k][2] not in _BONDS[m.kind(q, j)]:
                        return False
            return True

        def options(n: int) -> list[int]:
            back = self.back[n]
            pool = [x for x in t.near[at[back[0]]] if x in keep] if back else heavy
            if once:
                pool = [x for x in pool if all((x < at[j]) == later for j, later in self.twins[n])]
            return [x for x in pool if x not in used and fits(self.order[n], x)]

        stack = [iter(options(0))] if self.order else []
        while stack:
            n = len(stack) - 1
            q = self.order[n]
            if q in at:
                used.discard(at.pop(q))
            x = next(stack[-1], None)
            if x is None:
                stack.pop()
                continue
            at[q] = x
            used.add(x)
            if n + 1 == len(self.order):
                if not exact or len(t.bonds) - sum(drawn) == len(m.bonds) - sum(self.drawn):
                    yield [at.get(i) for i in range(len(m))]
            else:
                stack.append(iter(options(n + 1)))

    def first(self, t: g.Mol) -> list[int | None] | None:
        return next(self.find(t), None)

    def matches(self, t: g.Mol) -> bool:
        return self.first(t) is not None

    def all(self, t: g.Mol, unique: bool = True, visit: Callable[[list], bool] | None = None) -> list[list[int | None]]:
        """All places, or with ``unique`` one for each set of target atoms. ``visit`` may return False to end the search."""
        out, seen = [], set()
        for hit in self.find(t, once=unique):
            key = frozenset(x for x in hit if x is not None)
            if unique and key in seen:
                continue
            seen.add(key)
            out.append(hit)
            if visit is not None and visit(hit) is False:
                break
        return out


def prepared(m: g.Mol) -> g.Mol:
    g.aromatize(m)
    return m
