"""Molecular graphs: plain Python, no Spark."""

from __future__ import annotations

from dataclasses import dataclass, field

from .elements import NUMBER, SYMBOLS, WEIGHTS

SINGLE, DOUBLE, TRIPLE, AROMATIC, SINGLE_DOUBLE, SINGLE_AROMATIC, DOUBLE_AROMATIC, ANY = range(1, 9)
ANY_ATOM = 0


class BadStructure(ValueError):
    pass


@dataclass
class Mol:
    """``z`` 0 is any atom; ``choices`` holds an atom list where the atom is one of several elements."""

    name: str = ""
    z: list[int] = field(default_factory=list)
    charge: list[int] = field(default_factory=list)
    isotope: list[int] = field(default_factory=list)
    aromatic: list[bool] = field(default_factory=list)
    h: list[int | None] = field(default_factory=list)  #: hydrogens that are no atoms; None: as valence wants
    choices: list[tuple[frozenset[int], bool] | None] = field(default_factory=list)
    bonds: list[tuple[int, int, int]] = field(default_factory=list)
    near: list[dict[int, int]] = field(default_factory=list)  #: neighbour -> place in bonds
    props: dict[str, str] = field(default_factory=dict)

    def add_atom(self, z: int, charge: int = 0, isotope: int = 0, aromatic: bool = False, h: int | None = None, choices=None) -> int:
        self.z.append(z)
        self.charge.append(charge)
        self.isotope.append(isotope)
        self.aromatic.append(aromatic)
        self.h.append(h)
        self.choices.append(choices)
        self.near.append({})
        return len(self.z) - 1

    def add_bond(self, a: int, b: int, kind: int) -> None:
        if a == b or a < 0 or b < 0 or b in self.near[a]:
            raise BadStructure("a bond joins two atoms, once")
        self.near[a][b] = self.near[b][a] = len(self.bonds)
        self.bonds.append((a, b, kind))

    def kind(self, a: int, b: int) -> int:
        return self.bonds[self.near[a][b]][2]

    def symbol(self, i: int) -> str:
        return SYMBOLS[self.z[i] - 1] if self.z[i] else "*"

    def __len__(self) -> int:
        return len(self.z)


#: usual valences (fixed values)
_VALENCES = {5: (3,), 6: (4,), 7: (3, 5), 8: (2,), 9: (1,), 14: (4,), 15: (3, 5), 16: (2, 4, 6), 17: (1,), 33: (3, 5), 34: (2, 4, 6), 35: (1,), 53: (1, 3, 5)}


def fill_hydrogens(m: Mol) -> None:
    """Gives every atom without a stated number of hydrogens as many as its valence leaves."""
    for i, z in enumerate(m.z):
        if m.h[i] is not None:
            continue
        if z not in _VALENCES or m.choices[i]:
            m.h[i] = 0
            continue
        used, shared = 0, 0
        for j in m.near[i]:
            k = m.kind(i, j)
            used += {SINGLE: 1, DOUBLE: 2, TRIPLE: 3}.get(k, 1)
            shared += k == AROMATIC
        if shared or m.aromatic[i]:
            used += 1
        # a charge moves an atom to the valence of its neighbour in the table: N+ binds like C, O- like F
        shift = m.charge[i] if z in (7, 8, 15, 16, 33, 34) else -abs(m.charge[i]) if z != 5 else -m.charge[i]
        most = [v + shift for v in _VALENCES[z]]
        if shared or m.aromatic[i]:
            most = most[:1]
        m.h[i] = next((v - used for v in most if v >= used), 0)


def explicit(m: Mol) -> tuple[int, int]:
    """(atoms, bonds), hydrogens included."""
    h = sum(x or 0 for x in m.h)
    return len(m) + h, len(m.bonds) + h


def mass(m: Mol) -> float:
    return round(sum(float(m.isotope[i]) if m.isotope[i] else WEIGHTS[z - 1] for i, z in enumerate(m.z) if z) + WEIGHTS[0] * sum(x or 0 for x in m.h), 3)


def formula(m: Mol) -> str:
    """Hill order: carbon, hydrogen, then by symbol; without carbon all by symbol. A charge is no part of it."""
    count: dict[str, int] = {}
    for i, z in enumerate(m.z):
        if z:
            count[m.symbol(i)] = count.get(m.symbol(i), 0) + 1
    if h := sum(x or 0 for x in m.h):
        count["H"] = count.get("H", 0) + h
    first = ["C", "H"] if "C" in count else []
    order = [s for s in first if s in count] + sorted(s for s in count if s not in first)
    return "".join(s + (str(count[s]) if count[s] > 1 else "") for s in order)


def ring_bonds(m: Mol) -> set[int]:
    """Places of the bonds that are in a ring: those on the ways that bonds outside a spanning tree close."""
    up, depth, found = [-2] * len(m), [0] * len(m), set()
    for root in range(len(m)):
        if up[root] != -2:
            continue
        up[root] = -1
        row, closing = [root], []
        for x in row:
            for y, k in m.near[x].items():
                if up[y] == -2:
                    up[y], depth[y] = x, depth[x] + 1
                    row.append(y)
                elif x < y and up[x] != y and up[y] != x:
                    closing.append((x, y, k))
        for x, y, k in closing:
            found.add(k)
            while x != y:
                if depth[x] < depth[y]:
                    x, y = y, x
                found.add(m.near[x][up[x]])
                x = up[x]
    return found


def triangles(m: Mol) -> list[tuple[int, int, int]]:
    """Rings of three atoms, in ascending order: bonds ab, bc and ac."""
    pairs = [(a, b) if a < b else (b, a) for a, b, _ in m.bonds]
    return [(a, b, c) for a, b in pairs if not m.near[a].keys().isdisjoint(m.near[b]) for c in m.near[b] if c > b and c in m.near[a]]


def rings(m: Mol) -> list[list[int]]:
    """A smallest ring through each bond that is in one, without repeats."""
    found: dict[frozenset[int], list[int]] = {}
    # no way round leaves the bonds that are in rings, and in a ring that shares no atom every bond has that ring
    inner = ring_bonds(m)
    near = [[y for y, k in x.items() if k in inner] for x in m.near] if inner else []
    alone: set[int] = set()
    for place in sorted(inner):
        a, b, _ = m.bonds[place]
        if a in alone:
            continue
        before = {a: -1}
        row = [a]
        while row and b not in before:
            nxt = []
            for x in row:
                for y in near[x]:
                    if y not in before and not (x == a and y == b):
                        before[y] = x
                        nxt.append(y)
            row = nxt
        if b in before:
            ring = [b]
            while ring[-1] != a:
                ring.append(before[ring[-1]])
            found.setdefault(frozenset(ring), ring)
            if all(len(near[x]) == 2 for x in ring):
                alone.update(ring)
    return list(found.values())


def aromatize(m: Mol) -> None:
    """Marks rings of 4n + 2 shared electrons, single or fused in pairs, on top of what the input marks."""
    small = [r for r in rings(m) if 5 <= len(r) <= 8]
    if not small:
        return
    cyclic = {frozenset((r[i], r[i - 1])) for r in small for i in range(len(r))}

    def electrons(i: int) -> int | None:
        double = [j for j in m.near[i] if m.kind(i, j) == DOUBLE]
        if any(m.kind(i, j) == TRIPLE or m.kind(i, j) > AROMATIC and frozenset((i, j)) in cyclic for j in m.near[i]) and not m.aromatic[i]:
            return None
        if any(frozenset((i, j)) in cyclic for j in double):
            return 1
        if double:
            return 0 if m.z[i] in (6, 16) and all(m.z[j] in (7, 8, 16) for j in double) else None
        if m.aromatic[i]:
            degree = len(m.near[i]) + (m.h[i] or 0)
            return 2 if m.z[i] in (8, 16, 34) or m.z[i] in (7, 15) and degree > 2 and m.charge[i] <= 0 else 1
        if m.z[i] in (7, 15) and m.charge[i] <= 0 or m.z[i] in (8, 16, 34) and m.charge[i] == 0 and len(m.near[i]) == 2:
            return 2
        if m.z[i] == 6 and m.charge[i] == -1:
            return 2
        return 0 if m.z[i] == 5 or m.z[i] == 6 and m.charge[i] == 1 else None

    has: dict[int, int | None] = {}

    def counted(i: int) -> bool:
        if i not in has:
            has[i] = electrons(i)
        return has[i] is not None

    fused = []
    able = [r for r in small if all(counted(i) for i in r)]
    for x in range(len(able)):
        for y in range(x):
            if len(set(able[x]) & set(able[y])) == 2:
                fused.append((able[x], able[y]))
    marked = [[r] for r in able if sum(has[i] for i in r) % 4 == 2]
    marked += [list(p) for p in fused if sum(has[i] for i in set(p[0]) | set(p[1])) % 4 == 2]
    for group in marked:
        for r in group:
            for i in range(len(r)):
                a, b = r[i], r[i - 1]
                m.aromatic[a] = True
                k = m.near[a][b]
                m.bonds[k] = (*m.bonds[k][:2], AROMATIC)


def kekulized(m: Mol) -> list[int]:
    """Bond kinds with single and double bonds in place of aromatic ones; aromatic where that can't be done."""
    kinds = [k for _, _, k in m.bonds]
    need = set()
    for i in range(len(m)):
        shared = [j for j in m.near[i] if m.kind(i, j) == AROMATIC]
        if not shared:
            continue
        if any(m.kind(i, j) == DOUBLE for j in m.near[i]):
            continue
        degree = len(m.near[i]) + (m.h[i] or 0)
        z, q = m.z[i], m.charge[i]
        if z in (8, 16, 34) and q == 0 and degree == 2 or z in (7, 15) and q <= 0 and degree == 3 or z == 6 and q == -1 and degree == 3 or z == 5:
            continue
        need.add(i)
    mate: dict[int, int] = {}

    def grow(i: int, seen: set[int]) -> bool:
        for j in m.near[i]:
            if j in need and j not in seen and m.kind(i, j) == AROMATIC:
                seen.add(j)
                if j not in mate or grow(mate[j], seen | {i}):
                    mate[i], mate[j] = j, i
                    return True
        return False

    for i in sorted(need):
        if i not in mate:
            grow(i, {i})
    if any(mate.get(mate.get(i, -1), -1) != i for i in need):
        return kinds
    for k, (a, b, kind) in enumerate(m.bonds):
        if kind == AROMATIC:
            kinds[k] = DOUBLE if mate.get(a) == b else SINGLE
    return kinds


__all__ = ["ANY", "ANY_ATOM", "AROMATIC", "BadStructure", "Mol", "NUMBER", "aromatize", "explicit", "fill_hydrogens", "formula", "kekulized", "mass", "ring_bonds", "rings", "triangles"]
