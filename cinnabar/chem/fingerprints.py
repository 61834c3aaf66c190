"""512-bit fingerprints of a molecule: circular and linear-path, as 8 signed 64-bit words."""

from __future__ import annotations

from zlib import crc32

from . import graph as g

BITS = 512
PATH_BONDS = 7


def java_hash(s: str) -> int:
    h = 0
    for c in s:
        h = (31 * h + ord(c)) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


def _position(v: int, bits: int) -> int:
    return abs(v) % bits


def words(on: set[int], bits: int = BITS) -> list[int]:
    out = [0] * (bits // 64)
    for i in on:
        out[i // 64] |= 1 << i % 64
    return [w - (1 << 64) if w >> 63 else w for w in out]


def circular(m: g.Mol, depth: int = 3, per_string: int = 1, whole: bool = True, bits: int = BITS, legacy_shift: bool = False) -> list[int]:
    """Each atom's element, then ring after ring of neighbours by element and hydrogens, hashed; and one bit for the whole.

    An atom that two atoms of a ring lead to is written twice. ``legacy_shift`` sets bits as a 32-bit shift would: position
    i % 32 of the word, and from 31 on all bits where that is the sign.
    """
    at: list[int] = []
    label = [f"{m.symbol(i)}{m.h[i] or 0}" for i in range(len(m))]

    def add(text: str) -> None:
        at.extend(_position(java_hash(f"{text}?{i}"), bits) for i in range(per_string))

    for atom in range(len(m)):
        text, row, seen = m.symbol(atom), [atom], set()
        add(text)
        for _ in range(depth):
            seen.update(row)
            row = [j for i in row for j in m.near[i] if j not in seen]
            if not row:
                break
            row.sort(key=lambda i: label[i])
            text += "(" + "".join(label[i] for i in row) + ")"
            add(text)
    if whole:
        at.append(_position(sum(at), bits))
    if not legacy_shift:
        return words(set(at), bits)
    out = [0] * (bits // 64)
    for i in at:
        out[i // 64] |= 1 << i % 32 if i % 32 < 31 else ((1 << 64) - (1 << 31))
    return [w - (1 << 64) if w >> 63 else w for w in out]


_MARK = {g.SINGLE: "-", g.DOUBLE: "=", g.TRIPLE: "#", g.AROMATIC: ":"}


def paths(m: g.Mol, longest: int = PATH_BONDS, bits: int = BITS) -> list[int]:
    """Linear paths of heavy atoms by element and bond, read from their smaller end.

    Whatever matches a query has all of the query's paths: wildcards, atom lists, hydrogens and bonds that stand for
    several kinds are in no path, and neither flags nor hydrogen counts are part of it.
    """
    on: set[int] = set()
    fixed = [z > 1 and not m.choices[i] for i, z in enumerate(m.z)]
    seen: set[str] = set()

    name = [f"[{m.symbol(i)}]" for i in range(len(m))]
    steps = [[(j, mark) for j, k in m.near[i].items() if fixed[j] and (mark := _MARK.get(m.bonds[k][2]))] for i in range(len(m))]

    def walk(i: int, text: str, back: str, visited: tuple[int, ...]) -> None:
        seen.add(text if text < back else back)
        if len(visited) > longest:
            return
        for j, mark in steps[i]:
            if j not in visited:
                walk(j, text + mark + name[j], name[j] + mark + back, (*visited, j))

    for i in range(len(m)):
        if fixed[i]:
            walk(i, name[i], name[i], (i,))
    for text in seen:
        on.add(crc32(text.encode()) % bits)
    return words(on, bits)


def union(*fingerprints: list[int]) -> list[int]:
    """Bits that any of the members sets."""
    out = [0] * max(map(len, fingerprints))
    for f in fingerprints:
        for i, w in enumerate(f):
            out[i] |= w
    return out


def folded(positions: set[int], factor: int = 101, bits: int = BITS) -> list[int]:
    """Bit i at factor * i modulo the length."""
    return words({i * factor % bits for i in positions}, bits)


def similarity_fingerprint(m: g.Mol) -> list[int]:
    return union(circular(m), paths(m))
