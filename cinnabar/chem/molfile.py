"""MOL V2000 blocks and SD files, in and out."""

from __future__ import annotations

from . import graph as g
from . import smiles

_QUERY = {"A": g.ANY_ATOM, "*": g.ANY_ATOM, "Q": g.ANY_ATOM, "L": g.ANY_ATOM, "R": g.ANY_ATOM, "R#": g.ANY_ATOM}
#: codes of the charge column (fixed values)
_CHARGE = {1: 3, 2: 2, 3: 1, 5: -1, 6: -2, 7: -3}
MOST_ATOMS = 999


def _int(text: str) -> int:
    return int(text) if text.strip() else 0


def parse(text: str) -> g.Mol:
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    if len(lines) < 5 or "V2000" not in lines[3]:
        raise g.BadStructure("no V2000 block")
    m = g.Mol(name=lines[0].strip())
    try:
        atoms, bonds = _int(lines[3][:3]), _int(lines[3][3:6])
        told: dict[str, tuple[int, int | None]] = {}  # charge and hydrogens by their columns
        for x in lines[4 : 4 + atoms]:
            s = x[31:34].strip()
            if s in _QUERY:
                m.add_atom(_QUERY[s], h=0)
            elif s in ("D", "T"):
                m.add_atom(1, isotope=2 if s == "D" else 3, h=0)
            elif s in g.NUMBER:
                columns = x[36:45]
                if columns not in told:
                    drawn = _int(x[42:45])  # one more than the hydrogens, where their number doesn't follow from the bonds
                    told[columns] = _CHARGE.get(_int(x[36:39]), 0), drawn - 1 if drawn else None
                m.add_atom(g.NUMBER[s], told[columns][0], h=told[columns][1])
            else:
                raise g.BadStructure(f"no element {s}")
        for x in lines[4 + atoms : 4 + atoms + bonds]:
            m.add_bond(_int(x[:3]) - 1, _int(x[3:6]) - 1, _int(x[6:9]))
        charged = False
        for n, x in enumerate(lines[4 + atoms + bonds :]):
            if x.startswith("M  END"):
                _properties(m, lines[4 + atoms + bonds + n + 1 :])
                break
            part = x.split()
            if x.startswith("M  CHG"):
                if not charged:
                    m.charge[:] = [0] * len(m)
                    charged = True
                for i, q in zip(part[3::2], part[4::2]):
                    m.charge[int(i) - 1] = int(q)
            elif x.startswith("M  ISO"):
                for i, q in zip(part[3::2], part[4::2]):
                    m.isotope[int(i) - 1] = int(q)
            elif x.startswith("M  ALS"):
                m.choices[_int(x[7:10]) - 1] = (frozenset(g.NUMBER[s] for s in x[16:].split()), x[14:15] == "T")
    except (IndexError, ValueError, KeyError) as e:
        raise g.BadStructure(str(e)) from e
    for a, b, kind in m.bonds:
        if kind == g.AROMATIC:
            m.aromatic[a] = m.aromatic[b] = True
    g.fill_hydrogens(m)
    return m


def _properties(m: g.Mol, lines: list[str]) -> None:
    name = None
    for x in lines:
        if x.startswith(">"):
            name = x[x.find("<") + 1 : x.rfind(">")] if "<" in x else None
        elif x.startswith("$$$$"):
            return
        elif name is not None:
            if x.strip():
                m.props[name] = f"{m.props[name]}\n{x}" if name in m.props else x
            else:
                name = None


def read(text: str) -> g.Mol:
    """A structure in either notation."""
    if text is None or not text.strip():
        raise g.BadStructure("empty")
    return parse(text) if "\n" in text.strip("\n") else smiles.parse(text)


def write(m: g.Mol, kekule: bool = True) -> str:
    """A block with hydrogens left implicit; structures of more than 999 atoms have none."""
    if len(m) > MOST_ATOMS:
        raise g.BadStructure("too many atoms for V2000")
    kinds = g.kekulized(m) if kekule else [k for _, _, k in m.bonds]
    out = [m.name, "  cinnabar", "", f"{len(m):3d}{len(m.bonds):3d}  0  0  0  0  0  0  0  0999 V2000"]
    usual = g.Mol(z=m.z, charge=m.charge, aromatic=[not kekule and a for a in m.aromatic], h=[None] * len(m), choices=m.choices, bonds=[(a, b, k) for (a, b, _), k in zip(m.bonds, kinds)], near=m.near)
    g.fill_hydrogens(usual)
    for i in range(len(m)):
        symbol = "L" if m.choices[i] else "A" if not m.z[i] else m.symbol(i)
        # hydrogens that don't follow from the bonds are counted, one more than there are
        told = (m.h[i] or 0) != usual.h[i] or not kekule and m.z[i] != 6 and m.h[i] and any(kinds[k] == g.AROMATIC for k in m.near[i].values())
        out.append(f"{1.5 * (i % 8):10.4f}{1.3 * (i // 8):10.4f}{0:10.4f} {symbol:<3s} 0  0  0{(m.h[i] or 0) + 1 if told else 0:3d}  0  0  0  0  0  0  0  0")
    out += [f"{a + 1:3d}{b + 1:3d}{k:3d}  0" for (a, b, _), k in zip(m.bonds, kinds)]
    for tag, values in (("CHG", m.charge), ("ISO", m.isotope)):
        some = [(i + 1, v) for i, v in enumerate(values) if v]
        for s in range(0, len(some), 8):
            out.append(f"M  {tag}{len(some[s : s + 8]):3d}" + "".join(f"{i:4d}{v:4d}" for i, v in some[s : s + 8]))
    for i, c in enumerate(m.choices):
        if c:
            out.append(f"M  ALS {i + 1:3d}{len(c[0]):3d} {'T' if c[1] else 'F'} " + "".join(f"{g.SYMBOLS[z - 1]:<4s}" for z in sorted(c[0])))
    return "\n".join([*out, "M  END"])


def write_sd(m: g.Mol, kekule: bool = True) -> str:
    return write(m, kekule) + "\n" + "".join(f">  <{k}>\n{v}\n\n" for k, v in m.props.items()) + "$$$$\n"
