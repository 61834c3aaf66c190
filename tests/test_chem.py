import pytest

from cinnabar.chem import fingerprints as fp
from cinnabar.chem import graph, match, molfile, smiles, validate


def mol(text):
    return match.prepared(molfile.read(text))


def sub(query, target):
    return match.Query(mol(query)).first(mol(target))


def tanimoto(a, b):
    a, b = ([w & (1 << 64) - 1 for w in fp.similarity_fingerprint(mol(x))] for x in (a, b))
    return sum((x & y).bit_count() for x, y in zip(a, b)) / sum((x | y).bit_count() for x, y in zip(a, b))


def block(atoms, bonds, extra=()):
    lines = ["", "  test", "", f"{len(atoms):3d}{len(bonds):3d}  0  0  0  0  0  0  0  0999 V2000"]
    lines += [f"{0:10.4f}{0:10.4f}{0:10.4f} {a:<3s} 0  0  0  0  0  0  0  0  0  0  0  0" for a in atoms]
    lines += [f"{a:3d}{b:3d}{k:3d}  0" for a, b, k in bonds]
    return "\n".join([*lines, *extra, "M  END"])


def test_properties():
    m = mol("c1ccccc1")
    assert (graph.formula(m), graph.explicit(m)) == ("C6H6", (12, 12))
    assert graph.mass(mol("c1nc2ccccc2s1")) == pytest.approx(135.18, abs=0.02)
    assert graph.formula(mol("C[N+](C)(C)C.[Cl-]")) == "C4H12ClN"
    assert graph.formula(mol("OCC(O)CO")) == "C3H8O3"


def test_an_odd_valence_is_read():
    assert graph.formula(mol("N1C=NC2=C1COC1CCCC[C@H]1O=CC=C2")).startswith("C13")


@pytest.mark.parametrize("text", ["", "C(", "C1CC", "C[Xx]", "C==C)", "c1cc", "hello world"])
def test_bad_structures(text):
    with pytest.raises(ValueError):
        molfile.read(text)


@pytest.mark.parametrize("text", ["Cc1cc(Cl)nc2N(C3CC3)c3ncccc3C(=O)Nc12", "[O-][N+](=O)c1ccccc1", "O=c1cc[nH]cc1", "c1ccc2ccccc2c1", "CC(=O)Nc1ccc(cc1O)C(O)=O", "[13CH4]", "C[Se]C"])
def test_round_trips(text):
    m = mol(text)
    for again in (smiles.write(m), smiles.write(m, kekule=False), molfile.write(m), molfile.write(m, kekule=False)):
        n = mol(again)
        assert graph.formula(n) == graph.formula(m)
        assert match.Query(m, "exact").matches(n)


def test_kekule_output():
    assert smiles.write(mol("COc1ccccc1")) == "COC1=CC=CC=C1"


def test_sd_properties():
    m = mol("CO")
    m.props = {"logp": "1.5", "note": "two\nlines"}
    assert molfile.read(molfile.write_sd(m)).props == m.props


def test_kekule_query_finds_aromatic_target():
    assert sub("C1=CC=CC=C1", "COc1ccccc1") and sub("c1ccccc1", "COC1=CC=CC=C1")
    assert sub("CC1=CC2=C(SC=N2)C=C1", "CCC1=CC2=C(SC=N2)C=C1")
    assert not sub("C1=CC=CC=C1", "CCCC")


def test_linked_rings():
    assert sub("c1cccn1-c2ccc[nH]2", "c1cccn1-c2ccc[nH]2")
    assert tanimoto("c1cccn1-c2ccc[nH]2", "c1cccn1-c2ccc[nH]2") == 1


def test_drawn_hydrogens():
    q = "C(=CC=C1[H])(C(=C1C(=C2)[H])C(=C2)[H])[H]"
    assert sub(q, "C1=CC2=CC=CC=C2C=C1") and not sub(q, "CC1=C2C=CC=CC2=CC=C1")


def test_any_bond_and_any_atom():
    one, two = "COC1=CC=C(O)C2=C(O)C(C)=C3OC(C)(O)C(=O)C3=C12", "CC1=C2OC(C)(O)C(=O)C2=C3C4=C(C=C(O)C3=C1O)N5C=CC=CC5=N4"
    rest = r"~C1=c2c3c(OC([#6])(O)C3=O)cc(O)c2=C(O)\C=C/1"
    assert [bool(sub("O" + rest, t)) for t in (one, two)] == [True, False]
    assert [bool(sub("*" + rest, t)) for t in (one, two)] == [True, True]
    assert sub("C*", "CC") and sub("C*", "CO") and not sub("C*", "C")


def test_query_marks_of_mol_blocks():
    any_ = block(["C", "A"], [(1, 2, 8)])
    assert sub(any_, "CC") and sub(any_, "C=O")
    double_or_aromatic = block(["C", "C"], [(1, 2, 7)])
    assert sub(double_or_aromatic, "c1ccccc1") and sub(double_or_aromatic, "C=CC=C") and not sub(double_or_aromatic, "CCCCC")
    aromatic = block(["C", "C"], [(1, 2, 4)])
    assert sub(aromatic, "C1PONC2NOPC(C12)C3=CC=CC=C3") and not sub(aromatic, "C=CC1PONC2NOPCC12")
    some = block(["C", "L"], [(1, 2, 1)], ["M  ALS   2  2 F F   Cl  "])
    assert sub(some, "CF") and sub(some, "CCl") and not sub(some, "CO")
    none = block(["C", "L"], [(1, 2, 1)], ["M  ALS   2  2 T F   Cl  "])
    assert sub(none, "CO") and not sub(none, "CF")


def test_all_matches_are_unique_by_their_atoms():
    q = match.Query(mol("c1ccccc1"))
    assert len(q.all(mol("c1ccccc1"))) == 1 and len(q.all(mol("c1ccccc1"), unique=False)) == 12
    seen = []
    match.Query(mol("C")).all(mol("CCC"), visit=lambda h: seen.append(h) or False)
    assert len(seen) == 1


def test_exact_and_auto_modes():
    assert match.Query(mol("CCO"), "exact").matches(mol("OCC")) and not match.Query(mol("CC"), "exact").matches(mol("CCO"))
    assert match.Query(mol("C=C"), "auto").matches(mol("CC"))


def test_similar_molecules():
    q = "O=C1NC2=C(NC3=NC=CC=C13)N=CC=C2"
    corpus = ["c1ccccc1", "c1ccncc1", "OC1CCCC[C@H]1O", "CC(=O)Nc1ccc(cc1O)C(O)=O", "c1ncncc1", "Cc1cc(Cl)nc2N(C3CC3)c3ncccc3C(=O)Nc12"]
    assert [tanimoto(q, x) > 0.55 for x in corpus] == [False] * 5 + [True]
    assert 0.1 < tanimoto("C1=CC=C2C=NC=CC2=C1", "C3=CC=C4N=CC=CC4=C3") < 1
    assert 0.9 <= tanimoto("C" * 19 + "O" + "C" * 18, "C" * 12 + "O" + "C" * 24) < 1


def test_screen_loses_nothing():
    import random

    rng = random.Random(5)
    for text in ["Cc1cc(Cl)nc2N(C3CC3)c3ncccc3C(=O)Nc12", "CC(=O)Nc1ccc(cc1O)C(O)=O", "O=C1NC2=C(NC3=NC=CC=C13)N=CC=C2"]:
        m = mol(text)
        whole = fp.paths(m)
        for _ in range(30):
            keep = [rng.randrange(len(m))]
            while len(keep) < rng.randint(2, 9):
                more = [j for i in keep for j in m.near[i] if j not in keep]
                if not more:
                    break
                keep.append(rng.choice(more))
            q = graph.Mol()
            for i in keep:
                q.add_atom(m.z[i], m.charge[i], m.isotope[i], m.aromatic[i], 0)
            for a, b, k in m.bonds:
                if a in keep and b in keep:
                    q.add_bond(keep.index(a), keep.index(b), k)
            assert match.Query(q).matches(m)
            assert all((w & v) == v for w, v in zip(whole, fp.paths(q)))


def test_circular_fingerprint():
    assert fp.java_hash("hello") == 99162322 and fp.java_hash("C(C3)?0") == fp.java_hash("C(C3)?0")
    long, longer = mol("C" * 37), mol("C" * 38)
    assert fp.circular(long, whole=False) == fp.circular(longer, whole=False) and fp.circular(long) != fp.circular(longer)
    assert fp.circular(long) != fp.circular(long, legacy_shift=True)
    assert len(fp.folded(set(range(512)))) == 8 and all(w == -1 for w in fp.folded(set(range(512))))


def test_bonds_in_rings_are_those_that_cutting_leaves_joined():
    for text in ("C1CC1", "CCC", "C1CC2CC1CC2CC1CC1", "c1ccc2ccccc2c1CCc1ccccc1", "C12C3C4C1C5C2C3C45", "C1CC1.C1CCC1.C", "C1CC12CC2"):
        m = smiles.parse(text)

        def joined(a, b, without):
            seen, row = {a}, [a]
            for x in row:
                new = [y for y, k in m.near[x].items() if k != without and y not in seen]
                seen.update(new)
                row += new
            return b in seen

        inner = {k for k, (a, b, _) in enumerate(m.bonds) if joined(a, b, k)}
        assert graph.ring_bonds(m) == inner
        assert {m.near[r[i]][r[i - 1]] for r in graph.rings(m) for i in range(len(r))} == inner
        assert sorted(graph.triangles(m)) == sorted(tuple(sorted(r)) for r in graph.rings(m) if len(r) == 3)


def test_targets_that_a_look_at_elements_and_bonds_rules_out_have_no_match():
    texts = ["c1ccncc1", "C1=CC=NC=C1", "NS(=O)(=O)C", "[#16](=O)N", "C=S", "OC=O", "[2H]C", "[H][H]", "c1ccccc1-c1ccccc1", "C1=CC=CN1", "*~*", "C[Se]C", "C#N", "[se]1cccc1"]
    ruled = 0
    for q in texts:
        for mode in ("sub", "exact", "auto"):
            query = match.Query(mol(q), mode)
            for t in texts:
                possible = query.possible(smiles.parse(t))
                assert possible or not query.matches(mol(t)), (q, t, mode)
                ruled += not possible
    assert ruled > 200
    assert not match.Query(mol("O=S~N")).possible(smiles.parse("OSN"))


def test_a_bond_needs_atoms_that_are_there():
    with pytest.raises(graph.BadStructure):
        molfile.parse(block("CC", [(0, 1, 1)]))
    with pytest.raises(graph.BadStructure):
        smiles.parse("C$C")


def test_a_large_block_is_read():
    n = 653
    m = molfile.read(block(["C"] * n, [(i, i + 1, 1) for i in range(1, n)]))
    assert len(m) == n and graph.explicit(m)[0] == n + 2 * n + 2


@pytest.mark.parametrize("text", ["C", "C/C=C/C", "[C@@H](C)(N)O", "c1cc[nH]c1", "C%11CC%11", "[Na+].[Cl-]", "C(=O)(O)C", "[13CH3]C", "C=1CC=1", "[NH4+]", "[Cu+2]"])
def test_smiles_that_are_well_formed(text):
    assert validate.is_structure(text)


@pytest.mark.parametrize("text", ["", "C(", "C)", "C()C", "(C)C", "C1CC", "C=", "=C", "C==C", "C.", ".C", "C..C", "[Xx]", "[C", "C%1C", "C C", "[R1]", "Cé", "C(=)C", "1CC1"])
def test_smiles_that_are_not(text):
    assert not validate.is_structure(text)


def test_blocks():
    good = block(["C", "O"], [(1, 2, 1)])
    assert validate.is_structure(good) and validate.is_structure(good.replace("\n", "\r\n")) and validate.is_structure(good + "\n")
    for bad in (good.replace("V2000", "V3000"), good.replace(" O  ", " Xx "), good.replace("M  END", ""), good.replace("  1  2  1", "  1  3  1"), good.replace("  1  2  1", "  1  2  9"), good.replace("  2  1  0", "  3  1  0"), good + "\nmore"):
        assert not validate.is_structure(bad)


def test_symmetries_exchange_atoms_of_equal_invariant():
    toluene = mol("Cc1ccccc1")
    inv = match.invariants(toluene)
    assert inv[2] == inv[6] and inv[3] == inv[5] and len(set(inv)) == 5
    q = match.Query(toluene, "auto")
    assert sorted(q.all(toluene, unique=False)) == [[0, 1, 2, 3, 4, 5, 6], [0, 1, 6, 5, 4, 3, 2]]
    # an element alone doesn't make atoms exchangeable
    assert len(match.Query(mol("CCC(C)C"), "auto").all(mol("CCC(C)C"), unique=False)) == 2


def test_unique_matches_don_t_walk_every_order():
    target = mol("FC(F)(F)C(C(F)(F)F)(C(F)(F)F)C(F)(F)F")
    calls = 0

    def visit(hit):
        nonlocal calls
        calls += 1
        return True

    q = match.Query(mol("FC(F)F"))
    assert len(q.all(target, visit=visit)) == 4 and calls == 4
    assert sum(1 for _ in q.find(target, once=True)) == 4 and sum(1 for _ in q.find(target)) == 24
    for text in ("CC(C)C", "OC(=O)C", "c1ccccc1", "NCCN"):
        for other in ("CC(C)(C)C(C)C", "OC(=O)CC(=O)O", "c1ccc2ccccc2c1", "NCCNCCN"):
            a, b = match.Query(mol(text)), mol(other)
            assert {frozenset(h) for h in a.find(b)} == {frozenset(h) for h in a.find(b, once=True)}


def test_hydrogens_that_bonds_don_t_tell_are_kept():
    for text in ("[CH]1CCCC1", "[CH2]C", "[C]", "C[N+](C)(C)C", "c1cc[nH]c1", "CS(=O)(=O)N", "[SiH3]C"):
        a = mol(text)
        for kekule in (True, False):
            b = match.prepared(molfile.read(molfile.write(a, kekule)))
            assert graph.formula(b) == graph.formula(a), text
