import io
import random

import pytest
from pyspark.sql import functions as F

from cinnabar import cli
from cinnabar.chem import molfile, smiles
from cinnabar.functions import fingerprint as fp
from cinnabar.functions import predicates as p
from cinnabar.functions import textquery
from cinnabar.operators import aggregates, codebook, search
from cinnabar.plans import registry
from cinnabar.sources import structures
from cinnabar.sources.store import Conflict, ReadOnly, Store
from cinnabar.streaming import ingest

C6 = [("foo", "one", "c1ccccc1"), ("bar", "one", "c1ccncc1"), ("bar", "two", "OC1CCCC[C@H]1O"), ("bar", "three", "CC(=O)Nc1ccc(cc1O)C(O)=O"), ("abc", "one", "c1ncncc1"), ("abc", "two", "Cc1cc(Cl)nc2N(C3CC3)c3ncccc3C(=O)Nc12")]
C5 = [("s", "benzene", "c1ccccc1"), ("s", "benzothiazole", "c1nc2ccccc2s1"), ("s", "benzodiazole", "N1C=NC2=C1COC1CCCC[C@H]1O=CC=C2"), ("s", "benzodiazole", "[nH]1cnc2ccccc12"), ("s", "benzodiazole", "c1[nH]c2ccccc2n1")]


def filled(spark, path, rows, props=None):
    store = Store(spark, str(path))
    df = spark.createDataFrame([(*r, (props or [None] * len(rows))[i]) for i, r in enumerate(rows)], "source string, id string, structure string, props map<string,string>")
    store.add(df, props="props")
    return store


def ids(df):
    return [r["_id"] for r in df.select("_id").collect()]


def test_text_finds_an_added_record_until_it_is_removed(spark, tmp_path):
    store = filled(spark, tmp_path / "s", [("xxx", "benzene", "c1ccccc1")])
    assert ids(search.text(store.table(), "benzene", 1)) == ["benzene"]
    store.remove("xxx", "benzene")
    assert ids(search.text(store.table(), "benzene", 1)) == [] and store.size() == 0


def test_filtered_substructure(spark, tmp_path):
    t = filled(spark, tmp_path / "s", C5).table()
    r = search.substructure(t, "c1ccccc1", None, p.int_range(t, "_natoms", 6, None, False), p.double_range(t, "_molwt", 119), screen="_fingerprint_sub").collect()
    assert [x["_id"] for x in r] == ["benzothiazole"] and 0.02 < r[0]["similarity"] < 1 and len(r[0]["hits"]) == 6
    whole = search.substructure(t, "c1nc2ccccc2s1").collect()
    assert [(x["_id"], x["similarity"]) for x in whole] == [("benzothiazole", 1.0)]
    assert set(whole[0]["hits"]) == set(range(1, 10))


def test_batches_of_queries_find_what_single_ones_do(spark, tmp_path):
    t = filled(spark, tmp_path / "s", C5 + C6).table()
    texts = ["c1ccccc1", "C(=O)O", "C(", "C*", None]
    q = spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")
    got = {(r["query_id"], r["doc_key"]): r["hits"] for r in search.substructure_join(t, q).collect()}
    for i, text in enumerate(texts):
        want = {r["doc_key"]: r["hits"] for r in search.substructure(t, text).collect()} if text not in ("C(", None) else {}
        assert {k: h for (n, k), h in got.items() if n == i} == want


def test_similarity_search(spark, tmp_path):
    t = filled(spark, tmp_path / "s", C6).table()
    from cinnabar.chem import fingerprints, match, molfile

    q = lambda s: fingerprints.similarity_fingerprint(match.prepared(molfile.read(s)))
    r = search.similarity(t, q("O=C1NC2=C(NC3=NC=CC=C13)N=CC=C2"), 0.55, popcnt="_popcount").collect()
    assert [x["_id"] for x in r] == ["two"] and r[0]["similarity"] > 0.55
    r = search.similarity(t, q("c1ccnc2Nc3ncccc3C(=O)Nc12"), 0, None, p.double_range(t, "_molwt", 110)).collect()
    assert len(r) == 3 and all(x["_molwt"] > 110 for x in r)
    assert [x["similarity"] for x in r] == sorted((x["similarity"] for x in r), reverse=True)


def test_properties_count_under_every_type_they_read_as(spark, tmp_path):
    props = [{"prop1": "foo", "prop2": "123", "prop3": "3.1415926535"}, {"prop1": "456", "prop2": "bar", "prop3": "999"}]
    store = filled(spark, tmp_path / "s", [("zzz", "one", "c1ccccc1"), ("zzz", "two", "c1ccncc1")], props)
    t = store.table()
    assert ids(t.where(p.double_range(t, "prop3", 3, 4, True, False))) == ["one"]
    assert ids(t.where(p.int_range(t, "prop3", 0, 1000, False, False))) == ["two"]
    assert ids(search.text(t, "bar")) == ["two"] and ids(search.text(t, "prop2:bar")) == ["two"]
    assert store.fields() == ["prop1", "prop2", "prop3"]
    assert sorted(ids(search.text(t, "prop1"))) == ["one", "two"]
    with pytest.raises(ValueError):
        search.text(t, None)


def test_store(spark, tmp_path):
    path = tmp_path / "s"
    store = filled(spark, path, [("foo", "one", "c1ccccc1"), ("bar", "one", "c1ccncc1"), ("bar", "two", "c1ncncc1")])
    store.add_one("none", "C")
    assert store.sources() == {"bar": 2, "foo": 1}
    store.remove("bar")
    assert store.size() == 2 and sorted(ids(store.table())) == ["none", "one"]
    with pytest.raises(ValueError):
        store.remove()
    with pytest.raises(ValueError):
        store.add_one("bad", "C(")
    assert store.size() == 2 and store.last_modified > 0
    again = Store(spark, str(path), read_only=True)
    assert again.size() == 2
    with pytest.raises(ReadOnly):
        again.add_one("x", "C")
    with pytest.raises(FileNotFoundError):
        Store(spark, str(tmp_path / "nothing"), read_only=True)
    (tmp_path / "file").write_text("")
    with pytest.raises(NotADirectoryError):
        Store(spark, str(tmp_path / "file"))
    store.remove_all(spark.createDataFrame([("foo", None), (None, None), (None, "zzz")], "source string, id string"))
    assert ids(store.table()) == ["none"]


def test_tanimoto_columns(spark):
    rng = random.Random(2)
    rows = [(i, [rng.getrandbits(64) - (1 << 63) & -(1 << 63) | rng.getrandbits(63) for _ in range(8)]) for i in range(40)] + [(100, None), (101, [0] * 8)]
    df = spark.createDataFrame(rows, "doc_key long, _fingerprint_sim array<bigint>")
    q = rows[3][1]
    u = lambda w: w & (1 << 64) - 1
    want = {i: sum((u(a) & u(b)).bit_count() for a, b in zip(f, q)) / sum((u(a) | u(b)).bit_count() for a, b in zip(f, q)) for i, f in rows if f}
    for t in (0.0, 0.3, 0.34, 1.0):
        got = {r["doc_key"]: r["similarity"] for r in search.similarity(df, q, t).collect()}
        assert got == {i: s for i, s in want.items() if s >= t}
    assert [r["doc_key"] for r in search.similarity(df, [0] * 8, 0.5).collect()] == []
    queries = df.select(F.col("doc_key").alias("query_id"), "_fingerprint_sim")
    for most in (search.BROADCAST_ROWS, 7):
        search.BROADCAST_ROWS, kept = most, search.BROADCAST_ROWS
        got = search.similarity_join(df, queries, 0.3).where("query_id = 3").collect()
        search.BROADCAST_ROWS = kept
        assert {r["doc_key"] for r in got} == {i for i, s in want.items() if s >= 0.3}
    legacy = search.similarity(df, q, 0.0, legacy=True).collect()
    assert {r["doc_key"] for r in legacy if r["similarity"] == 1} == {3}


def test_windows_lose_nothing():
    for t in (0.1, 0.3, 0.55, 0.8, 0.95, 1.0):
        for a in range(0, 513, 3):
            lo, hi = fp.popcount_window(a, t)
            for b in range(0, 513, 5):
                if max(a, b) and min(a, b) / max(a, b) >= t:
                    assert lo <= b and (hi is None or b <= hi)


def test_filter_language(spark):
    df = spark.createDataFrame([(1, 5, {"x": "2.5", "y": "7"}), (2, 9, {"x": "Pyridine ring", "y": "9"}), (3, None, None)], "doc_key long, n int, props map<string,string>")
    find = lambda f, v: [r["doc_key"] for r in df.where(p.parse_filter(df, f, v)).orderBy("doc_key").collect()]
    assert find("n", "=5") == [1] and find("n", "5:9") == [1, 2] and find("n", ":8") == [1] and find("n", "6:") == [2]
    assert find("x", "1:2.5") == [1] and find("x", "pyridine") == find("x", "ring") == [2] and find("x", "Pyridine") == find("x", "pyridine ring") == [] and find("y", "=7") == [1] and find("y", "=7.0") == [1] and find("x", ":") == [1]
    with pytest.raises(p.BadFilter):
        p.parse_filter(df, "n", "9:5")
    with pytest.raises(p.BadFilter):
        p.parse_filter(df, "n", "=abc")


def test_query_syntax(spark):
    texts = {1: "the quick brown fox", 2: "Quick brown dogs", 3: "slow fox; brown quick", 4: None, 5: ""}
    df = spark.createDataFrame(list(texts.items()), "k long, text string").withColumn("t", textquery.tokens(F.col("text")))
    parse = textquery.Parser({"text": F.col("t")})
    find = lambda q: [r["k"] for r in df.where(parse(q)).orderBy("k").collect()]
    assert find("quick") == [1, 2, 3] and find("fox dogs") == [1, 2, 3] and find("fox AND slow") == [3] and find("+fox -slow") == [1]
    assert find('"quick brown"') == [1, 2] and find("do?s") == [2] and find("br*") == [1, 2, 3] and find("quikc~") == [1, 2, 3]
    assert find("(slow OR dogs) NOT fox") == [2] and find("text:slow^2") == [3] and find("[a TO c]") == [1, 2, 3] and find("*:*") == [1, 2, 3, 4, 5]
    assert find("the") == [] and find("nofield:x") == []
    for bad in ("(a", "a)", "+"):
        with pytest.raises(textquery.BadQuery):
            parse(bad)
    best = textquery.scored(df, F.col("t"), ["slow", "fox"], "k").orderBy(F.desc("score")).first()
    assert best["k"] == 3


def test_relevance(spark, tmp_path):
    rows = [("a", f"m{i}", "C" * (i + 1)) for i in range(6)]
    props = [{"note": "green oven"}, {"note": "oven oven green bench"}, {"note": "bench"}, {"other": "oven"}, {"note": "oven bench green"}, None]
    t = filled(spark, tmp_path / "s", rows, props).table()
    scores = lambda q: {r["_id"]: round(r["score"], 6) for r in search.text(t, q).collect()}
    # phrases, wildcards and words of a field have scores of their own, in the field they are in
    assert set(scores('"green oven"')) == {"m0"} and scores('"green oven"')["m0"] > 0
    assert set(scores("note:oven")) == {"m0", "m1", "m4"} and scores("note:oven")["m0"] > scores("note:oven")["m4"] > 0
    assert scores("ben*") == {"m1": 1.0, "m2": 1.0, "m4": 1.0}
    # a boost counts
    assert scores("note:oven^3 note:bench")["m0"] > scores("note:oven note:bench")["m0"]
    assert list(scores("note:bench^5 note:oven"))[0] == "m4" and scores("(note:bench)^2")["m2"] == pytest.approx(2 * scores("note:bench")["m2"], rel=1e-5)
    # words between, and in another order
    assert set(scores('"oven green"')) == {"m1"} and set(scores('note:"oven green"~1')) == {"m1", "m4"} and set(scores('"oven green"~2')) == {"m0", "m1", "m4"}
    assert set(scores('"oven bench"~1 -note:(oven -bench)')) == {"m4", "m1"}


def test_histograms_and_facets(spark):
    df = spark.createDataFrame([(x, f"s{x % 25}" if x % 7 else None) for x in range(100)] + [(None, None)], "n int, s string")
    rows = aggregates.histogram(df, F.col("n"), (10, 20, 90)).orderBy("bucket").collect()
    assert [r["count"] for r in rows] == [10, 10, 70, 10]
    assert aggregates.facet_counts(df, "s").count() == 20 and aggregates.facet_counts(df, "s", None).count() == 25
    with pytest.raises(ValueError):
        aggregates.histogram(df, F.col("n"), ())
    assert [r["count"] for r in aggregates.histogram(df.limit(0), F.col("n"), (1,)).collect()] == [0, 0]


def test_codebooks_screen_without_loss(spark):
    rng = random.Random(4)
    rows = [(i, [rng.getrandbits(63) & rng.getrandbits(63) for _ in range(8)]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_key long, _fingerprint_sim array<bigint>")
    books = codebook.build(4)
    q = [rows[7][1][0] & rng.getrandbits(63), *[0] * 7]
    inside = {r["doc_key"] for r in search.containment(df, q).collect()}
    assert 7 in inside
    for b in books:
        assert inside <= {r["doc_key"] for r in codebook.screen(df, b, q).collect()}
    counts = codebook.counts(df, books)
    assert counts.agg(F.sum("count")).first()[0] == 4 * 60
    assert codebook.best(counts, books, q) in (0, 1, 2, 3, None)


def test_codebooks_are_kept(spark, tmp_path):
    store = filled(spark, tmp_path / "s", C6)
    assert store.codebooks() == codebook.build() and codebook.build() == codebook.build()
    counted = {(r["book"], r["code"]): r["count"] for r in store.count_codes().collect()}
    assert counted == {(r["book"], r["code"]): r["count"] for r in codebook.counts(store.table(), store.codebooks()).collect()}
    again = Store(spark, str(tmp_path / "s"), read_only=True)
    assert again.codebooks() == store.codebooks() and {(r["book"], r["code"]): r["count"] for r in again.count_codes().collect()} == counted
    store.add_one("more", "CCCC")
    assert sum(r["count"] for r in store.count_codes().collect()) == 256 * 7
    t = store.table()
    q = t.where("_id = 'abc' or true").select("_fingerprint_sim").first()[0]
    some = [q[0], *[0] * 7]
    want = {r["doc_key"] for r in search.containment(t, some).collect()}
    assert {r["doc_key"] for r in codebook.screened(t, store.codebooks(), some).collect()} == want
    assert {r["doc_key"] for r in codebook.screened(t, store.codebooks(), [0] * 8).collect()} == {r["doc_key"] for r in t.collect()}
    codebook.save(codebook.counts(t.limit(0), [[1, 2]]), [[1, 2]], str(tmp_path / "empty"))
    assert codebook.load(spark, str(tmp_path / "empty"))[0] == [[1, 2]]


def test_a_slower_writer_changes_nothing(spark, tmp_path):
    one = filled(spark, tmp_path / "s", C6[:2])
    state, n = one._state()
    Store(spark, str(tmp_path / "s")).remove("foo")
    with pytest.raises(Conflict):
        one._commit(state, n)
    assert ids(one.table()) == ["one"]


def test_only_parts_with_a_hit_are_written_again(spark, tmp_path):
    store = filled(spark, tmp_path / "s", C6[:2])
    store.add_one("far", "CC", "three")
    before = store._state()[0]["parts"]
    store.remove_all(spark.createDataFrame([("three", None), (None, None), ("nothing", "x")], "source string, id string"))
    after = store._state()[0]["parts"]
    assert after[0] == before[0] and after[1] != before[1] and store.size() == 2


def test_large_batches_of_substructures_are_taken_in_parts(spark, monkeypatch):
    df = spark.createDataFrame([(i, s) for i, (_, _, s) in enumerate(C5 + C6)], "doc_key long, _molfile string")
    queries = spark.createDataFrame([(i, s) for i, (_, _, s) in enumerate(C5 + C6)] + [(50, "C("), (51, None)], "query_id long, query string")
    want = sorted(map(str, search.substructure_join(df, queries).collect()))
    monkeypatch.setattr(search, "BROADCAST_ROWS", 3)
    assert sorted(map(str, search.substructure_join(df, queries).collect())) == want and want


def test_structures_as_tables(spark):
    df = spark.createDataFrame([(1, "c1ccncc1"), (2, "C(=O)N"), (3, "C("), (4, None)], "doc_key long, _molfile string")
    atoms, bonds = structures.as_tables(df)
    assert {(r["doc_key"], r["i"], r["symbol"], r["aromatic"]) for r in atoms.collect()} == {(1, i, "N" if i == 4 else "C", True) for i in range(1, 7)} | {(2, 1, "C", False), (2, 2, "O", False), (2, 3, "N", False)}
    assert {(r["a"], r["b"], r["kind"]) for r in bonds.where("doc_key = 2").collect()} == {(1, 2, 2), (1, 3, 1)}
    assert structures.as_tables(df.limit(0))[0].count() == 0


def test_a_few_queries_are_matched_in_one_pass(spark, tmp_path):
    texts = ["NS(=O)(=O)c1ccccc1", "CP(=O)(N)N", "CP(=O)(N)NS(C)(=O)=O", "CSC.NP(C)(C)=O", None, "C1CS", "CS(=O)C.N", "N[#016](=O)C", "CCO", molfile.write(smiles.parse("NS(C)(=O)=O"))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_key long, _molfile string")
    df.write.parquet(str(tmp_path / "molecules.parquet"))
    single = [{r["doc_key"]: r["hits"] for r in search.substructure(df, q, all_hits=True).collect()} for q in ("O=S~N", "O=P~N")]
    sulfur = {r["doc_key"] for r in search.substructure(df, "S").collect()}
    both = search.substructure_hits(df, ["O=S~N", "O=P~N"])
    assert {r["doc_key"]: r["hits"] for r in both.collect()} == {k: [s.get(k, []) for s in single] for k in single[0].keys() | single[1].keys()}
    found = registry.substructure_query_bonds(spark, str(tmp_path))
    assert {r["doc_key"]: r["matches"] for r in found.collect()} == {k: sum(len(s.get(k, [])) for s in single) for k in (single[0].keys() | single[1].keys()) & sulfur} == {0: 2, 2: 4, 3: 1, 7: 1, 9: 2}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1


def test_rings_of_three_atoms_are_found_without_joins(spark, tmp_path):
    texts = ["C1CC1", "CC1OC1C", "C1CCC1", "C12CC1C2", None, "C1CC", "c1ccccc1.N1CC1"]
    spark.createDataFrame(list(enumerate(texts)), "doc_key long, _molfile string").write.parquet(str(tmp_path / "molecules.parquet"))
    found = registry.motif_triangle(spark, str(tmp_path))
    assert sorted(r["doc_key"] for r in found.collect()) == [0, 1, 3, 6]
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_files_and_command_line(spark, tmp_path):
    from cinnabar.chem import molfile

    sd = tmp_path / "my.lab.sdf"
    parts = []
    for n, (s, props) in enumerate([("c1ccccc1", {"logp": "2.1"}), ("c1ccncc1", {"logp": "0.7", "code": "P7"})]):
        m = molfile.read(s)
        m.name, m.props = ("ring" if n == 0 else ""), props
        parts.append(molfile.write_sd(m))
    sd.write_text("".join(parts))
    (tmp_path / "more.smi").write_text("CCO ethanol\nCCN ethyl amine\n")
    store = str(tmp_path / "store")
    out = io.StringIO()
    assert cli.main(["index", store, str(sd), str(tmp_path / "more.smi"), "-l"], spark, out) == 0
    assert "my.lab\t2" in out.getvalue() and "total\t4" in out.getvalue()
    found = ids(Store(spark, store).table())
    assert {"ring", "ethanol", "ethyl amine"} <= set(found) and any(len(i) == 10 and i.isdigit() for i in found)

    def run(*a):
        out = io.StringIO()
        code = cli.main(["search", store, *a], spark, out)
        return code, out.getvalue().splitlines()

    assert run("ring")[1][1].split("\t")[:3] == ["C1=CC=CC=C1", "ring", "my.lab"]
    assert len(run("-s", "sub", "c1ccccc1")[1]) == 2
    assert run("-s", "sim", "-t", "0.9", "CCO")[1][1].split("\t")[1:] == ["ethanol", "more", "1.000"]
    assert run("-F", "logp=0.0:1")[1][1].endswith("0.7") and run("-L")[1] == ["code", "logp"]
    assert run("-s", "sub", "-f", "mol", "CCO")[1][-1] == "M  END" and run("-F", "logp=2:1")[0] == 1 and run()[0] == 1
    out = io.StringIO()
    assert cli.main(["stats", store], spark, out) == 0 and "weight" in out.getvalue()
    again = str(tmp_path / "by-field")
    cli.main(["index", again, str(sd), "-i", "code"], spark, io.StringIO())
    assert set(ids(Store(spark, again).table())) == {"ring", "P7"}
    structures.write_tsv(Store(spark, store).table(), str(tmp_path / "tsv"), ["logp"])
    assert spark.read.csv(str(tmp_path / "tsv"), sep="\t", header=True).columns == ["#STRUCTURE", "ID", "SOURCE", "SIMILARITY", "logp"]


def test_source_names():
    assert [structures.source_name(x) for x in ("/a/b.c.sdf", "x", ".hidden", "d/.e.f")] == ["b.c", "x", ".hidden", ".e"]


def test_arriving_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.smi").write_text("CCO one\nCC two\n")
    store = Store(spark, str(tmp_path / "s"))
    for _ in range(2):
        ingest.into_store(ingest.watch_smiles(spark, str(tmp_path / "in")), store, str(tmp_path / "cp"), once=True).awaitTermination()
        assert sorted(ids(store.table())) == ["one", "two"]


def test_too_many_saved_filters_are_not_cut(spark, monkeypatch, tmp_path):
    from cinnabar.plans import registry

    m = spark.createDataFrame([(5, 4, 60.0, 7, {})], "_natoms int, _nbonds int, _molwt double, _popcount int, props map<string,string>")
    q = spark.createDataFrame([(i, "filter", None) for i in range(4)], "query_id long, kind string, filters array<struct<field:string,type:string,lo:double,hi:double,lo_inc:boolean,hi_inc:boolean>>")
    q.write.parquet(str(tmp_path / "saved_queries.parquet"))
    m.write.parquet(str(tmp_path / "molecules.parquet"))
    for most in (4, 3):
        monkeypatch.setattr(search, "BROADCAST_ROWS", most)
        assert {(r["query_id"], r["rows"]) for r in registry.saved_filters(spark, str(tmp_path)).collect()} == {(i, 1) for i in range(4)}
