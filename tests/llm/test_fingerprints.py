"""Pairs, clusters, neighbours and subsets against brute force on small tables."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from cinnabar.llm import bits, cluster, diverse, knn, pairs

SCHEMA = "doc_key long, _fingerprint_sim array<bigint>, _source string, u string, v string, key string"


def family_table(seed, families=12, most=14, flips=8):
    """Families of related fingerprints, unrelated ones, copies, nulls and empty ones."""
    rng = random.Random(seed)
    sets = []
    for _ in range(families):
        base = set(rng.sample(range(512), rng.randint(25, 90)))
        for _ in range(rng.randint(1, most)):
            other = set(base)
            for b in rng.sample(range(512), rng.randint(0, flips)):
                other ^= {b}
            sets.append(other)
    sets += [set(rng.sample(range(512), rng.randint(1, 60))) for _ in range(25)]
    sets += [set(sets[i]) for i in rng.sample(range(len(sets)), 10)]
    rng.shuffle(sets)
    rows = [(i + 1, s, rng.choice(["a", "b", "c", None])) for i, s in enumerate(sets)]
    return rows + [(1000, None, "a"), (1001, set(), "b"), (1002, None, None)]


def words(s):
    if s is None:
        return None
    out = [0] * 8
    for i in s:
        out[i // 64] |= 1 << i % 64
    return [w - (1 << 64) if w >> 63 else w for w in out]


def frame(spark, rows):
    return spark.createDataFrame([(k, words(s), src, "x", "y", "z") for k, s, src in rows], SCHEMA)


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def linked(rows, t):
    return {(min(k, m), max(k, m)) for (k, a, _), (m, b, _) in itertools.combinations(rows, 2) if jaccard(a, b) >= t}


def test_words():
    column = pa.array([[1, None, 3], None, [0] * 8, [-1] * 8, [1] * 9, []], pa.list_(pa.int64()))
    w, ok = bits.words_of(column)
    assert ok.tolist() == [True, False, False, True, False, False] and w[0].tolist() == [1, 0, 3, 0, 0, 0, 0, 0]
    sliced = pa.array([[5] * 8, [1] * 8, [2] * 8], pa.list_(pa.int64())).slice(1)
    assert bits.words_of(sliced)[0][:, 0].tolist() == [1, 2]
    assert bits.words_of(pa.array([], pa.list_(pa.int64())))[0].shape == (0, 8)


@pytest.mark.parametrize("t", [0.5, 0.6, 0.7, 0.8, 0.9, 1.0])
@pytest.mark.parametrize(("slices", "hot"), [(40_000, 250_000), (15, 250_000), (30, 8)])
def test_pairs_are_all_pairs(spark, monkeypatch, t, slices, hot):
    monkeypatch.setattr(pairs, "TASK_ROWS", slices)
    monkeypatch.setattr(pairs, "HOT_ROWS", hot)
    rows = family_table(3, flips=14)
    want = {(a, b) for a, b in linked(rows, t)}
    source = {k: s for k, _, s in rows}
    across = {(a, b) for a, b in want if source[a] and source[b] and source[a] != source[b]}
    got = pairs.pairs_across(frame(spark, rows), threshold=t).collect()
    assert len(got) == len(across) and {(r["key_a"], r["key_b"]) for r in got} == across
    by_key = {k: s for k, s, _ in rows}
    assert all(r["similarity"] == jaccard(by_key[r["key_a"]], by_key[r["key_b"]]) for r in got)


@pytest.mark.parametrize("side", [2000, 3])
def test_pairs_of_copies(spark, monkeypatch, side):
    """Classes of many copies, of one source and of several, next to one another; each pair once."""
    monkeypatch.setattr(pairs, "SIDE_ROWS", side)
    monkeypatch.setattr(bits, "HUB", 10)
    base = set(range(40))
    rows = [(i, base, "a") for i in range(12)] + [(100 + i, base, "b" if i else "c") for i in range(5)] + [(200 + i, base ^ {300}, "a") for i in range(4)] + [(300 + i, set(range(200, 240)), "a") for i in range(20)]
    rows += [(400, base ^ {301}, "d"), (401, base, None), (402, set(), "a"), (403, set(), "b")]
    got = [(r["key_a"], r["key_b"]) for r in pairs.pairs_across(frame(spark, rows)).collect()]
    source = {k: s for k, _, s in rows}
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a, b in linked(rows, 0.8) if source[a] and source[b] and source[a] != source[b]}


def test_pairs_of_nothing(spark):
    assert pairs.pairs_across(frame(spark, [])).count() == 0
    assert pairs.pairs_across(frame(spark, [(1, None, "a"), (2, set(), "b"), (3, set(), "a")])).count() == 0
    with pytest.raises(ValueError):
        pairs.pairs_across(frame(spark, []), threshold=0)


def brute_components(rows, t):
    parent = {k: k for k, s, _ in rows if s}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked(rows, t):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    groups = {}
    for k in parent:
        groups.setdefault(find(k), set()).add(k)
    return {r: g for r, g in groups.items() if len(g) >= 3}


@pytest.mark.parametrize("limit", [250_000, 40, 20, 4])
def test_clusters(spark, monkeypatch, limit):
    monkeypatch.setattr(cluster, "TASK_ROWS", limit)
    rows = family_table(8, flips=20)
    got = {}
    for r in cluster.clusters(frame(spark, rows)).collect():
        assert r["doc_key"] not in got.get(r["cluster_key"], set())
        got.setdefault(r["cluster_key"], set()).add(r["doc_key"])
    assert got == brute_components(rows, 0.6)
    assert cluster.clusters(frame(spark, [])).count() == 0


def test_buckets_of_large_tables_keep_unrelated_rows_apart():
    """F2: pairs of unrelated rows that share a bucket, of all there are, and pairs at similarity 0.6 that share none."""
    rng = np.random.default_rng(3)
    flat = rng.random((6000, 512)) < rng.beta(1.0, 7.0, 512)  # as alike as unrelated molecules: 0.13 on average
    w = np.packbits(flat, axis=1, bitorder="little").view(np.uint64)
    bands = cluster.band_keys(cluster.minhash(w, cluster.minhash_table(range(cluster.BANDS * cluster.ROWS), 8))).T

    def met(columns):
        return sum(int((n * (n - 1) // 2).sum()) for n in (np.unique(c, return_counts=True)[1] for c in columns))

    buckets = [c for r in range(cluster.routes(0.6)) for c in cluster.bucket_keys(w, r, 8).T]
    assert met(buckets) < 0.25 * met(bands)
    a, b = (np.zeros((2000, 512), bool) for _ in range(2))
    for x, y in zip(a, b):  # 45 bits of 75
        some = rng.permutation(512)[:75]
        x[some[:60]], y[some[15:]] = True, True
    x, y = (np.packbits(v, axis=1, bitorder="little").view(np.uint64) for v in (a, b))
    apart = np.all([~(cluster.bucket_keys(x, r, 8) == cluster.bucket_keys(y, r, 8)).any(axis=1) for r in range(cluster.routes(0.6))], axis=0)
    assert apart.mean() < 0.006


def test_a_group_of_copies_is_one_cluster(spark):
    rows = [(i, {1, 2, 3}, "a") for i in range(300)] + [(1000 + i, {100 + i}, "b") for i in range(5)]
    got = cluster.clusters(frame(spark, rows)).collect()
    assert len(got) == 300 and {r["cluster_key"] for r in got} == {0}


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 500), (3, 40), (200, 199), (199, 198)]
    got = {r["node"]: r["root"] for r in cluster.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 198, 199: 198, 198: 198}


@pytest.mark.parametrize("block", [20_000, 5])
def test_reports_split_loose_clusters(spark, monkeypatch, block):
    monkeypatch.setattr(cluster, "BLOCK", block)
    core = set(range(60))
    rows = [(i, core ^ {100 + i}, "a") for i in range(1, 8)]
    chain = [(20 + i, set(range(200 + 8 * i, 260 + 8 * i)), "a") for i in range(8)]
    got = {r["cluster_key"]: r for r in cluster.described(frame(spark, rows + chain), typical=2).collect()}
    assert got[1]["size"] == 7 and got[1]["typical"][0] == 1
    assert sum(r["size"] for r in got.values()) == 15 and len(got) >= 3
    assert cluster.described(frame(spark, [])).count() == 0


@pytest.mark.parametrize("block", [20_000, 6])
def test_clusters_and_their_typical_members(spark, monkeypatch, block):
    """Sizes, medoids and scores of all clusters against pairs taken one by one; clusters within components, singles included."""
    monkeypatch.setattr(cluster, "BLOCK", block)
    rows = [r for r in family_table(21, families=9, most=30, flips=26)]
    by_key = {k: s for k, s, _ in rows if s}
    got = {r["doc_key"]: r for r in cluster.members(frame(spark, rows)).collect()}
    assert got.keys() == by_key.keys()
    groups = {}
    for k, r in got.items():
        groups.setdefault(r["cluster_key"], set()).add(k)
    whole = {k: r for r, g in brute_components(rows, 0.6).items() for k in g}
    for name, own in groups.items():
        assert name == min(own) and {got[k]["size"] for k in own} == {len(own)} and len({got[k]["medoid"] for k in own}) == 1
        assert len({whole.get(k, k) for k in own}) == 1 or len(own) == 2
        for k in own:
            want = sum(len(by_key[k] & by_key[m]) for m in own) / sum(len(by_key[k] | by_key[m]) for m in own)
            assert abs(got[k]["score"] - want) < 1e-12
    # a split component's members are linked to their medoid, and no medoid to another one of the same block of work
    for r, g in brute_components(rows, 0.6).items():
        medoids = {got[k]["medoid"] for k in g}
        if len(medoids) > 1:
            assert all(k in medoids or jaccard(by_key[k], by_key[got[k]["medoid"]]) >= 0.6 for k in g)


def test_components_of_a_hub(spark, monkeypatch):
    monkeypatch.setattr(cluster, "HUB", 10)
    edges = [(0, i) for i in range(1, 60)] + [(i, i + 100) for i in range(1, 60)] + [(500, 400), (400, 300)]
    got = {r["node"]: r["root"] for r in cluster.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(60)}, **{100 + i: 0 for i in range(1, 60)}, 500: 300, 400: 300, 300: 300}


def brute_neighbours(rows, k, t):
    out = {}
    for key, s, _ in rows:
        near = sorted(((-jaccard(s, o), m) for m, o, _ in rows if m != key and jaccard(s, o) >= t))
        out[key] = [m for _, m in near[:k]]
    return out


@pytest.mark.parametrize("shard", [20_000, 12])
def test_neighbours(spark, monkeypatch, shard):
    monkeypatch.setattr(knn, "SHARD_ROWS", shard)
    rows = family_table(5, families=8, most=40, flips=10)
    want = brute_neighbours(rows, 5, 0.6)
    got = {}
    for r in knn.neighbours(frame(spark, rows)).orderBy("key", "place").collect():
        got.setdefault(r["key"], []).append(r["neighbour"])
    found = sum(len(set(got.get(k, [])) & set(v)) for k, v in want.items())
    assert found >= (0.97 if shard > 1000 else 0.9) * sum(map(len, want.values()))
    wanted = {(min(k, m), max(k, m)) for k, v in want.items() for m in v}
    have = {(r["key_a"], r["key_b"]) for r in knn.neighbour_pairs(frame(spark, rows)).collect()}
    assert len(have & wanted) >= 0.9 * len(wanted)
    assert knn.neighbours(frame(spark, [])).count() == 0


def test_neighbours_in_a_large_component(spark, monkeypatch):
    monkeypatch.setattr(knn, "SHARD_ROWS", 80)
    rng = random.Random(3)
    base = set(rng.sample(range(512), 60))
    subs = [base ^ set(rng.sample(range(512), 6)) for _ in range(15)]
    rows = [(i + 1, rng.choice(subs) ^ set(rng.sample(range(512), rng.randint(0, 8))), "a") for i in range(500)]
    want = brute_neighbours(rows, 5, 0.6)
    got = {}
    for r in knn.neighbours(frame(spark, rows)).collect():
        got.setdefault(r["key"], []).append(r["neighbour"])
    assert all(len(set(v)) == len(v) <= 5 for v in got.values())
    assert sum(len(set(got.get(k, [])) & set(v)) for k, v in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_neighbours_in_a_family_that_no_minhash_divides(spark, monkeypatch):
    monkeypatch.setattr(knn, "SHARD_ROWS", 60)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 60)
    monkeypatch.setattr(knn, "QUERIES", 50)
    rng = random.Random(4)
    order = rng.sample(range(512), 512)
    base, free = set(order[:70]), order[70:]
    family = {frozenset(base | set(rng.sample(free, rng.randint(1, 3)))) for _ in range(500)}
    rows = [(i + 1, set(s), "a") for i, s in enumerate(sorted(family, key=sorted))]
    rng.shuffle(rows)
    want = brute_neighbours(rows, 5, 0.6)
    got = {}
    for r in knn.neighbours(frame(spark, rows)).collect():
        got.setdefault(r["key"], []).append(r["neighbour"])
    assert all(len(set(v)) == len(v) <= 5 for v in got.values())
    assert sum(len(set(got.get(k, [])) & set(v)) for k, v in want.items()) >= 0.95 * sum(map(len, want.values()))


@pytest.mark.parametrize("large, graph", [(4000, 40_000), (20, 40_000), (20, 30)])
def test_neighbours_in_a_large_table(spark, monkeypatch, large, graph):
    """tables of more rows than a task holds go through the buckets of routes, small and large ones, and find what brute force does."""
    monkeypatch.setattr(cluster, "TASK_ROWS", 150)
    monkeypatch.setattr(knn, "LARGE", large)
    monkeypatch.setattr(knn, "GRAPH", graph)
    monkeypatch.setattr(cluster, "labels", None)  # without components
    rows = family_table(5, families=8, most=40, flips=10)
    rows += [(10_000 + i, rows[0][1], "a") for i in range(20)]  # more copies than go into a search
    want = brute_neighbours(rows, 5, 0.6)
    got = {}
    for r in knn.neighbours(frame(spark, rows)).orderBy("key", "place").collect():
        got.setdefault(r["key"], []).append(r["neighbour"])
    assert len(rows) > 150
    assert all(len(set(v)) == len(v) <= 5 for v in got.values())
    assert sum(len(set(got.get(k, [])) & set(v)) for k, v in want.items()) >= 0.98 * sum(map(len, want.values()))
    assert sum(got.get(k, []) == v for k, v in want.items()) >= 0.9 * len(want)  # in order, the smaller key first among equals


def test_all_routes_compare_fewer_pairs_than_one_search_in_each_division(monkeypatch):
    """what a row of a large component costs, in pairs compared."""
    rng = np.random.default_rng(3)
    flat = rng.random((6000, 512)) < rng.beta(1.0, 7.0, 512)
    flat[3000:] = flat[:3000] ^ (rng.random((3000, 512)) < 0.02)
    w = np.packbits(flat, axis=1, bitorder="little").view(np.uint64)
    searched = []
    plain = knn.distances
    monkeypatch.setattr(knn, "distances", lambda w, pc, a, b: searched.append(len(a)) or plain(w, pc, a, b))
    knn.nearest(np.zeros(len(w), np.uint64), np.arange(len(w)), w, 5, 0.6)
    pairs, found = 0, set()
    for r in range(cluster.routes(0.6)):
        best = knn.Nearest(w, np.full(len(w), int(0.4 * knn.UNIT) + 1), 5)
        knn.meet_in_buckets(best, cluster.bucket_keys(w, r, 8), 0.6)
        found |= set(zip(*(x.tolist() for x in best.found())))
        pairs += best.pairs
    assert pairs < 0.25 * knn.DIVISIONS * sum(searched)
    inter = bits.overlap(w, np.arange(3000), np.arange(3000, 6000))
    pc = bits.popcount(w)
    like = np.flatnonzero(inter >= 0.6 * (pc[:3000] + pc[3000:] - inter))
    assert np.mean([(i, i + 3000) in found and (i + 3000, i) in found for i in like.tolist()]) > 0.99


def test_thresholds_that_the_bands_are_not_made_for(spark):
    for f in (knn.neighbours, cluster.clusters):
        with pytest.raises(ValueError):
            f(frame(spark, []), threshold=0.1)


def test_compared_finds_the_first_of_equals():
    rows = [(i, {*range(40)} ^ {100 + i % 7, 200 + i}, "a") for i in range(60)]
    w = np.array([words(s) for _, s, _ in rows], np.int64).view(np.uint64)
    row, other, _ = knn.compared(w, np.arange(60), np.arange(60), 5, 0.6)
    got = {}
    for r, o in zip(row.tolist(), other.tolist()):
        got.setdefault(r, set()).add(o)
    assert got == {k: set(v) for k, v in brute_neighbours(rows, 5, 0.6).items()}


def test_copies_are_each_others_neighbours(spark):
    rows = [(i, {1, 2, 3, 4}, "a") for i in range(30)] + [(50, {1, 2, 3}, "a"), (51, None, "a"), (52, set(), "a")]
    assert {r["key"]: None for r in knn.neighbours(frame(spark, rows)).collect()}.keys() == {*range(30), 50}
    got = {}
    for r in knn.neighbours(frame(spark, rows)).orderBy("key", "place").collect():
        got.setdefault(r["key"], []).append(r["neighbour"])
    assert got == brute_neighbours(rows[:-2], 5, 0.6)


def test_graph_recall():
    rng = np.random.default_rng(3)
    base = rng.random((40, 512)) < 0.12
    flat = base[rng.integers(0, 40, 3000)] ^ (rng.random((3000, 512)) < 0.01)
    w = np.packbits(flat, axis=1, bitorder="little").view(np.uint64)
    f = flat.astype(np.float32)
    size = f.sum(axis=1)
    inter = f @ f.T
    s = inter / (size[:, None] + size - inter)
    np.fill_diagonal(s, -1)
    row, other, sim = knn.nearest(np.zeros(3000, np.uint64), np.arange(3000), w, 5, 0.0)
    kth = np.sort(s, axis=1)[:, -5]
    assert (sim >= kth[row] - 1e-6).mean() > 0.95


def test_subsets(spark):
    rows = [(i, {*range(50)} ^ {100 + i % 30}, "a") for i in range(400)] + [(1000 + i, {*range(200 + 9 * i, 230 + 9 * i)}, "b") for i in range(20)]
    rows += [(2000, None, None), (2001, set(), "a")]
    got = [r["doc_key"] for r in diverse.subset(frame(spark, rows).repartition(3), 20).collect()]
    assert len(got) == len(set(got)) == 20 and sum(k < 1000 for k in got) <= 2
    assert diverse.subset(frame(spark, rows[-5:]), 10).count() == 5
    assert diverse.subset(frame(spark, []), 3).count() == 0
    assert diverse.subset(frame(spark, rows).repartition(40), 7).count() == 7
    with pytest.raises(ValueError):
        diverse.subset(frame(spark, rows), 0)


def test_coverage(spark):
    rows = family_table(4, families=10)
    by_key = {k: s for k, s, _ in rows}
    got = {r["doc_key"]: r for r in diverse.coverage(frame(spark, rows), 15).collect()}
    chosen = {k for k, r in got.items() if r["chosen"]}
    assert got.keys() == by_key.keys() and len(chosen) == 15
    assert chosen == {r["doc_key"] for r in diverse.subset(frame(spark, rows), 15).collect()}
    for k, r in got.items():
        if by_key[k]:
            best = max(jaccard(by_key[k], by_key[c]) for c in chosen)
            assert r["similarity"] == best and r["nearest"] == min(c for c in chosen if jaccard(by_key[k], by_key[c]) == best)
        else:
            assert r["nearest"] is None and r["similarity"] is None
    few = diverse.coverage(frame(spark, [(1, None, "a"), (2, set(), "b")]), 5).collect()
    assert {(r["doc_key"], r["chosen"], r["nearest"]) for r in few} == {(1, True, None), (2, True, None)}
    assert diverse.coverage(frame(spark, []), 5).count() == 0


def test_swaps_only_gain(monkeypatch):
    rng = np.random.default_rng(1)
    w = rng.integers(0, 2**63, (300, 8), dtype=np.uint64) & rng.integers(0, 2**63, (300, 8), dtype=np.uint64) & rng.integers(0, 2**63, (300, 8), dtype=np.uint64)
    side, key = rng.integers(0, 4, 300), np.arange(300)
    best = diverse.choose(key, side, w, 12)
    monkeypatch.setattr(diverse, "KEPT", 1000)  # distances made anew give the same rows
    assert diverse.choose(key, side, w, 12).tolist() == best.tolist()
    pc = bits.popcount(w)
    total = lambda rows: sum(diverse.distance(w, pc, side, np.array(rows), r).sum() for r in rows)
    top = total(list(best))
    for i in range(12):
        for j in range(300):
            if j not in best:
                other = list(best)
                other[i] = j
                assert total(other) <= top + 1e-6
