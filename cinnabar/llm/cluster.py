"""Grouping records into similarity clusters.

MinHash banding proposes pairs, exact Jaccard verifies them, connected components form the groups, and loose groups are
split around the members that are most like the others.

No bucket's pairs are emitted. A task keeps a forest over its rows: it checks each bucket against a few of its members
first, and then only those pairs of the bucket that the forest doesn't join yet, all of them, so no verified link between
two components is lost. A task's output is at most one edge per row. Of more rows than a task holds, buckets are by six
values in place of four: the unrelated rows of a bucket grow with the table, and so would all pairs of them.

Edge cases: null, empty and too wide fingerprints belong to no cluster (``bits``); equal fingerprints have similarity 1;
a null key can't name a row and is left out; repeated keys are one row with several fingerprints, which links what each
links; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fingerprint as fp
from ..session import cut, done
from . import bits

ROWS = 4  #: MinHash values of a band: four keep unrelated records apart
BANDS = 42  #: a pair at similarity 0.6 shares no band with probability 0.003
LEAST = 0.5  #: at which a pair shares no band with probability 0.07
PER = 7  #: bands that one task takes
TASK_ROWS = 250_000  #: rows that one task holds at a time; of more, buckets share six MinHash values
BUCKETS = 7  #: of a route, by four MinHash values besides its two: a pair at similarity 0.6 shares none in 26 routes with probability 0.002
ROUTE_FUNCTIONS = 2 + 4 * BUCKETS
FIRST_ROUTES = 3  #: before rows are labelled
GATHER = 100_000  #: rows that are sent on together
CHUNK = 1_000_000  #: pairs that are verified at a time


def minhash_table(functions: Sequence[int], words: int, seed: int = 7) -> np.ndarray:
    """(bytes, 256, functions): the least rank of the bits in each byte's values, so a MinHash is a minimum over bytes."""
    ranks = np.stack([np.random.default_rng((seed, f)).permutation(64 * words).astype(np.uint16) for f in functions], axis=1)
    ranks = ranks.reshape(8 * words, 8, len(functions))
    table = np.full((8 * words, 256, len(functions)), 65535, np.uint16)
    for v in range(1, 256):
        low = (v & -v).bit_length() - 1
        np.minimum(table[:, v & (v - 1)], ranks[:, low], out=table[:, v])
    return table


def minhash(w: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = np.full((len(w), table.shape[2]), 65535, np.uint16)
    held = np.empty((4096, table.shape[2]), np.uint16)
    for a in range(0, len(w), len(held)):
        part = np.ascontiguousarray(np.ascontiguousarray(w[a : a + len(held)]).view(np.uint8).T).astype(np.intp)
        o = out[a : a + len(held)]
        h = held[: len(o)]
        for p in range(table.shape[0]):
            np.take(table[p], part[p], axis=0, out=h, mode="clip")
            np.minimum(o, h, out=o)
    return out


def band_keys(mh: np.ndarray) -> np.ndarray:
    """One 64-bit key per band: its ROWS values side by side."""
    return np.ascontiguousarray(mh).view(np.uint64)


def settle(label: np.ndarray) -> None:
    while True:
        nxt = label[label]
        if np.array_equal(nxt, label):
            return
        label[:] = nxt


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of a[i] and b[i]; every label is the least index of its component."""
    while len(a):
        ra, rb = label[a], label[b]
        differ = ra != rb
        if not differ.any():
            return
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
        settle(label)


def verified(w: np.ndarray, pc: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    out = np.zeros(len(a), bool)
    for s in range(0, len(a), CHUNK // 4):
        x, y = a[s : s + CHUNK // 4], b[s : s + CHUNK // 4]
        px, py = pc[x], pc[y]
        able = np.flatnonzero(np.minimum(px, py) >= threshold * np.maximum(px, py) - 1e-9)  # sizes too different are never as similar
        inter = bits.overlap(w, x[able], y[able])
        out[s + able] = bits.at_least(inter, (px + py)[able] - inter, threshold)
    return out


def link_buckets(label: np.ndarray, w: np.ndarray, pc: np.ndarray, key: np.ndarray, threshold: float, member: np.ndarray | None = None) -> None:
    """Joins in ``label`` whatever the verified pairs within equal ``key`` join. ``member``: only these rows are in buckets."""
    rows = np.arange(len(key)) if member is None else member
    order = rows[np.argsort(key[rows], kind="stable")]
    ks = key[order]
    start = np.flatnonzero(np.r_[True, ks[1:] != ks[:-1]]) if len(ks) else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, len(ks)])
    keep = size > 1
    order = order[np.repeat(keep, size)]
    size = size[keep]
    for where in (0.0, 0.5, 1.0, 0.25, 0.75):
        if not len(order):
            return
        start = np.cumsum(size) - size
        leader = np.repeat(order[start + ((size - 1) * where).astype(np.int64)], size)
        todo = label[leader] != label[order]
        a, b = leader[todo], order[todo]
        ok = verified(w, pc, a, b, threshold)
        unite(label, a[ok], b[ok])
        lab = label[order]
        mixed = np.minimum.reduceat(lab, start) != np.maximum.reduceat(lab, start)
        order, size = order[np.repeat(mixed, size)], size[mixed]
    if not len(order):
        return
    run = np.repeat(np.arange(len(size)), size)
    by = np.lexsort((label[order], run))
    order, lab = order[by], label[order][by]
    end = np.repeat(np.cumsum(size), size)
    new = np.flatnonzero(np.r_[True, (lab[1:] != lab[:-1]) | (run[1:] != run[:-1])])
    own_end = np.repeat(np.r_[new[1:], len(lab)], np.diff(np.r_[new, len(lab)]))
    count = end - own_end
    total = np.cumsum(count)
    s = 0
    while s < len(order):
        e = max(s + 1, int(np.searchsorted(total, (total[s - 1] if s else 0) + CHUNK, side="right")))
        c = count[s:e]
        i = np.repeat(np.arange(s, e), c)
        j = own_end[i] + bits.ranges(c)
        a, b = order[i], order[j]
        todo = label[a] != label[b]
        a, b = a[todo], b[todo]
        ok = verified(w, pc, a, b, threshold)
        unite(label, a[ok], b[ok])
        s = e


def routes(threshold: float) -> int:
    """Routes after which a pair at ``threshold`` meets in no bucket with a probability below that of the bands."""
    return 26 if threshold >= 0.6 else 29


def links(df: DataFrame, key: str, fingerprint: str, threshold: float, words: int = 8, n: int | None = None) -> DataFrame:
    """Edges (u, v), u > v, whose components are those of all verified candidate pairs.

    The bands are made for a ``threshold`` of ``LEAST`` or more; below it too many pairs would share none.
    """
    if threshold < LEAST:
        raise ValueError(f"the threshold is {LEAST} or more")
    df = df.select(F.col(key).cast("long").alias("key"), F.col(fingerprint).alias("fp")).where("key is not null and fp is not null")
    n = df.count() if n is None else n
    if n > TASK_ROWS:
        return _routed_links(df, threshold, words, n)
    dtype = np.dtype([("key", "<i8"), ("w", "<u8", (words,))])
    groups = BANDS // PER

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records, copies in _gathered(batches, words, dtype):
            parts = [(g, records) for g in range(groups)]
            if len(copies):
                parts.append((int(bits.mix(copies["key"][:1].view(np.uint64))[0] % np.uint64(groups)), copies))
            yield bits.blocks_batch(parts)

    def receive(g: int, records: np.ndarray) -> Iterator[pa.RecordBatch]:
        records = records[np.argsort(records["key"], kind="stable")]
        key, w = records["key"], np.ascontiguousarray(records["w"])
        pc = bits.popcount(w)
        label = np.arange(len(key))
        same = np.flatnonzero(key[1:] == key[:-1])
        unite(label, same + 1, same)
        keys = band_keys(minhash(w, minhash_table(range(g * PER * ROWS, (g + 1) * PER * ROWS), words)))
        for b in range(PER):
            link_buckets(label, w, pc, keys[:, b], threshold)
        yield from _edges(key, label)

    return bits.exchange(df, send, groups, receive, dtype, "u long, v long")


def _edges(key: np.ndarray, label: np.ndarray) -> Iterator[pa.RecordBatch]:
    u, v = key, key[label]
    edge = u > v
    u, v = u[edge], v[edge]
    for s in range(0, len(u), 100_000):
        yield pa.RecordBatch.from_pydict({"u": u[s : s + 100_000], "v": v[s : s + 100_000]})


def _gathered(batches: Iterator[pa.RecordBatch], words: int, dtype: np.dtype) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows, ``GATHER`` or more at a time: the first of each distinct fingerprint, and what links its copies to it, in pairs."""

    def made(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        records = np.concatenate(held)
        first, back = distinct_rows(np.ascontiguousarray(records["w"]))
        extra = np.setdiff1d(np.arange(len(records)), first)
        copies = np.empty(2 * len(extra), dtype)
        copies[0::2], copies[1::2] = records[extra], records[first[back[extra]]]
        return records[first], copies

    held: list[np.ndarray] = []
    for batch in batches:
        w, ok = bits.words_of(batch["fp"], words)
        records = np.empty(int(ok.sum()), dtype)
        records["key"], records["w"] = batch["key"].to_numpy(zero_copy_only=False)[ok], w[ok]
        if len(records):
            held.append(records)
        if sum(map(len, held)) >= GATHER:
            yield made(held)
            held = []
    if held:
        yield made(held)


def route_keys(w: np.ndarray, these: list[int], words: int) -> np.ndarray:
    """(rows, routes) hashes of each route's first two MinHash values."""
    mh = minhash(w, minhash_table([r * ROUTE_FUNCTIONS + i for r in these for i in (0, 1)], words)).astype(np.uint64)
    return bits.mix(mh[:, 0::2] << np.uint64(16) | mh[:, 1::2])


def bucket_keys(w: np.ndarray, route: int, words: int) -> np.ndarray:
    """(rows, BUCKETS) keys of a route's buckets: its two values and four more."""
    more = minhash(w, minhash_table(range(route * ROUTE_FUNCTIONS + 2, (route + 1) * ROUTE_FUNCTIONS), words))
    return bits.mix(band_keys(more) ^ route_keys(w, [route], words))


def _routed_links(df: DataFrame, threshold: float, words: int, n: int) -> DataFrame:
    """``links`` of many rows, in which the unrelated ones that share four MinHash values would be too many pairs.

    Buckets share six values: two name the task, so a route is one copy of each row for ``BUCKETS`` buckets. The first
    routes join most of what belongs together; rows go through the others with what they belong to, one of each
    fingerprint, and only links between different ones come out.
    """
    first = list(range(FIRST_ROUTES))
    found = components(_through(df, threshold, words, n, first))
    rest = list(range(FIRST_ROUTES, routes(threshold)))
    belongs = df.join(found.select(F.col("node").alias("key"), "root"), "key", "left").select(F.coalesce("root", "key").alias("key"), "fp")
    # copies of a fingerprint have met, but a key may have several, so one fingerprint has one label
    distinct = cut(belongs.groupBy("fp").agg(F.min("key").alias("key")))
    more = _through(distinct, threshold, words, distinct.count(), rest)
    return found.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more)


def _through(df: DataFrame, threshold: float, words: int, n: int, these: list[int]) -> DataFrame:
    """Edges (u, v), u > v, of what the buckets of some routes join; rows (key, fp) of one key belong together."""
    dtype = np.dtype([("key", "<i8"), ("w", "<u8", (words,))])

    def joined(route: int, buckets: list[int], records: np.ndarray) -> Iterator[pa.RecordBatch]:
        records = records[np.argsort(records["key"], kind="stable")]
        key, w = records["key"], np.ascontiguousarray(records["w"])
        pc = bits.popcount(w)
        start = _starts(key)
        label = np.repeat(start, np.diff(np.r_[start, len(key)]))
        keys = bucket_keys(w, route, words)
        for b in buckets:
            link_buckets(label, w, pc, keys[:, b], threshold)
        heads = label[start]  # a key's rows have one label, that of its first row or a smaller one's
        u, v = key[start], key[heads]
        yield from _edges(u, np.searchsorted(u, v))

    return by_routes(df, lambda batches: _gathered(batches, words, dtype), dtype, words, n, these, joined, "u long, v long")


def by_routes(df: DataFrame, gathered: Callable, dtype: np.dtype, words: int, n: int, these: list[int], receive: Callable, schema: str) -> DataFrame:
    """``receive(route, buckets, records)`` of the rows that share a route's two values, ``n`` in all; ``gathered`` yields records and copies that meet anywhere."""
    slices = max(1, -(-n // TASK_ROWS))
    hot: dict[int, tuple[int, int]] = {}  # slices that are too large go on by bucket: first target, targets of a bucket
    whose: dict[int, tuple[int, int]] = {}  # slice and bucket of such a target
    full: dict[int, tuple[int, int]] = {}  # targets that are still too large, in pairs of blocks
    origin: dict[int, tuple[int, int, int]] = {}
    targets = len(these) * slices

    def routed(records: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        w = np.ascontiguousarray(records["w"])
        keys = route_keys(w, these, words)
        for i, route in enumerate(these):
            pid = i * slices + (keys[:, i] % np.uint64(slices)).astype(np.int64)
            much = np.isin(pid, list(hot)) if hot else np.zeros(len(pid), bool)
            yield from bits.split(records[~much], pid[~much])
            if much.any():
                some, pid = records[much], pid[much]
                base, each = (np.array([hot[p][x] for p in pid.tolist()], np.int64) for x in (0, 1))
                keys_of = bucket_keys(np.ascontiguousarray(some["w"]), route, words)
                for b in range(BUCKETS):
                    yield from bits.split(some, base + b * each + (keys_of[:, b] % each.astype(np.uint64)).astype(np.int64))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records, _ in gathered(batches):
            parts = [(p, len(x)) for p, x in routed(records)]
            yield pa.RecordBatch.from_pydict({"pid": pa.array([p for p, _ in parts], pa.int32()), "n": pa.array([c for _, c in parts], pa.int64())})

    def too_large() -> list[tuple[int, int]]:
        """One number for each slice that is too large for a task comes to the driver."""
        sums = df.mapInArrow(counted, "pid int, n long").groupBy("pid").agg(F.sum("n").alias("n"))
        return [(r["pid"], r["n"]) for r in sums.where(F.col("n") > 2 * TASK_ROWS).collect()]

    for p, rows in sorted(too_large()):
        each = -(-rows // TASK_ROWS)
        hot[p] = (targets, each)
        whose |= {targets + b * each + j: (p, b) for b in range(BUCKETS) for j in range(each)}
        targets += BUCKETS * each
    if hot:
        full, targets, origin = bits.blocks_of([x for x in too_large() if x[0] in whose], targets, TASK_ROWS)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records, copies in gathered(batches):
            parts = [x for p, part in routed(records) for x in bits.in_blocks(p, part, full)]
            if len(copies):
                parts.append((int(bits.mix(copies["key"][:1].view(np.uint64))[0] % np.uint64(len(these) * slices)), copies))
            yield bits.blocks_batch(parts)

    def run(pid: int, records: np.ndarray) -> Iterator[pa.RecordBatch]:
        pid = origin.get(pid, (pid, 0, 0))[0]
        pid, bucket = whose.get(pid, (pid, None))
        yield from receive(these[pid // slices], list(range(BUCKETS)) if bucket is None else [bucket], records)

    return bits.exchange(df, send, targets, run, dtype, schema)


def distinct_rows(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first of each distinct row, in order, and for each row the position of its first among them."""
    h = bits.hash_rows(w)
    order = np.argsort(h, kind="stable")
    changed = np.r_[True, (w[order][1:] != w[order][:-1]).any(axis=1)] if len(w) else np.zeros(0, bool)
    group = np.cumsum(changed) - 1
    first, back = order[changed], np.empty(len(w), np.int64)
    back[order] = group
    rank = np.argsort(first, kind="stable")
    place = np.empty(len(first), np.int64)
    place[rank] = np.arange(len(first))
    return first[rank], place[back]


HUB = 100_000  #: edges of one node from which it is looked up by itself


def _looked_up(edges: DataFrame, total: int, low: DataFrame) -> DataFrame:
    """(u, v, m): ``edges`` with what ``low`` (v, m) has for v.

    The nodes that hold the most edges, ten thousand at most, are looked up in a small table; only the others are shuffled.
    """
    most = max(HUB, total // 10_000)
    if total <= most:
        return edges.join(low, "v", "left")
    hubs = cut(edges.groupBy("v").agg(F.count("*").alias("c")).where(F.col("c") > most).join(low, "v", "left").select("v", F.col("m").alias("hub"), F.lit(True).alias("is_hub")))
    edges = edges.join(F.broadcast(hubs), "v", "left")  # at most total / most rows
    return edges.where("is_hub is null").select("u", "v").join(low, "v", "left").unionByName(edges.where("is_hub").select("v", "u", F.col("hub").alias("m")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges`` (u, v) with the least node it is connected to, by large-star and small-star rounds.

    Each round is two aggregations and two joins over the edges, written to the shared folder; the number of rounds grows
    with the logarithm of the longest path. Only counts come to the driver. Hot nodes are aggregated on the map side.
    """
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before: list[DataFrame] = []
    while True:
        # settled when every node has one parent and no parent has one
        least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        above = edges.select("v").distinct().join(least.select(F.col("u").alias("v")), "v", "left_semi")
        if not (above.limit(1).count() or least.where("c > 1").limit(1).count()):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        # small star: each node's other parents hang on its least one
        low = least.select("u", "m")
        small = edges.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        # large star: each node's larger neighbours hang on the least of all its neighbours
        small = cut(small)
        done(*before, edges)
        small_low = small.groupBy("u").agg(F.min("v").alias("m"))
        large = _looked_up(small, small.count(), small_low.select(F.col("u").alias("v"), "m")).select("u", F.coalesce("m", "v").alias("v")).distinct()
        edges = cut(large)
        before = [small]


def labels(df: DataFrame, key: str, fingerprint: str, threshold: float = 0.6, words: int = 8) -> DataFrame:
    """(node, root) of every row that is linked to another one."""
    return components(links(df, key, fingerprint, threshold, words))


def clusters(df: DataFrame, key: str = "doc_key", fingerprint: str = "_fingerprint_sim", threshold: float = 0.6, least: int = 3, words: int = 8) -> DataFrame:
    """(key, cluster_key): members of every component of ``least`` rows or more; its name is its smallest key."""
    found = labels(df, key, fingerprint, threshold, words)
    sizes = found.groupBy("root").agg(F.count("*").alias("size")).where(F.col("size") >= least).select("root")
    return found.join(sizes, "root").select(F.col("node").alias(key), F.col("root").alias("cluster_key"))


BLOCK = 20_000  #: rows of a component that one task splits; of a larger one many tasks do
LOOSE = 0.5  #: a component whose most typical member is not linked to this part of it is split


def overlaps(w: np.ndarray, group: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bits that each row has in common with all rows of its group together, from the group's numbers of rows by bit."""
    out = np.empty(len(w), np.float64)
    for s in range(0, len(w), 4096):
        flat = np.unpackbits(np.ascontiguousarray(w[s : s + 4096]).view(np.uint8), axis=1)
        out[s : s + 4096] = np.einsum("ij,ij->i", flat, counts[group[s : s + 4096]], dtype=np.float64)
    return out


def bit_counts(w: np.ndarray, start: np.ndarray) -> np.ndarray:
    """(groups, bits) rows with each bit, of groups of adjacent rows."""
    out = np.empty((len(start), 64 * w.shape[1]), np.int64)
    ends = np.r_[start[1:], len(w)]
    g = 0
    while g < len(start):
        e = max(g + 1, int(np.searchsorted(ends, start[g] + 4096, side="right")))
        out[g:e] = np.add.reduceat(np.unpackbits(np.ascontiguousarray(w[start[g] : ends[e - 1]]).view(np.uint8), axis=1), start[g:e] - start[g], axis=0, dtype=np.int64)
        g = e
    return out


def typicality(pc: np.ndarray, common: np.ndarray, rows: np.ndarray, bits_set: np.ndarray) -> np.ndarray:
    """Common bits over bits of either, each summed over all rows of the group: how near a row is to all others, in linear time."""
    return common / (rows * pc + bits_set - common)


def _starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


def around_medoids(w: np.ndarray, pc: np.ndarray, threshold: float) -> np.ndarray:
    """Of each row, given by rank, the first row that no medoid before it is linked to and that it is linked to itself."""
    medoid = np.full(len(w), -1)
    left = np.arange(len(w))
    while len(left):
        top = left[0]
        ok = verified(w, pc, left, np.full(len(left), top), threshold)
        ok[0] = True
        medoid[left[ok]] = top
        left = left[~ok]
    return medoid


def _grouped(df: DataFrame, words: int, total: int, receive, schema: str) -> DataFrame:
    """``receive(group, key, w)`` of whole groups of ``df`` (grp, key, fp); its rows are in order of group and key."""
    dtype = np.dtype([("grp", "<i8"), ("key", "<i8"), ("w", "<u8", (words,))])
    targets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BLOCK))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, ok = bits.words_of(batch["fp"], words)
            records = np.empty(int(ok.sum()), dtype)
            for c in ("grp", "key"):
                records[c] = batch[c].to_numpy(zero_copy_only=False)[ok]
            records["w"] = w[ok]
            if len(records):
                yield bits.blocks_batch(list(bits.split(records, (bits.mix(records["grp"].view(np.uint64)) % np.uint64(targets)).astype(np.int64))))

    def run(_: int, records: np.ndarray) -> Iterator[pa.RecordBatch]:
        records = records[np.lexsort((records["key"], records["grp"]))]
        yield from receive(np.ascontiguousarray(records["grp"]), np.ascontiguousarray(records["key"]), np.ascontiguousarray(records["w"]))

    return bits.exchange(df.select("grp", "key", "fp"), send, targets, run, dtype, schema)


def typical(df: DataFrame, words: int, total: int) -> DataFrame:
    """(grp, key, score) of rows (grp, key, fp, size): by how much each is like all of its group, exactly.

    A group of more than ``BLOCK`` rows isn't brought together: its rows by bit are summed, and each row meets the sums.
    """

    def small(grp: np.ndarray, key: np.ndarray, w: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = _starts(grp)
        many = np.diff(np.r_[start, len(grp)])
        own = np.repeat(np.arange(len(start)), many)
        pc = bits.popcount(w).astype(np.int64)
        score = typicality(pc, overlaps(w, own, bit_counts(w, start)), many[own], np.add.reduceat(pc, start)[own])
        yield pa.RecordBatch.from_pydict({"grp": grp, "key": key, "score": score})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, _ = bits.words_of(batch["fp"], words)
            grp = batch["grp"].to_numpy()
            order = np.argsort(grp, kind="stable")
            start = _starts(grp[order])
            n = bit_counts(w[order], start)
            g, b = np.nonzero(n)
            yield pa.RecordBatch.from_pydict({"grp": grp[order][start][g], "bit": b, "n": n[g, b]})

    def large(grp: int, rows: np.ndarray, extra: np.ndarray) -> Iterator[pa.RecordBatch]:
        counts = np.ascontiguousarray(extra["w"][np.argsort(extra["key"])]).view(np.int64).reshape(1, -1)
        w = np.ascontiguousarray(rows["w"])
        pc = bits.popcount(w)
        score = typicality(pc, overlaps(w, np.zeros(len(w), np.int64), counts), rows["size"], counts.sum())
        yield pa.RecordBatch.from_pydict({"grp": rows["grp"], "key": rows["key"], "score": score})

    schema = "grp long, key long, score double"
    out = _grouped(df.where(F.col("size") <= BLOCK), words, total, small, schema)
    big = df.where(F.col("size") > BLOCK)
    if not big.limit(1).count():
        return out
    by_bit = big.select("grp", "fp").mapInArrow(counted, "grp long, bit long, n long").groupBy("grp", "bit").agg(F.sum("n").alias("n"))
    # the sums travel as 64 rows of ``words`` numbers a group
    every = big.select("grp", "size").distinct().withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(64 * words - 1)).cast("array<long>")))
    sums = every.join(by_bit, ["grp", "bit"], "left").groupBy("grp", "size", F.floor(F.col("bit") / words).alias("key"))
    sums = sums.agg(F.transform(F.array_sort(F.collect_list(F.struct("bit", F.coalesce("n", F.lit(0)).alias("n")))), lambda x: x["n"]).alias("fp"))
    return out.unionByName(_blocked(big.withColumn("score", F.lit(0.0)), sums.withColumn("score", F.lit(0.0)), words, total, large, schema))


def _blocked(df: DataFrame, extra: DataFrame, words: int, total: int, receive, schema: str) -> DataFrame:
    """``receive(group, rows, extra)`` of blocks of large groups (grp, key, fp, score, size), with all of a group's ``extra`` rows in each."""
    dtype = np.dtype([("grp", "<i8"), ("key", "<i8"), ("score", "<f8"), ("size", "<i8"), ("extra", "?"), ("w", "<u8", (words,))])
    targets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BLOCK))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records = np.empty(batch.num_rows, dtype)
            for c in ("grp", "key", "score", "size", "extra"):
                records[c] = batch[c].to_numpy(zero_copy_only=False)
            records["w"] = bits.words_of(batch["fp"], words)[0]
            blocks = -(-records["size"] // BLOCK)
            own = bits.mix(records["key"].view(np.uint64)) % blocks.astype(np.uint64)
            copies = np.where(records["extra"], blocks, 1)
            at = np.repeat(np.arange(len(records)), copies)
            block = np.where(records["extra"][at], bits.ranges(copies).astype(np.uint64), own[at])
            cell = bits.mix(bits.mix(records["grp"][at].view(np.uint64)) ^ bits.mix(block + np.uint64(1)))
            if len(at):
                yield bits.blocks_batch(list(bits.split(records[at], (cell % np.uint64(targets)).astype(np.int64))))

    def run(_: int, records: np.ndarray) -> Iterator[pa.RecordBatch]:
        records = records[np.argsort(records["grp"], kind="stable")]
        for some in np.split(records, _starts(records["grp"])[1:]):
            rows, more = some[~some["extra"]], some[some["extra"]]
            if len(rows):
                # two blocks of a group may meet here, each with the extra rows
                yield from receive(int(some["grp"][0]), rows, more[np.unique(more["key"], return_index=True)[1]])

    columns = ["grp", "key", "fp", "score", "size"]
    both = df.select(*columns, F.lit(False).alias("extra")).unionByName(extra.select(*columns, F.lit(True).alias("extra")))
    return bits.exchange(both, send, targets, run, dtype, schema)


def _split(df: DataFrame, threshold: float, words: int, total: int, loose: bool) -> DataFrame:
    """(key, medoid) of whole groups (grp, key, fp) of ``BLOCK`` rows or less. ``loose``: those known to be so."""

    def receive(grp: np.ndarray, key: np.ndarray, w: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = _starts(grp)
        many = np.diff(np.r_[start, len(grp)])
        own = np.repeat(np.arange(len(start)), many)
        pc = bits.popcount(w).astype(np.int64)
        score = typicality(pc, overlaps(w, own, bit_counts(w, start)), many[own], np.add.reduceat(pc, start)[own])
        order = np.lexsort((key, -score, own))
        key, w, pc = key[order], np.ascontiguousarray(w[order]), pc[order]
        top = start[own]
        linked = verified(w, pc, np.arange(len(key)), top, threshold)
        medoid = top.copy()
        for g in np.flatnonzero((np.add.reduceat(linked, start, dtype=np.int64) < LOOSE * many) | loose):
            s, e = start[g], start[g] + many[g]
            medoid[s:e] = s + around_medoids(w[s:e], pc[s:e], threshold)
        yield pa.RecordBatch.from_pydict({"key": key, "medoid": key[medoid]})

    return _grouped(df, words, total, receive, "key long, medoid long")


def _round(open_: DataFrame, threshold: float, words: int, total: int, turn: int) -> DataFrame:
    """(grp, key, fp, score, size, medoid) after a round over large groups: each row's medoid, or null.

    Candidates are the rows of best score by one MinHash value, 64 ``words`` of a group at most; those that no better
    candidate is linked to are medoids, and each row goes to the best one that it is linked to.
    """

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = minhash_table(range(turn, turn + 1), words, seed=13)
        for batch in batches:
            w, _ = bits.words_of(batch["fp"], words)
            grp, key, score = (batch[c].to_numpy() for c in ("grp", "key", "score"))
            v = minhash(w, table)[:, 0].astype(np.int64)
            order = np.lexsort((key, -score, v, grp))
            g, x = grp[order], v[order]
            one = pa.array(order[np.r_[True, (g[1:] != g[:-1]) | (x[1:] != x[:-1])]] if len(order) else order)
            yield pa.RecordBatch.from_arrays([*batch.take(one).columns, pa.array(v).take(one)], names=[*batch.schema.names, "v"])

    rank = Window.partitionBy("grp", "v").orderBy(F.desc("score"), "key")
    some = open_.select("grp", "key", "fp", "score", "size").mapInArrow(best, "grp long, key long, fp array<bigint>, score double, size long, v long")
    some = some.withColumn("nth", F.row_number().over(rank)).where("nth = 1")

    def assign(_: int, rows: np.ndarray, extra: np.ndarray) -> Iterator[pa.RecordBatch]:
        extra = extra[np.lexsort((extra["key"], -extra["score"]))]
        both = np.ascontiguousarray(np.concatenate([rows["w"], extra["w"]]))
        pc = bits.popcount(both).astype(np.int64)
        medoid, left, n = np.full(len(rows), -1), np.arange(len(rows)), len(rows)
        for m in np.unique(around_medoids(both[n:], pc[n:], threshold)):
            ok = verified(both, pc, left, np.full(len(left), n + m), threshold)
            medoid[left[ok]] = extra["key"][m]
            left = left[~ok]
        fp_ = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * words, pa.int32()), pa.array(np.ascontiguousarray(rows["w"]).view(np.int64).reshape(-1)))
        yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(rows[c])) for c in ("grp", "key", "score", "size")), fp_, pa.array(medoid, mask=medoid < 0)], names=["grp", "key", "score", "size", "fp", "medoid"])

    return _blocked(open_, some, words, total, assign, "grp long, key long, score double, size long, fp array<bigint>, medoid long")


def members(df: DataFrame, key: str = "doc_key", fingerprint: str = "_fingerprint_sim", threshold: float = 0.6, words: int = 8) -> DataFrame:
    """(key, cluster_key, medoid, score): every row with a fingerprint in its cluster, loose components split.

    Rank in a component: by typicality, which is a row's degree with each link weighed by how similar its ends are, summed
    exactly over all members without forming pairs; then by key. The first row is the medoid; where it is linked to less
    than ``LOOSE`` of the component, medoids are the rows that no medoid before them is linked to, and each other row goes
    to the first one it is linked to. In components of more than ``BLOCK`` rows medoids are taken by the hundred, in rounds,
    until ``BLOCK`` rows are left. A cluster is named by its smallest key; score is the typicality in the cluster. All steps
    take time in proportion to the rows, but for the splitting of what one task holds (rows times medoids).
    """
    df = df.select(F.col(key).cast("long").alias("key"), F.col(fingerprint).alias("fp")).where("key is not null and fp is not null")
    df = cut(df.where(F.exists("fp", lambda x: x != 0) & (F.size("fp") <= words)).groupBy("key").agg(F.first("fp").alias("fp")))
    found = cut(labels(df, "key", "fp", threshold, words))
    sizes = found.groupBy(F.col("root").alias("grp")).agg(F.count("*").alias("size"))
    placed = cut(df.join(found.select(F.col("node").alias("key"), F.col("root").alias("grp")), "key", "left").withColumn("grp", F.coalesce("grp", "key")).join(sizes, "grp", "left").withColumn("size", F.coalesce("size", F.lit(1))))
    total = placed.count()
    made = [_split(placed.where(F.col("size") <= BLOCK), threshold, words, total, False)]
    big = placed.where(F.col("size") > BLOCK)
    if big.limit(1).count():
        scored = cut(big.join(typical(big, words, total).select("key", "score"), "key").select("grp", "key", "fp", "score", "size"))
        rank = F.struct("score", (-F.col("key")).alias("k"))
        tops = scored.groupBy("grp").agg(F.max(rank).alias("r")).select("grp", (-F.col("r.k")).alias("key"))
        tops = tops.join(scored.select("key", F.col("fp").alias("top_fp")), "key").withColumnRenamed("key", "top")
        near = fp.column(fp.tanimoto(fp.words_of("fp", words), fp.words_of("top_fp", words)))
        degree = scored.join(tops, "grp").groupBy("grp", "top", "size").agg(F.count_if(near >= threshold).alias("degree"))
        tight = degree.where(F.col("degree") >= LOOSE * F.col("size")).select("grp", "top")
        open_ = cut(scored.join(tight, "grp", "left"))
        made.append(open_.where("top is not null").select("key", F.col("top").alias("medoid")))
        open_ = open_.where("top is null").drop("top")
        turn = 0
        while open_.limit(1).count():
            after = cut(_round(open_, threshold, words, total, turn))
            made.append(after.where("medoid is not null").select("key", "medoid"))
            rest = after.where("medoid is null").drop("medoid")
            few = rest.groupBy("grp").agg(F.count("*").alias("n"))
            rest = cut(rest.join(few, "grp"))
            made.append(_split(rest.where(F.col("n") <= BLOCK), threshold, words, total, True))
            open_, turn = rest.where(F.col("n") > BLOCK).drop("n"), turn + 1
    out = made[0]
    for d in made[1:]:
        out = out.unionByName(d)
    out = cut(out)
    names = out.groupBy("medoid").agg(F.min("key").alias("cluster_key"), F.count("*").alias("size"))
    named = cut(out.join(names, "medoid").join(df, "key"))
    score = typical(named.select(F.col("cluster_key").alias("grp"), "key", "fp", "size"), words, total).select("key", "score")
    return named.select("key", "cluster_key", "medoid", "size").join(score, "key").withColumnRenamed("key", key)


def described(df: DataFrame, key: str = "doc_key", fingerprint: str = "_fingerprint_sim", threshold: float = 0.6, typical: int = 3, words: int = 8) -> DataFrame:
    """(cluster_key, size, typical): every cluster with its size and its ``typical`` members that are most like all of it."""
    m = members(df, key, fingerprint, threshold, words)
    rank = Window.partitionBy("cluster_key").orderBy(F.desc("score"), key)
    top = m.withColumn("nth", F.row_number().over(rank)).where(F.col("nth") <= typical)  # cut to a few before the shuffle
    return top.groupBy("cluster_key").agg(F.first("size").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("nth", F.col(key).alias("k")))), lambda x: x["k"]).alias("typical"))
