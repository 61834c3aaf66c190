"""All similar pairs between set-valued records: a prefix-filtered join.

Single bits of a fingerprint are far too frequent to index: the rarest is in one record of thirty. So the tokens of the
join are groups of bits: the bits are dealt by rarity into m groups, and a record's token of a group is the group's whole
content. Two records of sizes a and b with Jaccard similarity t or more differ in at most H = (a + b)(1 - t)/(1 + t) bits,
and a differing bit spoils one token, so they share at least m - H of their m tokens. That is an overlap join: with tokens
ordered by rarity, similar records share one among the first H + 1 of each. Only these prefixes are indexed. Then come
the length filter (t a <= b <= a / t), the positional filter (a first common token at places i and j leaves
max(i, j) <= H, for the pair's own H), and the exact overlap of the bits.

Lengths are cut into bands of ratio t, so that a partner is in the same or the next band; each band has its own m.
Equal records are one class, found by an aggregation that combines on the map side; only classes are joined.

Edge cases: null, empty and too wide fingerprints are similar to nothing (``bits``); null keys are left out; a key may
repeat; an empty table gives no pairs; ties don't matter, thresholds are inclusive; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from . import bits

TASK_ROWS = 40_000  #: rows of a band, each sent once, that one task is to hold
HOT_ROWS = 250_000  #: rows of one target beyond which it is taken in pairs of blocks
CHUNK = 1_000_000  #: pairs that are looked at at a time
SLACK = 3  #: tokens above the least number


def most_differing(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    return np.floor((a + b) * ((1 - t) / (1 + t)) + 1e-9).astype(np.int64)


def length_bands(t: float, longest: int) -> np.ndarray:
    """Lower ends; a record as short as t times one of band k is in band k - 1 or k."""
    ends = [1]
    while ends[-1] <= longest:
        ends.append(max(ends[-1] + 1, ceil(ends[-1] / t - 1e-9)))
    return np.array(ends)


class Tokens:
    """The m tokens of each record of a band: their hashes in order of rarity."""

    def __init__(self, frequency: np.ndarray, rows: int, m: int):
        width = len(frequency)
        p = (frequency + 0.5) / (rows + 1.0)
        by_rarity = np.argsort(p, kind="stable")
        turn = np.arange(width)
        place = np.where(turn // m % 2 == 0, turn % m, m - 1 - turn % m)
        self.m, self.wide = m, 64 * ceil(ceil(width / m) / 64)
        column = np.full((m, self.wide), width, np.int64)
        for g in range(m):
            own = by_rarity[place == g]
            column[g, : len(own)] = own
        self.column = column.reshape(-1)
        weight = np.r_[np.round(1000 * np.log(p / (1 - p))), 0.0]
        self.weight = np.zeros((width, m), np.float32)  # whole numbers: sums are exact in any order
        for g in range(m):
            own = column[g][column[g] < width]
            self.weight[own, g] = weight[own]
        base = np.r_[np.round(1000 * np.log1p(-p)), 0.0]
        self.base = base[column].sum(axis=1)

    def __call__(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, m) token hashes by group; (n, m) groups from the rarest token on."""
        hashes, order = np.empty((len(w), self.m), np.uint64), np.empty((len(w), self.m), np.int16)
        for s in range(0, len(w), 4096):
            flat = np.unpackbits(np.ascontiguousarray(w[s : s + 4096]).view(np.uint8), axis=1, bitorder="little")
            score = flat.astype(np.float32) @ self.weight + self.base
            flat = np.take(np.concatenate([flat, np.zeros((len(flat), 1), np.uint8)], axis=1), self.column, axis=1)
            packed = np.ascontiguousarray(np.packbits(flat, axis=1, bitorder="little")).view(np.uint64).reshape(len(flat), self.m, -1)
            h = np.broadcast_to(np.arange(1, self.m + 1, dtype=np.uint64) << np.uint64(40), packed.shape[:2]).copy()
            for k in range(packed.shape[2]):
                h = bits.mix(h ^ packed[:, :, k])
            hashes[s : s + 4096] = h
            order[s : s + 4096] = np.lexsort((h, score), axis=1)
        return hashes, order


def profile(df: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Records by length, and by bit: two arrays of fixed size, whatever the number of records."""
    width = 64 * words

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length, by_bit = np.zeros(width + 1, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            w, ok = bits.words_of(batch["fp"], words)
            w = w[ok]
            by_length += np.bincount(bits.popcount(w), minlength=width + 1)
            by_bit += np.unpackbits(w.view(np.uint8).reshape(len(w), 8 * words), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        yield pa.RecordBatch.from_pydict({"at": np.arange(2 * width + 1), "n": np.r_[by_length, by_bit]})

    rows = df.mapInArrow(counted, "at long, n long").where("n > 0").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(2 * width + 1, np.int64)
    for r in rows:
        out[r["at"]] = r["n"]
    return out[: width + 1], out[width + 1 :]


def class_pairs(df: DataFrame, key: str, fingerprint: str, threshold: float, words: int = 8) -> DataFrame:
    """(a, b, similarity), a < b, of all pairs of rows at ``threshold`` or above. The rows' fingerprints should be distinct."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    df = df.select(F.col(key).cast("long").alias("key"), F.col(fingerprint).alias("fp")).where("key is not null and fp is not null")
    dtype = np.dtype([("key", "<i8"), ("w", "<u8", (words,))])
    by_length, by_bit = profile(df, words)
    rows = int(by_length.sum())
    longest = int(np.flatnonzero(by_length).max(initial=1))
    ends = length_bands(threshold, longest)
    band_rows = np.add.reduceat(by_length[: ends[-1]] if ends[-1] <= len(by_length) else np.r_[by_length, np.zeros(ends[-1] - len(by_length), np.int64)], ends[:-1])
    groups = []  # (first target, slices) of each band
    targets = 0
    for k in range(len(ends) - 1):
        slices = max(1, -(-int(band_rows[k] + (band_rows[k - 1] if k else 0)) // TASK_ROWS)) if band_rows[k] else 0
        groups.append((targets, slices))
        targets += slices

    def tokens_of(k: int) -> Tokens:
        most = int(most_differing(np.array(ends[k + 1] - 1), np.array(ends[k + 1] - 1), threshold))
        return Tokens(by_bit, rows, most + SLACK)

    def prefix(k: int, length: np.ndarray) -> np.ndarray:
        partner = np.minimum(np.floor(length / threshold + 1e-9), ends[k + 1] - 1)
        return most_differing(length, partner, threshold) + 1

    hot: dict[int, tuple[int, int]] = {}
    origin: dict[int, tuple[int, int, int]] = {}

    def send(batches: Iterator[pa.RecordBatch], count_only: bool = False) -> Iterator[pa.RecordBatch]:
        made: dict[int, Tokens] = {}
        for batch in batches:
            w, ok = bits.words_of(batch["fp"], words)
            w = w[ok]
            records = np.empty(len(w), dtype)
            records["key"], records["w"] = batch["key"].to_numpy(zero_copy_only=False)[ok], w
            length = bits.popcount(w)
            band = np.searchsorted(ends, length, side="right") - 1
            parts = []
            for k in np.unique(np.r_[band, band + 1]).tolist():
                if k >= len(groups) or not groups[k][1]:
                    continue
                first, slices = groups[k]
                some = np.flatnonzero((band == k) | (band == k - 1))
                if slices == 1:
                    parts += bits.in_blocks(first, records[some], hot)
                    continue
                if k not in made:
                    made[k] = tokens_of(k)
                tokens = made[k]
                h, order = tokens(w[some])
                ph = np.take_along_axis(h, order.astype(np.int64), axis=1) % np.uint64(slices)
                inside = np.arange(tokens.m) < prefix(k, length[some])[:, None]
                for s in range(slices):
                    goes = ((ph == s) & inside).any(axis=1)
                    if goes.any():
                        parts += bits.in_blocks(first + s, records[some[goes]], hot)
            if parts and count_only:
                yield pa.RecordBatch.from_pydict({"pid": pa.array([p for p, _ in parts], pa.int32()), "n": pa.array([len(x) for _, x in parts], pa.int64())})
            elif parts:
                yield bits.blocks_batch(parts)

    if any(s and band_rows[k] + (band_rows[k - 1] if k else 0) > 2 * HOT_ROWS for k, (_, s) in enumerate(groups)):
        counted = df.mapInArrow(lambda it: send(it, True), "pid int, n long").groupBy("pid").agg(F.sum("n").alias("n"))
        full = [(r["pid"], r["n"]) for r in counted.where(F.col("n") > 2 * HOT_ROWS).collect()]  # one number for each target too full
        hot, targets, origin = bits.blocks_of(full, targets, HOT_ROWS)

    def receive(pid: int, records: np.ndarray) -> Iterator[pa.RecordBatch]:
        pid, one, two = origin.get(pid, (pid, 0, 0))
        k = max(i for i, (f, s) in enumerate(groups) if s and f <= pid)
        first, slices = groups[k]
        records = records[np.argsort(bits.popcount(records["w"]), kind="stable")]
        key, w = records["key"], np.ascontiguousarray(records["w"])
        length = bits.popcount(w).astype(np.int64)
        short = length < ends[k]
        block = bits.block_of(np.ascontiguousarray(key), hot[pid][1]) if pid in hot else None
        tokens = tokens_of(k)
        hashes, order = tokens(w)
        need = prefix(k, length)
        found: list[np.ndarray] = []
        inside = np.arange(tokens.m) < need[:, None]
        ph = np.take_along_axis(hashes, order.astype(np.int64), axis=1)
        if slices > 1:
            inside &= ph % np.uint64(slices) == np.uint64(pid - first)
        row, rank = np.nonzero(inside)
        row, rank, h = row.astype(np.int32), rank.astype(np.int16), ph[inside]
        by = np.argsort(h, kind="stable")  # rows are in order of length, so each token's list is too
        row, rank, h = row[by], rank[by], h[by]
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        size = np.diff(np.r_[start, len(h)])
        end = np.repeat(start + size, size)
        own = np.arange(len(h))
        count = end - own - 1
        total = np.cumsum(count)
        s = 0
        while s < len(h):
            e = max(s + 1, int(np.searchsorted(total, (total[s - 1] if s else 0) + CHUNK, side="right")))
            c = count[s:e]
            if not c.any():
                s = e
                continue
            i = np.repeat(own[s:e], c)
            j = i + 1 + bits.ranges(c)
            a, b = row[i], row[j]
            la, lb = length[a], length[b]  # la <= lb
            ok = ~short[b] & (la >= threshold * lb - 1e-9)
            ok &= np.maximum(rank[i], rank[j]) <= most_differing(la, lb, threshold)
            if block is not None:  # pairs within a block are found where the block meets itself
                ok &= block[a] != block[b] if one != two else True
            a, b = a[ok], b[ok]
            for x in range(0, len(a), CHUNK // 4):
                p, q = a[x : x + CHUNK // 4], b[x : x + CHUNK // 4]
                inter = bits.overlap(w, p, q)
                union = length[p] + length[q] - inter
                good = bits.at_least(inter, union, threshold)
                found.append(np.unique(p[good].astype(np.int64) * len(key) + q[good]))
            s = e
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        for x in range(0, len(pairs), CHUNK // 8):
            p, q = np.divmod(pairs[x : x + CHUNK // 8], len(key))
            # of all slices that find a pair, the one with its first common token gives it
            if slices > 1:
                o = order[p].astype(np.int64)
                same = np.take_along_axis(hashes[p] == hashes[q], o, axis=1)
                at = np.take_along_axis(o, same.argmax(axis=1)[:, None], axis=1)[:, 0]
                mine = hashes[p, at] % np.uint64(slices) == np.uint64(pid - first)
                p, q = p[mine], q[mine]
            inter = bits.overlap(w, p, q)
            yield pa.RecordBatch.from_pydict({"a": np.minimum(key[p], key[q]), "b": np.maximum(key[p], key[q]), "similarity": inter / (length[p] + length[q] - inter)})

    if not targets:
        return df.sparkSession.createDataFrame([], "a long, b long, similarity double")
    return bits.exchange(df, send, targets, receive, dtype, "a long, b long, similarity double").where("a < b")


SIDE_ROWS = 2000  #: copies of one side that meet those of another in one piece of work


def pairs_across(df: DataFrame, key: str = "doc_key", fingerprint: str = "_fingerprint_sim", across: str = "_source", threshold: float = 0.8, words: int = 8) -> DataFrame:
    """(key_a, key_b, similarity), key_a < key_b: all similar pairs of rows whose ``across`` is given and different.

    Copies with one value of ``across`` are a side of their class. Pairs of sides are found first; those of single rows are
    done, the others are expanded in blocks, so that a class of many copies is work for many tasks, and none where all of
    its rows have one value.
    """
    df = df.select(F.col(key).cast("long").alias("key"), F.col(fingerprint).alias("fp"), F.col(across).alias("side")).where("key is not null and fp is not null and side is not null")
    by_class = Window.partitionBy("fp")
    sides = df.groupBy("fp", "side").agg(F.min("key").alias("key"), F.count("*").alias("n"))
    sides = cut(sides.withColumn("nth", F.row_number().over(by_class.orderBy("key", "side"))).withColumn("rep", F.min("key").over(by_class)).withColumn("sides", F.count("*").over(by_class)))
    found = class_pairs(sides.where("nth = 1"), "rep", "fp", threshold, words)
    own = sides.where(F.exists("fp", lambda x: x != 0) & (F.size("fp") <= words) & (F.col("sides") > 1)).where("nth = 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("similarity"))
    one, two = (sides.select(F.col("rep").alias(c), F.col("key").alias(f"k{c}"), F.col("side").alias(f"s{c}"), F.col("n").alias(f"n{c}")) for c in "ab")
    met = cut(found.unionByName(own).join(one, "a").join(two, "b").where("sa <> sb and (a <> b or sa < sb)"))
    single = met.where("na = 1 and nb = 1").select("ka", "kb", "similarity")
    several = met.where("na > 1 or nb > 1")
    if several.limit(1).count():
        block = F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / SIDE_ROWS)).cast("long")
        total = sides.agg(F.sum("n")).first()[0]
        rows = cut(bits.meet(df, sides.select("fp", "side", "rep", "n"), ["fp", "side"], "n", total).select("rep", "side", "key", block.alias("block")))
        for c in "ab":
            several = several.withColumn(f"i{c}", F.explode(F.sequence(F.lit(0), F.ceil(F.col(f"n{c}") / SIDE_ROWS) - 1).cast("array<long>")))
        for c in "ab":
            several = several.drop(f"k{c}").join(rows.select(F.col("rep").alias(c), F.col("side").alias(f"s{c}"), F.col("block").alias(f"i{c}"), F.col("key").alias(f"k{c}")), [c, f"s{c}", f"i{c}"])
        single = single.unionByName(several.select("ka", "kb", "similarity"))
    return single.where("ka <> kb").select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"), "similarity")
