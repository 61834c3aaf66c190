"""Choosing a varied subset: max-sum dispersion by local search over composable core-sets.

The distance of two rows is ``1 - Jaccard`` of their fingerprints, ``SOURCE`` of it given by whether their sources differ,
and, because a sum over hundreds of far pairs would forgive two members of one family, less ``CROWDING`` for the part
of the similarity above ``NEAR``. Each partition is read once in blocks: the rows chosen so far and the block's rows
compete, first by farthest-first choice, then by swaps of a chosen for an unchosen row while the sum of distances grows.
What a partition chose is its core-set; core-sets are merged the same way, ``FAN_IN`` at a time, until one is left. A task
holds a block and a core-set, whatever the table's size.

Rows without a fingerprint (null, empty, too wide) are only taken where there are fewer than ``k`` others; a null source
is a source of its own; null keys are left out; equal rows have distance 0 (1 - J) and the full surcharge, so copies are
chosen last; ties go to the smaller key; a table of fewer than ``k`` rows comes out whole; an empty one gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, splits, spread
from . import bits

SOURCE = 0.2
NEAR = 0.5
CROWDING = 20.0
FAN_IN = 16
BLOCK = 8192
KEPT = 16_000_000  #: distances that a task keeps
SCHEMA = "key long, side long, fp array<bigint>"


def distance(w: np.ndarray, pc: np.ndarray, side: np.ndarray, some: np.ndarray, one: int) -> np.ndarray:
    """Distances of the rows ``some`` to row ``one``."""
    inter = bits.ones(w[some] & w[one])
    union = pc[some] + pc[one] - inter
    j = np.where(union > 0, inter / np.maximum(union, 1), 1.0)  # two rows without a fingerprint are alike
    return (1 - SOURCE) * (1 - j) + SOURCE * (side[some] != side[one]) - CROWDING * np.maximum(0, j - NEAR) / (1 - NEAR)


def choose(key: np.ndarray, side: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    """Indices of ``k`` rows."""
    n = len(key)
    if n <= k:
        return np.arange(n)
    pc = bits.popcount(w)
    rows = np.flatnonzero(pc > 0)
    if len(rows) < k:  # the others fill up, by key
        rest = np.flatnonzero(pc == 0)
        return np.r_[rows, rest[np.argsort(key[rest], kind="stable")][: k - len(rows)]]
    rows = rows[np.argsort(key[rows], kind="stable")]
    m = len(rows)
    if m == k:
        return rows
    # farthest first; rows of distances are kept as far as they fit, and made anew when they are needed
    kept: dict[int, np.ndarray] = {}
    to = np.zeros(m)
    chosen = np.empty(k, np.int64)
    at = int(bits.mix(key[rows].view(np.uint64)).argmin())
    nearest = np.full(m, np.inf)
    for i in range(k):
        chosen[i] = at
        d = distance(w, pc, side, rows, rows[at])
        to += d
        if (i + 1) * m <= KEPT:
            kept[i] = d
        nearest = np.minimum(nearest, d)
        nearest[at] = -np.inf
        at = int(nearest.argmax())
    # swaps
    own = np.zeros(m, bool)
    own[chosen] = True
    self_ = distance(w, pc, side, rows[:1], rows[0])[0]  # a row's distance to itself, the same for all
    grew = True
    while grew:
        grew = False
        for i in np.argsort(to[chosen], kind="stable").tolist():  # each chosen row in turn, the one with the least sum first, for the best other one
            d = kept[i] if i in kept else distance(w, pc, side, rows, rows[chosen[i]])
            after = to - d
            after[own] = -np.inf
            j = int(after.argmax())
            if after[j] - (to[chosen[i]] - self_) <= 1e-9 * abs(to[chosen].sum()):
                continue
            fresh = distance(w, pc, side, rows, rows[j])
            to += fresh - d
            if i in kept:
                kept[i] = fresh
            own[chosen[i]], own[j] = False, True
            chosen[i] = j
            grew = True
    return rows[chosen]


def core_sets(df: DataFrame, k: int, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merge() -> None:
            key, side, w = (np.concatenate(x) for x in zip(*held))
            best = choose(key, side, w, k)
            held[:] = [(key[best], side[best], w[best])]

        for batch in batches:
            for s in range(0, batch.num_rows, BLOCK):
                part = batch.slice(s, BLOCK)
                w, ok = bits.words_of(part["fp"], words)
                held.append((part["key"].to_numpy(zero_copy_only=False), part["side"].to_numpy(zero_copy_only=False), np.where(ok[:, None], w, np.uint64(0))))
                if sum(len(x[0]) for x in held) >= BLOCK:
                    merge()
        if held:
            merge()
            key, side, w = held[0]
            fp = pa.ListArray.from_arrays(pa.array(np.arange(len(key) + 1) * words, pa.int32()), pa.array(np.ascontiguousarray(w).view(np.int64).reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(side), fp], names=["key", "side", "fp"])

    return df.mapInArrow(run, SCHEMA)


def subset(df: DataFrame, k: int = 200, key: str = "doc_key", fingerprint: str = "_fingerprint_sim", source: str = "_source", words: int = 8) -> DataFrame:
    """(key): ``k`` rows, or all where there are fewer."""
    if k < 1:
        raise ValueError("k is at least 1")
    df = df.select(F.col(key).cast("long").alias("key"), F.xxhash64(F.col(source).cast("string"), F.col(source).isNull()).alias("side"), F.col(fingerprint).alias("fp")).where("key is not null")
    found = core_sets(df, k, words)
    parts = splits(df) * FAN_IN
    while parts > 1:  # about FAN_IN core-sets a task; more of them are only more blocks
        parts = -(-parts // FAN_IN)
        to = F.lit(0) if parts == 1 else F.pmod(F.spark_partition_id(), F.lit(parts))
        found = core_sets(found.withColumn("to", to.cast("int")).repartitionById(parts, F.col("to")).drop("to"), k, words)
    return found.select(F.col("key").alias(key))



def coverage(df: DataFrame, k: int = 200, key: str = "doc_key", fingerprint: str = "_fingerprint_sim", source: str = "_source", words: int = 8) -> DataFrame:
    """(key, chosen, nearest, similarity): every row, whether it was chosen, and the chosen row most similar to it.

    ``k`` fingerprints are sent to every task, no more. Rows without a fingerprint are similar to none: ``nearest`` is null.
    Of equally similar ones the smaller key is named; rows with a null key are left out.
    """
    picked = cut(subset(df, k, key, fingerprint, source, words).select(F.col(key).alias("key")))
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(fingerprint).alias("fp")).where("key is not null")
    have = rows.join(F.broadcast(picked), "key").groupBy("key").agg(F.first("fp").alias("fp")).orderBy("key").toArrow()  # k rows
    cw, ok = bits.words_of(have["fp"], words)
    ck, every = have["key"].to_numpy(), set(have["key"].to_pylist())
    cw, ck = cw[ok], ck[ok]
    flat = np.unpackbits(np.ascontiguousarray(cw).view(np.uint8), axis=1).astype(np.float32)
    size = flat.sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 2048):
                part = batch.slice(s, 2048)
                w, ok = bits.words_of(part["fp"], words)
                near, best = np.zeros(len(w), np.int64), np.zeros(len(w))
                if len(ck) and len(w):
                    own = np.unpackbits(np.ascontiguousarray(w).view(np.uint8), axis=1).astype(np.float32)
                    inter = (own @ flat.T).astype(np.float64)
                    similar = inter / (own.sum(axis=1)[:, None] + size - inter)
                    at = similar.argmax(axis=1)
                    near, best = ck[at], similar[np.arange(len(w)), at]
                none = ~ok if len(ck) else np.ones(len(w), bool)
                keys = part["key"].to_numpy()
                yield pa.RecordBatch.from_pydict({"key": keys, "chosen": np.isin(keys, list(every)), "nearest": pa.array(near, mask=none), "similarity": pa.array(best, mask=none)})

    return spread(rows).mapInArrow(run, "key long, chosen boolean, nearest long, similarity double").withColumnRenamed("key", key)
