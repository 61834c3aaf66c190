"""Bit vectors in numpy, and the packed exchange that the fingerprint operators share.

A fingerprint column is ARRAY<BIGINT>; ``words`` (default 8) is its width. Null words count as zero, shorter arrays are
filled up with zeros. Null arrays, arrays without a set bit and arrays longer than ``words`` are no fingerprints: such rows
are similar to nothing.

Rows travel between stages as packed blocks, one compressed numpy record array per target partition and Arrow batch. The
JVM then moves a few large values instead of millions of narrow rows, and the number of targets follows the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_SCHEMA = "pid int, n int, block binary"


def words_of(column: pa.Array | pa.ChunkedArray, words: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(n, words) uint64 and the mask of rows that hold a fingerprint."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros((0, words), np.uint64), np.zeros(0, bool)
    offsets = column.offsets.to_numpy()
    length = np.diff(offsets)
    valid = np.asarray(column.is_valid())
    flat = column.values
    flat = flat.fill_null(0) if flat.null_count else flat
    flat = flat.to_numpy(zero_copy_only=False).view(np.uint64)
    if valid.all() and (length == words).all():
        out = flat[offsets[0] : offsets[-1]].reshape(n, words)
    else:
        out = np.zeros((n, words), np.uint64)
        valid = valid & (length <= words)
        for i in range(words):
            has = valid & (length > i)
            out[has, i] = flat[offsets[:-1][has] + i]
    return out, valid & out.any(axis=1)


def ones(w: np.ndarray) -> np.ndarray:
    """Bits set along the last axis. The counts of eight words are added as the bytes of one, a sum over a short axis being slow."""
    count = np.bitwise_count(w)
    if w.shape[-1] % 8:
        return count.sum(axis=-1, dtype=np.int32)
    by8 = np.ascontiguousarray(count).view(np.uint64)
    low = np.uint64(0x00FF00FF00FF00FF)
    out = by8 & low
    by8 >>= np.uint64(8)
    by8 &= low
    out += by8
    out *= np.uint64(0x0001000100010001)
    out >>= np.uint64(48)
    return out[..., 0].astype(np.int32) if out.shape[-1] == 1 else out.sum(axis=-1, dtype=np.int32)


def popcount(w: np.ndarray) -> np.ndarray:
    return ones(w)


def overlap(w: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits common to rows ``a`` and ``b``."""
    both = w[a]
    both &= w[b]
    return ones(both)


def at_least(inter: np.ndarray, union: np.ndarray, threshold: float) -> np.ndarray:
    """inter / union >= threshold, as the doubles compare."""
    return inter.astype(np.float64) / union >= threshold


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for every c of ``counts``, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    start = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) - np.repeat(start, counts)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: equal input gives equal output in every process."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x


def hash_rows(w: np.ndarray) -> np.ndarray:
    h = np.full(len(w), 0x9E3779B97F4A7C15, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(w.shape[1]):
            h = mix(h ^ w[:, i]) + np.uint64(i)
    return h


def pack(records: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(records).view(np.uint8).reshape(-1), codec="zstd", asbytes=True)


def unpack(block, n: int, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(pa.decompress(block, decompressed_size=n * dtype.itemsize, codec="zstd"), dtype, count=n)


def split(records: np.ndarray, pid: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The records of each target."""
    order = np.argsort(pid, kind="stable")
    pid, records = pid[order], records[order]
    cuts = np.flatnonzero(np.diff(pid)) + 1
    for part in np.split(np.arange(len(pid)), cuts):
        if len(part):
            yield int(pid[part[0]]), records[part]


def blocks_batch(parts: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([p for p, _ in parts], pa.int32()),
            pa.array([len(r) for _, r in parts], pa.int32()),
            pa.array([pack(r) for _, r in parts], pa.binary()),
        ],
        names=["pid", "n", "block"],
    )


def exchange(
    df: DataFrame, send: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], targets: int, receive: Callable, dtype: np.dtype, schema: str
) -> DataFrame:
    """``send`` turns rows into packed blocks, each target's blocks meet in one task, and ``receive(pid, records)`` yields its batches."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for p, n, b in zip(batch["pid"].to_pylist(), batch["n"].to_pylist(), batch["block"]):
                held.setdefault(p, []).append(unpack(b.as_buffer(), n, dtype))
        for p in sorted(held):
            yield from receive(p, np.concatenate(held.pop(p)))

    return df.mapInArrow(send, BLOCK_SCHEMA).repartitionById(targets, F.col("pid")).mapInArrow(reduce, schema)


def blocks_of(counts: list[tuple[int, int]], targets: int, rows: int) -> tuple[dict[int, tuple[int, int]], int, dict[int, tuple[int, int, int]]]:
    """Splits over-full targets into pairs of blocks of ``rows`` rows.

    Returns what becomes of each over-full target (its first new target, blocks), the number of targets now, and for each
    new target the one it belongs to and its two blocks.
    """
    hot: dict[int, tuple[int, int]] = {}
    for pid, n in sorted(counts):
        b = -(-n // rows)
        hot[pid] = (targets, b)
        targets += b * b
    origin = {base + i * b + j: (pid, i, j) for pid, (base, b) in hot.items() for i in range(b) for j in range(i, b)}
    return hot, targets, origin


def block_of(keys: np.ndarray, b: int) -> np.ndarray:
    return (mix(keys.view(np.uint64)) % np.uint64(b)).astype(np.int64)


def in_blocks(pid: int, part: np.ndarray, hot: dict[int, tuple[int, int]]) -> Iterator[tuple[int, np.ndarray]]:
    """The records of a target, or of the pairs of blocks it was split into; each record goes to as many as there are blocks."""
    if pid not in hot:
        yield pid, part
        return
    base, b = hot[pid]
    block = block_of(np.ascontiguousarray(part["key"]), b)
    for i in range(b):
        for j in range(i, b):
            some = part[(block == i) | (block == j)]
            if len(some):
                yield base + i * b + j, some


HUB = 100_000  #: rows of one group from which it is joined by itself


def meet(df: DataFrame, groups: DataFrame, on: list[str], many: str, total: int) -> DataFrame:
    """Inner join of rows with the groups they belong to, ``many`` being a group's number of rows and ``total`` all rows.

    The largest groups, ten thousand at most, are sent to every task, so that none of them is brought to one.
    """
    most = max(HUB, total // 10_000)
    if total <= most:
        return df.join(groups, on)
    hubs = groups.where(F.col(many) > most)  # at most total / most rows
    rest = df.join(F.broadcast(hubs.select(*on)), on, "left_anti").join(groups.where(F.col(many) <= most), on)
    return df.join(F.broadcast(hubs), on).unionByName(rest)
