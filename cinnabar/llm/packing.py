"""Filling containers of fixed capacity with texts, at target proportions of their sources.

Texts are dealt by the hash of their key to partitions of many windows. In a partition every source has a queue. For each
window, deficit round-robin gives each queue its share of the window's tokens on top of what it was owed, and takes texts
while they fit what the queue has; what remains is carried to the next window. A partition starts with what the
partitions before it left owing, known from totals per partition and source. A window's texts go, largest first, where
they leave the least space, among the containers still open; so only a partition's last containers are left with space.

A text that exceeds the capacity is cut into full containers and a rest; no other text is cut. Every text comes out, null
and empty ones with 0 tokens at some place; null sources are a source; rows with a null or repeated key are texts too.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from . import bpe

CAPACITY = 2048
WINDOW = 64  #: containers of a window
PARTITION = 2500  #: containers of a partition


class Bins:
    """Open containers by the space they have; the fullest with room for an item is the lowest set bit of a mask."""

    def __init__(self, capacity: int):
        self.capacity, self.made, self.mask = capacity, 0, 0
        self.with_space: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, size: int) -> tuple[int, int]:
        """(container, place) for an item."""
        fits = self.mask >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            box = self.with_space[space].pop()
            if not self.with_space[space]:
                self.mask &= ~(1 << space)
        else:
            box, space = self.made, self.capacity
            self.made += 1
        left = space - size
        if left or not size:
            self.with_space[left].append(box)
            self.mask |= 1 << left
        return box, self.capacity - space

    def full(self) -> int:
        self.made += 1
        return self.made - 1


def fill(source: list, tokens: list[int], share: dict, owed: dict, capacity: int = CAPACITY, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(item, piece, container, place, tokens) of a partition's items."""
    bins, out = Bins(capacity), []
    queues: dict = {}
    for i, (s, n) in enumerate(zip(source, tokens)):
        piece = 0
        while n - piece * capacity > capacity:
            out.append((i, piece, bins.full(), 0, capacity))
            piece += 1
        queues.setdefault(s, deque()).append((i, piece, n - piece * capacity))
    has = {s: float(owed.get(s, 0.0)) for s in queues}
    while queues:
        whole = sum(share.get(s, 0.0) for s in queues)
        taken = []
        for s in sorted(queues, key=str):
            q = queues[s]
            has[s] += window * capacity * (share.get(s, 0.0) / whole if whole else 1 / len(queues))
            while q and q[0][2] <= has[s]:
                taken.append(q.popleft())
                has[s] -= taken[-1][2]
        queues = {s: q for s, q in queues.items() if q}
        for i, piece, n in sorted(taken, key=lambda x: -x[2]):
            out.append((i, piece, *bins.put(n), n))
    return out


def pack(df: DataFrame, key: str = "doc_id", source: str = "source", tokens: str = "tokens", capacity: int = CAPACITY, shares: dict | None = None) -> DataFrame:
    """(key, piece, container, place, tokens): one row for each text, or for each piece of a text that had to be cut.

    ``shares``: each source's part of the tokens, of any number of sources; by default what it has in the table. Sources
    that aren't named get what the others leave.
    """
    items = cut(df.select(F.col(key).cast("long").alias("key"), F.col(source).cast("string").alias("source"), F.coalesce(F.col(tokens), F.lit(0)).cast("long").alias("n")))
    total = items.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // (capacity * PARTITION)))
    items = items.withColumn("pid", F.pmod(F.xxhash64("key", "n"), F.lit(parts)).cast("int"))
    by = cut(items.groupBy("pid", "source").agg(F.sum("n").alias("n")))
    if shares is None:
        wanted = by.groupBy(F.col("source").alias("of")).agg((F.sum("n") / max(total, 1)).alias("share"))
    else:
        wanted = df.sparkSession.createDataFrame([(s, float(v)) for s, v in shares.items()], "of string, share double")
    # what each partition's queues are owed at its start: targets so far less tokens so far
    before = lambda w: w.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    size = by.groupBy("pid").agg(F.sum("n").alias("size")).withColumn("sizes", F.coalesce(F.sum("size").over(before(Window.partitionBy(F.lit(0)))), F.lit(0)))  # a row for each partition
    owed = by.withColumn("had", F.coalesce(F.sum("n").over(before(Window.partitionBy("source"))), F.lit(0))).join(size, "pid")
    owed = owed.join(wanted, owed["source"].eqNullSafe(wanted["of"]), "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    owed = owed.select("pid", F.struct("source", "share", (F.col("share") * F.col("sizes") - F.col("had")).alias("owed")).alias("s"))
    owed = owed.groupBy("pid").agg(F.collect_list("s").alias("mix"))  # the sources that a partition has
    placed = items.select("pid", "key", "source", "n", F.lit(None).cast(owed.schema["mix"].dataType).alias("mix")).unionByName(owed.selectExpr("pid", "cast(null as long) key", "cast(null as string) source", "cast(null as long) n", "mix"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            pid = batch["pid"].to_numpy()
            for p in np.unique(pid):
                some = batch.filter(pa.array(pid == p))
                rows, mix = held.setdefault(int(p), ([], []))
                marked = some["mix"].is_valid()
                mix += [x for m in some["mix"].filter(marked).to_pylist() for x in m]
                rows.append(some.filter(pc.invert(marked)).select(["key", "source", "n"]))
        for p in sorted(held):
            rows, mix = held.pop(p)
            t = pa.Table.from_batches(rows)
            keys, n = t["key"].to_pylist(), t["n"].to_numpy()
            # an order that doesn't depend on how the rows arrived
            order = sorted(range(len(keys)), key=lambda i: (keys[i] is None, (keys[i] or 0) * 0x9E3779B97F4A7C15 & (1 << 64) - 1, keys[i] or 0, int(n[i])))
            source = t["source"].to_pylist()
            out = fill([source[i] for i in order], [int(n[i]) for i in order], {x["source"]: x["share"] for x in mix}, {x["source"]: x["owed"] for x in mix}, capacity)
            for s in range(0, len(out), 50_000):
                i, piece, box, place, size = zip(*out[s : s + 50_000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[order[x]] for x in i], pa.int64()), pa.array(piece, pa.int32()), pa.array([(p << 32) + b for b in box], pa.int64()), pa.array(place, pa.int32()), pa.array(size, pa.int32())],
                    names=["key", "piece", "container", "place", "tokens"],
                )

    out = placed.repartitionById(parts, F.col("pid")).mapInArrow(run, "key long, piece int, container long, place int, tokens int")
    return out.withColumnRenamed("key", key)


def pack_texts(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """``pack`` for texts measured in tokens."""
    sized = df.select(F.struct(F.col(key).cast("long").alias("key"), F.col(source).cast("string").alias("source")).alias("who"), F.col(text).alias("text"))
    sized = bpe.encode(sized, "who", "text", path, lengths=True).select(F.col("who.key").alias(key), F.col("who.source").alias(source), "tokens")
    return pack(sized, key, source, "tokens", capacity)
