"""Encoding a corpus with a public byte-level BPE vocabulary.

The pattern cuts a text into words, and each word is merged on a contiguous array of ranks: entry i holds where part i
begins and the rank of the pair that parts i and i + 1 would make. The array is scanned for its least rank, the boundary
behind that part is deleted, and the ranks of the part and of the one before it are looked up anew, until no pair has a
rank. Scanning is quadratic, so words of more than ``LONG`` bytes (a pasted blob without a blank) keep their candidates in
a heap over a linked list instead; the merges are the same.

Null and empty texts give an empty list. Text that looks like a special token is ordinary text. The vocabulary is read
once per Python worker from a path, which must be readable on every executor.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread

LONG = 200
KEEP = 400_000  #: words whose ids a worker remembers; then it starts again
#: the published pattern of this vocabulary (fixed value)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_RANK = 1 << 62


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}

    def word(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > LONG:
            return self.long_word(piece)
        get = ranks.get
        begin = list(range(len(piece) + 1))
        rank = [get(piece[i : i + 2], NO_RANK) for i in range(len(piece) - 1)]
        while rank:
            least = min(rank)
            if least == NO_RANK:
                break
            i = rank.index(least)
            del begin[i + 1]
            del rank[i]
            last = len(begin) - 2  # the last part
            if i < last:
                rank[i] = get(piece[begin[i] : begin[i + 2]], NO_RANK)
            if i:
                rank[i - 1] = get(piece[begin[i - 1] : begin[i + 1]], NO_RANK)
        return [ranks[piece[a:b]] for a, b in zip(begin, begin[1:])]

    def long_word(self, piece: bytes) -> list[int]:
        get, n = self.ranks.get, len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at i
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, i, end = heappop(heap)
            if not alive[i] or after[i] >= n or after[after[i]] != end:
                continue
            j = after[i]
            alive[j] = 0
            after[i] = end
            if end < n:
                before[end] = i
                if (r := get(piece[i : after[end]])) is not None:
                    heappush(heap, (r, i, after[end]))
            if (h := before[i]) >= 0 and (r := get(piece[h:end])) is not None:
                heappush(heap, (r, h, end))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        known = self.known
        for w in self.split(text):
            ids = known.get(w)
            if ids is None:
                ids = self.word(w.encode("utf-8", "replace"))
                if len(w) <= LONG:
                    if len(known) >= KEEP:
                        known.clear()
                    known[w] = ids
            out += ids
        return out


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str = PATTERN) -> Encoder:
    with open(path, "rb") as f:
        return Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str = PATTERN, lengths: bool = False) -> DataFrame:
    """(key, ids ARRAY<INT>) of every row; with ``lengths`` (key, tokens INT) instead."""
    path = path or default_vocabulary()
    df = df.select(F.col(key), F.col(text).cast("string").alias("__text"))
    kind = df.schema[0].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                part = batch.slice(s, 1000)
                ids = [own.encode(t) for t in part.column(1).to_pylist()]
                many = np.fromiter(map(len, ids), np.int32, len(ids))
                if lengths:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(many, pa.int32())], names=[key, "tokens"])
                    continue
                flat = np.fromiter((i for x in ids for i in x), np.int32, int(many.sum()))
                column = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many)], pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), column], names=[key, "ids"])

    result = T.StructField("tokens", T.IntegerType()) if lengths else T.StructField("ids", T.ArrayType(T.IntegerType()))
    return spread(df).mapInArrow(run, T.StructType([T.StructField(key, kind), result]))
