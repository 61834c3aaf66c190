"""Codebooks: small random projections of fingerprints, as another way to screen. Seeded, and kept with their counts in a table."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fingerprint as fp

BOOKS, WIDTH = 256, 8


def build(books: int = BOOKS, width: int = WIDTH, bits: int = 512, seed: int = 1) -> list[list[int]]:
    """Each codebook's fingerprint bits, distinct ones."""
    rng = random.Random(seed)
    return [sorted(rng.sample(range(bits), width)) for _ in range(books)]


def code(fingerprint: str, book: list[int]) -> str:
    """Bit i of the code is the fingerprint's bit book[i]; null for a null fingerprint."""
    return f"case when {fingerprint} is not null then " + " + ".join(f"{1 << i} * {fp.bit(fingerprint, b)}" for i, b in enumerate(book)) + " end"


def code_of(query: list[int], book: list[int]) -> int:
    return sum(((query[b // 64] >> b % 64) & 1) << i for i, b in enumerate(book))


def _literal(books: list[list[int]]) -> str:
    return "array(" + ", ".join(f"named_struct('book', {i}, 'bits', array({', '.join(map(str, b))}))" for i, b in enumerate(books)) + ")"


def counts(df: DataFrame, books: list[list[int]], fingerprint: str = "_fingerprint_sim") -> DataFrame:
    """(book, code, count) of all codebooks in one pass, combined on the map side: 2^width rows a book at most."""
    width = max(map(len, books))
    one = " + ".join(f"case when size(bits) > {i} then {1 << i} * bit_get(coalesce(get({fingerprint}, bits[{i}] div 64), 0L), bits[{i}] % 64) else 0 end" for i in range(width))
    if all(len(b) == width for b in books):
        one = " + ".join(f"{1 << i} * bit_get(coalesce(get({fingerprint}, bits[{i}] div 64), 0L), bits[{i}] % 64)" for i in range(width))
    rows = df.where(F.col(fingerprint).isNotNull()).select(fingerprint, F.expr(f"inline({_literal(books)})"))
    return rows.select("book", F.expr(one).alias("code")).groupBy("book", "code").agg(F.count("*").alias("count"))


def save(counted: DataFrame, books: list[list[int]], path: str) -> None:
    """Writes (book, bits, counts): each codebook's bits and how many rows have each code, as one row."""
    spark = counted.sparkSession
    have = spark.createDataFrame([(i, b) for i, b in enumerate(books)], "book int, bits array<int>")
    by_book = counted.groupBy("book").agg(F.map_from_entries(F.collect_list(F.struct("code", "count"))).alias("counts"))  # 2^width entries a book
    have.join(by_book, "book", "left").select("book", "bits", F.coalesce("counts", F.create_map().cast("map<int,bigint>")).alias("counts")).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> tuple[list[list[int]], DataFrame]:
    """The codebooks and their (book, code, count), as ``save`` left them."""
    t = spark.read.parquet(path)
    books = [r["bits"] for r in t.select("book", "bits").orderBy("book").collect()]
    return books, t.select("book", F.explode("counts").alias("code", "count"))


def best(table: DataFrame, books: list[list[int]], query: list[int]) -> int | None:
    """The codebook whose codes that contain the query's are fewest rows; None where no codebook excludes anything."""
    wanted = [code_of(query, b) for b in books]
    have: dict[int, int] = {}
    for r in table.collect():  # at most 2^width rows a book
        if r["code"] & wanted[r["book"]] == wanted[r["book"]]:
            have[r["book"]] = have.get(r["book"], 0) + r["count"]
    usable = {i: have.get(i, 0) for i, w in enumerate(wanted) if w}
    return min(usable, key=lambda i: (usable[i], i)) if usable else None


def screen(df: DataFrame, book: list[int], query: list[int], fingerprint: str = "_fingerprint_sim") -> DataFrame:
    """Rows whose code contains the query's."""
    want = code_of(query, book)
    return df.where(f"(({code(fingerprint, book)}) & {want}) = {want}")


def screened(df: DataFrame, books: list[list[int]], query: list[int], counted: DataFrame | None = None, fingerprint: str = "_fingerprint_sim") -> DataFrame:
    """Rows whose fingerprint has all bits of the query: the cheapest codebook by its counts screens, containment decides.

    The counts are read, or made, when this is called: 2^width numbers a book.
    """
    b = best(counts(df, books, fingerprint) if counted is None else counted, books, query)
    some = df if b is None else screen(df, books[b], query, fingerprint)
    return some.where(F.col(fingerprint).isNotNull() & fp.column(fp.contains(fp.words_of(fingerprint, len(query)), fp.literal(query))))
