"""Delimited records that may be broken: typed columns for those that can be loaded, the reason for the others.

A record is put together from its physical lines by Python's strict csv reader, quotes being what holds lines together. The
reader's structural exceptions become reasons before any field is typed; the quotes it lets pass (within an unquoted field)
are found by the record's grammar. ``reason`` is the first that applies of
``quoting``, ``column_count`` and ``invalid_value``; null means loaded.

Edge cases: a null line has no fields (``column_count``), an empty one has one; a null or unusable separator is a comma;
null keys, repeated keys and repeated lines are kept row by row; lines of any length are read whole.
"""

from __future__ import annotations

import csv
import datetime
import io
import math
import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..chem.validate import is_structure
from ..session import spread

FIELDS = ("_source", "_id", "_molfile", "_molwt", "added_on", "props")
_ID = re.compile(r"[A-Za-z0-9._:-]{1,40}")
_NUMBER = re.compile(r" *[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)? *")
_DAY = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")


class Unloadable(Exception):
    pass


@lru_cache(maxsize=64)
def _grammar(delim: str) -> re.Pattern:
    d = re.escape(delim)
    field = rf'(?:"(?:[^"]++|"")*+"|[^"\r\n{d}]*+)'
    return re.compile(rf"{field}(?:{d}{field})*+")


def fields(line: str | None, delim: str) -> list[str]:
    if line is None:
        raise Unloadable("column_count")
    line = line.removesuffix("\r")
    try:
        rows = list(csv.reader(io.StringIO(line, newline=""), delimiter=delim, strict=True))
    except csv.Error as e:
        raise Unloadable("quoting") from e
    if len(rows) > 1 or not _grammar(delim).fullmatch(line):
        raise Unloadable("quoting")
    return rows[0] if rows and rows[0] else [""]


def weight(text: str) -> float | None:
    if text == "":
        return None
    if not _NUMBER.fullmatch(text) or not math.isfinite(x := float(text)) or x <= 0:
        raise Unloadable("invalid_value")
    return x


def day(text: str) -> datetime.date | None:
    if text == "":
        return None
    if not _DAY.fullmatch(text):
        raise Unloadable("invalid_value")
    try:
        return datetime.date.fromisoformat(text)
    except ValueError as e:
        raise Unloadable("invalid_value") from e


def properties(text: str) -> dict[str, str]:
    """``name=value`` parts between semicolons; of a repeated name the last one."""
    return dict(p.partition("=")[::2] for p in text.split(";") if "=" in p)


def record(line: str | None, delim: str) -> tuple:
    row = fields(line, delim)
    if len(row) != len(FIELDS):
        raise Unloadable("column_count")
    source, ident, mol, molwt, added, props = row
    if not _ID.fullmatch(ident):
        raise Unloadable("invalid_value")
    typed = weight(molwt), day(added)
    if not is_structure(mol):
        raise Unloadable("invalid_value")
    return source or None, ident, mol, *typed, props or None, properties(props)


def load(df: DataFrame, key: str = "raw_id", line: str = "line", delim: str | Column = "delim", loaded: bool = True) -> DataFrame:
    """(key, reason, and the typed fields) of every row; without ``loaded`` only (key, reason) of the rows that fail."""
    df = df.select(F.col(key).cast("long").alias("key"), F.col(line).cast("string").alias("line"), (F.col(delim) if isinstance(delim, str) else delim).cast("string").alias("delim"))
    kinds = [pa.string(), pa.string(), pa.string(), pa.float64(), pa.date32(), pa.string(), pa.map_(pa.string(), pa.string())]
    names = [*FIELDS, "properties"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        for batch in batches:
            for s in range(0, batch.num_rows, 2000):
                part = batch.slice(s, 2000)
                keys, reasons, rows = part["key"].to_pylist(), [], []
                for text, d in zip(part["line"].to_pylist(), part["delim"].to_pylist()):
                    if d is None or len(d) != 1 or d in '"\r\n':
                        d = ","
                    try:
                        rows.append(record(text, d))
                        reasons.append(None)
                    except Unloadable as e:
                        rows.append((None,) * len(names))
                        reasons.append(str(e))
                if not loaded:
                    bad = [i for i, r in enumerate(reasons) if r]
                    yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in bad], pa.int64()), pa.array([reasons[i] for i in bad], pa.string())], names=["key", "reason"])
                    continue
                columns = [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(reasons, pa.string()), *columns], names=["key", "reason", *names])

    schema = "key long, reason string"
    if loaded:
        schema += ", _source string, _id string, _molfile string, _molwt double, added_on date, props string, properties map<string,string>"
    return spread(df).mapInArrow(run, schema).withColumnRenamed("key", key)


LONGEST = 10_000  #: physical lines of a record


def assemble(lines: DataFrame, file: str = "file_name", number: str = "line_no", text: str = "text", block: int = 100_000, columns: int | None = None, delim: str = ",") -> DataFrame:
    """(file, line_no, line): physical lines put together to records, by whether the quotes before a line are balanced.

    The quotes are counted in two steps, within blocks of lines and over blocks, so that a file of any length is spread
    over tasks; a record is as many lines as it has. With ``columns`` a line that is a whole record of so many fields by
    itself always starts one, so that a stray quote spoils no more than the lines up to there. What would be more than
    ``LONGEST`` lines is no record: its lines come out one by one. Null texts are empty lines; line numbers don't repeat
    within a file.
    """
    df = lines.select(F.col(file).alias("f"), F.col(number).cast("long").alias("n"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    df = df.withColumn("q", F.length("t") - F.length(F.replace(F.col("t"), F.lit('"'), F.lit("")))).withColumn("b", F.floor(F.col("n") / block))
    whole = F.lit(False)
    if columns:
        d = re.escape(delim)
        one = rf'(?:"(?:[^"]|"")*+"|[^"{d}]*+)'
        whole = F.col("t").rlike(rf"^{one}(?:{d}{one}){{{columns - 1}}}$")
    inside = Window.partitionBy("f", "b").orderBy("n")
    over = Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)

    def carried(df: DataFrame, value: Column, name: str, total: bool) -> DataFrame:
        """The sum of ``value`` before each line, or its last value at or before it, within blocks and over blocks."""
        f = F.sum if total else F.max
        own = f(value).over(inside) - value if total else f(value).over(inside)
        blocks = df.groupBy("f", "b").agg(f(value).alias("all"))
        blocks = blocks.select(F.col("f").alias("bf"), F.col("b").alias("bb"), f("all").over(over).alias("carry"))
        df = df.withColumn(name, own).join(blocks, df["f"].eqNullSafe(F.col("bf")) & (df["b"] == F.col("bb")))
        both = F.coalesce("carry", F.lit(0)) + F.col(name) if total else F.coalesce(name, "carry")
        return df.withColumn(name, both).drop("bf", "bb", "carry")

    df = carried(df, F.col("q"), "before", True).withColumn("whole", whole)
    if columns:
        df = carried(df, F.when(F.col("whole"), F.struct("n", "before")), "since", False)
    else:
        df = df.withColumn("since", F.lit(None).cast("struct<n:bigint,before:bigint>"))
    starts = F.col("whole") | ((F.col("before") - F.coalesce("since.before", F.lit(0))) % 2 == 0)
    df = carried(df.withColumn("starts", starts), F.when(F.col("starts"), F.col("n")), "rec", False)
    # a record that never ends is no record
    long = df.groupBy("f", "rec").agg(F.count("*").alias("c")).where(F.col("c") > LONGEST).select(F.col("f").alias("lf"), F.col("rec").alias("lr"))
    df = df.join(long, df["f"].eqNullSafe(F.col("lf")) & (df["rec"] == F.col("lr")), "left").withColumn("rec", F.when(F.col("lr").isNull(), F.col("rec")).otherwise(F.col("n")))
    got = df.groupBy("f", "rec").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("parts"))
    return got.select(F.col("f").alias(file), F.col("rec").alias(number), F.array_join(F.col("parts.t"), "\n").alias("line"))
