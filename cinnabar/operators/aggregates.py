"""Facet counts, histograms, field names and the reports made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POPCOUNT_EDGES = (0, 50, 100, 150, 200, 250, 300, 350)
ATOM_EDGES = (0, 10, 20, 30, 40, 50, 100)
WEIGHT_EDGES = (100, 200, 350, 500, 700)


def facet_counts(df: DataFrame, column: str = "_source", top: int | None = 20) -> DataFrame:
    """(value, count) of the ``top`` most frequent values, in order of value; null isn't one."""
    out = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"))
    if top is not None:
        out = out.orderBy(F.desc("count"), "value").limit(top)
    return out.orderBy("value")


def histograms(df: DataFrame, wanted: list[tuple[str, Column, tuple]]) -> DataFrame:
    """(what, bucket, lo, hi, count) of several values: below the first edge, between neighbours (the lower one included), from the last one on.

    One row per bucket, empty ones too; nulls are in none. One pass for all, combined on the map side.
    """
    sums, rows = [], []
    for n, (what, _, edges) in enumerate(wanted):
        if not edges:
            raise ValueError("edges are needed")
        for i, (lo, hi) in enumerate(zip([None, *edges], [*edges, None])):
            test = " and ".join([f"x{n} is not null", *([f"x{n} >= {lo}"] if lo is not None else []), *([f"x{n} < {hi}"] if hi is not None else [])])
            sums.append(F.expr(f"count_if({test})").alias(f"c{n}_{i}"))
            ends = ["cast(null as double)" if e is None else f"cast('{e}' as double)" for e in (lo, hi)]
            rows.append(f"named_struct('what', '{what}', 'bucket', {i}, 'lo', {ends[0]}, 'hi', {ends[1]}, 'count', c{n}_{i})")
    return df.select(*[x.alias(f"x{n}") for n, (_, x, _) in enumerate(wanted)]).agg(*sums).select(F.expr(f"inline(array({', '.join(rows)}))"))


def histogram(df: DataFrame, value: Column, edges) -> DataFrame:
    """(bucket, lo, hi, count) of one value."""
    return histograms(df, [("", value, tuple(edges))]).drop("what")


def field_names(df: DataFrame, props: str = "props") -> DataFrame:
    """(field): names of all properties."""
    return df.select(F.explode(F.map_keys(props)).alias("field")).distinct().orderBy("field")


def stats(df: DataFrame, popcount: Column, atoms: Column, weight: Column) -> DataFrame:
    return histograms(df, [("popcount", popcount, POPCOUNT_EDGES), ("weight", weight, WEIGHT_EDGES), ("atoms", atoms, ATOM_EDGES)])


def screen_efficiency(total: DataFrame, passed: Column) -> DataFrame:
    """(hits, total, efficiency): how much a screen spares."""
    return total.agg(F.count_if(passed).alias("hits"), F.count("*").alias("total")).withColumn("efficiency", F.when(F.col("total") > 0, 1 - F.col("hits") / F.col("total")))
