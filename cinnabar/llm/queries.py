"""Queries over the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import bpe, cluster, diverse, knn, mojibake, packing, pairs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


#: pairs of molecules (ka < kb) with the similarity s of their fingerprints, by comparing all with all
_ALL_PAIRS = (
    "m AS (SELECT doc_key AS k, _source AS src, "
    + ", ".join(f"_fingerprint_sim[{i}] AS w{i}" for i in range(1, 9))
    + ", list_sum(list_transform(_fingerprint_sim, lambda x: bit_count(x)::INT)) AS p FROM molecules WHERE _fingerprint_sim IS NOT NULL), "
    + "c AS (SELECT a.k AS ka, b.k AS kb, a.src AS sa, b.src AS sb, a.p + b.p AS p, "
    + " + ".join(f"bit_count(a.w{i} & b.w{i})::INT" for i in range(1, 9))
    + " AS i FROM m a JOIN m b ON a.k < b.k AND a.p > 0 AND b.p > 0), s AS (SELECT ka, kb, sa, sb, i / (p - i)::DOUBLE AS s FROM c)"
)
ORACLE["p3_found"] = f"WITH {_ALL_PAIRS} SELECT ka AS key_a, kb AS key_b FROM s WHERE s >= 0.8 AND sa <> sb"
ORACLE["p4_found"] = (
    f"WITH {_ALL_PAIRS}, e AS (SELECT ka AS k, kb AS o, s FROM s WHERE s >= 0.6 UNION ALL SELECT kb, ka, s FROM s WHERE s >= 0.6), "
    "r AS (SELECT k, o, row_number() OVER (PARTITION BY k ORDER BY s DESC, o) AS n FROM e) SELECT DISTINCT least(k, o) AS key_a, greatest(k, o) AS key_b FROM r WHERE n <= 5"
)
ORACLE["p5_found"] = (
    f"WITH RECURSIVE {_ALL_PAIRS}, e AS (SELECT ka AS k, kb AS o FROM s WHERE s >= 0.6 UNION ALL SELECT kb, ka FROM s WHERE s >= 0.6), "
    "x AS (SELECT DISTINCT k, k AS o FROM e UNION SELECT x.k, e.o FROM x JOIN e ON x.o = e.k), g AS (SELECT k, min(o) AS root, count(*) AS n FROM x GROUP BY k) "
    "SELECT k AS doc_key, root AS cluster_key FROM g WHERE n >= 3"
)


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p1_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with the chosen one that stands for it."""
    return diverse.coverage(table(spark, sf_dir, "molecules"), 200)


@query
def p1_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diverse.subset(table(spark, sf_dir, "molecules"), 200)


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.pairs_across(table(spark, sf_dir, "molecules")).select("key_a", "key_b")


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.neighbour_pairs(table(spark, sf_dir, "molecules"))


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.clusters(table(spark, sf_dir, "molecules"))


@query
def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.described(table(spark, sf_dir, "molecules"))


@query
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


@query
def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents"))


@query
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.affected(table(spark, sf_dir, "documents"))


@query
def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.restored(table(spark, sf_dir, "documents"))
