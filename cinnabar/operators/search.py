"""Similarity, containment, substructure and text search over a molecule table. Every result is totally ordered."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..chem import fingerprints, match, molfile
from ..chem.elements import SYMBOLS
from ..functions import fingerprint as fp
from ..functions import textquery
from ..functions.predicates import all_of
from ..session import spread

BROADCAST_ROWS = 100_000  #: queries that every task may hold; more are taken in parts


def similarity(df: DataFrame, query: list[int], threshold: float, most: int | None = None, *filters: Column, key: str = "doc_key", fingerprint: str = "_fingerprint_sim", popcnt: str | None = None, legacy: bool = False) -> DataFrame:
    """All columns and ``similarity`` of the rows at ``threshold`` or above, the most similar first, then by atoms and key.

    ``popcnt`` names a stored bit count that can be trusted; the window on it is then pushed to the scan. A query without
    a bit is similar to nothing, and at threshold 0 everything with a fingerprint is a hit.
    """
    words = len(query)
    own, mine = fp.words_of(fingerprint, words), fp.literal(query)
    bits = sum(int(w & (1 << 64) - 1).bit_count() for w in query)
    df = df.where(all_of(F.col(fingerprint).isNotNull(), *filters))
    if popcnt:
        df = df.where(fp.in_window(popcnt, bits, threshold))
    similar = fp.tanimoto_legacy(own, mine) if legacy else fp.tanimoto(own, mine, popcnt, str(bits)) if bits else "0D"
    out = df.withColumn("similarity", fp.column(f"coalesce({similar}, 0D)" if legacy else similar))
    out = out.where(F.col("similarity") >= threshold)
    order = [F.desc("similarity"), *([F.asc_nulls_last("_natoms")] if "_natoms" in df.columns else []), F.asc(key)]
    out = out.orderBy(*order)
    return out.limit(most) if most and most > 0 else out


def in_parts(queries: DataFrame) -> list[DataFrame]:
    """A batch of queries in parts of about ``BROADCAST_ROWS``, which a task may hold. Queries are counted when this is called."""
    parts = max(1, -(-queries.count() // BROADCAST_ROWS)) if BROADCAST_ROWS else 1
    if parts == 1:
        return [queries]
    part = F.pmod(F.xxhash64(*queries.columns), F.lit(parts))
    return [queries.where(part == i) for i in range(parts)]


def similarity_join(df: DataFrame, queries: DataFrame, threshold: Column | float, key: str = "doc_key", query_key: str = "query_id", fingerprint: str = "_fingerprint_sim", words: int = fp.WORDS) -> DataFrame:
    """(query key, key, similarity) for every query of a batch against all rows.

    A batch of a checked size is sent to every task, where a window on the number of bits comes before the exact test; a
    larger one is taken in parts of that size, each in a pass of its own over all rows.
    """
    q = queries.where(F.col(fingerprint).isNotNull()).withColumn("__t", F.lit(threshold) if isinstance(threshold, (int, float)) else threshold)
    q = q.select(query_key, "__t", *[fp.column(w).alias(f"q{i}") for i, w in enumerate(fp.words_of(fingerprint, words))])
    q = q.withColumn("qp", fp.column(fp.bits_of([f"q{i}" for i in range(words)])))
    q = q.withColumn("lo", fp.column("ceil(qp * __t - 1e-9D)")).withColumn("hi", fp.column(f"case when __t > 0 then floor(qp / __t + 1e-9D) else {64 * words} end"))
    t = df.where(F.col(fingerprint).isNotNull()).select(key, *[fp.column(w).alias(f"t{i}") for i, w in enumerate(fp.words_of(fingerprint, words))])
    t = t.withColumn("tp", fp.column(fp.bits_of([f"t{i}" for i in range(words)])))
    both = None
    for part in in_parts(q):
        met = t.join(F.broadcast(part), F.col("tp").between(F.col("lo"), F.col("hi")))
        both = met if both is None else both.unionByName(met)
    similarity = fp.tanimoto([f"t{i}" for i in range(words)], [f"q{i}" for i in range(words)], "tp", "qp")
    return both.withColumn("similarity", fp.column(f"coalesce({similarity}, 0D)")).where("similarity >= __t").select(query_key, key, "similarity")


def containment(df: DataFrame, query: list[int], fingerprint: str = "_fingerprint_sim") -> DataFrame:
    """Rows whose fingerprint has all bits of the query: a screen that loses nothing."""
    return df.where(F.col(fingerprint).isNotNull() & fp.column(fp.contains(fp.words_of(fingerprint, len(query)), fp.literal(query))))


def may_contain(matcher: match.Query, structure: str = "_molfile") -> Column:
    """Whether a structure's text names the elements that a query needs, in either notation: a screen that loses nothing."""
    named = []
    for z in sorted(z for z in matcher.need if z != 1):
        s = SYMBOLS[z - 1]
        named.append(F.col(structure).contains(s) | F.col(structure).contains(s.lower()) | F.col(structure).rlike(f"#0*{z}"))
    return all_of(*named)


def substructure(df: DataFrame, query: str, most: int | None = None, *filters: Column, key: str = "doc_key", structure: str = "_molfile", screen: str | None = None, mode: str = "sub", all_hits: bool = False) -> DataFrame:
    """All columns with ``similarity`` and ``hits`` of the rows that contain the query.

    ``hits`` are the target's atoms, from 1, in the order of the query's; null for a hydrogen drawn in the query. ``screen``
    names a stored path fingerprint, which is compared natively before a structure is parsed. Filters run before that too.
    Structures that can't be parsed match nothing; a query that can't be raises.
    """
    q = match.prepared(molfile.read(query))
    matcher = match.Query(q, mode)
    mine = fingerprints.similarity_fingerprint(q)
    df = df.where(all_of(F.col(structure).isNotNull(), *filters, may_contain(matcher, structure)))
    if screen:
        df = containment(df, fingerprints.paths(q), screen)
    # rows pass whole, so that hits needn't be joined to their columns again
    df = df.drop("similarity", "hits")
    hits_type = T.ArrayType(T.ArrayType(T.IntegerType())) if all_hits else T.ArrayType(T.IntegerType())
    schema = T.StructType([*df.schema, T.StructField("similarity", T.DoubleType()), T.StructField("hits", hits_type)])
    at = df.columns.index(structure)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.list_(pa.int32())) if all_hits else pa.list_(pa.int32())
        for batch in batches:
            rows, sims, hits = [], [], []
            for n, text in enumerate(batch.column(at).to_pylist()):
                try:
                    t = molfile.read(text)
                except ValueError:
                    continue
                if not matcher.possible(t):
                    continue
                t = match.prepared(t)
                found = matcher.all(t) if all_hits else matcher.first(t)
                if not found:
                    continue
                one = lambda h: [None if x is None else x + 1 for x in h]
                rows.append(n)
                hits.append([one(h) for h in found] if all_hits else one(found))
                own = fingerprints.similarity_fingerprint(t)
                a, b = ([w & (1 << 64) - 1 for w in x] for x in (own, mine))
                either = sum((x | y).bit_count() for x, y in zip(a, b))
                sims.append(sum((x & y).bit_count() for x, y in zip(a, b)) / either if either else None)
            found = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*found.columns, pa.array(sims, pa.float64()), pa.array(hits, kind)], names=[*found.schema.names, "similarity", "hits"])

    out = spread(df).mapInArrow(run, schema)
    out = out.orderBy(F.desc("similarity"), *([F.asc_nulls_last("_natoms")] if "_natoms" in df.columns else []), key)
    return out.limit(most) if most and most > 0 else out


def substructure_hits(df: DataFrame, queries: list[str], *filters: Column, within: list[str] | None = None, key: str = "doc_key", structure: str = "_molfile") -> DataFrame:
    """(key, hits) of the rows that contain any of a few queries: for each query all its places, as ``substructure`` has them.

    Only rows that contain all of ``within`` count. Each structure is parsed once for all queries, and no similarity is
    counted. Structures that can't be parsed match nothing; a query that can't be raises.
    """
    prepared = lambda texts: [match.Query(match.prepared(molfile.read(x))) for x in texts]
    some, every = prepared(queries), prepared(within or [])
    screen = F.lit(False)
    for x in some:
        screen = screen | may_contain(x, structure)
    df = df.where(all_of(F.col(structure).isNotNull(), *filters, *[may_contain(x, structure) for x in every], screen)).select(key, structure)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hits = [], []
            for n, text in enumerate(batch.column(1).to_pylist()):
                try:
                    t = molfile.read(text)
                except ValueError:
                    continue
                left = [x.possible(t) for x in some]
                if not any(left) or not all(x.possible(t) for x in every):
                    continue
                t = match.prepared(t)
                found = [x.all(t) if may else [] for x, may in zip(some, left)]
                if any(found) and all(x.matches(t) for x in every):
                    rows.append(n)
                    hits.append([[[None if a is None else a + 1 for a in h] for h in x] for x in found])
            keys = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(hits, pa.list_(pa.list_(pa.list_(pa.int32()))))], names=[key, "hits"])

    return spread(df).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, hits array<array<array<int>>>")


def text_fields(df: DataFrame) -> dict[str, Column]:
    """Token arrays of a molecule table: the catch-all ``text``, ``name``, keyword fields and every property on demand."""

    class Fields(dict):
        def __contains__(self, k):
            return True

        def __missing__(self, k):
            return textquery.tokens(F.try_element_at("props", F.lit(k)))

    everything = F.concat_ws(" ", F.col("_source"), F.col("_id"), F.array_join(F.map_values("props"), " "), F.array_join(F.map_keys("props"), " "), F.col("name"))
    return Fields(text=textquery.tokens(everything), name=textquery.tokens(F.col("name")), _id=F.array("_id"), _source=F.array("_source"), _formula=F.array("_formula"), _fields=F.map_keys("props"))


def text(df: DataFrame, query: str | None, most: int | None = None, *filters: Column, key: str = "doc_key", fields: dict[str, Column] | None = None) -> DataFrame:
    """Rows that a query in classic syntax finds, the most relevant first; without a query, what the filters let through."""
    if query is None and not filters:
        raise ValueError("a query or a filter is needed")
    df = df.where(all_of(*filters))
    if query is None:
        out = df.orderBy(key)
        return out.limit(most) if most and most > 0 else out
    fields = fields or text_fields(df)
    parser = textquery.Parser(fields, keyword=frozenset({"_id", "_source", "_formula", "_fields", "_codebook"}))
    tree = parser.tree(query)
    # fields that the leaves name, made once
    used = {x.field: fields[x.field] for x in tree.leaves() if x.words and x.field in fields}
    scores = textquery.relevance(df, tree.leaves(), used, key)
    hit = df.where(F.coalesce(tree.hit, F.lit(False))).join(scores, key, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    hit = hit.orderBy(F.desc("score"), key)
    return hit.limit(most) if most and most > 0 else hit


def substructure_join(df: DataFrame, queries: DataFrame, key: str = "doc_key", structure: str = "_molfile", query_key: str = "query_id", query: str = "query") -> DataFrame:
    """(query key, key, hits) for every query of a batch against all rows; queries that can't be parsed find nothing.

    Each structure is parsed once, and its path fingerprint screens the queries before any is matched. The batch goes to
    every task, so its size is checked; a larger one is taken in parts of that size, each in a pass of its own. Queries are
    read when this is called.
    """
    own = queries.select(F.col(query_key).cast("long").alias("k"), F.col(query).alias("q")).where("q is not null")
    out = None
    for part in in_parts(own):
        texts = [(r["k"], r["q"]) for r in part.collect()]
        found = _matched(df, texts, key, structure, query_key)
        out = found if out is None else out.unionByName(found)
    return out


def _matched(df: DataFrame, texts: list[tuple[int, str]], key: str, structure: str, query_key: str) -> DataFrame:
    schema = f"{query_key} long, {key} {dict(df.dtypes)[key]}, hits array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = []
        for k, text in texts:
            try:
                q = match.prepared(molfile.read(text))
            except ValueError:
                continue
            ready.append((k, match.Query(q), [(i, w) for i, w in enumerate(fingerprints.paths(q)) if w]))
        for batch in batches:
            kind = batch.schema.field(0).type
            rows = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    t = match.prepared(molfile.read(text))
                except ValueError:
                    continue
                bits = fingerprints.paths(t)
                for q, matcher, need in ready:
                    if all(bits[i] & w == w for i, w in need) and (hit := matcher.first(t)):
                        rows.append((q, k, [None if x is None else x + 1 for x in hit]))
            columns = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], kind), pa.array(columns[2], pa.list_(pa.int32()))], names=[query_key, key, "hits"])

    return spread(df.where(F.col(structure).isNotNull()).select(key, structure)).mapInArrow(run, schema)
