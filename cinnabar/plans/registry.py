"""Every query of the library over the driver's tables, with its equivalent SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..chem import graph
from ..functions import fingerprint as fp
from ..functions import predicates as p
from ..functions import textquery
from ..operators import aggregates, codebook, search
from ..session import cut, scratch, spread, table
from ..sources import records, store, structures
from . import structure_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: query fingerprint of the single-query examples (8 words)
ONE = [1191202118620432384, 74454598142665224, 18015231733268548, 81372719218690, 2308695142376407040, 1125424038464, 18577353194096640, 144186261262958866]
#: some of its bits
FEW = [ONE[0], 0, 0, 0, ONE[4], 0, 0, 0]
BOOKS = codebook.build()


def _sql_list(words: list[int]) -> str:
    return "[" + ", ".join(map(str, words)) + "]::BIGINT[]"


_COMMON = "list_sum(list_transform(list_zip({a}, {b}), lambda z: bit_count(z[1] & z[2])))"
_EITHER = "list_sum(list_transform(list_zip({a}, {b}), lambda z: bit_count(z[1] | z[2])))"


def _sim(a: str, b: str) -> str:
    return f"({_COMMON.format(a=a, b=b)} / {_EITHER.format(a=a, b=b)}::DOUBLE)"


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "molecules")


# similarity


@query(f"SELECT doc_key, _source, {_sim('_fingerprint_sim', _sql_list(ONE))} AS similarity FROM molecules WHERE _fingerprint_sim IS NOT NULL AND {_sim('_fingerprint_sim', _sql_list(ONE))} >= 0.25")
def similarity_threshold(spark, d):
    return search.similarity(molecules(spark, d), ONE, 0.25).select("doc_key", "_source", "similarity")


@query(f"SELECT doc_key, {_sim('_fingerprint_sim', _sql_list(ONE))} AS similarity FROM molecules WHERE _fingerprint_sim IS NOT NULL ORDER BY similarity DESC, _natoms NULLS LAST, doc_key LIMIT 25")
def similarity_topk(spark, d):
    return search.similarity(molecules(spark, d), ONE, 0.0, 25).select("doc_key", "similarity")


@query(
    f"SELECT doc_key, {_sim('_fingerprint_sim', _sql_list(ONE))} AS similarity FROM molecules WHERE _fingerprint_sim IS NOT NULL AND {_sim('_fingerprint_sim', _sql_list(ONE))} >= 0.15 AND _molwt >= 200 AND _natoms > 20 AND _natoms <= 60"
)
def similarity_filtered(spark, d):
    m = molecules(spark, d)
    return search.similarity(m, ONE, 0.15, None, p.double_range(m, "_molwt", 200), p.int_range(m, "_natoms", 20, 60, lo_inc=False)).select("doc_key", "similarity")


def _saved(spark, d) -> DataFrame:
    return table(spark, d, "saved_queries").where("kind = 'similarity'")


_PAIR_SIM = f"coalesce({_COMMON.format(a='m._fingerprint_sim', b='q._fingerprint_sim')} / nullif({_EITHER.format(a='m._fingerprint_sim', b='q._fingerprint_sim')}, 0)::DOUBLE, 0)"


@query(
    f"""SELECT q.query_id, m.doc_key, {_PAIR_SIM} AS similarity FROM molecules m, saved_queries q
WHERE q.kind = 'similarity' AND q._fingerprint_sim IS NOT NULL AND m._fingerprint_sim IS NOT NULL AND {_PAIR_SIM} >= coalesce(q.threshold, 0.8)"""
)
def similarity_batch_join(spark, d):
    """Every saved similarity query, at its own threshold, against all molecules."""
    return search.similarity_join(molecules(spark, d), _saved(spark, d), F.coalesce("threshold", F.lit(0.8)))


@query(f"SELECT doc_key FROM molecules WHERE _fingerprint_sim IS NOT NULL AND {_COMMON.format(a='_fingerprint_sim', b=_sql_list(FEW[:1] + [0] * 7))} = {bin(FEW[0] & (1 << 64) - 1).count('1')}")
def fp_containment_screen(spark, d):
    return search.containment(molecules(spark, d), FEW[:1] + [0] * 7).select("doc_key")


def _bit_sql(b: int) -> str:
    word, at = b // 64 + 1, b % 64
    return f"(CASE WHEN _fingerprint_sim[{word}] & ({(1 << at) if at < 63 else -(1 << 63)})::BIGINT <> 0 THEN 1 ELSE 0 END)" if at < 63 else f"(CASE WHEN _fingerprint_sim[{word}] < 0 THEN 1 ELSE 0 END)"


def _code_sql(book: list[int]) -> str:
    return "(" + " + ".join(f"{1 << i} * {_bit_sql(b)}" for i, b in enumerate(book)) + ")"


@query(f"SELECT doc_key FROM molecules WHERE _fingerprint_sim IS NOT NULL AND {_COMMON.format(a='_fingerprint_sim', b=_sql_list(FEW))} = {sum(bin(w & (1 << 64) - 1).count('1') for w in FEW)}")
def codebook_screen(spark, d):
    """Containment by way of the cheapest of all codebooks for this query."""
    return codebook.screened(molecules(spark, d), BOOKS, FEW).select("doc_key")


@query(f"SELECT doc_key, {_code_sql(BOOKS[0])} AS code FROM molecules WHERE _fingerprint_sim IS NOT NULL AND ({_code_sql(BOOKS[0])} & {codebook.code_of(ONE, BOOKS[0])}) = {codebook.code_of(ONE, BOOKS[0])}")
def codebook_codes(spark, d):
    out = codebook.screen(molecules(spark, d), BOOKS[0], ONE)
    return out.select("doc_key", F.expr(codebook.code("_fingerprint_sim", BOOKS[0])).alias("code"))


_COUNTS_SQL = (
    "WITH books AS (SELECT unnest([" + ", ".join(f"{{'book': {i}, 'bits': {b}}}" for i, b in enumerate(BOOKS)) + "], recursive := true)) "
    "SELECT book, list_sum(list_transform(bits, lambda x, i: (CASE WHEN x % 64 = 63 THEN _fingerprint_sim[x // 64 + 1] < 0 ELSE _fingerprint_sim[x // 64 + 1] & (1::BIGINT << (x % 64)) <> 0 END)::INT * (1 << (i - 1))))::INT AS code, count(*) AS count "
    "FROM molecules, books WHERE _fingerprint_sim IS NOT NULL GROUP BY 1, 2"
)


@query(_COUNTS_SQL)
def codebook_counts(spark, d):
    return codebook.counts(molecules(spark, d), BOOKS)


@query(_COUNTS_SQL)
def codebooks_kept(spark, d):
    """The counters of all codebooks, written with them and read again."""
    path = scratch(spark)
    codebook.save(codebook.counts(molecules(spark, d), BOOKS), BOOKS, path)
    return codebook.load(spark, path)[1]


@query(f"WITH t AS (SELECT {_COMMON.format(a='_fingerprint_sim', b=_sql_list(FEW[:1] + [0] * 7))} = {bin(FEW[0] & (1 << 64) - 1).count('1')} AS ok FROM molecules) SELECT count_if(ok) AS hits, count(*) AS total, 1 - count_if(ok) / count(*)::DOUBLE AS efficiency FROM t")
def screen_efficiency(spark, d):
    q = FEW[:1] + [0] * 7
    return aggregates.screen_efficiency(molecules(spark, d), fp.column(fp.contains(fp.words_of("_fingerprint_sim"), fp.literal(q))) & F.col("_fingerprint_sim").isNotNull())


# filters


@query("SELECT doc_key, _id FROM molecules WHERE _source = 'lagoon'")
def term_filter(spark, d):
    m = molecules(spark, d)
    return m.where(p.term(m, "_source", "lagoon")).select("doc_key", "_id")


_TOKENS_SQL = "list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '' AND len(x) <= 255)"


@query(f"SELECT doc_key FROM molecules WHERE list_contains({_TOKENS_SQL.format(x='name')}, 'acid')")
def term_of_analysed_field(spark, d):
    m = molecules(spark, d)
    return m.where(p.term(m, "name", "acid")).select("doc_key")


_WHOLE_SQL = "CASE WHEN regexp_full_match(props['{k}'], '[+-]?[0-9]+') THEN try_cast(props['{k}'] AS {t}) END"
_DOUBLE_SQL = "CASE WHEN regexp_full_match(props['{k}'], '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(props['{k}'] AS DOUBLE) END"


@query(f"SELECT doc_key FROM molecules WHERE {_WHOLE_SQL.format(k='prop1', t='INT')} > 0 AND {_WHOLE_SQL.format(k='prop1', t='INT')} < 1000")
def int_range_prop(spark, d):
    m = molecules(spark, d)
    return m.where(p.int_range(m, "prop1", 0, 1000, False, False)).select("doc_key")


@query(f"SELECT doc_key FROM molecules WHERE {_WHOLE_SQL.format(k='purity', t='BIGINT')} >= 100")
def long_range_prop(spark, d):
    m = molecules(spark, d)
    return m.where(p.long_range(m, "purity", 100)).select("doc_key")


@query(f"SELECT doc_key FROM molecules WHERE {_DOUBLE_SQL.format(k='prop1')} >= 3 AND {_DOUBLE_SQL.format(k='prop1')} < 400.5")
def double_range_open(spark, d):
    m = molecules(spark, d)
    return m.where(p.double_range(m, "prop1", 3, 400.5, hi_inc=False)).select("doc_key")


@query(f"SELECT doc_key FROM molecules WHERE {_DOUBLE_SQL.format(k='logp')} IS NOT NULL")
def property_exists_as_number(spark, d):
    m = molecules(spark, d)
    return m.where(p.double_range(m, "logp")).select("doc_key")


@query("SELECT doc_key FROM molecules WHERE _source = 'ostrel' AND _natoms > 40 AND _molwt >= 300")
def bool_and_filters(spark, d):
    m = molecules(spark, d)
    return m.where(p.all_of(p.term(m, "_source", "ostrel"), p.int_range(m, "_natoms", 40, None, False), p.double_range(m, "_molwt", 300))).select("doc_key")


@query("SELECT doc_key FROM molecules WHERE _natoms BETWEEN 20 AND 42 AND _molwt BETWEEN 150.5 AND 400 AND _nbonds <> 30")
def cli_filter(spark, d):
    m = molecules(spark, d)
    return m.where(p.parse_filter(m, "_natoms", "20:42") & p.parse_filter(m, "_molwt", "150.5:400") & ~p.parse_filter(m, "_nbonds", "=30")).select("doc_key")


_FILTERED_SQL = """SELECT q.query_id, m.doc_key FROM molecules m, saved_queries q WHERE q.kind = 'filter'
AND len(list_filter(coalesce(q.filters, []), lambda f: NOT coalesce(
 CASE f.field WHEN '_natoms' THEN m._natoms::DOUBLE WHEN '_nbonds' THEN m._nbonds::DOUBLE WHEN '_molwt' THEN m._molwt WHEN '_popcount' THEN m._popcount::DOUBLE
 ELSE CASE WHEN f.type = 'double' AND regexp_full_match(m.props[f.field], '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(m.props[f.field] AS DOUBLE)
  WHEN f.type <> 'double' AND regexp_full_match(m.props[f.field], '[+-]?[0-9]+') THEN CASE WHEN f.type = 'int' THEN try_cast(m.props[f.field] AS INT)::DOUBLE ELSE try_cast(m.props[f.field] AS BIGINT)::DOUBLE END END END
 BETWEEN coalesce(f.lo, '-infinity'::DOUBLE) AND coalesce(f.hi, 'infinity'::DOUBLE)
 AND (f.lo IS NULL OR f.lo_inc OR CASE f.field WHEN '_natoms' THEN m._natoms::DOUBLE WHEN '_nbonds' THEN m._nbonds::DOUBLE WHEN '_molwt' THEN m._molwt WHEN '_popcount' THEN m._popcount::DOUBLE ELSE try_cast(m.props[f.field] AS DOUBLE) END <> f.lo)
 AND (f.hi IS NULL OR f.hi_inc OR CASE f.field WHEN '_natoms' THEN m._natoms::DOUBLE WHEN '_nbonds' THEN m._nbonds::DOUBLE WHEN '_molwt' THEN m._molwt WHEN '_popcount' THEN m._popcount::DOUBLE ELSE try_cast(m.props[f.field] AS DOUBLE) END <> f.hi), false))) = 0"""


@query(f"SELECT query_id, count(*) AS rows FROM ({_FILTERED_SQL}) GROUP BY query_id")
def saved_filters(spark, d):
    """How many molecules each saved filter query lets through: filters are data here, applied to all rows in one pass."""
    return filter_counts(molecules(spark, d), table(spark, d, "saved_queries").where("kind = 'filter'"))


def filter_counts(m: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, rows): a batch of a checked size is sent to every task, a larger one part by part."""
    q = queries.select("query_id", "filters")
    m = m.select("_natoms", "_nbonds", "_molwt", "_popcount", "props")

    def value(f):
        text = F.try_element_at("props", f["field"])
        prop = F.when(f["type"] == "double", p.typed(text, "double")).when(f["type"] == "int", p.typed(text, "int").cast("double")).otherwise(p.typed(text, "long").cast("double"))
        return (
            F.when(f["field"] == "_natoms", F.col("_natoms").cast("double"))
            .when(f["field"] == "_nbonds", F.col("_nbonds").cast("double"))
            .when(f["field"] == "_molwt", F.col("_molwt"))
            .when(f["field"] == "_popcount", F.col("_popcount").cast("double"))
            .otherwise(prop)
        )

    def holds(f):
        x = value(f)
        lo = f["lo"].isNull() | (x > f["lo"]) | (f["lo_inc"] & (x == f["lo"]))
        hi = f["hi"].isNull() | (x < f["hi"]) | (f["hi_inc"] & (x == f["hi"]))
        return F.coalesce(x.isNotNull() & lo & hi, F.lit(False))

    found = [m.join(F.broadcast(part), F.coalesce(F.forall("filters", holds), F.lit(True))).groupBy("query_id").agg(F.count("*").alias("rows")) for part in search.in_parts(q)]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out if len(found) == 1 else out.groupBy("query_id").agg(F.sum("rows").alias("rows"))


@query(f"SELECT doc_key, {_bit_sql(3)} = 1 AS bit3, {_bit_sql(63)} = 1 AS bit63, {_bit_sql(300)} = 1 AS bit300 FROM molecules WHERE _fingerprint_sim IS NOT NULL")
def fingerprint_bits(spark, d):
    bits = [F.expr(f"{fp.bit('_fingerprint_sim', i)} = 1").alias(f"bit{i}") for i in (3, 63, 300)]
    return molecules(spark, d).where("_fingerprint_sim is not null").select("doc_key", *bits)


@query("SELECT doc_key, list_aggregate(list_transform(_fingerprint_sim, lambda x: lpad(to_hex(x), 16, '0')), 'string_agg', '') AS hex FROM molecules WHERE _fingerprint_sim IS NOT NULL")
def fingerprint_hex(spark, d):
    return molecules(spark, d).where("_fingerprint_sim is not null").select("doc_key", F.expr(fp.to_hex("_fingerprint_sim")).alias("hex"))


@query(f"SELECT doc_key FROM molecules WHERE _fingerprint_sim IS NOT NULL AND list_sum(list_transform(_fingerprint_sim, lambda x: bit_count(x)::INT)) BETWEEN {fp.popcount_window(65, 0.8)[0]} AND {fp.popcount_window(65, 0.8)[1]}")
def popcount_window(spark, d):
    return molecules(spark, d).where("_fingerprint_sim is not null").where(fp.in_window(fp.bits_of(fp.words_of("_fingerprint_sim")), 65, 0.8)).select("doc_key")


@query("SELECT doc_key, coalesce(nullif(trim(name), ''), lpad(doc_key::VARCHAR, 10, '0')) AS record_id, props['prop1'] AS prop1 FROM molecules")
def record_ids_and_property(spark, d):
    return molecules(spark, d).select("doc_key", structures.record_id(F.col("name"), number=F.col("doc_key")).alias("record_id"), F.try_element_at("props", F.lit("prop1")).alias("prop1"))


@query("SELECT DISTINCT file_name, regexp_replace(file_name, '(.)\\.[^.]*$', '\\1') AS source FROM raw_records")
def source_from_file_name(spark, d):
    return table(spark, d, "raw_records").select("file_name").distinct().withColumn("source", structures.source_of(F.col("file_name")))


@query("SELECT hit_id, list_transform(hits, lambda x: x - 1) AS places FROM search_hits WHERE hits IS NOT NULL")
def hit_places(spark, d):
    """Hits counted from 0."""
    return table(spark, d, "search_hits").where("hits is not null").select("hit_id", F.transform("hits", lambda x: x - 1).alias("places"))


@query(f"SELECT doc_key FROM molecules WHERE _fingerprint_sim IS NOT NULL AND {_code_sql(BOOKS[1])} IN (1, 3, 7)")
def code_disjunction(spark, d):
    return molecules(spark, d).where(f"({codebook.code('_fingerprint_sim', BOOKS[1])}) in (1, 3, 7)").select("doc_key")


# aggregates


@query("SELECT value, count FROM (SELECT _source AS value, count(*) AS count FROM molecules WHERE _source IS NOT NULL GROUP BY 1 ORDER BY count DESC, value LIMIT 20) ORDER BY value")
def facet_source_top20(spark, d):
    return aggregates.facet_counts(molecules(spark, d))


@query("SELECT _source AS value, count(*) AS count FROM molecules WHERE _source IS NOT NULL GROUP BY 1")
def source_listing(spark, d):
    return aggregates.facet_counts(molecules(spark, d), top=None)


def _histogram_sql(value: str, edges, source: str = "molecules", what: str | None = None) -> str:
    parts = []
    for i, (lo, hi) in enumerate(zip([None, *edges], [*edges, None])):
        test = " AND ".join([f"({value}) IS NOT NULL"] + ([f"({value}) >= {lo}"] if lo is not None else []) + ([f"({value}) < {hi}"] if hi is not None else []))
        parts.append(f"SELECT {i} AS bucket, {'NULL' if lo is None else lo}::DOUBLE AS lo, {'NULL' if hi is None else hi}::DOUBLE AS hi, count_if({test}) AS count" + (f", '{what}' AS what" if what else "") + f" FROM {source}")
    return " UNION ALL ".join(parts)


_POP = "CASE WHEN _fingerprint_sim IS NOT NULL THEN list_sum(list_transform(_fingerprint_sim, lambda x: bit_count(x))) END"


@query(_histogram_sql(_POP, (0, 40, 60, 80, 100)))
def popcount_histogram(spark, d):
    return aggregates.histogram(molecules(spark, d), fp.column(fp.popcount("_fingerprint_sim")), (0, 40, 60, 80, 100))


@query(_histogram_sql("_natoms", (10, 30, 50)))
def numeric_histogram_int(spark, d):
    return aggregates.histogram(molecules(spark, d), F.col("_natoms"), (10, 30, 50))


@query(_histogram_sql(_WHOLE_SQL.format(k="purity", t="BIGINT"), (10, 100, 500)))
def numeric_histogram_long(spark, d):
    m = molecules(spark, d)
    return aggregates.histogram(m, p.numeric(m, "purity", "long"), (10, 100, 500))


@query(_histogram_sql(_DOUBLE_SQL.format(k="logp"), (0, 2.5, 50)))
def numeric_histogram_double(spark, d):
    m = molecules(spark, d)
    return aggregates.histogram(m, p.numeric(m, "logp", "double"), (0, 2.5, 50))


@query(" UNION ALL ".join(_histogram_sql(v, e, what=w) for w, v, e in (("popcount", _POP, aggregates.POPCOUNT_EDGES), ("weight", "_molwt", aggregates.WEIGHT_EDGES), ("atoms", "_natoms", aggregates.ATOM_EDGES))))
def stats_report(spark, d):
    return aggregates.stats(molecules(spark, d), fp.column(fp.popcount("_fingerprint_sim")), F.col("_natoms"), F.col("_molwt"))


@query("SELECT DISTINCT unnest(map_keys(props)) AS field FROM molecules")
def field_names(spark, d):
    return aggregates.field_names(molecules(spark, d))


@query("SELECT count(*) AS size FROM molecules")
def size(spark, d):
    return molecules(spark, d).agg(F.count("*").alias("size"))


@query("SELECT doc_key, _id, _source FROM molecules")
def match_all(spark, d):
    return molecules(spark, d).select("doc_key", "_id", "_source")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2")
def group_totals(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


# text


_TOKENS_SQL = _TOKENS_SQL.format(x="text")


def _documents(spark, d) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", textquery.tokens(F.col("text"), stop=False).alias("t"))


def _find(spark, d, q: str) -> DataFrame:
    df = _documents(spark, d)
    return df.where(textquery.Parser({"text": F.col("t")})(q)).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE list_contains({_TOKENS_SQL}, 'pipette')")
def text_term(spark, d):
    return _find(spark, d, "pipette")


@query(f"SELECT doc_id FROM documents WHERE list_contains({_TOKENS_SQL}, 'pipette') AND NOT list_contains({_TOKENS_SQL}, 'oven') OR list_contains({_TOKENS_SQL}, 'prüfbericht') AND NOT list_contains({_TOKENS_SQL}, 'oven')")
def text_boolean(spark, d):
    return _find(spark, d, "(pipette OR Prüfbericht) NOT oven")


@query(f"SELECT doc_id FROM documents WHERE contains(' ' || list_aggregate({_TOKENS_SQL}, 'string_agg', ' ') || ' ', ' short answer ')")
def text_phrase(spark, d):
    return _find(spark, d, '"short answer"')


@query(f"SELECT doc_id FROM documents WHERE len(list_filter({_TOKENS_SQL}, lambda x: starts_with(x, 'xan') OR regexp_full_match(x, 'st.le'))) > 0")
def text_prefix_wildcard(spark, d):
    return _find(spark, d, "xan* st?le")


@query(f"SELECT doc_id FROM documents WHERE len(list_filter({_TOKENS_SQL}, lambda x: levenshtein(x, 'pipete') <= 2)) > 0")
def text_fuzzy(spark, d):
    return _find(spark, d, "pipete~")


@query(f"SELECT doc_id FROM documents WHERE len(list_filter({_TOKENS_SQL}, lambda x: x >= 'gasket' AND x <= 'gaskets')) > 0")
def text_range(spark, d):
    return _find(spark, d, "[gasket TO gaskets]")


@query(
    f"""WITH t AS (SELECT doc_id, {_TOKENS_SQL} AS t FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, len(t) AS n, len(list_filter(t, lambda x: x = 'gasket')) AS a, len(list_filter(t, lambda x: x = 'pipette')) AS b FROM t WHERE len(t) > 0),
w AS (SELECT 1 + ln(count(*) / (count_if(a > 0) + 1)::DOUBLE) AS ia, 1 + ln(count(*) / (count_if(b > 0) + 1)::DOUBLE) AS ib FROM u)
SELECT doc_id, round((sqrt(a) * ia * ia + sqrt(b) * ib * ib) / sqrt(n) * ((a > 0)::INT + (b > 0)::INT) / 2, 9) AS score FROM u, w WHERE a + b > 0 ORDER BY score DESC, doc_id LIMIT 20"""
)
def text_relevance_topk(spark, d):
    df = _documents(spark, d)
    scores = textquery.scored(df, F.col("t"), ["gasket", "pipette"], "doc_id")
    return scores.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "doc_id").limit(20)


_STOPPED_SQL = f"list_filter({_TOKENS_SQL}, lambda y: NOT list_contains({textquery.STOP_WORDS}, y))"


@query(f"SELECT doc_id FROM documents WHERE contains(' ' || list_aggregate({_STOPPED_SQL}, 'string_agg', ' ') || ' ', ' keep valve ') OR list_contains({_STOPPED_SQL}, 'pipette')")
def text_stop_words(spark, d):
    """Stop words are neither in the texts' words nor in a query's; of "the" alone nothing is left."""
    df = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", textquery.tokens(F.col("text")).alias("t"))
    return df.where(textquery.Parser({"text": F.col("t")})('"keep the valve" the The pipette')).select("doc_id")


@query(
    f"""WITH t AS (SELECT doc_id, {_TOKENS_SQL} AS t FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, len(t) AS n, len(list_filter(t, lambda x: x = 'gasket')) AS a,
 len(list_filter(range(1, len(t)), lambda i: t[i] = 'short' AND t[i + 1] = 'answer')) AS b, (len(list_filter(t, lambda x: starts_with(x, 'xan'))) > 0)::INT AS c FROM t WHERE len(t) > 0),
w AS (SELECT 1 + ln(count(*) / (count_if(a > 0) + 1)::DOUBLE) AS ia, 1 + ln(count(*) / (count_if(b > 0) + 1)::DOUBLE) AS ib FROM u)
SELECT doc_id, round(((2.5 * sqrt(a) * ia * ia + sqrt(b) * ib * ib) / sqrt(n) + 0.5 * c) * ((a > 0)::INT + (b > 0)::INT + c) / 3, 9) AS score FROM u, w WHERE a + b + c > 0"""
)
def text_relevance_of_phrases(spark, d):
    """Scores of a boosted word, a phrase and a boosted prefix."""
    df = _documents(spark, d)
    tree = textquery.Parser({"text": F.col("t")}).tree('gasket^2.5 "short answer" xan*^0.5')
    return textquery.relevance(df, tree.leaves(), {"text": F.col("t")}, "doc_id").withColumn("score", F.round("score", 9))


@query("SELECT doc_key FROM molecules WHERE _id = 'cmp277'")
def text_keyword_id(spark, d):
    return search.text(molecules(spark, d), "_id:cmp277").select("doc_key")


# deletes and appends


@query("SELECT doc_key, _source FROM molecules WHERE _source IS NULL OR _source <> 'lagoon'")
def delete_by_source(spark, d):
    gone = spark.createDataFrame([("lagoon", None)], "source string, id string")
    return store.removed(molecules(spark, d), gone).select("doc_key", "_source")


_LEFT = "SELECT m.* FROM molecules m WHERE NOT EXISTS (SELECT 1 FROM removals r WHERE (r.source IS NOT NULL OR r.id IS NOT NULL) AND (r.source IS NULL OR r.source = m._source) AND (r.id IS NULL OR r.id = m._id))"


@query(f"SELECT doc_key, _id, _source FROM ({_LEFT})")
def delete_by_source_and_id(spark, d):
    return store.removed(molecules(spark, d), table(spark, d, "removals")).select("doc_key", "_id", "_source")


@query(f"SELECT count(*) AS size FROM ({_LEFT})")
def size_after_delete(spark, d):
    return store.removed(molecules(spark, d), table(spark, d, "removals")).agg(F.count("*").alias("size"))


@query(f"SELECT _source AS value, count(*) AS count FROM ({_LEFT}) WHERE trim(_molfile) <> '' AND _source IS NOT NULL GROUP BY 1")
def store_changes(spark, d):
    """A store made of all structures in two commits, then emptied of what the delete requests name; the rows left by source."""
    m = molecules(spark, d).where("trim(_molfile) <> ''").select(F.col("_id").alias("id"), F.col("_source").alias("source"), F.col("_molfile").alias("structure"), "props")
    with store.Store(spark, scratch(spark)) as own:
        first = F.coalesce(F.col("source") == "lagoon", F.lit(False))
        own.add(m.where(first), props="props")
        own.add(m.where(~first), props="props")
        own.remove_all(table(spark, d, "removals"))
        return aggregates.facet_counts(own.table(), top=None)


# results of saved queries


@query("SELECT h.query_id, q.kind, count(*) AS hits, count(DISTINCT h.doc_key) AS molecules, max(h.similarity) AS best FROM search_hits h JOIN saved_queries q USING (query_id) GROUP BY 1, 2")
def hits_by_query(spark, d):
    h, q = table(spark, d, "search_hits"), table(spark, d, "saved_queries").select("query_id", "kind")
    # counted per query and molecule first, so that a hot query is spread over tasks
    each = h.groupBy("query_id", "doc_key").agg(F.count("*").alias("n"), F.max("similarity").alias("s"))
    per = each.groupBy("query_id").agg(F.sum("n").alias("hits"), F.count("doc_key").alias("molecules"), F.max("s").alias("best"))
    return per.join(q, "query_id").select("query_id", "kind", "hits", "molecules", "best")


# structures


@query()
def featurize_structures(spark, d):
    """Formula, counts, weight and fingerprints computed anew from every structure."""
    m = molecules(spark, d).where("_molfile is not null").select(F.col("doc_key").cast("string").alias("id"), F.col("_source").alias("source"), F.col("_molfile").alias("structure"))
    return structures.featurize(m).select(F.col("_id").cast("long").alias("doc_key"), "_formula", "_natoms", "_nbonds", "_molwt", "_popcount", "error")


#: hydrogens that a structure's text leaves out, by the usual valences; those that are drawn are atoms
_HYDROGEN_SQL = f"""WITH {structure_sql.GRAPH}, ion AS (SELECT k, trim(x[11 + 8 * j : 13 + 8 * j])::INT AS i, trim(x[14 + 8 * j : 17 + 8 * j])::INT AS q
 FROM (SELECT k, x, unnest(range(0, trim(x[7:9])::INT)) AS j FROM (SELECT k, unnest(l) AS x FROM mol) WHERE x LIKE 'M  CHG%')),
one AS (SELECT a.k, a.i, a.z, a.ar, s.atom, coalesce(q.q, CASE WHEN s.atom LIKE '[%' THEN CASE WHEN regexp_matches(s.atom, '-') THEN -1 WHEN regexp_matches(s.atom, '\\+') THEN 1 ELSE 0 END ELSE 0 END) AS q
 FROM atom a LEFT JOIN satom s ON s.k = a.k AND s.i = a.i LEFT JOIN ion q ON q.k = a.k AND q.i = a.i),
used AS (SELECT k, a AS i, sum(CASE o WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 1 END) AS u, max((o = 4)::INT) AS shared FROM e GROUP BY 1, 2),
hs AS (SELECT o.k, o.i, o.z, CASE WHEN atom LIKE '[%' THEN CASE WHEN regexp_matches(atom[2:], 'H[0-9]') THEN regexp_extract(atom[2:], 'H([0-9])', 1)::INT WHEN regexp_matches(atom[2:], 'H') THEN 1 ELSE 0 END
 ELSE coalesce(list_filter(list_transform(CASE z WHEN 'C' THEN [4] WHEN 'N' THEN [3, 5] WHEN 'O' THEN [2] WHEN 'S' THEN [2, 4, 6] WHEN 'P' THEN [3, 5] WHEN 'B' THEN [3] WHEN 'Si' THEN [4] WHEN 'F' THEN [1] WHEN 'Cl' THEN [1] WHEN 'Br' THEN [1] WHEN 'I' THEN [1, 3, 5] ELSE []::INT[] END,
  lambda v, n: CASE WHEN n > 1 AND (ar OR coalesce(shared, 0) = 1) THEN -9 ELSE v + CASE WHEN z IN ('N', 'O', 'S', 'P') THEN q WHEN z = 'B' THEN -q ELSE -abs(q) END - coalesce(u, 0) - (ar OR coalesce(shared, 0) = 1)::INT END), lambda h: h >= 0)[1], 0) END AS h
 FROM one o LEFT JOIN used x ON x.k = o.k AND x.i = o.i)"""


@query(f"{_HYDROGEN_SQL}, n AS (SELECT k, count(*) + sum(h) AS atoms, sum(h) + count(*) FILTER (z = 'H') AS hydrogens FROM hs GROUP BY 1), b AS (SELECT k, count(*) AS bonds FROM bond GROUP BY 1) SELECT n.k AS doc_key, atoms::BIGINT AS atoms, (coalesce(bonds, 0) + atoms - (SELECT count(*) FROM atom a WHERE a.k = n.k))::BIGINT AS bonds, hydrogens::BIGINT AS hydrogens FROM n LEFT JOIN b ON b.k = n.k")
def structure_counts(spark, d):
    """Atoms, bonds and hydrogens of all structures as featurising counts them."""
    m = molecules(spark, d).where("_molfile is not null").select(F.col("doc_key").cast("string").alias("id"), F.col("_molfile").alias("structure"))
    made = structures.featurize(m, source=None).where("error is null")
    hydrogens = F.regexp_extract("_formula", "H(?![a-z])([0-9]*)", 1)
    many = F.when(~F.col("_formula").rlike("H(?![a-z])"), 0).when(hydrogens == "", 1).otherwise(hydrogens.cast("int"))
    return made.select(F.col("_id").cast("long").alias("doc_key"), F.col("_natoms").cast("long").alias("atoms"), F.col("_nbonds").cast("long").alias("bonds"), many.cast("long").alias("hydrogens"))


_HEAVY_SQL = "regexp_replace(_formula, 'H(?:[0-9]+|($)|([A-Z+-]))', '\\1\\2', 'g')"


@query(f"SELECT doc_key, {_HEAVY_SQL} AS heavy, _nbonds - _natoms AS cycles FROM molecules WHERE trim(_molfile) <> '' AND _formula IS NOT NULL AND _natoms IS NOT NULL AND _nbonds IS NOT NULL")
def featurized_against_stored(spark, d):
    """What is independent of hydrogens, from every structure, against the stored columns: formula without H, bonds less atoms."""
    m = molecules(spark, d).where("trim(_molfile) <> '' and _formula is not null and _natoms is not null and _nbonds is not null")
    made = structures.featurize(m.select(F.col("doc_key").cast("string").alias("id"), F.col("_molfile").alias("structure")), source=None)
    heavy = F.regexp_replace("_formula", "H(?![a-z])[0-9]*", "")
    return made.select(F.col("_id").cast("long").alias("doc_key"), heavy.alias("heavy"), (F.col("_nbonds") - F.col("_natoms")).alias("cycles"))


@query()
def substructure_search(spark, d):
    return search.substructure(molecules(spark, d), "c1ccncc1").select("doc_key", "similarity", "hits")


def _atoms(df: DataFrame) -> DataFrame:
    """One row for each match: the atoms it lies on."""
    return df.select("doc_key", F.explode("hits").alias("h")).select("doc_key", F.array_sort("h").alias("atoms"))


@query(f"{structure_sql.PYRIDINE} SELECT k AS doc_key, atoms FROM ring")
def substructure_rings(spark, d):
    """All places of a pyridine ring in all structures."""
    return _atoms(search.substructure(molecules(spark, d), "c1ccncc1", all_hits=True))


@query(f"{structure_sql.AMIDE} SELECT DISTINCT k AS doc_key, list_sort([x, y, z]) AS atoms FROM path")
def substructure_amides(spark, d):
    return _atoms(search.substructure(molecules(spark, d), "C(=O)N", all_hits=True))


@query(f"{structure_sql.AMIDE} SELECT DISTINCT doc_key FROM path JOIN molecules ON doc_key = k WHERE _natoms >= 30 AND _molwt <= 450")
def substructure_filtered(spark, d):
    m = molecules(spark, d)
    return search.substructure(m, "C(=O)N", None, p.int_range(m, "_natoms", 30), p.double_range(m, "_molwt", None, 450)).select("doc_key")


@query(f"""{structure_sql.path("p.z = 'C'", "q.z <> 'H'", "r.z = 'N'", "x.o = 1 AND y.o = 1")} SELECT k AS doc_key, count(DISTINCT list_sort([x, y, z]))::INT AS matches FROM path GROUP BY 1""")
def substructure_all_matches(spark, d):
    return search.substructure(molecules(spark, d), "C*N", all_hits=True, key="doc_key").select("doc_key", F.size("hits").alias("matches"))


@query(f"""{structure_sql.path("p.z = 'O'", "q.z IN ('S', 'P')", "r.z = 'N'", "x.o = 2 AND y.o IN (1, 2, 3, 4) AND NOT q.ar")} SELECT k AS doc_key, count(DISTINCT list_sort([x, y, z]))::INT AS matches FROM path WHERE k IN (SELECT e.k FROM e JOIN atom ON atom.k = e.k AND i = e.a WHERE z = 'S') GROUP BY 1""")
def substructure_query_bonds(spark, d):
    """Any bond, and one of two elements: two queries over all structures, counted together where there is sulfur."""
    m = molecules(spark, d).where("doc_key is not null")
    return search.substructure_hits(m, ["O=S~N", "O=P~N"], within=["S"]).select("doc_key", (F.size(F.col("hits")[0]) + F.size(F.col("hits")[1])).alias("matches"))


@query(
    f"""WITH {structure_sql.GRAPH}, n AS (SELECT k, count(*) AS atoms, count_if(z = 'C') AS c, count_if(z = 'O') AS o FROM atom WHERE z <> 'H' GROUP BY 1), b AS (SELECT b.k, count(*) AS bonds FROM bond b JOIN atom p ON p.k = b.k AND p.i = b.a JOIN atom q ON q.k = b.k AND q.i = b.b WHERE p.z <> 'H' AND q.z <> 'H' GROUP BY 1),
g AS (SELECT e.k, e.a, count(*) AS degree FROM e JOIN atom q ON q.k = e.k AND q.i = e.b WHERE q.z <> 'H' GROUP BY 1, 2), m AS (SELECT k, min(degree) AS lo, max(degree) AS hi FROM g JOIN atom USING (k) WHERE atom.i = g.a AND z <> 'H' GROUP BY 1)
SELECT n.k AS doc_key FROM n JOIN b ON b.k = n.k JOIN m ON m.k = n.k WHERE atoms = 5 AND c = 4 AND o = 1 AND bonds = 5 AND lo = 2 AND hi = 2 AND NOT EXISTS (SELECT 1 FROM bond x WHERE x.k = n.k AND x.o <> 1)"""
)
def substructure_exact(spark, d):
    """Structures that are a ring of four carbons and an oxygen, and no more."""
    return search.substructure(molecules(spark, d), "C1CCCO1", mode="exact").select("doc_key")


@query()
def structures_as_smiles(spark, d):
    return structures.as_text(molecules(spark, d).where("_molfile is not null"), "smiles").select("doc_key", F.col("text").alias("smiles"))


@query(f"{_HYDROGEN_SQL} SELECT k AS doc_key, (count(*) + sum(h))::BIGINT AS atoms, ((SELECT count(*) FROM bond b WHERE b.k = hs.k) + sum(h))::BIGINT AS bonds FROM hs GROUP BY 1")
def structures_rewritten(spark, d):
    """Atoms and bonds of structures that were written as SMILES, read, written as blocks and read again."""
    m = molecules(spark, d).where("_molfile is not null").select("doc_key", "_molfile")
    m = cut(structures.as_text(cut(structures.as_text(m, "smiles")), "mol", "text", "block")).where("block is not null")
    made = structures.featurize(m.select(F.col("doc_key").cast("string").alias("id"), F.col("block").alias("structure")), source=None)
    return made.select(F.col("_id").cast("long").alias("doc_key"), F.col("_natoms").cast("long").alias("atoms"), F.col("_nbonds").cast("long").alias("bonds"))


@query()
def substructure_batch_join(spark, d):
    """Every saved substructure query against all molecules."""
    return search.substructure_join(molecules(spark, d), table(spark, d, "saved_queries").where("kind = 'substructure'"))


def _both_ways(bonds: DataFrame) -> DataFrame:
    return bonds.unionByName(bonds.select("doc_key", F.col("b").alias("a"), F.col("a").alias("b"), "kind"))


@query(f"""{structure_sql.path("p.z = 'C'", "q.z = 'O'", "r.z = 'C'")} SELECT DISTINCT k AS doc_key FROM path""")
def motif_path3(spark, d):
    """C-O-C as joins of the bonds of all structures, the relational form of a substructure search."""
    atoms, bonds = structures.as_tables(molecules(spark, d))
    atoms, e = cut(atoms), _both_ways(cut(bonds))
    s = {n: atoms.select("doc_key", F.col("i").alias(n), F.col("symbol").alias(f"s{n}")) for n in "abc"}
    # carbons at oxygens first, so that only their bonds are joined
    co = e.join(s["a"].where("sa = 'C'"), ["doc_key", "a"]).join(s["b"].where("sb = 'O'"), ["doc_key", "b"]).select("doc_key", "a", "b")
    return co.join(co.select("doc_key", "b", F.col("a").alias("c")), ["doc_key", "b"]).where("a < c").select("doc_key").distinct()


@query(f"WITH {structure_sql.GRAPH} SELECT DISTINCT x.k AS doc_key FROM e x JOIN e y ON x.k = y.k AND x.b = y.a JOIN e z ON x.k = z.k AND y.b = z.a AND z.b = x.a WHERE x.a < x.b AND x.b < y.b")
def motif_triangle(spark, d):
    """Rings of three atoms, the bonds' smaller ends first: bonds meet within their structure, none is joined by key."""
    m = molecules(spark, d).where("doc_key is not null").select("doc_key", "_molfile")
    return structures.where(m, graph.triangles).select("doc_key").distinct()


@query("SELECT label, count(*) AS n, count(DISTINCT embedding) AS different FROM embeddings GROUP BY label")
def distinct_embeddings(spark, d):
    e = table(spark, d, "embeddings")
    return e.groupBy("label", "embedding").agg(F.count("*").alias("c")).groupBy("label").agg(F.sum("c").alias("n"), F.count("*").alias("different"))


# loading


@query()
def p2_found(spark, d):
    return records.load(table(spark, d, "raw_records"), loaded=False)


@query()
def p2_loaded(spark, d):
    return records.load(table(spark, d, "raw_records")).where("reason is null").drop("reason", "properties")


@query()
def p2_assembled(spark, d):
    """The records as physical lines of three files, put together again and loaded: records by reason."""
    raw = table(spark, d, "raw_records").where("line is not null").select("raw_id", "delim", F.posexplode(F.split("line", "\n")).alias("i", "text"))
    raw = raw.withColumn("line_no", F.col("raw_id") * (1 << 20) + F.col("i"))
    parts = [records.assemble(raw.where(F.col("delim") == x).select(F.lit(x).alias("file_name"), "line_no", "text"), columns=6, delim=x) for x in (",", ";", "\t")]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return records.load(whole, key="line_no", delim="file_name").groupBy("reason").agg(F.count("*").alias("records"))
