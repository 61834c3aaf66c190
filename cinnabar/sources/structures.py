"""Structure files and strings to molecule rows, and back to text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..chem import fingerprints, graph, match, molfile, smiles
from ..session import spread

MOLECULE = (
    "_id string, _source string, name string, _molfile string, _formula string, _natoms int, _nbonds int, _molwt double, "
    "props map<string,string>, _fingerprint_sub array<bigint>, _fingerprint_sim array<bigint>, _popcount int, error string"
)


def source_name(path: str) -> str:
    """A file's name without its last extension; a leading dot begins none."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    at = name.rfind(".")
    return name[:at] if at > 0 else name


def source_of(file: Column) -> Column:
    """``source_name`` as a column."""
    return F.regexp_replace(file, r"(?<=.)\.[^.]*$", "")


def record_id(*given: Column, number: Column) -> Column:
    """The first name that isn't blank, else the record's number in ten digits."""
    return F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in given], F.lpad(number.cast("string"), 10, "0"))


def _row(ident, source, text, props) -> tuple:
    try:
        m = molfile.read(text)
    except ValueError as e:
        return ident, source, None, text, None, None, None, None, props, None, None, None, f"bad structure: {e}"
    props = {**(props or {}), **m.props}
    m = match.prepared(m)
    atoms, bonds = graph.explicit(m)
    sub = fingerprints.paths(m)
    sim = fingerprints.union(fingerprints.circular(m), sub)
    kept = molfile.write(m, kekule=False) if atoms <= molfile.MOST_ATOMS else smiles.write(m, kekule=False)
    bits = sum((w & (1 << 64) - 1).bit_count() for w in sim)
    return ident, source, m.name or None, kept, graph.formula(m), atoms, bonds, graph.mass(m), props, sub, sim, bits, None


def featurize(df: DataFrame, structure: str = "structure", ident: str = "id", source: str | None = "source", props: str | None = None) -> DataFrame:
    """Molecule rows of structure strings. A row that can't be parsed keeps its text and says why in ``error``."""
    none = F.lit(None)
    df = df.select(
        F.col(ident).cast("string").alias("id"),
        (F.col(source) if source else none).cast("string").alias("source"),
        F.col(structure).cast("string").alias("structure"),
        (F.col(props) if props else none).cast("map<string,string>").alias("props"),
    )
    fields = [c.split()[0] for c in MOLECULE.split(", ")]
    kinds = [pa.string()] * 5 + [pa.int32(), pa.int32(), pa.float64(), pa.map_(pa.string(), pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                part = batch.slice(s, 500)
                rows = [_row(i, o, t, dict(p) if p else None) for i, o, t, p in zip(*(part[c].to_pylist() for c in ("id", "source", "structure", "props")))]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=fields)

    return spread(df).mapInArrow(run, MOLECULE)


def read_sd(spark: SparkSession, path: str, id_field: str | None = None) -> DataFrame:
    """(id, source, structure) of SD files. The id is a property, else the record's title, else its number in ten digits.

    Files are split between records by the text source itself, so one large file is read by many tasks.
    """
    df = spark.read.option("lineSep", "$$$$\n").text(path).where(F.trim(F.translate("value", "\r\n", "")) != "").select(F.regexp_replace("value", "^\r?\n", "\n").alias("structure"), F.col("_metadata.file_name").alias("file"))
    title = F.split("structure", "\n")[0]
    chosen = [F.regexp_extract("structure", rf">[^\n]*<{id_field}>[^\n]*\n([^\n]*)", 1)] if id_field else []
    return df.select(record_id(*chosen, title, number=F.monotonically_increasing_id() + 1).alias("id"), source_of(F.col("file")).alias("source"), F.concat("structure", F.lit("$$$$\n")).alias("structure"))


def read_smiles(spark: SparkSession, path: str) -> DataFrame:
    """(id, source, structure) of files with a SMILES and a name on each line."""
    df = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+", 2).alias("p"), F.col("_metadata.file_name").alias("file"))
    return df.select(record_id(F.get("p", F.lit(1)), number=F.monotonically_increasing_id() + 1).alias("id"), source_of(F.col("file")).alias("source"), F.get("p", F.lit(0)).alias("structure"))


def as_text(df: DataFrame, kind: str = "smiles", structure: str = "_molfile", out: str = "text") -> DataFrame:
    """Adds the structure as ``smiles``, ``mol`` or ``sdf``; null where it can't be parsed."""
    if kind not in ("smiles", "mol", "sdf"):
        raise ValueError(f"no format {kind}")

    @F.pandas_udf("string")
    def convert(texts):
        def one(t):
            try:
                m = match.prepared(molfile.read(t))
                return smiles.write(m) if kind == "smiles" else molfile.write(m) if kind == "mol" else molfile.write_sd(m)
            except (ValueError, TypeError):
                return None

        return texts.map(one)

    return spread(df).withColumn(out, convert(F.col(structure)))


def as_tables(df: DataFrame, key: str = "doc_key", structure: str = "_molfile") -> tuple[DataFrame, DataFrame]:
    """(key, i, symbol, aromatic) and (key, a, b, kind) of all atoms and bonds of structures that can be parsed, atoms from 1.

    Hydrogens that aren't drawn are in neither; ``kind`` is 1 to 3, or 4 where electrons are shared.
    """
    kind = dict(df.dtypes)[key]
    graph_type = f"{key} {kind}, atoms array<struct<i:int,symbol:string,aromatic:boolean>>, bonds array<struct<a:int,b:int,kind:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        atom = pa.list_(pa.struct([("i", pa.int32()), ("symbol", pa.string()), ("aromatic", pa.bool_())]))
        bond = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("kind", pa.int32())]))
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                part = batch.slice(s, 500)
                rows, atoms, bonds = [], [], []
                for n, text in enumerate(part.column(1).to_pylist()):
                    try:
                        m = match.prepared(molfile.read(text))
                    except ValueError:
                        continue
                    rows.append(n)
                    atoms.append([{"i": i + 1, "symbol": m.symbol(i), "aromatic": bool(m.aromatic[i])} for i in range(len(m))])
                    bonds.append([{"a": a + 1, "b": b + 1, "kind": k} for a, b, k in m.bonds])
                keys = part.column(0).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(atoms, atom), pa.array(bonds, bond)], names=[key, "atoms", "bonds"])

    graphs = spread(df.where(F.col(structure).isNotNull()).select(key, structure)).mapInArrow(run, graph_type)
    return graphs.select(key, F.inline("atoms")), graphs.select(key, F.inline("bonds"))


def where(df: DataFrame, test: Callable[[graph.Mol], object], structure: str = "_molfile") -> DataFrame:
    """Rows whose structure can be parsed and passes a test on its graph, with bonds as the text has them.

    All atoms and bonds of a structure are in one row, so what joins them needs no shuffle and no table between.
    """
    df = df.where(F.col(structure).isNotNull())
    at = df.columns.index(structure)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, text in enumerate(batch.column(at).to_pylist()):
                try:
                    m = molfile.read(text)
                except ValueError:
                    continue
                if test(m):
                    rows.append(n)
            yield batch.take(pa.array(rows, pa.int64()))

    return spread(df).mapInArrow(run, df.schema)


def write_tsv(df: DataFrame, path: str, extra: list[str] | None = None) -> None:
    """Results as tab-separated SMILES, id, source, similarity to three places, and further fields."""
    df = as_text(df, "smiles", out="#STRUCTURE")
    similarity = F.format_string("%.3f", "similarity") if "similarity" in df.columns else F.lit(None).cast("string")
    fields = [F.col(c).cast("string").alias(c) if c in df.columns else F.try_element_at("props", F.lit(c)).alias(c) for c in extra or []]
    df.select("#STRUCTURE", F.col("_id").alias("ID"), F.col("_source").alias("SOURCE"), similarity.alias("SIMILARITY"), *fields).write.mode("overwrite").csv(path, sep="\t", header=True)
