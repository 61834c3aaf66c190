"""A molecule store: snapshot directories of parquet under a manifest, so that readers never see half a change.

A manifest lists the parts (directories) that make up a snapshot. A change writes new parts first and then the next
manifest, by a rename that fails where another writer was faster; the one with the highest number is the current one. An
append adds a part; a delete rewrites the parts that hold a hit, no others. All goes through Hadoop's file systems, so a
store may be wherever Spark can write.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates, codebook
from . import structures

SCHEMA = "doc_key bigint, " + structures.MOLECULE.removesuffix(", error string")


class ReadOnly(RuntimeError):
    pass


class Conflict(RuntimeError):
    """Another writer changed the store since it was read."""


class Files:
    """The few file operations a store needs, on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, base: str):
        self.jvm = spark.sparkContext._jvm
        self.at = lambda name: self.jvm.org.apache.hadoop.fs.Path(f"{base}/{name}" if name else base)
        self.fs = self.at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.setWriteChecksum(False)

    def is_dir(self, name: str = "") -> bool:
        return self.fs.exists(self.at(name)) and self.fs.getFileStatus(self.at(name)).isDirectory()

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.at(name))

    def names(self) -> list[str]:
        return [f.getPath().getName() for f in self.fs.listStatus(self.at(""))] if self.is_dir() else []

    def make(self) -> None:
        self.fs.mkdirs(self.at(""))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        out = self.fs.create(self.at(name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def move(self, old: str, new: str) -> bool:
        """Whether it could be done; never replaces a file."""
        return not self.exists(new) and self.fs.rename(self.at(old), self.at(new))

    def remove(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


class Store:
    def __init__(self, spark: SparkSession, path: str, read_only: bool = False):
        self.spark, self.path, self.read_only = spark, path.rstrip("/"), read_only
        self.files = Files(spark, self.path)
        if self.files.exists() and not self.files.is_dir():
            raise NotADirectoryError(path)
        if read_only and self._number() < 0:
            raise FileNotFoundError(path)
        self.last_modified = 0
        if not read_only:
            self.files.make()
            if self._number() < 0:
                self._commit({"parts": [], "next": 1}, -1)

    def _number(self) -> int:
        """Of the current manifest; -1 where there is none."""
        return max((int(n.split("-")[1].removesuffix(".json")) for n in self.files.names() if n.startswith("manifest-") and n.endswith(".json")), default=-1)

    def _state(self) -> tuple[dict, int]:
        n = self._number()
        return json.loads(self.files.read(f"manifest-{n}.json")), n

    def _commit(self, state: dict, after: int) -> None:
        tmp = f".manifest-{uuid.uuid4().hex}"
        self.files.write(tmp, json.dumps(state))
        if not self.files.move(tmp, f"manifest-{after + 1}.json"):
            self.files.remove(tmp)
            raise Conflict(f"snapshot {after + 1} of {self.path} is another one's")
        self.last_modified = int(time.time() * 1000)

    def _write(self, df: DataFrame) -> str:
        if self.read_only:
            raise ReadOnly("the store is open for reading")
        name = f"part-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def _read(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{p}" for p in parts])

    def table(self) -> DataFrame:
        """The current snapshot."""
        return self._read(self._state()[0]["parts"])

    def add(self, df: DataFrame, structure: str = "structure", ident: str = "id", source: str | None = "source", props: str | None = None) -> int:
        """Adds a table of structures; all of it or, where one can't be parsed, nothing. Ids needn't be unique."""
        if self.read_only:
            raise ReadOnly("the store is open for reading")
        state, n = self._state()
        rows = structures.featurize(df, structure, ident, source, props)
        name = self._write(rows.withColumn("doc_key", F.monotonically_increasing_id() + state["next"]))
        made = self.spark.read.parquet(f"{self.path}/{name}")
        bad = made.where("error is not null").select("_id", "error").first()
        top = None if bad else made.agg(F.max("doc_key"), F.count("*")).first()
        if bad or not top[1]:
            self.files.remove(name)
        if bad:
            raise ValueError(f"{bad['_id']}: {bad['error']}")
        if top[1]:
            self._commit({**state, "parts": [*state["parts"], name], "next": top[0] + 1}, n)
        return top[1]

    def add_one(self, ident: str, structure: str, source: str | None = None, props: dict | None = None) -> None:
        self.add(self.spark.createDataFrame([(ident, source, structure, props)], "id string, source string, structure string, props map<string,string>"), props="props")

    def remove(self, source: str | None = None, ident: str | None = None) -> None:
        """Deletes by source, id or both; what isn't given doesn't matter, and a null source is never meant."""
        if source is None and ident is None:
            raise ValueError("a source or an id is needed")
        hit = F.lit(True)
        if source is not None:
            hit = hit & F.col("_source").eqNullSafe(source)
        if ident is not None:
            hit = hit & F.col("_id").eqNullSafe(ident)
        self._rewrite(lambda t: t.where(hit), lambda t: t.where(~hit))

    def remove_all(self, requests: DataFrame) -> None:
        """Deletes by a table of (source, id) requests."""
        self._rewrite(lambda t: named(t, requests), lambda t: removed(t, requests))

    def _rewrite(self, hits, keep) -> None:
        if self.read_only:
            raise ReadOnly("the store is open for reading")
        state, n = self._state()
        parts = state["parts"]
        if parts:
            # one pass over keys and names tells which parts have a hit
            t = self._read(parts).select("_source", "_id", F.regexp_extract(F.input_file_name(), r"/(part-[0-9a-f]{32})/", 1).alias("part"))
            touched = {r["part"] for r in hits(t).select("part").distinct().collect()}
            self._commit({**state, "parts": [self._write(keep(self._read([p]))) if p in touched else p for p in parts]}, n)

    def codebooks(self) -> list[list[int]]:
        """The bits of the codebooks; made at first and then the same for ever."""
        if not self.files.exists("codebooks"):
            return codebook.build()
        return codebook.load(self.spark, f"{self.path}/codebooks")[0]

    def count_codes(self) -> DataFrame:
        """(book, code, count) of the current snapshot, which is kept with the codebooks."""
        books = self.codebooks()
        if self.read_only:
            return codebook.counts(self.table(), books)
        counted = self.spark.createDataFrame(codebook.counts(self.table(), books).toArrow())  # 2^8 rows a book
        codebook.save(counted, books, f"{self.path}/codebooks")
        return codebook.load(self.spark, f"{self.path}/codebooks")[1]

    def size(self) -> int:
        return self.table().count()

    def sources(self, top: int | None = 20) -> dict[str, int]:
        return {r["value"]: r["count"] for r in aggregates.facet_counts(self.table(), top=top).collect()}

    def fields(self) -> list[str]:
        return [r["field"] for r in aggregates.field_names(self.table()).collect()]

    def close(self) -> None:
        """Nothing is pending: every change is committed when its call returns."""

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def _requests(requests: DataFrame) -> list[tuple[DataFrame, dict[str, str]]]:
    """The requests by form: both given, a source, an id; rows with both null ask for nothing."""
    both = requests.where("source is not null and id is not null").select(F.col("source").alias("rs"), F.col("id").alias("ri")).distinct()
    by_source = requests.where("source is not null and id is null").select(F.col("source").alias("rs")).distinct()
    by_id = requests.where("source is null and id is not null").select(F.col("id").alias("ri")).distinct()
    return [(both, ("rs", "ri")), (by_source, ("rs",)), (by_id, ("ri",))]


def _joined(df: DataFrame, asked: DataFrame, keys, source: str, ident: str, how: str) -> DataFrame:
    own = {"rs": source, "ri": ident}
    on = None
    for k in keys:
        on = (df[own[k]] == asked[k]) if on is None else on & (df[own[k]] == asked[k])
    return df.join(asked, on, how)


def removed(df: DataFrame, requests: DataFrame, source: str = "_source", ident: str = "_id") -> DataFrame:
    """What is left after delete requests (source, id), either of which may be null; rows with both null ask for nothing.

    Three anti joins on equal keys, one for each form of a request, instead of one on a disjunction.
    """
    for asked, keys in _requests(requests):
        df = _joined(df, asked, keys, source, ident, "left_anti")
    return df


def named(df: DataFrame, requests: DataFrame, source: str = "_source", ident: str = "_id") -> DataFrame:
    """The rows that delete requests name, those of several requests once for each form."""
    found = [_joined(df, asked, keys, source, ident, "left_semi") for asked, keys in _requests(requests)]
    return found[0].unionByName(found[1]).unionByName(found[2])
