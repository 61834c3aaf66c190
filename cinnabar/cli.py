"""``python -m cinnabar.cli index|search|stats``: the store from a shell."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .chem import fingerprints, match, molfile
from .functions.fingerprint import popcount
from .functions.predicates import BadFilter, parse_filter
from .operators import aggregates, search
from .sources import structures
from .sources.store import Store


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cinnabar")
    sub = p.add_subparsers(dest="what", required=True)
    i = sub.add_parser("index", help="add structure files to a store")
    i.add_argument("store")
    i.add_argument("files", nargs="*")
    i.add_argument("-i", "--id-field", help="property that holds a record's id")
    i.add_argument("-l", "--list", action="store_true", help="list sources and their counts")
    s = sub.add_parser("search", help="search a store")
    s.add_argument("store")
    s.add_argument("query", nargs="?")
    s.add_argument("-s", "--kind", choices=["sim", "tan", "sub", "text"], default="text")
    s.add_argument("-t", "--threshold", type=float, default=0.8)
    s.add_argument("-n", "--most", type=int)
    s.add_argument("-F", "--filter", action="append", default=[], metavar="FIELD=VALUE")
    s.add_argument("-L", "--fields", action="store_true", help="list fields")
    s.add_argument("-f", "--format", choices=["smiles", "mol", "sdf"], default="smiles")
    t = sub.add_parser("stats", help="histograms of a store")
    t.add_argument("store")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    parser, out = _parser(), out or sys.stdout
    a, rest = parser.parse_known_args(argv)
    if rest:  # a query after the options
        if a.what != "search" or a.query is not None or len(rest) > 1:
            parser.error(f"not understood: {' '.join(rest)}")
        a.query = rest[0]
    spark = spark or SparkSession.builder.appName("cinnabar").getOrCreate()
    say = lambda *x: print(*x, sep="\t", file=out)
    if a.what == "index":
        with Store(spark, a.store) as store:
            for f in a.files:
                rows = structures.read_smiles(spark, f) if f.rsplit(".", 1)[-1] in ("smi", "smiles", "txt") else structures.read_sd(spark, f, a.id_field)
                say(f, store.add(rows))
            if a.list:
                found = store.sources(top=None)
                for k, n in found.items():
                    say(k, n)
                say("total", sum(found.values()))
        return 0
    store = Store(spark, a.store, read_only=True)
    df = store.table()
    if a.what == "stats":
        for r in aggregates.stats(df, F.expr(popcount("_fingerprint_sim")), F.col("_natoms"), F.col("_molwt")).collect():
            say(r["what"], "" if r["lo"] is None else f"{r['lo']:g}", "" if r["hi"] is None else f"{r['hi']:g}", r["count"])
        return 0
    if a.fields:
        for f in store.fields():
            say(f)
        return 0
    try:
        filters = [parse_filter(df, *f.partition("=")[::2]) for f in a.filter]
    except BadFilter as e:
        print(e, file=sys.stderr)
        return 1
    wanted = [f.partition("=")[0] for f in a.filter]
    if a.query is None or a.kind == "text":
        if a.query is None and not filters:
            print("a query or a filter is needed", file=sys.stderr)
            return 1
        found = search.text(df, a.query, a.most, *filters)
    elif a.kind == "sub":
        found = search.substructure(df, a.query, a.most, *filters, screen="_fingerprint_sub")
    else:
        q = fingerprints.similarity_fingerprint(match.prepared(molfile.read(a.query)))
        found = search.similarity(df, q, a.threshold, a.most, *filters, popcnt="_popcount")
    found = structures.as_text(found, a.format)
    if a.format != "smiles":
        for r in found.select("text").toLocalIterator():
            print(r["text"], file=out)
        return 0
    fields = [F.col(c).cast("string").alias(c) if c in found.columns else F.try_element_at("props", F.lit(c)).alias(c) for c in dict.fromkeys(wanted)]
    similarity = F.format_string("%.3f", "similarity") if "similarity" in found.columns else F.lit("")
    say("#STRUCTURE", "ID", "SOURCE", "SIMILARITY", *dict.fromkeys(wanted))
    for r in found.select("text", "_id", "_source", similarity, *fields).toLocalIterator():
        say(*("" if x is None else x for x in r))
    return 0


if __name__ == "__main__":
    sys.exit(main())
