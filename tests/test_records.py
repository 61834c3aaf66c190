import datetime

import pytest

from cinnabar.sources import records

COLUMNS = "raw_id long, delim string, line string, reason string"


def reasons(spark, rows):
    df = spark.createDataFrame([(i, d, line, "x") for i, (d, line) in enumerate(rows)], COLUMNS)
    return {r["raw_id"]: r["reason"] for r in records.load(df).collect()}


def test_reasons(spark):
    rows = [
        (",", "s,id1,CCO,46.07,2020-02-29,a=1;b=2"),
        (",", 's,id1,CCO,,,"say ""x"", twice"'),
        (",", 's,id1,"CCO"x,,,'),
        (",", 's,id1,CC"O,,,'),
        (",", 's,id1,"CCO,,,'),
        (",", "s,id1,C\nC,,,"),
        (",", "s,id1,CCO,,"),
        (",", "s,id1,CCO,,,,"),
        (",", ""),
        (",", None),
        (";", "s;id1;CCO;;;x,y"),
        ("\t", "s\tid1\tCCO\t\t\t"),
        (",", "s,id 1,CCO,,,"),
        (",", "s," + "x" * 41 + ",CCO,,,"),
        (",", "s,id1,C(C,,,"),
        (",", "s,id1,CCO,0,,"),
        (",", "s,id1,CCO,inf,,"),
        (",", "s,id1,CCO, +1.5e2 ,,"),
        (",", "s,id1,CCO,,2021-02-29,"),
        (",", "s,id1,CCO,,,\r"),
        (",", "s,id1,CCO,,,\r\r"),
        (None, "s,id1,CCO,,,"),
        ("||", "s,id1,CCO,,,"),
        (",", "s,id1,,,,"),
        (",", '"s" ,id1,CCO,,,'),
        (",", "s,id1,CCO,,,\x00"),
    ]
    q, c, v, ok = "quoting", "column_count", "invalid_value", None
    assert list(reasons(spark, rows).values()) == [ok, ok, q, q, q, q, c, c, c, c, ok, ok, v, v, v, v, v, ok, v, ok, q, ok, ok, v, q, ok]


def test_the_reader_decides_before_the_grammar(monkeypatch):
    asked = []
    grammar = records._grammar
    monkeypatch.setattr(records, "_grammar", lambda d: asked.append(d) or grammar(d))
    for line, by_grammar in (('a,"b"c', 0), ('a,"b', 0), ('a,b"c', 1), ("a\nb", 0), ('a,"b ""c"""', 1)):
        asked.clear()
        try:
            assert records.fields(line, ",") == ["a", 'b "c"']
        except records.Unloadable as e:
            assert str(e) == "quoting"
        assert len(asked) == by_grammar, line


def test_typed_columns(spark):
    df = spark.createDataFrame([(1, ",", " s ,a:b,CCO, 46.07 ,2020-02-29,a=1;a=2;x;c=", "clash")], COLUMNS)
    r = records.load(df).first()
    assert (r["_source"], r["_id"], r["_molwt"], r["added_on"], r["properties"]) == (" s ", "a:b", 46.07, datetime.date(2020, 2, 29), {"a": "2", "c": ""})


def test_empty_and_long(spark):
    assert records.load(spark.createDataFrame([], COLUMNS)).count() == 0
    assert reasons(spark, [(",", "s,id1," + "C" * 400_000 + ",,,")]) == {0: None}
    assert records.load(spark.createDataFrame([(1, ",", "x", None), (1, ",", "x", None), (None, ",", "x", None)], COLUMNS), loaded=False).count() == 3


def test_assembled_lines(spark):
    text = ['a,"one', "two", 'three",b', "c,d", 'e,"f ""g', 'h"', "i", 'j,"', '"', None]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)] + [("g", 5, "x")], "file_name string, line_no long, text string")
    for block in (1, 3, 100):
        got = {(r["file_name"], r["line_no"]): r["line"] for r in records.assemble(df, block=block).collect()}
        assert got == {("f", 0): 'a,"one\ntwo\nthree",b', ("f", 3): "c,d", ("f", 4): 'e,"f ""g\nh"', ("f", 6): "i", ("f", 7): 'j,"\n"', ("f", 9): "", ("g", 5): "x"}


def test_a_stray_quote_spoils_only_what_is_next_to_it(spark, monkeypatch):
    text = ['a,"one', 'two",b,c', 'd,e",f', "g,h,i", 'j,"k', 'l",m', "n,o,p", '"q,r,s', "t,u", "v,w,x"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "file_name string, line_no long, text string")
    for block in (1, 4, 100):
        got = {r["line_no"]: r["line"] for r in records.assemble(df, block=block, columns=3).collect()}
        assert got == {0: 'a,"one\ntwo",b,c', 2: 'd,e",f', 3: "g,h,i", 4: 'j,"k\nl",m', 6: "n,o,p", 7: '"q,r,s\nt,u', 9: "v,w,x"}
    monkeypatch.setattr(records, "LONGEST", 3)
    open_ = spark.createDataFrame([("f", i, '"x' if i == 2 else "y,z") for i in range(9)], "file_name string, line_no long, text string")
    assert {r["line_no"]: r["line"] for r in records.assemble(open_).collect()} == {i: '"x' if i == 2 else "y,z" for i in range(9)}


def test_the_reader_itself_gives_the_reason(monkeypatch):
    """Without the grammar the reader's own exceptions reject these, and put the last one together."""
    monkeypatch.setattr(records, "_grammar", lambda d: records.re.compile("(?s).*"))
    for line in ('a,"b"c', 'a,"b', "a\nb"):
        with pytest.raises(records.Unloadable, match="quoting"):
            records.fields(line, ",")
    assert records.fields('a,"b\r\nc\rd",e', ",") == ["a", "b\r\nc\rd", "e"]
