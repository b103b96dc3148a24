import io
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.cli.__main__ import Repl, main, matches
from quern.operators.index import UniqueIndex
from quern.operators.two_q import TwoQ
from quern.sources import Attribute, Catalog, ParserError, RelationSchema, parse
from quern.sources.records import RecordError, decode, decoded, encode, encoded
from quern.sources.segment import SegmentTable, UnknownTid
from quern.sources.u64 import external_sort, generate, is_sorted, read_u64, shown, xorshift
from quern.types import TypeTag

I, C = TypeTag.INTEGER, TypeTag.CHAR


def test_ddl():
    assert parse(" \n \t ") == []
    one, two = parse("CREATE TABLE test1(attr1 integer, attr2 INTEGER, attr3 INTEGER NOT NULL, attr4 CHAR(1),\n attr5 CHAR(10) not NULL, PRIMARY key (attr2, attr4)); create table test2(attr1 integer);")
    assert one.primary_key == (1, 3) and [a.not_null for a in one.attributes] == [False, False, True, False, True]
    assert one.types() == [I, I, I, C, C] and one.attributes[4].length == 10 and two.primary_key == ()
    assert [f.nullable for f in one.struct()] == [True, True, False, True, False]
    (t,) = parse("CREATE TABLE d(id integer not null, name char(25), PRIMARY KEY(id), Country_Id char(2), price numeric(10, 2), );")
    assert t.primary_key == (0,) and t.attributes[2].name == "Country_Id" and t.struct()[3].dataType.simpleString() == "decimal(10,2)"
    assert str(t) == "TABLE d:\n  id INTEGER NOT NULL\n  name CHAR(25)\n  Country_Id CHAR(2)\n  price NUMERIC(10, 2)\n  primary key: 0\n"
    assert parse("CREATE TABLE 1e();")[0].attributes == ()


@pytest.mark.parametrize(("text", "line"), [("CREATE TABLE test(  attr1 integer,", 1), ("CREATE\nVIEW", 2), ("CREATE TABLE t(a integer)", 1), ("CREATE TABLE t(a float);", 1), ("CREATE TABLE t(a integer,\n\nPRIMARY KEY (A));", 3), ("CREATE TABLE key(a integer);", 1), ("CREATE TABLE t(a integer b integer);", 1), ("CREATE TABLE t(a char(x));", 1)])
def test_ddl_errors(text, line):
    with pytest.raises(ParserError) as e:
        parse(text)
    assert e.value.line == line


def test_catalog(spark, tmp_path):
    s = RelationSchema("studenten", (Attribute("id", I, None, True), Attribute("name", C, 30), Attribute("semester", I)), (0, 4, 10, 23), 3, 1)
    assert RelationSchema.from_json(s.to_json()) == s
    catalog = Catalog(str(tmp_path / "catalog"))
    catalog.store(spark, [s, RelationSchema("other")])
    assert catalog.read(spark) == [s, RelationSchema("other")]
    catalog.store(spark, [RelationSchema("new")])
    assert [r.name for r in catalog.read(spark)] == ["new"]
    df = spark.createDataFrame([(None, "x" * 31, 1), (1, "a", 1), (1, "a", 1)], "id int, name string, semester int")
    assert tuple(RelationSchema("s", s.attributes, (0,)).violations(df).head()) == (1, 1, 1)


def test_records(spark):
    row = (42, "The answer to life", 666)
    assert decode(encode(row), [I, C, I]) == row and decode(encode(("null\0char",)), [C]) == ("null\0char",)
    for record, types in ((encode((100,)), [C]), (encode(("Hello", 1)), [C]), (b"", [I])):
        with pytest.raises(RecordError):
            decode(record, types)
    with pytest.raises(RecordError):
        encode((None,))
    df = spark.createDataFrame([(1, "a"), (-2, "ü")], "a int, b string")
    assert sorted(map(tuple, decoded(encoded(df), df.schema).collect())) == [(-2, "ü"), (1, "a")]
    with pytest.raises(RecordError):
        encoded(spark.range(1).select(F.lit(1.0)))


@pytest.mark.parametrize("values", [[], [42], [1, 2, 3, 12, 33], [10, 8, 23, 12, 43], [1, 1, 3, 3], [10, 8, 10, 8, 7], [2**64 - 1, 0, 2**63, 2**63 - 1]])
def test_external_sort(spark, tmp_path, values):
    a, b = str(tmp_path / "in"), str(tmp_path / "out")
    np.array(values, "<u8").tofile(a)
    with open(a, "ab") as f:
        f.write(b"xyz")  # ignored
    assert external_sort(spark, a, b, single=True) == len(values)
    assert np.fromfile(b, "<u8").tolist() == sorted(values)
    assert is_sorted(spark, a) == (values == sorted(values)) and is_sorted(spark, b)
    parts = str(tmp_path / "parts")
    for source, expected in ((a, values), (b, values[:0])):  # a second run leaves nothing of the first behind
        if not expected:
            np.array([], "<u8").tofile(b)
        external_sort(spark, source, parts)
        rows = read_u64(spark, parts, part=2).orderBy("place").collect()
        assert [r.place for r in rows] == list(range(len(expected))) and [(r.k + 2**63) for r in rows] == sorted(expected)
        assert is_sorted(spark, parts)


def test_sort_in_parts(spark, tmp_path):
    a, b = str(tmp_path / "in"), str(tmp_path / "out")
    generate(a, 100_000)
    x = np.fromfile(a, "<u8")
    assert x[:4].tolist() == [8748534153485358512, 3040900993826735515, 3453997556048239312, 16431732851926010853] == list(xorshift(4))
    assert (x.min(), x.max(), int((x >= 2**63).sum())) == (10489504892952, 18446617110369215684, 50090)
    df = read_u64(spark, a, part=1024)
    assert df.rdd.getNumPartitions() == 98 and df.agg(F.max(shown(F.col("k")))).head()[0] == int(x.max())
    assert main(["sort", a, b]) == 0
    assert np.fromfile(b, "<u8").tolist() == np.sort(x).tolist()
    assert main(["isSorted", a]) == 2 and main(["isSorted", b]) == 0 and main(["isSorted", str(tmp_path / "none")]) == 1 and main([]) == 1


KEYS = {
    "bigint": lambda i: (i,),
    "string": lambda i: (f"{i:020d}",),
    "pair": lambda i: (i // 3, 3 - i % 3),
}


@pytest.mark.parametrize(("kind", "types"), [("bigint", "key bigint"), ("string", "key string"), ("pair", "a bigint, b bigint")])
def test_index(spark, kind, types):
    key, n = KEYS[kind], 1000
    index = UniqueIndex.empty(spark, types)
    assert index.size() == 0 and index.get(key(1)) is None
    rows = spark.createDataFrame([(*key(i), i * i) for i in range(n)], f"{types}, tid bigint")
    index, rejected = index.insert(rows)
    assert index.size() == n and rejected.count() == 0 and index.get(key(10)) == 100
    again, rejected = index.insert(rows.limit(5))
    assert again.size() == n and rejected.agg(F.sum("n")).head()[0] == 5
    gone = spark.createDataFrame([key(i) for i in range(0, n, 7)], types)
    index, missing = index.erase(gone)
    assert missing.count() == 0 and index.size() == n - 143
    found = index.lookup(spark.createDataFrame([key(i) for i in range(20)], types)).collect()
    assert sum(r.tid is None for r in found) == 3
    assert index.erase(gone)[1].count() == 143


def test_index_range(spark, tmp_path):
    index = UniqueIndex(spark.range(100_000).select(F.col("id").alias("key"), F.col("id").alias("tid")))
    got = [r.tid for r in index.lookup_range(95_000, 91_000).collect()]
    assert got == list(range(91_000, 95_001))
    index.save(str(tmp_path / "i"))
    assert UniqueIndex.load(spark, str(tmp_path / "i")).lookup_range(3, 5).count() == 3
    backward = UniqueIndex(index.df.limit(10), order=(-F.col("key"),))
    assert [r.key for r in backward.lookup_range(2, 4).collect()] == [4, 3, 2]
    dot = UniqueIndex(index.df.where("key < 30")).export_dot(4)
    assert dot.startswith("digraph") and dot.count("label") == 8 + 2 + 1


def test_index_repl(spark, tmp_path):
    out = io.StringIO()
    repl = Repl(spark, out)
    script = ["# comment", "i 1 100", "l 10", "l 10 20 2", "i 101", "i 101", "i 102 200 2", "i 200 300 3", "d 1", "d 10 20 2", f"v {tmp_path / 'x'}", "i a", "i 1 2 0", "x"]
    assert all(repl.run(line) for line in script) and not repl.run("q")
    text = out.getvalue()
    assert text.count("inserted 100 entries") == 1 and "10: 100" in text and "not inserted: 101" in text and "inserted 0 entries" in text
    assert "inserted 50 entries" in text and "inserted 33 entries" in text and "not inserted: 200" in text and "deleted 6 entries" in text and "unknown command" in text
    assert repl.index.size() == 177 and (tmp_path / "x.dot").exists() and text.count("usage: i") == 2


def test_segment(spark, tmp_path):
    table = SegmentTable(spark, str(tmp_path / "seg"), spark.createDataFrame([], "v string").schema)
    assert table.scan().count() == 0
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "v string")
    tids = lambda *t: spark.createDataFrame([(x,) for x in t], "tid bigint")
    assert [r.tid for r in table.insert(rows("Test", "Hello", "World"), "v").orderBy("tid").collect()] == [0, 1, 2]
    assert table.lookup(1).head().v == "Test"
    table.remove(tids(1))
    with pytest.raises(UnknownTid):
        table.lookup(1)
    with pytest.raises(UnknownTid):
        table.remove(tids(1))
    table.remove(tids(1), missing="ignore")
    assert sorted(r.v for r in table.scan().collect()) == ["Hello", "World"]
    assert table.insert(rows("again")).head().tid == 1
    assert table.insert(rows("more")).head().tid == 3
    table.update(spark.createDataFrame([(2, "x" * 1000)], "tid bigint, v string"))
    assert table.lookup(2).head().v == "x" * 1000 and table.lookup(tids(0, 3)).count() == 2
    with pytest.raises(UnknownTid):
        table.update(spark.createDataFrame([(9, "y")], "tid bigint, v string"))


def test_segment_random(spark, tmp_path):
    random.seed(7)
    table, model = SegmentTable(spark, str(tmp_path / "seg"), spark.createDataFrame([], "v string").schema), {}
    for _ in range(5):
        new = table.insert(spark.createDataFrame([(f"{random.random()}",) for _ in range(6)], "v string")).collect()
        model |= {r.tid: r.v for r in new}
        gone = random.sample(sorted(model), 3)
        table.remove(spark.createDataFrame([(t,) for t in gone], "tid bigint"))
        model = {t: v for t, v in model.items() if t not in gone}
        changed = random.choice(sorted(model))
        table.update(spark.createDataFrame([(changed, "new")], "tid bigint, v string"))
        model[changed] = "new"
        assert {r.tid: r.v for r in table.scan().collect()} == model
    assert max(model) < 18


def test_two_q():
    def play(*steps):
        q, out = TwoQ(), []
        for s in steps:
            out.append(q.evict()) if s == "e" else q.access(s)
        return out

    assert play(1, 2, 3, "e", "e", "e") == [1, 2, 3]
    assert play(1, 2, 3, 1, "e", "e", 4, 5, "e", "e", "e") == [2, 3, 4, 5, 1]
    assert play(1, 2, 2, 1, "e", 2, 2, 1, 1, 2, "e") == [2, 1]
    with pytest.raises(LookupError):
        play(1, 1, "e", "e")
    q = TwoQ()
    for p in (1, 1, 2, 2, 3, 3):
        q.access(p)
    q.erase(2)
    assert (q.evict(), q.evict(), len(q)) == (1, 3, 0)


def test_cli(spark, tmp_path, capsys):
    ddl, catalog = tmp_path / "s.sql", str(tmp_path / "catalog")
    ddl.write_text("CREATE TABLE t(a integer not null, primary key(a));")
    assert main(["parseSchema", str(ddl)]) == 0 and main(["loadSchema", str(ddl), catalog]) == 0 and main(["showSchema", catalog]) == 0
    text = "TABLE t:\n  a INTEGER NOT NULL\n  primary key: 0\n"
    assert capsys.readouterr().out == text + text
    Path(ddl).write_text("CREATE")
    assert main(["parseSchema", str(ddl)]) == 1
    assert len({n for _, n, _ in matches(spark, 50, 200)}) == 1
