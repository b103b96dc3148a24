import io

import pytest

from quern.functions import ExpressionFunction, arg, const, is_false, is_true, is_unknown, weak_and, weak_not, weak_or
from quern.functions.expr import horner
from quern.operators import Collector, HashJoin, InMemoryScan, Print, Projection, Selection, TableScan
from quern.operators.hashing import STRATEGIES, lookup_counts, match_count, multiplicity
from quern.operators.numbering import numbered
from quern.types import Cell, TypeTag
from pyspark.sql import functions as F

STUDENTS = InMemoryScan([(1, "Alf", 50), (2, "Bert", 20), (3, "Bert's twin", 20), (4, "Carl", 33)], "c0 int, c1 string, c2 int")
POINTS = InMemoryScan([(1, 50), (3, 3), (4, 90)], "c0 int, c1 int")


def bag(rows):
    return sorted(map(tuple, rows))


def test_scan_and_collect(spark):
    assert [tuple(r) for r in Collector(STUDENTS).run(spark)] == list(STUDENTS.rows)
    assert len(STUDENTS.columns(spark)) == 3
    assert InMemoryScan([(Cell(1), Cell("a"))], "c0 int, c1 string").collect(spark)[0] == (1, "a")
    assert InMemoryScan([], "c0 int").collect(spark) == []


def test_print_is_a_tap(spark):
    out = io.StringIO()
    rows = Print(STUDENTS, out).collect(spark)
    assert out.getvalue() == "1 | Alf | 50\n2 | Bert | 20\n3 | Bert's twin | 20\n4 | Carl | 33\n"
    assert bag(rows) == bag(STUDENTS.rows)
    out = io.StringIO()
    Print(InMemoryScan([(None, "x")], "a int, b string"), out).run(spark)
    assert out.getvalue() == "Undefined | x\n"


def test_table_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    STUDENTS.to_df(spark).write.parquet(path)
    assert bag(TableScan(path).collect(spark)) == bag(STUDENTS.rows)
    assert bag(Selection(TableScan(path, "c0 int, c1 string, c2 int"), 2, 20).collect(spark)) == [(2, "Bert", 20), (3, "Bert's twin", 20)]


def test_pushdown_reaches_the_scan(spark, sf_dir):
    plan = Projection(Selection(TableScan(f"{sf_dir}/lineitem.parquet"), 3, 3), [0]).to_df(spark)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_linenumber,3)" in text and "l_comment" not in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in text


@pytest.mark.parametrize(("node", "places", "expected"), [(STUDENTS, [2], [(20,), (20,), (33,), (50,)]), (STUDENTS, [2, 2], [(20, 20), (20, 20), (33, 33), (50, 50)]), (POINTS, [1, 0], [(3, 3), (50, 1), (90, 4)])])
def test_projection(spark, node, places, expected):
    assert bag(Projection(node, places).collect(spark)) == expected
    with pytest.raises(IndexError):
        Projection(node, [9]).collect(spark)


def test_selection_is_type_strict(spark):
    assert bag(Selection(STUDENTS, 2, 20).collect(spark)) == [(2, "Bert", 20), (3, "Bert's twin", 20)]
    assert Selection(STUDENTS, 1, Cell("Carl")).collect(spark)[0].c0 == 4
    for place, constant in ((0, "1"), (1, 1), (0, None), (0, True), (0, 1.0)):
        assert Selection(STUDENTS, place, constant).collect(spark) == []


def test_join(spark):
    joined = Projection(HashJoin(STUDENTS, POINTS, 0, 0), [0, 1, 4])
    assert bag(joined.collect(spark)) == [(1, "Alf", 50), (3, "Bert's twin", 3), (4, "Carl", 90)]


@pytest.mark.parametrize("build", [None, "broadcast", "shuffle_hash"])
def test_self_join(spark, build):
    rows = HashJoin(STUDENTS, STUDENTS, 2, 2, build).collect(spark)
    assert sorted((r[0], r[3]) for r in rows) == [(1, 1), (2, 2), (2, 3), (3, 2), (3, 3), (4, 4)]
    assert len(rows[0]) == 6


def test_join_edges(spark):
    assert HashJoin(Selection(STUDENTS, 0, 99), POINTS, 0, 0).collect(spark) == []
    assert HashJoin(STUDENTS, POINTS, 1, 0).collect(spark) == []
    nulls = InMemoryScan([(None,), (1,)], "k int")
    assert len(HashJoin(nulls, nulls, 0, 0).collect(spark)) == 1
    with pytest.raises(ValueError):
        HashJoin(STUDENTS, POINTS, 0, 0, "left").collect(spark)
    big = HashJoin(STUDENTS, POINTS, 0, 0, "broadcast", broadcast_limit=0).to_df(spark)
    assert "Broadcast" not in big._jdf.queryExecution().sparkPlan().toString()


def test_nodes_run_again(spark):
    node = HashJoin(STUDENTS, POINTS, 0, 0)
    assert bag(node.collect(spark)) == bag(node.collect(spark))


def test_cells():
    a, b = Cell(12), Cell("hello")
    assert (a.type, b.type, Cell().type) == (TypeTag.INTEGER, TypeTag.CHAR, TypeTag.INVALID)
    with pytest.raises(TypeError):
        a.string
    with pytest.raises(TypeError):
        b.integer
    assert Cell(5) < Cell(10) and Cell("hallo") < Cell("welt") and a != b and a < b and Cell(5) == Cell(5) and hash(Cell(5)) == hash(Cell(5))
    a.integer = 42
    assert a.integer == 42 and str(a) == "42" and str(b) == "hello" and str(Cell()) == "Undefined"
    with pytest.raises(TypeError):
        Cell() < a


def test_weak_logic(spark):
    cells = [(a, b) for a in (True, False, None) for b in (True, False, None)]
    df = spark.createDataFrame(cells, "a boolean, b boolean")
    a, b = F.col("a"), F.col("b")
    for r in df.select("a", "b", weak_and(a, b).alias("x"), weak_or(a, b).alias("y"), weak_not(a).alias("z"), is_true(a).alias("t"), is_false(a).alias("f"), is_unknown(a).alias("u")).collect():
        unknown = r.a is None or r.b is None
        assert r.x == (None if unknown else r.a and r.b) and r.y == (None if unknown else r.a or r.b)
        assert r.z == (None if r.a is None else not r.a) and (r.t, r.f, r.u) == (r.a is True, r.a is False, r.a is None)


def value(spark, f, *args):
    return spark.range(1).select(f(*(F.lit(a).cast("bigint") for a in args))).head()[0]


def test_expressions(spark):
    f = ExpressionFunction("f", arg(1) + (arg(0) - 2))
    assert f.arity == 2 and value(spark, f, 42, 42) == 82
    p = ExpressionFunction("p", horner([1, 4, 3, 0, 1], arg(0)))
    assert [value(spark, p, x) for x in (0, 1, 2, 5, 10, -1, -2)] == [1, 9, 37, 721, 10341, 1, 21]
    assert value(spark, ExpressionFunction("s", 5 - arg(0)), 3) == 2 and value(spark, ExpressionFunction("q", 10 / arg(0)), 3) == 3
    assert [value(spark, ExpressionFunction("d", arg(0) / 2), x) for x in (-3, 3, -4)] == [-1, 1, -2]
    assert value(spark, ExpressionFunction("m", 2 * -arg(0) + const(1)), 4) == -7
    x = arg(0)
    x += 1
    x *= 3
    assert value(spark, ExpressionFunction("i", x), 1) == 6
    with pytest.raises(OverflowError):
        const(1 << 63)
    with pytest.raises(TypeError):
        f(F.lit(1))


def test_wrapping(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    wrap = lambda v: (v + (1 << 63)) % (1 << 64) - (1 << 63)
    for a, b in ((high, 1), (low, -1), (high, high), (low, low), (3, 5), (low, high)):
        assert value(spark, ExpressionFunction("a", arg(0) + arg(1), wrap=True), a, b) == wrap(a + b)
        assert value(spark, ExpressionFunction("s", arg(0) - arg(1), wrap=True), a, b) == wrap(a - b)
        assert value(spark, ExpressionFunction("m", arg(0) * arg(1), wrap=True), a, b) == wrap(a * b)
        assert value(spark, ExpressionFunction("n", -arg(0), wrap=True), a) == wrap(-a)


def test_matches(spark):
    r = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k bigint")
    s = spark.createDataFrame([(1,), (1,), (3,), (None,)], "k bigint")
    assert {match_count(r, s, "k", x).head()[0] for x in STRATEGIES} == {4}
    assert {match_count(r.limit(0), s, "k", x).head()[0] for x in STRATEGIES} == {0}
    assert bag(multiplicity(r, "k").collect()) == [(1, 2), (2, 1)]
    assert sorted(x.multiplicity for x in lookup_counts(r, s, "k").collect()) == [0, 0, 2, 2]
    with pytest.raises(ValueError):
        match_count(r, s, "k", "?")


def test_numbered(spark):
    df = spark.range(1000, numPartitions=7).select((999 - F.col("id")).alias("v"))
    assert sorted(map(tuple, numbered(df, "n", "v", start=5).collect())) == [(i + 5, i) for i in range(1000)]
    assert numbered(df.limit(0), "n").collect() == []


def test_streaming_leaf(spark, tmp_path):
    STUDENTS.to_df(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("c0 int, c1 string, c2 int").parquet(str(tmp_path / "in"))
    q = Selection(TableScan(stream), 2, 20).to_df(spark).writeStream.format("memory").queryName("picked").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("picked").count() == 2
