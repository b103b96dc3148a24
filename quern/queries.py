"""Registered queries of the relational operators and their SQL; each reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ExpressionFunction, arg, const, is_false, is_true, is_unknown, weak_and, weak_not, weak_or
from .functions.expr import horner
from .operators import Collector, HashJoin, InMemoryScan, Node, Print, Projection, Selection, TableScan
from .operators.hashing import lookup_counts, match_count, multiplicity
from .operators.index import UniqueIndex
from .operators.nodes import printed
from .operators.numbering import numbered
from .operators.two_q import TwoQ
from .sources import Catalog, ParserError, parse
from .sources.records import decoded, encoded
from .sources.scratch import scratch
from .sources.segment import SegmentTable, UnknownTid, replaced, without
from .sources.u64 import external_sort, generate, is_sorted, read_u64, shown, write_u64
from .types import Cell

#: Rows of an in-memory table: number, name, weight; a quote, a repeated weight, an empty and a longer name.
PARCELS = ((1, "lamp", 900), (2, "o'clock", 150), (3, "", 150), (4, "two wooden chairs", 7300), (5, "lamp", 20))
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def scan(sf_dir: str, name: str) -> TableScan:
    return TableScan(f"{sf_dir}/{name}.parquet")


def _place(node: Node, spark: SparkSession, *names: str) -> list[int]:
    columns = node.columns(spark)
    return [columns.index(n) for n in names]


@query("SELECT * FROM nation")
def scan_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(sf_dir, "nation").to_df(spark)


@query("SELECT * FROM (VALUES (1, 'lamp', 900), (2, 'o''clock', 150), (3, '', 150), (4, 'two wooden chairs', 7300), (5, 'lamp', 20)) s(c0, c1, c2)")
def scan_in_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return InMemoryScan(PARCELS, "c0 int, c1 string, c2 int").to_df(spark)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def print_tap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that a printing node passes on; its lines go to a string, whose number of lines must be theirs."""
    import io

    out = io.StringIO()
    df = Print(scan(sf_dir, "nation"), out).to_df(spark)
    if out.getvalue().count("\n") != df.count():
        raise AssertionError("a line for each row")
    return df


@query("SELECT r_regionkey, r_name FROM region")
def collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(Collector(scan(sf_dir, "region")).run(spark), "r_regionkey int, r_name string")


@query("SELECT * FROM (VALUES (0, '-5'), (1, '3'), (2, '20'), (3, ''), (4, '20'), (5, 'a'), (6, 'b')) c(place, cell)")
def cell_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of both types in their order: whole numbers first, strings by their bytes."""
    cells = sorted(map(Cell, ["b", 20, "", "20", 3, "a", -5]))
    return spark.createDataFrame([(i, str(c)) for i, c in enumerate(cells)], "place int, cell string")


@query("SELECT n_nationkey || ' | ' || n_name || ' | ' || n_regionkey AS value FROM nation")
def print_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return printed(scan(sf_dir, "nation").to_df(spark))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def record_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scan(sf_dir, "nation").to_df(spark)
    return decoded(encoded(df), df.schema)


@query("SELECT c_mktsegment FROM customer")
def project_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = scan(sf_dir, "customer")
    return Projection(node, _place(node, spark, "c_mktsegment")).to_df(spark)


@query("SELECT n_name, n_nationkey FROM nation")
def project_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Projection(scan(sf_dir, "nation"), [1, 0]).to_df(spark)


@query("SELECT n_regionkey AS c0, n_regionkey AS c1 FROM nation")
def project_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Projection(scan(sf_dir, "nation"), [2, 2]).to_df(spark)


def _select(spark: SparkSession, sf_dir: str, name: str, column: str, value: object) -> DataFrame:
    node = scan(sf_dir, name)
    return Selection(node, _place(node, spark, column)[0], value).to_df(spark)


@query("SELECT * FROM lineitem WHERE l_linenumber = 3")
def select_eq_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, "lineitem", "l_linenumber", 3)


@query("SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")
def select_eq_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, "customer", "c_mktsegment", "BUILDING")


@query("SELECT * FROM nation WHERE n_nationkey = 999")
def select_no_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, "nation", "n_nationkey", 999)


@query("SELECT * FROM nation WHERE false")
def select_type_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, "nation", "n_nationkey", "1")


@query("SELECT * FROM customer JOIN orders ON c_custkey = o_custkey")
def hash_join_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return HashJoin(scan(sf_dir, "customer"), scan(sf_dir, "orders"), 0, 1).to_df(spark)


@query("SELECT a.c_custkey AS c0, a.c_name AS c1, b.c_custkey AS c2 FROM customer a JOIN customer b ON a.c_name = b.c_name")
def hash_join_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = [Projection(scan(sf_dir, "customer"), [0, 1]) for _ in range(2)]
    return Projection(HashJoin(*two, 1, 1), [0, 1, 2], ["c0", "c1", "c2"]).to_df(spark)


@query("SELECT a.n_nationkey l0, a.n_name l1, a.n_regionkey l2, b.n_nationkey r0, b.n_name r1, b.n_regionkey r2 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def hash_join_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    return HashJoin(scan(sf_dir, "nation"), scan(sf_dir, "nation"), 2, 2).to_df(spark)


@query("SELECT n_name, r_name FROM region JOIN nation ON r_regionkey = n_regionkey WHERE r_regionkey = 999")
def hash_join_empty_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    join = HashJoin(Selection(scan(sf_dir, "region"), 0, 999), scan(sf_dir, "nation"), 0, 2)
    return Projection(join, _place(join, spark, "n_name", "r_name")).to_df(spark)


@query("SELECT n_name, r_name FROM region JOIN nation ON r_regionkey = n_regionkey")
def hash_join_build_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    join = HashJoin(scan(sf_dir, "region"), scan(sf_dir, "nation"), 0, 2, build="shuffle_hash")
    return Projection(join, _place(join, spark, "n_name", "r_name")).to_df(spark)


@query("SELECT * FROM nation JOIN customer ON n_nationkey = c_nationkey")
def hash_join_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return HashJoin(scan(sf_dir, "nation"), scan(sf_dir, "customer"), 0, 2, build="broadcast").to_df(spark)


@query("SELECT n_name, r_name FROM region JOIN nation ON false")
def hash_join_type_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    join = HashJoin(scan(sf_dir, "region"), scan(sf_dir, "nation"), 1, 2)
    return Projection(join, _place(join, spark, "n_name", "r_name")).to_df(spark)


@query("SELECT o_orderkey, o_totalprice, c_name, c_mktsegment FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'F'")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = scan(sf_dir, "orders")
    join = HashJoin(scan(sf_dir, "customer"), Selection(orders, _place(orders, spark, "o_orderstatus")[0], "F"), 0, 1)
    return Projection(join, _place(join, spark, "o_orderkey", "o_totalprice", "c_name", "c_mktsegment")).to_df(spark)


@query("SELECT c_custkey, c_name, n_name, r_name FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey WHERE r_name = 'ASIA'")
def left_deep_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = HashJoin(Selection(scan(sf_dir, "region"), 1, "ASIA"), scan(sf_dir, "nation"), 0, 2)
    join = HashJoin(first, scan(sf_dir, "customer"), _place(first, spark, "n_nationkey")[0], 2)
    return Projection(join, _place(join, spark, "c_custkey", "c_name", "n_name", "r_name")).to_df(spark)


def _keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    one = scan(sf_dir, "orders").to_df(spark).select(F.col("o_orderkey").alias("k"))
    return one, scan(sf_dir, "lineitem").to_df(spark).select(F.col("l_orderkey").alias("k"))


_MATCHES = "SELECT count(*) AS matches FROM orders JOIN lineitem ON o_orderkey = l_orderkey"


@query(_MATCHES)
def match_count_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_count(*_keys(spark, sf_dir), "k", "join")


@query(_MATCHES)
def match_count_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_count(*_keys(spark, sf_dir), "k", "counted_both")


@query("SELECT l_orderkey AS k, count(*) AS multiplicity FROM lineitem GROUP BY l_orderkey")
def key_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiplicity(_keys(spark, sf_dir)[1], "k")


@query("SELECT s.k, coalesce(r.multiplicity, 0) AS multiplicity FROM (SELECT o_orderkey * 2 AS k FROM orders) s LEFT JOIN (SELECT l_orderkey AS k, count(*) AS multiplicity FROM lineitem GROUP BY 1) r ON r.k = s.k")
def key_lookup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, many = _keys(spark, sf_dir)
    return lookup_counts(many, one.select((F.col("k") * 2).alias("k")), "k")


def _index(spark: SparkSession, sf_dir: str) -> UniqueIndex:
    df = scan(sf_dir, "orders").to_df(spark)
    return UniqueIndex(df.select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("tid")))


_INDEX = "FROM (SELECT o_orderkey AS key, o_custkey AS tid FROM orders)"


@query(f"SELECT key, tid {_INDEX} WHERE key = 10")
def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).lookup(10)


@query("SELECT k.key, i.tid FROM (SELECT DISTINCT l_orderkey * 2 AS key FROM lineitem) k LEFT JOIN (SELECT o_orderkey AS key, o_custkey AS tid FROM orders) i ON k.key = i.key")
def index_batch_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = scan(sf_dir, "lineitem").to_df(spark).select((F.col("l_orderkey") * 2).alias("key")).distinct()
    return _index(spark, sf_dir).lookup(keys)


@query(f"SELECT key, tid {_INDEX} WHERE key BETWEEN 100 AND 500 ORDER BY key")
def index_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).lookup_range(500, 100)


@query("SELECT c_name AS key, c_custkey AS tid FROM customer WHERE c_name BETWEEN 'Customer#000000010' AND 'Customer#000000020'")
def index_range_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scan(sf_dir, "customer").to_df(spark).select(F.col("c_name").alias("key"), F.col("c_custkey").alias("tid"))
    return UniqueIndex(df).lookup_range("Customer#000000010", "Customer#000000020")


@query("SELECT l_orderkey AS a, l_linenumber AS b, min(l_partkey) AS tid FROM lineitem WHERE (l_orderkey = 3 AND l_linenumber >= 2) OR (l_orderkey > 3 AND l_orderkey < 9) OR (l_orderkey = 9 AND l_linenumber <= 4) GROUP BY 1, 2")
def index_range_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scan(sf_dir, "lineitem").to_df(spark).groupBy(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b")).agg(F.min("l_partkey").alias("tid"))
    return UniqueIndex(df, ("a", "b")).lookup_range((9, 4), (3, 2))


def _spelled(spark: SparkSession, sf_dir: str) -> UniqueIndex:
    """Names of nations, every other one in lower case, in an index whose comparator ignores case."""
    key = F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("key")
    rows = scan(sf_dir, "nation").to_df(spark).select(key, F.col("n_nationkey").cast("bigint").alias("tid"))
    return UniqueIndex.empty(spark, "key string", (F.lower("key"),)).insert(rows)[0]


_SPELLED = "(SELECT CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS key, n_nationkey::BIGINT AS tid FROM nation)"


@query(f"SELECT key, tid FROM {_SPELLED} WHERE lower(key) BETWEEN 'nation_10' AND 'nation_2'")
def index_comparator_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spelled(spark, sf_dir).lookup_range("Nation_2", "NATION_10")


@query(f"SELECT upper(key) AS key, tid + 100 AS tid, 1::BIGINT AS n FROM {_SPELLED}")
def index_comparator_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _spelled(spark, sf_dir)
    more = index.df.select(F.upper("key").alias("key"), (F.col("tid") + 100).alias("tid"))
    return index.insert(more.union(spark.createDataFrame([("Atlantis", 500)], "key string, tid bigint")))[1]


@query(f"SELECT upper(key) AS key, CASE WHEN tid % 3 = 0 THEN NULL ELSE tid END AS tid FROM {_SPELLED}")
def index_comparator_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _spelled(spark, sf_dir)
    left = index.erase(index.df.where("tid % 3 = 0").select(F.initcap("key").alias("key")))[0]
    return left.lookup(index.df.select(F.upper("key").alias("key")))


@query(f"SELECT 2 * key + 1 AS key {_INDEX} WHERE 2 * key + 1 > (SELECT max(o_orderkey) FROM orders)")
def index_erase_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    return index.erase(index.df.select((F.col("key") * 2 + 1).alias("key")))[1]


@query("""WITH l AS (SELECT r_regionkey // 2 AS n, '  n' || (r_regionkey // 2) || ' [label="' || string_agg(r_regionkey || ': ' || r_regionkey, '|' ORDER BY r_regionkey) || '"];' AS line, max(r_regionkey) AS top FROM region GROUP BY 1, r_regionkey // 2)
SELECT line FROM l UNION ALL SELECT 'digraph index {' UNION ALL SELECT '  node [shape=record];' UNION ALL SELECT '}'
UNION ALL SELECT '  n' || (n - 1) || ' -> n' || n || ' [style=dashed, constraint=false];' FROM l WHERE n > 0
UNION ALL SELECT * FROM (VALUES ('  n3 [label="1|3"];'), ('  n3 -> n0;'), ('  n3 -> n1;'), ('  n4 [label="4"];'), ('  n4 -> n2;'), ('  n5 [label="3|4"];'), ('  n5 -> n3;'), ('  n5 -> n4;'))""")
def index_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a drawing with two entries a node."""
    rows = scan(sf_dir, "region").to_df(spark).select(F.col("r_regionkey").alias("key"), F.col("r_regionkey").alias("tid"))
    return spark.createDataFrame([(x,) for x in UniqueIndex(rows).export_dot(2).splitlines()], "line string")


@query(f"SELECT key, tid {_INDEX} WHERE key BETWEEN 70 AND 90")
def index_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of an index that was stored and read again."""
    path = scratch(spark, "index") + "/stored"
    _index(spark, sf_dir).save(path)
    return UniqueIndex.load(spark, path).lookup_range(70, 90)


@query(f"SELECT key, tid {_INDEX} WHERE key % 7 <> 0")
def index_erase(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    return index.erase(index.df.where("key % 7 = 0"))[0].df


@query("SELECT count(*) AS size FROM (SELECT DISTINCT o_orderkey FROM orders)")
def index_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).df.agg(F.count("*").alias("size"))


_ROW = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey AS tid FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_ROW}) rn FROM lineitem) WHERE rn = 1")
def index_insert_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(sf_dir, "lineitem").to_df(spark).select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("tid"))
    return UniqueIndex.empty(spark, "l_orderkey bigint, l_linenumber int").insert(rows)[0].df


@query("SELECT l_orderkey, l_linenumber, min(l_partkey) AS tid, count(*) - 1 AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def index_insert_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(sf_dir, "lineitem").to_df(spark).select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("tid"))
    return UniqueIndex.empty(spark, "l_orderkey bigint, l_linenumber int").insert(rows)[1]


@query("SELECT l_linenumber, 1 + x * (4 + x * (3 + x * (0 + x * (1 + x * 0)))) AS p FROM (SELECT l_linenumber, CAST(l_linenumber AS BIGINT) AS x FROM lineitem)")
def expr_polynomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ExpressionFunction("p", horner([1, 4, 3, 0, 1], arg(0)))
    return f.on(scan(sf_dir, "lineitem").to_df(spark).select("l_linenumber"), "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, (l_linenumber::BIGINT - 4) // 2 AS d FROM lineitem")
def expr_div(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ExpressionFunction("d", (arg(0) - 4) / 2)
    return f.on(scan(sf_dir, "lineitem").to_df(spark).select("l_orderkey", "l_linenumber"), "l_linenumber")


@query("SELECT o_orderkey, o_custkey + (o_orderkey - 2) AS e FROM orders")
def expr_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ExpressionFunction("e", arg(1) + (arg(0) - 2))
    return f.on(scan(sf_dir, "orders").to_df(spark).select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey").drop("o_custkey")


@query("SELECT o_orderkey, -o_custkey AS n, 5 - o_custkey AS s FROM orders")
def expr_neg(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scan(sf_dir, "orders").to_df(spark)
    return df.select("o_orderkey", ExpressionFunction("n", -arg(0))(F.col("o_custkey")), ExpressionFunction("s", 5 - arg(0))(F.col("o_custkey")))


@query("""SELECT o_orderkey, ((((x * y + 9223372036854775808::HUGEINT) % 18446744073709551616::HUGEINT) + 18446744073709551616::HUGEINT)
% 18446744073709551616::HUGEINT - 9223372036854775808::HUGEINT)::BIGINT AS w
FROM (SELECT o_orderkey, o_orderkey::HUGEINT * 9007199254740993::HUGEINT AS x, 3037000507::HUGEINT AS y FROM orders)""")
def expr_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ExpressionFunction("w", arg(0) * const(9007199254740993) * const(3037000507), wrap=True)
    return f.on(scan(sf_dir, "orders").to_df(spark).select("o_orderkey"), "o_orderkey")


@query("""SELECT a, b, CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE a AND b END x, CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE a OR b END y, NOT a z
FROM (VALUES (true), (false), (CAST(NULL AS BOOLEAN))) l(a), (VALUES (true), (false), (CAST(NULL AS BOOLEAN))) r(b)""")
def logic_weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = [(a, b) for a in (True, False, None) for b in (True, False, None)]
    a, b = F.col("a"), F.col("b")
    return InMemoryScan(cells, "a boolean, b boolean").to_df(spark).select(a, b, weak_and(a, b).alias("x"), weak_or(a, b).alias("y"), weak_not(a).alias("z"))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey")
def sort_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(sf_dir, "orders").to_df(spark).select("o_orderkey").orderBy("o_orderkey")


@query("SELECT a, a IS NOT NULL AND a AS t, a IS NOT NULL AND NOT a AS f, a IS NULL AS u FROM (VALUES (true), (false), (CAST(NULL AS BOOLEAN))) l(a)")
def logic_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("a")
    return InMemoryScan([(True,), (False,), (None,)], "a boolean").to_df(spark).select(a, is_true(a).alias("t"), is_false(a).alias("f"), is_unknown(a).alias("u"))


def _unsigned(spark: SparkSession, sf_dir: str) -> str:
    """A folder of unsigned numbers, a multiple of each order's key modulo 2**64, in the order of the keys."""
    wide, half, whole = "decimal(38,0)", F.lit("9223372036854775808").cast("decimal(38,0)"), F.lit("18446744073709551616").cast("decimal(38,0)")
    value = F.pmod(F.col("o_orderkey").cast("decimal(18,0)") * F.lit("11400714819323198485").cast("decimal(20,0)"), whole).cast(wide)
    path = scratch(spark, "u64") + "/numbers"
    rows = scan(sf_dir, "orders").to_df(spark).select("o_orderkey", (value - half).cast("bigint").alias("k"))
    write_u64(rows.orderBy("o_orderkey").select("k"), path)
    return path


_UNSIGNED = "(SELECT o_orderkey, (o_orderkey::HUGEINT * 11400714819323198485::HUGEINT) % 18446744073709551616::HUGEINT AS v FROM orders)"


@query(f"SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS place, v::DECIMAL(20, 0) AS v FROM {_UNSIGNED}")
def u64_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_u64(spark, _unsigned(spark, sf_dir)).select("place", shown(F.col("k")).alias("v"))


@query(f"SELECT row_number() OVER (ORDER BY v) - 1 AS place, v::DECIMAL(20, 0) AS v FROM {_UNSIGNED}")
def u64_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers after an external sort from files to files, read back."""
    source = _unsigned(spark, sf_dir)
    external_sort(spark, source, f"{source}.sorted")
    return read_u64(spark, f"{source}.sorted").select("place", shown(F.col("k")).alias("v"))


@query(f"""SELECT 'source' AS file, NOT EXISTS (SELECT 1 FROM (SELECT v, lag(v) OVER (ORDER BY o_orderkey) AS p FROM {_UNSIGNED}) WHERE p > v) AS s
UNION ALL SELECT 'sorted', NOT EXISTS (SELECT 1 FROM (SELECT v, lag(v) OVER (ORDER BY v) AS p FROM {_UNSIGNED}) WHERE p > v)""")
def u64_is_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check on a sequence that is not in order, and on what the sort made of it."""
    source = _unsigned(spark, sf_dir)
    external_sort(spark, source, f"{source}.sorted", single=True)
    return spark.createDataFrame([(name, is_sorted(spark, path)) for name, path in (("source", source), ("sorted", f"{source}.sorted"))], "file string, s boolean")


_ORDERS = "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS place, {} AS k FROM orders"


@query(f"""SELECT 'key' AS c, NOT EXISTS (SELECT 1 FROM (SELECT k, lag(k) OVER (ORDER BY place) AS p FROM ({_ORDERS.format('o_orderkey')})) WHERE p > k) AS s
UNION ALL SELECT 'customer', NOT EXISTS (SELECT 1 FROM (SELECT k, lag(k) OVER (ORDER BY place) AS p FROM ({_ORDERS.format('o_custkey')})) WHERE p > k)""")
def rows_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two columns of orders never fall in the order of the keys."""
    from .sources.u64 import sorted_in_order

    rows = numbered(scan(sf_dir, "orders").to_df(spark).select("o_orderkey", "o_custkey"), "place", "o_orderkey")
    found = [(name, sorted_in_order(rows.select("place", F.col(c).alias("k")))) for name, c in (("key", "o_orderkey"), ("customer", "o_custkey"))]
    return spark.createDataFrame(found, "c string, s boolean")


@query("""WITH RECURSIVE g AS (SELECT 0 AS place, 88172645463325252::HUGEINT AS x UNION ALL
SELECT place + 1, xor(b, (b << 17) % 18446744073709551616::HUGEINT) FROM (SELECT place, xor(a, a >> 7) AS b FROM (SELECT place, xor(x, (x << 13) % 18446744073709551616::HUGEINT) AS a FROM g WHERE place < 500)))
SELECT place - 1 AS place, x::DECIMAL(20, 0) AS v FROM g WHERE place > 0""")
def u64_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 numbers of the fixture generator, through a file."""
    path = scratch(spark, "u64") + "/generated"
    generate(path, 500)
    return read_u64(spark, path).select("place", shown(F.col("k")).alias("v"))


def _tids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(scan(sf_dir, "orders").to_df(spark).select("o_orderkey"), "tid", "o_orderkey")


_TIDS = "(SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS tid, o_orderkey FROM orders)"


@query(f"SELECT tid, o_orderkey FROM {_TIDS}")
def tid_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tids(spark, sf_dir)


@query(f"SELECT tid, o_orderkey FROM {_TIDS} WHERE tid = 42")
def tid_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tids(spark, sf_dir).where(F.col("tid") == 42)


@query(f"SELECT tid, o_orderkey FROM {_TIDS} WHERE tid % 3 <> 0")
def tid_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tids(spark, sf_dir)
    return without(rows, rows.where("tid % 3 = 0"))


@query(f"SELECT tid, CASE WHEN tid % 5 = 0 THEN -o_orderkey ELSE o_orderkey END AS o_orderkey FROM {_TIDS}")
def tid_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tids(spark, sf_dir)
    return replaced(rows, rows.where("tid % 5 = 0").withColumn("o_orderkey", -F.col("o_orderkey")))


def _segment(spark: SparkSession, sf_dir: str) -> SegmentTable:
    """The nations, stored, without every third; then the regions, which take the freed ids."""
    rows = scan(sf_dir, "nation").to_df(spark).select(F.col("n_nationkey").alias("number"), F.col("n_name").alias("name"))
    table = SegmentTable(spark, scratch(spark, "segment"), rows.schema)
    table.insert(rows, "number")
    table.remove(table.scan().where("number % 3 = 0"))
    table.insert(scan(sf_dir, "region").to_df(spark).select(F.col("r_regionkey").alias("number"), F.col("r_name").alias("name")), "number")
    return table


_SEGMENT = """(SELECT n_nationkey::BIGINT AS tid, n_nationkey AS number, n_name AS name FROM nation WHERE n_nationkey % 3 <> 0
UNION ALL SELECT 3 * r_regionkey::BIGINT, r_regionkey, r_name FROM region)"""


@query(f"SELECT tid, number, name FROM {_SEGMENT}")
def segment_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segment(spark, sf_dir).scan()


@query("SELECT n_nationkey::BIGINT AS tid FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey >= 3 * (SELECT count(*) FROM region)")
def segment_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that are free for the next rows."""
    return _segment(spark, sf_dir).free()


@query(f"SELECT tid, number, name FROM {_SEGMENT} WHERE tid IN (3, 4)")
def segment_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _segment(spark, sf_dir)
    return table.lookup(3).union(table.lookup(spark.createDataFrame([(4,)], "tid bigint")))


@query(f"SELECT tid, CASE WHEN tid % 2 = 0 THEN -number ELSE number END AS number, CASE WHEN tid % 2 = 0 THEN 'a longer name than before: ' || name ELSE name END AS name FROM {_SEGMENT}")
def segment_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that grow keep their ids."""
    table = _segment(spark, sf_dir)
    table.update(table.scan().where("tid % 2 = 0").select("tid", (-F.col("number")).alias("number"), F.concat(F.lit("a longer name than before: "), "name").alias("name")))
    return table.scan()


@query("SELECT * FROM (VALUES ('lookup', true), ('remove', true), ('remove again', false), ('update', true)) u(action, raised)")
def segment_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an id without a row does; only a removal that asks to passes over it."""
    table, none = _segment(spark, sf_dir), spark.createDataFrame([(99_999, 1, "x")], "tid bigint, number int, name string")
    actions = {"lookup": lambda: table.lookup(99_999), "remove": lambda: table.remove(none), "remove again": lambda: table.remove(none, missing="ignore"), "update": lambda: table.update(none)}
    out = []
    for name, act in actions.items():
        try:
            act()
            out.append((name, False))
        except UnknownTid:
            out.append((name, True))
    return spark.createDataFrame(out, "action string, raised boolean")


DDL = """create table Shelf ( id INTEGER not null, label char(12), Width integer, PRIMARY KEY (id, label) );
CREATE TABLE box (weight Numeric(8, 2) NOT NULL, primary key (weight), owner CHAR(3) not NULL,);"""
_ATTRIBUTES = """(VALUES ('Shelf', 0, 'id', 'INTEGER', NULL, true, true), ('Shelf', 1, 'label', 'CHAR', 12, false, true), ('Shelf', 2, 'Width', 'INTEGER', NULL, false, false),
('box', 0, 'weight', 'NUMERIC', NULL, true, true), ('box', 1, 'owner', 'CHAR', 3, true, false)) d(relation, place, attribute, type, length, not_null, is_key)"""


def _attributes(spark: SparkSession, relations: list) -> DataFrame:
    rows = [(r.name, i, a.name, a.type.name, a.length, a.not_null, i in r.primary_key) for r in relations for i, a in enumerate(r.attributes)]
    return spark.createDataFrame(rows, "relation string, place int, attribute string, type string, length int, not_null boolean, is_key boolean")


@query(f"SELECT * FROM {_ATTRIBUTES}")
def ddl_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attributes(spark, parse(DDL))


@query(f"SELECT * FROM {_ATTRIBUTES}")
def catalog_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relations after they were stored in a catalog and read again."""
    catalog = Catalog(scratch(spark, "catalog") + "/relations")
    catalog.store(spark, parse(DDL))
    return _attributes(spark, catalog.read(spark))


@query("SELECT * FROM (VALUES (0, 'TABLE Shelf:'), (1, '  id INTEGER NOT NULL'), (2, '  label CHAR(12)'), (3, '  Width INTEGER'), (4, '  primary key: 0 1'), (5, 'TABLE box:'), (6, '  weight NUMERIC(8, 2) NOT NULL'), (7, '  owner CHAR(3) NOT NULL'), (8, '  primary key: 0')) l(place, line)")
def ddl_print(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate("".join(map(str, parse(DDL))).splitlines())), "place int, line string")


@query("SELECT * FROM (VALUES (0, 2), (1, 1), (2, 3), (3, 1), (4, 0)) e(number, line)")
def ddl_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines at which texts stop making sense; 0 for a blank one, which has no relation."""
    texts = ("create table a (x integer,\ny text);", "create table a (x integer)", "create table a (\nx integer,\nprimary key (z));", "drop table a;", " \n\t ")
    out = []
    for i, text in enumerate(texts):
        try:
            out.append((i, len(parse(text))))
        except ParserError as e:
            out.append((i, e.line))
    return spark.createDataFrame(out, "number int, line int")


@query("SELECT * FROM (VALUES (0, 'b'), (1, 'd'), (2, 'c'), (3, 'a'), (4, 'none')) t(place, page)")
def two_q_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What leaves in turn after a, b, a, c, c, d, e, a were used and e was erased: first those used once."""
    queue, out = TwoQ(), []
    for page in "abaccdea":
        queue.access(page)
    queue.erase("e")
    for place in range(5):
        try:
            out.append((place, queue.evict()))
        except LookupError:
            out.append((place, "none"))
    return spark.createDataFrame(out, "place int, page string")


@query("SELECT * FROM (VALUES (0, 'inserted 5 entries'), (1, '3: 9'), (2, 'deleted 1 entries'), (3, '2: not found'), (4, 'not inserted: 3'), (5, 'inserted 0 entries'), (6, 'not there: 2'), (7, 'deleted 0 entries'), (8, 'unknown command')) r(place, line)")
def index_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an interactive index answers to typed commands."""
    import io

    from .cli.__main__ import Repl

    repl = Repl(spark, io.StringIO())
    for line in ("# squares", "i 1 5", "l 3", "d 2", "l 2", "i 3", "d 2", "x", ""):
        repl.run(line)
    return spark.createDataFrame(list(enumerate(repl.out.getvalue().splitlines())), "place int, line string")


@query("SELECT * FROM (VALUES (0, 'generate', 0), (1, 'isSorted', 2), (2, 'sort', 0), (3, 'isSorted', 0), (4, 'parseSchema', 0), (5, 'loadSchema', 0), (6, 'showSchema', 0), (7, 'parseSchema', 1), (8, 'isSorted', 1)) c(place, command, code)")
def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit codes of the command line, on files of a folder on the driver."""
    import contextlib
    import io
    import tempfile

    from .cli.__main__ import main

    with tempfile.TemporaryDirectory() as folder, contextlib.redirect_stdout(io.StringIO()), contextlib.redirect_stderr(io.StringIO()):
        with open(f"{folder}/good.sql", "w") as f:
            f.write(DDL)
        with open(f"{folder}/bad.sql", "w") as f:
            f.write("create table")
        numbers, sorted_, catalog = (scratch(spark, "commands") + "/" + x for x in ("numbers", "sorted", "catalog"))
        lines = (["generate", numbers, "300"], ["isSorted", numbers], ["sort", numbers, sorted_], ["isSorted", sorted_], ["parseSchema", f"{folder}/good.sql"], ["loadSchema", f"{folder}/good.sql", catalog], ["showSchema", catalog], ["parseSchema", f"{folder}/bad.sql"], ["isSorted", f"{folder}/none"])
        rows = [(i, x[0], main(x)) for i, x in enumerate(lines)]
    return spark.createDataFrame(rows, "place int, command string, code int")
