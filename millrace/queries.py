"""The catalogue of the engine's queries over the relational test tables, each with the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.table import empty, merge_sorted, union_distinct
from millrace.plans.parser import parse
from millrace.session import Engine
from millrace.sources.catalog import Catalog
from millrace.sources.textio import format_records, parse_records

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

#: Name: (dialect text, output names, SQL). Output names rename the engine's columns, such as AVG(x), in order.
DIALECT: dict[str, tuple[str, list[str], str]] = {
    "q01_star": ("SELECT * FROM nation", ["n_nationkey", "n_name", "n_regionkey"], "SELECT * FROM nation"),
    "q02_range": (
        "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200",
        ["o_orderkey", "o_custkey"],
        "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200",
    ),
    "q03_or": (
        'SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_custkey = 4 OR (c_nationkey > 8 AND c_mktsegment < "F")',
        ["c_custkey", "c_nationkey", "c_mktsegment"],
        "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_custkey = 4 OR (c_nationkey > 8 AND c_mktsegment < 'F')",
    ),
    "q04_not": ("SELECT c_custkey FROM customer WHERE NOT (c_nationkey < 20)", ["c_custkey"], "SELECT c_custkey FROM customer WHERE NOT (c_nationkey < 20)"),
    "q05_arithmetic": ("SELECT p_partkey, p_size FROM part WHERE p_size + 3 < 8 AND p_partkey % 2 = 1", ["p_partkey", "p_size"], "SELECT p_partkey, p_size FROM part WHERE p_size + 3 < 8 AND p_partkey % 2 = 1"),
    "q06_integer_division": ("SELECT p_partkey FROM part WHERE p_size / 2 = 3", ["p_partkey"], "SELECT p_partkey FROM part WHERE p_size // 2 = 3"),
    "q07_constant_false": ("SELECT n_name FROM nation WHERE 1 + 3 = 7", ["n_name"], "SELECT n_name FROM nation WHERE 1 + 3 = 7"),
    "q08_contradiction": ("SELECT p_partkey FROM part WHERE p_size > 5 AND p_size < 3", ["p_partkey"], "SELECT p_partkey FROM part WHERE p_size > 5 AND p_size < 3"),
    "q09_point": ("SELECT c_name, c_acctbal FROM customer WHERE c_custkey = 42", ["c_name", "c_acctbal"], "SELECT c_name, c_acctbal FROM customer WHERE c_custkey = 42"),
    "q10_strings": (
        'SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = "F" AND o_orderpriority != "1-URGENT"',
        ["o_orderkey", "o_orderstatus"],
        "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority != '1-URGENT'",
    ),
    "q11_unary_minus": ("SELECT p_partkey, p_size FROM part WHERE -p_size < -40", ["p_partkey", "p_size"], "SELECT p_partkey, p_size FROM part WHERE -p_size < -40"),
    "q12_double_arithmetic": (
        "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 30000.0",
        ["l_orderkey", "l_linenumber", "l_extendedprice"],
        "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 30000.0",
    ),
    "q13_double_bounds": (
        "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 20000.5 AND o_totalprice <= 90000.25",
        ["o_orderkey", "o_totalprice"],
        "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 20000.5 AND o_totalprice <= 90000.25",
    ),
    "q14_star_order": (
        "SELECT n_name, *, nation.n_regionkey FROM nation",
        ["n_name", "n_nationkey", "n_regionkey"],
        "SELECT n_name, n_nationkey, n_regionkey FROM nation",
    ),
    "q15_const_true": ("SELECT r_name FROM region WHERE true", ["r_name"], "SELECT r_name FROM region"),
    "q16_fraction_bound": ("SELECT p_partkey, p_size FROM part WHERE p_size > -1.5 AND p_size < 3.5 AND p_size != 2.5", ["p_partkey", "p_size"], "SELECT p_partkey, p_size FROM part WHERE p_size > -1.5 AND p_size < 3.5"),
    "q17_merged_equality": ("SELECT p_partkey FROM part WHERE p_size >= 7 AND 7 >= p_size AND p_partkey < 500", ["p_partkey"], "SELECT p_partkey FROM part WHERE p_size = 7 AND p_partkey < 500"),
    "q18_timestamp_passthrough": ("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey < 50", ["o_orderkey", "o_orderdate"], "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey < 50"),
    "q88_merged_equality_whole": ("SELECT p_partkey FROM part WHERE p_size >= 7 AND 7 >= p_size", ["p_partkey"], "SELECT p_partkey FROM part WHERE p_size = 7"),
    "q89_timestamp_whole": ("SELECT o_orderkey, o_orderdate FROM orders", ["o_orderkey", "o_orderdate"], "SELECT o_orderkey, o_orderdate FROM orders"),
    "q23_min_max_string": (
        "SELECT c_nationkey, MIN(c_mktsegment), MAX(c_name) FROM customer GROUP BY c_nationkey",
        ["c_nationkey", "min_segment", "max_name"],
        "SELECT c_nationkey, MIN(c_mktsegment) AS min_segment, MAX(c_name) AS max_name FROM customer GROUP BY c_nationkey",
    ),
    "q21_integer_average": (
        "SELECT p_brand, AVG(p_size) FROM part GROUP BY p_brand",
        ["p_brand", "avg_size"],
        "SELECT p_brand, CAST(sum(p_size) // count(p_size) AS BIGINT) AS avg_size FROM part GROUP BY p_brand",
    ),
    "q22_global_sum": ("SELECT SUM(p_size) FROM part", ["sum_size"], "SELECT CAST(sum(p_size) AS BIGINT) AS sum_size FROM part"),
    "q24_count_star": ("SELECT l_linestatus, COUNT(*) FROM lineitem GROUP BY l_linestatus", ["l_linestatus", "n"], "SELECT l_linestatus, count(*) AS n FROM lineitem GROUP BY l_linestatus"),
    "q25_implicit_group": ("SELECT o_orderstatus, COUNT(o_orderkey) FROM orders", ["o_orderstatus", "n"], "SELECT o_orderstatus, count(o_orderkey) AS n FROM orders GROUP BY o_orderstatus"),
    "q26_two_keys": (
        "SELECT l_returnflag, l_linestatus, COUNT(l_orderkey), MIN(l_quantity), MAX(l_quantity) FROM lineitem GROUP BY l_linestatus, l_returnflag",
        ["l_returnflag", "l_linestatus", "n", "min_quantity", "max_quantity"],
        "SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_quantity) AS min_quantity, max(l_quantity) AS max_quantity FROM lineitem GROUP BY 1, 2",
    ),
    "q27_empty_aggregate": ("SELECT COUNT(n_nationkey), SUM(n_nationkey) FROM nation WHERE n_nationkey < 0", ["n", "s"], "SELECT count(n_nationkey) AS n, CAST(sum(n_nationkey) AS BIGINT) AS s FROM nation WHERE n_nationkey < 0"),
    "q28_order_by": (
        "SELECT s_nationkey, s_suppkey FROM supplier ORDER BY s_nationkey, s_suppkey",
        ["s_nationkey", "s_suppkey"],
        "SELECT s_nationkey, s_suppkey FROM supplier ORDER BY 1, 2",
    ),
    "q30_count_column": ("SELECT p_brand, COUNT(p_name) FROM part GROUP BY p_brand", ["p_brand", "n"], "SELECT p_brand, count(p_name) AS n FROM part GROUP BY p_brand"),
    "q32_group_without_aggregate": ("SELECT n_regionkey FROM nation GROUP BY n_regionkey", ["n_regionkey"], "SELECT DISTINCT n_regionkey FROM nation"),
    "q40_join": (
        "SELECT nation.n_name, region.r_name FROM nation, region WHERE nation.n_regionkey = region.r_regionkey",
        ["n_name", "r_name"],
        "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey",
    ),
    "q41_join_filters": (
        'SELECT orders.o_orderkey, customer.c_custkey FROM orders, customer WHERE orders.o_custkey = customer.c_custkey AND customer.c_mktsegment = "BUILDING" AND (orders.o_totalprice > 100000.0 OR orders.o_orderstatus = "F")',
        ["o_orderkey", "c_custkey"],
        "SELECT o_orderkey, c_custkey FROM orders, customer WHERE o_custkey = c_custkey AND c_mktsegment = 'BUILDING' AND (o_totalprice > 100000.0 OR o_orderstatus = 'F')",
    ),
    "q42_theta_join": (
        "SELECT nation.n_nationkey, region.r_regionkey FROM nation, region WHERE nation.n_regionkey < region.r_regionkey",
        ["n_nationkey", "r_regionkey"],
        "SELECT n_nationkey, r_regionkey FROM nation, region WHERE n_regionkey < r_regionkey",
    ),
    "q43_cross_join": ("SELECT nation.n_nationkey, region.r_regionkey FROM nation, region", ["n_nationkey", "r_regionkey"], "SELECT n_nationkey, r_regionkey FROM nation, region"),
    "q44_join_aggregate": (
        "SELECT customer.c_mktsegment, COUNT(orders.o_orderkey) FROM customer, orders WHERE customer.c_custkey = orders.o_custkey GROUP BY customer.c_mktsegment",
        ["c_mktsegment", "n"],
        "SELECT c_mktsegment, count(o_orderkey) AS n FROM customer, orders WHERE c_custkey = o_custkey GROUP BY c_mktsegment",
    ),
    "q45_two_equalities": (
        "SELECT customer.c_custkey, supplier.s_suppkey FROM customer, supplier WHERE customer.c_nationkey = supplier.s_nationkey AND customer.c_custkey = supplier.s_suppkey",
        ["c_custkey", "s_suppkey"],
        "SELECT c_custkey, s_suppkey FROM customer, supplier WHERE c_nationkey = s_nationkey AND c_custkey = s_suppkey",
    ),
    "q46_three_way": (
        "SELECT supplier.s_name, nation.n_name, region.r_name FROM supplier, region, nation WHERE supplier.s_nationkey = nation.n_nationkey AND nation.n_regionkey = region.r_regionkey",
        ["s_name", "n_name", "r_name"],
        "SELECT s_name, n_name, r_name FROM supplier, nation, region WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey",
    ),
    "q47_residual_or": (
        "SELECT nation.n_nationkey, region.r_regionkey FROM nation, region WHERE nation.n_regionkey = region.r_regionkey OR nation.n_nationkey = region.r_regionkey",
        ["n_nationkey", "r_regionkey"],
        "SELECT n_nationkey, r_regionkey FROM nation, region WHERE n_regionkey = r_regionkey OR n_nationkey = r_regionkey",
    ),
}

#: As DIALECT, with doubles rounded on both sides: sums of doubles depend on their order.
ROUNDED: dict[str, tuple[str, list[str], str]] = {
    "q00_flagship": (
        "SELECT l_returnflag, COUNT(l_orderkey), AVG(l_quantity) FROM lineitem WHERE l_quantity < 24 GROUP BY l_returnflag ORDER BY l_returnflag",
        ["l_returnflag", "n", "avg_quantity"],
        "SELECT l_returnflag, count(l_orderkey) AS n, round(avg(l_quantity), 4) AS avg_quantity FROM lineitem WHERE l_quantity < 24 GROUP BY l_returnflag",
    ),
    "q20_all_aggregates": (
        "SELECT l_returnflag, COUNT(l_quantity), SUM(l_quantity), AVG(l_extendedprice), MAX(l_discount), MIN(l_tax) FROM lineitem GROUP BY l_returnflag",
        ["l_returnflag", "n", "sum_quantity", "avg_price", "max_discount", "min_tax"],
        "SELECT l_returnflag, count(l_quantity) AS n, round(sum(l_quantity), 4) AS sum_quantity, round(avg(l_extendedprice), 4) AS avg_price, round(max(l_discount), 4) AS max_discount, round(min(l_tax), 4) AS min_tax FROM lineitem GROUP BY l_returnflag",
    ),
    "q29_order_by_aggregate": (
        "SELECT p_size, AVG(p_retailprice) FROM part GROUP BY p_size ORDER BY AVG(p_retailprice), p_size",
        ["p_size", "avg_price"],
        "SELECT p_size, round(avg(p_retailprice), 4) AS avg_price FROM part GROUP BY p_size",
    ),
}


def engine(spark: SparkSession, sf_dir: str, *tables: str) -> Engine:
    """An engine over the given tables, or all."""
    own = Engine(spark)
    for name in tables or TABLES:
        own.read(name, f"{sf_dir}/{name}.parquet")
    return own


def _dialect(text: str, names: list[str], rounded: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = engine(spark, sf_dir, *parse(text).tables).sql(text).toDF(*names)  # type: ignore[union-attr]
        return found.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes]) if rounded else found

    return run


def q31_aggregate_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Engine(spark)
    own.register("sizes", spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size"))
    return own.sql("SELECT MAX(sizes.*) FROM sizes").toDF("max_partkey", "max_size")


def q50_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = engine(spark, sf_dir, "customer")
    columns = "SELECT c_custkey, c_nationkey FROM customer WHERE "
    return union_distinct(own.sql(columns + "c_nationkey > 20"), own.sql(columns + "c_custkey < 100"), "c_custkey")


def q51_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = engine(spark, sf_dir, "supplier").table("supplier")
    left, _ = suppliers.delete(suppliers.search(right={"s_suppkey": 7}).select("s_suppkey"))
    return left.rows.select("s_suppkey", "s_name")


def q52_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = engine(spark, sf_dir, "region")
    added = spark.createDataFrame([(5, "ATLANTIS")], "r_regionkey int, r_name string")
    own.put(own.table("region").insert(added))
    return own.sql("SELECT r_name, COUNT(r_regionkey) FROM region").toDF("r_name", "n")


def q53_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine(spark, sf_dir, "orders").table("orders").search(left={"o_totalprice": 1000.0}, right={"o_totalprice": 20000.0}, left_open=True)
    return found.select("o_orderkey", "o_totalprice")


def q54_key_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, "customer").table("customer").keys()


def q55_composite_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine(spark, sf_dir, "supplier").table("supplier").search(left={"s_nationkey": 5, "s_suppkey": 30}, right={"s_nationkey": 9, "s_suppkey": 60}, right_open=True)
    return found.select("s_nationkey", "s_suppkey")


def _ranked(rows: DataFrame) -> DataFrame:
    """The rows of a result with their place in it, to hold the order against SQL's: one task numbers them, as only a check of order needs."""
    return rows.coalesce(1).withColumn("place", F.monotonically_increasing_id())


def q33_boolean_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Engine(spark)
    own.register("stock", spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_size") > 25).alias("large")))
    return own.sql("SELECT p_partkey FROM stock WHERE large AND NOT (p_partkey < 10)")


def q34_aggregate_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine(spark, sf_dir, "lineitem").sql("SELECT MIN(l_linestatus), MIN(l_returnflag), MAX(l_linenumber), COUNT(*) FROM lineitem")
    return found.toDF("first_status", "first_flag", "most_lines", "n")


def q35_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Engine(spark)
    sizes = F.when(F.col("p_size") != 7, F.col("p_size"))
    own.register("sizes", spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", sizes.alias("size")))
    return own.sql("SELECT p_partkey FROM sizes WHERE size != 3.5 AND NOT (size < 2 AND size > 3)")


def q36_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(engine(spark, sf_dir, "customer").sql("SELECT c_nationkey, c_custkey FROM customer ORDER BY c_nationkey, c_custkey"))


def q37_ordered_by_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine(spark, sf_dir, "orders").sql("SELECT o_custkey, COUNT(o_orderkey) FROM orders GROUP BY o_custkey ORDER BY COUNT(o_orderkey), o_custkey")
    return _ranked(found.toDF("o_custkey", "n"))


def q56_merge_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = engine(spark, sf_dir, "nation", "region")
    nations = own.sql("SELECT n_regionkey FROM nation").toDF("k")
    return _ranked(merge_sorted(nations, own.sql("SELECT r_regionkey FROM region").toDF("k"), "k"))


def q57_delete_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = engine(spark, sf_dir, "supplier").table("supplier")
    return suppliers.delete(suppliers.search(right={"s_suppkey": 7}).select("s_suppkey"))[1]


def q58_text_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as text records and read again, with bars, quotes and line feeds in the texts."""
    own = engine(spark, sf_dir, "part")
    awkward = own.sql("SELECT p_partkey, p_name FROM part").withColumn("p_name", F.concat(F.lit('|"'), F.col("p_name"), F.lit("\n\\p|")))
    table = own.register("awkward", awkward).definition
    return parse_records(format_records(awkward, table), table, strict=True)


def q59_empty_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table emptied, then given rows again by another load."""
    regions = engine(spark, sf_dir, "region").table("region")
    return empty(regions.definition, regions.rows).load(regions.rows).insert(regions.rows).rows


def q60_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query through a catalog that was turned to JSON's types and back."""
    first = engine(spark, sf_dir, "nation")
    own = Engine(spark, Catalog.from_dict(first.catalog.to_dict()))
    own.read("nation", f"{sf_dir}/nation.parquet")
    return own.sql("SELECT n_regionkey, COUNT(n_nationkey) FROM nation GROUP BY n_regionkey").toDF("n_regionkey", "n")


def q61_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Engine(spark)
    texts = ["7 / 2 + 1", "-7 % 4", "2.5 * 4", "3 < 3.5 AND NOT false"]
    return spark.range(1).select(*[F.lit(own.evaluate_const(t)).alias(f"x{i}") for i, t in enumerate(texts)])


def q62_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the text grid of a small result."""
    grid = engine(spark, sf_dir, "region").show("SELECT r_regionkey, r_name FROM region WHERE r_regionkey < 2 ORDER BY r_regionkey")
    return spark.range(1).select(F.posexplode(F.split(F.lit(grid.strip()), "\n")).alias("place", "line"))


API: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "q31_aggregate_star": (q31_aggregate_star, "SELECT max(p_partkey) AS max_partkey, max(p_size) AS max_size FROM part"),
    "q33_boolean_column": (q33_boolean_column, "SELECT p_partkey FROM part WHERE p_size > 25 AND NOT (p_partkey < 10)"),
    "q34_aggregate_types": (q34_aggregate_types, "SELECT min(l_linestatus) AS first_status, min(l_returnflag) AS first_flag, max(l_linenumber) AS most_lines, count(*) AS n FROM lineitem"),
    "q35_nulls": (q35_nulls, "SELECT p_partkey FROM (SELECT p_partkey, CASE WHEN p_size <> 7 THEN p_size END AS size FROM part) WHERE size <> 3.5 AND NOT (size < 2 AND size > 3)"),
    "q36_ordered": (q36_ordered, "SELECT c_nationkey, c_custkey, row_number() OVER (ORDER BY c_nationkey, c_custkey) - 1 AS place FROM customer"),
    "q37_ordered_by_aggregate": (q37_ordered_by_aggregate, "SELECT o_custkey, n, row_number() OVER (ORDER BY n, o_custkey) - 1 AS place FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)"),
    "q56_merge_sorted": (q56_merge_sorted, "SELECT k, row_number() OVER (ORDER BY k) - 1 AS place FROM (SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region)"),
    "q57_delete_count": (q57_delete_count, "SELECT count(*) AS n FROM supplier WHERE s_suppkey <= 7"),
    "q58_text_records": (q58_text_records, "SELECT p_partkey, '|\"' || p_name || chr(10) || '\\p|' AS p_name FROM part"),
    "q59_empty_load": (q59_empty_load, "SELECT * FROM region UNION ALL SELECT * FROM region"),
    "q60_catalog": (q60_catalog, "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey"),
    "q61_constants": (q61_constants, "SELECT 4 AS x0, -3 AS x1, 10.0::DOUBLE AS x2, true AS x3"),
    "q62_grid": (
        q62_grid,
        "WITH r AS (SELECT r_regionkey, r_name, max(length(r_name)) OVER () AS w FROM region WHERE r_regionkey < 2), b AS (SELECT '+' || repeat('-', 13) || '+' || repeat('-', 2 + greatest(6, max(w))) || '+' AS rule, 2 + greatest(6, max(w)) AS w FROM r) "
        "SELECT 0 AS place, rule AS line FROM b UNION ALL SELECT 1, '| r_regionkey |' || rpad(' r_name', w::INT, ' ') || '|' FROM b UNION ALL SELECT 2, rule FROM b "
        "UNION ALL SELECT 3 + r_regionkey, '|' || rpad(' ' || r_regionkey, 13, ' ') || '|' || rpad(' ' || r_name, b.w::INT, ' ') || '|' FROM r, b UNION ALL SELECT 5, rule FROM b UNION ALL SELECT 6, '2 rows in set' FROM b",
    ),
    "q50_union_distinct": (q50_union_distinct, "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey > 20 UNION SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey < 100"),
    "q51_delete": (q51_delete, "SELECT s_suppkey, s_name FROM supplier WHERE NOT s_suppkey <= 7"),
    "q52_insert": (q52_insert, "SELECT r_name, count(*) AS n FROM (SELECT r_name FROM region UNION ALL SELECT 'ATLANTIS') GROUP BY r_name"),
    "q53_search": (q53_search, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000.0 AND o_totalprice <= 20000.0"),
    "q54_key_scan": (q54_key_scan, "SELECT c_custkey FROM customer ORDER BY 1"),
    "q55_composite_search": (q55_composite_search, "SELECT s_nationkey, s_suppkey FROM supplier WHERE (s_nationkey > 5 OR s_nationkey = 5 AND s_suppkey >= 30) AND (s_nationkey < 9 OR s_nationkey = 9 AND s_suppkey < 60)"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{n: _dialect(text, names, True) for n, (text, names, _) in ROUNDED.items()},
    **{n: _dialect(text, names, False) for n, (text, names, _) in DIALECT.items()},
    **{n: run for n, (run, _) in API.items()},
}
ORACLE_SQL: dict[str, str] = {**{n: sql for n, (_, _, sql) in (ROUNDED | DIALECT).items()}, **{n: sql for n, (_, sql) in API.items()}}
