"""Queries and the table API on Spark, against brute force in Python."""

from __future__ import annotations

import itertools
import os

import pytest
from hypothesis import HealthCheck, given, settings
from puppies import HOST, PUPPY, catalog, rows
from pyspark.sql import functions as F
from test_dialect import CONDITIONS

from millrace import AnalysisError, Engine, SchemaError
from millrace.functions.scalar import evaluate
from millrace.functions.types import FieldType
from millrace.operators.table import empty, merge_sorted, union_distinct
from millrace.plans.analyzer import Analyzer
from millrace.plans.ast import ColumnRef
from millrace.plans.parser import parse
from millrace.sources.catalog import FieldDef, TableDef
from millrace.sources.render import grid
from millrace.sources.textio import format_records, parse_records
from millrace.streaming.continuous import start

PUPPIES, HOSTS = rows()
NAMES = [f.name for f in PUPPY.fields]


@pytest.fixture(scope="module")
def engine(spark):
    own = Engine(spark, catalog())
    own.register("Puppy", spark.createDataFrame(PUPPIES, PUPPY.schema()).coalesce(1).cache(), check=True)
    own.register("Host", spark.createDataFrame(HOSTS, HOST.schema()).coalesce(1).cache())
    return own


def row_of(puppy: tuple = (), host: tuple = ()) -> dict:
    return {ColumnRef("Puppy", n): v for n, v in zip(NAMES, puppy, strict=False)} | {ColumnRef("Host", n): v for n, v in zip(("id", "name"), host, strict=False)}


def brute(engine, condition: str, tables=("Puppy",)) -> list:
    own = Analyzer(engine.catalog.tables, tables)
    e = own.qualified(parse(condition))
    if tables == ("Puppy",):
        return sorted(p for p in PUPPIES if evaluate(e, row_of(p)))
    return sorted((p, h) for p, h in itertools.product(PUPPIES, HOSTS) if evaluate(e, row_of(p, h)))


@pytest.mark.parametrize(
    "condition",
    [
        "id < 300", "id > -1 AND id < 10", "id < 300 AND age < 1", "id > 700 OR weight > 1.7", "true", "adult AND NOT (age < 3)", "NOT adult AND age > 7", 'id <100 OR(age > 8 OR name = "snoopy")',
        "id >500 OR weight < 1.0", "age + 3 < 8", "NOT NOT NOT false", "-weight < -1.0", "-age + 5 > 2", "-(age - 3) >= 1", "grade + 1 = 'c'", "grade > 97", "age / 2 = 2", "age % 3 = 1", "adult = false",
        "age * weight > 4", "signature >= \"m\"", "-id % 4 = -3",
    ],
)
def test_conditions_against_brute_force(engine, condition):
    found = engine.sql(f"SELECT * FROM Puppy WHERE {condition}").collect()
    assert sorted(map(tuple, found)) == brute(engine, condition)


@given(CONDITIONS)
@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_random_conditions(engine, condition):
    assert sorted(map(tuple, engine.sql(f"SELECT * FROM Puppy WHERE {condition}").collect())) == brute(engine, condition)


@pytest.mark.parametrize(
    "condition",
    [
        "Puppy.host_id = Host.id",
        'Puppy.host_id = Host.id AND Host.name = "hy" AND Puppy.age < 5',
        "Puppy.host_id = Host.id AND (Puppy.age > 5 OR Host.id = 1)",
        "Puppy.host_id < Host.id AND NOT Puppy.adult",
        "Puppy.age > 5 OR Host.id = 1",
        "Puppy.adult",
        "1 = 1",
        "1 = 2",
        "Puppy.host_id = Host.id AND Puppy.id + Host.id > 10 AND Puppy.age % 2 = Host.id",
    ],
)
def test_joins_against_brute_force(engine, condition):
    found = engine.sql(f"SELECT Puppy.*, Host.* FROM Puppy, Host WHERE {condition}")
    assert found.columns == [f"Puppy.{n}" for n in NAMES] + ["Host.id", "Host.name"]
    assert sorted((tuple(r)[: len(NAMES)], tuple(r)[len(NAMES) :]) for r in found.collect()) == brute(engine, condition, ("Puppy", "Host"))


def test_aggregates_by_hand(engine):
    found = engine.sql("SELECT age, AVG(weight), COUNT(*), SUM(id), AVG(id), MIN(name), MAX(grade) FROM Puppy").collect()
    groups: dict = {}
    for p in PUPPIES:
        groups.setdefault(p[1], []).append(p)
    assert len(found) == len(groups)
    for r in found:
        own = groups[r[0]]
        ids = [p[2] for p in own]
        assert r[1] == pytest.approx(sum(p[3] for p in own) / len(own))
        assert tuple(r)[2:] == (len(own), sum(ids), sum(ids) // len(ids), min(p[0] for p in own), max(p[7] for p in own))


def test_integer_average_truncates_towards_zero(spark):
    own = Engine(spark)
    own.register("t", spark.createDataFrame([(-3,), (-4,)], "x int"))
    assert own.sql("SELECT AVG(x), SUM(x) FROM t").collect() == [(-3, -7)]
    own.register("big", spark.createDataFrame([(2**31 - 1,), (2**31 - 1,)], "x int"))
    assert own.sql("SELECT SUM(x) FROM big").first()[0] == 2**32 - 2


def test_groups_without_aggregates_and_empty_input(engine):
    assert engine.sql("SELECT age FROM Puppy GROUP BY age").count() == len({p[1] for p in PUPPIES})
    assert [tuple(r) for r in engine.sql("SELECT COUNT(id), SUM(id) FROM Puppy WHERE id < 0").collect()] == [(0, None)]
    assert engine.sql("SELECT age, COUNT(id) FROM Puppy WHERE id < 0").collect() == []


def test_order(engine):
    found = [tuple(r) for r in engine.sql("SELECT age, id FROM Puppy ORDER BY age, id").collect()]
    assert found == sorted((p[1], p[2]) for p in PUPPIES)
    means = [r[1] for r in engine.sql("SELECT age, AVG(weight) FROM Puppy ORDER BY AVG(weight)").collect()]
    assert means == sorted(means)
    three = [tuple(r) for r in engine.sql("SELECT grade, adult, id FROM Puppy ORDER BY grade, adult, id").collect()]
    assert three == sorted((p[7], p[4], p[2]) for p in PUPPIES)


def test_join_with_aggregate(engine):
    found = dict(map(tuple, engine.sql("SELECT Host.name, COUNT(Puppy.id) FROM Puppy, Host WHERE Puppy.host_id = Host.id").collect()))
    assert found == {name: sum(p[6] == i for p in PUPPIES) for i, name in HOSTS}


def test_duplicates_survive_or(spark):
    own = Engine(spark)
    own.register("t", spark.createDataFrame([(1, 1), (1, 1), (1, 2)], "k int, v int"))
    assert own.sql("SELECT * FROM t WHERE k = 1 OR v = 2").count() == 3


def test_plans(engine, spark, tmp_path):
    engine.sql("SELECT * FROM Puppy").write.parquet(str(tmp_path / "p"))
    own = Engine(spark)
    own.read("p", str(tmp_path / "p"))
    assert "FileScan" not in own.sql("SELECT * FROM p WHERE id > 5 AND id < 3")._jdf.queryExecution().executedPlan().toString()
    text = own.explain("SELECT name FROM p WHERE id > 5 AND id > 7 AND id <= 9")
    assert text.startswith("WHERE ((p.id >= 8) AND (p.id <= 9))")
    assert "GreaterThanOrEqual(id,8)" in text and "ReadSchema: struct<name:string,id:bigint>" in text


def test_show(engine):
    assert engine.show("SELECT id, name FROM Host WHERE id = 1") == "+----+------+\n| id | name |\n+----+------+\n| 1  | hy   |\n+----+------+\n1 rows in set\n"
    assert grid(["a"], []) == "Empty set\n"
    assert grid(["x", "y"], [(1.5, True)]) == "+-----+------+\n| x   | y    |\n+-----+------+\n| 1.5 | True |\n+-----+------+\n1 rows in set\n"


def test_search_and_scan(engine):
    puppies = engine.table("Puppy")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(puppies.search(key={"age": 3})) == sorted(p[2] for p in PUPPIES if p[1] == 3)
    assert ids(puppies.search(left={"id": 4}, right={"id": 9}, left_open=True)) == [5, 6, 7, 8, 9]
    assert ids(puppies.search(left={"id": 9}, right={"id": 4})) == []
    assert ids(puppies.search(left={"age": 3, "id": 10}, right={"age": 6, "id": 2}, right_open=True)) == sorted(p[2] for p in PUPPIES if (3, 10) <= (p[1], p[2]) < (6, 2))
    assert ids(puppies.search()) == ids(puppies.scan()) == list(range(20))
    assert [r.id for r in puppies.keys().collect()] == list(range(20))
    with pytest.raises(SchemaError):
        puppies.search(key={"xx": 1})


def test_load_insert_delete(engine, spark, tmp_path):
    hosts = engine.table("Host")
    more = hosts.insert(spark.createDataFrame([(2, "dup"), (3, "new")], HOST.schema()))
    assert more.rows.count() == 5
    left, gone = more.delete(spark.createDataFrame([(2,), (9,), (2,)], "id long"))
    assert gone.first().n == 2 and sorted(r.id for r in left.rows.collect()) == [0, 1, 3]
    assert left.load(spark.createDataFrame([], HOST.schema())).rows.count() == 0
    assert empty(HOST, hosts.rows).rows.columns == ["id", "name"]
    left.save(str(tmp_path / "hosts"), 2)
    assert spark.read.parquet(str(tmp_path / "hosts")).count() == 3


@pytest.mark.parametrize(
    ("column", "bad"), [("age", "10"), ("signature", "'abcd'"), ("grade", "'xy'"), ("name", "cast(null as string)")]
)  # an enforced domain, a long text, a long character, a null
def test_breaking_rows(engine, spark, column, bad):
    wrong = spark.createDataFrame(PUPPIES[:1], PUPPY.schema()).withColumn(column, F.expr(bad).cast(PUPPY.schema()[column].dataType))
    with pytest.raises(Exception, match="breaks its declaration"):
        engine.table("Puppy").load(wrong).rows.collect()


def test_wrong_shape(engine, spark):
    with pytest.raises(SchemaError):
        engine.table("Host").load(spark.createDataFrame([("a", "b")], "id string, name string"))
    with pytest.raises(SchemaError):
        engine.table("Host").load(spark.createDataFrame([(1,)], "id long"))
    with pytest.raises(AnalysisError):
        engine.table("Cat")


def test_unions(spark):
    a, b = spark.createDataFrame([(1, "a"), (3, "c")], "k int, v string"), spark.createDataFrame([(1, "z"), (2, "b")], "k int, v string")
    assert sorted(r.k for r in union_distinct(a, b, "k").collect()) == [1, 2, 3]
    assert [r.k for r in merge_sorted(a, b, "k").collect()] == [1, 1, 2, 3]


def test_text_records(spark):
    line = 'Record: | String: "nb" | Int: 19 | LongInt: 46 | Double: 1.682927 | Bool: 0 | CharArray: "qpe" | Int64: 2 | Char: "c" | '
    lines = spark.createDataFrame([(line,), ("i = 71, record size = 44",), ("",), (None,)], "value string")
    found = parse_records(lines, PUPPY).collect()
    assert [tuple(r) for r in found] == [("nb", 19, 46, 1.682927, False, "qpe", 2, "c")]
    own = spark.createDataFrame(PUPPIES, PUPPY.schema())
    assert sorted(map(tuple, parse_records(format_records(own, PUPPY), PUPPY).collect())) == sorted(PUPPIES)
    with pytest.raises(Exception, match="Not a record"):
        parse_records(lines, PUPPY, strict=True).collect()


AWKWARD = ["a|b", "x\ny", '"quoted"', "back\\slash", "\\n", "\\\\p|", "\r", "", " padded ", '|"\\"|', "é \0"]


def test_awkward_texts_in_records(spark):
    table = TableDef("T", (FieldDef("a", FieldType.STRING), FieldDef("n", FieldType.INT), FieldDef("b", FieldType.STRING)))
    rows = [(a, i, b) for i, (a, b) in enumerate(itertools.product(AWKWARD, AWKWARD))]
    own = spark.createDataFrame(rows, "a string, n int, b string")
    for strict in (False, True):
        assert sorted(map(tuple, parse_records(format_records(own, table), table, strict=strict).collect())) == sorted(rows)
    # A bar between quotes belongs to the text, also where another writer left it.
    lines = spark.createDataFrame([('Record: | String: "a|b" | Int: 1 | String: "c" | ',)], "value string")
    assert [tuple(r) for r in parse_records(lines, table, strict=True).collect()] == [("a|b", 1, "c")]


@pytest.mark.parametrize("text", ["id != 3.5", "NOT (id < 2 AND id > 3)", "NOT (id = 3.5)", "NOT (id < 2 AND id > 3 OR name = 'b')".replace("'", '"'), "id != 2"])
def test_nulls_are_never_true(spark, text):
    rows = spark.createDataFrame([(1, "a"), (None, "a"), (2, "b"), (4, None)], "id int, name string")
    own = Engine(spark)
    own.register("t", rows)
    expected = sorted(r.id for r in rows.where(text).collect())
    assert None not in expected
    assert sorted(r.id for r in own.sql(f"SELECT id FROM t WHERE {text}").collect()) == expected
    with pytest.raises(Exception, match="breaks its declaration"):
        checked = Engine(spark)
        checked.register("t", rows, check=True)
        checked.sql(f"SELECT id FROM t WHERE {text}").collect()


def test_stream(spark, tmp_path):
    spark.createDataFrame(PUPPIES, PUPPY.schema()).write.parquet(str(tmp_path / "in"))
    own = Engine(spark)
    own.register("p", spark.readStream.schema(PUPPY.schema()).parquet(str(tmp_path / "in")))
    query = start(own, "SELECT grade, COUNT(id) FROM p WHERE id < 10", "grades", str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    found = dict(map(tuple, spark.table("grades").collect()))
    assert found == {g: n for g in "abc" if (n := sum(p[7] == g and p[2] < 10 for p in PUPPIES))}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the test tables aren't there")
def test_catalogue_against_sql(spark):
    import duckdb

    from millrace.queries import ORACLE_SQL, QUERIES, TABLES

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    same = lambda rows: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
    for name, query in QUERIES.items():
        df = query(spark, sf)
        result = db.execute(ORACLE_SQL[name])
        names = [d[0] for d in result.description]
        assert sorted(df.columns) == sorted(names), name
        assert same(map(tuple, df.select(names).collect())) == same(result.fetchall()), name
