"""Lexer, parser, analyzer and normaliser; no Spark."""

from __future__ import annotations

import itertools

import pytest
from hypothesis import given
from hypothesis import strategies as st
from puppies import HOST, PUPPY, catalog

from millrace import AnalysisError, Catalog, Engine, FieldDef, ParseError, SchemaError, TableDef
from millrace.functions.scalar import evaluate
from millrace.functions.types import FieldType, ValueType, aggregates, result_type
from millrace.plans.analyzer import Analyzer, analyze
from millrace.plans.ast import ColumnRef
from millrace.plans.normalize import FALSE, TRUE, normalize
from millrace.plans.parser import parse
from millrace.session import show

TABLES = catalog().tables
ENGINE = Engine(None, catalog())


def where(condition: str) -> str:
    _, found, _ = ENGINE.analyze(f"SELECT * FROM Puppy WHERE {condition}")
    return show(found)


def fails(query: str) -> str:
    with pytest.raises(AnalysisError) as e:
        ENGINE.analyze(query)
    return e.value.code


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("1 != 1.0", False), ("1 + 2 * -3", -5), ("(-1.5 + 3 )* 2", 3.0), ("1 + 2 * -3 - 4/0.5 <= 8.0", True), ("7 / 2", 3), ("-7 / 2", -3), ("-7 % 3", -1), ("7 % -3", 1),
        ("0 + 5", 5), ("007", 7), ("- - 3", 3), ("-(1 + 2)", -3), ("'a' + 1", "b"), ("'c' - 'a' = 2", True), ("'a' < 98", True), ("NOT NOT NOT false", True), ("True = FALSE", False),
        ("1 < 2 AND NOT 2 < 1 OR false", True), ('"a" < "b"', True), ("1 = 1 ; rubbish (", True),
    ],
)
def test_constants(text, value):
    found = ENGINE.evaluate_const(text)
    assert found == value and type(found) is type(value)


@pytest.mark.parametrize("text", ["SELECT", "SELECT * FROM", "SELECT a FROM t WHERE", "1 +", "(1", "1 ? 2", "SELECT a.b.c FROM t", "'ab'", '"a', "SELECT * FROM t GROUP BY *", "SELECT SUM(*) FROM t ORDER BY *", "9223372036854775808", "1 2"])
def test_not_of_the_dialect(text):
    with pytest.raises(ParseError):
        parse(text)


def test_keywords_in_any_case_and_spacing():
    a = parse("select max(age) from Puppy group   by age order\nby age")
    assert a == parse("SELECT MAX(age) FROM Puppy GROUP BY age ORDER BY age;")


def test_typing_matrix():
    i, d, b, c, s = ValueType.INT64, ValueType.DOUBLE, ValueType.BOOL, ValueType.CHAR, ValueType.STRING
    good = {}
    for op in "+-":
        good |= {(op, i, i): i, (op, i, d): d, (op, d, d): d, (op, i, c): c, (op, c, c): c}
    for op in "*/":
        good |= {(op, i, i): i, (op, i, d): d, (op, d, d): d}
    good["%", i, i] = i
    for op in ("=", "!=", "<", ">", "<=", ">="):
        good |= {(op, *p): b for p in ((i, i), (i, d), (d, d), (i, c), (c, c), (s, s))}
    good |= {(op, b, b): b for op in ("=", "!=", "AND", "OR")}
    for op in ("+", "-", "*", "/", "%", "=", "!=", "<", ">", "<=", ">=", "AND", "OR"):
        for x, y in itertools.product(ValueType, repeat=2):
            assert result_type(op, x, y) == good.get((op, x, y), good.get((op, y, x))), (op, x, y)


def test_aggregates_by_type():
    assert [f for f in FieldType if aggregates("SUM", f)] == [FieldType.INT, FieldType.LONGINT, FieldType.DOUBLE]
    assert not aggregates("MAX", FieldType.BOOL) and aggregates("MIN", FieldType.STRING) and aggregates("COUNT", FieldType.BOOL)


@pytest.mark.parametrize(
    ("query", "code"),
    [
        ("SELECT xx FROM Puppy", "INVALID_COLUMN"),
        ("SELECT * FROM Cat", "INVALID_TABLE"),
        ("SELECT * FROM Puppy, Puppy", "DUPLICATE_TABLE"),
        ("SELECT * FROM Puppy, Host", "NO_DEFAULT_TABLE"),
        ('SELECT Puppy.age FROM Puppy, Host WHERE name = "hy"', "AMBIGUOUS_COLUMN"),
        ("SELECT age FROM Puppy, Host", "AMBIGUOUS_COLUMN"),
        ("SELECT age FROM Puppy WHERE Host.id = 1", "TABLE_NOT_SELECTED"),
        ("SELECT Host.id FROM Puppy", "TABLE_NOT_SELECTED"),
        ("SELECT age FROM Puppy WHERE signature + 3 = 6", "INVALID_OPERATION"),
        ("SELECT age FROM Puppy WHERE adult AND 1", "INVALID_OPERATION"),
        ("SELECT age FROM Puppy WHERE 1 + adult = 2", "INVALID_OPERATION"),
        ("SELECT age FROM Puppy WHERE 1 < 2 < 3", "INVALID_OPERATION"),
        ("SELECT age FROM Puppy WHERE adult < true", "INVALID_OPERATION"),
        ('SELECT age FROM Puppy WHERE name = 5', "INVALID_OPERATION"),
        ("SELECT age FROM Puppy WHERE age + 1", "WHERE_NOT_BOOL"),
        ("SELECT SUM(name) FROM Puppy", "INVALID_AGGREGATE"),
        ("SELECT MAX(adult) FROM Puppy", "INVALID_AGGREGATE"),
        ("SELECT SUM(Puppy.*) FROM Puppy", "INVALID_AGGREGATE"),
        ("SELECT age, COUNT(id) FROM Puppy GROUP BY name", "GROUP_BY_NOT_SELECTED"),
        ("SELECT age, name, COUNT(id) FROM Puppy GROUP BY name", "GROUP_BY_MISMATCH"),
        ("SELECT age FROM Puppy ORDER BY name", "ORDER_BY_NOT_SELECTED"),
        ("SELECT age FROM Puppy ORDER BY AVG(age)", "ORDER_BY_NOT_SELECTED"),
        ("1 = 1", "NOT_A_QUERY"),
    ],
)
def test_analysis_errors(query, code):
    assert fails(query) == code


def outputs(query: str) -> list[str]:
    found = analyze(parse(query), TABLES)
    return [o.name(len(found.tables) > 1) for o in found.outputs]


def test_stars_and_duplicates():
    names = [f.name for f in PUPPY.fields]
    assert outputs("SELECT * FROM Puppy") == names
    assert outputs("SELECT *, age FROM Puppy") == [n for n in names if n != "age"] + ["age"]
    assert outputs("SELECT age, *, age FROM Puppy") == ["age"] + [n for n in names if n != "age"]
    assert outputs("SELECT Puppy.name, Puppy.*, Host.name, Puppy.age FROM Puppy, Host") == ["Puppy.name", *[f"Puppy.{n}" for n in names if n not in ("name", "age")], "Host.name", "Puppy.age"]
    assert outputs("SELECT COUNT(*), COUNT(age), AVG(age) FROM Puppy") == ["COUNT(*)", "COUNT(age)", "AVG(age)"]
    assert outputs("SELECT COUNT(Host.*) FROM Host") == [f"COUNT({f.name})" for f in HOST.fields]


@pytest.mark.parametrize(
    ("given_", "found"),
    [
        ("2.5 <= age AND age < 3.5", "(Puppy.age = 3)"),
        ("age < 3 AND 2.5 <= age AND age < 3.5", "FALSE"),
        ("age <= 3 AND 2.5 <= age AND age < 3.5", "(Puppy.age = 3)"),
        ("id != 3.5", "TRUE"),
        ("id = 3.5", "FALSE"),
        ("NOT (id < 200 AND id > 300)", "TRUE"),
        ("age > 20 OR id = 0.5", "FALSE"),
        ("age > 4 OR id != 0.5", "TRUE"),
        ("age < 4 AND 3 <= age AND age >= 4", "FALSE"),
        ("weight > 0.7 AND age = 20 AND True", "FALSE"),
        ("weight < 0.6 AND 1 + 3 = 7", "FALSE"),
        ("adult AND false", "FALSE"),
        ("id > 5 AND id < 3", "FALSE"),
        ("3 > id AND id > 5", "FALSE"),
        ("id > 3 AND id < 5", "(Puppy.id = 4)"),
        ("id > 3 AND id < 4", "FALSE"),
        ("weight > 3 AND weight < 4", "((Puppy.weight > 3) AND (Puppy.weight < 4))"),
        ("id > -1.5", "(Puppy.id >= -1)"),
        ("id = 3 AND id != 3", "FALSE"),
        ("id = 3 AND id = 3.0", "(Puppy.id = 3)"),
        ('name = "a" AND name = "b"', "FALSE"),
        ('name >= "a" AND name <= "a"', '(Puppy.name = "a")'),
        # The domain of age (0 to 9) is enforced, so such a bound goes; its siblings stay.
        ("age < 300 AND id + 3 < 8", "((Puppy.id + 3) < 8)"),
        ("id < 300 AND age + 3 < 8", "((Puppy.id <= 299) AND ((Puppy.age + 3) < 8))"),
        ("-id > 3 AND id > 0", "((Puppy.id >= 1) AND ((-Puppy.id) > 3))"),
        ("id > 9223372036854775807", "FALSE"),
        ("adult", "Puppy.adult"),
    ],
)
def test_normalised(given_, found):
    assert where(given_) == found


def columns(query="SELECT * FROM Puppy"):
    own = Analyzer(TABLES, ("Puppy",))
    return own, lambda c: own.resolve(c)[1]


NUMBERS = st.one_of(st.integers(-3, 12).map(str), st.sampled_from(["-1.5", "0.5", "2.5", "3.0", "9.5"]))
ATOMS = st.one_of(
    st.builds(lambda c, o, v, flip: f"{v} {o} {c}" if flip else f"{c} {o} {v}", st.sampled_from(["age", "id", "weight", "host_id"]), st.sampled_from(["=", "!=", "<", ">", "<=", ">="]), NUMBERS, st.booleans()),
    st.builds(lambda o, v: f'name {o} "{v}"', st.sampled_from(["=", "!=", "<", ">="]), st.sampled_from(["", "a", "mm"])),
    st.sampled_from(["adult", "true", "age + 1 > id", "id % 2 = 0", "-age < -4", "grade = 'b'"]),
)
CONDITIONS = st.recursive(ATOMS, lambda inner: st.one_of(st.builds(lambda a, o, b: f"({a}) {o} ({b})", inner, st.sampled_from(["AND", "OR"]), inner), inner.map(lambda a: f"NOT ({a})")), max_leaves=8)


@given(CONDITIONS, st.integers(0, 9), st.integers(-2, 13), st.sampled_from([-1.5, 0.5, 1.0, 2.5, 3.0, 9.5]), st.integers(-2, 12), st.sampled_from(["", "a", "b", "mm", "z"]), st.booleans(), st.sampled_from("abc"))
def test_normalised_holds_for_the_same_rows(text, age, id_, weight, host_id, name, adult, grade):
    own, lookup = columns()
    e = own.qualified(parse(text))
    row = {ColumnRef("Puppy", n): v for n, v in {"age": age, "id": id_, "weight": weight, "host_id": host_id, "name": name, "adult": adult, "grade": grade}.items()}
    assert evaluate(normalize(e, lookup), row) == evaluate(e, row)


def test_constants_fold_to_the_two_literals():
    own, lookup = columns()
    assert normalize(parse("1 + 3 = 7"), lookup) == FALSE and normalize(parse("NOT 1 > 2"), lookup) == TRUE


def test_catalog_round_trip_and_checks(tmp_path):
    own = catalog()
    own.save(str(tmp_path / "c.json"))
    assert Catalog.load(str(tmp_path / "c.json")) == own
    assert PUPPY.key == ("id",) and TableDef("t", (FieldDef("x", FieldType.INT), FieldDef("y", FieldType.INT))).key == ("x",)
    assert PUPPY.has_index("id") and PUPPY.has_index("age") and not PUPPY.has_index("weight")
    for bad in (
        lambda: own.add(PUPPY),
        lambda: TableDef("t", (FieldDef("x", FieldType.INT), FieldDef("x", FieldType.INT))),
        lambda: TableDef("t", ()),
        lambda: FieldDef("x", FieldType.CHARARRAY),
        lambda: FieldDef("x", FieldType.INT, enforced=True),
        lambda: FieldDef("x", FieldType.INT, min=3, max=1),
    ):
        with pytest.raises(SchemaError):
            bad()
