"""Three-valued semantics of every leaf and combinator, on one small typed cohort."""

import pytest

from cohortlens.functions.conditions import Facts, condition_column, prose, tri
from cohortlens.model import All, AnyOf, Codes, FactDecl, FactModel, Leaf, Not
from pyspark.sql import functions as F

MODEL = FactModel("m", {"n": FactDecl("number"), "e": FactDecl("enum", values=("a", "b")), "b": FactDecl("boolean"), "c": FactDecl("code", systems=("s",))})
SCHEMA = "patient string, n double, e string, b boolean, c array<struct<code:string,system:string,daysAgo:int>>"


@pytest.fixture(scope="module")
def cohort(spark):
    rows = [
        ("full", 5.0, "a", True, [("x", "s", 10), ("y", "s", None)]),
        ("empty", 0.0, "b", False, []),
        ("absent", None, None, None, None),
        ("odd", float("nan"), "z", None, [("x", "other", 1), ("x", "s", None)]),
    ]
    return spark.createDataFrame(rows, SCHEMA).cache()


def results(cohort, cond):
    col = tri(condition_column(cond, Facts(cohort.columns, MODEL)))
    return {r.patient: r.t for r in cohort.select("patient", col.alias("t")).collect()}


def within(days, code="x"):
    return Leaf("c", "anyWithin", codes=Codes("s", (code,)), window_days=days)


def test_numbers_are_unknown_when_absent_or_not_finite(cohort):
    assert results(cohort, Leaf("n", "gte", 5)) == {"full": "true", "empty": "false", "absent": "unknown", "odd": "unknown"}
    assert results(cohort, Leaf("n", "neq", 5)) == {"full": "false", "empty": "true", "absent": "unknown", "odd": "unknown"}


def test_exists_is_never_false(cohort):
    assert set(results(cohort, Leaf("c", "exists")).values()) == {"true", "unknown"}


def test_empty_list_is_known(cohort):
    in_, not_in = (results(cohort, Leaf("c", op, codes=Codes("s", ("x",)))) for op in ("in", "notIn"))
    assert (in_["empty"], not_in["empty"], in_["absent"], not_in["absent"]) == ("false", "true", "unknown", "unknown")


def test_window_is_inclusive_and_undated_matches_are_unknown(cohort):
    assert results(cohort, within(10))["full"] == "true"
    assert results(cohort, within(9))["full"] == "false"
    assert results(cohort, within(9, "y"))["full"] == "unknown"
    assert results(cohort, within(500))["odd"] == "unknown"
    assert results(cohort, within(0))["empty"] == "false"


def test_wrong_type_is_unknown(cohort):
    assert set(results(cohort, Leaf("n", "eq", "5")).values()) == {"unknown"}
    assert set(results(cohort, Leaf("undeclared", "gt", 1)).values()) == {"unknown"}


def test_kleene(cohort):
    u, t, f = Leaf("undeclared", "gt", 1), Leaf("n", "gt", 1), Leaf("n", "gt", 9)
    get = lambda c: results(cohort, c)["full"]
    assert [get(All((u, t))), get(All((u, f))), get(AnyOf((u, t))), get(AnyOf((u, f))), get(Not(u))] == ["unknown", "false", "true", "unknown", "unknown"]
    assert get(Not(All((u, f)))) == get(AnyOf((Not(u), Not(f))))


def test_prose(cohort):
    c = All((Leaf("n", "gte", 1, unit="kg"), Not(Leaf("e", "eq", "b"))))
    got = {r.patient: r.p for r in cohort.select("patient", prose(c, Facts(cohort.columns, MODEL)).alias("p")).collect()}
    assert got["full"] == "n = 5.0, required ≥ 1 kg and not (e = a, required = b)"
    assert got["absent"] == "n missing → unknown and not (e missing → unknown)"


def test_bool_and_is_not_kleene(spark):
    assert spark.range(1).select(F.expr("true and null").alias("x")).first().x is None
