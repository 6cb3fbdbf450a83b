import pytest

from cohortlens.model import FactDecl, FactModel, RuleSet
from cohortlens.operators.lint import check, check_text, lint
from cohortlens.operators.prove import Interval, analyse, conflicts, possible_results
from cohortlens.sources import documents as D

HEAD = "ruleset: r\nrulesetVersion: 1.0.0\nfactModel: m\ncriteria:\n"
MODEL = FactModel("m", {"age": FactDecl("number", "years"), "bmi": FactDecl("number"), "sex": FactDecl("enum", values=("f", "m")), "ok": FactDecl("boolean"), "meds": FactDecl("code", systems=("rx",))})


def rs(*criteria: str) -> RuleSet:
    return D.parse_ruleset(HEAD + "".join(f"  - {{id: c{i}, kind: {c.split('|')[0]}, verbatim: t, when: {c.split('|')[1]}}}\n" for i, c in enumerate(criteria)))


def codes(findings):
    return {(f.level, f.code) for f in findings}


def test_all_problems_are_listed():
    with pytest.raises(D.DocumentError) as e:
        D.parse_ruleset("ruleset: r\nrulesetVersion: '1.0'\nfactModel: m\nextra: 1\ncriteria:\n  - {id: overall, kind: maybe, verbatim: ''}\n")
    text = str(e.value)
    for part in ("rulesetVersion", "extra: unknown key", "criteria.0.id", "criteria.0.kind", "criteria.0.verbatim", "either when"):
        assert part in text


def test_limits():
    with pytest.raises(D.DocumentError, match="nested deeper"):
        D.load("[" * 70 + "]" * 70)
    with pytest.raises(D.DocumentError, match="longer"):
        D.load("x" * 1_000_001)


def test_dates_and_suites():
    assert D.is_day("2024-02-29") and not D.is_day("2026-02-30") and not D.is_day("2026-2-3")
    with pytest.raises(D.DocumentError, match="overall"):
        D.parse_suite("cases: [{name: a, facts: {}, expect: {c1: pass}}]")
    assert D.parse_suite("cases: [{name: a, facts: {n: 1}, expect: {overall: eligible}}]")[0]["name"] == "a"
    with pytest.raises(D.DocumentError):
        D.parse_patient("patient: p\nfacts: {a: null}")


def test_facts_file_rules():
    with pytest.raises(D.DocumentError) as e:
        D.parse_facts_file("patient: p\nfacts:\n  - {fact: a, value: 1, status: proposed, extractedBy: pipeline}\n  - {fact: a, value: 1, status: confirmed, extractedBy: llm/x, confidence: 2}\n")
    for part in ("pipeline row", "confidence", "reviewedBy", "more than one live row", "source, quote"):
        assert part in str(e.value)


def test_note():
    n = D.parse_note("---\ndoc: a\npatient: p\nkind: echo\nsynthetic: true\n---\nBody.\n", "x/a.txt")
    assert n["body"] == "Body.\n" and n["trap"] is None
    with pytest.raises(D.DocumentError, match="stem"):
        D.parse_note("---\ndoc: b\npatient: p\nkind: echo\nsynthetic: true\n---\nBody.\n", "a.txt")


@pytest.mark.parametrize(
    ("cond", "code"),
    [
        ("{fact: nope, op: gt, value: 1}", "unknown-fact"),
        ("{fact: sex, op: gt, value: 1}", "type-mismatch"),
        ("{fact: sex, op: eq, value: x}", "unknown-enum-value"),
        ("{fact: age, op: gt, value: 1}", "unit-undeclared"),
        ("{fact: age, op: gt, value: 1, unit: months}", "unit-mismatch"),
        ("{fact: bmi, op: gt, value: 1, unit: kg}", "unit-unexpected"),
        ("{fact: ok, op: exists}", "exists-value-type"),
        ("{fact: meds, op: in, codes: {system: zz, values: [a]}}", "unknown-code-system"),
    ],
)
def test_lint_codes(cond, code):
    assert ("error", code) in codes(lint(rs(f"inclusion|{cond}"), MODEL))


def test_unparseable_is_a_finding():
    assert ("error", "schema") in codes(check_text("a: [", "name: m\nfacts: {}"))
    assert ("error", "fact-model-schema") in codes(check_text(HEAD + "  - {id: a, kind: inclusion, verbatim: t, unmodeled: true}", "name: m\nfacts: {a: {type: what}}"))


def test_intervals():
    a, b = Interval.of("gte", 30), Interval.of("lt", 45)
    assert str(a & b) == "[30, 45)" and (a & Interval.of("lt", 30)).empty and a.contains(Interval.of("gt", 30)) and not Interval.of("gt", 30).contains(a)
    assert Interval.of("eq", 3).point == 3 and Interval().full


def test_contradictions():
    n = lambda op, v: f"{{fact: bmi, op: {op}, value: {v}}}"
    assert ("error", "unsatisfiable-criterion") in codes(conflicts(rs(f"inclusion|{{all: [{n('gt', 5)}, {n('lt', 5)}]}}")))
    assert ("error", "unsatisfiable-criterion") in codes(conflicts(rs(f"inclusion|{{all: [{n('eq', 5)}, {n('neq', 5)}]}}")))
    assert ("error", "contradictory-inclusions") in codes(conflicts(rs(f"inclusion|{n('gt', 5)}", f"inclusion|{n('lte', 5)}")))
    assert ("error", "contradictory-inclusions") in codes(conflicts(rs(f"inclusion|{n('gte', 5)}", f"inclusion|{n('lte', 5)}", f"inclusion|{n('neq', 5)}")))
    assert ("error", "unsatisfiable-ruleset") in codes(conflicts(rs(f"inclusion|{n('gte', 30)}", f"exclusion|{n('gte', 20)}")))
    assert not [f for f in conflicts(rs(f"inclusion|{n('gte', 5)}", f"exclusion|{n('lt', 5)}")) if f.level == "error"]
    two = "{all: [{fact: bmi, op: gte, value: 20}, {fact: age, op: gt, value: 3}]}"
    assert not [f for f in conflicts(rs(f"inclusion|{n('gte', 30)}", f"exclusion|{two}")) if f.level == "error"]
    c = lambda op, *v: f"{{fact: meds, op: {op}, codes: {{system: rx, values: [{', '.join(v)}]}}}}"
    assert ("error", "unsatisfiable-ruleset") in codes(conflicts(rs(f"inclusion|{c('in', 'a')}", f"exclusion|{c('in', 'a', 'b')}")))
    assert ("error", "contradictory-inclusions") in codes(conflicts(rs(f"inclusion|{c('in', 'a')}", f"inclusion|{c('notIn', 'a', 'b')}")))
    assert ("info", "analysis-incomplete") in codes(conflicts(rs(f"inclusion|{{any: [{n('gt', 1)}, {n('lt', 9)}]}}")))
    assert not analyse(rs(f"inclusion|{{not: {n('gt', 1)}}}").criteria[0].when).complete


def test_possible_results():
    c = rs("inclusion|{all: [{fact: bmi, op: exists}, {fact: meds, op: exists}]}").criteria[0].when
    assert possible_results(c) == {True, None}
    assert not [f for f in check(rs("inclusion|{fact: bmi, op: gte, value: 1}"), MODEL) if f.level == "error"]
