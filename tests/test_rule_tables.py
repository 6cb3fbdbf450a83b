"""Operators over tables of rule sets against those for one rule set, on drawn rule sets; findings of small rule sets by hand."""

import json
import random
from collections import Counter

import pytest

from cohortlens.model import FactDecl, FactModel, RuleSet, to_plain
from cohortlens.operators import diff, lint, prove, rule_tables
from cohortlens.sources.documents import parse_ruleset

MODEL = FactModel("m", {"age": FactDecl("number", "years"), "bmi": FactDecl("number"), "sex": FactDecl("enum", values=("f", "m")), "ok": FactDecl("boolean"), "meds": FactDecl("code", systems=("rx",))})
SCHEMA = "ruleset string, version string, fact_model string, ord long, id string, ref string, kind string, verbatim string, `when` string, needed string, nodes int, __v int"


def rules(*criteria, model="m", version="1.0.0", name="r"):
    head = f"ruleset: {name}\nrulesetVersion: {version}\nfactModel: {model}\ncriteria:\n"
    return parse_ruleset(head + "".join(f"  - {{id: c{i}, kind: {c.split('|')[0]}, verbatim: t, {c.split('|')[1]}}}\n" for i, c in enumerate(criteria)))


def table(spark, sets: list[RuleSet]):
    rows = []
    for n, s in enumerate(sets):
        for i, c in enumerate(s.criteria):
            plain = to_plain(c.when)
            text = None if plain is None else json.dumps(plain, sort_keys=(n + i) % 2 == 0, indent=None if i % 2 else 1)
            rows.append((s.ruleset, s.version, s.fact_model, i, c.id, c.ref, c.kind, c.verbatim, text, "x", 1, 2))
    return spark.createDataFrame(rows, SCHEMA)


def models(spark, model=MODEL):
    return spark.createDataFrame([(model.name, k, d.type, d.unit, list(d.values), list(d.systems)) for k, d in model.facts.items()], "fact_model string, fact string, type string, unit string, values array<string>, systems array<string>")


def drawn(rnd, depth=0):
    leafs = [
        {"fact": "bmi", "op": rnd.choice(["eq", "neq", "gt", "gte", "lt", "lte"]), "value": rnd.choice([1, 2, 3, 2.5])},
        {"fact": "age", "op": rnd.choice(["gt", "lte", "neq"]), "value": rnd.randint(1, 3), **rnd.choice([{}, {"unit": "years"}, {"unit": "months"}])},
        {"fact": "meds", "op": rnd.choice(["in", "notIn"]), "codes": {"system": rnd.choice(["rx", "rx", "zz"]), "values": rnd.sample(["a", "b", "c"], rnd.randint(1, 2))}},
        {"fact": rnd.choice(["sex", "bmi", "nope"]), "op": "eq", "value": rnd.choice(["f", "x", True])},
        {"fact": rnd.choice(["ok", "meds", "age"]), "op": "exists"},
        {"fact": "meds", "op": "anyWithin", "codes": {"system": "rx", "values": ["a"]}, "windowDays": rnd.randint(0, 3)},
    ]
    if depth < 3 and rnd.random() < 0.45:
        kind = rnd.choice(["all", "all", "any", "not"])
        return {"not": drawn(rnd, depth + 1)} if kind == "not" else {kind: [drawn(rnd, depth + 1) for _ in range(rnd.randint(1, 3))]}
    return rnd.choice(leafs[:3] if rnd.random() < 0.75 else leafs)


def drawn_set(rnd, name, version="1.0.0", criteria=None):
    criteria = criteria or [(f"c{i}", rnd.choice([None, "R1", f"R{i}"]), rnd.choice(["inclusion", "inclusion", "exclusion"]), f"t{rnd.randint(0, 2)}", drawn(rnd) if rnd.random() < 0.9 else None) for i in range(rnd.randint(1, 6))]
    doc = {"ruleset": name, "rulesetVersion": version, "factModel": "m", "criteria": [{"id": i, "kind": k, "verbatim": v, **({"ref": r} if r else {}), **({"when": w} if w else {"unmodeled": True})} for i, r, k, v, w in criteria]}
    return parse_ruleset(json.dumps(doc)), criteria


def edited(rnd, criteria):
    out = []
    for i, r, k, v, w in criteria:
        x = rnd.random()
        if x < 0.1:
            continue
        if x < 0.3:
            i = i + "x"
        if w and rnd.random() < 0.3:
            w = json.loads(json.dumps(w).replace("2", "3"))
        out.append((i, r, k, v, w))
    if rnd.random() < 0.4:
        out.append(("n" + str(rnd.randint(0, 99)), None, "inclusion", "new", drawn(rnd)))
    if rnd.random() < 0.4:
        rnd.shuffle(out)
    return out or criteria


@pytest.fixture(scope="module")
def sets():
    rnd = random.Random(8)
    return [drawn_set(rnd, f"r{i}")[0] for i in range(150)]


def test_lint_against_one_by_one(spark, sets):
    got = Counter((r.ruleset, r.level, r.code, r.criterion) for r in rule_tables.lint_rules(table(spark, sets), models(spark)).collect())
    want = Counter((s.ruleset, f.level, f.code, f.criteria[0] if f.criteria else None) for s in sets for f in lint.lint(s, MODEL))
    assert got == want


def test_contradictions_against_one_by_one(spark, sets):
    got = {(r.ruleset, r.level, r.code) for r in rule_tables.contradictions(table(spark, sets)).collect()}
    assert got == {(s.ruleset, f.level, f.code) for s in sets for f in prove.conflicts(s)}
    own = Counter((r.ruleset, r.code, r.criteria) for r in rule_tables.contradictions(table(spark, sets)).where("code IN ('analysis-incomplete')").collect())
    assert own == Counter((s.ruleset, f.code, f.criteria[0]) for s in sets for f in prove.conflicts(s) if f.code == "analysis-incomplete")


def test_structural_changes_against_one_by_one(spark):
    rnd, every, want = random.Random(3), [], Counter()
    for n in range(60):
        first, criteria = drawn_set(rnd, f"r{n}", "1.9.0")
        every.append(first)
        for version in ("1.10.0", "2.0.0"):
            criteria = edited(rnd, criteria)
            nxt, _ = drawn_set(rnd, f"r{n}", version, criteria)
            want.update((nxt.ruleset, every[-1].version, version, *row) for row in diff.structural_diff(every[-1], nxt).rows())
            every.append(nxt)
    got = rule_tables.structural_changes(table(spark, every))
    assert Counter((r.ruleset, r.from_version, r.version, r.change, r.id, r.from_id) for r in got.collect()) == want


def test_nodes_and_empty_tables(spark):
    deep = {"fact": "bmi", "op": "gt", "value": 1}
    for _ in range(12):
        deep = {"not": {"all": [deep]}}
    s, _ = drawn_set(random.Random(1), "r", "1.0.0", [("a", None, "inclusion", 'say "{[" twice', deep), ("b", None, "exclusion", "t", None)])
    rows = rule_tables.node_rows(table(spark, [s])).collect()
    assert len(rows) == 25 and max(len(r.path.split(".")) for r in rows) == 25 and [r.node for r in rows if r.parent is None] == ["not"]
    assert [r.needed for r in rows if r.path == "0.0"] == [False]
    none = table(spark, [s]).limit(0)
    for f in (lambda c: rule_tables.lint_rules(c, models(spark)), rule_tables.contradictions, rule_tables.structural_changes, rule_tables.admitted_intervals):
        assert f(none).count() == 0
    assert {r.code for r in rule_tables.lint_rules(table(spark, [s]), models(spark).limit(0)).collect()} == {"fact-model-mismatch", "unmodeled-criterion"}


LINTED = (
    ("unmodeled: true", "info", "unmodeled-criterion"), ("when: {fact: nope, op: gt, value: 1}", "error", "unknown-fact"), ("when: {fact: sex, op: gt, value: 1}", "error", "type-mismatch"),
    ("when: {fact: bmi, op: eq, value: x}", "error", "type-mismatch"), ("when: {fact: sex, op: eq, value: x}", "error", "unknown-enum-value"), ("when: {fact: sex, op: eq, value: true}", "error", "type-mismatch"),
    ("when: {fact: bmi, op: in, codes: {system: rx, values: [a]}}", "error", "type-mismatch"), ("when: {fact: meds, op: in, codes: {system: zz, values: [a]}}", "error", "unknown-code-system"),
    ("when: {fact: bmi, op: gt, value: 1, unit: kg}", "error", "unit-unexpected"), ("when: {fact: age, op: gt, value: 1}", "error", "unit-undeclared"), ("when: {fact: age, op: gt, value: 1, unit: months}", "error", "unit-mismatch"),
    ("when: {fact: ok, op: exists}", "error", "exists-value-type"), ("when: {all: [{fact: age, op: gt, value: 1, unit: years}, {not: {any: [{fact: nope, op: exists}]}}]}", "error", "unknown-fact"),
    ("when: {fact: age, op: lte, value: 9, unit: years}", None, None),
)


def test_lint_by_hand(spark):
    s = rules(*(f"inclusion|{c}" for c, _, _ in LINTED))
    want = [(level, code, f"c{i}") for i, (_, level, code) in enumerate(LINTED) if code]
    assert sorted((r.level, r.code, r.criterion) for r in rule_tables.lint_rules(table(spark, [s]), models(spark)).collect()) == sorted(want)
    other = rules(*(f"inclusion|{c}" for c, _, _ in LINTED), model="other")
    found = prove.by_severity(lint.lint(other, MODEL) + lint.modeling_warnings(other, ("c1",)))
    assert [f.level for f in found] == ["error"] * 13 + ["warning"] * 2 + ["info"]
    assert sorted((f.level, f.code, ",".join(f.criteria)) for f in found if f.level != "warning") == sorted([*want, ("error", "fact-model-mismatch", "")])


def bmi(op, v):
    return f"{{fact: bmi, op: {op}, value: {v}}}"


def meds(op, *codes):
    return f"{{fact: meds, op: {op}, codes: {{system: rx, values: [{', '.join(codes)}]}}}}"


CONFLICTS = (
    ("interval", (f"inclusion|when: {{all: [{bmi('gt', 5)}, {bmi('lt', 5)}]}}",), "unsatisfiable-criterion"),
    ("point", (f"inclusion|when: {{all: [{bmi('eq', 5)}, {bmi('neq', 5)}]}}",), "unsatisfiable-criterion"),
    ("codes-in-one", (f"inclusion|when: {{all: [{meds('in', 'a')}, {meds('notIn', 'a', 'b')}]}}",), "unsatisfiable-criterion"),
    ("two-inclusions", (f"inclusion|when: {bmi('gt', 5)}", f"inclusion|when: {bmi('lte', 5)}"), "contradictory-inclusions"),
    ("three-inclusions", (f"inclusion|when: {bmi('gte', 5)}", f"inclusion|when: {bmi('lte', 5)}", f"inclusion|when: {bmi('neq', 5)}"), "contradictory-inclusions"),
    ("codes-of-two", (f"inclusion|when: {meds('in', 'a')}", f"inclusion|when: {meds('notIn', 'a', 'b')}"), "contradictory-inclusions"),
    ("exclusion-covers", (f"inclusion|when: {bmi('gte', 30)}", f"exclusion|when: {bmi('gte', 20)}"), "unsatisfiable-ruleset"),
    ("excluded-codes", (f"inclusion|when: {meds('in', 'a')}", f"exclusion|when: {meds('in', 'a', 'b')}"), "unsatisfiable-ruleset"),
    ("meets-at-an-end", (f"inclusion|when: {bmi('gte', 5)}", f"exclusion|when: {bmi('lt', 5)}"), None),
    ("codes-of-another", (f"inclusion|when: {meds('in', 'a', 'c')}", f"exclusion|when: {meds('in', 'a', 'b')}"), None),
)


def test_conflicts_by_hand(spark):
    sets = [rules(*c, name=name) for name, c, _ in CONFLICTS]
    want = {(name, code) for name, _, code in CONFLICTS if code}
    assert {(s.ruleset, f.code) for s in sets for f in prove.conflicts(s) if f.level == "error"} == want
    assert {(r.ruleset, r.code) for r in rule_tables.contradictions(table(spark, sets)).where("level = 'error'").collect()} == want


ENDS = (("gt", 1.0), ("gte", 1.0), ("lt", 4.0), ("lte", 4.0), ("eq", 1.0))
SHOWN = {"gt": "(1, ", "gte": "[1, ", "lt": ", 4)", "lte": ", 4]"}


def test_interval_algebra(spark):
    of, want = prove.Interval.of, {}
    for a, x in ENDS:
        for b, y in ENDS:
            met = of(a, x) & of(b, y)
            if (a, b) in {("gt", "lt"), ("gt", "lte"), ("gte", "lt"), ("gte", "lte")}:
                assert str(met) == SHOWN[a] + SHOWN[b].removeprefix(", ")
            want[f"{a}-{b}"] = "empty" if met.empty else str(met)
    sets = [rules(f"inclusion|when: {bmi(a, x)}", f"inclusion|when: {bmi(b, y)}", name=f"{a}-{b}") for a, x in ENDS for b, y in ENDS]
    assert {r.ruleset: r.interval for r in rule_tables.admitted_intervals(table(spark, sets)).collect()} == want
    assert (of("gt", 1.0) & of("eq", 1.0)).empty and (of("gte", 1.0) & of("eq", 1.0)).point == 1.0 and (of("lt", 4.0) & of("eq", 1.0)).point == 1.0
