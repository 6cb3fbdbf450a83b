"""Comparison, sensitivity, ingestion, grounding, review and streaming on small cohorts."""

import json

import pytest
from pyspark.sql import functions as F

from cohortlens import streaming
from cohortlens.api import Engine
from cohortlens.functions import facts as FN
from cohortlens.model import FactDecl, FactModel, replace_at
from cohortlens.operators import cohort, diff, evaluate, ground, ingest, report, review, sensitivity
from cohortlens.plans.cohort_tables import MODEL, V1, V2, facts_wide
from cohortlens.sources import documents as D
from cohortlens.sources import tables

MODEL_TEXT = """
name: m
facts:
  age: {type: number, unit: years}
  lvef: {type: number, unit: "%"}
  sex: {type: enum, values: [f, m]}
  meds: {type: code, systems: [rx]}
"""
RULES = """
ruleset: demo
rulesetVersion: {v}
factModel: m
criteria:
  - {{id: age-min, ref: I1, kind: inclusion, verbatim: adult, when: {{fact: age, op: gte, value: {age}, unit: years}}}}
  - {{id: washout, ref: E1, kind: exclusion, verbatim: recent anticoagulant, when: {{fact: meds, op: anyWithin, codes: {{system: rx, values: [ac]}}, windowDays: 30}}}}
  - {{id: note, kind: exclusion, verbatim: judgement, unmodeled: true}}
"""
A, B = RULES.format(v="1.0.0", age=18), RULES.format(v="1.1.0", age=65)


@pytest.fixture(scope="module")
def wide(spark, sf_dir):
    return facts_wide(spark, sf_dir).cache()


def test_attrition_adds_up(wide):
    ev = evaluate.evaluate(wide, V1, MODEL)
    bands = {r.band: r.n for r in cohort.band_counts(ev).collect()}
    rows = cohort.attrition(ev, V1).collect()
    assert sum(bands.values()) == wide.count() and sum(r.removed_sequential for r in rows) == bands["screen-fail"]
    assert [r.sole_reason for r in rows if r.id == "balance-min"] == [0]  # something is always unknown
    assert "| balance-min |" in report.markdown_report(ev, V1, "2001-08-02")


def test_empty_cohort_is_zero_filled(wide):
    ev = evaluate.evaluate(wide.limit(0), V1, MODEL)
    assert {r.n for r in cohort.overall_counts(ev).collect()} == {0} and cohort.attrition(ev, V1).count() == len(V1.criteria)


def test_wide_rule_sets_compile_in_groups(wide):
    many = type(V1)("r", "1.0.0", V1.fact_model, tuple(type(c)(f"{c.id}-{i}", c.kind, c.verbatim, c.when, c.ref) for i in range(40) for c in V1.criteria))
    ev = evaluate.evaluate(wide, many, MODEL)
    assert ev.select(F.size("results").alias("n"), F.element_at("results", 240)["ord"].alias("o")).first() == (240, 239)


def test_yields_equal_reevaluation(wide):
    base = evaluate.evaluate(wide, V1, MODEL).where("overall = 'ineligible'").count()
    got = {r.knob: r.delta for r in sensitivity.yields(wide, V1, MODEL).collect()}
    for k in sensitivity.knobs(V1):
        crits = list(V1.criteria)
        c = crits[k.ord]
        crits[k.ord] = type(c)(c.id, c.kind, c.verbatim, replace_at(c.when, k.path, k.relaxed), c.ref)
        moved = evaluate.evaluate(wide, type(V1)(V1.ruleset, V1.version, V1.fact_model, tuple(crits)), MODEL)
        assert base - moved.where("overall = 'ineligible'").count() == got[k.name]


def test_relaxed_values():
    assert [sensitivity.relaxed("inclusion", "gte", "value", 40), sensitivity.relaxed("exclusion", "gt", "value", 40), sensitivity.relaxed("exclusion", "lt", "value", 40), sensitivity.relaxed("exclusion", "anyWithin", "windowDays", 1)] == [35, 45, 35, 1]
    assert [sensitivity.nice_width(0, 100), sensitivity.nice_width(5, 5)] == [10, 1]


def test_structural_diff_of_many_criteria_is_linear():
    import time

    big = lambda tag: D.parse_ruleset("ruleset: r\nrulesetVersion: 1.0.0\nfactModel: m\ncriteria:\n" + "".join(f"  - {{id: {tag}-{i}, kind: inclusion, verbatim: {tag} {i}, when: {{fact: x, op: gt, value: {i}}}}}\n" for i in range(1000)))
    a, b = big("a"), big("b")
    t = time.time()
    s = diff.structural_diff(a, b)
    assert time.time() - t < 1 and len(s.added) == len(s.removed) == 1000


def test_version_gate():
    s = diff.structural_diff(V1, V2)
    assert s.renamed == (("urgent-window", "urgent-recent"),) and s.removed == ("segment-open",) and s.added == ("returns-max",)
    assert diff.version_findings(V1, V2, s) == []
    assert ("error", "invalid-version-bump") in diff.version_findings(V2, V1, s)
    assert diff.scalar_changes(V1.criteria[3], V2.criteria[2]) == "windowDays 90 → 60"


def test_one_projection_no_join(wide):
    plan = diff.both_versions(wide, V1, V2, MODEL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("InMemoryRelation")[0]


def test_variant_facts_are_not_coerced(spark):
    m = FactModel("m", {"n": FactDecl("number"), "b": FactDecl("boolean"), "c": FactDecl("code", systems=("s",))})
    docs = ['{"n": "38", "b": 1, "c": []}', '{"n": 38, "b": true, "c": [{"code": "x", "system": "s"}]}', '{"n": 1.5}']
    df = spark.createDataFrame([(str(i), d) for i, d in enumerate(docs)], "patient string, j string").select("patient", F.parse_json("j").alias("facts"))
    rows = tables.facts_wide(df, m).orderBy("patient").collect()
    assert [(r.n, r.b, None if r.c is None else len(r.c)) for r in rows] == [(None, None, 0), (38.0, True, 1), (1.5, None, None)]
    assert rows[1].c[0].daysAgo is None


def test_rounding_and_years(spark):
    r = spark.sql("select 1.005d as x, date'2000-02-29' as b, date'2001-02-28' as d").select(FN.round_half_up(F.col("x")).alias("r"), FN.completed_years(F.col("b"), F.col("d")).alias("y")).first()
    assert (r.r, r.y) == (1.0, 0)


def test_api_end_to_end(spark, tmp_path):
    (tmp_path / "p").mkdir()
    people = {"a": {"age": 70, "meds": []}, "b": {"age": 40, "meds": []}, "c": {"age": 70}, "d": {"age": 10, "meds": [{"code": "ac", "system": "rx", "daysAgo": 3}]}}
    for k, f in people.items():
        (tmp_path / "p" / f"{k}.yaml").write_text(json.dumps({"patient": k, "facts": f}))
    e = Engine(spark)
    ev, text = e.screen(str(tmp_path / "p"), A, MODEL_TEXT, "2026-01-01", out=str(tmp_path / "out"))
    assert {r.patient: r.overall for r in ev.collect()} == {"a": "undetermined", "b": "undetermined", "c": "undetermined", "d": "ineligible"}
    assert "screen-fail | 1" in text and (tmp_path / "out" / "metadata").exists()
    facts, bad = e.cohort(str(tmp_path / "p"), MODEL_TEXT, [D.parse_ruleset(A)])
    assert bad.count() == 0
    s, findings, flips = e.compare(A, B, MODEL_TEXT, facts)
    assert s.changed == ("age-min",) and findings == []
    assert [(r.patient, r.responsible) for r in flips.collect()] == [("b", ["age-min"])]
    suite = "cases:\n  - {name: x, facts: {age: 3}, expect: {overall: ineligible, age-min: fail}}\n  - {name: y, facts: {age: 30}, expect: {overall: eligible}}\n"
    t = e.test(A, MODEL_TEXT, suite)
    assert [(r.patient, r.id, r.got) for r in t.mismatches.collect()] == [("y", "overall", "undetermined")]
    (tmp_path / "p" / "e.yaml").write_text(json.dumps({"patient": "a", "facts": {"age": "70", "sex": "x"}}))
    assert {(r.code, r.fact) for r in e.cohort(str(tmp_path / "p"), MODEL_TEXT, [D.parse_ruleset(A)])[1].collect()} == {("duplicate-patient", "patient"), ("invalid-patient-fact", "age"), ("invalid-patient-fact", "sex")}
    (tmp_path / "p" / "f.yaml").write_text(json.dumps({"patient": "u", "facts": {"age": 70, "age_unit": "months"}}))
    assert ("invalid-patient-unit", "age") in {(r.code, r.fact) for r in e.cohort(str(tmp_path / "p"), MODEL_TEXT, [D.parse_ruleset(A)])[1].collect()}
    with pytest.raises(ValueError, match="blocked"):
        e.evaluate(facts, A.replace("years", "months"), MODEL_TEXT)


def test_mess_is_deterministic_and_normalisation_repairs(spark):
    labs = spark.createDataFrame([(f"p{i}", s, c, 100.0 + i, u, 5) for i in range(40) for c, s, u in ingest.LABS[:6]], "patient string, slug string, code string, value double, unit string, days_ago int")
    one, two = (ingest.mess(x, 3).orderBy("patient", "slug") for x in (labs, labs.repartition(7)))
    assert one.collect() == two.collect()
    n = ingest.normalize_labs(one.withColumnRenamed("slug", "base").drop("log")).cache()
    clean = n.where("status in ('ok', 'unit-alias', 'assumed-unit')").join(labs.select("patient", F.col("slug"), F.col("value").alias("was"), F.col("unit").alias("unit0")), ["patient", "slug"])
    changed = one.where("array_contains(log, 'convert-unit') or array_contains(log, 'drop-unit')").select("patient", "slug")
    assert clean.join(changed, ["patient", "slug"], "left_anti").where("value <> was or unit <> unit0").count() == 0
    assert n.where("status in ('unresolvable-code', 'quarantined-value', 'unknown-unit') and (value is not null or raw is null)").count() == 0
    again = ingest.normalize_labs(n.where("raw is null").select("patient", F.lit(None).cast("string").alias("code"), F.col("slug").alias("base"), F.col("value").cast("string").alias("value_text"), "unit"))
    assert [r[0] for r in again.select("status").distinct().collect()] == ["ok"]


def test_dedup_keeps_first_of_equals_and_undated_stays(spark):
    rows = [("p", "s", "x", None, 1), ("p", "s", "x", None, 2), ("p", "s", "y", 9, 1), ("p", "s", "y", 3, 2), ("p", "s", "y", 3, 3)]
    got = ingest.dedup_codes(spark.createDataFrame(rows, "patient string, system string, code string, days_ago int, seq int"), "patient")
    assert sorted((r.code, r.days_ago, r.seq) for r in got.collect()) == [("x", None, 1), ("y", 3, 2)]


def test_flatten(spark):
    coding = lambda s, c: {"coding": [{"system": s, "code": c}]}
    lab = lambda c, v, at: {"resource": {"resourceType": "Observation", "code": coding("http://loinc.org", c), "effectiveDateTime": at, "valueQuantity": {"value": v, "unit": "mg/dL"}}}
    bundle = {"entry": [
        {"resource": {"resourceType": "Patient", "id": "ab12cd34ef", "birthDate": "1960-05-01", "gender": "male"}},
        lab("38483-4", 1.0, "2020-01-01"), lab("38483-4", 1.2, "2020-03-01"), lab("0000-0", 9, "2020-03-01"),
        {"resource": {"resourceType": "Observation", "code": coding("http://loinc.org", "55284-4"), "effectiveDateTime": "2020-02-01", "component": [{"code": coding("http://loinc.org", "8480-6"), "valueQuantity": {"value": 120, "unit": "mm[Hg]"}}]}},
        {"resource": {"resourceType": "MedicationRequest", "status": "stopped", "authoredOn": "2018-01-01", "medicationCodeableConcept": coding(ingest.RXNORM, "old")}},
        {"resource": {"resourceType": "MedicationRequest", "status": "active", "authoredOn": "2018-01-01", "medicationCodeableConcept": coding(ingest.RXNORM, "now")}},
        {"resource": {"resourceType": "Condition", "onsetDateTime": "2019-01-01", "code": {"coding": [{"system": "other", "code": "x"}, {"system": ingest.SNOMED, "code": "88805009"}]}}},
        {"resource": {"resourceType": "Condition", "onsetDateTime": "2019-01-01", "code": {"coding": []}}}, {"resource": {"resourceType": "Condition", "code": coding(ingest.SNOMED, "undated")}},
    ]}
    b = spark.createDataFrame([(json.dumps(bundle),)], "j string").select(F.from_json("j", ingest.BUNDLE).alias("b")).select("b.entry")
    r = ingest.flatten(b, "2020-05-01").first()
    assert (r.patient, r.age, r.sex) == ("SYN-AB12CD34", 60, "male") and {k: v.value for k, v in r.labs.items()} == {"creatinine": 1.2, "systolic_bp": 120.0}
    assert [m.code for m in r.medications] == ["now"] and [(c.code, c.system) for c in r.conditions] == [("88805009", "snomed")]


@pytest.mark.parametrize(
    ("fact", "kind", "value", "quote", "denied"),
    [
        ("nyha", "enum", "IV", "No evidence of NYHA class IV", True),
        ("nyha", "enum", "IV", "No edema. NYHA class IV", False),
        ("nyha", "enum", "IV", "not class IV, but later class IV confirmed", False),
        ("on_dialysis", "boolean", "true", "denies dialysis", True),
        ("on_dialysis", "boolean", "false", "denies dialysis", False),
        ("nyha", "enum", "IV", "No class\r\nIV", False),
        ("nyha", "enum", "IV", "Free of\tclass iv; no IV", True),
        ("nyha", "enum", "IV", "no " + "x" * 100 + " IV", False),
        ("lvef", "number", "4.5", "not 4.5 %, not 4x5", True),
        ("nyha", "enum", "IV", "nothing like IV", False),
        ("nyha", "code", "IV", "no IV", False),
        ("nyha", "enum", "IV", None, None),
        ("nyha", "enum", "", "no IV", False),
    ],
)
def test_negation(spark, fact, kind, value, quote, denied):
    row = spark.createDataFrame([(fact, kind, value, quote)], "fact string, kind string, value string, quote string")
    assert row.select(ground.negation(*map(F.col, row.columns))).first()[0] is denied


def test_gate(spark):
    m = FactModel("m", {"lvef": FactDecl("number", "%"), "sex": FactDecl("enum", values=("f", "m"))})
    docs = spark.createDataFrame([("d1", "p1", "LVEF was 38 %.\r\nSex: f"), ("d2", None, "LVEF 40-45 %")], "doc string, patient string, body string")
    rows = [
        ("d1", 1, "lvef", "38", "%", 0.9, "LVEF was 38 %.\nSex: f", "p1"), ("d1", 2, "lvef", "38", "%", 0.9, "LVEF was 38", "p1"), ("d1", 3, "sex", "F", None, 0.9, "Sex: f", "p1"),
        ("d1", 4, "lvef", "38", "percent", 0.9, "LVEF was 39", "p2"), ("d2", 1, "lvef", "40-45", None, 0.5, "LVEF 40-45 %", "p9"), ("d3", 1, "age", "1", None, 0.5, " ", "p1"),
    ]
    p = spark.createDataFrame(rows, "doc string, seq int, fact string, value string, unit string, confidence double, quote string, patient string")
    got = {(r.doc, r.seq): r.reasons for r in ground.gate(p, docs, m).collect()}
    assert got == {
        ("d1", 1): [], ("d1", 2): ["duplicate-fact"], ("d1", 3): ["value-not-allowed"], ("d1", 4): ["wrong-patient", "quote-not-found", "unit-mismatch", "duplicate-fact"],
        ("d2", 1): ["type-mismatch", "missing-unit"], ("d3", 1): ["unknown-fact", "missing-source", "doc-not-found"],
    }


def test_calibration_keeps_empty_buckets(spark):
    b = {r.bucket: r.n for r in ground.calibration(spark.createDataFrame([(1.0, True), (0.2, False)], "confidence double, correct boolean")).collect()}
    assert b == {0: 0, 1: 1, 2: 0, 3: 0, 4: 1}
    assert ground.sentences("One. Two is here. Three. Four.", "is here") == "One. Two is here. Three."


def test_review_queue_order(spark):
    q = review.queue(spark.createDataFrame([("a", 0.9, False), ("b", 0.5, False), ("c", 0.9, True), ("d", 0.5, False)], "card string, confidence double, flips boolean"))
    assert [r.card for r in q.collect()] == ["c", "b", "d", "a"]


def test_streaming_gives_the_batch_verdicts(spark, tmp_path, wide):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    wide.write.parquet(src)
    stream = spark.readStream.schema(wide.schema).parquet(src)
    streaming.run_available(stream, V1, MODEL, out, str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(out).select("patient", "overall")
    assert got.exceptAll(evaluate.evaluate(wide, V1, MODEL).select("patient", "overall")).count() == 0 and got.count() == wide.count()
