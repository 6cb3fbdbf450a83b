import json

import pytest

from cohortlens.operators import ingest
from cohortlens.plans.cohort_tables import V1
from cohortlens.sources import sidecars as S
from cohortlens.sources.documents import DocumentError

RULES = """ruleset: r
rulesetVersion: 1.0.0
factModel: m
criteria:
  - id: age-min
    kind: inclusion
    verbatim: over 18   # keep
    when: {fact: age, op: gte, value: 18, unit: years}
  - id: other
    kind: inclusion
    verbatim: t
    when: {fact: bmi, op: gte, value: 18}

"""


def test_modeling_declaration():
    ok = {"ruleset": V1.ruleset, "rulesetVersion": V1.version, "partial": ["balance-min"]}
    assert S.modeling_declaration(json.dumps(ok), V1) == ("balance-min",)
    with pytest.raises(DocumentError) as e:
        S.modeling_declaration(json.dumps({**ok, "rulesetVersion": "9.9.9", "partial": ["nope", "chart-note", "nope"]}), V1)
    assert len(e.value.problems) == 4


def test_text_edits():
    out = S.set_literal(RULES, "other", 18, 21)
    assert out == RULES[: RULES.rindex("18")] + "21" + RULES[RULES.rindex("18") + 2 :]
    assert S.criterion_lines(RULES) == {"age-min": (5, 8), "other": (9, 12)}
    assert S.render_prompt("<!-- note -->\nUse {{factModel}}.", "M") == "Use M."


def test_review_state(spark):
    rows = S.review_state(spark, json.dumps({"a": "confirmed", "b": {"decision": "rejected", "at": "t"}, "c": {"decision": "maybe"}, "d": 3})).collect()
    assert sorted((r.card, r.decision) for r in rows) == [("a", "confirmed"), ("b", "rejected")]
    assert S.review_state(spark, "not json").count() == 0


def test_heart_failure_facts(spark):
    df = spark.createDataFrame([("p", ["lvef"]), ("q", [])], "patient string, has array<string>")
    one, two = (sorted(map(tuple, ingest.heart_failure_facts(x, 1).collect())) for x in (df, df.repartition(3)))
    assert one == two and ("p", "lvef") not in {r[:2] for r in one} and len(one) == 5 + 6
