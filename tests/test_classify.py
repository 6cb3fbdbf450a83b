"""Labelled criterion lines, and the term tables."""

from pyspark.sql import functions as F

from cohortlens.operators import classify, term_table

#: Lines and the classes that they must have.
LINES = {
    "Karnofsky Performance Status > 60": "expressible",
    "Prior stroke within 90 days of randomization": "expressible",
    "Serum creatinine < 1.5 mg/dL": "expressible",
    "Ages Eligible for Study: 18 Years to 95 Years": "expressible",
    "Must have a documented left ventricular ejection fraction of less than or equal to 40 percent": "expressible",
    "Hemoglobin greater than or equal to 9 g/dL": "expressible",
    "Pregnant or lactating.": "expressible",
    "Patients with symptomatic CNS metastases or leptomeningeal involvement": "expressible",
    "Patients with known brain metastases, unless these metastases have been treated and have been stable for at least six months prior to study start": "partially",
    "Any condition that, in the opinion of the investigator, would have an unacceptable risk of bleeding within 28 days of randomization": "partially",
    "Must have a life expectancy of greater than three (3) months": "partially",
    "Adequate renal function defined as serum creatinine less than 2.0 mg/dL": "partially",
    "Planned intermittent outpatient treatment with positive inotropic drugs administered intravenously": "partially",
    "Must be medically stable in terms of their heart failure clinical status at the time of randomization": "partially",
    "Willing and able to provide written informed consent": "unmodeled",
    "Patients who are, in the opinion of the investigator, unsuitable for the study": "unmodeled",
}
SIGNALS = {
    "Prior stroke within 90 days of randomization": (["time-window", "clinical-condition"], []),
    "platelets of 100 x 10^9/L or 5 U/L": (["unit", "named-measure"], []),
    "5 u/l and 30 % of all": (["unit"], []),
    "5 u/l": ([], []),
    "No more than twelve weeks; BMI >=30": (["numeric-threshold", "named-measure"], []),
    "disease that might interfere": (["clinical-condition"], ["interference"]),
    "that could one two three four limit": ([], []),
    "the investigator’s judgment; including, but also": ([], ["investigator-judgement", "open-ended-list"]),
    "well-controlled breast-feeding men": (["sex", "clinical-condition"], ["vague-qualifier"]),
    "arthritis, but not itis, coma": (["clinical-condition"], []),
    "compromising allergies": (["clinical-condition"], ["interference"]),
    "≤ 3,5 ≥": (["numeric-threshold"], []),
    "": ([], []),
}


def test_labelled_lines(spark):
    df = spark.createDataFrame([(x,) for x in LINES], "line string")
    assert {r.line: r["class"] for r in classify.classify(df).collect()} == LINES


def test_signals(spark):
    df = spark.createDataFrame([(x,) for x in [*SIGNALS, None]], "line string")
    got = classify.classify(df).collect()
    assert {r.line: (r.anchors, r.blockers) for r in got if r.line is not None} == SIGNALS
    assert [(r.anchors, r.blockers, r["class"]) for r in got if r.line is None] == [([], [], "unmodeled")]


def test_forms():
    assert term_table.terms("metastasis+; therapy+; box+; plan+ to; compromise!") == ["metastasis", "metastases", "therapy", "therapies", "box", "boxes", "plan to", "plans to", "compromise", "compromises", "compromised", "compromising"]
    assert all(len(terms) < 200 for terms in ({t for s, t in term_table.ANCHORS + term_table.BLOCKERS if s == name} for name in {*term_table.ANCHOR_TERMS, *term_table.BLOCKER_TERMS}))


def test_examples(spark):
    df = spark.createDataFrame([("b", 2, "x"), ("b", 1, "y"), ("a", 3, "z")], "trial string, at int, line string").withColumn("__n", F.lit(0))
    assert all(r["__n"] == 0 for r in classify.examples(df, "trial", "at", 5).collect())
    assert [(r.trial, r.line) for r in classify.examples(df, "trial", "at", 5).collect()] == [("a", "z"), ("b", "y")]
