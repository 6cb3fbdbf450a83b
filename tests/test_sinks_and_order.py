"""Corpus stages, order numbers, matching with units, and the batch stream, each against plain Python."""

import json
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortlens.api import Engine
from cohortlens.operators import classify, ground, report, review
from cohortlens.sources import file_order, tables
from cohortlens.sources.documents import parse_facts_file, parse_patient
from cohortlens.streaming import batches


def entries(spark, rows):
    df = spark.createDataFrame(rows, "patient string, fact string, value string, unit string, confidence double, extractedBy string, doc string, quote string, status string")
    return df.withColumn("value", F.parse_json("value"))


def files(path):
    return {os.path.join(d, f): (os.stat(os.path.join(d, f)).st_mtime_ns, open(os.path.join(d, f)).read()) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_facts_files_are_guarded(spark, tmp_path):
    path = str(tmp_path / "facts")
    rows = [(p, f, v, u, 0.5, "llm/m", "d", "q \"x\"", s) for p in ("a", "b/c d", "7") for f, v, u, s in (("lvef", "40", "%", "proposed"), ("bmi", '"x"', None, "proposed"), ("gone", "1", None, "rejected"))]
    docs = report.facts_documents(entries(spark, rows), "2024-01-02")
    first = {r.patient: r.action for r in report.write_documents(docs, path, guard=True).collect()}
    assert first == {"a": "written", "b/c d": "written", "7": "written"}
    read = {r.patient: parse_facts_file(r.text) for r in report.read_documents(spark, path).collect()}
    assert read["7"]["asOf"] == "2024-01-02" and [f["fact"] for f in read["b/c d"]["facts"]] == ["bmi", "lvef"] and read["a"]["facts"][1]["value"] == 40
    before = files(path)
    assert {r.action for r in report.write_documents(docs, path, guard=True).collect()} == {"unchanged"} and files(path) == before
    # somebody decides a row of "a"; new extractions come for "a" and "7"
    (mine,) = [f for f in before if "patient=a" in f]
    decided = read["a"]
    decided["facts"][0] |= {"status": "confirmed", "reviewedBy": "r", "reviewedAt": "2024-01-03T00:00:00Z"}
    open(mine, "w").write(json.dumps(decided))
    os.remove(os.path.join(os.path.dirname(mine), f".{os.path.basename(mine)}.crc"))
    changed = report.facts_documents(entries(spark, [(p, f, "41" if f == "lvef" else v, *rest) for p, f, v, *rest in rows if p != "b/c d"]))
    got = {r.patient: r.action for r in report.write_documents(changed, path, guard=True).collect()}
    assert got == {"a": "kept", "7": "written"}
    after = {r.patient: json.loads(r.text) for r in report.read_documents(spark, path).collect()}
    assert after["a"] == decided and after["7"]["facts"][1]["value"] == 41 and after["b/c d"] == read["b/c d"]


def test_bucketed_documents(spark, tmp_path):
    path = str(tmp_path / "b")
    docs = lambda rows: spark.createDataFrame(rows, "patient string, text string")
    rows = {str(i): json.dumps({"patient": str(i), "facts": []}) for i in range(40)}
    assert {r.action for r in report.write_documents(docs(list(rows.items())), path, buckets=4).collect()} == {"written"}
    before = sorted(os.listdir(path))
    assert {r.action for r in report.write_documents(docs(list(rows.items())[:9]), path, guard=True, buckets=4).collect()} == {"unchanged"}
    decided = json.dumps({"patient": "3", "facts": [{"fact": "f", "value": 1, "status": "confirmed", "extractedBy": "human", "reviewedBy": "r", "reviewedAt": "2024-01-01T00:00:00Z"}]})
    report.write_documents(docs([("3", decided)]), path, buckets=4)
    got = {r.patient: r.action for r in report.write_documents(docs([("3", "new"), ("4", "new"), ("99", "new")]), path, guard=True, buckets=4).collect()}
    assert got == {"3": "kept", "4": "written", "99": "written"} and sorted(os.listdir(path)) == before
    assert {r.patient: r.text for r in report.read_documents(spark, path, 4).collect()} == {**rows, "3": decided, "4": "new", "99": "new"}


def test_stage_with_log(spark, tmp_path):
    facts = spark.createDataFrame([("p\"1", '{"age": 3, "x": "y"}'), ("p2", "{}")], "patient string, facts string").withColumn("facts", F.parse_json("facts"))
    log = spark.createDataFrame([("p\"1", "unit", "lab_a", "dropped"), ("p\"1", "rename", "lab_b", "to\nz")], "patient string, kind string, target string, detail string")
    path = str(tmp_path / "messy")
    report.write_documents(report.stage_documents(facts, log), path)
    texts = {r.patient: r.text for r in report.read_documents(spark, path).collect()}
    assert texts["p\"1"].split("\n")[:2] == ["# rename lab_b to z", "# unit lab_a dropped"]
    assert parse_patient(texts["p\"1"]) == {"patient": 'p"1', "facts": {"age": 3, "x": "y"}} and json.loads(texts["p2"]) == {"patient": "p2", "facts": {}}
    none = report.write_documents(report.stage_documents(facts.limit(0), log), path)
    assert none.count() == 0 and len(files(path)) == 2


@pytest.mark.parametrize("parts,ranges", [(1, 1), (7, 5), (3, 40)])
def test_order_numbers(spark, parts, ranges):
    rnd = random.Random(parts)
    rows = [("same", i, 0) for i in range(300)] + [(rnd.choice("abcxyz") * rnd.randint(1, 3), rnd.randint(0, 5), i) for i in range(200)] + [(None, 1, 1), ("", None, 2), ("", 1, 3)]
    df = spark.createDataFrame(rows, "name string, t int, __lot int").repartition(parts)
    got = file_order.numbered(df, "name", "t", ranges=ranges).collect()
    assert sorted(r.place for r in got) == list(range(len(rows)))
    low = lambda x: (x is not None, x)
    want = sorted(rows, key=lambda r: (low(r[0]), low(r[1])))
    assert [(r.name, r.t) for r in sorted(got, key=lambda r: r.place)] == [r[:2] for r in want]
    assert file_order.numbered(df.limit(0), "name", "t").count() == 0


def test_notes_in_order(spark, tmp_path):
    for n in ("b", "a", "c"):
        (tmp_path / f"{n}.txt").write_text(f"---\ndoc: {n}\npatient: p{n}\nkind: k\nsynthetic: true\n---\nBody {n}.\n" if n != "c" else "no front matter")
    notes = tables.read_notes(tables.read_files(spark, str(tmp_path), "*.txt"))
    assert [(r.place, r.doc, r.patient) for r in sorted(tables.notes_in_order(notes).collect())] == [(0, "a", "pa"), (1, "b", "pb")]
    assert tables.duplicate_documents(notes).count() == 0


def test_matching_with_units(spark):
    rnd = random.Random(5)
    draw = lambda i: (f"d{rnd.randint(0, 5)}", i, rnd.choice(["f", "g"]), rnd.choice(["1", '"1"', "1.0", "true"]), rnd.choice([None, "kg", "lb"]))
    expected, grounded = [draw(i) for i in range(120)], [(*draw(i), 0.5) for i in range(150)]
    want = Counter()
    left = {}
    norm = lambda v: "1" if v == "1.0" else v
    for d, _, f, v, u in expected:
        left.setdefault((d, f, norm(v)), []).append(u)
    for d, _, f, v, u, _ in grounded:
        rest = left.get((d, f, norm(v)), [])
        at = next((i for i, e in enumerate(rest) if e is None or e == u), None)
        want[d, f, norm(v), u, "fp" if at is None else "tp"] += 1
        if at is not None:
            rest.pop(at)
    want.update((*k, u, "fn") for k, rest in left.items() for u in rest)
    e = spark.createDataFrame(expected, "doc string, seq int, fact string, value string, unit string").withColumn("value", F.parse_json("value"))
    g = spark.createDataFrame(grounded, "doc string, seq int, fact string, value string, unit string, confidence double").withColumn("value", F.parse_json("value"))
    got = ground.match_facts(e, g)
    assert Counter((r.doc, r.fact, r.value, r.unit, r.outcome) for r in got.collect()) == want
    assert got.where("confidence IS NULL AND outcome <> 'fn'").count() == 0
    assert {r.outcome for r in ground.match_facts(e.limit(0), g).collect()} == {"fp"} and ground.match_facts(e.limit(0), g.limit(0)).count() == 0


def test_batch_stream(spark, tmp_path):
    at = lambda h: f"2024-01-0{1 + h // 24} {h % 24:02d}:00:00"
    steps = [
        [(f"r{i}", "request", None, at(0)) for i in range(6)],
        [("r0", "result", "succeeded", at(1)), ("r1", "result", "errored", at(1)), ("r2", "result", "succeeded", at(1)), ("zz", "result", "succeeded", at(2))],
        [("r2", "result", "succeeded", at(3)), ("r5", "result", "succeeded", at(20))],
        [(None, "clock", None, at(60))],
        [("r3", "result", "succeeded", at(61)), (None, "clock", None, at(120))],
    ]
    for i, rows in enumerate(steps):
        spark.createDataFrame(rows, "custom_id string, kind string, status string, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        batches.run_batch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = Counter((r.custom_id, r.problem) for r in spark.read.schema("custom_id string, problem string").parquet(str(tmp_path / "out")).collect())
    assert got == Counter({("r1", "failed"): 1, ("r2", "duplicate"): 1, ("r3", "missing"): 1, ("r4", "missing"): 1, ("zz", "unexpected"): 1, ("r3", "unexpected"): 1})


def test_manifest_refuses_unfounded_corrections(spark):
    e = entries(spark, [("a", "f", "1", None, 0.5, "llm/m", "d", "q", "proposed"), ("a", "g", "2", None, None, "human", "d", "q", "confirmed"), ("b", "f", "1", None, 0.5, "llm/m", "d", "q", "proposed")]).withColumn("source", F.struct("doc", "quote"))
    d = spark.createDataFrame([("a:f", "confirmed", "3", None, "typo", None), ("b:f", "pending", None, None, None, None)], "card string, decision string, value string, at string, correction_reason string, correction_source string").withColumn("value", F.parse_json("value"))
    with pytest.raises(Exception, match="a:f: a corrected value has no reason or source"):
        review.snapshot_manifest(e, d, "r", "2024-01-01").collect()
    (row,) = review.snapshot_manifest(e, d.withColumn("correction_source", F.lit("chart")), " r ", "2024-01-01").collect()
    m = json.loads(row.json)
    assert m["patient"] == "a" and not m["authoritative"] and [x["fact"] for x in m["sourceSnapshot"]] == ["f", "g"]
    assert m["decisions"][0]["after"] == {"fact": "f", "value": 3, "status": "confirmed", "extractedBy": "human", "attestation": {"type": "reviewer-attestation", "detail": "chart"}, "reviewedBy": "r", "reviewedAt": "2024-01-01"}
    with pytest.raises(ValueError):
        review.snapshot_manifest(e, d, " ", "2024-01-01")


def test_batch_text_and_requests(spark):
    b = spark.createDataFrame([("a", 1, "text", '"x"]'), ("a", 0, "text", "["), ("a", 2, "thinking", "no"), ("b", 0, "thinking", "x"), ("c", 0, "text", "[1"), ("d", 0, "text", None)], "doc string, seq int, type string, text string")
    assert {r.doc: (r.output, r.problem) for r in ground.batch_text(b).collect()} == {"a": ('["x"]', None), "b": (None, "empty"), "c": (None, "not-json"), "d": (None, "empty")}
    n = spark.createDataFrame([("a", "é" * 5), ("b", "x" * 11), ("c", "1"), ("c", "2"), ("d", None)], "doc string, body string")
    got = sorted((r.custom_id, r.n_bytes, r.problem, r.request is None) for r in ground.requests(n, "s", "m", "f", note_bytes=10).collect())
    assert got == [("a", 10, None, False), ("b", 11, "note-too-long", True), ("c", 1, "duplicate-id", True), ("c", 1, "duplicate-id", True), ("d", 0, None, False)]
    with pytest.raises(ValueError):
        ground.requests(n, "s", "m", "f", "x" * 11, model_bytes=10)


def test_coverage_report(spark):
    lines = spark.createDataFrame([("t1", "inclusion", "Age over 18 years"), ("t1", "exclusion", "Planned surgery soon"), ("t2", "inclusion", "Fond of long walks")], "trial string, kind string, line string")
    text = report.coverage_report(classify.classify(lines))
    assert "2 trials" in text and "| all | expressible | 1 | 33.3 |" in text and "- Fond of long walks (t2)" in text and "- Planned surgery soon (t1: clinical-condition, not intent-or-plan)" in text


def test_one_fact_model_and_confirmed_facts(spark, tmp_path):
    (tmp_path / "model.yaml").write_text("name: m\nfacts:\n  age: {type: number, unit: years}\n")
    with pytest.raises(ValueError):
        tables.load_fact_model(spark)
    spark.conf.set("cohortlens.factModel", str(tmp_path / "model.yaml"))
    try:
        assert tables.load_fact_model(spark).facts["age"].unit == "years"
    finally:
        spark.conf.unset("cohortlens.factModel")
    folder = tmp_path / "facts"
    folder.mkdir()
    row = lambda f, v, s="confirmed": {"fact": f, "value": v, "status": s, "extractedBy": "human", "reviewedBy": "r", "reviewedAt": "2024-01-01T00:00:00Z"}
    (folder / "a.yaml").write_text(json.dumps({"patient": "a", "facts": [row("age", 3), row("bmi", 4, "rejected")]}))
    (folder / "b.yaml").write_text(json.dumps({"patient": "a", "facts": [row("x", "y")]}))
    engine = Engine(spark)
    assert sorted((r.patient, r.fact, str(r.value)) for r in engine.confirmed(str(folder)).withColumn("value", F.to_json("value")).collect()) == [("a", "age", "3"), ("a", "x", '"y"')]
    (folder / "c.yaml").write_text(json.dumps({"patient": "a", "facts": [row("age", 4)]}))
    with pytest.raises(ValueError, match="a/age"):
        engine.confirmed(str(folder))
