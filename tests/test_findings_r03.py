"""What the review of round 3 found, each in small."""

from pyspark.sql import functions as F

from cohortlens.model import FactDecl, FactModel
from cohortlens.operators import ground
from cohortlens.sources import file_order


def test_only_values_that_fit_are_denied(spark):
    """"no … es" doesn't deny a language that the model doesn't allow, and still denies one that it does."""
    m = FactModel("m", {"lang": FactDecl("enum", values=("en", "de")), "n": FactDecl("number"), "long": FactDecl("boolean")})
    rows = [(0, "lang", "es", "No es."), (1, "lang", "de", "No de."), (2, "n", "about 10", "not about 10"), (3, "n", "10", "not 10"), (4, "long", "yes", "not long"), (5, "long", "true", "not long")]
    p = spark.createDataFrame([(f"d{i}", i, f, v, None, 0.5, q, "p") for i, f, v, q in rows], "doc string, seq int, fact string, value string, unit string, confidence double, quote string, patient string")
    docs = p.select("doc", "patient", F.col("quote").alias("body"))
    got = {r.seq: r.reasons for r in ground.gate(p, docs, m).collect()}
    assert got == {0: ["value-not-allowed"], 1: ["contradictory-negation"], 2: ["type-mismatch"], 3: ["contradictory-negation"], 4: ["type-mismatch"], 5: ["contradictory-negation"]}


def test_files_are_numbered_in_many_ranges(spark):
    """as many ranges as a large table takes; the plan must not nest by their number."""
    rows = spark.range(3000).select(F.when(F.col("id") % 50 != 0, F.md5((F.col("id") % 900).cast("string"))).alias("name"), "id")
    got = sorted(file_order.numbered(rows, "name", "id", ranges=1200).collect(), key=lambda r: r.place)
    assert [r.place for r in got] == list(range(3000))
    assert [(r.name, r.id) for r in got] == sorted(((r.name, r.id) for r in rows.collect()), key=lambda x: (x[0] is not None, x[0] or "", x[1]))


def test_models_are_not_dealt_by_their_name(spark):
    """nearly all rule sets name one model, so no exchange may deal leaves by its name."""
    from cohortlens.operators import rule_tables

    c = spark.range(40).select(*[F.lit(x).alias(k) for k, x in (("version", "1.0.0"), ("fact_model", "m"), ("ref", None), ("kind", "inclusion"), ("verbatim", "t"))], F.col("id").cast("string").alias("ruleset"), F.col("id").alias("ord"), F.col("id").cast("string").alias("id"), F.lit('{"fact":"nope","op":"exists"}').alias("when"))
    models = spark.createDataFrame([("m", "age", "number", None, [], [])], "fact_model string, fact string, type string, unit string, values array<string>, systems array<string>")
    found = rule_tables.lint_rules(c, models)
    assert found.count() == 40
    assert "hashpartitioning(fact_model" not in found._jdf.queryExecution().optimizedPlan().toString() + found._jdf.queryExecution().sparkPlan().toString() and "SortMergeJoin" not in found._jdf.queryExecution().sparkPlan().toString()
    assert rule_tables.levels_of(c) == 1 and rule_tables.levels_of(c.withColumn("when", F.lit('{"not":{"fact":"a","op":"exists"}}'))) >= 2


def test_bundles_share_files(spark, tmp_path):
    """many small bundles take few files, a large one its own; what is read is the same."""
    import json

    from cohortlens.operators import ingest
    from test_bundles import bundle

    texts = [(str(i), json.dumps(bundle(f"{i:08d}-1", i % 5 + (300 if i == 7 else 0)), indent=i % 2 or None)) for i in range(60)]
    df = spark.createDataFrame(texts, "name string, text string").repartition(3)
    ingest.write_bundles(df, str(tmp_path / "b"), own_bytes=20_000)
    assert len(list((tmp_path / "b" / "lots").glob("part-*"))) <= 4 and len(list((tmp_path / "b" / "fhir").glob("name=*"))) == 1
    told = lambda rows: sorted((r.patient, r.r.resourceType, r.r.id, str(r["at"])) for r in rows.collect())
    whole = df.select(F.from_json("text", ingest.BUNDLE).alias("b")).select("b.entry")
    assert told(ingest.read_written(spark, str(tmp_path / "b"))) == told(ingest.resources(whole))


def test_many_files_take_few_steps(spark, tmp_path):
    """a batch in many files, ids of one lot that expire at different times among them."""
    from collections import Counter

    from cohortlens.streaming import batches

    day = lambda d: f"2024-01-{d:02d} 00:00:00"
    say = lambda rows, n: spark.createDataFrame(rows, "custom_id string, kind string, status string, at string").withColumn("at", F.to_timestamp("at")).repartition(n).write.mode("append").parquet(str(tmp_path / "in"))
    paths = [str(tmp_path / n) for n in ("in", "out", "state")]
    ids = [f"r{i}" for i in range(300)]
    before, batches.LOTS = batches.LOTS, 3
    try:
        say([(i, "request", None, day(1 + k % 2)) for k, i in enumerate(ids)] + [(i, "result", "errored" if k % 7 == 0 else "succeeded", day(2)) for k, i in enumerate(ids) if k % 3] + [(None, "clock", None, day(2))], 9)
        q = batches.run_batch(spark, *paths, step_bytes=1 << 20)
        q.awaitTermination()
        assert len(q.recentProgress) <= 3  # before: a step for each of nine files
        early = Counter(r.problem for r in spark.read.schema("custom_id string, problem string").parquet(paths[1]).collect())
        say([("r1", "result", "succeeded", "2024-01-02 01:00:00"), (None, "clock", None, day(5))], 1)
        batches.run_batch(spark, *paths, step_bytes=1 << 20).awaitTermination()
    finally:
        batches.LOTS = before
    got = {r.custom_id: r.problem for r in spark.read.schema("custom_id string, problem string").parquet(paths[1]).collect()}
    want = {i: "missing" if k % 3 == 0 else "failed" for k, i in enumerate(ids) if k % 3 == 0 or k % 7 == 0}
    assert not early and got == {**want, "r1": "duplicate"}


def test_json_documents_are_read_by_their_own_reader(spark):
    """facts files are JSON; YAML's reader took most of the stage's time, and cut characters beyond the basic plane in two."""
    from cohortlens.operators import report
    from cohortlens.sources import documents as D

    assert D.load('{"a": "\\ud83d\\ude00", "b": [1e3]}') == {"a": "\U0001f600", "b": [1000.0]}
    assert report.buckets_for(1) == 16 and report.buckets_for(900_000) == 45


def test_repeated_lines_are_classified_once(spark, sf_dir, monkeypatch):
    """F8, F9: what is only counted is classified by its distinct lines, with the same counts."""
    from cohortlens.operators import classify
    from cohortlens.plans import catalogue

    lines = catalogue._criteria_lines(spark, sf_dir)
    lines = lines.unionByName(lines).unionByName(lines.limit(5).withColumn("line", F.lit(None).cast("string")))
    one = classify.counted(lines, "kind", "line")
    assert one.count() == lines.select("kind", "line").distinct().count() < lines.count() / 2
    rows = lambda d: sorted(map(str, d.collect()))
    every, once = classify.classify(lines), classify.classify(one)
    assert rows(classify.tally(every, "kind")) == rows(classify.tally(once, "kind", "times"))
    assert classify.top_signals(every, "anchors").collect() == classify.top_signals(once, "anchors", times="times").collect()
    given = []
    monkeypatch.setattr(classify, "classify", lambda d, *a, f=classify.classify: given.append(d.columns) or f(d, *a))
    for name in ("classify_tally", "signal_top5"):
        catalogue.queries()[name](spark, sf_dir)
    assert given == [["kind", "line", "times"], ["line", "times"]]


def test_intervals_are_hashed_and_levels_are_tight(spark):
    """no aggregate sorts, brackets of code lists are no levels, and nodes of each depth are found by any spelling of their keys."""
    import random

    from cohortlens.operators import rule_tables
    from test_rule_tables import drawn_set, table

    leaf = lambda op, v: f'{{"fact":"a","op":"{op}","value":{v}}}'
    whens = {
        "ties": [leaf("gt", 1), leaf("gte", 1), leaf("lte", 4), leaf("lt", 4)], "closed": [leaf("gte", 1), leaf("lte", 4), leaf("neq", 2)], "empty": [leaf("gt", 1), leaf("lte", 1)],
        "deep": ['{"all":[%s,{"all":[%s]}]}' % (leaf("gte", 0), leaf("lt", 9))], "escaped": ['{"\\u0061ll":[%s]}' % leaf("gte", 3)], "beside": ['{"any":[%s]}' % leaf("gt", 5), '{"fact":"a","op":"in","codes":{"system":"all","values":["value"]}}'],
        "same": [leaf("eq", 7)] * 2, "own": ['{"all":[%s,%s]}' % (leaf("gt", 2), leaf("lt", 2)), leaf("gte", -1)], "no number": [leaf("lt", "null"), leaf("gt", 1)], "text": [leaf("eq", '"x"'), leaf("eq", "true")],
    }
    rows = [(name, "1.0.0", "m", 0 if name == "same" else i, "c", None, "inclusion", "t", w) for name, ws in whens.items() for i, w in enumerate(ws)]
    c = spark.createDataFrame(rows, "ruleset string, version string, fact_model string, ord long, id string, ref string, kind string, verbatim string, `when` string")
    got = rule_tables.admitted_intervals(c)
    assert {r.ruleset: (r.interval, r.n) for r in got.collect()} == {"ties": ("(1, 4)", 4), "closed": ("[1, 4]", 2), "empty": ("empty", 2), "deep": ("[0, 9)", 1), "escaped": ("[3, ∞)", 1), "same": ("[7, 7]", 1), "own": ("[-1, ∞)", 1), "no number": ("(1, ∞)", 1)}
    assert "SortAggregate" not in got._jdf.queryExecution().sparkPlan().toString()  # before: four sorts of all criteria
    assert rule_tables.levels_of(c.where("ruleset = 'deep'")) == 3 and rule_tables.levels_of(c.where("ruleset = 'beside'")) == 2  # before: by brackets

    rnd = random.Random(11)
    drawn = table(spark, [drawn_set(rnd, f"r{i}")[0] for i in range(80)])
    told = lambda d: sorted(map(str, d.collect()))
    keys = [*rule_tables._CRITERION, "fact", "op", "number"]
    assert told(rule_tables._numbers(drawn).select(*keys)) == told(rule_tables.node_rows(drawn, 9).where("needed AND family = 'numeric'").select(*keys))
    parts = ["ruleset", "ord", "path", "parent", "node", "fact", "op"]
    assert told(rule_tables.node_rows(drawn, needed=True).select(*parts)) == told(rule_tables.node_rows(drawn, 9).where("needed").select(*parts))
