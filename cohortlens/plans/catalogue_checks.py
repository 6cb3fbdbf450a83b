"""More queries: findings of rule documents, renderings, responses, reviews and corpus reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.model import FactDecl, FactModel
from cohortlens.operators import classify, cohort, evaluate, ground, ingest, lint, report, review
from cohortlens.plans import catalogue
from cohortlens.plans import sql_parts as S
from cohortlens.plans.catalogue import query
from cohortlens.plans.cohort_tables import MODEL, V1, facts_wide
from cohortlens.sources import sidecars, tables


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


_SMALL = FactModel("m", {"age": FactDecl("number", "years"), "bmi": FactDecl("number"), "sex": FactDecl("enum", values=("f", "m")), "ok": FactDecl("boolean"), "meds": FactDecl("code", systems=("rx",))})

# --- renderings ------------------------------------------------------------------------------------------


@query("report_lines", f"""SELECT '| ' || band || ' | ' || n || ' |' AS line FROM ({catalogue.oracle_sql()['display_band_counts']})
UNION ALL SELECT '| ' || id || ' | ' || removed_sequential || ' | ' || fails_alone || ' | ' || sole_reason || ' | ' || sole_modeled_reason || ' |' FROM ({catalogue.oracle_sql()['attrition_rows']})
UNION ALL SELECT '- ' || id || ' (' || n || '): ' || replace(patients, ',', ', ') || CASE WHEN n > 3 THEN ' and ' || (n - 3) || ' more' ELSE '' END FROM ({catalogue.oracle_sql()['sole_disqualifiers_listed']})""")
def _(spark, d):
    """The rows of the tables and the lists of the Markdown report."""
    text = report.markdown_report(evaluate.evaluate(facts_wide(spark, d), V1, MODEL), V1, "2001-08-02", shown=3)
    rows = [x for x in text.split("\n") if x.startswith(("| ", "- ")) and not x.startswith(("| band", "| criterion"))]
    return spark.createDataFrame([(x,) for x in rows], "line string")


@query("result_prose", S.with_v1("""
SELECT x.patient, x.id, CASE x.id WHEN 'chart-note' THEN 'needs chart review: not modeled'
    WHEN 'segment-open' THEN coalesce('segment = ' || segment || ', required ≠ MACHINERY', 'segment missing → unknown')
    ELSE coalesce('orders: ' || n_orders::BIGINT || ' entries, any of 1-URGENT within 90 days', 'orders missing → unknown') || CASE WHEN verdict = 'fail' THEN ' (exclusion fired)' ELSE '' END END AS prose,
  CASE WHEN unmodeled THEN 'cr' WHEN verdict = 'pass' THEN 'elig' WHEN verdict = 'fail' THEN 'fail' ELSE 'ne' END AS mark
FROM v AS x JOIN f USING (patient) WHERE x.id IN ('chart-note', 'segment-open', 'urgent-window')"""))
def _(spark, d):
    r = evaluate.evaluate(facts_wide(spark, d), V1, MODEL, trace=True).select("patient", F.explode("results").alias("r")).where(F.col("r.id").isin("chart-note", "segment-open", "urgent-window"))
    return r.select("patient", "r.id", evaluate.result_prose(F.col("r")).alias("prose"), evaluate.status_mark(F.col("r")).alias("mark"))


@query("corpus_hash", """WITH l AS (SELECT left(sha256(doc_id::VARCHAR), 4) AS lot, sha256('[' || string_agg('{"patient":"' || doc_id || '","hash":"' || sha256(text) || '"}', ',' ORDER BY doc_id::VARCHAR, sha256(text)) || ']') AS d, count(*) AS n FROM documents GROUP BY 1)
SELECT sha256(string_agg(d, '' ORDER BY lot)) AS corpus_hash, sum(n)::BIGINT AS n FROM l""")
def _(spark, d):
    return cohort.content_hash(_read(spark, d, "documents").select(F.col("doc_id").alias("patient"), F.sha2("text", 256).alias("hash")))


@query("demographics", "SELECT c_custkey AS patient, concat_ws(' · ', CASE WHEN c_custkey % 3 <> 0 THEN 'female' END, CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey % 90)::VARCHAR END) AS label FROM customer")
def _(spark, d):
    k = F.col("c_custkey")
    return _read(spark, d, "customer").select(k.alias("patient"), F.when(k % 3 != 0, "female").alias("sex"), F.when(k % 4 != 0, (k % 90).cast("double")).alias("age")).select("patient", sidecars.demographics().alias("label"))


# --- criterion lines -----------------------------------------------------------------------------------------


@query("classify_examples", "SELECT source AS trial, min(doc_id) AS doc_id FROM documents GROUP BY source ORDER BY source LIMIT 10")
def _(spark, d):
    return classify.examples(_read(spark, d, "documents").select(F.col("source").alias("trial"), "doc_id"), "trial", "doc_id").select("trial", "doc_id")


@query("distinct_trials", "SELECT count(DISTINCT source) AS trials FROM documents")
def _(spark, d):
    return classify.distinct_trials(_read(spark, d, "documents").select(F.col("source").alias("trial")), "trial")


# --- bundles -----------------------------------------------------------------------------------------------


@query("heart_failure_first", """(SELECT c_custkey AS patient, 1 AS n FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 12)
UNION ALL (SELECT c_custkey, 1 FROM customer WHERE c_mktsegment <> 'BUILDING' ORDER BY c_nationkey DESC, c_custkey LIMIT 8)""")
def _(spark, d):
    c = _read(spark, d, "customer")
    code = F.when(F.col("c_mktsegment") == "BUILDING", ingest.HF_CODES[0]).otherwise("x")
    flat = c.select(F.col("c_custkey").alias("patient"), F.col("c_nationkey").alias("age"), F.array(F.struct(code.alias("code"))).alias("conditions"))
    return ingest.hf_cohort(flat, 12, 20).select("patient", F.lit(1).alias("n"))


@query("normalize_twice", "SELECT e.event_id, CASE WHEN event_id % 3 = 0 THEN 'quarantined-before' WHEN event_id % 3 = 1 THEN 'quarantined-value' ELSE 'ok' END AS status, CASE WHEN event_id % 3 = 0 THEN 'hemolyzed mg/dL' WHEN event_id % 3 = 1 THEN 'cancelled mg/dL' END AS raw FROM events AS e")
def _(spark, d):
    k = F.col("event_id") % 3
    rows = _read(spark, d, "events").select("event_id", F.lit("38483-4").alias("code"), F.lit("creatinine").alias("base"), F.when(k == 1, "cancelled").when(k == 2, "1.5").alias("value_text"), F.when(k != 0, "mg/dL").alias("unit"), F.when(k == 0, "hemolyzed mg/dL").alias("raw"))
    once = ingest.normalize_labs(rows)
    return once.select("event_id", "status", "raw")


# --- responses, gate and review --------------------------------------------------------------------------------


@query("parse_responses", """SELECT doc_id AS doc, i AS seq, CASE i WHEN 0 THEN 'lang' ELSE 'chars' END AS fact, CASE i WHEN 0 THEN lang ELSE n_chars::VARCHAR END AS value, CASE i WHEN 1 THEN 'chars' END AS unit,
  CASE i WHEN 0 THEN 1.0 ELSE 0.25 END::DOUBLE AS confidence FROM documents, range(2) AS r(i) WHERE doc_id % 5 <> 0""")
def _(spark, d):
    x = _read(spark, d, "documents")
    told = lambda f, v, u, c: F.struct(F.lit(f).alias("fact"), v.alias("value"), F.lit(u).alias("unit"), F.lit(c).alias("confidence"), F.lit("q").alias("quote"))
    out = F.to_json(F.array(told("lang", F.col("lang"), " ", 1.5), told("chars", F.col("n_chars").cast("string"), "chars", 0.25)))
    rows = x.select(F.col("doc_id").alias("doc"), F.when(F.col("doc_id") % 5 == 0, F.lit("no JSON")).otherwise(out).alias("output"))
    return ground.parse_response(rows).where("fact is not null").select("doc", "seq", "fact", "value", "unit", "confidence")


_CHARS = FactModel("labels/v1", {"chars": FactDecl("number", "chars"), "lang": FactDecl("enum", values=("en", "de", "fr")), "long": FactDecl("boolean"), "meds": FactDecl("code", systems=("rx",))})


def _extracted(spark: SparkSession, d: str) -> DataFrame:
    x = _read(spark, d, "documents")
    told = lambda f, v, u: F.struct(F.lit(f).alias("fact"), v.alias("value"), F.lit(u).alias("unit"), F.lit(0.5).alias("confidence"), F.substring("text", 1, 20).alias("quote"))
    out = F.to_json(F.array(told("long", F.when(F.col("doc_id") % 2 == 0, "true").otherwise("yes"), None), told("lang", F.col("lang"), None), told("meds", F.lit("a"), None), told("chars", F.col("n_chars").cast("string"), None)))
    rows = x.select(F.col("doc_id").alias("doc"), out.alias("output"))
    notes = x.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("doc"), F.lit("p").alias("patient"), F.col("text").alias("body"))
    return ground.extract(rows, notes, _CHARS)


_GATED = """g AS (SELECT doc_id AS doc, i AS seq, CASE WHEN doc_id % 7 = 0 THEN false WHEN i = 0 THEN doc_id % 2 = 0 WHEN i = 1 THEN lang IN ('en', 'de', 'fr') ELSE false END AS grounded, doc_id, lang
  FROM documents, range(4) AS r(i))"""


@query("extract_facts", f"WITH {_GATED} SELECT doc, seq, CASE WHEN grounded THEN 'proposed' ELSE 'rejected' END AS status FROM g")
def _(spark, d):
    """Recorded responses through the gate: boolean and code proposals, languages and missing units among them."""
    return _extracted(spark, d).select("doc", "seq", "status")


@query("extract_reasons", f"""WITH {_GATED}, r AS (SELECT 'doc-not-found' AS reason FROM g WHERE doc % 7 = 0 UNION ALL SELECT 'type-mismatch' FROM g WHERE (seq = 0 AND doc % 2 <> 0) OR seq = 2
  UNION ALL SELECT 'value-not-allowed' FROM g WHERE seq = 1 AND lang NOT IN ('en', 'de', 'fr') UNION ALL SELECT 'missing-unit' FROM g WHERE seq = 3)
SELECT reason, count(*) AS n FROM r GROUP BY reason ORDER BY n DESC, reason""")
def _(spark, d):
    return ground.reasons_by_frequency(_extracted(spark, d))


@query("grounding_stats", f"""WITH {_GATED} SELECT count(*) AS proposed, count(*) FILTER (WHERE grounded) AS grounded, count(*) FILTER (WHERE NOT grounded) AS rejected, round(count(*) FILTER (WHERE grounded) / count(*), 9) AS pass_rate,
  count(*) FILTER (WHERE NOT grounded AND NOT (seq = 1 AND doc % 3 = 0)) AS caught, count(*) FILTER (WHERE NOT grounded AND seq = 1 AND doc % 3 = 0) AS overblocked FROM g""")
def _(spark, d):
    expected = _read(spark, d, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("doc"), F.lit("lang").alias("fact"), F.col("lang").alias("value"))
    return ground.grounding_stats(_extracted(spark, d), expected).withColumn("pass_rate", F.round("pass_rate", 9))


@query("token_sums", "SELECT sum(CASE WHEN doc_id % 4 <> 0 THEN n_chars ELSE 0 END)::BIGINT AS input_tokens, sum(CASE WHEN doc_id % 3 <> 0 THEN 1 ELSE 0 END)::BIGINT AS output_tokens, count(*) FILTER (WHERE doc_id % 4 <> 0 AND doc_id % 3 <> 0) AS recorded FROM documents")
def _(spark, d):
    k = F.col("doc_id")
    return ground.token_sums(_read(spark, d, "documents").select(F.when(k % 4 != 0, F.col("n_chars").cast("long")).alias("input_tokens"), F.when(k % 3 != 0, F.lit(1).cast("long")).alias("output_tokens")))


@query("notes_without_cases", "SELECT doc_id AS doc, CASE WHEN doc_id % 3 = 0 THEN 'no-expected-case' ELSE 'no-note' END AS problem FROM documents WHERE (doc_id % 3 = 0) <> (doc_id % 4 = 0)")
def _(spark, d):
    doc = _read(spark, d, "documents").select(F.col("doc_id").alias("doc"))
    return ground.without_expected(doc.where("doc % 3 = 0"), doc.where("doc % 4 = 0"))


@query("recording_mismatches", "SELECT doc_id AS doc, concat_ws(',', CASE WHEN doc_id % 2 = 0 THEN 'requestHash' END, CASE WHEN doc_id % 3 = 0 THEN 'promptHash' END) AS mismatches FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def _(spark, d):
    want = sidecars.controls({"doc": "x"}, "prompt", {"type": "array"})
    k = F.col("doc_id")
    rec = _read(spark, d, "documents").select(k.alias("doc"), F.when(k % 2 != 0, want["requestHash"]).alias("requestHash"), F.when(k % 3 == 0, "old").otherwise(want["promptHash"]).alias("promptHash"), F.lit(want["schemaHash"]).alias("schemaHash"))
    return ground.recording_mismatches(rec, want).withColumn("mismatches", F.array_join("mismatches", ","))


@query("matching_recordings", "SELECT doc_id AS doc FROM documents WHERE doc_id % 2 <> 0 AND doc_id % 5 <> 0")
def _(spark, d):
    want = sidecars.controls({"doc": "x"}, "prompt", {"type": "array"})
    k = F.col("doc_id")
    rec = _read(spark, d, "documents").select(k.alias("doc"), F.when(k % 2 != 0, want["requestHash"]).alias("requestHash"), F.lit(want["promptHash"]).alias("promptHash"), F.lit(want["schemaHash"]).alias("schemaHash"), (k % 5 != 0).alias("valid"))
    return tables.matching(rec, want).select("doc")


_DECISIONS = """x AS (SELECT o_orderkey AS card, o_custkey AS patient, CASE o_orderkey % 5 WHEN 0 THEN 'maybe' WHEN 1 THEN 'rejected' ELSE 'confirmed' END AS decision, CASE WHEN o_orderkey % 3 = 0 THEN '7' END AS value,
  CASE WHEN o_orderkey % 2 = 0 THEN 'typo' END AS reason FROM orders)"""


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    decision = F.when(k % 5 == 0, "maybe").when(k % 5 == 1, "rejected").otherwise("confirmed")
    return _read(spark, d, "orders").select(k.alias("card"), F.col("o_custkey").alias("patient"), decision.alias("decision"), F.when(k % 3 == 0, "7").alias("value"), F.lit("2024-01-01").alias("at"), F.when(k % 2 == 0, "typo").alias("correction_reason"), F.lit("chart").alias("correction_source"))


@query("valid_decisions", f"WITH {_DECISIONS} SELECT card, decision FROM x WHERE card % 7 <> 0 AND decision <> 'maybe' AND (value IS NULL OR (decision = 'confirmed' AND reason IS NOT NULL))")
def _(spark, d):
    rows = _decisions(spark, d)
    return review.valid_decisions(rows, rows.where("card % 7 <> 0").select("card")).select("card", "decision")


@query("latest_decisions", f"WITH {_DECISIONS} SELECT patient AS card, max(decision) AS decision FROM x GROUP BY patient")
def _(spark, d):
    """All of one time: the tie goes to the rejection, then to the greater word."""
    return review.latest_decisions(_decisions(spark, d).withColumn("card", F.col("patient"))).select("card", "decision")


@query("review_manifest", f"""WITH {_DECISIONS} SELECT card, '{{"card":' || card || ',"patient":' || patient || ',"fact":"f","decision":"' || decision || '","change":{{"before":"1","after":"' || coalesce(value, '2') || '"}},"at":"2024-01-01"}}' AS json FROM x WHERE decision <> 'maybe'""")
def _(spark, d):
    rows = _decisions(spark, d).select("card", "patient", F.lit("f").alias("fact"), F.nullif("decision", F.lit("maybe")).alias("decision"), F.lit("1").alias("recorded"), F.lit("2").alias("proposed"), F.col("value").alias("corrected"), "at")
    return review.manifest(rows)


@query("highlight_spans", "SELECT doc_id, length(text) - strpos(text, substr(text, 11, 12)) - length(substr(text, 11, 12)) + 1 AS after, strpos(text, substr(text, 11, 12)) - 1 AS before FROM documents")
def _(spark, d):
    x = _read(spark, d, "documents").select("doc_id", review.highlight(F.col("text"), F.substring("text", 11, 12)).alias("h"))
    return x.select("doc_id", F.length("h.after").alias("after"), F.length("h.before").alias("before"))


@query("structured_values", "SELECT o_orderkey AS card, CASE WHEN o_custkey % 2 = 0 THEN c_mktsegment END AS structured FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark, d):
    known = _read(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("patient"), F.lit("segment").alias("fact"), F.col("c_mktsegment").alias("value"))
    told = _read(spark, d, "orders").select(F.col("o_orderkey").alias("card"), F.col("o_custkey").alias("patient"), F.lit("segment").alias("fact"))
    return review.structured_values(told, known).select("card", "structured")


@query("allowed_values", "SELECT o_orderkey AS card, CASE WHEN o_orderkey % 2 = 0 THEN 'en,de,fr' END AS allowed FROM orders")
def _(spark, d):
    k = F.col("o_orderkey")
    told = _read(spark, d, "orders").select(k.alias("card"), F.when(k % 2 == 0, "lang").when(k % 3 == 0, "chars").otherwise("nothing").alias("fact"))
    return review.allowed_values(told, _CHARS).select("card", F.array_join("allowed", ",").alias("allowed"))


@query("companion_units", "SELECT c_custkey AS patient, 'age' AS fact, CASE c_custkey % 4 WHEN 1 THEN 'empty unit' ELSE 'unit not equivalent' END AS detail FROM customer WHERE c_custkey % 4 IN (1, 2) UNION ALL SELECT c_custkey, 'bmi', 'unit not expected' FROM customer WHERE c_custkey % 4 = 3")
def _(spark, d):
    k = F.col("c_custkey") % 4
    fact = F.when(k == 3, "bmi_unit").otherwise("age_unit")
    unit = F.when(k == 0, '"years"').when(k == 1, '" "').when(k == 2, '"months"').otherwise('"kg"')
    long = _read(spark, d, "customer").select(F.col("c_custkey").alias("patient"), fact.alias("fact"), F.parse_json(unit).alias("value"))
    return lint.companion_units(long, _SMALL).select("patient", "fact", "detail")
