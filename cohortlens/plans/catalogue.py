"""Queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions import facts as FN
from cohortlens.functions.conditions import Facts, condition_column, tri
from cohortlens.model import All, AnyOf, Codes, FactDecl, FactModel, Leaf, Not
from cohortlens.operators import classify, cohort, diff, evaluate, ground, ingest, lint, quotes, review, sensitivity
from cohortlens.operators.classify import TOKEN as term_token
from cohortlens.operators.term_table import ANCHORS, BLOCKERS, CONDITION_ENDINGS, NUMBER_WORDS, TIME_WORDS
from cohortlens.plans import sql_parts as S
from cohortlens.plans.cohort_tables import MODEL, V1, V2, facts_wide

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.evaluate(facts_wide(spark, sf_dir), V1, MODEL)


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.both_versions(facts_wide(spark, sf_dir), V1, V2, MODEL)


def _tri_columns(spark: SparkSession, sf_dir: str, named: dict) -> DataFrame:
    f = facts_wide(spark, sf_dir)
    known = Facts(f.columns, MODEL)
    return f.select("patient", *[tri(condition_column(c, known)).alias(n) for n, c in named.items()])


def _tri_sql(named: dict[str, str]) -> str:
    cols = ", ".join(f"CASE WHEN {c} IS NULL THEN 'unknown' WHEN {c} THEN 'true' ELSE 'false' END AS {n}" for n, c in named.items())
    return f"WITH {S.FACTS} SELECT patient, {cols} FROM f"


# --- the condition language --------------------------------------------------------------------------

_OPS = {"eq": "=", "neq": "<>", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}


@query("leaf_numeric_ops", _tri_sql({f"n_{k}": f"recent_orders {v} 3" for k, v in _OPS.items()}))
def _(spark, d):
    return _tri_columns(spark, d, {f"n_{k}": Leaf("recent_orders", k, 3) for k in _OPS})


@query("leaf_enum_bool", _tri_sql({"seg_eq": "segment = 'BUILDING'", "seg_neq": "segment <> 'BUILDING'", "vip_eq": "vip = TRUE", "vip_neq": "vip <> TRUE", "region_eq": "region = 'ASIA'"}))
def _(spark, d):
    return _tri_columns(spark, d, {"seg_eq": Leaf("segment", "eq", "BUILDING"), "seg_neq": Leaf("segment", "neq", "BUILDING"), "vip_eq": Leaf("vip", "eq", True), "vip_neq": Leaf("vip", "neq", True), "region_eq": Leaf("region", "eq", "ASIA")})


_LOW = Codes("priority", ("4-NOT SPECIFIED", "5-LOW"))


@query("leaf_in_notin", _tri_sql({"low_in": S.listed("n_low"), "low_not": f"(NOT {S.listed('n_low')})", "other_system": "CASE WHEN n_orders IS NOT NULL THEN FALSE END"}))
def _(spark, d):
    return _tri_columns(spark, d, {"low_in": Leaf("orders", "in", codes=_LOW), "low_not": Leaf("orders", "notIn", codes=_LOW), "other_system": Leaf("orders", "in", codes=Codes("status", _LOW.values))})


@query("leaf_exists", _tri_sql({"has_orders": "CASE WHEN n_orders IS NOT NULL THEN TRUE END", "has_recent": "CASE WHEN recent_orders IS NOT NULL THEN TRUE END", "has_undeclared": "NULL::BOOLEAN"}))
def _(spark, d):
    return _tri_columns(spark, d, {"has_orders": Leaf("orders", "exists"), "has_recent": Leaf("recent_orders", "exists"), "has_undeclared": Leaf("income", "exists")})


def _urgent(days: int) -> Leaf:
    return Leaf("orders", "anyWithin", codes=Codes("priority", ("1-URGENT",)), window_days=days)


@query("leaf_any_within", _tri_sql({f"within_{n}": S.within(n) for n in (30, 90, 365)}))
def _(spark, d):
    return _tri_columns(spark, d, {f"within_{n}": _urgent(n) for n in (30, 90, 365)})


@query("leaf_any_within_zero", _tri_sql({"within_0": S.within(0), "within_1": S.within(1)}))
def _(spark, d):
    return _tri_columns(spark, d, {"within_0": _urgent(0), "within_1": _urgent(1)})


_A, _B, _C = Leaf("acct_balance", "gt", 5000), Leaf("recent_orders", "gte", 3), _urgent(90)
_SA, _SB, _SC = "acct_balance > 5000", "recent_orders >= 3", S.within(90)


@query("kleene_all_any_not", _tri_sql({"k_all": f"({_SA} AND {_SB} AND {_SC})", "k_any": f"({_SA} OR {_SB} OR {_SC})", "k_not": f"(NOT {_SC})", "k_nested": f"(({_SA} OR {_SB}) AND NOT ({_SC} AND {_SA}))"}))
def _(spark, d):
    return _tri_columns(spark, d, {"k_all": All((_A, _B, _C)), "k_any": AnyOf((_A, _B, _C)), "k_not": Not(_C), "k_nested": All((AnyOf((_A, _B)), Not(All((_C, _A)))))})


@query("kleene_demorgan", _tri_sql({"left_side": f"(NOT ({_SB} AND {_SC}))", "right_side": f"((NOT {_SB}) OR (NOT {_SC}))"}))
def _(spark, d):
    return _tri_columns(spark, d, {"left_side": Not(All((_B, _C))), "right_side": AnyOf((Not(_B), Not(_C)))})


@query("wrong_type_is_unknown", _tri_sql({"text_op_on_number": "NULL::BOOLEAN", "number_op_on_text": "NULL::BOOLEAN"}))
def _(spark, d):
    return _tri_columns(spark, d, {"text_op_on_number": Leaf("acct_balance", "eq", "1"), "number_op_on_text": Leaf("segment", "gt", 1)})


# --- evaluation and cohort reports -------------------------------------------------------------------


@query("criterion_verdicts_long", S.with_v1("SELECT patient, ord, id, kind, unmodeled, verdict FROM v"))
def _(spark, d):
    return evaluate.long_results(_ev(spark, d))


@query("overall_counts", S.with_v1(S.zero_filled(("eligible", "ineligible", "undetermined"), "overall", "v_o", "overall")))
def _(spark, d):
    return cohort.overall_counts(_ev(spark, d))


@query("patient_overall", S.with_v1("SELECT patient, overall, n_fail::BIGINT AS n_fail FROM v_o"))
def _(spark, d):
    return _ev(spark, d).select("patient", "overall", F.size(F.filter("results", lambda r: r["verdict"] == "fail")).cast("long").alias("n_fail"))


@query("band_counts", S.with_v1(", b AS (SELECT CASE overall WHEN 'eligible' THEN 'potentially-eligible' WHEN 'ineligible' THEN 'screen-fail' ELSE 'not-evaluable' END AS band FROM v_o) " + S.zero_filled(evaluate.BANDS, "band", "b", "band")))
def _(spark, d):
    return cohort.band_counts(_ev(spark, d))


@query("display_band_counts", S.with_v1(S.zero_filled(evaluate.DISPLAY_BANDS, "band", "v_o", "display_band")))
def _(spark, d):
    return cohort.display_band_counts(_ev(spark, d))


@query("attrition_rows", S.with_v1(f"""
SELECT c.ord, c.id, count(*) FILTER (WHERE x.verdict = 'fail' AND o2.first_ord = c.ord) AS removed_sequential, count(*) FILTER (WHERE x.verdict = 'fail') AS fails_alone,
       count(*) FILTER (WHERE x.verdict = 'fail' AND n_fail = 1 AND n_open + n_parked = 0) AS sole_reason,
       count(*) FILTER (WHERE x.verdict = 'fail' AND n_fail = 1 AND n_open = 0 AND NOT x.unmodeled) AS sole_modeled_reason
FROM {S.criteria_values(S.V1)} LEFT JOIN v AS x ON x.ord = c.ord LEFT JOIN v_o AS o2 ON o2.patient = x.patient GROUP BY c.ord, c.id"""))
def _(spark, d):
    return cohort.attrition(_ev(spark, d), V1)


@query("sole_disqualifiers", S.with_v1("SELECT id, x.patient AS patient FROM v AS x JOIN v_o USING (patient) WHERE verdict = 'fail' AND n_fail = 1 AND n_open = 0 AND NOT unmodeled"))
def _(spark, d):
    """Over the modeled criteria: one that is not modeled is unknown for everybody and leaves no sole reason."""
    modeled = replace(V1, criteria=tuple(c for c in V1.criteria if not c.unmodeled))
    return cohort.sole_disqualifiers(evaluate.evaluate(facts_wide(spark, d), modeled, MODEL))


@query("sole_disqualifiers_listed", S.with_v1("SELECT id, count(*) AS n, array_to_string((list(x.patient ORDER BY x.patient))[1:3], ',') AS patients FROM v AS x JOIN v_o USING (patient) WHERE verdict = 'fail' AND n_fail = 1 AND n_open = 0 AND NOT unmodeled GROUP BY id"))
def _(spark, d):
    out = cohort.listed(cohort.sole_disqualifiers(_ev(spark, d), modeled=True), ["id"], 3)
    return out.withColumn("patients", F.array_join(F.col("patients").cast("array<string>"), ","))


@query("sole_modeled_reason", S.with_v1("SELECT id, x.patient AS patient FROM v AS x JOIN v_o USING (patient) WHERE verdict = 'fail' AND n_fail = 1 AND n_open = 0 AND NOT unmodeled"))
def _(spark, d):
    return cohort.sole_disqualifiers(_ev(spark, d), modeled=True)


@query("funnel_rows", S.with_v1(f"""
SELECT c.ord, c.id, count(a.patient) AS entering, count(*) FILTER (WHERE verdict = 'pass') AS passed, count(*) FILTER (WHERE verdict = 'fail') AS failed,
       count(*) FILTER (WHERE verdict = 'unknown' AND NOT unmodeled) AS unknown, count(*) FILTER (WHERE verdict = 'unknown' AND unmodeled) AS chart_review
FROM {S.criteria_values(S.V1)} LEFT JOIN (SELECT x.* FROM v AS x JOIN v_o USING (patient) WHERE first_ord IS NULL OR ord <= first_ord) AS a ON a.ord = c.ord GROUP BY c.ord, c.id"""))
def _(spark, d):
    return cohort.funnel(_ev(spark, d), V1)


@query("funnel_drilldown", S.with_v1("""
SELECT id, CASE WHEN verdict = 'unknown' AND unmodeled THEN 'chart_review' ELSE verdict END AS bucket, patient
FROM (SELECT x.* FROM v AS x JOIN v_o USING (patient) WHERE first_ord IS NULL OR ord <= first_ord)"""))
def _(spark, d):
    return cohort.funnel_drilldown(_ev(spark, d))


@query("chart_review_overlay", S.with_v1("""
, u AS (SELECT x.patient, CASE WHEN x.id = 'chart-note' AND segment = 'BUILDING' THEN 'pass' WHEN x.id = 'chart-note' AND segment = 'MACHINERY' THEN 'fail' ELSE verdict END AS verdict FROM v AS x JOIN f USING (patient)),
p AS (SELECT patient, CASE WHEN bool_or(verdict = 'fail') THEN 'ineligible' WHEN bool_or(verdict = 'unknown') THEN 'undetermined' ELSE 'eligible' END AS overall FROM u GROUP BY patient)
SELECT overall, count(*) AS n FROM p GROUP BY overall"""))
def _(spark, d):
    f = facts_wide(spark, d)
    ev = evaluate.with_results(f, V1, MODEL).select("patient", "results", "segment")
    return evaluate.chart_review(ev, {"chart-note": ("segment", {"BUILDING": "pass", "MACHINERY": "fail"})}).groupBy("overall").agg(F.count(F.lit(1)).alias("n"))


@query("suite_coverage", S.with_v1(f"""
, n AS (SELECT c.ord, c.id, count(*) FILTER (WHERE verdict = 'pass') AS n_pass, count(*) FILTER (WHERE verdict = 'fail') AS n_fail, count(*) FILTER (WHERE verdict = 'unknown') AS n_unknown
FROM {S.criteria_values(S.V1)} LEFT JOIN v AS x ON x.ord = c.ord GROUP BY c.ord, c.id)
SELECT *, concat_ws('; ', CASE WHEN id <> 'chart-note' AND n_pass = 0 THEN 'never passes' END, CASE WHEN id <> 'chart-note' AND n_fail = 0 THEN 'never fails' END) AS gap FROM n"""))
def _(spark, d):
    return cohort.coverage(_ev(spark, d), V1)


@query("dead_rules", S.with_v1("""
SELECT ord, id, CASE WHEN count(*) FILTER (WHERE verdict = 'pass') = 0 THEN 'always unknown' ELSE 'never fails' END AS reason
FROM v WHERE NOT unmodeled GROUP BY ord, id HAVING count(*) FILTER (WHERE verdict = 'fail') = 0"""))
def _(spark, d):
    return cohort.dead_rules(_ev(spark, d), V1)


@query("suite_mismatches", S.with_v1("SELECT patient, 'overall' AS id, 'undetermined' AS expected, overall AS got FROM v_o WHERE overall <> 'undetermined'"))
def _(spark, d):
    ev = _ev(spark, d)
    expect = ev.select("patient", F.lit("overall").alias("id"), F.lit("undetermined").alias("expected"))
    return cohort.run_suite(ev, expect)


@query("trace_details", f"""WITH {S.FACTS}
SELECT patient, CASE WHEN acct_balance IS NULL THEN 'unknown' WHEN acct_balance >= 0 THEN 'true' ELSE 'false' END AS result, 'leaf' AS kind, '0' AS path FROM f""")
def _(spark, d):
    ev = evaluate.evaluate(facts_wide(spark, d), V1, MODEL, trace=True)
    return ev.select("patient", F.element_at("results", 1)["trace"][0].alias("t")).select("patient", "t.result", "t.kind", "t.path")


# --- comparison of versions --------------------------------------------------------------------------

_ALIGNED = """
al AS (
  SELECT coalesce(x.patient, y.patient) AS patient, coalesce(y.id, x.id) AS id, coalesce(y.ord, 1000 + x.ord) AS k, coalesce(x.verdict, 'pass') AS va, coalesce(y.verdict, 'pass') AS vb
  FROM (SELECT patient, ord, CASE id WHEN 'urgent-window' THEN 'urgent-recent' ELSE id END AS id, verdict FROM v) AS x
  FULL OUTER JOIN w AS y ON x.patient = y.patient AND x.id = y.id),
fl AS (
  SELECT a.patient, a.overall AS from_overall, b.overall AS to_overall FROM v_o AS a JOIN w_o AS b USING (patient) WHERE a.overall <> b.overall),
fr AS (
  SELECT fl.patient, from_overall, to_overall, string_agg(id, ',' ORDER BY CASE WHEN (va = 'fail') <> (vb = 'fail') THEN 0 ELSE 1 END, k) AS responsible, arg_min(id, k) AS primary_id
  FROM fl JOIN al ON al.patient = fl.patient AND va <> vb GROUP BY ALL)"""


@query("behavioral_flips", S.with_both(f", {_ALIGNED} SELECT patient, from_overall, to_overall FROM fl"))
def _(spark, d):
    return diff.behavioral_flips(_both(spark, d), V1, V2).select("patient", "from_overall", "to_overall")


@query("flip_attribution", S.with_both(f", {_ALIGNED} SELECT patient, responsible, primary_id FROM fr"))
def _(spark, d):
    return diff.behavioral_flips(_both(spark, d), V1, V2).select("patient", F.array_join("responsible", ",").alias("responsible"), F.col("primary").alias("primary_id"))


@query("flip_groups", S.with_both(f", {_ALIGNED} SELECT primary_id, count(*) AS n FROM fr GROUP BY primary_id"))
def _(spark, d):
    return diff.flip_groups(diff.behavioral_flips(_both(spark, d), V1, V2)).withColumnRenamed("primary", "primary_id")


@query("amendment_band_impact", S.with_both(f""", {_ALIGNED}
SELECT a.patient, a.display_band AS from_band, b.display_band AS to_band,
       coalesce((SELECT string_agg(id, ',' ORDER BY k) FROM al WHERE al.patient = a.patient AND k < 1000 AND va <> vb), '') AS responsible
FROM v_o AS a JOIN w_o AS b USING (patient) WHERE a.display_band <> b.display_band"""))
def _(spark, d):
    return diff.amendment_impact(_both(spark, d), V1, V2).select("patient", "from_band", "to_band", F.array_join("responsible", ",").alias("responsible"))


@query("enrolled_impact", S.with_both("""
SELECT a.patient, (SELECT string_agg(y.id, ',' ORDER BY y.ord) FROM w AS y WHERE y.patient = a.patient AND y.verdict = 'fail'
                   AND y.id NOT IN (SELECT x.id FROM v AS x WHERE x.patient = a.patient AND x.verdict = 'fail')) AS reasons
FROM v_o AS a JOIN w_o AS b USING (patient) JOIN f USING (patient) WHERE vip AND a.overall <> 'ineligible' AND b.overall = 'ineligible'"""))
def _(spark, d):
    enrolled = facts_wide(spark, d).where("vip").select("patient")
    return diff.enrolled_impact(_both(spark, d), enrolled).select("patient", F.array_join("reasons", ",").alias("reasons"))


# --- sensitivity ---------------------------------------------------------------------------------------


def _fails_with(ord_: int, cond: str) -> str:
    """Patients that fail with one criterion's condition replaced."""
    parts = [S.verdict(k, cond if i == ord_ else c) for i, (_, k, c) in enumerate(S.V1)]
    return "(SELECT count(*) FROM f WHERE " + " OR ".join(f"{p} = 'fail'" for p in parts) + ")"


_KNOBS = ((0, "balance-min:value", 0.0, -5.0, "acct_balance >= -5"), (1, "recent-activity:value", 1.0, -4.0, "recent_orders >= -4"), (3, "urgent-window:windowDays", 90.0, 45.0, S.within(45)), (4, "filled-max:value", 200000.0, 200005.0, "avg_filled_value > 200005"))


@query("sensitivity_yields", f"WITH {S.FACTS} " + " UNION ALL ".join(f"SELECT {i} AS knob_ord, '{n}' AS knob, {v}::DOUBLE AS value, {x}::DOUBLE AS relaxed, {_fails_with(o, S.V1[o][2])} - {_fails_with(o, c)} AS delta" for i, (o, n, v, x, c) in enumerate(_KNOBS)))
def _(spark, d):
    return sensitivity.yields(facts_wide(spark, d), V1, MODEL)


_PREVIEW = (30.0, 60.0, 120.0)


def _band_with(days: float) -> str:
    parts = [S.verdict(k, S.within(int(days)) if i == 3 else c) for i, (_, k, c) in enumerate(S.V1)]
    fail = " OR ".join(f"{p} = 'fail'" for p in parts)
    open_ = " OR ".join(f"{p} = 'unknown'" for p in parts[:5])
    return f"SELECT {days}::DOUBLE AS value, CASE WHEN {fail} THEN 'screen-fail' WHEN {open_} THEN 'not-evaluable' ELSE 'pending-chart-review' END AS band FROM f"


@query("sensitivity_preview", f"WITH {S.FACTS}, p AS ({' UNION ALL '.join(map(_band_with, _PREVIEW))}), g AS (SELECT value, band FROM (VALUES {', '.join(f'({v}::DOUBLE)' for v in _PREVIEW)}) AS a(value), (VALUES {', '.join(repr((b,)).replace(',)', ')') for b in evaluate.DISPLAY_BANDS)}) AS b(band)) SELECT g.value, g.band, count(p.band) AS n FROM g LEFT JOIN p USING (value, band) GROUP BY ALL")
def _(spark, d):
    k = sensitivity.knobs(V1)[2]
    return sensitivity.preview(facts_wide(spark, d), V1, MODEL, k, list(_PREVIEW))


@query("threshold_histogram", f"""WITH {S.FACTS}, x AS (SELECT acct_balance AS x FROM f WHERE acct_balance IS NOT NULL),
g AS (SELECT floor(least(min(x), 0.0) / 1000)::BIGINT AS a, greatest(ceil(greatest(max(x), 0.0) / 1000)::BIGINT, floor(least(min(x), 0.0) / 1000)::BIGINT + 1) AS z FROM x),
b AS (SELECT unnest(range(a, z)) AS bin FROM g),
c AS (SELECT least(floor(x / 1000)::BIGINT, z - 1) AS bin, count(*) AS n FROM x, g GROUP BY 1)
SELECT bin, bin * 1000.0::DOUBLE AS low, (bin + 1) * 1000.0::DOUBLE AS high, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (bin)""")
def _(spark, d):
    return sensitivity.histogram(facts_wide(spark, d), "acct_balance", 1000.0, (0.0,))


@query("knob_values", f"WITH {S.FACTS} SELECT patient, avg_filled_value AS x, CASE WHEN avg_filled_value IS NULL THEN 'not recorded' END AS note FROM f")
def _(spark, d):
    return sensitivity.knob_values(facts_wide(spark, d), MODEL, sensitivity.knobs(V1)[3])


@query("knob_values_window", f"""WITH {S.FACTS}
SELECT c_custkey AS patient, CASE WHEN c_custkey % 10 <> 0 AND o_orderstatus <> 'P' THEN date_diff('day', o_orderdate::DATE, DATE '2001-08-02')::DOUBLE END AS x,
       CASE WHEN c_custkey % 10 = 0 THEN 'not recorded' WHEN o_orderstatus = 'P' THEN 'no date' END AS note
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND c_custkey % 10 > 1 WHERE c_custkey % 10 = 0 OR o_orderkey IS NOT NULL""")
def _(spark, d):
    return sensitivity.knob_values(facts_wide(spark, d), MODEL, sensitivity.knobs(V1)[2])


# --- checks of cohorts ----------------------------------------------------------------------------------


@query("lint_cohort_types", """SELECT user_id AS patient, event_type AS fact, 'invalid-patient-fact' AS code, count(*) AS n FROM events WHERE event_type IN ('click', 'purchase') AND event_id % 3 = 0 GROUP BY ALL""")
def _(spark, d):
    """Event values as facts: every third value of two kinds is text where the model declares numbers."""
    e = _read(spark, d, "events")
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('"'), F.col("value").cast("string"), F.lit('"'))).otherwise(F.col("value").cast("string"))
    long = e.select(F.col("user_id").alias("patient"), F.col("event_type").alias("fact"), F.parse_json(raw).alias("value"))
    model = FactModel("events/v1", {"click": FactDecl("number"), "purchase": FactDecl("number")})
    return lint.lint_facts(long, model).groupBy("patient", "fact", "code").agg(F.count(F.lit(1)).alias("n"))


@query("lint_duplicate_ids", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INTEGER AS occurrence FROM events QUALIFY occurrence > 1")
def _(spark, d):
    return lint.duplicate_ids(_read(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id")


_UNITS = ("mg/dL", "MG/DL", "percent", "kg", "", "K/uL")
_WANTED = ("mg/dL", "mg/dL", "%", "cm", "kg", "10*3/uL")


def _pick_sql(items: tuple, by: str) -> str:
    return f"CASE {by} % {len(items)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(items)) + " END"


@query("lint_unit_alias", f"""SELECT c_custkey AS patient, 'lab' AS fact, 'invalid-patient-unit' AS code, CASE WHEN c_custkey % 6 = 4 THEN 'empty unit' ELSE 'unit not equivalent' END AS detail FROM customer WHERE c_custkey % 6 IN (3, 4)""")
def _(spark, d):
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("c_custkey") % len(xs) + 1).cast("int"))
    units = _read(spark, d, "customer").select(F.col("c_custkey").alias("patient"), F.lit("lab").alias("fact"), pick(_UNITS).alias("unit"), pick(_WANTED).alias("declared"))
    return lint.lint_units(units)


@query("non_numeric_facts", "SELECT 'click' AS fact, count(*) AS n FROM events WHERE event_type = 'click' AND event_id % 3 = 0 HAVING count(*) > 0")
def _(spark, d):
    e = _read(spark, d, "events")
    raw = F.when(F.col("event_id") % 3 == 0, F.lit('"hemolyzed"')).otherwise(F.col("value").cast("string"))
    long = e.select(F.col("user_id").alias("patient"), F.col("event_type").alias("fact"), F.parse_json(raw).alias("value"))
    from cohortlens.model import Criterion, RuleSet

    return lint.non_numeric(long, RuleSet("r", "1.0.0", "m", (Criterion("c", "inclusion", "x", Leaf("click", "gt", 1)),)))


@query("facts_recency", """WITH e AS (SELECT o_orderkey AS entry, CASE WHEN o_orderkey % 11 = 0 THEN '2001-02-30' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS measured_at FROM orders)
SELECT entry, date_diff('day', try_cast(measured_at AS DATE), DATE '2001-07-01')::INTEGER AS age_days,
  CASE WHEN try_cast(measured_at AS DATE) IS NULL THEN 'not-datable' WHEN date_diff('day', try_cast(measured_at AS DATE), DATE '2001-07-01') < 0 THEN 'measured-after' ELSE 'stale' END AS finding
FROM e WHERE try_cast(measured_at AS DATE) IS NULL OR date_diff('day', try_cast(measured_at AS DATE), DATE '2001-07-01') NOT BETWEEN 0 AND 90""")
def _(spark, d):
    o = _read(spark, d, "orders")
    e = o.select(F.col("o_orderkey").alias("entry"), F.when(F.col("o_orderkey") % 11 == 0, "2001-02-30").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("measured_at"), F.lit(90).alias("valid_within_days"))
    return lint.recency(e, F.lit("2001-07-01").cast("date")).select("entry", "age_days", "finding")


# --- ingestion -----------------------------------------------------------------------------------------

_CODES = ("38483-4", "CREAT-S", "4548-4", "A1C", "29463-7", "LOCAL-UNMAPPED-9", "33914-3")
_LABUNITS = ("mg/dL", "umol/L", "%", "percent", "lb", "", "mL/min", "furlong")


def _labs(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "events")
    pick = lambda xs, by: F.element_at(F.array(*map(F.lit, xs)), (by % len(xs) + 1).cast("int"))
    value = F.when(F.col("event_id") % 13 == 0, F.lit(">60")).otherwise((F.col("event_id") % 1000).cast("string"))
    return e.select("event_id", pick(_CODES, F.col("event_id")).alias("code"), F.lit("lab").alias("base"), value.alias("value_text"), F.nullif(pick(_LABUNITS, F.floor(F.col("event_id") / 7)), F.lit("")).alias("unit"))


_NORM = f"""WITH d(code, loinc, slug, want) AS (VALUES ('38483-4', '38483-4', 'creatinine', 'mg/dL'), ('CREAT-S', '38483-4', 'creatinine', 'mg/dL'), ('4548-4', '4548-4', 'hba1c', '%'), ('A1C', '4548-4', 'hba1c', '%'), ('29463-7', '29463-7', 'weight', 'kg'), ('33914-3', '33914-3', 'egfr', 'mL/min/{{1.73_m2}}')),
e AS (SELECT event_id, {_pick_sql(_CODES, 'event_id')} AS code, CASE WHEN event_id % 13 = 0 THEN '>60' ELSE (event_id % 1000)::VARCHAR END AS value_text, nullif({_pick_sql(_LABUNITS, '(event_id // 7)')}, '') AS unit FROM events),
j AS (SELECT e.*, coalesce(slug, 'lab') AS slug, want, CASE WHEN slug = 'creatinine' AND unit = 'umol/L' THEN 0.0113123 WHEN slug = 'egfr' AND unit = 'mL/min' THEN 1.0 WHEN slug = 'weight' AND unit = 'lb' THEN 0.45359237 END::DOUBLE AS factor FROM e LEFT JOIN d USING (code)),
s AS (SELECT *, CASE WHEN want IS NULL THEN 'unresolvable-code' WHEN value_text = '>60' THEN 'quarantined-value' WHEN unit = want THEN 'ok' WHEN unit IS NULL THEN 'assumed-unit' WHEN unit = 'percent' AND want = '%' THEN 'unit-alias' WHEN factor IS NOT NULL THEN 'converted' ELSE 'unknown-unit' END AS status FROM j),
n AS (SELECT *, status IN ('unresolvable-code', 'quarantined-value', 'unknown-unit') AS bad FROM s)"""


@query("normalize_labs", _NORM + """ SELECT event_id, slug, status, CASE WHEN NOT bad THEN want END AS unit, CASE WHEN bad THEN concat_ws(' ', value_text, unit) END AS raw,
CASE WHEN bad THEN NULL WHEN status = 'converted' THEN floor(value_text::DOUBLE * factor * 100 + 0.5) / 100 ELSE value_text::DOUBLE END AS value FROM n""")
def _(spark, d):
    return ingest.normalize_labs(_labs(spark, d)).select("event_id", "slug", "status", "unit", "raw", "value")


@query("normalize_log_counts", _NORM + """ SELECT op, count(*) AS n FROM (SELECT 'mapped-code' AS op FROM n WHERE code IN ('CREAT-S', 'A1C') UNION ALL SELECT status FROM n WHERE status <> 'ok') GROUP BY op""")
def _(spark, d):
    out = ingest.normalize_labs(_labs(spark, d))
    return ingest.op_counts(out.select(F.col("event_id").alias("patient"), "log")).select("op", "n")


@query("dedup_codes", """SELECT o_custkey AS patient, o_orderpriority AS code, min(CASE WHEN o_orderstatus <> 'P' THEN date_diff('day', o_orderdate::DATE, DATE '2001-08-02') END)::INTEGER AS days_ago FROM orders GROUP BY ALL""")
def _(spark, d):
    o = _read(spark, d, "orders")
    days = F.when(F.col("o_orderstatus") != "P", F.datediff(F.lit("2001-08-02").cast("date"), F.col("o_orderdate").cast("date")))
    rows = o.select(F.col("o_custkey").alias("patient"), F.lit("priority").alias("system"), F.col("o_orderpriority").alias("code"), days.alias("days_ago"), F.col("o_orderkey").alias("seq"))
    return ingest.dedup_codes(rows, "patient").select("patient", "code", "days_ago")


@query("latest_lab", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) = 1")
def _(spark, d):
    rows = _read(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return ingest.latest(rows, ["user_id", "event_type"], "ts", "event_id").drop("ts")


def _draw_sql(patient: str, *stream: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', '7', {patient}, {', '.join(repr(s) for s in stream)})), 1, 8))::UBIGINT / 4294967296.0)"


_LAB_DRAW = lambda name: _draw_sql("event_id::VARCHAR", "mess:creatinine", name)


@query("mess_ops", f"""WITH u AS (SELECT event_id, {_LAB_DRAW('local-code')} AS c, {_LAB_DRAW('unresolvable')} AS o, {_LAB_DRAW('unit')} AS n, {_LAB_DRAW('stringify')} AS t, {_LAB_DRAW('backdate')} AS d FROM events),
l AS (SELECT event_id, CASE WHEN c < 0.18 THEN CASE WHEN o < 0.12 THEN 'unresolvable-code' ELSE 'local-code' END END AS op FROM u
  UNION ALL SELECT event_id, CASE WHEN n < 0.22 THEN 'drop-unit' WHEN n < 0.22::DOUBLE + 0.10::DOUBLE THEN 'convert-unit' WHEN n < 0.22::DOUBLE + 0.10::DOUBLE + 0.25::DOUBLE THEN 'sloppy-unit' END FROM u
  UNION ALL SELECT event_id, 'stringify' FROM u WHERE t < 0.07 UNION ALL SELECT event_id, 'backdate' FROM u WHERE d < 0.15)
SELECT op, count(*) AS n, count(DISTINCT event_id) AS patients FROM l WHERE op IS NOT NULL GROUP BY op""")
def _(spark, d):
    """Seeded corruption of event values as labs."""
    e = _read(spark, d, "events")
    labs = e.select(F.col("event_id").cast("string").alias("patient"), F.lit("creatinine").alias("slug"), F.lit("38483-4").alias("code"), "value", F.lit("mg/dL").alias("unit"), F.lit(10).alias("days_ago"))
    return ingest.op_counts(ingest.mess(labs, seed=7))


@query("mess_lab_rows", f"""SELECT event_id::VARCHAR AS patient, CASE WHEN {_LAB_DRAW('backdate')} < 0.15 THEN 10 + floor({_LAB_DRAW('days')} * 371)::BIGINT + 30 ELSE 10 END AS days_ago,
  CASE WHEN {_LAB_DRAW('local-code')} < 0.18 THEN CASE WHEN {_LAB_DRAW('unresolvable')} < 0.12 THEN 'LOCAL-UNMAPPED-9' ELSE 'CREAT-S' END ELSE '38483-4' END AS code FROM events""")
def _(spark, d):
    e = _read(spark, d, "events")
    labs = e.select(F.col("event_id").cast("string").alias("patient"), F.lit("creatinine").alias("slug"), F.lit("38483-4").alias("code"), "value", F.lit("mg/dL").alias("unit"), F.lit(10).alias("days_ago"))
    return ingest.mess(labs, seed=7).select("patient", "days_ago", "code")


_MED = lambda *s: _draw_sql("o_custkey::VARCHAR", "mess:medications", *s)


@query("mess_medications", f"""WITH m AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 90 END AS ago, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n,
  CASE WHEN {_MED('duplicate')} < 0.35 THEN floor({_MED('copies')} * 2) + 1 ELSE 0 END AS many FROM orders)
SELECT o_custkey AS patient, o_orderkey AS seq, 0 AS copy, ago AS days_ago FROM m
UNION ALL SELECT o_custkey, o_orderkey, 1, ago + floor({_MED('days', '1')} * 7)::BIGINT FROM m WHERE many >= 1 AND floor({_MED('pick', '1')} * n) = i
UNION ALL SELECT o_custkey, o_orderkey, 2, ago + floor({_MED('days', '2')} * 7)::BIGINT FROM m WHERE many >= 2 AND floor({_MED('pick', '2')} * n) = i""")
def _(spark, d):
    o = _read(spark, d, "orders")
    ago = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 90).cast("long")
    return ingest.mess_medications(o.select(F.col("o_custkey").alias("patient"), F.col("o_orderkey").alias("seq"), ago.alias("days_ago")), seed=7)


_COND = lambda s: _draw_sql("o_custkey::VARCHAR", "mess:conditions", s)


@query("mess_conditions", f"""SELECT o_custkey AS patient, o_orderkey AS seq, CASE WHEN {_COND('backdate')} < 0.15 THEN coalesce(ago, 0) + floor({_COND('days')} * 181)::BIGINT + 20 ELSE ago END AS days_ago
FROM (SELECT *, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 90 END AS ago FROM orders)""")
def _(spark, d):
    o = _read(spark, d, "orders")
    ago = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 90).cast("long")
    return ingest.mess_conditions(o.select(F.col("o_custkey").alias("patient"), F.col("o_orderkey").alias("seq"), ago.alias("days_ago")), seed=7)


@query("flatten_bundles", "SELECT 'SYN-' || lpad(c_custkey::VARCHAR, 8, '0') AS patient, 41 AS age, 'female' AS sex, CASE WHEN count(o_orderkey) > 0 THEN 'hemoglobin' END AS lab_names FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def _(spark, d):
    """Customers and their orders as nested bundles, flattened again."""
    c = _read(spark, d, "customer").select("c_custkey")
    o = _read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    coding = F.array(F.struct(F.lit("http://loinc.org").alias("system"), F.lit("718-7").alias("code"), F.lit(None).cast("string").alias("display")))
    entry = F.to_json(F.struct(F.struct(F.lit("Observation").alias("resourceType"), F.col("o_orderkey").cast("string").alias("id"), F.struct(coding.alias("coding")).alias("code"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("effectiveDateTime"), F.struct(F.col("o_totalprice").alias("value"), F.lit("g/dL").alias("unit")).alias("valueQuantity")).alias("resource")))
    person = F.to_json(F.struct(F.struct(F.lit("Patient").alias("resourceType"), F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("id"), F.lit("1960-02-29").alias("birthDate"), F.lit("female").alias("gender")).alias("resource")))
    docs = c.join(o.groupBy("o_custkey").agg(F.collect_list(entry).alias("es")), F.col("c_custkey") == F.col("o_custkey"), "left")
    text = F.concat(F.lit('{"entry":['), F.concat_ws(",", F.array(person), F.coalesce("es", F.array().cast("array<string>"))), F.lit("]}"))
    bundles = docs.select(F.from_json(text, ingest.BUNDLE).alias("b")).select("b.entry")
    flat = ingest.flatten(bundles, "2001-08-02")
    return flat.select("patient", "age", "sex", F.array_join(F.map_keys("labs"), ",").alias("lab_names"))


# --- grounding and scores --------------------------------------------------------------------------------


@query("ground_quotes", "SELECT item_id, count(*) AS n FROM benchmark JOIN documents ON contains(documents.text, benchmark.text) WHERE length(trim(benchmark.text)) > 0 GROUP BY item_id")
def _(spark, d):
    """Benchmark passages as quotes, sought verbatim in documents, each under its rarest run of words."""
    hits = quotes.quote_hits(_read(spark, d, "benchmark"), _read(spark, d, "documents"), "item_id", "text", "doc_id", "text")
    return hits.groupBy(F.col("id").alias("item_id")).agg(F.count(F.lit(1)).alias("n"))


_GMODEL = FactModel("labels/v1", {"chars": FactDecl("number", "chars"), "lang": FactDecl("enum", values=("en", "de", "fr")), "toxic": FactDecl("boolean")})


def _proposals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = _read(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("patient"), F.col("text").alias("body"), "lang", "n_chars")
    first = F.substring("body", 1, 20)
    quote = F.when(F.col("doc") % 6 == 5, F.lit("no such words in it")).otherwise(first)
    rows = docs.select(
        "doc", F.col("doc").alias("seq"),
        F.when(F.col("doc") % 5 == 0, "size").when(F.col("doc") % 2 == 0, "chars").otherwise("lang").alias("fact"),
        F.when(F.col("doc") % 5 == 0, "1").when(F.col("doc") % 2 == 0, F.when(F.col("doc") % 8 == 0, "about 10").otherwise(F.col("n_chars").cast("string"))).otherwise(F.col("lang")).alias("value"),
        F.when((F.col("doc") % 2 == 0) & (F.col("doc") % 7 != 0), "chars").alias("unit"), F.lit(0.9).alias("confidence"), quote.alias("quote"), F.when(F.col("doc") % 9 == 0, "other").otherwise(F.col("patient")).alias("patient"),
    )
    return rows, docs


@query("ground_reasons", """WITH p AS (SELECT doc_id AS doc, CASE WHEN doc_id % 5 = 0 THEN 'size' WHEN doc_id % 2 = 0 THEN 'chars' ELSE 'lang' END AS fact, lang, text FROM documents),
r AS (
  SELECT doc, 'unknown-fact' AS reason FROM p WHERE fact = 'size'
  UNION ALL SELECT doc, 'missing-source' FROM p WHERE doc % 6 <> 5 AND length(trim(substr(text, 1, 20), ' ')) = 0
  UNION ALL SELECT doc, 'wrong-patient' FROM p WHERE doc % 9 = 0
  UNION ALL SELECT doc, 'quote-not-found' FROM p WHERE doc % 6 = 5
  UNION ALL SELECT doc, 'type-mismatch' FROM p WHERE fact = 'chars' AND doc % 8 = 0
  UNION ALL SELECT doc, 'value-not-allowed' FROM p WHERE fact = 'lang' AND lang NOT IN ('en', 'de', 'fr')
  UNION ALL SELECT doc, 'missing-unit' FROM p WHERE fact = 'chars' AND doc % 7 = 0)
SELECT reason, count(*) AS n FROM r GROUP BY reason""")
def _(spark, d):
    rows, docs = _proposals(spark, d)
    return ground.reason_counts(ground.gate(rows, docs, _GMODEL))


_DENIED = (
    ("No evidence of class IV today", True), ("Not tired. Class IV since May", False), ("not class IV, but later class IV confirmed", False), ("free of iv, never IV", True),
    ("nothing to tell", False), ("knot IV", False),
)


@query("negation_gate", f"SELECT event_id, [{', '.join(str(x).lower() for _, x in _DENIED)}][event_id % {len(_DENIED)} + 1] AS denied FROM events")
def _(spark, d):
    """Quotes that deny what they are cited for, at each place where they name it."""
    quote = F.element_at(F.array(*[F.lit(q) for q, _ in _DENIED]), (F.col("event_id") % len(_DENIED) + 1).cast("int"))
    return _read(spark, d, "events").select("event_id", ground.negation(F.lit("class"), F.lit("enum"), F.lit("IV"), quote).alias("denied"))


_ENTRIES = """e AS (SELECT o_custkey AS patient, 'fact' || (o_orderkey % 4) AS fact, CASE WHEN o_orderkey % 3 = 0 THEN 'pipeline' ELSE 'llm/m' END AS extracted_by,
CASE WHEN o_orderkey % 3 = 0 THEN 'confirmed' WHEN o_orderkey % 5 = 0 THEN 'rejected' WHEN o_orderkey % 2 = 0 THEN 'proposed' ELSE 'confirmed' END AS status, o_orderpriority AS value FROM orders)"""


def _entries(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return _read(spark, d, "orders").select(
        F.col("o_custkey").alias("patient"), F.concat(F.lit("fact"), (k % 4).cast("string")).alias("fact"), F.when(k % 3 == 0, "pipeline").otherwise("llm/m").alias("extracted_by"),
        F.when(k % 3 == 0, "confirmed").when(k % 5 == 0, "rejected").when(k % 2 == 0, "proposed").otherwise("confirmed").alias("status"), F.col("o_orderpriority").alias("value"),
    )


@query("confirmed_compile", f"WITH {_ENTRIES} SELECT patient, fact, min(value) AS value, min(value) <> max(value) AS clash FROM e WHERE status <> 'rejected' AND (extracted_by = 'pipeline' OR status = 'confirmed') GROUP BY ALL")
def _(spark, d):
    return ground.confirmed_facts(_entries(spark, d))


@query("pending_review", f"WITH {_ENTRIES} SELECT patient, count(*) AS n, string_agg(fact, ',' ORDER BY fact) AS facts FROM e WHERE status = 'proposed' GROUP BY patient")
def _(spark, d):
    return ground.pending_review(_entries(spark, d))


_SCORED = "s AS (SELECT doc_id, source, least(0.999, n_chars / 8000.0) AS confidence, quality, toxic FROM documents JOIN labels USING (doc_id))"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    j = _read(spark, d, "documents").select("doc_id", "source", "n_chars").join(_read(spark, d, "labels"), "doc_id")
    return j.select("doc_id", "source", F.least(F.lit(0.999), F.col("n_chars") / 8000.0).alias("confidence"), "quality", "toxic")


@query("score_prf", f"""WITH {_SCORED}, m AS (SELECT source, CASE WHEN confidence >= 0.25 AND quality = 1 THEN 'tp' WHEN confidence >= 0.25 THEN 'fp' WHEN quality = 1 THEN 'fn' END AS outcome FROM s),
c AS (SELECT source, count(*) FILTER (WHERE outcome = 'tp') AS tp, count(*) FILTER (WHERE outcome = 'fp') AS fp, count(*) FILTER (WHERE outcome = 'fn') AS fn FROM m WHERE outcome IS NOT NULL GROUP BY source)
SELECT source, tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS "precision", round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall FROM c""")
def _(spark, d):
    s = _scored(spark, d)
    hit, good = F.col("confidence") >= 0.25, F.col("quality") == 1
    m = s.select("source", F.when(hit & good, "tp").when(hit, "fp").when(good, "fn").alias("outcome")).where("outcome is not null")
    return ground.precision_recall(m, "source").select("source", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("score_calibration", f"""WITH {_SCORED}, b AS (SELECT least(floor(confidence * 5), 4)::INTEGER AS bucket, count(*) AS n, avg(confidence) AS c, avg(quality) AS a FROM s GROUP BY 1)
SELECT g.bucket, coalesce(n, 0) AS n, round(c, 6) AS mean_confidence, round(a, 6) AS accuracy FROM (SELECT unnest(range(5))::INTEGER AS bucket) AS g LEFT JOIN b USING (bucket)""")
def _(spark, d):
    b = ground.calibration(_scored(spark, d).select("confidence", (F.col("quality") == 1).alias("correct")))
    return b.select("bucket", "n", F.round("mean_confidence", 6).alias("mean_confidence"), F.round("accuracy", 6).alias("accuracy"))


@query("score_ece", f"""WITH {_SCORED}, b AS (SELECT least(floor(confidence * 5), 4) AS bucket, count(*) AS n, abs(avg(confidence) - avg(quality)) AS gap FROM s GROUP BY 1) SELECT round(sum(n * gap) / sum(n), 6) AS ece FROM b""")
def _(spark, d):
    b = ground.calibration(_scored(spark, d).select("confidence", (F.col("quality") == 1).alias("correct")))
    return ground.expected_calibration_error(b).select(F.round("ece", 6).alias("ece"))


@query("score_latency", "SELECT count(value) AS n, round(avg(value), 4) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events")
def _(spark, d):
    return ground.latency(_read(spark, d, "events"), "value").withColumn("mean", F.round("mean", 4))


@query("overblocked_vs_caught", f"WITH {_SCORED} SELECT CASE WHEN quality = 1 THEN 'over-blocked' ELSE 'caught' END AS judgement, count(*) AS n FROM s WHERE confidence < 0.25 GROUP BY 1")
def _(spark, d):
    s = _scored(spark, d).select(F.col("doc_id").alias("doc"), F.lit("good").alias("fact"), F.lit("true").alias("value"), "confidence", "quality")
    return ground.caught_or_overblocked(s.where("confidence < 0.25").select("doc", "fact", "value"), s.where("quality = 1").select("doc", "fact", "value"))


@query("score_known_gaps", f"""WITH {_SCORED}, c AS (SELECT source AS doc, count(*) FILTER (WHERE confidence >= 0.25 AND quality = 1) AS tp, count(*) FILTER (WHERE confidence >= 0.25 AND quality <> 1) AS fp, count(*) FILTER (WHERE confidence < 0.25 AND quality = 1) AS fn FROM s GROUP BY 1)
SELECT doc, fp <= 1 AND fn <= 12 AS passed, round(CASE WHEN tp + fn + fp = 0 THEN 0 ELSE tp / (tp + fn + fp) END, 6) AS score FROM c""")
def _(spark, d):
    hit, good = F.col("confidence") >= 0.25, F.col("quality") == 1
    n = lambda c, name: F.sum(c.cast("long")).alias(name)
    per = _scored(spark, d).groupBy(F.col("source").alias("doc")).agg(n(hit & good, "tp"), n(hit & ~good, "fp"), n(~hit & good, "fn"))
    gaps = per.select("doc", F.lit(1).alias("allow_fp"), F.lit(12).alias("allow_fn"))
    return ground.within_known_gaps(per, gaps).withColumn("score", F.round("score", 6))


@query("match_expected", """WITH e AS (SELECT o_custkey AS doc, o_orderpriority AS value, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY ALL),
g AS (SELECT o_custkey AS doc, o_orderpriority AS value, count(*) AS n FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY ALL),
j AS (SELECT coalesce(e.n, 0) AS a, coalesce(g.n, 0) AS b FROM e FULL OUTER JOIN g ON e.doc = g.doc AND e.value = g.value)
SELECT sum(least(a, b))::BIGINT AS tp, sum(greatest(b - a, 0))::BIGINT AS fp, sum(greatest(a - b, 0))::BIGINT AS fn FROM j""")
def _(spark, d):
    o = _read(spark, d, "orders").select(F.col("o_custkey").alias("doc"), F.lit("priority").alias("fact"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("seq"))
    return ground.precision_recall(ground.match(o.where("seq % 3 <> 0"), o.where("seq % 4 <> 0"))).select("tp", "fp", "fn")


@query("batch_reconcile", """WITH r AS (SELECT l_orderkey AS custom_id, count(*) AS n, bool_or(l_linestatus = 'F') AS bad FROM lineitem GROUP BY 1), q AS (SELECT o_orderkey AS custom_id FROM orders WHERE o_custkey % 2 = 0)
SELECT coalesce(q.custom_id, r.custom_id) AS custom_id, CASE WHEN n IS NULL THEN 'missing' WHEN q.custom_id IS NULL THEN 'unexpected' WHEN n > 1 THEN 'duplicate' ELSE 'failed' END AS problem
FROM q FULL OUTER JOIN r ON q.custom_id = r.custom_id WHERE n IS NULL OR q.custom_id IS NULL OR n > 1 OR bad""")
def _(spark, d):
    asked = _read(spark, d, "orders").where("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("custom_id"))
    got = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("custom_id"), F.when(F.col("l_linestatus") == "F", "errored").otherwise("succeeded").alias("status"))
    return ground.reconcile(asked, got)


# --- review ----------------------------------------------------------------------------------------------


def _cards(spark: SparkSession, d: str) -> DataFrame:
    """A proposal of the average filled value for every customer, half as much again as recorded (or 180000)."""
    f = facts_wide(spark, d)
    return f.withColumns({"card": F.concat(F.lit("c"), F.col("patient").cast("string")), "proposed": F.coalesce(F.col("avg_filled_value") * 1.5, F.lit(180000.0)), "confidence": (F.col("patient") % 100) / 100.0})


_CARDS = f"""WITH {S.FACTS}, {S.verdicts(tuple((i, k, "NULL::BOOLEAN" if i == "filled-max" else c) for i, k, c in S.V1), "a")},
{S.verdicts(tuple((i, k, "coalesce(avg_filled_value * 1.5, 180000.0) > 200000" if i == "filled-max" else c) for i, k, c in S.V1), "b")},
q AS (SELECT x.patient, 'c' || x.patient AS card, (x.patient % 100) / 100.0::DOUBLE AS confidence, x.display_band AS band_without, y.display_band AS band_with, x.display_band <> y.display_band AS flips FROM a_o AS x JOIN b_o AS y USING (patient))"""


@query("review_impact", _CARDS + " SELECT card, band_without, band_with, flips FROM q")
def _(spark, d):
    return review.impact(_cards(spark, d), V1, MODEL, "avg_filled_value").select("card", "band_without", "band_with", "flips")


@query("review_queue", _CARDS + " SELECT card, flips, confidence, confidence < 0.8 AS unsure FROM q")
def _(spark, d):
    q = review.queue(review.impact(_cards(spark, d), V1, MODEL, "avg_filled_value"))
    return q.select("card", "flips", "confidence", "unsure")


@query("review_progress", "SELECT count(*) AS total, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS pending, count(*) FILTER (WHERE o_orderkey % 3 <> 0) AS decided, count(*) FILTER (WHERE o_orderstatus = 'F') AS relevant, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0) AS relevant_pending, count(DISTINCT o_custkey) AS patients FROM orders")
def _(spark, d):
    cards = _read(spark, d, "orders").select(F.col("o_custkey").alias("patient"), F.when(F.col("o_orderkey") % 3 != 0, "confirmed").alias("decision"), (F.col("o_orderstatus") == "F").alias("relevant"))
    return review.progress(cards)


@query("apply_review", """SELECT c_custkey AS patient, CASE WHEN c_custkey % 3 = 0 THEN 'corrected' WHEN c_custkey % 3 = 1 THEN 'proposed' ELSE c_mktsegment END AS value FROM customer""")
def _(spark, d):
    c = _read(spark, d, "customer")
    base = c.select(F.col("c_custkey").alias("patient"), F.lit("segment").alias("fact"), F.col("c_mktsegment").alias("value"))
    proposals = base.select(F.concat(F.lit("c"), F.col("patient").cast("string")).alias("card"), "patient", "fact", F.lit("proposed").alias("value"))
    decisions = proposals.select("card", F.when(F.col("patient") % 3 == 2, "rejected").otherwise("confirmed").alias("decision"), F.when(F.col("patient") % 3 == 0, "corrected").alias("value"))
    return review.apply_review(base, proposals, decisions).select("patient", "value")


@query("parse_edits", """SELECT c_custkey AS patient, CASE c_custkey % 4 WHEN 0 THEN '12.5' WHEN 1 THEN NULL WHEN 2 THEN 'true' ELSE c_mktsegment END AS edited FROM customer""")
def _(spark, d):
    k = F.col("c_custkey") % 4
    text = F.when(k == 0, " 12.5 ").when(k == 1, "about 12").when(k == 2, "Yes").otherwise(F.col("c_mktsegment"))
    kind = F.when(k <= 1, "number").when(k == 2, "boolean").otherwise("string")
    return _read(spark, d, "customer").select(F.col("c_custkey").alias("patient"), review.parse_edit(text, kind).alias("edited"))


# --- criterion lines -----------------------------------------------------------------------------------------

#: Parts of criterion lines; the lines are put together from the numbers of each event.
_LEAD = ("", "Documented", "No evidence of", "In the clinician's opinion,", "History of", "Unless treated, any", "Planned", "Patients with")
_SUBJECT = ("hemoglobin", "chronic kidney disease", "arthritis", "a stable dose of warfarin", "walks in the rain", "informed consent", "BMI", "prior stroke", "women", "pancreatitis or metastases", "creatinine clearance")
_COMPARED = (" > {}", " at least {} mg/dL", " within the last {} months", "", " of {} %", " less than or equal to {}", " (including but not limited to {} others)", " ≥{},5 x 10^9/L", " for {} days prior", " expected to last {} weeks")


_LEAD_AT, _SUBJECT_AT, _COMPARED_AT = "event_id % 8", "user_id % 11", "(event_id + user_id) % 10"


def _item(values: tuple[str, ...], index: str) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.expr(f"cast({index} as int)"))


def _item_sql(values: tuple[str, ...], index: str) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{quoted}])[CAST({index} AS INTEGER) + 1]"


_KIND = "CASE WHEN event_id % 3 = 0 THEN 'exclusion' ELSE 'inclusion' END"


def _criteria_lines(spark: SparkSession, d: str) -> DataFrame:
    """(kind, id, line): a criterion line of each event, and every line of every document."""
    number = F.expr("cast(cast(floor(abs(value)) as long) as string)")
    line = F.concat(_item(_LEAD, _LEAD_AT), F.lit(" "), _item(_SUBJECT, _SUBJECT_AT), F.replace(_item(_COMPARED, _COMPARED_AT), F.lit("{}"), F.coalesce(number, F.lit("?"))))
    events = _read(spark, d, "events").select(F.expr(_KIND).alias("kind"), F.col("event_id").alias("id"), line.alias("line"))
    return events.unionByName(_document_lines(spark, d).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "line"))


def _document_lines(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "documents").select("doc_id", F.explode(classify.split_lines(F.col("text"))).alias("line"))


_DOCUMENT_LINES = r"(SELECT doc_id, line FROM (SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS line FROM documents) WHERE length(line) >= 12)"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)


def _class_sql() -> str:
    listed = lambda words: ", ".join(f"'{w}'" for w in words)
    token = term_token.replace("'", "''")
    longest = max(t.count(" ") + 1 for _, t in ANCHORS + BLOCKERS)
    return f"""lex(side, signal, term) AS (VALUES {_values([("a", *r) for r in ANCHORS] + [("b", *r) for r in BLOCKERS])}),
lines AS (SELECT row_number() OVER () AS rid, * FROM (
  SELECT {_KIND} AS kind, event_id AS id, {_item_sql(_LEAD, _LEAD_AT)} || ' ' || {_item_sql(_SUBJECT, _SUBJECT_AT)} || replace({_item_sql(_COMPARED, _COMPARED_AT)}, '{{}}', coalesce(CAST(CAST(floor(abs(value)) AS BIGINT) AS VARCHAR), '?')) AS line FROM events
  UNION ALL SELECT 'document', doc_id, line FROM {_DOCUMENT_LINES})),
tok AS (SELECT rid, regexp_extract_all(line, '{token}') AS raw FROM lines),
two AS (SELECT rid, list_transform(raw, lambda x: CASE WHEN regexp_matches(x, '^[0-9]') OR lower(x) IN ({listed(NUMBER_WORDS)}) THEN '#' WHEN lower(x) IN ({listed(TIME_WORDS)}) THEN '~'
    WHEN x = '≤' THEN '<=' WHEN x = '≥' THEN '>=' ELSE replace(lower(x), '’', chr(39)) END) AS plain, list_transform(raw, lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN '#' ELSE x END) AS cased FROM tok),
pos AS (SELECT rid, plain, cased, unnest(range(1, len(plain) + 1)) AS i FROM two),
run AS (
  SELECT rid, array_to_string(plain[i:i + n - 1], ' ') AS term FROM pos, range(1, {longest + 1}) AS r(n) WHERE i + n - 1 <= len(plain)
  UNION ALL SELECT rid, '$' || array_to_string(cased[i:i + n - 1], ' ') FROM pos, range(1, {longest + 1}) AS r(n) WHERE i + n - 1 <= len(plain)
  UNION ALL SELECT rid, '-' || right(plain[i], k) FROM pos, (VALUES {", ".join(f"({k})" for k in sorted({len(e) for e in CONDITION_ENDINGS}))}) AS e(k) WHERE length(plain[i]) >= k + 3),
found AS (SELECT DISTINCT rid, side, signal FROM run JOIN lex USING (term)),
l AS (SELECT kind, id, line, rid, CASE WHEN NOT EXISTS (SELECT 1 FROM found f WHERE f.rid = lines.rid AND side = 'a') THEN 'unmodeled'
  WHEN EXISTS (SELECT 1 FROM found f WHERE f.rid = lines.rid AND side = 'b') THEN 'partially' ELSE 'expressible' END AS class FROM lines)"""


_CLASSED = _class_sql()


@query("classify_lines", f"WITH {_CLASSED}, s AS (SELECT rid, string_agg(signal, ',' ORDER BY signal) AS signals FROM found GROUP BY rid) SELECT kind, id, md5(line) AS line_md5, class, coalesce(signals, '') AS signals FROM l LEFT JOIN s USING (rid)")
def _(spark, d):
    c = classify.classify(_criteria_lines(spark, d))
    return c.select("kind", "id", F.md5("line").alias("line_md5"), "class", F.array_join(F.array_sort(F.concat("anchors", "blockers")), ",").alias("signals"))


@query("classify_tally", f"""WITH {_CLASSED}, t AS (SELECT kind, class, count(*) AS n FROM l GROUP BY GROUPING SETS ((kind, class), (class)))
SELECT kind, class, n, round(n * 100.0 / sum(n) OVER (PARTITION BY kind), 1)::DOUBLE AS pct FROM t""")
def _(spark, d):
    t = classify.tally(classify.classify(classify.counted(_criteria_lines(spark, d), "kind", "line")), "kind", "times")
    return t.withColumn("pct", F.col("pct").cast("double"))


@query("signal_top5", f"WITH {_CLASSED} SELECT signal, count(*) AS n FROM found WHERE side = 'a' GROUP BY signal ORDER BY n DESC, signal LIMIT 5")
def _(spark, d):
    return classify.top_signals(classify.classify(classify.counted(_criteria_lines(spark, d), "line")), "anchors", times="times")


@query("split_document_lines", f"SELECT doc_id, length(line) AS n_chars FROM {_DOCUMENT_LINES}")
def _(spark, d):
    return _document_lines(spark, d).select("doc_id", F.length("line").cast("long").alias("n_chars"))


# --- manifests and scalar functions ------------------------------------------------------------------------------


@query("hash_manifest", "SELECT doc_id, sha256(text) AS hash FROM documents")
def _(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


@query("scalar_rounding", "SELECT o_orderkey, floor(o_totalprice * 10 + 0.5) / 10 AS rounded FROM orders")
def _(spark, d):
    return _read(spark, d, "orders").select("o_orderkey", FN.round_half_up(F.col("o_totalprice"), 1).alias("rounded"))


@query("scalar_slugify", r"SELECT p_partkey, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS slug FROM part")
def _(spark, d):
    return _read(spark, d, "part").select("p_partkey", FN.slugify(F.col("p_type")).alias("slug"))


@query("scalar_completed_years", "SELECT o_orderkey, (year(DATE '2001-08-02') - year(o_orderdate) - CASE WHEN '0802' < strftime(o_orderdate, '%m%d') THEN 1 ELSE 0 END)::INTEGER AS years FROM orders")
def _(spark, d):
    return _read(spark, d, "orders").select("o_orderkey", FN.completed_years(F.col("o_orderdate"), F.lit("2001-08-02").cast("date")).alias("years"))
