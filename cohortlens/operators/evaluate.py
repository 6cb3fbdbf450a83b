"""Evaluation of a rule set over a cohort: one narrow projection, no shuffle, no UDF.

``eval_wide`` has one row per patient with ``results`` (an array in rule order) and ``overall``.
Wide rule sets are compiled in groups of ``CHUNK`` criteria, so that no projection outgrows codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.conditions import Facts, condition_column, prose, trace_nodes, verdict
from cohortlens.model import Criterion, FactModel, RuleSet

CHUNK = 100
OVERALL = ("eligible", "ineligible", "undetermined")
BANDS = ("potentially-eligible", "screen-fail", "not-evaluable")
DISPLAY_BANDS = ("potentially-eligible", "screen-fail", "not-evaluable", "pending-chart-review")


def criterion_struct(ord_: int, c: Criterion, facts: Facts, trace: bool) -> Column:
    v = F.lit("unknown") if c.unmodeled else verdict(c.kind, condition_column(c.when, facts))
    parts = [F.lit(ord_).alias("ord"), F.lit(c.id).alias("id"), F.lit(c.ref).cast("string").alias("ref"), F.lit(c.kind).alias("kind"), F.lit(c.unmodeled).alias("unmodeled"), v.alias("verdict")]
    if trace:
        empty = F.array().cast("array<struct<path:string,kind:string,result:string,detail:string>>")
        parts.append((empty if c.unmodeled else F.array(*trace_nodes(c.when, facts))).alias("trace"))
        parts.append((F.lit("needs chart review: not modeled") if c.unmodeled else prose(c.when, facts)).alias("prose"))
    return F.struct(*parts)


def overall_of(results: Column) -> Column:
    """Any fail: ineligible; else any unknown: undetermined; else eligible."""
    has = lambda v: F.exists(results, lambda r: r["verdict"] == v)
    return F.when(has("fail"), "ineligible").when(has("unknown"), "undetermined").otherwise("eligible")


def with_results(df: DataFrame, rs: RuleSet, model: FactModel, name: str = "results", trace: bool = False) -> DataFrame:
    """Adds the array of criterion results of a rule set to a typed wide cohort."""
    facts = Facts(df.columns, model)
    structs = [criterion_struct(i, c, facts, trace) for i, c in enumerate(rs.criteria)]
    if len(structs) <= CHUNK:
        return df.withColumn(name, F.array(*structs))
    parts = []
    for k in range(0, len(structs), CHUNK):
        parts.append(f"__{name}_{k}")
        df = df.withColumn(parts[-1], F.array(*structs[k : k + CHUNK]))
    return df.withColumn(name, F.concat(*parts)).drop(*parts)


def evaluate(df: DataFrame, rs: RuleSet, model: FactModel, trace: bool = False) -> DataFrame:
    """(patient, results, overall)."""
    out = with_results(df, rs, model, trace=trace).select("patient", "results")
    return out.withColumn("overall", overall_of(F.col("results")))


def evaluate_checked(df: DataFrame, rs: RuleSet, model: FactModel) -> DataFrame:
    """As :func:`evaluate`, but a rule set with any error is not evaluated."""
    from cohortlens.operators.lint import check

    errors = [f for f in check(rs, model) if f.level == "error"]
    if errors:
        raise ValueError("evaluation blocked: " + "; ".join(f"{f.code}: {f.message}" for f in errors))
    return evaluate(df, rs, model)


def long_results(ev: DataFrame) -> DataFrame:
    """(patient, ord, id, kind, unmodeled, verdict), one row per criterion."""
    return ev.select("patient", F.explode("results").alias("r")).select("patient", "r.ord", "r.id", "r.kind", "r.unmodeled", "r.verdict")


def is_parked(r: Column) -> Column:
    return r["unmodeled"] & (r["verdict"] == "unknown")


def band(overall: Column) -> Column:
    return F.when(overall == "eligible", BANDS[0]).when(overall == "ineligible", BANDS[1]).otherwise(BANDS[2])


def display_band(overall: Column, results: Column) -> Column:
    """Not-evaluable splits: only chart review is missing, or a modeled criterion is unknown too."""
    open_ = F.exists(results, lambda r: (r["verdict"] == "unknown") & ~r["unmodeled"])
    return F.when(overall == "eligible", DISPLAY_BANDS[0]).when(overall == "ineligible", DISPLAY_BANDS[1]).when(open_, DISPLAY_BANDS[2]).otherwise(DISPLAY_BANDS[3])


def status_mark(r: Column) -> Column:
    return F.when(is_parked(r), "cr").when(r["verdict"] == "pass", "elig").when(r["verdict"] == "fail", "fail").otherwise("ne")


def result_prose(r: Column) -> Column:
    """A result in words: chart review, or what was compared, and that an exclusion fired."""
    fired = F.when((r["kind"] == "exclusion") & (r["verdict"] == "fail"), F.lit(" (exclusion fired)")).otherwise(F.lit(""))
    return F.when(is_parked(r), F.lit("needs chart review: not modeled")).otherwise(F.concat(r["prose"], fired))


def chart_review(ev_with_facts: DataFrame, answers: dict[str, tuple[str, dict[str, str]]]) -> DataFrame:
    """Unmodeled criteria resolved by a confirmed string fact: id to (fact column, value to verdict); overall follows."""

    def answer(r: Column) -> Column:
        out = r["verdict"]
        for cid, (fact, verdicts) in answers.items():
            if fact in ev_with_facts.columns:
                for value, v in verdicts.items():
                    out = F.when((r["id"] == cid) & is_parked(r) & (F.col(fact) == value), v).otherwise(out)
        return out

    out = ev_with_facts.withColumn("results", F.transform("results", lambda r: r.withField("verdict", answer(r))))
    return out.withColumn("overall", overall_of(F.col("results")))
