"""The library's commands as functions, and an engine that remembers what it has parsed."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.model import FactModel, RuleSet, facts_read
from cohortlens.operators import cohort, diff, evaluate, ground, lint, report, sensitivity
from cohortlens.operators.prove import Finding
from cohortlens.sources import documents as D
from cohortlens.sources import tables


@lru_cache(32)
def _ruleset(text: str) -> RuleSet:
    return D.parse_ruleset(text)


@lru_cache(32)
def _model(text: str) -> FactModel:
    return D.parse_fact_model(text)


@dataclass
class SuiteResult:
    mismatches: DataFrame
    coverage: DataFrame


class Engine:
    """Rule sets over cohorts.  Everything fails closed: a rule set with errors is not evaluated."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def check(self, ruleset: str, fact_model: str) -> list[Finding]:
        return lint.check_text(ruleset, fact_model)

    def _sound(self, ruleset: str, fact_model: str) -> tuple[RuleSet, FactModel]:
        bad = [f for f in self.check(ruleset, fact_model) if f.level == "error"]
        if bad:
            raise ValueError("blocked: " + report.findings_text(bad))
        return _ruleset(ruleset), _model(fact_model)

    def cohort(self, path: str, fact_model: str, rules: list[RuleSet]) -> tuple[DataFrame, DataFrame]:
        """(typed wide facts that the rules read, findings of the data) of a folder of patients."""
        model = _model(fact_model)
        patients = tables.read_patients(tables.read_files(self.spark, path))
        bad = patients.where("problems is not null").select(F.col("name").alias("patient"), F.lit("document").alias("fact"), F.lit("schema").alias("code"), F.array_join("problems", "; ").alias("detail"))
        good = patients.where("problems is null")
        twice = lint.duplicate_ids(good.select("patient", "name"), "patient", "name").select("patient", F.lit("patient").alias("fact"), F.lit("duplicate-patient").alias("code"), F.col("name").alias("detail"))
        long = tables.facts_long(good)
        findings = bad.unionByName(twice).unionByName(lint.lint_facts(long, model)).unionByName(lint.companion_units(long, model))
        only = list(dict.fromkeys(f for r in rules for f in facts_read(r)))
        return tables.facts_wide(good, model, only), findings

    def evaluate(self, facts: DataFrame, ruleset: str, fact_model: str, trace: bool = False) -> DataFrame:
        rs, model = self._sound(ruleset, fact_model)
        return evaluate.evaluate(facts, rs, model, trace)

    def screen(self, path: str, ruleset: str, fact_model: str, as_of: str, out: str | None = None, partial: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
        """(evaluations, Markdown report) of a folder of patients; data with errors blocks."""
        D.iso_day(as_of)
        rs, model = self._sound(ruleset, fact_model)
        facts, findings = self.cohort(path, fact_model, [rs])
        if not findings.isEmpty():
            raise ValueError("the cohort has errors")
        ev = evaluate.evaluate(facts, rs, model, trace=True)
        if out:  # evaluated once: what follows reads what was written
            ev = report.screen_json(ev, out, self.metadata(ruleset, fact_model, as_of, partial))
        return ev, report.markdown_report(ev, rs, as_of)

    def metadata(self, ruleset: str, fact_model: str, as_of: str, partial: tuple[str, ...] = ()) -> dict:
        rs = _ruleset(ruleset)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        return {
            "ruleset": rs.ruleset, "version": rs.version, "asOf": as_of, "rulesetHash": sha(ruleset), "factModelHash": sha(fact_model),
            "modeling": cohort.modeling_counts(rs, partial), "warnings": [f.code for f in lint.modeling_warnings(rs, partial)],
        }

    def test(self, ruleset: str, fact_model: str, suite: str) -> SuiteResult:
        rs, model = self._sound(ruleset, fact_model)
        cases = D.parse_suite(suite)
        ev = evaluate.evaluate(tables.facts_wide(tables.cases_frame(self.spark, cases), model), rs, model)
        return SuiteResult(cohort.run_suite(ev, tables.expectations_frame(self.spark, cases)), cohort.coverage(ev, rs))

    def compare(self, a: str, b: str, fact_model: str, facts: DataFrame | None = None) -> tuple[diff.Structural, list[tuple[str, str]], DataFrame | None]:
        """(structural changes, findings on the version step, flips over a cohort if there is one)."""
        (ra, model), (rb, _) = self._sound(a, fact_model), self._sound(b, fact_model)
        s = diff.structural_diff(ra, rb)
        flips = diff.behavioral_flips(diff.both_versions(facts, ra, rb, model), ra, rb) if facts is not None else None
        return s, diff.version_findings(ra, rb, s, flips.count() if flips is not None else None), flips

    def yields(self, facts: DataFrame, ruleset: str, fact_model: str) -> DataFrame:
        rs, model = self._sound(ruleset, fact_model)
        return sensitivity.ranked(sensitivity.yields(facts, rs, model))

    def confirmed(self, path: str) -> DataFrame:
        """(patient, fact, value) of stored facts that rules may read; files that can't be read, or two values of one fact, are errors."""
        rows = tables.read_facts_files(tables.read_files(self.spark, path))
        bad = rows.where("problems is not null").select("name").distinct().orderBy("name").limit(10).collect()
        if bad:
            raise ValueError("unreadable facts files: " + ", ".join(r.name for r in bad))
        e = rows.where("entry is not null").select("patient", "entry.fact", F.to_json("entry.value").alias("value"), "entry.status", F.col("entry.extractedBy").alias("extracted_by"))
        return ground.refuse_clashes(ground.confirmed_facts(e)).withColumn("value", F.parse_json("value"))

    def check_facts(self, path: str, notes: DataFrame, fact_model: str, as_of: str) -> DataFrame:
        """(patient, fact, finding) of stored facts that don't stand in their notes, or are stale."""
        model = _model(fact_model)
        rows = tables.read_facts_files(tables.read_files(self.spark, path))
        bad = rows.where("problems is not null").select("patient", F.lit(None).cast("string").alias("fact"), F.explode("problems").alias("finding"))
        e = rows.where("problems is null and entry is not null").select("patient", "place", F.coalesce(F.lit(as_of), "asOf").alias("as_of"), "entry.*")
        told = e.where(F.col("extractedBy") != "pipeline").select(F.col("source.doc").alias("doc"), F.col("place").alias("seq"), "fact", F.expr("try_variant_get(value, '$', 'string')").alias("value"), "unit", "confidence", F.col("source.quote").alias("quote"), "patient", "status")
        failed = ground.reverify(told, notes, model).where("not grounded").select("patient", "fact", F.explode("reasons").alias("finding"))
        stale = lint.recency(e.withColumnsRenamed({"measuredAt": "measured_at", "validWithinDays": "valid_within_days"}), F.to_date("as_of")).select("patient", "fact", "finding")
        return bad.unionByName(failed).unionByName(stale)
