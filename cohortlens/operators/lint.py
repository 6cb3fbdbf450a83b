"""Checks of rule sets against a fact model (driver) and of cohorts against it (distributed filters)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.facts import units_equivalent
from cohortlens.model import FactModel, RuleSet, leaves
from cohortlens.operators.prove import Finding, all_leaves, by_severity, conflicts
from cohortlens.sources.documents import DocumentError, parse_fact_model, parse_ruleset

_WANT = {"numeric": "number", "text": "enum", "boolean": "boolean", "set": "code", "within": "code"}


def lint(rs: RuleSet, model: FactModel) -> list[Finding]:
    out: list[Finding] = []
    err = lambda code, msg, c: out.append(Finding("error", code, msg, (c.id,)))
    if rs.fact_model != model.name:
        out.append(Finding("error", "fact-model-mismatch", f"the rule set names {rs.fact_model}, the model is {model.name}"))
    out += [Finding("info", "unmodeled-criterion", f"{c.id} is carried as text", (c.id,)) for c in rs.criteria if c.unmodeled]
    for c, leaf in all_leaves(rs):
        decl = model.facts.get(leaf.fact)
        if decl is None:
            err("unknown-fact", f"{leaf.fact} is not declared", c)
            continue
        want = _WANT.get(leaf.family)
        if want and decl.type != want:
            err("type-mismatch", f"{leaf.op} on {leaf.fact}, which is {decl.type}", c)
            continue
        if leaf.family == "exists" and decl.type in ("enum", "boolean"):
            err("exists-value-type", f"exists on {leaf.fact}, which is {decl.type}", c)
        if leaf.family == "text" and leaf.value not in decl.values:
            err("unknown-enum-value", f"{leaf.value} is no value of {leaf.fact}", c)
        if leaf.codes and leaf.codes.system not in decl.systems:
            err("unknown-code-system", f"{leaf.codes.system} is no system of {leaf.fact}", c)
        if leaf.family == "numeric":
            if decl.unit is None and leaf.unit is not None:
                err("unit-unexpected", f"{leaf.fact} has no unit", c)
            elif decl.unit is not None and leaf.unit is None:
                err("unit-undeclared", f"{leaf.fact} is in {decl.unit}; the literal names no unit", c)
            elif decl.unit != leaf.unit:
                err("unit-mismatch", f"{leaf.fact} is in {decl.unit}, the literal in {leaf.unit}", c)
    return out


def check(rs: RuleSet, model: FactModel) -> list[Finding]:
    """All findings, errors first."""
    return by_severity(lint(rs, model) + conflicts(rs))


def check_text(ruleset: str, fact_model: str) -> list[Finding]:
    """As :func:`check`, for documents; what can't be parsed is a finding, and what can is still examined."""
    out, rs, model = [], None, None
    try:
        rs = parse_ruleset(ruleset)
    except DocumentError as e:
        out += [Finding("error", "schema", p) for p in e.problems]
    try:
        model = parse_fact_model(fact_model)
    except DocumentError as e:
        out += [Finding("error", "fact-model-schema", p) for p in e.problems]
    if rs:
        out += conflicts(rs) + (lint(rs, model) if model else [])
    return by_severity(out)


def modeling_warnings(rs: RuleSet, partial: tuple[str, ...] = ()) -> list[Finding]:
    out = [Finding("warning", "partial-criteria", "modeled in part only", partial)] if partial else []
    un = tuple(c.id for c in rs.criteria if c.unmodeled)
    return out + ([Finding("warning", "unmodeled-criteria", "need chart review", un)] if un else [])


def numeric_facts(rs: RuleSet) -> list[str]:
    return list(dict.fromkeys(x.fact for c in rs.criteria for x in leaves(c.when) if x.family == "numeric"))


# --- cohorts: rows (patient, fact, value VARIANT) ------------------------------------------------


def value_kind(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return F.when(kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|FLOAT|DOUBLE|DECIMAL)"), "number").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind.startswith("ARRAY"), "list").otherwise("other")


def lint_facts(long: DataFrame, model: FactModel) -> DataFrame:
    """(patient, fact, code, detail) of values that their declaration doesn't allow; undeclared facts are tolerated."""
    rows = [(k, d.type, d.unit, list(d.values), list(d.systems)) for k, d in model.facts.items()]
    decl = F.broadcast(long.sparkSession.createDataFrame(rows, "fact string, type string, unit string, values array<string>, systems array<string>"))
    j = long.join(decl, "fact").withColumn("is", value_kind(F.col("value")))
    text = F.try_variant_get("value", "$", "string")
    number = F.try_variant_get("value", "$", "double")
    entries = F.try_variant_get("value", "$", "array<struct<code:string,system:string,daysAgo:int>>")
    bad_entry = F.exists(entries, lambda e: e.isNull() | e["code"].isNull() | (F.length(e["code"]) == 0) | ~F.coalesce(F.array_contains(F.col("systems"), e["system"]), F.lit(False)) | F.coalesce(e["daysAgo"] < 0, F.lit(False)))
    detail = (
        F.when((F.col("type") == "number") & ((F.col("is") != "number") | F.isnan(number)), "not a finite number")
        .when((F.col("type") == "boolean") & (F.col("is") != "boolean"), "not a boolean")
        .when((F.col("type") == "enum") & ((F.col("is") != "string") | ~F.coalesce(F.array_contains("values", text), F.lit(False))), "not a declared value")
        .when((F.col("type") == "code") & ((F.col("is") != "list") | entries.isNull()), "not a list of codes")
        .when((F.col("type") == "code") & bad_entry, "an entry is not allowed")
    )
    return j.where(detail.isNotNull()).select("patient", "fact", F.lit("invalid-patient-fact").alias("code"), detail.alias("detail"))


def lint_units(units: DataFrame) -> DataFrame:
    """(patient, fact, code, detail) of companion units that are empty, unexpected or not equivalent.  units: patient, fact, unit, declared."""
    given = F.trim("unit")
    detail = F.when(F.length(given) == 0, "empty unit").when(F.col("declared").isNull(), "unit not expected").when(~units_equivalent(given, F.col("declared")), "unit not equivalent")
    return units.where(F.col("unit").isNotNull()).withColumn("detail", detail).where("detail is not null").select("patient", "fact", F.lit("invalid-patient-unit").alias("code"), "detail")


def companion_units(long: DataFrame, model: FactModel) -> DataFrame:
    """Findings on the ``<fact>_unit`` facts of a cohort, whose unit must be the declared one of the fact (:func:`lint_units`)."""
    rows = [(f"{k}_unit", k, d.unit) for k, d in model.facts.items() if f"{k}_unit" not in model.facts]
    decl = F.broadcast(long.sparkSession.createDataFrame(rows, "name string, of string, declared string"))
    told = long.join(decl, F.col("fact") == F.col("name")).select("patient", F.col("of").alias("fact"), F.coalesce(F.try_variant_get("value", "$", "string"), F.lit("")).alias("unit"), "declared")
    return lint_units(told)


def duplicate_ids(df: DataFrame, key: str, order: str) -> DataFrame:
    """The second and later rows of each id."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("occurrence", F.row_number().over(w)).where("occurrence > 1")


def non_numeric(long: DataFrame, rs: RuleSet) -> DataFrame:
    """(fact, n): facts that rules compare as numbers but that are strings in the cohort."""
    return long.where(F.col("fact").isin(numeric_facts(rs)) & (value_kind(F.col("value")) == "string")).groupBy("fact").agg(F.count(F.lit(1)).alias("n"))


def recency(entries: DataFrame, as_of: Column) -> DataFrame:
    """(…, finding) of dated facts that are stale, measured after the reference day, or not datable.

    entries: measured_at string, valid_within_days int, and any other columns.
    """
    day = F.try_to_date("measured_at", "yyyy-MM-dd")
    age = F.datediff(as_of, day)
    finding = F.when(day.isNull(), "not-datable").when(age < 0, "measured-after").when(age > F.col("valid_within_days"), "stale")
    return entries.where("valid_within_days is not null").withColumn("age_days", age).withColumn("finding", finding).where("finding is not null")

