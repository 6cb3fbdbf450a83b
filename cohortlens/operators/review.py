"""The review queue: decisions, what they change, and the order in which to take proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.names import free
from cohortlens.model import Criterion, FactModel, RuleSet, leaves
from cohortlens.operators import ground
from cohortlens.operators.evaluate import display_band, overall_of, with_results

UNSURE = 0.8


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The last decision of each card; of equal times a rejection, then the greater value.  decisions: card, decision, value, at, correction_reason, correction_source."""
    w = Window.partitionBy("card").orderBy(F.desc("at"), F.desc("decision"), F.desc("value"), F.desc("correction_reason"), F.desc("correction_source"))
    (n,) = free(decisions, "__n")
    return decisions.withColumn(n, F.row_number().over(w)).where(F.col(n) == 1).drop(n)


def valid_decisions(decisions: DataFrame, reviewable: DataFrame) -> DataFrame:
    """Decisions on cards that can be reviewed; a corrected value needs a reason and a source, and a confirmation."""
    corrected = F.col("value").isNotNull()
    ok = F.col("decision").isin("confirmed", "rejected") & (~corrected | ((F.col("decision") == "confirmed") & F.col("correction_reason").isNotNull() & F.col("correction_source").isNotNull()))
    return decisions.join(reviewable.select("card").distinct(), "card", "left_semi").where(ok)


def apply_review(cohort: DataFrame, proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """(patient, fact, value): the structured record stands; a confirmed proposal, or its correction, overrides it.

    cohort: patient, fact, value; proposals: card, patient, fact, value; decisions: the latest of each card.
    """
    confirmed = proposals.join(decisions.where("decision = 'confirmed'").select("card", F.col("value").alias("corrected")), "card").groupBy("patient", "fact").agg(F.max(F.coalesce("corrected", "value")).alias("reviewed"))
    known = cohort.select("patient").distinct()
    return cohort.join(confirmed.join(known, "patient", "left_semi"), ["patient", "fact"], "full_outer").select("patient", "fact", F.coalesce("reviewed", "value").alias("value"))


def structured_values(proposals: DataFrame, cohort: DataFrame) -> DataFrame:
    """``proposals`` with ``structured``: the recorded value that a confirmation would override.  cohort: patient, fact, value, once for each patient and fact."""
    return proposals.join(cohort.select("patient", "fact", F.col("value").alias("structured")), ["patient", "fact"], "left")


def allowed_values(proposals: DataFrame, model: FactModel) -> DataFrame:
    """``proposals`` with ``allowed``: the values that the model declares for an enum fact, NULL for others."""
    rows = [(k, list(d.values)) for k, d in model.facts.items() if d.type == "enum"]
    declared = proposals.sparkSession.createDataFrame(rows, "fact string, allowed array<string>")
    return proposals.join(F.broadcast(declared), "fact", "left")


def parse_edit(edited: Column, original_type: Column) -> Column:
    """An edited value of the original's type, as text; NULL where it is none (lists are refused)."""
    e = F.trim(edited)
    yes = F.when(F.lower(e).isin("true", "yes"), "true").when(F.lower(e).isin("false", "no"), "false")
    number = F.when(e.rlike(r"\A-?\d+(\.\d+)?\z"), e)
    return F.when(original_type == "number", number).when(original_type == "boolean", yes).when((original_type == "string") & (F.length(e) > 0), e)


def display_type(value: Column) -> Column:
    return F.when(value.rlike(r"\A-?\d+(\.\d+)?\z"), "number").when(value.isin("true", "false"), "boolean").otherwise("string")


def facts_of_interest(rs: RuleSet, chart: dict[str, str] | None = None) -> dict[str, list[str]]:
    """Facts that rules read, and those that resolve unmodeled criteria, with the criteria that do."""
    out: dict[str, list[str]] = {}
    for c in rs.criteria:
        for f in _facts(c, chart or {}):
            out.setdefault(f, []).append(c.id)
    return out


def _facts(c: Criterion, chart: dict[str, str]) -> list[str]:
    return [chart[c.id]] if c.unmodeled and c.id in chart else list(dict.fromkeys(x.fact for x in leaves(c.when)))


def impact(pending: DataFrame, rs: RuleSet, model: FactModel, fact: str, column: str = "proposed") -> DataFrame:
    """(patient, card, confidence, band_without, band_with, flips) of pending proposals of one fact.

    pending: a typed wide cohort joined with the proposals, one row for each card; ``column`` holds
    the proposed value.  The fact's column is swapped between two projections of the same row, so that
    the cohort is evaluated without the fact and with it in one pass.
    """
    t = pending.schema[fact].dataType
    first = with_results(pending.withColumn(fact, F.lit(None).cast(t)), rs, model, "r0")
    both = with_results(first.withColumn(fact, F.col(column)), rs, model, "r1")
    b0, b1 = display_band(overall_of(F.col("r0")), F.col("r0")), display_band(overall_of(F.col("r1")), F.col("r1"))
    return both.select("patient", "card", "confidence", b0.alias("band_without"), b1.alias("band_with"), (b0 != b1).alias("flips"))


def queue(cards: DataFrame) -> DataFrame:
    """What flips a patient first, then the least sure, then by card."""
    return cards.withColumn("unsure", F.col("confidence") < UNSURE).orderBy(F.desc("flips"), "confidence", "card")


def progress(cards: DataFrame) -> DataFrame:
    """(total, pending, decided, relevant, relevant_pending, patients).  cards: patient, decision (NULL while pending), relevant."""
    n = lambda c, name: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name)
    open_ = F.col("decision").isNull()
    return cards.agg(F.count(F.lit(1)).alias("total"), n(open_, "pending"), n(~open_, "decided"), n(F.col("relevant"), "relevant"), n(F.col("relevant") & open_, "relevant_pending"), F.countDistinct("patient").alias("patients"))


def manifest(cards: DataFrame) -> DataFrame:
    """One JSON document for each decided card, with the value before and after; not authoritative."""
    body = F.struct("card", "patient", "fact", "decision", F.struct(F.col("recorded").alias("before"), F.coalesce("corrected", "proposed").alias("after")).alias("change"), "at")
    return cards.where("decision is not null").select("card", F.to_json(body).alias("json"))


def snapshot_manifest(entries: DataFrame, decisions: DataFrame, reviewer: str, now: str, recorded: DataFrame | None = None) -> DataFrame:
    """(patient, json): what was decided of each patient's facts file, with each row before and after and the file as it was.

    entries: patient, fact, value VARIANT, unit, status, confidence, extractedBy, source struct<doc, quote>;
    decisions: card (``patient:fact``), decision, value VARIANT (a correction), at, correction_reason,
    correction_source; recorded: patient, fact, value VARIANT of the structured record.  Patients of whom
    nothing is decided have no row.  A correction without reason and source, or no reviewer, is an error.
    The manifest is not authoritative and never replaces a facts file.
    """
    if not reviewer.strip():
        raise ValueError("a manifest names its reviewer")
    keys = ["patient", "fact"]
    file = F.struct("fact", "value", "unit", "status", "confidence", "extractedBy", "source")
    told = entries.where(ground.is_llm() & (F.col("status") != "rejected")).select(*keys, F.concat_ws(":", *keys).alias("card"), "value", "unit", "extractedBy", "source", file.alias("proposal"))
    d = decisions.where(F.col("decision").isin("confirmed", "rejected")).select("card", "decision", F.col("value").alias("corrected"), F.coalesce("at", F.lit(now)).alias("at"), "correction_reason", "correction_source")
    j = told.join(d, "card")
    if recorded is not None:
        j = j.join(recorded.select(*keys, F.col("value").alias("recordedValue")), keys, "left")
    else:
        j = j.withColumn("recordedValue", F.lit(None).cast("variant"))
    fixed = F.col("corrected").isNotNull()
    unfounded = fixed & (F.coalesce(F.length("correction_reason"), F.lit(0)) * F.coalesce(F.length("correction_source"), F.lit(0)) == 0)
    refused = F.when(unfounded, F.raise_error(F.concat("card", F.lit(": a corrected value has no reason or source"))).cast("string"))
    attested = F.struct(F.lit("reviewer-attestation").alias("type"), F.col("correction_source").alias("detail"))
    after = F.struct(
        "fact", F.coalesce("corrected", "value").alias("value"), "unit", F.col("decision").alias("status"), F.when(fixed, "human").otherwise(F.col("extractedBy")).alias("extractedBy"),
        F.when(~fixed, F.col("source")).alias("source"), F.when(fixed, attested).alias("attestation"), F.lit(reviewer.strip()).alias("reviewedBy"), F.col("at").alias("reviewedAt"), refused.alias("refused"),
    )
    one = F.struct("fact", "decision", F.struct("proposal", "recordedValue").alias("before"), after.alias("after"), F.when(fixed, F.struct(F.col("correction_reason").alias("reason"), F.col("correction_source").alias("source"))).alias("correction"))
    each = j.select("patient", "fact", F.to_json(one).alias("d")).groupBy("patient").agg(F.array_sort(F.collect_list(F.struct("fact", "d"))).alias("ds"))
    files = entries.join(each.select("patient"), "patient", "left_semi").select("patient", "fact", F.to_json(file).alias("e")).groupBy("patient").agg(F.array_sort(F.collect_list(F.struct("fact", "e"))).alias("es"))
    listed = lambda col, part: F.array_join(F.transform(col, lambda x: x[part]), ",")
    head = F.to_json(F.struct(F.lit("review-manifest").alias("kind"), F.lit(1).alias("version"), F.lit(False).alias("authoritative"), F.lit(now).alias("exportedAt"), F.col("patient").cast("string").alias("patient")))
    text = F.concat(F.regexp_replace(head, r"\}$", ',"sourceSnapshot":['), listed("es", "e"), F.lit('],"decisions":['), listed("ds", "d"), F.lit("]}"))
    return each.join(files, "patient").select("patient", text.alias("json"))


def highlight(body: Column, quote: Column) -> Column:
    """The text before, in and after the first occurrence of the quote; NULL if there is none."""
    at = F.instr(body, quote)
    return F.when(at > 0, F.struct(F.substring(body, F.lit(1), at - 1).alias("before"), quote.alias("hit"), F.substring(body, at + F.length(quote), F.length(body)).alias("after")))
