"""Sinks: JSON and Markdown of a screening, coverage and evaluation reports.  Only aggregates reach the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.model import RuleSet
from cohortlens.operators import classify, cohort
from cohortlens.operators.prove import Finding, by_severity
from cohortlens.sources import tables
from cohortlens.sources.shared import exists, kept


def screen_json(ev: DataFrame, path: str, metadata: dict) -> DataFrame:
    """Per-patient evaluations as JSON lines, and the metadata and counts beside them; returns the evaluations as written."""
    ev.write.mode("overwrite").json(f"{path}/evaluations")
    ev = ev.sparkSession.read.schema(ev.schema).json(f"{path}/evaluations")
    counts = {r.overall: r.n for r in cohort.overall_counts(ev).collect()}
    ev.sparkSession.createDataFrame([(json.dumps({**metadata, "counts": counts}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    return ev


def markdown_report(ev: DataFrame, rs: RuleSet, as_of: str, shown: int = 20) -> str:
    """Bands, attrition and sole disqualifiers of a screening; collects as many rows as there are criteria, each with ``shown`` patients at most."""
    bands = {r.band: r.n for r in cohort.display_band_counts(ev).collect()}
    rows = sorted(cohort.attrition(ev, rs).collect(), key=lambda r: r.ord)
    out = ["---", f"ruleset: {rs.ruleset}", f"version: {rs.version}", f"asOf: {as_of}", "---", "", "# Screening", "", "| band | patients |", "|---|---|"]
    out += [f"| {b} | {n} |" for b, n in bands.items()]
    out += ["", "| criterion | removed in order | fails alone | sole reason | sole modeled reason |", "|---|---|---|---|---|"]
    out += [f"| {r.id} | {r.removed_sequential} | {r.fails_alone} | {r.sole_reason} | {r.sole_modeled_reason} |" for r in rows]
    for title, modeled in (("Sole disqualifiers", False), ("Sole modeled disqualifiers", True)):
        lists = cohort.listed(cohort.sole_disqualifiers(ev, modeled), ["id"], shown).orderBy("id").collect()
        more = lambda r: f" and {r.n - len(r.patients)} more" if r.n > len(r.patients) else ""
        out += ["", f"## {title}", "", *([f"- {r.id} ({r.n}): {', '.join(map(str, r.patients))}{more(r)}" for r in lists] or ["none"])]
    return "\n".join(out) + "\n"


def findings_text(findings: list[Finding]) -> str:
    return "\n".join(f"{f.level}: {f.code}: {f.message}" for f in by_severity(findings)) or "no findings"


def coverage_report(classified: DataFrame, kind: str = "kind", trial: str = "trial", line: str = "line", shown: int = 10) -> str:
    """Markdown of a classification: shares by kind, the most frequent signals, and examples of each class, one of a trial.

    Collects the shares, ten signals and ``shown`` lines of each class.
    """
    tally = classify.tally(classified, kind)
    n = classify.distinct_trials(classified, trial).first()[0]
    out = ["# Coverage", "", f"{n} trials", "", "| kind | class | lines | % |", "|---|---|---|---|"]
    out += [f"| {r[kind] or 'all'} | {r['class']} | {r.n} | {r.pct} |" for r in tally.orderBy(F.col(kind).asc_nulls_first(), "class").collect()]
    for title, column in (("Anchors", "anchors"), ("Blockers", "blockers")):
        out += ["", f"## {title}", "", *(f"- {r.signal}: {r.n}" for r in classify.top_signals(classified, column).collect())]
    for name in classify.CLASSES:
        of = classify.examples(classified.where(F.col("class") == name), trial, line, shown).collect()
        told = lambda r: ", ".join([*r["anchors"], *(f"not {x}" for x in r["blockers"])])
        out += ["", f"## Examples: {name}", "", *([f"- {r[line]} ({r[trial]}{': ' + told(r) if told(r) else ''})" for r in of] or ["none"])]
    return "\n".join(out) + "\n"


def score_report(scores: DataFrame, buckets: DataFrame) -> str:
    """Fixed-width text of an extraction's scores."""
    s = scores.collect()[0]
    out = [f"{k:<10}{s[k]:>10.4f}" if isinstance(s[k], float) else f"{k:<10}{s[k]:>10}" for k in scores.columns]
    none = lambda x: f"{x:.3f}" if x is not None else "-"
    out += [f"bucket {r.bucket}: n={r.n} confidence={none(r.mean_confidence)} accuracy={none(r.accuracy)}" for r in buckets.orderBy("bucket").collect()]
    return "\n".join(out) + "\n"


def summary_line(bands: dict[str, int]) -> str:
    """Bands that hold somebody, in one line."""
    return " · ".join(f"{n} {b.replace('-', ' ')}" for b, n in bands.items() if n)


# --- stages of a corpus: one document for each patient ---------------------------------------------------------


def stage_documents(facts: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """(patient, text): each patient's facts as a document that the parser reads, under a comment for each entry of a log.

    facts: patient, facts VARIANT; log: patient, kind, target, detail (what was corrupted or repaired).
    """
    body = F.concat(F.lit('{"patient": '), F.to_json(F.array(F.col("patient").cast("string"))).substr(F.lit(2), F.length(F.to_json(F.array(F.col("patient").cast("string")))) - 2), F.lit(', "facts": '), F.to_json("facts"), F.lit("}"))
    docs = facts.select(F.col("patient").cast("string").alias("patient"), body.alias("body"))
    if log is None:
        return docs.select("patient", F.col("body").alias("text"))
    line = F.concat(F.lit("# "), F.regexp_replace(F.concat_ws(" ", "kind", "target", "detail"), r"[\r\n]+", " "))
    lines = log.groupBy(F.col("patient").cast("string").alias("patient")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return docs.join(lines, "patient", "left").select("patient", F.concat_ws("\n", "lines", "body").alias("text"))


def facts_documents(entries: DataFrame, as_of: str | None = None) -> DataFrame:
    """(patient, text): the proposed rows of each patient as a facts file, in the order of their facts.

    entries: patient, fact, value VARIANT, unit, confidence, extractedBy, doc, quote, status; rows that aren't proposed are left out.
    """
    entry = F.struct("fact", "value", "unit", "status", "confidence", "extractedBy", F.struct("doc", "quote").alias("source"))
    day = F.lit(as_of).cast("string")
    rows = entries.where("status = 'proposed'").select(F.col("patient").cast("string").alias("patient"), "fact", "doc", "quote", F.to_json(entry).alias("e"))
    each = rows.groupBy("patient").agg(F.array_sort(F.collect_list(F.struct("fact", "doc", "quote", "e"))).alias("rows"))
    named = F.to_json(F.struct("patient", day.alias("asOf")))
    text = F.concat(F.regexp_replace(named, r"\}$", ', "facts": ['), F.array_join(F.transform("rows", lambda r: r["e"]), ",\n"), F.lit("]}"))
    return each.select("patient", text.alias("text"))


def buckets_for(documents: int) -> int:
    """As many buckets as keep each, which one task writes, at some 20,000 documents; a folder keeps the number that it was written with."""
    return max(16, -(-documents // 20_000))


def read_documents(spark: SparkSession, path: str, buckets: int | None = None) -> DataFrame:
    """(patient, text) of documents that :func:`write_documents` wrote."""
    if buckets:
        return spark.read.schema("patient string, text string, bucket int").parquet(path)
    rows = spark.read.schema("value string, patient string").text(path, wholetext=True)
    return rows.select("patient", F.regexp_replace("value", r"\n$", "").alias("text"))


def decided_patients(documents: DataFrame) -> DataFrame:
    """(patient) whose facts file has a row that somebody decided, or that can't be read: neither may be overwritten."""
    rows = tables.read_facts_files(documents.select(F.col("patient").alias("name"), F.col("text").alias("content")))
    return rows.where("problems IS NOT NULL OR entry.status <> 'proposed'").select(F.col("name").alias("patient")).distinct()


def write_documents(documents: DataFrame, path: str, guard: bool = False, buckets: int | None = None) -> DataFrame:
    """Writes (patient, text), and returns (patient, action): written, kept or unchanged.

    A text file in a folder for each patient; with ``buckets``, which large corpora need, as many folders of
    Parquet with the documents of many patients each, of which a run rewrites only those with a new document.

    Safe to repeat: a document that is there already is left alone; what is new is first written whole to
    a staging folder (read back from there, so that it is computed once), and then replaces its
    folders only.  With ``guard`` a facts file that holds decisions is never replaced.  A run that ends
    in the middle leaves whole old or whole new folders; running again completes it.
    """
    spark = documents.sparkSession
    staged = kept(documents.select(F.col("patient").cast("string").alias("patient"), "text"), "stage")
    if exists(spark, path):
        old = read_documents(spark, path, buckets)
        hashed = staged.withColumn("hash", F.sha2("text", 256))
        action = hashed.join(old.select("patient", F.sha2("text", 256).alias("old")), "patient", "left")
        decided = decided_patients(old).withColumn("decided", F.lit(True)) if guard else None
        action = action.join(decided, "patient", "left") if guard else action.withColumn("decided", F.lit(False))
        action = action.withColumn("action", F.when(F.col("hash") == F.col("old"), "unchanged").when(F.col("decided"), "kept").otherwise("written"))
    else:
        old, action = None, staged.withColumn("action", F.lit("written"))
    told = kept(action.select("patient", "text", "action"), "actions")  # decided before anything is replaced
    new = told.where("action = 'written'").select("patient", "text")
    if new.isEmpty():
        return told.select("patient", "action")
    if buckets:
        new = new.withColumn("bucket", F.pmod(F.xxhash64("patient"), F.lit(buckets)).cast("int"))
        if old is not None:
            beside = old.join(new.select("bucket").distinct(), "bucket", "left_semi").join(new.select("patient"), "patient", "left_anti")
            new = kept(new.unionByName(beside.select("patient", "text", "bucket")), "merged")
        new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    else:
        new.select(F.col("text").alias("value"), "patient").repartition("patient").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("patient").text(path)
    return told.select("patient", "action")
