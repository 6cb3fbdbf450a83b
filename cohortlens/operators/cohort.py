"""Cohort analytics over evaluations: counts, attrition, funnel, sole reasons, coverage, dead rules.

Every report starts from the criteria (or the fixed bands), so that rows with nothing to count are
there with zeros; each is one partial and final hash aggregate over narrow rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.model import RuleSet
from cohortlens.operators.evaluate import BANDS, DISPLAY_BANDS, OVERALL, band, display_band, is_parked
from cohortlens.operators.prove import possible_results


def domain(spark: SparkSession, column: str, values: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"ord int, {column} string")


def counts_over(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """(column, n) for each value of a fixed list, zeros included."""
    got = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(domain(df.sparkSession, column, values)).join(got, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def overall_counts(ev: DataFrame) -> DataFrame:
    return counts_over(ev, "overall", OVERALL)


def band_counts(ev: DataFrame) -> DataFrame:
    return counts_over(ev.select(band(F.col("overall")).alias("band")), "band", BANDS)


def display_band_counts(ev: DataFrame) -> DataFrame:
    return counts_over(ev.select(display_band(F.col("overall"), F.col("results")).alias("band")), "band", DISPLAY_BANDS)


def _fails(results: Column) -> Column:
    return F.filter(results, lambda r: r["verdict"] == "fail")


def reasons(ev: DataFrame) -> DataFrame:
    """Per patient: first failing criterion, sole reason, and sole modeled reason (NULL where there is none)."""
    f = _fails(F.col("results"))
    first = F.try_element_at(f, F.lit(1))
    alone = F.size(f) == 1
    sole = alone & ~F.exists("results", lambda r: r["verdict"] == "unknown")
    modeled = alone & ~first["unmodeled"] & F.forall("results", lambda r: (r["verdict"] != "unknown") | is_parked(r))
    return ev.select("patient", "results", "overall", first["ord"].alias("first_ord"), F.when(sole, first["ord"]).alias("sole_ord"), F.when(modeled, first["ord"]).alias("sole_modeled_ord"))


def criteria_frame(spark: SparkSession, rs: RuleSet) -> DataFrame:
    return spark.createDataFrame([(i, c.id, c.kind, c.unmodeled) for i, c in enumerate(rs.criteria)], "ord int, id string, kind string, unmodeled boolean")


def attrition(ev: DataFrame, rs: RuleSet) -> DataFrame:
    """(ord, id, removed_sequential, fails_alone, sole_reason, sole_modeled_reason) in rule order, zero-filled.

    All four counters come from one pass: a patient adds at most one row per criterion that fails.
    """
    r = reasons(ev)
    rows = r.select(F.explode(_fails(F.col("results"))).alias("f"), "first_ord", "sole_ord", "sole_modeled_ord")
    is_ = lambda c: F.sum((F.col("f.ord") == F.col(c)).cast("long"))
    agg = rows.groupBy(F.col("f.ord").alias("ord")).agg(is_("first_ord").alias("a"), F.count(F.lit(1)).alias("b"), is_("sole_ord").alias("c"), is_("sole_modeled_ord").alias("d"))
    z = lambda c, n: F.coalesce(c, F.lit(0)).alias(n)
    return F.broadcast(criteria_frame(ev.sparkSession, rs)).join(agg, "ord", "left").select("ord", "id", z("a", "removed_sequential"), z("b", "fails_alone"), z("c", "sole_reason"), z("d", "sole_modeled_reason"))


def sole_disqualifiers(ev: DataFrame, modeled: bool = False) -> DataFrame:
    """(id, patient): one row for each patient whom one criterion alone removes; no list is gathered."""
    c = "sole_modeled_ord" if modeled else "sole_ord"
    return reasons(ev).where(F.col(c).isNotNull()).select(F.element_at("results", F.col(c) + 1)["id"].alias("id"), "patient")


def listed(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """(…, n, patients): how many patients each group has, and the least k of them, for a report."""
    w = Window.partitionBy(*by).orderBy("patient")
    least = rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).groupBy(*by).agg(F.array_sort(F.collect_list("patient")).alias("patients"))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).join(least, by)


def funnel(ev: DataFrame, rs: RuleSet) -> DataFrame:
    """(ord, id, entering, passed, failed, unknown, chart_review) over patients whom no earlier criterion has removed."""
    active = ev.select("results", reasons_first(F.col("results")).alias("first")).select(F.explode("results").alias("r"), "first").where(F.col("first").isNull() | (F.col("r.ord") <= F.col("first")))
    n = lambda cond, name: F.sum(cond.cast("long")).alias(name)
    parked = is_parked(F.col("r"))
    agg = active.groupBy(F.col("r.ord").alias("ord")).agg(F.count(F.lit(1)).alias("entering"), n(F.col("r.verdict") == "pass", "passed"), n(F.col("r.verdict") == "fail", "failed"), n((F.col("r.verdict") == "unknown") & ~parked, "unknown"), n(parked, "chart_review"))
    names = ("entering", "passed", "failed", "unknown", "chart_review")
    return F.broadcast(criteria_frame(ev.sparkSession, rs)).join(agg, "ord", "left").select("ord", "id", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])


def reasons_first(results: Column) -> Column:
    return F.try_element_at(_fails(results), F.lit(1))["ord"]


def funnel_drilldown(ev: DataFrame) -> DataFrame:
    """(id, bucket, patient): the patients behind the funnel's counts, one row for each place that a patient is counted at."""
    active = ev.select("patient", F.explode("results").alias("r"), reasons_first(F.col("results")).alias("first")).where(F.col("first").isNull() | (F.col("r.ord") <= F.col("first")))
    bucket = F.when(is_parked(F.col("r")), "chart_review").otherwise(F.col("r.verdict"))
    return active.select("r.id", bucket.alias("bucket"), "patient")


def verdict_counts(ev: DataFrame, rs: RuleSet) -> DataFrame:
    """(ord, id, n_pass, n_fail, n_unknown)."""
    rows = ev.select(F.explode("results").alias("r"))
    n = lambda v: F.sum((F.col("r.verdict") == v).cast("long")).alias(f"n_{v}")
    agg = rows.groupBy(F.col("r.ord").alias("ord")).agg(n("pass"), n("fail"), n("unknown"))
    return F.broadcast(criteria_frame(ev.sparkSession, rs)).join(agg, "ord", "left").select("ord", "id", *[F.coalesce(f"n_{v}", F.lit(0)).alias(f"n_{v}") for v in ("pass", "fail", "unknown")])


def coverage(ev: DataFrame, rs: RuleSet) -> DataFrame:
    """Verdict counts and the gaps: a reachable verdict that no case shows."""
    reach = ev.sparkSession.createDataFrame([(i, "pass" in p, "fail" in p) for i, p in ((i, possible_verdicts(c)) for i, c in enumerate(rs.criteria))], "ord int, can_pass boolean, can_fail boolean")
    gap = F.concat_ws("; ", F.when(F.col("can_pass") & (F.col("n_pass") == 0), "never passes"), F.when(F.col("can_fail") & (F.col("n_fail") == 0), "never fails"))
    return verdict_counts(ev, rs).join(F.broadcast(reach), "ord").select("ord", "id", "n_pass", "n_fail", "n_unknown", gap.alias("gap"))


def possible_verdicts(c) -> set[str]:
    if c.unmodeled:
        return {"unknown"}
    good = {True: "pass", False: "fail", None: "unknown"} if c.kind == "inclusion" else {True: "fail", False: "pass", None: "unknown"}
    return {good[r] for r in possible_results(c.when)}


def dead_rules(ev: DataFrame, rs: RuleSet) -> DataFrame:
    """(ord, id, reason): modeled criteria that could fail and remove nobody."""
    can = [i for i, c in enumerate(rs.criteria) if "fail" in possible_verdicts(c)]
    v = verdict_counts(ev, rs).where(F.col("ord").isin(can) & (F.col("n_fail") == 0))
    return v.select("ord", "id", F.when((F.col("n_unknown") > 0) & (F.col("n_pass") == 0), "always unknown").otherwise("never fails").alias("reason"))


def run_suite(ev: DataFrame, expect: DataFrame) -> DataFrame:
    """(patient, id, expected, got) of expectations that don't hold.  expect: patient, id ('overall' or a criterion), expected."""
    got = ev.select("patient", F.explode(F.concat(F.array(F.struct(F.lit("overall").alias("id"), F.col("overall").alias("got"))), F.transform("results", lambda r: F.struct(r["id"].alias("id"), r["verdict"].alias("got"))))).alias("g")).select("patient", "g.*")
    return expect.join(got, ["patient", "id"], "left").where(~F.col("expected").eqNullSafe(F.col("got")))


def modeling_counts(rs: RuleSet, partial: tuple[str, ...] = ()) -> dict[str, int]:
    un = sum(c.unmodeled for c in rs.criteria)
    return {"total": len(rs.criteria), "modeled": len(rs.criteria) - un - len(partial), "partial": len(partial), "unmodeled": un}


def content_hash(files: DataFrame) -> DataFrame:
    """(corpus_hash, n): SHA-256 over a corpus, whatever its order.  files: patient, hash.

    Files are dealt into 65,536 lots by the digest of their patient; each lot's sorted list is hashed
    in its own group, and the lots' digests, a bounded list, are hashed in order.
    """
    patient = F.coalesce(F.col("patient").cast("string"), F.lit(""))
    lots = files.select(F.left(F.sha2(patient, 256), F.lit(4)).alias("lot"), F.struct(patient.alias("patient"), "hash").alias("f"))
    lots = lots.groupBy("lot").agg(F.sha2(F.to_json(F.array_sort(F.collect_list("f"))), 256).alias("d"), F.count(F.lit(1)).alias("n"))
    return lots.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lot", "d"))), lambda x: x["d"]), ""), 256).alias("corpus_hash"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def level_counts(findings: DataFrame) -> DataFrame:
    """(level, n) of findings, zeros included.  findings: level."""
    return counts_over(findings, "level", ("error", "warning", "info"))
