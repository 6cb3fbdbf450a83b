"""Ingestion: nested bundles to flat facts, seeded corruption, and normalisation that quarantines rather than guesses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.functions.facts import UNIT_ALIASES, completed_years, patient_id, round_half_up, whole_days
from cohortlens.functions.names import free
from cohortlens.sources.shared import exists, kept

#: Laboratory concepts (code, name, canonical unit).
LABS = (
    ("38483-4", "creatinine", "mg/dL"), ("33914-3", "egfr", "mL/min/{1.73_m2}"), ("6299-2", "bun", "mg/dL"), ("2947-0", "sodium", "mmol/L"),
    ("6298-4", "potassium", "mmol/L"), ("2339-0", "glucose", "mg/dL"), ("49765-1", "calcium", "mg/dL"), ("718-7", "hemoglobin", "g/dL"),
    ("4544-3", "hematocrit", "%"), ("777-3", "platelets", "10*3/uL"), ("6690-2", "wbc", "10*3/uL"), ("1751-7", "albumin", "g/dL"),
    ("1742-6", "alt", "U/L"), ("1920-8", "ast", "U/L"), ("1975-2", "bilirubin_total", "mg/dL"), ("4548-4", "hba1c", "%"),
    ("2093-3", "total_cholesterol", "mg/dL"), ("18262-6", "ldl", "mg/dL"), ("2085-9", "hdl", "mg/dL"), ("2571-8", "triglycerides", "mg/dL"),
    ("8480-6", "systolic_bp", "mm[Hg]"), ("8462-4", "diastolic_bp", "mm[Hg]"), ("29463-7", "weight", "kg"), ("8302-2", "height", "cm"),
    ("39156-5", "bmi", "kg/m2"), ("10230-1", "lvef", "%"), ("30934-4", "bnp", "pg/mL"), ("33762-6", "nt_probnp", "pg/mL"),
)
#: Codes of local laboratories.
LOCAL_CODES = {
    "CREAT-S": "38483-4", "EGFR-EPI": "33914-3", "BUN-S": "6299-2", "NA-SER": "2947-0", "K-SER": "6298-4", "GLU-R": "2339-0", "CA-S": "49765-1",
    "HGB": "718-7", "HCT": "4544-3", "PLT": "777-3", "WBC-A": "6690-2", "ALB-S": "1751-7", "ALT-S": "1742-6", "AST-S": "1920-8", "TBILI": "1975-2",
    "A1C": "4548-4", "CHOL-T": "2093-3", "LDL-C": "18262-6", "HDL-C": "2085-9", "TRIG": "2571-8", "EF-ECHO": "10230-1", "BNP-Q": "30934-4", "NTPBNP": "33762-6",
}
#: Conversions that hold for one analyte (name, from, to, factor).
CONVERSIONS = (
    ("creatinine", "umol/L", "mg/dL", 0.0113123), ("creatinine", "µmol/L", "mg/dL", 0.0113123),
    ("egfr", "mL/min", "mL/min/{1.73_m2}", 1.0), ("egfr", "ml/min", "mL/min/{1.73_m2}", 1.0),
    ("bnp", "ng/L", "pg/mL", 1.0), ("nt_probnp", "ng/L", "pg/mL", 1.0), ("lvef", "1", "%", 100.0), ("lvef", "fraction", "%", 100.0),
    ("hemoglobin", "g/L", "g/dL", 0.1), ("weight", "[lb_av]", "kg", 0.45359237), ("weight", "lb", "kg", 0.45359237),
    ("height", "[in_i]", "cm", 2.54), ("height", "in", "cm", 2.54),
)
#: Default shares of the corruptions, and days a stopped medication stays.
RATES = {"drop_unit": 0.22, "sloppy_unit": 0.25, "convert": 0.10, "local_code": 0.18, "stringify": 0.07, "duplicate": 0.35, "backdate": 0.15, "unresolvable": 0.12}
MEDICATION_DAYS, JITTER_DAYS = 365, 45
#: By how many days, from and to, the date of a lab is moved back.
BACKDATE = (30, 400)
UNRESOLVABLE = "LOCAL-UNMAPPED-9"
HF_CODES = ("88805009", "84114007", "42343007")


def lab_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LABS), "loinc string, slug string, canonical string")


def local_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LOCAL_CODES.items()), "local string, loinc string")


def alias_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(UNIT_ALIASES.items()), "alias string, unit string")


def conversion_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CONVERSIONS), "slug string, from_unit string, to_unit string, factor double")


def normalize_labs(labs: DataFrame) -> DataFrame:
    """(… , slug, value, unit, raw, status, log) of lab rows (…, code, base, value_text, unit).

    ``value_text`` is the number as text; what is no plain number, or in a unit that isn't known for
    the analyte, is quarantined: value and unit go, ``raw`` keeps both as text.  A row that an earlier
    run has quarantined (no value, but ``raw``) stays exactly as it is, so that normalising twice is
    normalising once.  The dimensions are fixed tables of under forty rows and so are broadcast.
    """
    before = F.col("value_text").isNull() & F.col("raw").isNotNull() if "raw" in labs.columns else F.lit(False)
    spark = labs.sparkSession
    defs, local = lab_dim(spark), local_dim(spark).select("local", F.col("loinc").alias("mapped"))
    conv = conversion_dim(spark).withColumnsRenamed({"slug": "c_slug", "from_unit": "c_from", "to_unit": "c_to"})
    alias = alias_dim(spark).withColumnsRenamed({"alias": "a_from", "unit": "a_to"})
    j = labs.join(F.broadcast(defs.select(F.col("loinc").alias("direct"))), F.col("code") == F.col("direct"), "left").join(F.broadcast(local), F.col("code") == F.col("local"), "left")
    j = j.withColumn("loinc", F.coalesce("direct", "mapped"))
    by_slug = defs.select(F.col("slug").alias("b_slug"), F.col("canonical").alias("b_unit"))
    j = j.join(F.broadcast(defs), "loinc", "left").join(F.broadcast(by_slug), F.col("code").isNull() & (F.col("base") == F.col("b_slug")), "left")
    slug, want = F.coalesce("slug", "b_slug"), F.coalesce("canonical", "b_unit")
    j = j.withColumns({"slug": F.coalesce(slug, F.col("base")), "want": want})
    j = j.join(F.broadcast(alias), F.col("unit") == F.col("a_from"), "left")
    j = j.join(F.broadcast(conv), (F.col("slug") == F.col("c_slug")) & (F.coalesce("unit", F.lit("")) == F.col("c_from")) & (F.col("want") == F.col("c_to")), "left")
    number = F.when(F.col("value_text").rlike(r"\A-?\d+(\.\d+)?\z"), F.expr("try_cast(value_text as double)"))
    status = (
        F.when(before, "quarantined-before")
        .when(F.col("want").isNull(), "unresolvable-code")
        .when(number.isNull(), "quarantined-value")
        .when(F.coalesce(F.col("unit") == F.col("want"), F.lit(False)), "ok")
        .when(F.coalesce(F.length(F.trim("unit")), F.lit(0)) == 0, "assumed-unit")
        .when(F.coalesce(F.col("a_to") == F.col("want"), F.lit(False)), "unit-alias")
        .when(F.col("factor").isNotNull(), "converted")
        .otherwise("unknown-unit")
    )
    j = j.withColumns({"number": number, "status": status})
    bad = F.col("status").isin("unresolvable-code", "quarantined-value", "unknown-unit")
    value = F.when(bad, F.lit(None).cast("double")).when(F.col("status") == "converted", round_half_up(F.col("number") * F.col("factor"))).otherwise(F.col("number"))
    raw = F.when(bad, F.concat_ws(" ", "value_text", "unit"))
    raw = F.when(before, F.col("raw")).otherwise(raw) if "raw" in labs.columns else raw
    bad = bad | (F.col("status") == "quarantined-before")
    mapped = F.when(~before & F.col("direct").isNull() & F.col("mapped").isNotNull(), "mapped-code")
    keep = [c for c in labs.columns if c not in ("value_text", "unit", "raw")]
    return j.select(*keep, "slug", value.alias("value"), F.when(bad, F.lit(None)).otherwise(F.col("want")).alias("unit"), raw.alias("raw"), "status", F.array_compact(F.array(mapped, F.when(~F.col("status").isin("ok", "quarantined-before"), F.col("status")))).alias("log"))


def dedup_codes(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each key, system and code: the one of the fewest days ago, undated last; the first in ``seq`` among equals."""
    (n,) = free(rows, "__n")
    w = Window.partitionBy(*keys, "system", "code").orderBy(F.asc_nulls_last("days_ago"), "seq")
    return rows.withColumn(n, F.row_number().over(w)).where(F.col(n) == 1).drop(n)


def latest(rows: DataFrame, keys: list[str], when: str, seq: str) -> DataFrame:
    """The newest row of each key; the first in ``seq`` among equals."""
    (n,) = free(rows, "__n")
    w = Window.partitionBy(*keys).orderBy(F.desc(when), seq)
    return rows.withColumn(n, F.row_number().over(w)).where(F.col(n) == 1).drop(n)


def lab_base(fact: Column) -> Column:
    return F.regexp_replace(fact, "_(unit|code|days_ago|raw)$", "")


# --- bundles ---------------------------------------------------------------------------------------

#: The names of the code systems of conditions and medications.
SNOMED, RXNORM = "http://snomed.info/sct", "http://www.nlm.nih.gov/research/umls/rxnorm"
CODING = "array<struct<system:string,code:string,display:string>>"
BUNDLE = (
    "entry array<struct<resource:struct<resourceType:string,id:string,birthDate:string,gender:string,status:string,"
    f"code:struct<coding:{CODING}>,medicationCodeableConcept:struct<coding:{CODING}>,effectiveDateTime:string,authoredOn:string,onsetDateTime:string,"
    "effectivePeriod:struct<start:string>,valueQuantity:struct<value:double,unit:string>,"
    f"component:array<struct<code:struct<coding:{CODING}>,valueQuantity:struct<value:double,unit:string>>>>>>"
)


RESOURCE = BUNDLE.removeprefix("entry array<struct<resource:").removesuffix(">>")


#: Bundles of more bytes get a file of their own, which is split among tasks at its entries.
OWN_BYTES = 16 << 20
#: Files that are read whole by their names; beyond that all are read and those picked.
FEW = 5000


def find_bundles(spark: SparkSession, root: str, ending: str = ".json") -> str:
    """The first of root/fhir and root that holds bundle files, in whatever store they are."""
    jvm = spark.sparkContext._jvm
    for folder in (f"{root.rstrip('/')}/fhir", root):
        p = jvm.org.apache.hadoop.fs.Path(folder)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(p) and fs.getFileStatus(p).isDirectory() and any(x.getPath().getName().endswith(ending) for x in fs.listStatus(p)):
            return folder
    raise FileNotFoundError(f"no *{ending} under {root}")


def read_bundles(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(entry) of whole bundles: one row for each file."""
    return spark.read.schema(BUNDLE).option("multiLine", True).option("pathGlobFilter", glob).json(path)


def read_resources(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(patient, seq, r, at) as :func:`resources`, of a folder of bundle files, a row for each entry.

    Files are read as text that ends at each key ``"resource"``, so that Spark splits even one huge bundle
    among tasks and no bundle is ever a row.  Files in which that word isn't only the key of an entry (it
    is a value, or stands inside a resource) are told by the pieces that don't fit, and are read whole.
    """
    text = spark.read.option("lineSep", '"resource"').option("pathGlobFilter", glob)
    raw = text.text(path).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("seq"), "value")
    starts = raw.withColumn("body", F.regexp_extract("value", r"(?s)^\s*:\s*(\{.*)$", 1))
    is_head = ~F.col("value").rlike(r"^\s*[:,}\]]")
    r = F.when(F.length("body") > 0, F.from_json("body", RESOURCE))
    rows = kept(starts.where(~is_head).select("file", "seq", r.alias("r")), "bundle-entries")  # parsed once
    odd = rows.where("r.resourceType IS NULL").select("file").distinct()
    good = rows.join(odd, "file", "left_anti")
    at = F.try_to_timestamp(F.coalesce("r.effectiveDateTime", "r.authoredOn", "r.onsetDateTime", "r.effectivePeriod.start"))
    # the first patient of each file
    named = good.where("r.resourceType = 'Patient'").groupBy("file").agg(patient_id(F.min_by("r.id", "seq")).alias("patient"))
    split = good.join(named, "file", "left").select("patient", "seq", "r", at.alias("at"))
    named_odd = [r.file for r in odd.limit(FEW + 1).collect()]
    if not named_odd:
        return split
    whole = spark.read.schema(BUNDLE).option("multiLine", True)
    if len(named_odd) <= FEW:
        rest = resources(whole.json(named_odd))
    else:
        every = whole.option("pathGlobFilter", glob).json(path).select("entry", F.col("_metadata.file_path").alias("file"))
        rest = resources(every.join(odd, "file", "left_semi").select("entry"))
    return split.unionByName(rest.withColumn("seq", F.struct(F.lit(0).cast("long").alias("block"), F.col("seq").cast("long").alias("n"))))


def write_bundles(bundles: DataFrame, root: str, own_bytes: int = OWN_BYTES) -> None:
    """Writes (name, text): bundles as lines of a few files under root/lots, one beyond ``own_bytes`` as a file of its own under root/fhir.

    A store lists, opens and commits each file by itself, which for a file a patient takes longer than all else.
    """
    staged = kept(bundles.select("name", "text"), "bundle-texts")
    large = F.octet_length("text") > own_bytes
    # outside of strings, where JSON has them escaped, line ends are white space
    staged.where(~large).select(F.regexp_replace("text", r"[\r\n]+", " ").alias("value")).write.text(f"{root}/lots")
    alone = staged.where(large)
    if not alone.isEmpty():
        alone.select(F.col("text").alias("value"), "name").repartition("name").write.partitionBy("name").text(f"{root}/fhir")


def read_written(spark: SparkSession, root: str) -> DataFrame:
    """(patient, seq, r, at) as :func:`read_resources`, of what :func:`write_bundles` wrote."""
    rows = resources(spark.read.schema(BUNDLE).json(f"{root}/lots"))
    rows = kept(rows.withColumn("seq", F.struct(F.lit(0).cast("long").alias("block"), F.col("seq").cast("long").alias("n"))), "bundle-entries")  # parsed once
    return rows.unionByName(read_resources(spark, f"{root}/fhir", "*.txt")) if exists(spark, f"{root}/fhir") else rows


def resources(bundles: DataFrame) -> DataFrame:
    """(patient, seq, r, at): every resource, its place in the bundle and its date."""
    named = bundles.select("entry", F.get(F.filter("entry", lambda e: e["resource"]["resourceType"] == "Patient"), F.lit(0))["resource"]["id"].alias("rid"))
    rows = named.select(patient_id(F.col("rid")).alias("patient"), F.posexplode("entry").alias("seq", "e")).select("patient", "seq", F.col("e.resource").alias("r"))
    at = F.coalesce("r.effectiveDateTime", "r.authoredOn", "r.onsetDateTime", "r.effectivePeriod.start")
    return rows.withColumn("at", F.try_to_timestamp(at))


def flatten(bundles: DataFrame, as_of: str, jitter_seed: int = 0) -> DataFrame:
    """(patient, age, sex, conditions, medications, labs): bundles as flat facts.

    The newest event of a patient stands for the reference day, up to ``JITTER_DAYS`` earlier; days
    ago count from there.  Of a lab the newest reading stays, of a code its newest mention;
    medications that ended over a year ago go, labs that aren't listed, and conditions and medications
    without a date or without a code of their system (SNOMED CT, RxNorm).
    """
    return flatten_resources(resources(bundles), as_of, jitter_seed)


def flatten_resources(rows: DataFrame, as_of: str, jitter_seed: int = 0) -> DataFrame:
    """As :func:`flatten`, of rows (patient, seq, r, at)."""
    spark = rows.sparkSession
    anchor = rows.groupBy("patient").agg(F.max("at").alias("anchor"))
    jitter = F.pmod(F.xxhash64(F.lit(jitter_seed), "patient"), F.lit(JITTER_DAYS + 1)).cast("int")
    rows = rows.join(anchor, "patient").withColumn("days_ago", whole_days(F.col("anchor"), F.col("at")) + jitter)
    person = rows.where(F.col("r.resourceType") == "Patient").select("patient", completed_years(F.to_date("r.birthDate"), F.to_date(F.lit(as_of))).alias("age"), F.col("r.gender").alias("sex"))
    condition = F.col("r.resourceType") == "Condition"
    of = lambda concept, system: F.get(F.filter(concept, lambda c: (c["system"] == system) & c["code"].isNotNull()), F.lit(0))["code"]
    code = F.when(condition, of("r.code.coding", SNOMED)).otherwise(of("r.medicationCodeableConcept.coding", RXNORM))
    coded = rows.where(F.col("r.resourceType").isin("Condition", "MedicationRequest") & F.col("at").isNotNull())
    coded = coded.select("patient", "seq", F.when(condition, "conditions").otherwise("medications").alias("list"), code.alias("code"), F.when(condition, "snomed").otherwise("rxnorm").alias("system"), F.greatest(F.col("days_ago"), F.lit(0)).alias("days_ago"), "r.status").where("code IS NOT NULL")
    coded = coded.where((F.col("list") == "conditions") | (F.col("status") == "active") | (F.col("days_ago") <= MEDICATION_DAYS))
    coded = dedup_codes(coded, "patient", "list")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("days_ago", F.lit(0)).alias("o"), "code", "system", F.col("days_ago").alias("daysAgo"))))
    lists = coded.groupBy("patient").pivot("list", ["conditions", "medications"]).agg(F.transform(order, lambda x: F.struct(x["code"].alias("code"), x["system"].alias("system"), x["daysAgo"].alias("daysAgo"))))
    own = F.struct(F.col("r.code").alias("code"), F.col("r.valueQuantity").alias("valueQuantity"))
    readings = rows.where(F.col("r.resourceType") == "Observation").select("patient", "seq", "at", "days_ago", F.explode(F.concat(F.array(own), F.coalesce("r.component", F.array().cast(f"array<struct<code:struct<coding:{CODING}>,valueQuantity:struct<value:double,unit:string>>>")))).alias("o"))
    readings = readings.where("o.valueQuantity.value is not null").withColumn("loinc", F.get(F.filter("o.code.coding", lambda c: c["system"] == "http://loinc.org"), F.lit(0))["code"])
    labs = latest(readings.join(F.broadcast(lab_dim(spark)), "loinc"), ["patient", "slug"], "at", "seq")
    labs = labs.groupBy("patient").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("slug", F.struct(round_half_up(F.col("o.valueQuantity.value")).alias("value"), F.coalesce("o.valueQuantity.unit", "canonical").alias("unit"), F.col("loinc").alias("code"), "days_ago"))))).alias("labs"))
    return person.join(lists, "patient", "left").join(labs, "patient", "left")


def hf_cohort(flat: DataFrame, n_hf: int, n_all: int) -> DataFrame:
    """The first ``n_hf`` patients with a heart-failure code, filled up with the oldest others (ties by id)."""
    hf = F.coalesce(F.exists("conditions", lambda c: c["code"].isin(*HF_CODES)), F.lit(False))
    first = flat.where(hf).orderBy("patient").limit(n_hf)
    rest = flat.where(~hf).orderBy(F.desc("age"), "patient").limit(max(0, n_all - n_hf))
    return first.unionByName(rest)


# --- seeded corruption -------------------------------------------------------------------------------


def draw(seed: int, patient: Column, *stream: Column | str) -> Column:
    """A number in [0, 1) that depends on the seed, the patient and the stream's name alone: the head of an MD5 digest."""
    parts = [F.lit(str(seed)), patient.cast("string"), *(F.lit(s) if isinstance(s, str) else s for s in stream)]
    return F.conv(F.left(F.md5(F.concat_ws(":", *parts)), F.lit(8)), 16, 10).cast("long") / float(1 << 32)


def _between(u: Column, low: int, high: int) -> Column:
    return (F.floor(u * (high - low + 1)) + low).cast("long")


def _any_of(u: Column, items: Column) -> Column:
    return F.get(items, F.floor(u * F.size(items)).cast("int"))


def mess(labs: DataFrame, seed: int, rates: dict | None = None) -> DataFrame:
    """(patient, slug, code, value_text, unit, days_ago, log): labs as a careless extract has them.

    Per patient and lab, in this order: local or unresolvable code; unit dropped, converted, or sloppily
    spelt (one of them at most); value as text; date shifted.  Draws depend on the patient and lab
    alone, so that partitioning and order don't matter.
    """
    r = {**RATES, **(rates or {})}
    sloppy: dict[str, list[str]] = {}
    for a, u in UNIT_ALIASES.items():
        sloppy.setdefault(u, []).append(a)
    away: dict[str, list] = {}
    for slug, given, want, factor in CONVERSIONS:
        away.setdefault(f"{slug}|{want}", []).append(F.struct(F.lit(given).alias("unit"), F.lit(factor).alias("factor")))
    table = lambda d: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), v)])
    local = table({v: F.lit(k) for k, v in LOCAL_CODES.items()})
    spelt = table({k: F.array(*map(F.lit, v)) for k, v in sloppy.items()})
    converts = table({k: F.array(*v) for k, v in away.items()})
    u = lambda name: draw(seed, F.col("patient"), F.concat(F.lit("mess:"), "slug"), name)

    x = labs.select("patient", "slug", "code", F.col("value").cast("double").alias("value"), "unit", F.col("days_ago").cast("long").alias("days_ago"))
    x = x.withColumns({"other": F.try_element_at(local, F.col("code")), "to": F.try_element_at(converts, F.concat_ws("|", "slug", "unit")), "spelt": F.try_element_at(spelt, F.col("unit")), "which": u("unit")})
    drop, convert, sloppy_upto = r["drop_unit"], r["drop_unit"] + r["convert"], r["drop_unit"] + r["convert"] + r["sloppy_unit"]
    coded = u("local-code") < r["local_code"]
    x = x.withColumns({
        "c": F.when(coded & (u("unresolvable") < r["unresolvable"]), "unresolvable-code").when(coded & F.col("other").isNotNull(), "local-code"),
        "n": F.when(F.col("which") < drop, "drop-unit").when((F.col("which") < convert) & F.col("to").isNotNull(), "convert-unit").when((F.col("which") < sloppy_upto) & F.col("spelt").isNotNull(), "sloppy-unit"),
        "t": F.when(u("stringify") < r["stringify"], "stringify"),
        "d": F.when(F.col("days_ago").isNotNull() & (u("backdate") < r["backdate"]), "backdate"),
        "to": _any_of(u("to"), F.col("to")),
    })
    value = F.when(F.col("n") == "convert-unit", F.col("value") / F.col("to.factor")).otherwise(F.col("value"))
    shown = F.format_string("%.2f", value)
    texts = F.array(F.concat(F.lit(">"), shown), F.concat(F.lit("<"), shown), F.concat(shown, F.lit(" (see comment)")), F.lit("cancelled"), F.lit("hemolyzed"), F.concat(shown, F.lit(" *")))
    unit = F.when(F.col("n") == "drop-unit", F.lit(None)).when(F.col("n") == "convert-unit", F.col("to.unit")).when(F.col("n") == "sloppy-unit", _any_of(u("spelling"), F.col("spelt"))).otherwise(F.col("unit"))
    return x.select(
        "patient", "slug",
        F.when(F.col("c") == "unresolvable-code", UNRESOLVABLE).when(F.col("c") == "local-code", F.col("other")).otherwise(F.col("code")).alias("code"),
        F.when(F.col("t").isNotNull(), _any_of(u("text"), texts)).otherwise(value.cast("string")).alias("value_text"), unit.alias("unit"),
        F.when(F.col("d").isNotNull(), F.col("days_ago") + _between(u("days"), *BACKDATE)).otherwise(F.col("days_ago")).alias("days_ago"),
        F.array_compact(F.array("c", "n", "t", "d")).alias("log"),
    )


def mess_medications(rows: DataFrame, seed: int, rates: dict | None = None) -> DataFrame:
    """``rows`` with ``copy``: 0, or 1 and 2 for the repeats that a careless join of two systems leaves.

    rows: patient, seq, days_ago, and any other columns.  A copy is up to six days older than its
    original; the copy of an undated row stays undated.
    """
    r = {**RATES, **(rates or {})}
    w = Window.partitionBy("patient")
    u = lambda *name: draw(seed, F.col("patient"), "mess:medications", *name)
    i, n = free(rows, "__i", "__n")
    numbered = rows.withColumns({i: F.row_number().over(w.orderBy("seq")) - 1, n: F.count(F.lit(1)).over(w)})
    many = F.when(u("duplicate") < r["duplicate"], _between(u("copies"), 1, 2)).otherwise(0)
    picked = F.filter(F.array(F.lit(1), F.lit(2)), lambda k: (k <= many) & (F.floor(u("pick", k.cast("string")) * F.col(n)) == F.col(i)))
    out = numbered.withColumn("copy", F.explode(F.concat(F.array(F.lit(0)), picked)))
    days = F.col("days_ago") + F.when(F.col("copy") > 0, _between(u("days", F.col("copy").cast("string")), 0, 6)).otherwise(0)
    return out.withColumn("days_ago", days.cast(rows.schema["days_ago"].dataType)).drop(i, n)


def mess_conditions(rows: DataFrame, seed: int, rates: dict | None = None) -> DataFrame:
    """``rows`` (patient, days_ago, and any other columns) with all onsets of some patients moved back alike; an undated one counts as of today there."""
    r = {**RATES, **(rates or {})}
    u = lambda name: draw(seed, F.col("patient"), "mess:conditions", name)
    moved = F.coalesce("days_ago", F.lit(0)) + _between(u("days"), 20, 200)
    return rows.withColumn("days_ago", F.when(u("backdate") < r["backdate"], moved).otherwise(F.col("days_ago")).cast(rows.schema["days_ago"].dataType))


#: Facts of a heart-failure patient that records lack (name, low, high), and codes that are filled in.
HF_FACTS = (("lvef", 15.0, 60.0), ("bnp", 100.0, 2500.0), ("nt_probnp", 300.0, 9000.0))
HF_ALWAYS = (("days_since_index_event", 0.0, 90.0), ("hf_duration_months", 1.0, 120.0), ("symptom_duration_days", 1.0, 60.0))


def heart_failure_facts(patients: DataFrame, seed: int) -> DataFrame:
    """(patient, fact, value) to add to heart-failure patients (patient, has array of fact names).

    Gaps are filled from draws that depend on the patient alone; facts that are recorded stay, and the
    index and duration facts are always written.  Native: a keyed hash gives each draw.
    """

    def draw(name: str, low: float, high: float):
        u = F.pmod(F.xxhash64(F.lit(seed), "patient", F.lit(name)), F.lit(1 << 30)) / float(1 << 30)
        return round_half_up(u * (high - low) + low)

    facts = [F.when(~F.array_contains("has", n), F.struct(F.lit(n).alias("fact"), draw(n, a, b).alias("value"))) for n, a, b in HF_FACTS]
    facts += [F.struct(F.lit(n).alias("fact"), draw(n, a, b).alias("value")) for n, a, b in HF_ALWAYS]
    return patients.select("patient", F.explode(F.array_compact(F.array(*facts))).alias("f")).select("patient", "f.fact", "f.value")


def op_counts(logged: DataFrame) -> DataFrame:
    """(op, n, patients) of what a log column lists."""
    rows = logged.select("patient", F.explode("log").alias("op"))
    return rows.groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("patient").alias("patients"))
