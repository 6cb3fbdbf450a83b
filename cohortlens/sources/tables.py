"""Readers of rule documents, patients, notes and recordings as DataFrames."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.facts import from_variant
from cohortlens.model import FactModel
from cohortlens.sources import documents as D
from cohortlens.sources.file_order import numbered

RECORDING = "doc string, model string, promptId string, schemaId string, recordedAt string, output string, requestHash string, promptHash string, schemaHash string"


def read_files(spark: SparkSession, path: str, glob: str = "*.yaml") -> DataFrame:
    """(name, content, hash) of the files of a folder, whatever store it is in."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").cast("string").alias("content"), F.sha2("content", 256).alias("hash"))


def _parsed(files: DataFrame, parse, keys: tuple[str, ...]) -> DataFrame:
    """Adds one JSON column for each key of the parsed document, and ``problems`` where it can't be parsed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in (*keys, "problems")]
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    x, bad = parse(text, name), None
                except D.DocumentError as e:
                    x, bad = {}, e.problems
                for c, k in zip(cols, keys, strict=False):
                    v = x.get(k)
                    c.append(v if isinstance(v, str) or v is None else json.dumps(v))
                cols[-1].append(bad)
            arrays = [pa.array(c, pa.string()) for c in cols[:-1]] + [pa.array(cols[-1], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names=["name", *keys, "problems"])

    return files.select("name", "content").mapInArrow(run, "name string, " + ", ".join(f"`{k}` string" for k in keys) + ", problems array<string>")


def read_patients(files: DataFrame) -> DataFrame:
    """(name, patient, facts VARIANT, problems)."""
    return _parsed(files, lambda t, n: D.parse_patient(t), ("patient", "facts")).withColumn("facts", F.try_parse_json("facts"))


def read_notes(files: DataFrame) -> DataFrame:
    """(name, doc, patient, kind, date, trap, body, problems)."""
    return _parsed(files, D.parse_note, ("doc", "patient", "kind", "date", "trap", "body"))


def notes_in_order(notes: DataFrame) -> DataFrame:
    """(place, doc, patient, body) of readable notes, numbered in the lexical order of their files' names (``file_order.numbered``)."""
    return numbered(notes.where("problems IS NULL").select("name", "doc", "patient", "body"), "name", "doc").drop("name")


def read_facts_files(files: DataFrame) -> DataFrame:
    """(name, patient, asOf, problems, place, entry struct): one row for each entry, with its place in the file."""
    entry = "array<struct<fact:string,value:variant,unit:string,status:string,confidence:double,extractedBy:string,source:struct<doc:string,quote:string>,measuredAt:string,validWithinDays:int,reviewedBy:string,reviewedAt:string>>"
    rows = _parsed(files, lambda t, n: D.parse_facts_file(t), ("patient", "asOf", "facts"))
    return rows.select("name", "patient", "asOf", "problems", F.posexplode_outer(F.from_json("facts", entry)).alias("place", "entry"))


def load_fact_model(spark: SparkSession, path: str | None = None) -> FactModel:
    """The fact model that every consumer uses: of the file at ``path``, or else at the session setting ``cohortlens.factModel``."""
    path = path or spark.conf.get("cohortlens.factModel", None)
    if not path:
        raise ValueError("name a fact model, or set cohortlens.factModel")
    (row,) = read_files(spark, path, "*").collect()
    return D.parse_fact_model(row.content)


def duplicate_documents(notes: DataFrame) -> DataFrame:
    return notes.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def facts_wide(patients: DataFrame, model: FactModel, only: list[str] | None = None) -> DataFrame:
    """(patient, one typed column per declared fact): the checked boundary between VARIANT and rules."""
    names = only if only is not None else list(model.facts)
    return patients.select("patient", *[from_variant(F.col("facts"), n, model.facts[n]).alias(n) for n in names if n in model.facts])


def facts_long(patients: DataFrame) -> DataFrame:
    """(patient, fact, value VARIANT), undeclared facts included."""
    names = F.explode(F.map_entries(F.from_json(F.to_json("facts"), "map<string,variant>"))).alias("e")
    return patients.select("patient", names).select("patient", F.col("e.key").alias("fact"), F.col("e.value").alias("value"))


def cases_frame(spark: SparkSession, cases: list[dict]) -> DataFrame:
    """(patient, facts VARIANT) of a suite's cases, named by case."""
    rows = [(c["name"], json.dumps(c["facts"])) for c in cases]
    return spark.createDataFrame(rows, "patient string, facts string").withColumn("facts", F.try_parse_json("facts"))


def expectations_frame(spark: SparkSession, cases: list[dict]) -> DataFrame:
    return spark.createDataFrame([(c["name"], k, v) for c in cases for k, v in c["expect"].items()], "patient string, id string, expected string")


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    """Recorded responses, with ``valid``: every field is there and the hashes are hashes."""
    rows = spark.read.schema(RECORDING).option("multiLine", True).json(path)
    ok = F.col("doc").isNotNull() & F.col("output").isNotNull()
    for c in ("requestHash", "promptHash", "schemaHash"):
        ok = ok & F.coalesce(F.col(c).rlike("^[0-9a-f]{64}$"), F.lit(False))
    return rows.withColumn("valid", ok)


def matching(recordings: DataFrame, controls: dict[str, str]) -> DataFrame:
    """Valid recordings of exactly this request, prompt and schema (``sidecars.controls``); all others fail closed."""
    ok = F.col("valid")
    for k, v in controls.items():
        ok = ok & F.col(k).eqNullSafe(F.lit(v))
    return recordings.where(ok)


def read_legacy_recordings(spark: SparkSession, path: str) -> DataFrame:
    """Recordings of the older form, which is bound to no request: (doc, model, recordedAt, output, valid)."""
    rows = spark.read.schema("doc string, model string, promptHash string, recordedAt string, output string").option("multiLine", True).json(path)
    ok = F.col("promptHash").rlike("^[0-9a-f]{64}$")
    for c in ("doc", "model", "recordedAt", "output"):
        ok = ok & F.col(c).isNotNull()
    return rows.withColumn("valid", F.coalesce(ok, F.lit(False)))


def write_recordings(recordings: DataFrame, path: str) -> None:
    """Recorded responses as JSON, one envelope a line; reading them again gives the same rows."""
    recordings.drop("valid").write.mode("errorifexists").json(path)


def criterion_lines(spark: SparkSession, path: str) -> DataFrame:
    """(trial, kind, line) of criterion files named <trial>_inc.txt or <trial>_exc.txt."""
    from cohortlens.operators.classify import split_lines

    raw = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value")
    kind = F.when(F.regexp_extract("name", "_(inc|exc)\\.txt$", 1) == "inc", "inclusion").otherwise("exclusion")
    return raw.select(F.regexp_extract("name", "^(.*)_(?:inc|exc)\\.txt$", 1).alias("trial"), kind.alias("kind"), F.explode(split_lines(F.col("value"))).alias("line"))
