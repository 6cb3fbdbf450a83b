"""Bundle files: found, split into entries, and read whole where the word "resource" isn't only a key."""

import json

import pytest

from cohortlens.operators import ingest


def bundle(pid, n, extra=None):
    obs = [{"resource": {"resourceType": "Observation", "id": str(i), "code": {"coding": [{"system": "http://loinc.org", "code": "718-7", "display": 'a "resource": {'}]}, "effectiveDateTime": f"2020-01-{i % 28 + 1:02d}", "valueQuantity": {"value": i, "unit": "g/dL"}}} for i in range(n)]
    return {"resourceType": "Bundle", "entry": [{"resource": {"resourceType": "Patient", "id": pid, "birthDate": "1950-05-05", "gender": "female"}}, *obs, *(extra or [])]}


def test_bundles_are_found_and_split(spark, tmp_path):
    root = tmp_path / "corpus"
    (root / "fhir").mkdir(parents=True)
    (root / "x.json").write_text("{}")
    with pytest.raises(FileNotFoundError):
        ingest.find_bundles(spark, str(tmp_path / "none"))
    assert ingest.find_bundles(spark, str(root)) == str(root)
    odd = [{"resource": {"resourceType": "Condition", "id": "c", "status": "resource", "code": {"coding": []}}}]
    nested = [{"resource": {"resourceType": "Condition", "id": "c", "contained": [{"entry": [{"resource": {"resourceType": "Patient", "id": "inner"}}]}], "onsetDateTime": "2020-02-01"}}]
    for name, b, indent in (("a", bundle("aaaaaaaa-1", 400), None), ("b", bundle("bbbbbbbb-1", 3), 2), ("c", bundle("cccccccc-1", 2, odd), None), ("d", bundle("dddddddd-1", 1, nested), 1), ("e", {"resourceType": "Bundle", "entry": []}, None)):
        (root / "fhir" / f"{name}.json").write_text(json.dumps(b, indent=indent))
    path = ingest.find_bundles(spark, str(root))
    assert path == f"{root}/fhir"
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # the first bundle takes many tasks
    try:
        rows = ingest.read_resources(spark, path)
        assert rows.rdd.getNumPartitions() > 5
        got = sorted((r.patient, r.r.resourceType, r.r.id, str(r["at"])) for r in rows.collect())
        flat = {r.patient: r for r in ingest.flatten_resources(rows, "2024-01-01").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = sorted((r.patient, r.r.resourceType, r.r.id, str(r["at"])) for r in ingest.resources(ingest.read_bundles(spark, path)).where("r IS NOT NULL").collect())
    assert len(want) == 401 + 4 + 4 + 3
    inner = [g for g in got if g[2] == "inner"]
    assert [g for g in got if g not in inner] == want
    assert {p: r.labs["hemoglobin"]["value"] for p, r in flat.items()} == {r.patient: r.labs["hemoglobin"]["value"] for r in ingest.flatten(ingest.read_bundles(spark, path), "2024-01-01").collect()}
