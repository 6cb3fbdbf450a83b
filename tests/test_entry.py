import __spark_entry__ as entry


def test_names_match():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and "overall_counts" in q


def test_entry(spark):
    assert {r.overall for r in entry.entry(spark).collect()} == {"eligible", "ineligible", "undetermined"}


def test_nothing_else_imports_the_llm_subpackage():
    import pathlib

    top = pathlib.Path(entry.__file__).parent
    for p in (top / "cohortlens").rglob("*.py"):
        if "llm" not in p.relative_to(top).parts:
            assert "cohortlens.llm" not in p.read_text() and "corpus_pipeline" not in p.read_text(), p
