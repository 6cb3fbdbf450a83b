"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortlens.llm import decontaminate, doc_fingerprint, html_extract, packing, pii, quality, simhash, substring_dedup, token_align, token_counts, token_file, url_filter, vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_array_dedup": substring_dedup.op1,
        "op2_url_filters": url_filter.op2,
        "op3_document_fingerprints": doc_fingerprint.op3,
        "op4_token_counts": token_counts.op4,
        "op5_simhash_near_dedup": simhash.op5,
        "op6_pii_surrogates": pii.op6,
        "op7_quality_classifier": quality.op7,
        "op8_benchmark_decontamination": decontaminate.op8,
        "op9_token_file": token_file.op9,
        "op10_best_fit_packing": packing.op10,
        "op11_vector_codes": vector_codes.op11,
        "op12_token_alignment": token_align.op12,
        "op13_html_extraction": html_extract.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": url_filter.OP2_SQL}
