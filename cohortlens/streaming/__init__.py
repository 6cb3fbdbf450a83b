"""A compiled rule set over a stream of patients: every criterion looks at one row, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cohortlens.model import FactModel, RuleSet
from cohortlens.operators.evaluate import evaluate


def screen_stream(facts: DataFrame, rs: RuleSet, model: FactModel) -> DataFrame:
    """As ``evaluate``, for a streaming DataFrame of typed wide facts."""
    return evaluate(facts, rs, model)


def run_available(facts: DataFrame, rs: RuleSet, model: FactModel, path: str, checkpoint: str) -> StreamingQuery:
    """Screens what has arrived, writes Parquet at ``path``, and ends."""
    out = screen_stream(facts, rs, model)
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
