"""A batch of requests as a stream: results are reconciled as they arrive, and what is open after a day expires.

Events are rows (custom_id, kind, status, at): kind ``request``, ``result`` or ``clock``.  Ids are dealt into
lots; the keyed state of a lot holds what each of its open ids was asked and answered (two numbers and two
flags), and when it expires: the event time of its first event plus the patience of the batch.  When the
watermark passes that, the id's verdict is emitted once and it leaves the state, so the state never outgrows
a day of requests.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "custom_id string, kind string, status string, at timestamp"
DAY_MS = 24 * 60 * 60 * 1000


#: Lots that ids are dealt into by their hash; one call of the state function serves all ids of a lot.
LOTS = 4096
_STATE = "ids array<string>, asked array<boolean>, n array<long>, failed array<boolean>, due array<long>"


def _problems(x: pd.DataFrame) -> pd.DataFrame:
    """(custom_id, problem) of expired ids that have one."""
    problem = pd.Series("failed", index=x.index).where(x["failed"], None)
    problem = problem.mask(x["n"] > 1, "duplicate").mask(x["n"] == 0, "missing").mask(~x["asked"], "unexpected")
    return pd.DataFrame({"custom_id": x["custom_id"], "problem": problem})[problem.notna()]


def reconcile_stream(events: DataFrame, patience_ms: int = DAY_MS, delay: str = "0 seconds") -> DataFrame:
    """(custom_id, problem): missing, unexpected, repeated or failed results, each once, when their time is over.

    Defined results: events without an id (the clock's) only move the watermark; an id without a problem
    gives no row; an event that is later than the watermark is not looked at any more.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if key[0] < 0:  # the clock
            return
        now = state.getCurrentWatermarkMs()
        ids, asked, n, failed, due = map(list, state.get) if state.exists else ([], [], [], [], [])
        parts = [pd.DataFrame({"custom_id": ids, "asked": asked, "n": n, "failed": failed, "due": due}).astype({"custom_id": object, "asked": bool, "n": "int64", "failed": bool, "due": "int64"})]
        touched: set = set()
        for b in [] if state.hasTimedOut else batches:
            result = b["kind"] == "result"
            at = (b["at"] - pd.Timestamp(0)) // pd.Timedelta(milliseconds=1)
            parts.append(pd.DataFrame({"custom_id": b["custom_id"], "asked": b["kind"] == "request", "n": result.astype("int64"), "failed": result & (b["status"] != "succeeded"), "due": at.astype("int64") + patience_ms}))
            touched.update(b["custom_id"])
        open_ids = pd.concat(parts).groupby("custom_id", sort=False).agg({"asked": "max", "n": "sum", "failed": "max", "due": "min"}).reset_index()
        over = (open_ids["due"] < now) & ~open_ids["custom_id"].isin(touched)
        left = open_ids[~over]
        if left.empty:
            state.remove()
        else:
            state.update(tuple(left[c].tolist() for c in ("custom_id", "asked", "n", "failed", "due")))
            state.setTimeoutTimestamp(max(int(left["due"].min()), now + 1))
        if over.any():
            yield _problems(open_ids[over])

    lot = F.when(F.col("custom_id").isNull(), -1 - F.spark_partition_id()).otherwise(F.pmod(F.xxhash64("custom_id"), F.lit(LOTS)).cast("int"))
    timed = events.withWatermark("at", delay).where("custom_id IS NOT NULL OR kind = 'clock'").withColumn("lot", lot)
    return timed.groupBy("lot").applyInPandasWithState(step, "custom_id string, problem string", _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_batch(spark: SparkSession, path: str, out: str, checkpoint: str, patience_ms: int = DAY_MS, step_bytes: int | None = None) -> StreamingQuery:
    """Reconciles the event files of a folder (Parquet, oldest first), writes Parquet at ``out``, and ends.

    One file a step, or with ``step_bytes`` as many as hold so much: each step has its own tasks and state
    files, so a batch in many files takes few steps.  Time-outs come between steps only.
    """
    most = ("maxBytesPerTrigger", step_bytes) if step_bytes else ("maxFilesPerTrigger", 1)
    events = spark.readStream.schema(EVENTS).option(*most).parquet(path)
    return reconcile_stream(events, patience_ms).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
