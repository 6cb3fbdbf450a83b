"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_MADE: list[tuple[SparkSession, str]] = []


@atexit.register
def _clean() -> None:
    for spark, path in _MADE:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended
            return


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path, deleted when the driver ends, in the folder that ``spark.checkpoint.dir`` names; in one of our own only in local mode without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="cohortlens-")
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: what several branches of a plan read is computed once, and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
