"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; one of our own only where it is unset."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if got.isDefined():
            return got.get()
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="cohortlens-")
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _OWN:
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended
            return


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table that :func:`new_path` named, once nothing reads it any more."""
    _delete(spark, path)
    _OWN[:] = [x for x in _OWN if x[1] != path]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _OWN.append((spark, path))
    return path


def save(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Cut the lineage: write ``df`` to the shared folder and read it again, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


class Tables:
    """Intermediate tables of one job, freed together once what they lead to is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        self.drop()

    def save(self, df: DataFrame, name: str) -> DataFrame:
        out, path = save(df, name)
        self.paths.append(path)
        return out

    def drop(self) -> None:
        for path in self.paths:
            drop_table(self.spark, path)
        self.paths.clear()


class since:
    """Knows the tables that are made from its beginning on, to free them when their reader is written."""

    def __enter__(self) -> since:
        self.before = {path for _, path in _OWN}
        return self

    def __exit__(self, *_) -> None:
        pass

    def free(self, spark: SparkSession, keep: str) -> None:
        for _, path in list(_OWN):
            if path not in self.before and path != keep:
                drop_table(spark, path)


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like those wanted that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def row_key(*cols: Column) -> list[Column]:
    """128-bit key of a row's own content: rows with equal keys have equal content, and so equal results."""
    return [F.xxhash64(*cols).alias("k1"), F.xxhash64(F.lit(7), *reversed(cols)).alias("k2")]


def document_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """:func:`row_key` of a document's id and text."""
    return row_key(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shards(df: DataFrame, key: str, n: int) -> tuple[Column, list]:
    """Contiguous, roughly even ranges of an integer key.

    Reads only the key column.  Returns the range number as an expression (a null key sorts
    first) and the bounds, at most ``n - 1`` of them whatever the input's size.
    """
    qs = df.select(F.col(key).cast("double").alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    bounds = sorted({int(q) for q in qs})
    if not bounds:
        return F.lit(0), []
    arr = F.array(*[F.lit(b).cast("long") for b in bounds])
    pid = F.coalesce(F.size(F.filter(arr, lambda b: b <= F.col(key))), F.lit(0))
    return F.when(F.col(key).isNull(), F.lit(0)).otherwise(pid), bounds
