"""Global order numbers without a window over everything."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.names import free

#: Values that the ranges' bounds are chosen from, those of least hash.
SAMPLE = 4096


def numbered(df: DataFrame, by: str, *ties: str, name: str = "place", ranges: int | None = None) -> DataFrame:
    """Adds ``name``: 0, 1, 2 … in the order of ``by`` (a string, nulls first), then of ``ties``.

    The rows are put into ranges by bounds that are chosen from a bounded sample, the sizes of the ranges
    (one number for each) are summed, and each range is numbered by itself from there on.  Bounds and
    numbers depend on the values alone, not on how the rows are partitioned, so a recomputed task gives
    the same numbers.  Rows that are equal in ``by`` and ``ties`` may take each other's number.  A value
    that holds much of the table is split among ranges as far as its rows' ``ties`` differ.
    """
    spark = df.sparkSession
    ranges = ranges or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [by, *ties]
    hashed = df.select(*keys).where(F.col(by).isNotNull()).distinct().orderBy(F.xxhash64(*keys), *keys).limit(SAMPLE)
    sample = sorted((tuple(r) for r in hashed.collect()), key=lambda r: tuple((x is not None, x) for x in r))
    bounds = [sample[i * len(sample) // ranges] for i in range(1, ranges)] if sample else []
    bounds = sorted(set(bounds), key=lambda r: tuple((x is not None, x) for x in r))
    types = [df.schema[k].dataType for k in keys]
    told = lambda rows: F.array(*[F.struct(*[F.lit(x).cast(t).alias(k) for k, x, t in zip(keys, r, types, strict=True)]) for r in rows])
    own = F.struct(*keys)  # structs compare key by key, nulls first
    upto = lambda rows: F.size(F.filter(rows, lambda b: b <= own))
    # how many bounds are at or below a row: first among the last bounds of steps, then within one step
    step = max(1, math.isqrt(len(bounds)))
    whole = upto(told(bounds[step - 1 :: step])) * step
    lot = whole + upto(F.slice(told(bounds), whole + 1, F.lit(step))) if bounds else F.lit(0)
    (lots,) = free(df, "__lot")
    dealt = df.withColumn(lots, lot)
    sizes = {r[0]: r[1] for r in dealt.groupBy(lots).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for k in range(len(bounds) + 1):
        before.append(total)
        total += sizes.get(k, 0)
    at = F.row_number().over(Window.partitionBy(lots).orderBy(*[F.asc_nulls_first(k) for k in keys]))
    return dealt.withColumn(name, F.get(F.array(*[F.lit(b).cast("long") for b in before]), F.col(lots)) + at - 1).drop(lots)
