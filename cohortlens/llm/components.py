"""Connected components of a large graph by alternating large-star and small-star steps.

Defined results: a graph without links has no rows; loops and repeated links change nothing; ids may
be any longs but null, and links with a null end are ignored; a node without a link is not listed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import drop_table, save


def _star(edges: DataFrame) -> DataFrame:
    """(node, least of its neighbours) joined back to the neighbours."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a")


def connected_components(edges: DataFrame) -> tuple[DataFrame, str]:
    """(node, component) for every node with a link, and the path of the table behind it; the component is its least node.

    edges: (a long, b long), any order, loops and repeats allowed.  Nothing but a count and a
    checksum reaches the driver.  Each step writes its links to the shared folder, so that a lost
    executor repeats one step at most; the number of steps is about the logarithm of a component's
    diameter.
    """
    now, path = save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both).where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).where("a > b").distinct()
        grown = _star(large)
        small = grown.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        small = small.unionByName(grown.select("a", F.col("m").alias("b"))).where("a > b").distinct()
        nxt, nxt_path = save(small, "links")
        drop_table(now.sparkSession, path)
        now, path = nxt, nxt_path
        got = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).collect()[0]
        if (got.n, got.h) == mark:
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots), path
        mark = (got.n, got.h)
