"""Which documents hold which quotes verbatim, by equi-joins of word runs.

Words are what stands between single spaces; a quote's first and last word may touch what stands beside
it, its inner words are whole words of a document.  A quote is filed under its rarest inner run of eight
words at most, by how often its runs occur in the documents; a quote whose rarest run is still common is
filed under all of itself: its inner words with the end of the word before and the head of the word
after them, as long as its own.  Quotes of two words have such ends only, and one word is sought inside
words.  So no key that many quotes or documents share is joined, and pairs hardly outnumber hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.ground import newlines
from cohortlens.sources.shared import shared_path

#: Words of a run at most, and occurrences above which a run is common.
RUN, COMMON = 8, 200


def _run(words: Column, at: Column, k: Column) -> Column:
    """Hash of k words from place ``at`` (from 1)."""
    return F.xxhash64(F.array_join(F.slice(words, at, k), " "))


def _ends(words: Column, i: Column, k: Column, a: Column, b: Column) -> Column:
    """Hash of the last ``a`` characters of word i (from 0), the k words after it, and the first ``b`` of the next."""
    tail = lambda x, n: F.when(n > 0, F.right(x, n)).otherwise("")
    return F.xxhash64(tail(F.get(words, i), a), F.array_join(F.slice(words, i + 2, k), " "), F.left(F.get(words, i + k + 1), b))


def _numbers(upto: Column, first: int) -> Column:
    """first … upto, or none."""
    return F.when(upto >= first, F.sequence(F.lit(first), upto))


def quote_hits(quotes: DataFrame, docs: DataFrame, id_col: str = "id", quote_col: str = "quote", doc_col: str = "doc", text_col: str = "text", common: int = COMMON) -> DataFrame:
    """(id, doc) of each quote and document that holds it, line ends apart.

    Defined results: null and blank quotes, and null texts, are in no pair; repeated rows give a pair once.
    """
    spark = docs.sparkSession
    q = quotes.select(F.col(id_col).alias("id"), newlines(F.col(quote_col)).alias("quote")).where(F.length(F.trim(F.regexp_replace("quote", r"\s", " "))) > 0)
    q = q.withColumn("w", F.split("quote", " ")).withColumn("inner", F.size("w") - 2)
    d = docs.select(F.col(doc_col).alias("doc"), newlines(F.col(text_col)).alias("text")).where("text IS NOT NULL").withColumn("w", F.split("text", " "))

    # occurrences of the quotes' runs, by document
    long = q.where("inner >= 1").withColumn("k", F.least("inner", F.lit(RUN)))
    keys = long.select("id", "k", "w", F.explode(_numbers(F.size("w") - F.col("k"), 2)).alias("at")).select("id", "k", _run(F.col("w"), F.col("at"), F.col("k")).alias("h"))
    ks = sorted(r.k for r in keys.select("k").distinct().collect())  # eight at most
    runs = d.select("doc", "w", F.explode(F.array(*map(F.lit, ks or [1]))).alias("k")).select("doc", "k", "w", F.explode(_numbers(F.size("w") - F.col("k") + 1, 1)).alias("at"))
    runs = runs.select("doc", "k", _run(F.col("w"), F.col("at"), F.col("k")).alias("h"))
    held_at = shared_path(spark, "quote-runs")
    runs.join(keys.select("k", "h").distinct(), ["k", "h"]).groupBy("doc", "k", "h").agg(F.count(F.lit(1)).alias("n")).write.parquet(held_at)
    held = spark.read.parquet(held_at)
    often = held.groupBy("k", "h").agg(F.sum("n").alias("n"))
    rarest = keys.join(often, ["k", "h"], "left").groupBy("id").agg(F.min_by(F.struct("k", "h"), F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h")).alias("key"), F.min(F.coalesce("n", F.lit(0))).alias("n"))
    found = held.join(rarest.where(F.col("n").between(1, common)).select("id", "key.k", "key.h"), ["k", "h"]).select("id", "doc")

    # quotes of common runs, and those of two words: under all of themselves
    whole = q.where("inner = 0").unionByName(long.drop("k").join(rarest.where(F.col("n") > common).select("id"), "id", "left_semi"))
    whole = whole.select("id", F.col("inner").alias("k"), F.length(F.get("w", F.lit(0))).alias("a"), F.length(F.element_at("w", -1)).alias("b"), _ends(F.col("w"), F.lit(0), F.col("inner"), F.length(F.get("w", F.lit(0))), F.length(F.element_at("w", -1))).alias("h"))
    shapes = [tuple(r) for r in whole.select("k", "a", "b").distinct().collect()]  # word counts and lengths of end words of short quotes
    if shapes:
        shape = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, a, b in shapes])).alias("s")
        spots = d.select("doc", "w", shape).select("doc", "w", "s.*").select("doc", "k", "a", "b", "w", F.explode(_numbers(F.size("w") - F.col("k") - 2, 0)).alias("i"))
        spots = spots.where((F.length(F.get("w", F.col("i"))) >= F.col("a")) & (F.length(F.get("w", F.col("i") + F.col("k") + 1)) >= F.col("b")))
        spots = spots.select("doc", "k", "a", "b", _ends(F.col("w"), F.col("i"), F.col("k"), F.col("a"), F.col("b")).alias("h"))
        found = found.unionByName(spots.join(whole, ["k", "a", "b", "h"]).select("id", "doc"))

    # quotes of one word: inside words
    one = q.where("inner = -1").select("id", F.length("quote").alias("n"), F.xxhash64("quote").alias("h"))
    sizes = sorted(r.n for r in one.select("n").distinct().collect())
    if sizes:
        words = d.select("doc", F.explode(F.array_distinct("w")).alias("x")).select("doc", "x", F.explode(F.array(*map(F.lit, sizes))).alias("n")).where(F.length("x") >= F.col("n"))
        parts = words.select("doc", "n", "x", F.explode(_numbers(F.length("x") - F.col("n") + 1, 1)).alias("at")).select("doc", "n", F.xxhash64(F.substring("x", F.col("at"), F.col("n"))).alias("h"))
        found = found.unionByName(parts.join(one, ["n", "h"]).select("id", "doc"))

    pairs = found.distinct()
    texts = pairs.join(q.select("id", "quote"), "id").join(d.select("doc", "text"), "doc")
    return texts.where(F.contains("text", F.col("quote"))).select("id", "doc").distinct()
