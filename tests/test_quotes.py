"""Quotes against a plain search."""

import random

from pyspark.sql import functions as F

from cohortlens.operators import quotes


def test_quotes_against_search(spark):
    rnd = random.Random(4)
    words = ["the", "of", "a", "cat", "dog", "é", "long-word", "x\ny", ""]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    docs = [(i, text(rnd.randint(0, 60))) for i in range(60)] + [(100, None), (101, ""), (102, "the of a " * 3000), (7, "the cat of the dog"), (103, "end\r\nline of text")]
    cut = lambda t: t[(i := rnd.randint(0, max(0, len(t) - 1))) : i + rnd.randint(1, 60)]
    qs = [(i, cut(rnd.choice(docs[:60])[1] or "x")) for i in range(150)] + [(200, "the of a"), (201, "of"), (202, "e"), (203, " "), (204, None), (205, ""), (206, "absent words here"), (207, "he o"), (208, "the of a the of a the of a the of a the of a"), (209, "end\nline"), (201, "of"), (210, " the "), (211, "of the dog")]
    norm = lambda t: t.replace("\r\n", "\n")
    want = {(i, d) for i, q in qs if q and q.strip() for d, t in docs if t is not None and norm(q) in norm(t)}
    q = spark.createDataFrame(qs, "id int, quote string").withColumn("w", F.lit(1))
    d = spark.createDataFrame(docs, "doc int, text string").withColumn("h", F.lit(1))
    for common in (1, 5, 10_000):
        got = [(r.id, r.doc) for r in quotes.quote_hits(q, d, common=common).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert quotes.quote_hits(q.limit(0), d).count() == 0 and quotes.quote_hits(q, d.limit(0)).count() == 0
