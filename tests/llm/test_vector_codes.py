"""Vector codes against plain integers."""

import collections
import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from cohortlens.llm import vector_codes
from cohortlens.llm.common import Tables

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [(i, v, c) for i, v, c in rows if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return {}, None
    dim = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == dim]
    width = dim // parts
    cut = [[tuple(math.floor(256 * x) for x in v[p * width : (p + 1) * width]) for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def near(book, x):
        each = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in book]
        return each.index(min(each)), min(each)

    for _ in range(rounds):
        for p in range(parts):
            groups = collections.defaultdict(list)
            for c in cut:
                groups[near(books[p], c[p])[0]].append(c[p])
            for k, g in groups.items():
                books[p][k] = [sum(x) // len(g) for x in zip(*g, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by_label = [], collections.Counter()
    for (i, _, label), c in zip(kept, cut, strict=True):
        each = [near(books[p], c[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for k, _ in each), sum(d for _, d in each), label))
        by_label[label] += out[-1][2]
    return collections.Counter((i, code, min(e, 2**63 - 1), min(by_label[label], 2**63 - 1)) for i, code, e, label in out), sha


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).select("*", F.lit("x").alias("code"), F.lit(1).alias("__v"), F.lit(2).alias("error"))
    tables = Tables(spark)
    coded, books = vector_codes.vector_codes(df.repartition(3), tables, **kw)
    got = vector_codes.with_label_error(coded, tables)
    return collections.Counter((r.vec_id, r.code, r.error, r.label_error) for r in got.collect()), books.sha256() if books else None


def vectors(n, seed, scale=1.0, dim=64):
    rnd = np.random.default_rng(seed)
    return [[float(np.float32(x)) for x in v] for v in rnd.normal(0, scale, (n, dim))]


def test_codes_against_plain_integers(spark):
    rows = [(i, v, i % 3 if i % 4 else None) for i, v in enumerate(vectors(150, 1))]
    rows += [(i, v, 9) for i, v in enumerate(vectors(40, 2), 200)] * 2  # repeated rows
    rows += [(300, None, 1), (301, [None] * 64, 1), (302, [float("nan")] * 64, 1), (303, [float("inf")] + [0.0] * 63, 1), (304, [], 1), (305, [1.0] * 32, 1), (None, rows[5][1], None), (7, rows[9][1], 2)]
    rows += [(400 + i, [0.5] * 64, 5) for i in range(5)]  # ties
    assert run(spark, rows) == brute(rows)


def test_few_rows_ties_and_empty(spark):
    assert run(spark, []) == (collections.Counter(), None)
    rows = [(3, [0.0] * 64, None), (1, [1.0] * 64, None), (2, [0.0] * 64, 1)]
    assert run(spark, rows) == brute(rows)
    rows = [(i, [float(x) for x in np.random.default_rng(i).integers(-2, 3, 16)], i % 2) for i in range(200)]  # one component a part, many ties
    assert run(spark, rows) == brute(rows)


def test_components_beyond_int64(spark):
    rows = [(i, [float(np.float32(x)) for x in np.random.default_rng(i).normal(0, 10.0 ** (i % 39), 16)], 1) for i in range(80)]
    assert run(spark, rows) == brute(rows)


def test_screening_keeps_near_ties():
    rnd = np.random.default_rng(3)
    base = rnd.integers(-(1 << 20), 1 << 20, (1, 64, 4))
    base[0, 1:] = base[0, :1] + rnd.integers(-1, 2, (63, 4))  # float32 cannot tell these apart
    v = base[0, :1] + rnd.integers(-500, 500, (300, 1, 4))
    v = np.clip(v, -(1 << 20), 1 << 20)
    book = vector_codes.Codebooks(base)
    index, dist = book.nearest(v.astype(np.int64))
    exact = ((v[:, 0, None, :] - base[0][None]) ** 2).sum(axis=2)
    assert (index[:, 0] == exact.argmin(axis=1)).all() and (dist[:, 0] == exact.min(axis=1)).all()
