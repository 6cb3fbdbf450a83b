"""What the review of round 4 found, each in small."""

import random

from pyspark.sql import functions as F

from cohortlens.llm import decontaminate, packing


def test_windows_are_rows_with_their_shingles(spark, monkeypatch):
    """tables of single shingles pack so well that one task reads millions; there is one row a window, and none of single hits."""
    passage = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(k, f"a b c {passage} d e") for k in range(4)], "doc_id long, text string")
    rows = {}
    save = decontaminate.Tables.save
    monkeypatch.setattr(decontaminate.Tables, "save", lambda self, df, name: rows.setdefault(name, save(self, df, name)))
    counts = {}
    monkeypatch.setattr(decontaminate.Tables, "drop", lambda self: counts.update({k: v.count() for k, v in rows.items()}))
    got = decontaminate.contamination(docs, spark.createDataFrame([(7, passage)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_items, r.similarity) for r in got) == [(k, 1, 1.0) for k in range(4)]
    assert counts["window-shingles"] == counts["windows"] and "hits" not in counts


def test_fingerprints_count_bits_in_the_row(spark):
    """the bits that more than half of the hashes have set, for short and long windows; repeated hashes count each time."""
    rnd = random.Random(4)
    lists = [[rnd.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (1, 2, 3, 38, 127, 128, 700)]
    lists += [[-1] * 127, [-1] * 128, [0] * 5, [5, 5, 5, -7, -7], [x for x in lists[3] for _ in range(9)]]
    want = []
    for x in lists:
        bits = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in x) > len(x))
        want.append(bits - (1 << 64) if bits >> 63 else bits)
    df = spark.createDataFrame(list(enumerate(lists)), "i int, sh array<long>")
    assert [r.fp for r in df.select("i", decontaminate._fingerprint(F.col("sh")).alias("fp")).orderBy("i").collect()] == want
    sets = [r.s for r in df.select("i", decontaminate._numbered(F.col("sh")).alias("s")).orderBy("i").collect()]
    assert all(len(set(s)) == len(x) and set(x) <= set(s) for s, x in zip(sets, lists, strict=True))


def test_best_exchange_is_found_without_trying_all():
    """the exchange that fills another pattern most, as trying each with each finds it."""
    rnd = random.Random(5)
    for _ in range(60):
        size = rnd.choice([12, 40, 1024])
        keys = {tuple(sorted((rnd.randint(1, size // 2) for _ in range(rnd.randint(1, 5))), reverse=True)) for _ in range(rnd.randint(1, 25))}
        loose = sorted((sum(k), k) for k in keys if sum(k) < size)
        for at, (fill, src) in enumerate(loose):
            for alone in (True, False):
                gifts = [(y,) for y in src] + [(src[i], src[j]) for i in range(len(src)) for j in range(i)]
                others = [(f, k) for f, k in loose if f >= fill and not (alone and k == src)]
                gains = [sum(g) - x for f, k in others for g in gifts for x in ((0, *k) if len(g) == 1 else k) if 0 < sum(g) - x <= size - f]
                got = packing._Loose(loose, size).best_exchange(at, alone)
                assert (got is None) == (not gains)
                if got:
                    dst, out, back = got
                    assert sum(out) - sum(back) == max(gains) <= size - sum(dst) and set(back) <= set(dst) and (sum(dst), dst) in others
