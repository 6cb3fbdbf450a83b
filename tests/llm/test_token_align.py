"""Token alignment against whole-text encoding by both libraries and plain loops."""

import collections
import hashlib
import random

import numpy as np
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from cohortlens.llm import token_align, tokens
from cohortlens.llm.common import Tables

PATHS = tokens.default_tokenizer(), token_align.default_pieces()
WORDS = ["the", "a", "of", "blick", "éa", "zorro", "in", "that", "<|endoftext|>", "<s>", "<0x41>", "don't", "x.y", "日本語", "A🙂b", " ", "tab\there", "line\nbreak", "zz%%%", "###", "café", "1234567", "\x00", "\x1c", "́e"]


def brute(rows):
    tok = Tokenizer.from_file(PATHS[0])
    tok.encode_special_tokens = True
    sp = SentencePieceProcessor(model_file=PATHS[1])
    back = {c: bytes([b]) for b, c in enumerate(tokens._byte_alphabet())}
    entry = {i: t for t, i in tok.get_vocab().items()}
    docs = []
    for i, text in rows:
        groups, links, n = [], [], (0, 0)
        if text:
            raw = b" " + text.encode()
            a = [(x, b"".join(back[c] for c in entry[x])) for x in tok.encode(" " + text, add_special_tokens=False).ids]
            b = [(x, bytes([int(sp.id_to_piece(x)[3:5], 16)]) if sp.is_byte(x) else sp.id_to_piece(x).replace("▁", " ").encode()) for x in sp.encode(text)]
            if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b):
                n = len(a), len(b)
                ends_a, ends_b = {}, {}
                for ends, toks in ((ends_a, a), (ends_b, b)):
                    at = 0
                    for k, (_, x) in enumerate(toks):
                        at += len(x)
                        ends[at] = k
                done = (0, 0)
                for at in sorted(set(ends_a) & set(ends_b)):
                    ka, kb = ends_a[at] + 1, ends_b[at] + 1
                    groups.append(",".join(str(x) for x, _ in a[done[0] : ka]) + "|" + ",".join(str(x) for x, _ in b[done[1] : kb]))
                    links.append((a[ka - 1][0], b[kb - 1][0]))
                    done = ka, kb
        docs.append((i, *n, groups, links))
    counts = collections.Counter(p for d in docs for p in d[4])
    most = collections.Counter()
    for (_, b), c in counts.items():
        most[b] = max(most[b], c)
    return collections.Counter((i, na, nb, len(g), len(ls), sum(counts[p] == most[p[1]] for p in ls), sum(counts[p] for p in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, na, nb, g, ls in docs)


def run(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("x").alias("links"), F.lit(1).alias("n_a")).repartition(parts)
    tables = Tables(spark)
    aligned = tables.save(token_align.align_tokens(df, *PATHS), "t")
    got = token_align.with_pair_counts(aligned, token_align.pair_counts(aligned, *PATHS), *PATHS)
    return collections.Counter(tuple(r) for r in got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


def rows_of(seed):
    rnd = random.Random(seed)
    gaps = [" "] * 12 + ["  ", "   ", "\n", " \n", "\t", "\n\n", ""]
    out = []
    for i in range(80):
        out.append((i, "".join(rnd.choice(WORDS) + rnd.choice(gaps) for _ in range(rnd.randint(0, 60)))))
    out += [(100, None), (101, ""), (102, " "), (103, "  "), (104, " x"), (105, "x "), (106, "\n"), (107, "a▁b c"), (108, "▁"), (None, out[3][1]), (None, None), (3, out[3][1]), (3, out[3][1])]
    out += [(109, "q" * 3000), (110, " ".join(rnd.choice(WORDS) for _ in range(20000))), (111, "日本" * 2000), (112, "a  b" * 3000), (113, "   lead and trail   "), (114, "ab" + "　" + "cd 　 ef")]
    return out


def test_alignment_against_whole_texts(spark):
    rows = rows_of(4)
    assert run(spark, rows) == brute(rows)


def test_memory_that_starts_anew(monkeypatch):
    import pyarrow as pa

    rows = rows_of(9)
    al = token_align.Aligner(*PATHS)
    texts = pa.array([t for _, t in rows])
    want = [(x.tolist() if isinstance(x, np.ndarray) else x) for part in al.align(texts) for x in part]
    monkeypatch.setattr(token_align, "MEMORY", 0)
    monkeypatch.setattr(token_align, "HASHED", 7)
    monkeypatch.setattr(token_align, "SLICE_BYTES", 500)
    parts = list(al.align(texts))
    assert len(parts) > 5
    assert [d for p in parts for d in p[5]] == want[5]
    assert np.concatenate([p[6] for p in parts]).tolist() == want[6]
    al.cuts = False
    parts = list(al.align(texts))
    assert [d for p in parts for d in p[5]] == want[5]


def test_ranks_of_cuts():
    cuts, a, b = token_align.cut_groups(np.array([1, 2, 61, 1, 70]), np.array([3, 30, 32, 70]))
    assert cuts.tolist() == [3, 65, 135] and a.tolist() == [2, 4, 5] and b.tolist() == [1, 3, 4]
    assert all(len(x) == 0 for x in token_align.cut_groups(np.zeros(0, np.int64), np.zeros(0, np.int64)))


def test_empty(spark):
    assert run(spark, []) == collections.Counter()
