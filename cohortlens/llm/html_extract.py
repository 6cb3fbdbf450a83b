"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

Every leaf block of a page is article text or not.  A block's features come from its ancestors (their
tags and the words of their class, id and role) and from its text (length, links, punctuation, the words
of short texts); the field adds a weight for each pair of neighbouring labels, is trained on labelled
pages by the gradient of its log-likelihood (forward-backward over all pages at once), and decodes a
page by Viterbi.  The training pages are ``html_pages.labelled_pages``, a bounded number that is a
parameter; training takes seconds and nothing of the corpus, so its model is the same at every size.
Extraction is one narrow map over the pages: no shuffle, one page in memory at a time.

Defined results: null, empty or markup-only html has an empty text of 0 characters; rows keep their
multiplicity and repeated pages get equal texts; null ids and urls stay null; an empty table gives no
rows; very long pages take time in proportion and are neither cut nor capped (of a block's ancestors the
8 outermost and 16 innermost are looked at); a tie between labels counts as no article text; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import html_blocks, html_pages
from cohortlens.llm.html_blocks import Block

#: Pages that are trained on, passes of the gradient over them, and the weight of the penalty.
PAGES, STEPS, PENALTY, SEED = 1200, 150, 0.3, 11
#: Words of a text up to which each word is a feature.
SHORT = 12


def path_features(path: tuple[str, ...]) -> list[str]:
    out = []
    for key in path:
        name, *words = key.split(" ")
        out.append("t:" + name)
        for w in words:
            out.append("c:" + w)
            if len(w) > 4:
                out.append("p:" + w[:4])
    if path:
        name, *words = path[-1].split(" ")
        out.append("n:" + name)
        out += ["nc:" + w for w in words]
        out.append("nn:" + " ".join(k.split(" ")[0] for k in path[-2:]))
    return list(dict.fromkeys(out))


def _bucket(n: int) -> int:
    return n.bit_length()


def text_features(block: Block, i: int, n: int) -> list[str]:
    text = block.text
    words = text.split(" ")
    tag = block.path[-1].partition(" ")[0] if block.path else ""
    size = "w" + str(_bucket(len(words)))
    share = "l" + str(min(4, 5 * block.linked // max(1, len(text))))
    out = [size, share, size + share, size + tag, share + tag]
    out.append("." if text[-1] in ".!?…。:»”\"" else "-")
    out.append("," + str(min(3, _bucket(text.count(",")))))
    if n == 1:
        out.append("only")
    elif i == 0:
        out.append("first")
    elif i == n - 1:
        out.append("last")
    out.append("at" + str(4 * i // n))
    if text[0] in "©|•·":
        out.append("sign")
    if len(words) <= SHORT:
        out += ["s:" + w.strip(".,:;!?").lower() for w in dict.fromkeys(words)]
    return out


class Field:
    """weights: by feature, for the label 1; pair[a][b]: for a followed by b; start: for a first 1."""

    def __init__(self, weights: dict[str, float], pair: list[list[float]], start: float):
        self.weights, self.pair, self.start = weights, pair, start
        self.paths: dict[tuple[str, ...], float] = {}

    def _scores(self, blocks: list[Block]) -> list[float]:
        get, n, out = self.weights.get, len(blocks), []
        for i, b in enumerate(blocks):
            of_path = self.paths.get(b.path)
            if of_path is None:
                if len(self.paths) > 50_000:
                    self.paths.clear()
                of_path = self.paths[b.path] = sum(get(f, 0.0) for f in path_features(b.path))
            out.append(of_path + sum([get(f, 0.0) for f in text_features(b, i, n)]))
        return out

    def decode(self, blocks: list[Block]) -> list[int]:
        """The likeliest labels (Viterbi)."""
        if not blocks:
            return []
        (t00, t01), (t10, t11) = self.pair
        scores = self._scores(blocks)
        zero, one, back = 0.0, self.start + scores[0], []
        for e in scores[1:]:
            a, b, c, d = zero + t00, one + t10, zero + t01, one + t11
            back.append((int(b > a), int(d > c)))
            zero, one = max(a, b), max(c, d) + e
        out = [int(one > zero)]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]

    def extract(self, page: str) -> str:
        blocks = html_blocks.blocks(page)
        return "\n".join([b.text for b, y in zip(blocks, self.decode(blocks), strict=True) if y])


def _marginals(score: np.ndarray, active: list[int], pair: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """P(label 1) and the expected number of each label pair by scaled forward and backward passes.

    score: (blocks, pages), pages by falling length; active[t] pages have a block t.
    """
    width, n = score.shape
    e = np.stack([np.ones_like(score), np.exp(np.clip(score, -40, 40))], axis=2)
    m = np.exp(pair)
    fwd, bwd, scale = np.zeros((width, n, 2)), np.ones((width, n, 2)), np.ones((width, n, 1))
    for t in range(width):
        k = active[t]
        x = e[t, :k] * ([1.0, np.exp(start)] if t == 0 else fwd[t - 1, :k] @ m)
        scale[t, :k] = x.sum(axis=1, keepdims=True)
        fwd[t, :k] = x / scale[t, :k]
    both = np.zeros((2, 2))
    for t in range(width - 2, -1, -1):
        k = active[t + 1]
        ahead = e[t + 1, :k] * bwd[t + 1, :k] / scale[t + 1, :k]
        bwd[t, :k] = ahead @ m.T
        both += m * (fwd[t, :k].T @ ahead)
    return fwd[:, :, 1] * bwd[:, :, 1], both


def train(pages: list[str], steps: int = STEPS, penalty: float = PENALTY) -> Field:
    """A field fitted to labelled pages (article texts begin with ``html_pages.MARK``)."""
    index: dict[str, int] = {}
    flat, owner, labels, lengths = [], [], [], []
    for found in sorted(filter(None, map(html_blocks.blocks, pages)), key=len, reverse=True):
        lengths.append(len(found))
        for i, b in enumerate(found):
            clean = Block(b.path, b.text.replace(html_pages.MARK, "").strip() or "-", b.linked, b.links)
            for f in dict.fromkeys(path_features(clean.path) + text_features(clean, i, len(found))):
                flat.append(index.setdefault(f, len(index)))
                owner.append(len(labels))
            labels.append(html_pages.MARK in b.text)
    if not labels:
        return Field({}, [[0.0, 0.0], [0.0, 0.0]], 0.0)
    flat, owner, labels, lengths = np.array(flat), np.array(owner), np.array(labels, float), np.array(lengths)
    seen = np.bincount(flat)
    n, width = len(lengths), int(lengths.max())
    active = [int((lengths > t).sum()) for t in range(width)]
    place = np.concatenate([np.arange(m) * n + p for p, m in enumerate(lengths)])
    gold = np.zeros((width, n))
    gold.reshape(-1)[place] = labels
    want = np.zeros((2, 2))
    for t in range(1, width):
        np.add.at(want, (gold[t - 1, : active[t]].astype(int), gold[t, : active[t]].astype(int)), 1)
    w, pair, start = np.zeros(len(index)), np.zeros((2, 2)), np.zeros(1)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, pair, start)]
    for step in range(1, steps + 1):
        score = np.zeros((width, n))
        score.reshape(-1)[place] = np.bincount(owner, w[flat], len(labels))
        one, both = _marginals(score, active, pair, float(start[0]))
        miss = labels - one.reshape(-1)[place]
        grads = (np.bincount(flat, miss[owner], len(index)) - penalty * w, want - both - penalty * pair, np.array([(gold[0] - one[0]).sum()]) - penalty * start)
        for x, g, (m, v) in zip((w, pair, start), grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    rare = 1e-3
    return Field({f: float(w[i]) for f, i in index.items() if abs(w[i]) > rare and seen[i] > 1}, pair.tolist(), float(start[0]))


@lru_cache(4)
def default_field(pages: int = PAGES, seed: int = SEED) -> Field:
    return train(html_pages.labelled_pages(pages, seed))


def extract_main_text(pages: DataFrame, field: Field | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages``."""
    sent = pages.sparkSession.sparkContext.broadcast(field or default_field())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            texts = [model.extract(h) if h else "" for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return src.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
