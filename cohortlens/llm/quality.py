"""Quality classifier: logistic regression over hashed word n-grams, trained with FTRL updates.

Features of a text are its words and word pairs, and the shapes of its words and of word pairs
(runs of small letters, capitals, digits and other characters), hashed to ``2**BITS`` coordinates;
a text's score is a sparse dot product of its mean feature vector with the weights.

Training takes at most ``SAMPLE`` labelled rows, those whose ids have the least hash (a bounded,
documented sample), in one task that goes through them ``EPOCHS`` times.  Weights are at most
``2**BITS`` numbers, whatever the input.  Scoring reads every whole text in one narrow map.

Defined results: a null or empty text has the bias as its score; without labelled rows every score
is 0.5; an id that is labelled twice counts once, with its lower label; an id on several texts is
trained on the least of them; repeated rows stay; a null id is never held out and never trained on;
an empty table gives no rows; very long texts are read whole; other columns are ignored, or kept
(``drop_low_quality``) whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import worker
from cohortlens.llm.common import documents, free_name

BITS = 18
SAMPLE = 8_000
EPOCHS = 3
THRESHOLD = 0.3
#: Fixed values of the update rule: learning rate, its offset, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
#: Length of the mean feature vector's entries, summed.
SCALE = 16.0
_MASK = np.uint64((1 << BITS) - 1)
_WORD_MEMORY = 500_000
_REPEAT = 0x5EED
_known: dict[str, tuple[int, int]] = {}
worker.keeps("quality", _known.clear)


def shape(word: str) -> str:
    """Runs of small letters (a), capitals (A) and digits (0) as one sign each; other characters as they are, runs as one."""
    out = []
    for ch in word:
        s = "a" if ch.islower() else "A" if ch.isupper() else "0" if ch.isdigit() else "x" if ch.isalpha() else ch
        if not out or out[-1] != s:
            out.append(s)
    return "".join(out)


def _word_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    worker.begin("quality")
    if len(_known) > _WORD_MEMORY:
        _known.clear()
    h = xxhash.xxh64_intdigest
    lexical, formal = np.empty(len(words), np.uint64), np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        got = _known.get(w)
        if got is None:
            got = _known[w] = (h(w.lower().encode("utf-8", "surrogatepass"), 3), h(shape(w).encode("utf-8", "surrogatepass"), 5))
        lexical[i], formal[i] = got
    return lexical, formal


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9)


def features(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """For each kind of feature the coordinate of every word, and where each text's words begin (one more at the end).

    Pairs belong to their first word; the last word of a text is paired with nothing.
    """
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    offs = split.offsets.to_numpy().astype(np.int64)
    flat = split.flatten()
    offs -= offs[0]
    keep = pc.not_equal(flat, "")
    if not pc.all(keep).as_py():  # white space at the ends leaves empty words
        kept = keep.to_numpy(zero_copy_only=False)
        offs = np.concatenate([[0], np.cumsum(kept)])[offs]
        flat = flat.filter(keep)
    coded = flat.dictionary_encode()
    lexical, formal = (x[coded.indices.to_numpy()] for x in _word_hashes(coded.dictionary.to_pylist()))
    n = len(lexical)
    last = np.zeros(n, bool)
    last[offs[1:][np.diff(offs) > 0] - 1] = True
    out = []
    for seed, x in enumerate((lexical, formal)):
        nxt = np.concatenate([x[1:], x[:1]]) if n else x
        if x is formal and n:  # a word that is repeated at once is a pair of its own kind
            nxt = np.where(lexical == np.concatenate([lexical[1:], lexical[:1]]), np.uint64(_REPEAT), nxt)
        nxt = np.where(last, np.uint64(seed + 1), nxt)
        out += [((x ^ (x >> np.uint64(31))) & _MASK).astype(np.int64), (_mix(x, nxt) >> np.uint64(64 - BITS)).astype(np.int64)]
    return out, offs


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """(weights, bias) after FTRL-proximal updates, text by text in the given order."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias_at = 1 << BITS
    docs = []
    for a in range(0, len(texts), 500):
        kinds, offs = features(pa.array(texts[a : a + 500], pa.string()))
        for i in range(len(offs) - 1):
            x = np.concatenate([k[offs[i] : offs[i + 1]] for k in kinds])
            at, times = np.unique(x, return_counts=True)
            docs.append((np.append(at, bias_at), np.append(times * (SCALE / max(1, len(x))), 1.0)))
    for _ in range(epochs):
        for (at, v), y in zip(docs, labels, strict=True):
            zi, ni = z[at], n[at]
            w = _weights(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(w @ v, -35, 35)))
            g = (p - y) * v
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[at] += g - sigma * w
            n[at] = ni + g * g
    w = _weights(z, n)
    return w[:-1].astype(np.float32), float(w[-1])


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def scores(texts: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """Probability of label 1 for each text."""
    kinds, offs = features(texts)
    each = np.zeros(len(kinds[0]), np.float64)
    for k in kinds:
        each += weights[k]
    upto = np.concatenate([[0], np.cumsum(each)])
    words = np.diff(offs)
    dot = (upto[offs[1:]] - upto[offs[:-1]]) * SCALE / np.maximum(1, words * len(kinds))
    return 1 / (1 + np.exp(-np.clip(dot + bias, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, float]:
    """Weights and bias from the labelled rows that are not held out."""
    ids = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.min("y").alias("y"))
    chosen = ids.where(~held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id").limit(sample)
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # one text for each id, however many rows repeat it: at most ``sample`` rows on either side
    one = text.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    rows = one.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y = [], []
        for b in batches:
            texts += b.column(0).to_pylist()
            y += b.column(1).to_pylist()
        w, bias = train(texts, y)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w[at].astype(np.float64), bias))], names=["at", "w"])

    weights, bias = np.zeros(1 << BITS, np.float32), 0.0
    for r in rows.select("text", "y").mapInArrow(run, "at long, w double").collect():  # at most 2**BITS + 1 rows
        if r["at"] < 0:
            bias = r["w"]
        else:
            weights[r["at"]] = r["w"]
    return weights, bias


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def score_udf(spark: SparkSession, weights: np.ndarray, bias: float):
    """A column function that scores texts; the weights (1 MB) go to each executor once."""
    sent = spark.sparkContext.broadcast((weights, bias))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        w, b = sent.value
        out = [scores(texts.slice(a, 1000), w, b) for a in range(0, len(texts), 1000)]
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    score = score_udf(docs.sparkSession, *fit(docs, labels, id_col=id_col, text_col=text_col))
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), score(F.col(text_col).cast("string")).alias("score"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the classifier rejects; columns as they were."""
    score = score_udf(docs.sparkSession, *fit(docs, labels, id_col=id_col, text_col=text_col))
    (name,) = free_name(docs, "score")
    return docs.withColumn(name, score(F.col(text_col).cast("string"))).where(F.col(name) >= threshold).drop(name)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
