"""SimHash near-duplicates over a Gray-order hierarchical index.

``simhash_components`` links documents whose 64-bit fingerprints differ in at most ``radius`` bits.
Fingerprints are cut into five blocks; two within radius 3 agree on at least two of them, so each
distinct fingerprint goes to ten tables keyed by a pair of blocks, and in each bucket the
hierarchical index (``hamming_index``) finds the neighbours.  Equal fingerprints are one entry, and
a bucket emits spanning links only, so no group is expanded into pairs.  A bucket over ``BUCKET``
entries is dealt in chunks, every pair of chunks to a task.

Near-duplicates at a similarity, by the same index, are in ``near_duplicates``.

Defined results: a null text is an empty one; a document without words has fingerprint zero and is
linked like any other; repeated rows are members of one class; a null id stays null and never names
a component, unless all its members' ids are null; other columns are kept or ignored as stated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import hamming_index as hi
from cohortlens.llm.common import Tables, documents, parallelism, save
from cohortlens.llm.components import connected_components

#: Entries of a bucket that one task takes at once.
BUCKET = 50_000
#: Rows that a task indexes at once (whole buckets).
RUN = 100_000
#: Bit ranges of the five blocks of a 64-bit fingerprint.
BLOCKS = ((0, 13), (13, 26), (26, 39), (39, 52), (52, 64))
TABLES = [(i, j) for i in range(5) for j in range(i)]


def words_of(text: str | None) -> list[bytes]:
    """Lower-cases A-Z, then takes runs without ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], k: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of k words joined by spaces; of the whole sequence if it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    line = b" ".join(words)
    if len(words) <= k:
        return np.array([h(line, seed)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    begin = (end - size)[: len(words) - k + 1].tolist()
    return np.fromiter([h(line[a:b], seed) for a, b in zip(begin, end[k - 1 :].tolist(), strict=True)], np.uint64, len(begin))


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    n = len(hashes)
    if not n:
        return 0
    total = np.zeros(64, np.int64)
    for a in range(0, n, 1 << 14):
        part = np.ascontiguousarray(hashes[a : a + (1 << 14)]).astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(shingle_hashes(words_of(t.as_py()), shingle)) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _table_key(i: int, j: int) -> Column:
    mask = sum(1 << b for lo, hi_ in (BLOCKS[i], BLOCKS[j]) for b in range(lo, hi_))
    return F.col("fp").bitwiseAND(F.lit(mask if mask < 1 << 63 else mask - (1 << 64)))


def _gray(x: Column) -> Column:
    for s in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, s))
    return x


def _split_hot(rows: DataFrame, keys: list[str], spread: Column, most: int) -> DataFrame:
    """Adds ``part``: buckets over ``most`` entries are dealt in chunks, each pair of chunks to one part."""
    hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).withColumn("chunks", F.ceil(F.col("n") / most).cast("int")).drop("n")
    mine = F.pmod(spread, F.col("chunks")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least(mine, c).alias("x"), F.greatest(mine, c).alias("y")))
    parts = F.when(F.col("chunks").isNull(), F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))).otherwise(pair)
    return rows.join(hot, keys, "left").withColumn("part", F.explode(parts)).drop("chunks")


def whole_groups(batches: Iterator[pa.RecordBatch], key_columns: list[int], most: int, weight=lambda b: b.num_rows) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Runs of whole groups of rows sorted by their keys, of about that weight, with a group number for each row."""
    held: list[pa.RecordBatch] = []
    holds = 0

    def numbered(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        for c in key_columns:
            x = t.column(c).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.cumsum(new)

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        holds += weight(b)
        if holds < most:
            continue
        t = pa.Table.from_batches(held)
        g = numbered(t)
        cut = int(np.searchsorted(g, g[-1]))
        if cut:
            yield g[:cut], t.slice(0, cut)
        held = t.slice(cut).combine_chunks().to_batches()
        holds = sum(map(weight, held))
    if held:
        t = pa.Table.from_batches(held)
        yield numbered(t), t


def hamming_links(reps: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): spanning links between the representatives ``rep`` of distinct fingerprints ``fp`` within the radius (3 at most)."""
    if radius > 3:
        raise ValueError("five blocks, two of them equal, guarantee a radius of 3")
    spark = reps.sparkSession
    tables = F.array(*[F.struct(F.lit(t).alias("t"), _table_key(i, j).alias("key")) for t, (i, j) in enumerate(TABLES)])
    rows = reps.select("fp", "rep", F.explode(tables).alias("e")).select("fp", "rep", "e.t", "e.key")
    rows = _split_hot(rows, ["t", "key"], F.xxhash64("fp"), BUCKET).select("t", "key", "part.x", "part.y", _gray(F.col("fp").bitwiseAND(F.bitwise_not(F.col("key")))).alias("gray"), "fp", "rep")
    dealt = rows.repartition(parallelism(spark), "t", "key", "x", "y").sortWithinPartitions("t", "key", "x", "y", "gray")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, t in whole_groups(batches, [0, 1, 2, 3], RUN):
            lonely = np.concatenate([[False], group[1:] == group[:-1]])
            keep = lonely | np.concatenate([lonely[1:], [False]])
            if not keep.any():
                continue
            fp, rep = t.column(5).to_numpy()[keep].view(np.uint64), t.column(6).to_numpy()[keep]
            i, j = hi.spanning_links(group[keep], fp[:, None], radius)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(rep[i]), pa.array(rep[j])], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    prints, _ = save(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    with Tables(docs.sparkSession) as tables:
        named = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
        # a class needs a name even if its ids are all null: its fingerprint, below all ids
        reps = tables.save(named.select("fp", "least", F.coalesce("least", F.lit(-(2**62)) + F.shiftrightunsigned("fp", 2)).alias("rep")), "fingerprint-classes")
        found, path = connected_components(hamming_links(reps.select("fp", "rep"), radius))
        tables.paths.append(path)
        known = reps.join(found, reps.rep == found.node, "left").select("fp", "least", F.coalesce("component", "rep").alias("root"))
        names = known.groupBy("root").agg(F.min("least").alias("component_id"))
        labels, _ = save(known.join(names, "root").select("fp", "component_id"), "labels")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(labels, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir))
