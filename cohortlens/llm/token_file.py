"""Token ids of a corpus as a file of Simple-8b blocks, in ascending document order.

File format: a Parquet folder (so that Spark's committer makes lost executors harmless, and any
store that Spark writes to will do), one row for each block of whole documents:

``shard, block``      order of the blocks; shards hold ascending, disjoint ranges of ids
``before``            ids of the shard in front of this block
``doc_ids, lengths``  the documents of the block and how many ids each has
``words``             Simple-8b words, little-endian 64-bit
``word_offsets``      for every ``simple8b.BLOCK`` values, the word they begin at

Defined results: a null or empty text has only the end id; a null id sorts first; equal ids sort
by text; repeated rows are repeated documents; an empty table gives an empty file; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import simple8b, tokens
from cohortlens.llm.common import documents, new_path, parallelism, shards

FORMAT = "shard int, block int, before long, doc_ids array<long>, lengths array<long>, words binary, word_offsets array<long>"
BLOCK_IDS = 1 << 18


def write_token_file(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", n_shards: int | None = None) -> None:
    """Encode ``docs`` and write the file at ``path``.  One shuffle, by ranges of the id."""
    spark = docs.sparkSession
    vocabulary = tokenizer or tokens.default_tokenizer()
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = n_shards or 2 * parallelism(spark)
    shard, _ = shards(src, "id", n)
    dealt = src.withColumn("shard", shard.cast("int")).repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(vocabulary)
        shard, block, before, holds = None, 0, 0, 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def flushed() -> pa.RecordBatch:
            ids, counts = np.concatenate([h[2] for h in held]), np.concatenate([h[1] for h in held])
            words, at = simple8b.encode(ids)
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            lists = [one(pa.concat_arrays([h[0] for h in held])), one(pa.array(counts, pa.int64()))]
            head = [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64())]
            return pa.RecordBatch.from_arrays([*head, *lists, pa.array([words.astype("<u8").tobytes()], pa.binary()), one(pa.array(at, pa.int64()))], names=["shard", "block", "before", "doc_ids", "lengths", "words", "word_offsets"])

        for b in batches:
            of = b.column(2).to_numpy()
            for a, z, counts, ids in enc.encode(b.column(1), end_id=end_id):
                upto = np.concatenate([[0], np.cumsum(counts)])
                here = of[a:z]
                edges = [0, *(np.flatnonzero(np.diff(here)) + 1).tolist(), z - a]
                for p, q in zip(edges, edges[1:], strict=False):
                    if here[p] != shard:
                        if held:
                            yield flushed()
                            held.clear()
                        shard, block, before, holds = int(here[p]), 0, 0, 0
                    held.append((b.column(0).slice(a + p, q - p), counts[p:q], ids[upto[p] : upto[q]]))
                    holds += int(upto[q] - upto[p])
                    if holds >= BLOCK_IDS:
                        yield flushed()
                        held.clear()
                        block, before, holds = block + 1, before + holds, 0
        if held:
            yield flushed()

    dealt.select("id", "text", "shard").mapInArrow(run, FORMAT).write.option("compression", "zstd").parquet(path)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, decoded block by block."""
    return _read(spark, path, "doc_id long, start long, n_tokens long, ids array<int>", lambda ids, upto: _lists(ids, upto))


def digest_token_file(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the decoded blocks."""
    return _read(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", _digests)


def _lists(ids: np.ndarray, upto: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids.astype(np.int32)))


def _digests(ids: np.ndarray, upto: np.ndarray) -> pa.Array:
    raw = memoryview(ids.astype("<u4")).cast("B")
    return pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)], pa.int64())


def _read(spark: SparkSession, path: str, schema: str, last) -> DataFrame:
    blocks = spark.read.schema(FORMAT).parquet(path)
    sums = blocks.groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda x, y: x + y)).alias("n")).orderBy("shard").collect()
    base, total = {}, 0  # one number for each shard
    for r in sums:
        base[r.shard] = total
        total += r.n
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                shard, before, doc_ids, lengths, words = (c[i] for c in b.columns)
                ids = simple8b.decode(np.frombuffer(words.as_buffer(), "<u8"))
                n = lengths.values.to_numpy()
                upto = np.concatenate([[0], np.cumsum(n)])
                yield pa.RecordBatch.from_arrays([doc_ids.values, pa.array(upto[:-1] + (base[shard.as_py()] + before.as_py())), pa.array(n), last(ids, upto)], names=names)

    return blocks.select("shard", "before", "doc_ids", "lengths", "words").mapInArrow(run, schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "op9-ids")
    write_token_file(documents(spark, sf_dir), path)
    return digest_token_file(spark, path)
