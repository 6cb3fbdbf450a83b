"""Token counts of whole texts (overlap resynchronisation for huge documents).

Texts over ``tokens.CHUNK`` code points are encoded in overlapping chunks with offsets, spliced at
stable boundaries (``tokens.resync_encode``); shorter ones go through ``tokens.WordEncoder``.  The
operator is one narrow map: no shuffle, bounded memory per batch, any lost task is simply rerun.

Defined results: a null or empty text has 0 bytes and 0 tokens; rows keep their multiplicity, so a
repeated row is counted once for each time; a null id stays null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import tokens
from cohortlens.llm.common import documents


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", chunk: int = tokens.CHUNK, overlap: int = tokens.OVERLAP) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row of ``docs``."""
    path = tokenizer or tokens.default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            n_bytes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            long = np.flatnonzero(pc.utf8_length(texts).to_numpy(zero_copy_only=False) > chunk)
            counts = np.zeros(len(texts), np.int64)
            if len(long):
                mask = np.zeros(len(texts), bool)
                mask[long] = True
                for i in long.tolist():
                    counts[i] = len(tokens.resync_encode(enc.tok, texts[i].as_py(), chunk, overlap))
                texts = pc.if_else(pa.array(mask), "", texts)
            for a, z, c, _ in enc.encode(texts, want_ids=False):
                counts[a:z] += c
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes), pa.array(counts), pa.array(counts > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    src = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"`{id_col}` long, n_bytes long, n_tokens long, over_limit boolean")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
