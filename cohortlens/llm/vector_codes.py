"""Compression of vectors to product-quantisation codes (float32 screening with proven error intervals).

A vector's components become integers ``floor(256 * x)`` and the vector is cut into equal parts.  Each
part position has a codebook; the nearest entry of all parts of a batch is found by one float32 matrix
product for a position.  A float32 score is only trusted as far as its rounding error is bounded: the
products of ``d + 1`` terms differ from the true ones by at most ``gamma(d + 3) * (2|v||c| + |c|^2)``,
so every entry whose interval overlaps the least one's is computed again in int64, and ties go to the
lowest index.  Parts with components beyond ``EXACT`` are computed with Python's own integers.

The codebooks (parts x entries x part length integers, whatever the input's size) are refined in
rounds: every task sums its own rows by entry, Spark adds the sums, and only these bounded sums reach
the driver.

Defined results: rows whose vector is null or holds a null, NaN or infinite component are dropped, as
are vectors whose length isn't that of the least kept id's (or isn't a multiple of the parts); an empty
table gives no rows; fewer rows than entries give smaller codebooks; repeated rows are coded each for
itself and count each for itself; equal ids are ordered by their vectors; null ids come last; null
labels are one label; errors beyond a long are the largest long; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import Tables

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components up to this size have squared distances that int64 holds for up to 2^20 components.
EXACT = 1 << 20
#: Rows screened at once.
ROWS = 4096
#: Labels up to this many are broadcast with their sums (24 bytes each); more are joined by a shuffle.
SENT_LABELS = 200_000
_MOST = (1 << 63) - 1
_LIMB = 10**30


def _valid(v: Column) -> Column:
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(ok, F.lit(False))


def _integers(flat: np.ndarray) -> np.ndarray:
    """floor(256 x) as int64, or as Python's integers where int64 can't be sure to hold what follows."""
    scaled = np.floor(flat.astype(np.float64) * SCALE)
    if scaled.size and np.abs(scaled).max() > EXACT:
        # the product may overflow a double: the integers then come from the components themselves
        return np.array([int(y) if np.isfinite(y) else int(x) * SCALE for y, x in zip(scaled.tolist(), flat.astype(np.float64).tolist(), strict=True)], object)
    return scaled.astype(np.int64)


def _gamma(n: int) -> float:
    u = 2.0**-24
    return n * u / (1 - n * u)


class Codebooks:
    """entries: (parts, entries, part length) integers."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.small = entries.dtype != object
        if self.small:
            e = entries.astype(np.float64)
            norm = (e * e).sum(axis=2)
            self.matrix = np.concatenate([-2 * e, norm[:, :, None]], axis=2).astype(np.float32).transpose(0, 2, 1)
            self.far = np.sqrt(norm.max(axis=1))

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, parts, part length) integers to (rows, parts) indexes and exact squared distances."""
        if not self.small or vectors.dtype == object:
            return self._plain(vectors)
        n, parts, d = vectors.shape
        index, dist = np.empty((n, parts), np.int64), np.empty((n, parts), np.int64)
        for p in range(parts):
            v, e = np.ascontiguousarray(vectors[:, p]), self.entries[p]
            vf = np.ones((n, d + 1), np.float32)
            vf[:, :d] = v
            score = vf @ self.matrix[p]
            length = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
            error = _gamma(d + 3) * (2 * length * self.far[p] + self.far[p] ** 2) * (1 + 1e-6)
            upto = np.nextafter((score.min(axis=1).astype(np.float64) + 2 * error).astype(np.float32), np.float32(np.inf))
            row, entry = np.nonzero(score <= upto[:, None])  # the true nearest is among these
            exact = ((v[row] - e[entry]) ** 2).sum(axis=1)
            first = np.searchsorted(row, np.arange(n))
            least = np.minimum.reduceat(exact, first)
            hit = np.flatnonzero(exact == least[row])
            index[:, p] = entry[hit[np.searchsorted(row[hit], np.arange(n))]]  # entries ascend in a row
            dist[:, p] = least
        return index, dist

    def _plain(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v, e = vectors.astype(object), self.entries.astype(object)
        index, dist = np.empty(v.shape[:2], np.int64), np.empty(v.shape[:2], object)
        for p in range(v.shape[1]):
            for i in range(len(v)):
                each = ((v[i, p] - e[p]) ** 2).sum(axis=1)
                index[i, p] = min(range(len(each)), key=lambda k: each[k])
                dist[i, p] = each[index[i, p]]
        return index, dist

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def _vectors(col: pa.Array, parts: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Runs of rows of equal part lengths as (first, after the last, integers)."""
    for a in range(0, len(col), ROWS):
        piece = col.slice(a, ROWS)
        flat = piece.flatten().to_numpy(zero_copy_only=False)
        yield a, a + len(piece), _integers(flat).reshape(len(piece), parts, -1)


def _first_entries(rows: DataFrame, parts: int, entries: int) -> tuple[int, np.ndarray | None]:
    """The vectors' length and the first codebooks, from the least ids."""
    ordered = rows.where((F.size("__v") >= parts) & (F.size("__v") % parts == 0)).orderBy(F.asc_nulls_last("__id"), "__v")
    least = ordered.limit(entries).collect()
    if not least:
        return 0, None
    dim = len(least[0]["__v"])
    if any(len(r["__v"]) != dim for r in least):
        least = ordered.where(F.size("__v") == dim).limit(entries).collect()
    flat = np.array([x for r in least for x in r["__v"]], np.float64)
    return dim, _integers(flat).reshape(len(least), parts, dim // parts).transpose(1, 0, 2)


def _limbs(total: list[int]) -> list[list[str]]:
    """Integers of any size as digits to the base 10^30, each with its integer's sign, so that decimals can add them."""
    out, rest, sign = [], [abs(x) for x in total], [-1 if x < 0 else 1 for x in total]
    while not out or any(rest):
        out.append([str(s * (x % _LIMB)) for s, x in zip(sign, rest, strict=True)])
        rest = [x // _LIMB for x in rest]
    return out


def _sums(rows: DataFrame, books: Codebooks, parts: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Per (part, entry): number of parts and sum of each component.  Bounded by the codebooks' size."""
    width = books.entries.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, v in _vectors(b.column(0), parts):
                index, _ = books.nearest(v)
                for p in range(parts):
                    used, at, n = np.unique(index[:, p], return_inverse=True, return_counts=True)
                    total = np.zeros((len(used), width), v.dtype)
                    np.add.at(total, at, v[:, p])
                    out = [(p, e, k, 0 if k else m, limb) for e, m, r in zip(used.tolist(), n.tolist(), total.tolist(), strict=True) for k, limb in enumerate(_limbs(r))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())), strict=True)], names=["part", "entry", "limb", "n", "total"])

    out = rows.select("__v").mapInArrow(run, "part int, entry int, limb int, n long, total array<string>")
    cols = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    sums: dict = {}
    for r in out.groupBy("part", "entry", "limb").agg(F.sum("n").alias("n"), *cols).collect():
        n, total = sums.get((r["part"], r["entry"]), (0, [0] * width))
        sums[r["part"], r["entry"]] = (n + r["n"], [t + int(r[f"s{i}"]) * _LIMB ** r["limb"] for i, t in enumerate(total)])
    return sums


def train_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[int, Codebooks | None]:
    """The vectors' length and the refined codebooks; ``rows`` has a valid vector in ``__v`` and an id in ``__id``."""
    dim, now = _first_entries(rows, parts, entries)
    if now is None:
        return 0, None
    kept = rows.where(F.size("__v") == dim)
    for _ in range(rounds):
        nxt = now.astype(object)
        for (part, entry), (n, total) in _sums(kept, Codebooks(now), parts).items():
            nxt[part, entry] = [t // n for t in total]
        fits = max(map(abs, nxt.reshape(-1).tolist())) <= EXACT
        now = nxt.astype(np.int64) if fits else nxt
    return dim, Codebooks(now)


def vector_codes(vectors: DataFrame, tables: Tables, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, code, error) of every kept row, written to the shared folder, and the codebooks."""
    if entries > 256:
        raise ValueError("a code has two hex digits for a part")
    rows = vectors.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).alias("__label"), F.col(vector_col).cast("array<double>").alias("__v")).where(_valid(F.col("__v")))
    dim, books = train_codebooks(rows, parts, entries, rounds)
    label_type = vectors.schema[label_col].dataType.simpleString()
    schema = f"vec_id long, label {label_type}, code string, error long"
    if books is None:
        return vectors.sparkSession.createDataFrame([], schema), None
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = sent.value
        for b in batches:
            for a, z, v in _vectors(b.column(2), parts):
                index, dist = book.nearest(v)
                digits = index.astype(np.uint8).tobytes().hex()
                codes = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
                error = [min(x, _MOST) for x in dist.sum(axis=1).tolist()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), b.column(1).slice(a, z - a), pa.array(codes, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return tables.save(rows.where(F.size("__v") == dim).mapInArrow(run, schema), "vector-codes"), books


def with_label_error(coded: DataFrame, tables: Tables) -> DataFrame:
    """Adds label_error: the error summed over equal labels, nulls together."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_MOST).cast("decimal(38,0)")).cast("long")
    sums = tables.save(coded.groupBy(F.col("label").alias("__label")).agg(total.alias("label_error")), "label-errors")
    if sums.count() <= SENT_LABELS:
        sums = F.broadcast(sums)
    return coded.join(sums, F.col("label").eqNullSafe(F.col("__label"))).drop("__label")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark)
    coded, books = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), tables)
    out = with_label_error(coded, tables)
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))
