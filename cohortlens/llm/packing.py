"""Best-fit packing of token sequences, improved by a swap-based local search.

Pieces of equal length are interchangeable, so the search runs on bin *patterns* with
multiplicities over the histogram of lengths: at most ``size`` counts, however many documents.
Best-fit decreasing fills the patterns; then moves, one-for-one and two-for-one exchanges between
underfull patterns increase the sum of squared fills until bins empty (``improve``).  Pieces take
their places by their rank within their length; ranks come from salted groups, so that no task sees
all pieces of one length.

Defined results: a null or empty text is a document of its end id alone; repeated rows are packed
once for each time; null ids stay null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm import tokens
from cohortlens.llm.common import documents, save

#: Pieces that one ranking task takes; lengths with more are dealt over as many salts as that needs.
RANKED = 5_000


class Bins:
    """Bin patterns with multiplicities: key (sorted lengths) to count."""

    def __init__(self, size: int):
        self.size = size
        self.n: dict[tuple[int, ...], int] = {}

    def add(self, key: tuple[int, ...], k: int) -> None:
        left = self.n.get(key, 0) + k
        if left:
            self.n[key] = left
        else:
            self.n.pop(key, None)

    def total(self) -> int:
        return sum(self.n.values())


def best_fit(counts: dict[int, int], size: int) -> Bins:
    """Best-fit decreasing on the histogram: the longest pieces first, each into the fullest bin that takes it."""
    bins = Bins(size)
    open_: dict[int, dict[tuple, int]] = {size: {}}  # room left: patterns
    for length in sorted(counts, reverse=True):
        c = counts[length]
        while c:
            room = min((r for r in open_ if r >= length and open_[r]), default=None)
            if room is None:
                k = size // length
                full, rest = divmod(c, k)
                for times, many in ((k, full), (rest, 1 if rest else 0)):
                    if many:
                        open_.setdefault(size - times * length, {})[(length,) * times] = many
                c = 0
                break
            key, m = next(iter(open_[room].items()))
            k = min(room // length, c)
            many = min(m, c // k)
            if many < m:
                open_[room][key] = m - many
            else:
                del open_[room][key]
            grown = open_.setdefault(room - k * length, {})
            new = tuple(sorted((*key, *(length,) * k), reverse=True))
            grown[new] = grown.get(new, 0) + many
            c -= many * k
    for group in open_.values():
        for key, m in group.items():
            bins.add(key, m)
    return bins


def improve(bins: Bins) -> Bins:
    """Local search: exchanges that raise the sum of squared fills, from the emptiest bins on, until none is left or the bins are as few as the total allows."""
    size = bins.size
    least = -(-sum(sum(k) * m for k, m in bins.n.items()) // size)
    n_bins = bins.total()
    stuck: set[tuple] = set()
    loose = sorted((sum(k), k) for k in bins.n if sum(k) < size)
    while n_bins > least:
        done, look = True, None
        for at, (fill, src) in enumerate(loose):
            if src in stuck:
                continue
            look = look or _Loose(loose, size)
            step = look.best_exchange(at, bins.n[src] < 2)
            if step is None:
                stuck.add(src)
                continue
            dst, out, back = step
            k = min(bins.n[src], bins.n[dst]) if src != dst else bins.n[src] // 2
            a, b = list(dst), list(src)
            for x in back:
                a.remove(x)
                b.append(x)
            for y in out:
                b.remove(y)
                a.append(y)
            bins.add(src, -k)
            bins.add(dst, -k)
            new_dst, new_src = tuple(sorted(a, reverse=True)), tuple(sorted(b, reverse=True))
            bins.add(new_dst, k)
            if new_src:
                bins.add(new_src, k)
            else:
                n_bins -= k
            for key in {src, dst, new_dst, new_src} - {()}:
                entry = (sum(key), key)
                i = bisect.bisect_left(loose, entry)
                there = i < len(loose) and loose[i] == entry
                if there and key not in bins.n:
                    del loose[i]
                elif not there and key in bins.n and entry[0] < size:
                    loose.insert(i, entry)
            stuck -= {new_dst, new_src}
            if sum(new_dst) < size:
                stuck.clear()
            done = False
            break
        if done:
            break
    return bins


class _Loose:
    """Underfull patterns in order of their fill, and which lengths each holds."""

    def __init__(self, loose: list[tuple[int, tuple]], size: int):
        self.loose, self.size = loose, size
        n = np.fromiter((len(k) for _, k in loose), np.int64, len(loose))
        self.begin = np.concatenate([[0], np.cumsum(n)])
        self.lengths = np.fromiter(chain.from_iterable(k for _, k in loose), np.int64, int(self.begin[-1]))
        self.owner = np.repeat(np.arange(len(loose)), n)
        self.room = size - np.fromiter((fill for fill, _ in loose), np.int64, len(loose))

    def best_exchange(self, at: int, alone: bool):
        """The exchange of a pattern with another one at least as full that fills that one most: (its pattern, lengths that it gets, lengths that it gives); ``alone``: not with itself."""
        fill, src = self.loose[at]
        start = bisect.bisect_left(self.loose, (fill,))
        flat = slice(self.begin[start], None)
        lengths, owner = self.lengths[flat][::-1], self.owner[flat][::-1]
        if alone:
            keep = owner != at
            lengths, owner = lengths[keep], owner[keep]
        first = np.full(self.size + 1, -1)  # the emptiest pattern that holds a length; the last one written stays
        first[lengths] = owner
        first[0] = start + (alone and start == at)
        if first[0] >= len(self.loose):
            return None
        gifts = [((y,), y) for y in set(src)]
        single = len(gifts)
        gifts += [((src[i], src[j]), src[i] + src[j]) for i in range(len(src)) for j in range(i)]
        held = np.flatnonzero(first >= 0)
        gain = np.array([y for _, y in gifts])[:, None] - held
        gain[gain > self.room[first[held]]] = 0
        gain[single:, 0] = 0  # two are only given for one
        best = gain.max()
        if best <= 0:
            return None
        g, h = np.nonzero(gain == best)
        i = min(range(len(g)), key=lambda i: (first[held[h[i]]], g[i]))
        x = int(held[h[i]])
        return self.loose[first[x]][1], gifts[g[i]][0], (x,) if x else ()


def pack(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Bin patterns and how many bins have each."""
    return sorted(improve(best_fit(counts, size)).n.items(), reverse=True)


def pieces_of(docs: DataFrame, size: int, end_id: int, tokenizer: str | None, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents over ``size`` ids are cut, the first piece takes the remainder."""
    path = tokenizer or tokens.default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        for b in batches:
            for a, z, counts, ids in enc.encode(b.column(1), end_id=end_id):
                n = -(-counts // size)
                doc = np.repeat(np.arange(z - a), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                short = counts - (n - 1) * size
                length = np.where(piece == 0, short[doc], size)
                start = np.where(piece == 0, 0, short[doc] + (piece - 1) * size)
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                upto = np.concatenate([[0], np.cumsum(length)]).tolist()
                crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(upto, upto[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_pack(docs: DataFrame, size: int = 1024, end_id: int = 2, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", ranked: int = RANKED) -> DataFrame:
    """The place of every piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    pieces, _ = save(pieces_of(docs, size, end_id, tokenizer, id_col, text_col), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``size`` rows
    many = F.create_map(*[F.lit(x) for length, n in counts.items() for x in (length, -(-n // ranked))]) if counts else F.create_map(F.lit(0).cast("long"), F.lit(1))
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "start"), F.try_element_at(many, F.col("length"))).cast("int")
    salted = pieces.withColumn("salt", salt)
    each = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    slot_key, slot_seq, slot_off = [], [], []
    seen: dict[int, int] = {}
    seq = 0
    for key, m in pack(counts, size):
        at = 0
        for length in key:
            slot_key.append((length << 44) + seen.get(length, 0))
            slot_seq.append(seq)
            slot_off.append(at)
            seen[length] = seen.get(length, 0) + m
            at += length
        seq += m
    order = np.argsort(np.asarray(slot_key, np.int64), kind="stable")
    keys, seqs, offs = (np.asarray(x, np.int64)[order] for x in (slot_key, slot_seq, slot_off))
    before = each.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = salted.withColumn("rank", rank).join(before, ["length", "salt"]).withColumn("key", F.col("length") * F.lit(1 << 44) + F.col("before") + F.col("rank") - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(5).to_numpy()
            at = np.searchsorted(keys, key, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seqs[at] + key - keys[at]), pa.array(offs[at])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "key").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(documents(spark, sf_dir))
