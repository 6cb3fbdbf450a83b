"""Exact removal of repeated byte strings by distributed prefix doubling.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts anywhere else.

Ranks are names of the string that starts at a position: ``r25`` names 25 bytes, and the pair of
ranks at growing offsets names the string twice as long: (r25(p), r25(p+25)) is r50(p), then r100
with offset 50 and r200 with offset 100, the threshold.  A position whose rank is unique drops out.

All positions of 100 TB can't be sorted, nor need they be.  Of the 25-byte strings inside a window
of 200 bytes the one with the least name (the leftmost of equals) is the window's *anchor*; equal
windows have equal anchors at equal places.  So the first round sorts the names of anchors alone,
about one in 85 positions, and windows whose anchor is unique are unique.  An anchor stands for the
run of windows it is the anchor of; anchors that agree on the ranks of the first and last window of
the run repeat as a whole.  What is left are anchors whose surroundings differ between their
places; those whose r100 is unique to both sides drop out, and for the rest the windows of each
group of equal anchors are ranked one by one (``r200``).  Groups with very many different
surroundings are ranked by Spark instead, window by window.

Names have 64 bits, and two windows count as equal only if their anchors' names agree as well.

Defined results: a null text is an empty one; texts of fewer than 200 bytes lose nothing; rows that
repeat another row's text lose all of it (from 200 bytes on), those with equal ids too; a null id
stays null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import documents, drop_table, parallelism, row_key, save

LENGTH, GRAM = 200, 25
WINDOW = LENGTH - GRAM + 1
#: Different surroundings of one anchor that a task ranks at once; more are ranked by Spark.
GROUP = 20_000
#: Bytes of texts that are scanned at once.
SCAN = 1 << 20
_PLACE_BITS = 22
_PLACE = np.uint64((1 << _PLACE_BITS) - 1)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of a pair of names."""
    x = a * _ODD[0]
    x ^= x >> np.uint64(32)
    x += b
    x *= _ODD[1]
    x ^= x >> np.uint64(29)
    x *= _ODD[2]
    return x


def _double(rank: np.ndarray, offset: int) -> np.ndarray:
    """From the ranks of strings to those of strings twice as long: pairs at the offset."""
    return _mix(rank[:-offset], rank[offset:]) if len(rank) > offset else rank[:0]


def ranks(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r25, r100 and r200 of every position of a byte buffer at which such a string fits."""
    n = len(buf)
    if n < LENGTH:
        e = np.zeros(0, np.uint64)
        return e, e, e
    eight = np.ndarray((n - 7,), "<u8", buffer=buf.data, strides=(1,))
    m = n - GRAM + 1
    x = eight[:m] * _ODD[0]
    x ^= x >> np.uint64(31)
    x += eight[8 : m + 8]
    x *= _ODD[1]
    x ^= x >> np.uint64(30)
    x += eight[16 : m + 16]
    x *= _ODD[2]
    x ^= x >> np.uint64(29)
    x += buf[24 : m + 24]
    x *= _ODD[3]
    x ^= x >> np.uint64(32)
    x *= _ODD[1]
    r100 = _double(_double(x, 25), 50)
    return x, r100, _double(r100, 100)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def anchors(buf: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """Runs of windows with one anchor, over texts that stand one after the other in ``buf``.

    Yields arrays: text, anchor's place, first and last window of the run (places in the text), the
    anchor's name, the names to its right and left (32 bits, for pruning), and the run's name.
    """
    piece = 1 << (_PLACE_BITS - 1)
    for a in range(0, max(1, len(buf)), piece):
        part = buf[a : a + piece + LENGTH - 1]
        if len(part) < LENGTH:
            return
        r25, r100, r200 = ranks(part)
        key = (r25 & ~_PLACE) | np.arange(len(r25), dtype=np.uint64)
        at = (_sliding_min(key, WINDOW) & _PLACE).astype(np.int64)[: min(piece, len(part) - LENGTH + 1)]
        text = np.searchsorted(end, np.arange(a, a + len(at)), side="right")
        ok = np.arange(a, a + len(at)) + LENGTH <= end[np.minimum(text, len(end) - 1)]
        p = np.flatnonzero(ok)
        if not len(p):
            continue
        x, t = at[p], text[p]
        new = np.concatenate([[True], (x[1:] != x[:-1]) | (t[1:] != t[:-1])])
        first = p[new]
        last = p[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(p) - 1]])]
        x, t = x[new], t[new]
        run = _mix(_mix(r200[first], r200[last]), ((x - first) * 1000 + last - first).astype(np.uint64))
        right_ok, left_ok = x + 100 + a <= end[t], x - 75 + a >= begin[t]
        right = np.where(right_ok, r100[np.minimum(x, len(r100) - 1)], run) >> np.uint64(33)
        left = np.where(left_ok, r100[np.maximum(x - 75, 0)], run) >> np.uint64(33)
        base = begin[t] - a
        yield t, x - base, first - base, last - base, r25[x], right, left, run


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes one after the other, and where each begins (one more at the end)."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]] if len(texts) else np.zeros(0, np.uint8)
    return np.ascontiguousarray(data), offs - offs[0]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offs = _bytes_of(b.column(2))
        run = (offs[:-1] // SCAN) if len(offs) > 1 else offs[:0]
        edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), b.num_rows]
        for i, j in zip(edges, edges[1:], strict=False):
            o = offs[i : j + 1] - offs[i]
            if o[-1] < LENGTH:
                continue
            for t, x, first, last, g, right, left, c in anchors(data[offs[i] : offs[j]], o[:-1], o[1:]):
                row = pa.array(t + i)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(row), b.column(1).take(row), pa.array(x.astype(np.int32)), pa.array((x - first).astype(np.int16)), pa.array((last - x).astype(np.int16)), pa.array(g.view(np.int64)), pa.array(c.view(np.int64)), pa.array(right.astype(np.int32)), pa.array(left.astype(np.int32))],
                    names=["k1", "k2", "x", "before", "after", "g", "c", "r", "l"],
                )


_ANCHOR = "k1 long, k2 long, x int, before short, after short, g long, c long, r int, l int"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each run of windows: columns text, then a list of (place, before, after, g, n, big)."""
    for b in batches:
        data, offs = _bytes_of(b.column(2))
        out: list[list] = [[] for _ in range(7)]
        for i, places in enumerate(b.column(3).to_pylist()):
            o = int(offs[i])
            for m in places:
                lo = m["x"] - m["before"]
                for c, v in zip(out, (m["g"], b.column(0)[i].as_py(), b.column(1)[i].as_py(), lo, m["n"] == 1, m["big"], data[o + lo : o + m["x"] + m["after"] + LENGTH].tobytes()), strict=True):
                    c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["g", "k1", "k2", "lo", "alone", "big", "bytes"])


def _windows(cut: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, window's place in its text, name) of every window of the rows' bytes."""
    data, offs = _bytes_of(cut.column("bytes").combine_chunks())
    _, _, r200 = ranks(data)
    n = np.diff(offs) - LENGTH + 1
    row = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    g = cut.column("g").to_numpy().view(np.uint64)
    return row, k + cut.column("lo").to_numpy()[row], _mix(r200[offs[row] + k], g[row])


def _spans(row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows as (row, first byte, byte after the last)."""
    if not len(row):
        return row, place, place
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(row) - 1]])
    return row[new], place[new], place[last] + LENGTH


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor: windows that repeat within their group, as spans."""
    held: list[pa.RecordBatch] = []

    def ranked(t: pa.Table) -> Iterator[pa.RecordBatch]:
        row, place, name = _windows(t)
        _, back, times = np.unique(name, return_inverse=True, return_counts=True)
        again = (times[back] > 1) & t.column("alone").to_numpy()[row]
        r, a, b = _spans(row[again], place[again])
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array(t.column(c).to_numpy()[r]) for c in ("k1", "k2")] + [pa.array(v.astype(np.int32)) for v in (a, b)], names=["k1", "k2", "a", "b"])

    size = 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size < 10_000:
            continue
        t = pa.Table.from_batches(held)
        g = t.column("g").to_numpy()
        cut = int(np.flatnonzero(g != g[-1])[-1]) + 1 if (g != g[-1]).any() else 0
        if cut:
            yield from ranked(t.slice(0, cut))
        held = t.slice(cut).combine_chunks().to_batches()
        size = t.num_rows - cut
    if held and size:
        yield from ranked(pa.Table.from_batches(held))


def _single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        t = pa.Table.from_batches([b])
        row, place, name = _windows(t)
        yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), *(pa.array(t.column(c).to_numpy()[row]) for c in ("k1", "k2")), pa.array(place.astype(np.int32))], names=["name", "k1", "k2", "a"])


def repeated_spans(texts: DataFrame, group: int = GROUP) -> DataFrame:
    """(k1, k2, a, b): byte ranges of texts that repeated strings cover.  texts: k1, k2, text."""
    spark = texts.sparkSession
    found, found_path = save(texts.mapInArrow(_scan, _ANCHOR), "anchors")
    # written first, so that both sides of the join are shuffled for it and a hot anchor's rows can be split
    twice, _ = save(found.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g"), "repeated-names")
    kept, _ = save(found.join(twice, "g", "left_semi"), "repeated-anchors")
    drop_table(spark, found_path)
    runs, _ = save(kept.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "x", "before", "after", "r", "l")).alias("m")).select("g", "c", "n", "m.*"), "runs")
    whole = kept.join(runs.where("n > 1").select("g", "c"), ["g", "c"], "left_semi").select("k1", "k2", (F.col("x") - F.col("before")).alias("a"), (F.col("x") + F.col("after") + LENGTH).alias("b"))
    mixed = runs.groupBy("g").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("g", (F.col("kinds") > group).alias("big"))
    open_, _ = save(runs.join(mixed, "g"), "open-runs")
    right = open_.groupBy("g", "r").agg(F.count(F.lit(1)).alias("rn")).where("rn > 1")
    left = open_.groupBy("g", "l").agg(F.count(F.lit(1)).alias("ln")).where("ln > 1")
    open_ = open_.join(right, ["g", "r"], "left").join(left, ["g", "l"], "left").where("rn is not null or ln is not null")
    per = open_.groupBy("k1", "k2").agg(F.collect_list(F.struct("x", "before", "after", "g", "n", "big")).alias("places"))
    cut, _ = save(texts.join(per, ["k1", "k2"]).select("k1", "k2", "text", "places").mapInArrow(_cut, "g long, k1 long, k2 long, lo int, alone boolean, big boolean, bytes binary"), "surroundings")
    near = cut.where("not big").repartition(parallelism(spark), "g").sortWithinPartitions("g").mapInArrow(_compare, "k1 long, k2 long, a int, b int")
    single, _ = save(cut.where("big").mapInArrow(_single_windows, "name long, k1 long, k2 long, a int"), "windows")
    again = single.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name")
    far = single.join(again, "name", "left_semi").select("k1", "k2", "a", (F.col("a") + LENGTH).alias("b"))
    out, _ = save(whole.unionByName(near).unionByName(far), "spans")
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, group: int = GROUP) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row, and with ``keep_text`` the bytes that stay (``kept``)."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = src.select("doc_id", *row_key(F.col("doc_id"), F.col("text")), "text")
    spans = repeated_spans(keyed.select("k1", "k2", "text"), group)
    per = spans.distinct().groupBy("k1", "k2").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = _bytes_of(b.column(1))
            out: list[list] = [[] for _ in range(5)]
            for i, (starts, ends) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                body = data[offs[i] : offs[i + 1]]
                n_spans = 0
                if starts:
                    edge = np.zeros(len(body) + 1, np.int32)
                    np.add.at(edge, np.asarray(starts), 1)
                    np.add.at(edge, np.asarray(ends), -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = body[~gone].tobytes()
                else:
                    kept = body.tobytes()
                for c, v in zip(out, (len(body), len(body) - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), kept if keep_text else None), strict=True):
                    c.append(v)
            arrays = [pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays][: 6 if keep_text else 5], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if keep_text else 5])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")
    return keyed.join(per, ["k1", "k2"], "left").select("doc_id", "text", "a", "b").mapInArrow(run, schema)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), keep_text=False)
