"""Alignment of two tokenizers' tokens over the same bytes (bitsets of token ends).

A text with a space before it is encoded by a byte-level BPE (A) and by a SentencePiece BPE with byte
fallback (B).  The ends of A's tokens and of B's tokens are marked in packed bitsets over the text's
bytes; their AND holds the shared cuts, running popcounts (rank) turn a cut into the numbers of A and B
tokens before it, so that every two neighbouring cuts give one group of A tokens and one of B tokens,
and the tokens that end at a cut are linked.

Texts are cut before single spaces between visible characters, where neither encoding has a token
across: A's pre-tokenizer always cuts there, and B has no piece with a space inside (checked when the
vocabulary is read; with such pieces whole texts are encoded).  A worker remembers the alignment of
pieces, so only new ones are encoded and marked.

Defined results: a null or empty text, and one whose joined tokens aren't the text's bytes (it holds
U+2581), have no tokens: zeros and an empty string; rows keep their multiplicity, and repeated rows count
each for itself; a null id stays null; an empty table gives no rows; very long texts are cut like any
other, their tokens are hashed piece by piece; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm import tokens
from cohortlens.llm.common import Tables, documents

#: Pieces, and bytes of them, that a worker remembers before it starts anew; parts of pieces that it remembers besides.
MEMORY, MEMORY_BYTES, MEMORY_PARTS = 150_000, 16 << 20, 60_000
#: Bytes of text handled at once.
SLICE_BYTES = 2 << 20
#: Pieces of one text that are hashed at once.
HASHED = 50_000

_SPACE = "▁"
_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Texts with a space that isn't between visible characters, which take the slower cut.
_ODD = rf"^ | $|[{tokens._WS}] | [{tokens._WS}]"


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def cut_groups(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For token byte lengths over the same bytes: shared cuts, and the A and B tokens that end at or before each."""
    total = int(size_a.sum())
    words = -(-total // 64)
    packed = []
    for size in (size_a, size_b):
        mark = np.zeros(words * 64, np.uint8)
        mark[np.cumsum(size) - 1] = 1
        packed.append(np.packbits(mark, bitorder="little").view(np.uint64))
    shared = packed[0] & packed[1]
    at = np.flatnonzero(np.unpackbits(shared.view(np.uint8), bitorder="little"))  # select
    word, low = at >> 6, (at & 63).astype(np.uint64)
    mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - low)
    ranks = []
    for bits in packed:
        ones = np.bitwise_count(bits).astype(np.int64)
        ranks.append((np.cumsum(ones) - ones)[word] + np.bitwise_count(bits[word] & mask))
    return at + 1, ranks[0], ranks[1]


class Aligner:
    """Aligns distinct pieces once; pieces are kept in pooled arrays and found by slot."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor

        self.enc = tokens.WordEncoder(path_a)
        self.enc.tok.encode_special_tokens = True  # special strings inside texts are plain text
        self.enc.specials = []
        byte = {c: bytes([b]) for b, c in enumerate(self.enc.alphabet)}
        vocab = self.enc.tok.get_vocab()
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = b"".join([byte.get(c, c.encode()) for c in token])
        self.sp = SentencePieceProcessor(model_file=path_b)
        n = self.sp.get_piece_size()
        pieces = self.sp.id_to_piece(list(range(n)))
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.cuts = not any(_SPACE in p.lstrip(_SPACE) for p in pieces)
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.text_a = [str(i) for i in range(len(self.bytes_a))]
        self.text_b = [str(i) for i in range(n)]
        self.code = np.uint32 if len(self.bytes_a) * n < 1 << 32 else np.uint64
        self._reset()

    def _reset(self) -> None:
        self.slots: dict[str, int] = {}
        self.held = 0
        self.n_a, self.n_b, self.start, self.n_groups = array("i"), array("i"), array("q"), array("i")
        self.ok, self.text = bytearray(), []
        self.pool = array("I" if self.code is np.uint32 else "Q")

    def pair_bound(self) -> int:
        """Most linked id pairs that there can be: of two tokens that end together one is a suffix of the other, so a token is linked to at most one byte string for each of its bytes, and few ids share a string."""
        same = max(np.unique(np.array(x, object), return_counts=True)[1].max() for x in ([b for b in self.bytes_a if b], [b for b in self.bytes_b if b]))
        return int(same * (self.size_a.sum() + self.size_b.sum()))

    def _new(self, keys: list[str]) -> int:
        """Encodes and aligns pieces (each with a space before it); returns the slot of the first."""
        first = len(self.ok)
        ids_a = [self.enc._piece(" " + w) for w in keys]
        ids_b = self.sp.encode(keys, num_threads=1)
        good = []
        for i, w in enumerate(keys):
            raw = b" " + w.encode("utf-8", "replace")
            if b"".join([self.bytes_a[t] for t in ids_a[i]]) == raw and b"".join([self.bytes_b[t] for t in ids_b[i]]) == raw:
                good.append(True)
            else:
                good.append(False)
                ids_a[i], ids_b[i] = (), ()
        n_a, n_b = np.fromiter(map(len, ids_a), np.int64, len(keys)), np.fromiter(map(len, ids_b), np.int64, len(keys))
        flat_a, flat_b = np.fromiter(chain.from_iterable(ids_a), np.int64, n_a.sum()), np.fromiter(chain.from_iterable(ids_b), np.int64, n_b.sum())
        _, upto_a, upto_b = cut_groups(self.size_a[flat_a], self.size_b[flat_b])
        # the last tokens of each group end together: the links
        links = (flat_a[upto_a - 1].astype(np.uint64) * np.uint64(len(self.bytes_b)) + flat_b[upto_b - 1].astype(np.uint64)).astype(self.code)
        groups = np.diff(np.searchsorted(upto_a, np.concatenate([[0], np.cumsum(n_a)]), "right"))  # pieces end at shared cuts
        self.start.frombytes((len(self.pool) + np.cumsum(groups) - groups).astype(np.int64).tobytes())
        self.pool.frombytes(links.tobytes())
        for out, x in ((self.n_a, n_a), (self.n_b, n_b), (self.n_groups, groups)):
            out.frombytes(x.astype(np.int32).tobytes())
        self.ok.extend(good)
        ta, tb = [self.text_a[i] for i in flat_a.tolist()], [self.text_b[i] for i in flat_b.tolist()]
        a = b = k = 0
        ends_a, ends_b = upto_a.tolist(), upto_b.tolist()
        for n in groups.tolist():
            parts = []
            for j in range(k, k + n):
                za, zb = ends_a[j], ends_b[j]
                parts.append((ta[a] if za == a + 1 else ",".join(ta[a:za])) + "|" + (tb[b] if zb == b + 1 else ",".join(tb[b:zb])))
                a, b = za, zb
            k += n
            self.text.append(";".join(parts))
        self.held += int(self.size_a[flat_a].sum())
        return first

    def _look_up(self, keys: list[str]) -> np.ndarray:
        out = list(map(self.slots.get, keys))
        missing = [i for i, s in enumerate(out) if s is None]
        if missing:
            new = list(dict.fromkeys([keys[i] for i in missing]))
            first = self._new(new)
            self.slots.update(zip(new, range(first, first + len(new)), strict=True))
            for i in missing:
                out[i] = self.slots[keys[i]]
        return np.array(out, np.int64)

    def align(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]]:
        """For runs of texts: (first, after the last, A tokens, B tokens, groups, digests of the groups, link codes of the run)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        if not n:
            return
        size = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1])
        run = np.diff(np.cumsum(size) // SLICE_BYTES, prepend=0)
        edges = sorted({0, *np.flatnonzero(run).tolist(), n})
        for a, z in zip(edges, edges[1:], strict=False):
            yield a, z, *self._align(texts.slice(a, z - a))

    def _align(self, texts: pa.Array):
        if len(self.slots) > MEMORY or self.held > MEMORY_BYTES:
            self._reset()
        if len(self.enc.atoms) > MEMORY_PARTS:
            self.enc.atoms, self.enc.past_atoms = {}, {}
        n = len(texts)
        odd = pc.match_substring_regex(texts, _ODD) if self.cuts else pa.array(np.ones(n, bool))
        own = {int(i): self._own_cuts(texts[int(i)].as_py()) for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False))}
        split = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        offs = split.offsets.to_numpy().astype(np.int64)
        offs = offs - offs[0]
        flat = split.flatten()
        coded = flat.dictionary_encode()
        known = self._look_up(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        each, empty = [], pc.equal(texts, "").to_numpy(zero_copy_only=False)
        none = np.zeros(0, np.int64)
        for i in range(n):
            each.append(none if empty[i] else self._look_up(own[i]) if i in own else known[offs[i] : offs[i + 1]])
        ok, text = np.frombuffer(self.ok, np.uint8), self.text
        digests = []
        for i, slots in enumerate(each):
            if len(slots) and not ok[slots].all():
                each[i] = slots = none
            digest = hashlib.sha256()
            for k in range(0, len(slots), HASHED):
                digest.update(((";" if k else "") + ";".join([text[s] for s in slots[k : k + HASHED].tolist()])).encode())
            digests.append(digest.hexdigest() if len(slots) else "")
        del ok
        slots = np.concatenate(each) if each else none
        ends = np.concatenate([[0], np.cumsum([len(x) for x in each])])
        views = [np.frombuffer(x, t)[slots] for x, t in ((self.n_a, np.int32), (self.n_b, np.int32), (self.n_groups, np.int32), (self.start, np.int64))]
        sums = []
        for v in views[:3]:
            upto = np.concatenate([[0], np.cumsum(v, dtype=np.int64)])
            sums.append(upto[ends[1:]] - upto[ends[:-1]])
        groups = views[2].astype(np.int64)
        upto = np.cumsum(groups) - groups
        at = np.repeat(views[3] - upto, groups) + np.arange(int(groups.sum()))
        links = np.frombuffer(self.pool, self.code)[at]
        return *sums, digests, links

    def _own_cuts(self, text: str) -> list[str]:
        """Pieces of a text without the space before each: cut at spaces between visible characters, if there may be cuts."""
        return _SAFE.split(text) if self.cuts else [text]


_KNOWN: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker process, kept between tasks."""
    if (path_a, path_b) not in _KNOWN:
        _KNOWN[path_a, path_b] = Aligner(path_a, path_b)
    return _KNOWN[path_a, path_b]


def align_tokens(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups_sha256, links) of each row; links: little-endian codes ``a * (B's vocabulary) + b``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(path_a, path_b)
        wide = np.dtype(al.code).itemsize
        for b in batches:
            for a, z, n_a, n_b, groups, digests, links in al.align(b.column(1)):
                ends = np.concatenate([[0], np.cumsum(groups)]) * wide
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), z - a, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(links))])
                cols = [b.column(0).slice(a, z - a), pa.array(n_a), pa.array(n_b), pa.array(groups), pa.array(digests, pa.string()), packed.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary")


def pair_counts(aligned: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(a, b, n, best) of each linked id pair: the corpus's links that hold it, and whether no pair of its b has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(path_a, path_b)
        width = len(al.bytes_b)
        for b in batches:
            code, n = np.unique(_codes(b.column(0), al.code)[0], return_counts=True)
            code = code.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(code // width), pa.array(code % width), pa.array(n.astype(np.int64))], names=["a", "b", "n"])

    counts = aligned.select("links").mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def _codes(col: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The link codes of a batch of documents, and where each document's begin (and the last one's end)."""
    col = col.cast(pa.large_binary())
    ends = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    wide = np.dtype(kind).itemsize
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and len(ends) else np.zeros(0, np.uint8)
    return np.frombuffer(raw.tobytes(), kind), (ends - ends[0]) // wide


def with_pair_counts(aligned: DataFrame, pairs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Adds n_links, n_best and count_sum; ``pairs`` is of :func:`pair_counts`.

    The pairs are broadcast: their number is bounded by the two vocabularies (:meth:`Aligner.pair_bound`),
    whatever the corpus's size.
    """
    al = aligner(path_a, path_b)
    width = len(al.bytes_b)
    got = pairs.orderBy("a", "b").limit(al.pair_bound() + 1).toArrow()
    if len(got) > al.pair_bound():
        raise ValueError("more id pairs than two vocabularies can link")
    key = got["a"].to_numpy() * width + got["b"].to_numpy()
    sent = aligned.sparkSession.sparkContext.broadcast((key.astype(al.code), got["n"].to_numpy(), got["best"].to_numpy().astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = sent.value
        for b in batches:
            codes, ends = _codes(b.column(5), keys.dtype.type)
            at = np.searchsorted(keys, codes)
            out = []
            for v in (best, n):
                upto = np.concatenate([[0], np.cumsum(v[at], dtype=np.int64)])
                out.append(pa.array(upto[ends[1:]] - upto[ends[:-1]]))
            links = pa.array(np.diff(ends))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), links, *out, b.column(4)], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    cols = aligned.select("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links")
    return cols.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = tokens.default_tokenizer(), default_pieces()
    tables = Tables(spark)
    aligned = tables.save(align_tokens(documents(spark, sf_dir), *paths), "aligned-tokens")
    return with_pair_counts(aligned, pair_counts(aligned, *paths), *paths)
