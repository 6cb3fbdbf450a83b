"""Encoding with the byte-level BPE vocabulary of the ``tokenizers`` library.

Two ways that give the library's ids for a whole text:

* :class:`WordEncoder` cuts a text before single spaces, where the byte-level pre-tokenizer always
  cuts, and lets the library encode each distinct piece once per worker;
* :func:`resync_encode` is for huge documents: overlapping chunks are encoded with offsets and
  spliced at boundaries that are provably stable; the overlap widens where none is found.

Defined results: a null text is an empty one and has no ids (but an end id, where one is asked for);
repeated texts get equal ids; special strings inside texts are handled as the library does.
"""

from __future__ import annotations

import codecs
import gc
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cohortlens.llm import worker

#: Texts longer than this many code points are encoded in overlapping chunks.
CHUNK, OVERLAP = 32_768, 256
#: Distinct pieces that a worker remembers before it starts a new memory; what the last one held is taken over when it is met again.
MEMORY = 400_000
#: Bytes of text handled at once.
SLICE_BYTES = 6 << 20

_WS = "\t-\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A space between two white-space characters: the only place where a cut before a space may change tokens.
_UNSAFE = f"[{_WS}] [{_WS}]"
_TAIL = ".,!?;:%&$*#|"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stays, the rest follows from 256 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class WordEncoder:
    """Ids of many texts; the library encodes a distinct piece once and numpy puts the pieces together."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.alphabet = _byte_alphabet()
        self.table = "".join(self.alphabet)
        self.past_atoms: dict[str, tuple] = {}
        self.atoms: dict[str, tuple] = {}
        self._begin()
        self._reset()

    def _begin(self) -> None:
        self.slots: dict[str, int] = {}
        self.heads: dict[str, int] = {}
        self.pool, self.start, self.length = array("I"), array("q"), array("i")

    def _reset(self) -> None:
        """A new memory; the one before it stays within reach."""
        self.past = (self.slots, self.heads, self.pool, self.start, self.length)
        self._begin()

    def _library(self, piece: str) -> list[int]:
        return self.tok.encode(piece, add_special_tokens=False).ids

    def _atom(self, s: str, whole: bool = False) -> tuple:
        """Ids of a piece without a white-space run inside; letters alone are one pre-token, which goes to the model directly.

        ``whole``: the caller remembers the piece itself.
        """
        got = None if whole else self.atoms.get(s) or self.past_atoms.get(s)
        if got is None:
            word = s[1:] if s[:1] == " " else s
            if word.isalpha():
                mapped = self._mapped(word)
                got = tuple([t.id for t in self.model.tokenize(mapped if word is s else self.alphabet[32] + mapped)])
            else:
                core = s.rstrip(_TAIL)
                if core and core is not s and core != s and core[-1:].isalpha():
                    got = self._atom(core) + self._atom(s[len(core) :])
                else:
                    got = tuple(self._library(s))
            if not whole:
                self.atoms[s] = got
        return got

    def _piece(self, s: str) -> tuple:
        if "\n" in s:
            parts = s.split("\n")
            body = parts[0].removeprefix(" ")
            if body and not any(not p or re.search(r"\s", p) for p in [body, *parts[1:]]):
                out = self._atom(parts[0])
                for p in parts[1:]:
                    out += self._atom("\n") + self._atom(p)
                return out
            return tuple(self._library(s))
        return self._atom(s, whole=True)

    def _stored(self, many: list) -> int:
        """Keeps the ids of new pieces; returns the slot of the first."""
        first = len(self.start)
        sizes = np.fromiter(map(len, many), np.int64, len(many))
        self.start.frombytes((len(self.pool) + np.cumsum(sizes) - sizes).tobytes())
        self.length.frombytes(sizes.astype(np.int32).tobytes())
        self.pool.extend(chain.from_iterable(many))
        return first

    def _mapped(self, word: str) -> str:
        """The word in the model's alphabet."""
        return word if word.isascii() else codecs.charmap_decode(word.encode(), "strict", self.table)[0]

    def _new(self, words: list[str], known: dict[str, int], past: dict[str, int], lead: str) -> list:
        """Ids of pieces that are not known yet, which get the next slots and stand in ``known`` from now on: letters alone first, as they serve their forms with signs."""
        tokenize, space, mapped, atoms = self.model.tokenize, self.alphabet[32] if lead else "", self._mapped, self.atoms
        first, out = len(self.start), []
        if past:
            _, _, pool, start, length = self.past
            held = [w for w in words if w in past]
            out = [pool[start[at] : start[at] + length[at]] for at in map(past.__getitem__, held)]
            known.update(zip(held, range(first, first + len(held)), strict=True))
            words = [w for w in words if w not in past]
        begun = first + len(out)
        bare = [w for w in words if w.isalpha()]  # letters alone are one pre-token
        out += [[t.id for t in tokenize(space + mapped(w))] for w in bare]
        rest = [w for w in words if not w.isalpha()]
        known.update(zip(chain(bare, rest), range(begun, begun + len(words)), strict=True))
        nl = self._atom("\n") if rest else ()
        for w in rest:
            core = w.rstrip(_TAIL)
            if core.isalpha():  # most of these words came without signs already
                at = known.get(core)
                if at is None:
                    head = atoms.get(lead + core)
                    if head is None:
                        head = atoms[lead + core] = tuple([t.id for t in tokenize(space + mapped(core))])
                elif at < first:
                    head = self.pool[self.start[at] : self.start[at] + self.length[at]]
                else:
                    head = out[at - first]
                tail = w[len(core) :]
                out.append((*head, *(atoms.get(tail) or self._atom(tail))))
            elif "\n" in w and "\n".join(parts := w.split()) == w:  # single line breaks between visible characters
                ids = [*self._atom(lead + parts[0])]
                for p in parts[1:]:
                    ids += nl
                    ids += atoms.get(p) or self._atom(p)
                out.append(ids)
            else:
                out.append(self._piece(lead + w) if lead or w else ())
        return out

    def _look_up(self, pieces: pa.Array, known: dict[str, int], past: dict[str, int], lead: str) -> np.ndarray:
        """Slots of distinct pieces."""
        pieces = pieces.to_numpy(zero_copy_only=False).tolist()
        out = list(map(known.get, pieces))
        missing = [i for i, at in enumerate(out) if at is None]
        if missing:
            collects = gc.isenabled()
            gc.disable()  # many small lists and no cycle: looking for cycles took a quarter of the time
            try:
                self._stored(self._new([pieces[i] for i in missing], known, past, lead))
            finally:
                if collects:
                    gc.enable()
            for i in missing:
                out[i] = known[pieces[i]]
        return np.array(out, np.int64)

    def _whole(self, text: str) -> np.ndarray:
        return resync_encode(self.tok, text) if len(text) > CHUNK else np.asarray(self._library(text), np.uint32)

    def encode(self, texts: pa.Array, want_ids: bool = True, end_id: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray | None]]:
        """For runs of texts: (first, after the last, token counts, all ids of the run or None); with ``end_id`` each text ends in it."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        if not n:
            return
        size = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1])
        cut = np.flatnonzero(np.diff(np.cumsum(size) // SLICE_BYTES, prepend=0)).tolist()
        edges = sorted({0, *cut, n})
        for a, b in zip(edges, edges[1:], strict=False):
            yield from self._encode(texts.slice(a, b - a), a, want_ids, end_id)

    def _encode(self, texts: pa.Array, base: int, want_ids: bool, end_id: int | None):
        if len(self.slots) + len(self.heads) > MEMORY:
            self._reset()
        if len(self.atoms) > MEMORY:
            self.atoms, self.past_atoms = {}, self.atoms
        n = len(texts)
        odd = pc.match_substring_regex(texts, _UNSAFE)
        for s in self.specials:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        whole = {}
        if len(odd):
            mask = np.zeros(n, bool)
            mask[odd] = True
            whole = {int(i): self._whole(texts[int(i)].as_py()) for i in odd}
            texts = pc.if_else(pa.array(mask), "", texts)
        split = pc.split_pattern(texts, " ")
        offs = split.offsets.to_numpy().astype(np.int64)
        offs = offs - offs[0]
        flat = split.flatten()
        coded = flat.dictionary_encode()
        slots = self._look_up(coded.dictionary, self.slots, self.past[0], " ")[coded.indices.to_numpy()]
        first = offs[:-1]
        heads = flat.take(pa.array(first)).dictionary_encode()
        slots[first] = self._look_up(heads.dictionary, self.heads, self.past[1], "")[heads.indices.to_numpy()]
        if end_id is not None:  # one more piece for each text
            slots = np.insert(slots, offs[1:], self._stored([(end_id,)]))
            offs = offs + np.arange(n + 1)
        start, length, pool = (np.frombuffer(x, t) for x, t in ((self.start, np.int64), (self.length, np.int32), (self.pool, np.uint32)))
        try:
            each = length[slots]
            upto = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
            counts = upto[offs[1:]] - upto[offs[:-1]]
            ends = int(end_id is not None)
            for i, x in whole.items():
                counts[i] = len(x) + ends
            if not want_ids:
                yield base, base + n, counts, None
                return
            run = np.cumsum(counts) >> 20
            edges = sorted({0, *np.flatnonzero(np.diff(run, prepend=0)).tolist(), n})
            for a, b in zip(edges, edges[1:], strict=False):
                p, q = offs[a], offs[b]
                m = each[p:q]
                total = int(upto[q] - upto[p])
                at = np.arange(total, dtype=np.int32)
                at += np.repeat((start[slots[p:q]] - (upto[p:q] - upto[p])).astype(np.int32), m)
                ids = pool[at] if total else np.zeros(0, np.uint32)
                if inside := [i for i in whole if a <= i < b]:
                    parts, done = [], 0
                    for i in sorted(inside):
                        k = int(upto[offs[i]] - upto[p])
                        parts += [ids[done:k], whole[i]]
                        done = k + int(upto[offs[i + 1]] - upto[offs[i]]) - ends  # an end id stays
                    ids = np.concatenate([*parts, ids[done:]]).astype(np.uint32)
                yield base + a, base + b, counts[a:b], ids
        finally:
            del start, length, pool


_KNOWN: dict[str, WordEncoder] = {}
worker.keeps("tokens", _KNOWN.clear)


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process, kept between tasks."""
    worker.begin("tokens")
    if path not in _KNOWN:
        _KNOWN[path] = WordEncoder(path)
    return _KNOWN[path]


_STABLE = re.compile(r"(?<=\S)[ \n](?=\S)")


def stable_cuts(text: str, a: int, b: int) -> list[int]:
    """Positions in [a, b) before which the pre-tokenizer cuts whatever stands further away: a single space or newline between two visible characters."""
    return [m.start() for m in _STABLE.finditer(text, max(a, 0), min(b + 1, len(text))) if a <= m.start() < b]


def resync_encode(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """Ids of a huge text from overlapping chunks.

    The next chunk starts ``overlap`` before the end of this one.  In the overlap a stable cut is
    sought at which a token starts in both encodings; the ids are spliced there.  If there is none,
    the overlap widens (at last over the whole of the text before, which always fits).
    """
    enc = tok.encode(text[:chunk], add_special_tokens=False)
    ids, starts = np.asarray(enc.ids, np.uint32), np.asarray([o[0] for o in enc.offsets], np.int64)
    end, out, done = min(chunk, len(text)), [], 0  # tokens that start before ``done`` are spliced already
    while end < len(text):
        wide = overlap
        while True:
            begin = max(done, end - wide)
            nxt_end = min(len(text), end + chunk)
            nxt = tok.encode(text[begin:nxt_end], add_special_tokens=False)
            nstarts = np.asarray([o[0] for o in nxt.offsets], np.int64) + begin
            cuts = stable_cuts(text, begin + 1, end - 1) if begin > done else [done]
            both = np.intersect1d(np.intersect1d(np.asarray(cuts, np.int64), _true_starts(text, starts)), _true_starts(text, nstarts)) if begin > done else np.asarray([done])
            if len(both):
                at = int(both[-1])
                break
            wide *= 4
        shift, nshift = _true_starts(text, starts), _true_starts(text, nstarts)
        out.append(ids[(shift >= done) & (shift < at)] if done else ids[shift < at])
        keep = nshift >= at
        ids, starts = np.asarray(nxt.ids, np.uint32)[keep], nstarts[keep]
        done, end = at, nxt_end
    return np.concatenate([*out, ids]) if out else ids


def _true_starts(text: str, starts: np.ndarray) -> np.ndarray:
    """Token starts with the leading space, which the library's trimmed offsets leave out, counted in."""
    low = int(starts[0]) if len(starts) else 0
    codes = np.frombuffer(text[max(0, low - 1) : int(starts[-1]) + 1].encode("utf-32-le", "surrogatepass"), np.uint32) if len(starts) else np.zeros(0, np.uint32)
    at = starts - max(0, low - 1)
    space = (starts > 0) & (codes[np.maximum(at - 1, 0)] == 32)
    back = np.flatnonzero(space)
    seen = np.array([not (s < len(text) and text[s].isspace()) for s in starts[back].tolist()], bool) if len(back) else np.zeros(0, bool)
    out = starts.copy()
    out[back[seen]] -= 1
    return out
