"""Canonical exact fingerprints of documents, in DataFrame functions only.

Canonical text: compatibility normal form (NFKC) with case folding, and white-space runs become one
space (none at the ends).  Characters are folded one by one; runs of combining marks are put in
canonical order (32 marks at a time, more than any writing system stacks) and composed with the
letter before them, conjoining Hangul letters with one another.  Plain Latin text skips all but the
lower-casing.  The fingerprint is two chained XXH64 values of the canonical
text.  Equal fingerprints are checked byte by byte: in a bucket whose least and greatest canonical
texts differ, the fingerprint carries the text's SHA-256 as well, so that equal fingerprints always
mean equal canonical texts.

Defined results: a null text is an empty one; equal ids are ordered by text; a null id comes first;
repeated rows stay; other columns are ignored; an empty table gives no rows; very long texts are read
whole.  With one row the next document is the row itself.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import documents, parallelism, save, shards

_SPACE = "[\\s\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


#: Marks that are put in order at once.
STACK = 32
#: Frequent characters with longer forms, which are replaced before all others are looked for.
_FREQUENT = "…™½¼¾ﬁﬂ№"
#: The Greek iota below, a mark that folds to a letter once marks are in order.
_IOTA = "\u0345"
_PLAIN = "[^\\x00-\\x9f\\u00c0-\\u0131]"
_NUL = "\x00"


class Unicode(NamedTuple):
    """Parallel strings made from Python's Unicode data; lists are joined by NUL."""

    one: str  # characters whose folded form is one character
    to: str
    many: str  # characters whose folded form is longer
    forms: str
    marks: str  # combining marks, and their classes as characters in order
    classes: str
    dec: str  # characters with a canonical decomposition
    parts: str
    second: str  # marks that compose, the letters before them, and what they make
    bases: str
    built: str


def _folded(text: str) -> str:
    nf = unicodedata.normalize
    return nf("NFKC", nf("NFKC", nf("NFD", text).casefold()).casefold())


@lru_cache
def _unicode() -> Unicode:
    one, many, marks, dec, pairs = {}, {}, {}, {}, {}
    for c in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= c < 0xE000 or 0xAC00 <= c < 0xD7A4:
            continue
        ch = chr(c)
        form, d = _folded(ch), unicodedata.normalize("NFD", ch)
        if _IOTA in d and ch != _IOTA:
            form = _folded(d.replace(_IOTA, "")) + _IOTA
        if form != ch and ch != _IOTA:
            (one if len(form) == 1 else many)[ch] = form
        if unicodedata.combining(ch):
            marks[ch] = chr(0x100 + unicodedata.combining(ch))
        if d != ch:
            dec[ch] = d
            step = unicodedata.decomposition(ch).split()
            if len(step) == 2 and unicodedata.normalize("NFC", ch) == ch and chr(int(step[1], 16)) != _IOTA:
                base, mark = (chr(int(x, 16)) for x in step)
                pairs.setdefault(mark, {})[base] = ch
    join = "".join
    return Unicode(
        join(one), join(one.values()), join(many), _NUL.join(many.values()), join(marks), join(marks.values()), join(dec), _NUL.join(dec.values()),
        join(pairs), _NUL.join(map(join, pairs.values())), _NUL.join(join(x.values()) for x in pairs.values()),
    )


def _class_of(chars: str, gap: int = 16) -> str:
    """A character class that holds them, and what stands in gaps of that width, so that it has few ranges."""
    codes, runs = sorted(map(ord, chars)), []
    for c in codes:
        if runs and c <= runs[-1][1] + gap:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"


def _listed(joined: str) -> Column:
    return F.split(F.lit(joined), _NUL)


def _looked_up(c: Column, keys: str, values: Column, other: Column) -> Column:
    at = F.instr(F.lit(keys), c)
    return F.when((at > 0) & (F.length(c) == 1), F.element_at(values, F.greatest(at, F.lit(1)))).otherwise(other)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _ordered_and_composed(cluster: Column) -> Column:
    """One letter and its marks in canonical order, composed as far as they are not blocked."""
    u = _unicode()
    starter = F.lit(chr(0x100))
    chars = F.filter(F.flatten(F.transform(F.split(cluster, ""), lambda c: F.split(_looked_up(c, u.dec, _listed(u.parts), c), ""))), lambda c: c != "")
    ranked = F.transform(chars, lambda c: F.struct(_looked_up(c, u.marks, F.split(F.lit(u.classes), ""), starter).alias("k"), c.alias("c")))

    def placed(x: Column) -> Column:
        run = lambda i: F.size(F.filter(F.slice(x, 1, i + 1), lambda y: y["k"] == starter))
        return F.array_sort(F.transform(x, lambda y, i: F.struct(run(i).alias("run"), y["k"].alias("k"), i.alias("i"), y["c"].alias("c"))))

    def made(a: Column, b: Column) -> Column:
        k = F.greatest(F.instr(F.lit(u.second), b), F.lit(1))
        j = F.instr(F.element_at(_listed(u.bases), k), a)
        return F.when(F.contains(F.lit(u.second), b) & (F.length(a) > 0) & (j > 0), F.substring(F.element_at(_listed(u.built), k), j, F.lit(1))).otherwise("")

    state = lambda done, first, tail, last: F.struct(done.alias("done"), first.alias("first"), tail.alias("tail"), last.alias("last"))

    def step(s: Column, x: Column) -> Column:
        blocked = (s["tail"] != "") & (s["last"] >= x["k"])
        new = F.when(blocked, "").otherwise(made(s["first"], x["c"]))
        begins = state(F.concat(s["done"], s["first"], s["tail"]), x["c"], F.lit(""), F.lit(""))
        return F.when(new != "", state(s["done"], new, s["tail"], s["last"])).when(x["k"] == starter, begins).otherwise(state(s["done"], s["first"], F.concat(s["tail"], x["c"]), x["k"]))

    return F.aggregate(_let(ranked, placed), state(*[F.lit("")] * 4), step, lambda s: F.concat(s["done"], s["first"], s["tail"]))


def _composed(text: Column) -> Column:
    pieces = F.regexp_extract_all(text, F.lit(f"(?s)\\P{{M}}*+\\p{{M}}{{1,{STACK}}}|\\P{{M}}++"), F.lit(0))

    def piece(p: Column) -> Column:
        n = F.length(F.regexp_extract(p, "^\\P{M}*+", 0))
        head = F.greatest(n - 1, F.lit(0))
        return F.when(n < F.length(p), F.concat(F.left(p, head), _ordered_and_composed(F.substring(p, head + 1, F.length(p))))).otherwise(p)

    return F.array_join(F.transform(pieces, piece), "")


def _hangul(text: Column) -> Column:
    """Conjoining letters as syllables, by their numbers."""
    pieces = F.regexp_extract_all(text, F.lit("(?s)[\\u1100-\\u1112][\\u1161-\\u1175][\\u11a8-\\u11c2]?|[\\uac00-\\ud7a3][\\u11a8-\\u11c2]|[^\\u1100-\\u1112\\uac00-\\ud7a3]++|."), F.lit(0))

    def piece(p: Column) -> Column:
        code = lambda i: F.ascii(F.substring(p, i, 1))
        last = F.when(F.length(p) == 3, code(3) - 0x11A7).otherwise(0)
        syllable = F.when(p.rlike("^[\\u1100-\\u1112][\\u1161-\\u1175]"), (code(1) - 0x1100) * 588 + (code(2) - 0x1161) * 28 + last + 0xAC00)
        syllable = syllable.when(p.rlike("^[\\uac00-\\ud7a3][\\u11a8-\\u11c2]") & ((code(1) - 0xAC00) % 28 == 0), code(1) + code(2) - 0x11A7)
        return F.when(syllable.isNull(), p).otherwise(F.decode(F.unhex(F.lpad(F.hex(syllable), 4, "0")), "UTF-16BE"))

    return F.array_join(F.transform(pieces, piece), "")


def _spelt_out(text: Column) -> Column:
    """Characters whose folded form is longer, replaced."""
    u = _unicode()
    many = _class_of(u.many)
    runs = F.regexp_extract_all(text, F.lit(f"(?s){many}|[^{many[1:-1]}]++"), F.lit(0))
    some = F.length(F.translate(text, u.many, "")) < F.length(text)
    return F.when(some, F.array_join(F.transform(runs, lambda r: _looked_up(r, u.many, _listed(u.forms), r)), "")).otherwise(text)


def canonical(text: Column) -> Column:
    """The text that is digested.  Each step works on a value that is worked out once."""
    u = _unicode()
    low = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    single = F.translate(low, u.one, u.to)
    for c in _FREQUENT:
        single = F.replace(single, F.lit(c), F.lit(_folded(c)))
    ordered = lambda x: F.when(x.rlike("\\p{M}"), F.translate(_composed(x), _IOTA, "ι")).otherwise(x)
    joined = lambda x: F.when(x.rlike("[\\u1161-\\u1175\\u11a8-\\u11c2]"), _hangul(x)).otherwise(x)
    full = _let(_let(_let(single, _spelt_out), ordered), joined)
    return F.trim(F.regexp_replace(F.when(low.rlike(_PLAIN), full).otherwise(low), _SPACE, " "))


def wide_hash(text: Column) -> list[Column]:
    """128 bits of two XXH64 values (seed 42, and the hash of 1 as seed)."""
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def hex_print(h1: Column, h2: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(h1), 16, "0"), F.lpad(F.hex(h2), 16, "0")))


_CARRIED = (("text", "string"), ("h1", "long"), ("h2", "long"), ("sha", "binary"))


def with_next(docs: DataFrame) -> DataFrame:
    """Adds ``next_*`` columns of the row that follows by (k, text); the first follows the last.

    docs: k long (not null), text, h1, h2, sha.  Rows are dealt by ranges of k; each range also gets the
    first rows of the range after it, so that no task needs more than its own range.
    """
    spark = docs.sparkSession
    pid, bounds = shards(docs, "k", 2 * parallelism(spark))
    ranged = docs.withColumn("pid", pid.cast("int"))
    firsts = sorted((r.pid, r.k) for r in ranged.groupBy("pid").agg(F.min("k").alias("k")).collect())  # at most one for each range
    if not firsts:
        return docs.select("*", *[F.lit(None).cast(t).alias(f"next_{c}") for c, t in _CARRIED])
    before = {firsts[i][1]: firsts[i - 1][0] for i in range(len(firsts))}
    ghost = F.create_map(*[F.lit(x) for k, p in before.items() for x in (k, p)])
    places = F.array(F.struct(F.col("pid").alias("p"), F.lit(0).alias("ghost")))
    target = F.try_element_at(ghost, F.col("k"))
    places = F.when(target.isNull(), places).otherwise(F.array_append(places, F.struct(target.alias("p"), F.lit(1).alias("ghost"))))
    dealt = ranged.withColumn("at", F.explode(places)).select("*", "at.p", "at.ghost").drop("at", "pid")
    w = Window.partitionBy("p").orderBy("ghost", "k", "text")
    return dealt.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c, _ in _CARRIED]).where("ghost = 0").drop("ghost", "p")


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    canon = canonical(F.col("text"))
    h = wide_hash(canon)
    keyed = src.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("k"), "doc_id", "text", h[0].alias("h1"), h[1].alias("h2"), F.unhex(F.sha2(canon, 256)).alias("sha"))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = with_next(keyed).withColumn("edited", F.concat(F.left("text", n - cut), F.left("next_text", cut)))
    edited = edited.select("doc_id", n.cast("long").alias("n_chars"), "h1", "h2", "sha", "next_h1", "next_h2", "next_sha", "edited", canonical(F.col("edited")).alias("canon"))
    e = wide_hash(F.col("canon"))
    slim, _ = save(edited.select(*[c for c in edited.columns if c not in ("edited", "canon")], F.sha2("edited", 256).alias("edited_sha256"), e[0].alias("e1"), e[1].alias("e2"), F.unhex(F.sha2("canon", 256)).alias("e_sha")), "fingerprints")
    collided, _ = save(colliding(src, slim), "collided")
    clash = not collided.isEmpty()
    out = slim
    for name, x1, x2, sha in (("fingerprint", "h1", "h2", "sha"), ("edited_fingerprint", "e1", "e2", "e_sha"), ("next_fingerprint", "next_h1", "next_h2", "next_sha")):
        made = hex_print(F.col(x1), F.col(x2))
        if clash:  # texts of such a bucket are told apart by a second digest
            bad = collided.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"))
            out = out.join(bad, (F.col(x1) == bad.b1) & (F.col(x2) == bad.b2), "left").withColumn(name, F.when(F.col("b1").isNull(), made).otherwise(F.concat(made, F.lower(F.hex(sha))))).drop("b1", "b2")
        else:
            out = out.withColumn(name, made)
    same = lambda x, y: (F.col(x) == F.col(y)).cast("double")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", same("fingerprint", "edited_fingerprint").alias("near_edited"), same("fingerprint", "next_fingerprint").alias("near_next"))


def colliding(src: DataFrame, slim: DataFrame) -> DataFrame:
    """(h1, h2) of buckets whose canonical texts are not all equal.

    Buckets with several documents compare their canonical texts byte by byte, through the least and
    the greatest, which every task finds for its own rows first; edited texts compare digests.
    """
    keys = slim.select("h1", "h2", "sha", F.lit(1).alias("own")).unionByName(slim.select(F.col("e1").alias("h1"), F.col("e2").alias("h2"), F.col("e_sha").alias("sha"), F.lit(0).alias("own")))
    buckets = keys.groupBy("h1", "h2").agg(F.sum("own").alias("n"), F.min("sha").alias("low"), F.max("sha").alias("high"))
    by_digest = buckets.where("low <> high").select("h1", "h2")
    several = buckets.where("n > 1").select("h1", "h2")
    canon = canonical(F.col("text"))
    h = wide_hash(F.col("canon"))
    texts = src.select(canon.alias("canon")).select("canon", h[0].alias("h1"), h[1].alias("h2")).join(several, ["h1", "h2"], "left_semi")
    by_bytes = texts.groupBy("h1", "h2").agg(F.min("canon").alias("low"), F.max("canon").alias("high")).where("low <> high").select("h1", "h2")
    return by_digest.unionByName(by_bytes).distinct()


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(documents(spark, sf_dir))
