"""Which criterion lines a closed condition language could express, by the terms in their text.

A line is cut into tokens once; its runs of tokens are looked up in the term tables' hash sets, longer
runs only where a token begins a term of that length (a trie by length).  No shuffle, no regular
expression for a term, no UDF: a lexicon of any number of terms costs one look-up a run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.names import free
from cohortlens.operators.term_table import ANCHORS, BLOCKERS, NUMBER_WORDS, TIME_WORDS

CLASSES = ("expressible", "partially", "unmodeled")
SHORTEST = 12
#: Words (an apostrophe inside), numbers, and the signs that terms use; anything else parts them.
TOKEN = r"\p{L}+(?:['’]\p{L}+)?|[0-9]+(?:[.,][0-9]+)*|[<>]=?|[≤≥=%/^*]"


def _listed(words) -> str:
    return ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in sorted(words))


def _number(t: str) -> str:
    return f"({t} >= '0' AND {t} < ':')"  # begins with a digit


def _normal(t: str) -> str:
    return f"CASE WHEN {_number(t)} OR {t} IN ({_listed(NUMBER_WORDS)}) THEN '#' WHEN {t} IN ({_listed(TIME_WORDS)}) THEN '~' WHEN {t} = '≤' THEN '<=' WHEN {t} = '≥' THEN '>=' ELSE {t} END"


def _longer_runs(tokens: str, terms: list[str], normal: Callable[[str], str], classes: dict[str, str], mark: str) -> str:
    """SQL of the runs of two tokens or more that are terms; runs begin where a token, or a class of tokens, begins a term."""
    first = {t.split(" ", 1)[0] for t in terms}
    starts = " OR ".join([f"t IN ({_listed(first - set(classes))})", *(test for name, test in classes.items() if name in first)])
    lengths = sorted({t.count(" ") + 1 for t in terms})
    runs = ", ".join(f"array_join(slice(w, 1, {n}), ' ')" for n in lengths)
    at = f"filter(transform({tokens}, (t, i) -> CASE WHEN {starts} THEN i END), i -> i IS NOT NULL)"
    words = f"transform({at}, i -> transform(slice({tokens}, i + 1, {lengths[-1]}), x -> {normal('x')}))"
    return f"transform(filter(flatten(transform({words}, w -> array({runs}))), run -> run IN ({_listed(terms)})), run -> concat('{mark}', run))"


def hits(lines: DataFrame, column: str, rows: list[tuple[str, str]], out: str = "hits") -> DataFrame:
    """Adds the distinct terms of ``rows`` (signal, term) that each line holds; a null line holds none."""
    raw, low = free(lines, "__raw", "__low")
    words = {t for _, t in rows if t[0] not in "$-"}
    units = sorted({t[1:] for _, t in rows if t[0] == "$"})
    endings = sorted({t[1:] for _, t in rows if t[0] == "-"}, key=lambda e: (-len(e), e))
    classes = {"#": f"{_number('t')} OR t IN ({_listed(NUMBER_WORDS)})", "~": f"t IN ({_listed(TIME_WORDS)})", "<=": "t = '≤' OR t = '<='", ">=": "t = '≥' OR t = '>='"}
    found = []
    if single := [t for t in words if " " not in t]:
        found.append(f"filter({low}, t -> t IN ({_listed(single)}))")
    if longer := [t for t in words if " " in t]:
        found.append(_longer_runs(low, longer, _normal, classes, ""))
    if units:
        found.append(f"transform(filter({raw}, t -> t IN ({_listed(units)})), t -> concat('$', t))")
    if longer := [t for t in units if " " in t]:
        found.append(_longer_runs(raw, longer, lambda t: f"CASE WHEN {_number(t)} THEN '#' ELSE {t} END", {}, "$"))
    if endings:
        held = [f"(endswith(t, '{e}') AND length(t) >= {len(e) + 3})" for e in endings]
        named = ", ".join(f"CASE WHEN {h} THEN '-{e}' END" for e, h in zip(endings, held, strict=True))
        found.append(f"array_compact(flatten(transform(filter({low}, t -> {' OR '.join(held)}), t -> array({named}))))")
    cut = lines.withColumn(raw, F.regexp_extract_all(F.coalesce(F.col(column), F.lit("")), F.lit(TOKEN), F.lit(0)))
    cut = cut.withColumn(low, F.expr(f"transform({raw}, t -> replace(lower(t), '’', '\\''))"))
    return cut.withColumn(out, F.expr(f"array_distinct(concat({', '.join(found)}))") if found else F.array().cast("array<string>")).drop(raw, low)


def signals(found: str, rows: list[tuple[str, str]]) -> Column:
    """Names of the signals of which the terms in a column hold one, in the table's order."""
    named: dict[str, list[str]] = {}
    for name, term in rows:
        named.setdefault(name, []).append(term)
    cases = ", ".join(f"CASE WHEN exists(`{found}`, h -> h IN ({_listed(set(terms))})) THEN '{name}' END" for name, terms in named.items())
    return F.expr(f"array_compact(array({cases}))")


def split_lines(text: Column) -> Column:
    """Lines with white space collapsed; those under twelve characters are headings and fragments."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.filter(lines, lambda x: F.length(x) >= SHORTEST)


def classify(lines: DataFrame, column: str = "line") -> DataFrame:
    """Adds anchors, blockers and class."""
    (found,) = free(lines, "__hits")
    out = hits(lines, column, ANCHORS + BLOCKERS, found)
    out = out.withColumns({"anchors": signals(found, ANCHORS), "blockers": signals(found, BLOCKERS)}).drop(found)
    return out.withColumn("class", F.when(F.size("anchors") == 0, "unmodeled").when(F.size("blockers") == 0, "expressible").otherwise("partially"))


def counted(lines: DataFrame, *columns: str) -> DataFrame:
    """The distinct values of the columns and how many rows have each (``times``): what is only counted is classified once, however often it is repeated."""
    return lines.groupBy(*columns).agg(F.count(F.lit(1)).alias("times"))


def _rows(times: str | None) -> Column:
    return F.count(F.lit(1)) if times is None else F.sum(times)


def tally(classified: DataFrame, by: str, times: str | None = None) -> DataFrame:
    """(by, class, n, pct): counts by kind and over all (NULL), with one decimal of a per cent; ``times``: a column of how many lines a row stands for."""
    sums = classified.groupingSets([[F.col(by), F.col("class")], [F.col("class")]], by, "class").agg(_rows(times).alias("n"))
    total = F.sum("n").over(Window.partitionBy(by))
    return sums.select(by, "class", "n", F.round(F.col("n") * 100.0 / total, 1).alias("pct"))


def top_signals(classified: DataFrame, column: str, k: int = 5, times: str | None = None) -> DataFrame:
    """(signal, n) of the k most frequent signals, names among equals."""
    # explode_outer: a plain explode makes the optimiser push a test of the whole matching below itself, where it is done again
    named = classified.select(F.explode_outer(column).alias("signal"), *([times] if times else [])).where("signal is not null")
    return named.groupBy("signal").agg(_rows(times).alias("n")).orderBy(F.desc("n"), "signal").limit(k)


def examples(classified: DataFrame, trial: str, order: str, k: int = 10) -> DataFrame:
    """The first line of each trial, and of those the first k."""
    (n,) = free(classified, "__n")
    w = Window.partitionBy(trial).orderBy(order)
    return classified.withColumn(n, F.row_number().over(w)).where(F.col(n) == 1).drop(n).orderBy(trial).limit(k)


def distinct_trials(lines: DataFrame, trial: str) -> DataFrame:
    """(trials): how many trials there are."""
    return lines.agg(F.countDistinct(trial).alias("trials"))
