"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a host and a path prefix, as in ``example.org/es/``; it fits the host and its subdomains
where the path starts with the rule's, and the longest rule wins.  Besides there are patterns
(regular expressions with the literal tokens that any match must hold) for urls that no rule fits.
Every rule is filed under the one of its whole literal tokens that is rarest among the urls; a url's
tokens fetch the rules filed under them, and only those run their regular expressions.  A rule
without a whole token is tried on every url.

The index goes to the executors with the task as long as it has at most ``PART`` rules; more rules
are tried in parts, one after the other, and the longest fit of all parts wins, so that memory stays
bounded however many rules there are.

Defined results: a null url, or one without ``://``, has empty host and path, which no rule fits;
repeated rows stay; null ids stay null; an empty table gives no rows; a very long url is judged whole
(each token fetches its rules once); among equally long rules a block wins, then the lesser name;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules of the query: (rule, verdict).
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Words of a host name by which the method blocks a url that no rule fits.
JUNK_WORDS = ("spam", "pills", "casino", "viagra", "porn", "xxx", "adult", "ads", "bets", "poker", "lottery", "warez")
#: Rules that one index holds.
PART = 100_000
_TOKEN = re.compile("[A-Za-z0-9]+")


@dataclass(frozen=True)
class Rule:
    name: str | None
    verdict: str
    regex: str
    tokens: tuple[str, ...]  # whole tokens of any url that fits
    weight: int  # the heaviest fit wins


def host_path_rule(text: str, verdict: str) -> Rule:
    host, slash, path = text.partition("/")
    host = host.lower()
    tokens = [*_TOKEN.findall(host), *(m[0] for m in _TOKEN.finditer(slash + path) if m.end() < len(slash + path))]
    return Rule(text, verdict, rf"(?:[^/?#]*\.)?{re.escape(host)}{re.escape(slash + path)}", tuple(tokens), len(text))


def junk_word_rule(word: str) -> Rule:
    """Blocks a host with the word as a token of its own; lighter than any listed rule."""
    return Rule(None, "block", rf"(?:[^/?#]*[^a-z0-9/?#])?{word}(?:[^a-z0-9].*)?$", (word,), -1)


def split_url(url: str | None) -> tuple[str, str]:
    """(host with A-Z lower-cased, path); both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    rest = re.split("[?#]", rest, maxsplit=1)[0]
    at = rest.find("/")
    host, path = (rest, "") if at < 0 else (rest[:at], rest[at:])
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), path


class RuleIndex:
    def __init__(self, rules: list[Rule], frequency: dict[str, int]):
        """frequency: how many urls hold a token; unknown tokens are the rarest."""
        self.by_token: dict[str, list[tuple[Rule, re.Pattern]]] = {}
        self.always: list[tuple[Rule, re.Pattern]] = []
        for r in rules:
            entry = (r, re.compile(r.regex, re.DOTALL))
            if r.tokens:
                self.by_token.setdefault(min(r.tokens, key=lambda t: (frequency.get(t, 0), -len(t), t)), []).append(entry)
            else:
                self.always.append(entry)

    def best(self, host: str, path: str) -> Rule | None:
        """The heaviest rule that fits; among equals a block wins, then the lesser name."""
        line, found = host + path, None
        for token in {*_TOKEN.findall(line)}:
            for rule, pattern in self.by_token.get(token, ()):
                if pattern.match(line) and (found is None or _order(rule) < _order(found)):
                    found = rule
        for rule, pattern in self.always:
            if pattern.match(line) and (found is None or _order(rule) < _order(found)):
                found = rule
        return found


def _order(r: Rule) -> tuple:
    return (-r.weight, r.verdict != "block", r.name or "")


def token_frequency(urls: DataFrame, rules: list[Rule], url_col: str) -> dict[str, int]:
    """How many urls hold each token of the rules; one number for each token, at most ``PART`` rules' tokens."""
    spark = urls.sparkSession
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    listed = spark.createDataFrame(pa.table({"t": wanted}))
    line = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    tokens = urls.select(F.explode(F.array_distinct(F.regexp_extract_all(line, F.lit("[A-Za-z0-9]+"), F.lit(0)))).alias("t"))
    hits = tokens.join(F.broadcast(listed), "t").groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    return {r.t: r.n for r in hits.collect()}


def filter_urls(urls: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of every url."""
    names = [id_col, "host", "path", "rule", "verdict", "weight"]
    out = urls.select(F.col(id_col).cast("long").alias(id_col), F.col(url_col).cast("string").alias("url"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"), F.lit(None).cast("int").alias("weight"))
    parts = [rules[a : a + PART] for a in range(0, len(rules), PART)] or [[]]
    for k, part in enumerate(parts):
        frequency = token_frequency(urls, part, url_col)
        last = k == len(parts) - 1

        def run(batches: Iterator[pa.RecordBatch], part=part, frequency=frequency, last=last) -> Iterator[pa.RecordBatch]:
            index = RuleIndex(part, frequency)
            for b in batches:
                cols: list[list] = [[], [], [], [], []]
                for url, name, verdict, weight in zip(*(b.column(i).to_pylist() for i in range(1, 5)), strict=True):
                    host, path = split_url(url)
                    got = index.best(host, path)
                    if got and (weight is None or _order(got) < (-weight, verdict != "block", name or "")):
                        name, verdict, weight = got.name, got.verdict, got.weight
                    for c, x in zip(cols, (host, path, name, verdict, weight), strict=True):
                        c.append(x)
                kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32())
                arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
                if last:
                    yield pa.RecordBatch.from_arrays([b.column(0), *arrays[:4]], names=names[:5])
                else:
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *arrays[2:]], names=[id_col, "url", *names[3:]])

        schema = f"`{id_col}` long, host string, path string, rule string, verdict string" if last else f"`{id_col}` long, url string, rule string, verdict string, weight int"
        out = out.mapInArrow(run, schema)
    return out


def production_rules() -> list[Rule]:
    return [*(host_path_rule(*r) for r in RULES), *map(junk_word_rule, JUNK_WORDS)]


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), production_rules())


OP2_SQL = rf"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM parts)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN regexp_matches(host, '(^|[^a-z0-9])({"|".join(JUNK_WORDS)})([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
