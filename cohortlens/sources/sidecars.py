"""Small documents beside the rules: what is modeled in part, prompts, review states, enrolled participants, text edits of rules."""

from __future__ import annotations

import hashlib
import json
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.model import RuleSet, literals
from cohortlens.sources.documents import DocumentError


def modeling_declaration(text: str, rs: RuleSet) -> tuple[str, ...]:
    """Criteria that are modeled in part; the document must name this rule set and version, and modeled criteria of it, once each."""
    try:
        x = json.loads(text)
    except ValueError as e:
        raise DocumentError([f"not readable: {e}"]) from e
    ids, known = x.get("partial", []), {c.id: c for c in rs.criteria}
    bad = []
    if (x.get("ruleset"), x.get("rulesetVersion")) != (rs.ruleset, rs.version):
        bad.append("ruleset: another rule set or version")
    bad += [f"partial: {i} is no criterion" for i in ids if i not in known]
    bad += [f"partial: {i} is not modeled at all" for i in ids if i in known and known[i].unmodeled]
    if len(set(ids)) < len(ids):
        bad.append("partial: repeated id")
    if bad:
        raise DocumentError(bad)
    return tuple(ids)


def render_prompt(template: str, fact_model: str) -> str:
    """The template without its leading comment, with the fact model in its place."""
    return re.sub(r"\A\s*<!--.*?-->\s*", "", template, flags=re.DOTALL).replace("{{factModel}}", fact_model)


def controls(request: Any, prompt: str, schema: Any) -> dict[str, str]:
    """Hashes to which a recording is bound."""
    sha = lambda x: hashlib.sha256((x if isinstance(x, str) else json.dumps(x, sort_keys=True, separators=(",", ":"))).encode()).hexdigest()
    return {"requestHash": sha(request), "promptHash": sha(prompt), "schemaHash": sha(schema)}


def review_state(spark: SparkSession, text: str | None) -> DataFrame:
    """(card, decision, value, at, correction_reason, correction_source) of a saved state; rows that aren't decisions are dropped.

    The older form has the decision alone for each card.
    """
    try:
        raw = json.loads(text or "{}")
    except ValueError:
        raw = {}
    raw = raw.get("decisions", raw) if isinstance(raw, dict) else {}
    rows = []
    for card, d in raw.items():
        d = {"decision": d} if isinstance(d, str) else d
        if isinstance(d, dict) and d.get("decision") in ("confirmed", "rejected"):
            c = d.get("correction") or {}
            rows.append((card, d["decision"], None if d.get("value") is None else str(d["value"]), d.get("at"), c.get("reason"), c.get("source")))
    return spark.createDataFrame(rows, "card string, decision string, value string, at string, correction_reason string, correction_source string")


def save_review_state(decisions: DataFrame, path: str) -> None:
    decisions.write.mode("overwrite").json(path)


def enrolled(spark: SparkSession, path: str) -> DataFrame:
    """(participant, site, randomized, patient, facts VARIANT) of enrolled participants."""
    schema = "participant string, site string, randomized string, patient string, facts variant"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def demographics(sex: str = "sex", age: str = "age"):
    """\"sex · age\" of what is recorded."""
    return F.concat_ws(" · ", F.col(sex), F.col(age).cast("int").cast("string"))


def set_literal(text: str, criterion: str, old: float, new: float) -> str:
    """The rule document with one number of one criterion replaced, every other byte as it was."""
    at = re.search(rf"\bid:\s*[\"']?{re.escape(criterion)}\b", text)
    if not at:
        raise DocumentError([f"{criterion}: no such criterion"])
    end = re.search(r"\n\s*-\s*\{?\s*id:", text[at.end() :])
    stop = at.end() + end.start() if end else len(text)
    shown = f"{old:g}"
    hits = [m for m in re.finditer(rf"(?:value|windowDays):\s*({re.escape(shown)})(?![\d.])", text[at.end() : stop])]
    if len(hits) != 1:
        raise DocumentError([f"{criterion}: {shown} stands in {len(hits)} places"])
    a, b = at.end() + hits[0].start(1), at.end() + hits[0].end(1)
    return text[:a] + f"{new:g}" + text[b:]


def criterion_lines(text: str) -> dict[str, tuple[int, int]]:
    """First and last line (from 1) of each criterion in a rule document."""
    lines = text.split("\n")
    begins = [(i, m[1]) for i, x in enumerate(lines) if (m := re.match(r"\s*-\s*\{?\s*id:\s*[\"']?([a-z0-9-]+)", x))]
    out = {}
    for k, (i, cid) in enumerate(begins):
        last = begins[k + 1][0] if k + 1 < len(begins) else len(lines)
        while last > i + 1 and not lines[last - 1].strip():
            last -= 1
        out[cid] = (i + 1, last)
    return out


def tunable(rs: RuleSet) -> list[tuple[str, float]]:
    return [(c.id, v) for c in rs.criteria for _, _, _, v in literals(c.when)]
