"""Comparison of two versions of a rule set: structure (driver), behaviour and impact (one projection over the cohort)."""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.model import Criterion, FactModel, RuleSet, canonical, to_plain
from cohortlens.operators.evaluate import display_band, overall_of, with_results


@dataclass(frozen=True)
class Structural:
    added: tuple[str, ...]
    removed: tuple[str, ...]
    changed: tuple[str, ...]
    renamed: tuple[tuple[str, str], ...]  # (from, to)
    reordered: tuple[str, ...]
    metadata: tuple[str, ...]

    @property
    def tracked(self) -> bool:
        return any((self.added, self.removed, self.changed, self.renamed, self.reordered))

    def rows(self) -> list[tuple[str, str, str | None]]:
        """(change, id, from_id) of every change."""
        out = [(k, i, None) for k in ("added", "removed", "changed", "reordered") for i in getattr(self, k)]
        return out + [("renamed", b, a) for a, b in self.renamed] + [("metadata", m, None) for m in self.metadata]


def comparable(a: RuleSet, b: RuleSet) -> None:
    if (a.ruleset, a.fact_model) != (b.ruleset, b.fact_model):
        raise ValueError("versions of one rule set over one fact model are compared")


def _identity(c: Criterion) -> str:
    return canonical([c.kind, c.verbatim, to_plain(c.when), c.unmodeled])


def signature(c: Criterion) -> str:
    return canonical([c.ref, _identity(c)])


def shape(c: Criterion) -> str:
    return canonical([c.kind, to_plain(c.when, mask=True), c.unmodeled])


def _unique(items, key) -> dict:
    by = defaultdict(list)
    for x in items:
        by[key(x)].append(x)
    return {k: v[0] for k, v in by.items() if len(v) == 1}


def structural_diff(a: RuleSet, b: RuleSet) -> Structural:
    """Added, removed, changed, renamed and reordered criteria, and changed metadata, in linear time.

    A rename is a criterion that is equal but for its id, or (a second pass) one of the same shape
    under a reference that both sides use once.
    """
    comparable(a, b)
    of_a, of_b = {c.id: c for c in a.criteria}, {c.id: c for c in b.criteria}
    gone, new = [c for c in a.criteria if c.id not in of_b], [c for c in b.criteria if c.id not in of_a]
    pairs: dict[str, str] = {}
    left, right = _unique(gone, _identity), _unique(new, _identity)
    pairs.update({left[k].id: right[k].id for k in left if k in right})
    by_ref = lambda c: canonical([c.ref, shape(c)])
    refs_a, refs_b = Counter(c.ref for c in a.criteria), Counter(c.ref for c in b.criteria)
    taken = set(pairs.values())
    rest_a = [c for c in gone if c.id not in pairs and c.ref and refs_a[c.ref] == 1]
    rest_b = [c for c in new if c.id not in taken and c.ref and refs_b[c.ref] == 1]
    left, right = _unique(rest_a, by_ref), _unique(rest_b, by_ref)
    by_pair = {left[k].id: right[k].id for k in left if k in right}
    pairs.update(by_pair)
    back = {v: k for k, v in pairs.items()}
    common = [c.id for c in a.criteria if c.id in of_b]
    order_b = [c.id for c in b.criteria if c.id in of_a]
    changed = [i for i in common if signature(of_a[i]) != signature(of_b[i])] + [v for k, v in by_pair.items() if _identity(of_a[k]) != _identity(of_b[v])]
    ma, mb = dict(a.meta), dict(b.meta)
    return Structural(
        tuple(c.id for c in new if c.id not in back),
        tuple(c.id for c in gone if c.id not in pairs),
        tuple(changed),
        tuple(pairs.items()),
        tuple(x for x, y in zip(common, order_b, strict=True) if x != y),
        tuple(k for k in sorted({*ma, *mb}) if ma.get(k) != mb.get(k)),
    )


def version_findings(a: RuleSet, b: RuleSet, s: Structural, flips: int | None = None) -> list[tuple[str, str]]:
    """(level, code) of the step from one version to the next."""
    va, vb = (tuple(int(x) for x in r.version.split(".")) for r in (a, b))
    out = []
    if vb < va:
        out.append(("error", "invalid-version-bump"))
    elif vb == va:
        if s.tracked:
            out.append(("error", "invalid-version-bump"))
    else:
        breaking = bool(s.added or s.removed)
        if breaking and vb[0] == va[0]:
            out.append(("error", "invalid-version-bump"))
        elif (s.changed or flips) and vb[:2] == va[:2]:
            out.append(("error", "invalid-version-bump"))
        if not s.tracked and not s.metadata and not flips:
            out.append(("warning", "empty-version-bump"))
    return out


def scalar_changes(a: Criterion, b: Criterion) -> str:
    """What changed in a condition, scalar by scalar, or that it was rewritten."""

    def flat(x, path=""):
        if isinstance(x, dict):
            return {k2: v2 for k, v in x.items() for k2, v2 in flat(v, f"{path}.{k}").items()}
        if isinstance(x, list):
            return {k2: v2 for i, v in enumerate(x) for k2, v2 in flat(v, f"{path}.{i}").items()}
        return {path: x}

    fa, fb = flat(to_plain(a.when)), flat(to_plain(b.when))
    if set(fa) != set(fb):
        return "condition rewritten"
    return "; ".join(f"{p.rsplit('.', 1)[-1]} {fa[p]} → {fb[p]}" for p in fa if fa[p] != fb[p])


def both_versions(df: DataFrame, a: RuleSet, b: RuleSet, model: FactModel) -> DataFrame:
    """(patient, ra, rb, oa, ob): results and overall under both versions, from one scan and one projection; no join."""
    comparable(a, b)
    out = with_results(with_results(df, a, model, "ra"), b, model, "rb").select("patient", "ra", "rb")
    return out.withColumns({"oa": overall_of(F.col("ra")), "ob": overall_of(F.col("rb"))})


def _verdict_of(results: Column, ord_: int | None) -> Column:
    return F.lit("pass") if ord_ is None else F.element_at(results, ord_ + 1)["verdict"]


def behavioral_flips(both: DataFrame, a: RuleSet, b: RuleSet) -> DataFrame:
    """(patient, from_overall, to_overall, responsible, primary) of patients whose overall verdict moved.

    Criteria are aligned by id and rename, one that a side lacks reads as pass.  Those whose failing
    changed come first, then the others, each in rule order; ``primary`` is the earliest in rule order.
    """
    s = structural_diff(a, b)
    to_a = {y: x for x, y in s.renamed}
    oa, ob = {c.id: i for i, c in enumerate(a.criteria)}, {c.id: i for i, c in enumerate(b.criteria)}
    aligned = [(c.id, oa.get(to_a.get(c.id, c.id)), i) for i, c in enumerate(b.criteria)] + [(i, oa[i], None) for i in s.removed]
    items = []
    for k, (cid, ia, ib) in enumerate(aligned):
        va, vb = _verdict_of(F.col("ra"), ia), _verdict_of(F.col("rb"), ib)
        hard = (va == "fail") != (vb == "fail")
        items.append(F.when(va != vb, F.struct((~hard).alias("soft"), F.lit(k).alias("k"), F.lit(cid).alias("id"))))
    found = F.array_sort(F.array_compact(F.array(*items))) if items else F.array()
    moved = both.where("oa <> ob").withColumn("f", found)
    first = F.array_min(F.transform("f", lambda x: F.struct(x["k"].alias("k"), x["id"].alias("id"))))["id"]
    return moved.select("patient", F.col("oa").alias("from_overall"), F.col("ob").alias("to_overall"), F.transform("f", lambda x: x["id"]).alias("responsible"), F.coalesce(first, F.lit("")).alias("primary"))


def flip_groups(flips: DataFrame) -> DataFrame:
    """(primary, n)."""
    return flips.groupBy("primary").agg(F.count(F.lit(1)).alias("n"))


def amendment_impact(both: DataFrame, a: RuleSet, b: RuleSet) -> DataFrame:
    """(patient, from_band, to_band, responsible) of patients whose display band moved.

    A criterion is named if its verdict or its being modeled changed; a new one if it doesn't pass;
    removed ones are not named.
    """
    s = structural_diff(a, b)
    to_a = {y: x for x, y in s.renamed}
    oa = {c.id: i for i, c in enumerate(a.criteria)}
    items = []
    for ib, c in enumerate(b.criteria):
        ia, rb = oa.get(to_a.get(c.id, c.id)), F.element_at("rb", ib + 1)
        if ia is None:
            differs = rb["verdict"] != "pass"
        else:
            ra = F.element_at("ra", ia + 1)
            differs = (ra["verdict"] != rb["verdict"]) | (ra["unmodeled"] != rb["unmodeled"])
        items.append(F.when(differs, F.lit(c.id)))
    bands = both.withColumns({"from_band": display_band(F.col("oa"), F.col("ra")), "to_band": display_band(F.col("ob"), F.col("rb"))})
    return bands.where("from_band <> to_band").select("patient", "from_band", "to_band", F.array_compact(F.array(*items)).alias("responsible"))


def enrolled_impact(both: DataFrame, enrolled: DataFrame) -> DataFrame:
    """(patient, reasons): enrolled patients who were not ineligible and now are, with the criteria that newly fail."""
    fails = lambda c: F.transform(F.filter(c, lambda r: r["verdict"] == "fail"), lambda r: r["id"])
    hit = both.join(enrolled.select("patient").distinct(), "patient", "left_semi").where("oa <> 'ineligible' and ob = 'ineligible'")
    return hit.select("patient", F.array_except(fails(F.col("rb")), fails(F.col("ra"))).alias("reasons"))
