"""Contradiction proofs over the numbers and code sets of a rule set, on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass

from cohortlens.model import All, AnyOf, Condition, Criterion, Leaf, Not, RuleSet, leaves


@dataclass(frozen=True)
class Finding:
    level: str  # error, warning, info
    code: str
    message: str
    criteria: tuple[str, ...] = ()


LEVELS = {"error": 0, "warning": 1, "info": 2}


def by_severity(findings: list[Finding]) -> list[Finding]:
    return sorted(findings, key=lambda f: LEVELS[f.level])


@dataclass(frozen=True)
class Interval:
    low: float = -math.inf
    high: float = math.inf
    low_open: bool = True
    high_open: bool = True

    @staticmethod
    def of(op: str, v: float) -> Interval | None:
        made = {"eq": (v, v, False, False), "gt": (v, math.inf, True, True), "gte": (v, math.inf, False, True), "lt": (-math.inf, v, True, True), "lte": (-math.inf, v, True, False)}.get(op)
        return Interval(*made) if made else None

    def __and__(self, o: Interval) -> Interval:
        low, low_open = max((self.low, self.low_open), (o.low, o.low_open))
        high, high_closed = min((self.high, not self.high_open), (o.high, not o.high_open))
        return Interval(low, high, low_open, not high_closed)

    @property
    def empty(self) -> bool:
        return self.low > self.high or (self.low == self.high and (self.low_open or self.high_open))

    @property
    def full(self) -> bool:
        return self.low == -math.inf and self.high == math.inf

    @property
    def point(self) -> float | None:
        return self.low if self.low == self.high and not self.empty and math.isfinite(self.low) else None

    def contains(self, o: Interval) -> bool:
        return o.empty or (self & o) == o

    def __str__(self) -> str:
        n = lambda x: "∞" if x == math.inf else "-∞" if x == -math.inf else f"{x:g}"
        return f"{'(' if self.low_open else '['}{n(self.low)}, {n(self.high)}{')' if self.high_open else ']'}"


@dataclass
class Analysis:
    """What a criterion's condition needs of each fact, as far as a chain of ``all`` shows it."""

    intervals: dict[str, Interval]
    holes: dict[str, set[float]]
    code_in: dict[tuple[str, str], list[frozenset]]
    code_not: dict[tuple[str, str], list[frozenset]]
    complete: bool
    only_in: tuple[tuple[str, str], frozenset] | None


def _needed(c: Condition) -> tuple[list[Leaf], bool]:
    if isinstance(c, Leaf):
        return [c], True
    if isinstance(c, All):
        parts = [_needed(x) for x in c.children]
        return [x for p, _ in parts for x in p], all(ok for _, ok in parts)
    return [], False


def analyse(c: Condition) -> Analysis:
    found, complete = _needed(c)
    a = Analysis({}, {}, {}, {}, complete, None)
    for leaf in found:
        if leaf.family == "numeric":
            if leaf.op == "neq":
                a.holes.setdefault(leaf.fact, set()).add(leaf.value)
            else:
                a.intervals[leaf.fact] = a.intervals.get(leaf.fact, Interval()) & Interval.of(leaf.op, leaf.value)
        elif leaf.family == "set":
            to = a.code_in if leaf.op == "in" else a.code_not
            to.setdefault((leaf.fact, leaf.codes.system), []).append(frozenset(leaf.codes.values))
        else:
            a.complete = False
    if isinstance(c, Leaf) and c.op == "in":
        a.only_in = ((c.fact, c.codes.system), frozenset(c.codes.values))
    return a


def conflicts(rs: RuleSet) -> list[Finding]:
    """Criteria, pairs of inclusions, and whole rule sets that no patient can satisfy."""
    out: list[Finding] = []
    seen: list[tuple[Criterion, Analysis]] = []
    for c in rs.criteria:
        if c.unmodeled:
            continue
        a = analyse(c.when)
        seen.append((c, a))
        if not a.complete:
            out.append(Finding("info", "analysis-incomplete", f"{c.id}: parts of its condition are not analysed", (c.id,)))
        for fact, iv in a.intervals.items():
            if iv.empty:
                out.append(Finding("error", "unsatisfiable-criterion", f"{c.id}: no {fact} satisfies it", (c.id,)))
            elif iv.point is not None and iv.point in a.holes.get(fact, ()):
                out.append(Finding("error", "unsatisfiable-criterion", f"{c.id}: {fact} must and must not be {iv.point:g}", (c.id,)))
        for key, needs in a.code_in.items():
            if any(s <= t for s in needs for t in a.code_not.get(key, ())):
                out.append(Finding("error", "unsatisfiable-criterion", f"{c.id}: every required {key[0]} code is also forbidden", (c.id,)))
    inc = [(c, a) for c, a in seen if c.kind == "inclusion"]
    exc = [(c, a) for c, a in seen if c.kind == "exclusion"]
    for i, (c, a) in enumerate(inc):
        for d, b in inc[i + 1 :]:
            for x, y in ((a, b), (b, a)):
                for key, needs in x.code_in.items():
                    if any(s <= t for s in needs for t in y.code_not.get(key, ())):
                        out.append(Finding("error", "contradictory-inclusions", f"{c.id} and {d.id}: {key[0]} codes required and forbidden", (c.id, d.id)))
    for c, a in inc:
        for d, b in exc:
            if a.only_in and b.only_in and a.only_in[0] == b.only_in[0] and a.only_in[1] <= b.only_in[1]:
                out.append(Finding("error", "unsatisfiable-ruleset", f"{c.id} requires what {d.id} excludes", (c.id, d.id)))
    admitted: dict[str, Interval] = {}
    sources: dict[str, list[tuple[Criterion, Interval]]] = {}
    for c, a in inc:
        for fact, iv in a.intervals.items():
            if not iv.empty:
                admitted[fact] = admitted.get(fact, Interval()) & iv
                sources.setdefault(fact, []).append((c, iv))
    contradicted = False
    for fact, iv in admitted.items():
        src = sources[fact]
        if iv.empty and len(src) > 1:
            pair = [(c, d) for i, (c, x) in enumerate(src) for d, y in src[i + 1 :] if (x & y).empty]
            named = pair[-1] if pair else [c for c, _ in src]
            out.append(Finding("error", "contradictory-inclusions", f"no {fact} satisfies {' and '.join(c.id for c in named)}", tuple(c.id for c in named)))
            contradicted = True
        elif iv.point is not None:
            for c, a in inc:
                if iv.point in a.holes.get(fact, ()) and not any(c is d for d, _ in src):
                    named = (*(d.id for d, _ in src), c.id)
                    out.append(Finding("error", "contradictory-inclusions", f"{fact} must and must not be {iv.point:g}", named))
                    contradicted = True
    for d, b in exc:
        if contradicted or not b.complete or not b.intervals or b.holes or b.code_in or b.code_not:
            continue
        if all(f in admitted and not admitted[f].empty and iv.contains(admitted[f]) for f, iv in b.intervals.items()):
            names = tuple(dict.fromkeys([*(c.id for f in b.intervals for c, _ in sources[f]), d.id]))
            out.append(Finding("error", "unsatisfiable-ruleset", f"{d.id} excludes all that the inclusions admit", names))
    return out


def possible_results(c: Condition) -> set[bool | None]:
    """Truth values that a condition can take: presence can't be false."""
    match c:
        case Leaf():
            return {True, None} if c.op == "exists" else {True, False, None}
        case Not(child):
            return {None if r is None else not r for r in possible_results(child)}
    kids = [possible_results(x) for x in c.children]
    if isinstance(c, AnyOf):
        return {None if r is None else not r for r in _conjunction([{None if r is None else not r for r in k} for k in kids])}
    return _conjunction(kids)


def _conjunction(kids: list[set]) -> set:
    out: set[bool | None] = set()
    if any(False in k for k in kids):
        out.add(False)
    if all(True in k for k in kids):
        out.add(True)
    if any(None in k for k in kids) and all(k & {True, None} for k in kids):
        out.add(None)
    return out


def all_leaves(rs: RuleSet) -> list[tuple[Criterion, Leaf]]:
    return [(c, x) for c in rs.criteria for x in leaves(c.when)]
