"""Rule sets, conditions and fact models as immutable Python values.

They are small metadata: parsed and checked on the driver, compiled to columns, never distributed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

#: Operators by family.
NUMERIC_OPS = ("eq", "neq", "gt", "gte", "lt", "lte")
EQUALITY_OPS = ("eq", "neq")
SET_OPS = ("in", "notIn")


@dataclass(frozen=True)
class Codes:
    system: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class Leaf:
    fact: str
    op: str
    value: Any = None
    unit: str | None = None
    codes: Codes | None = None
    window_days: int | None = None

    @property
    def family(self) -> str:
        if self.op in ("in", "notIn"):
            return "set"
        if self.op == "exists":
            return "exists"
        if self.op == "anyWithin":
            return "within"
        if isinstance(self.value, bool):
            return "boolean"
        return "text" if isinstance(self.value, str) else "numeric"


@dataclass(frozen=True)
class All:
    children: tuple


@dataclass(frozen=True)
class AnyOf:
    children: tuple


@dataclass(frozen=True)
class Not:
    child: Any


Condition = Leaf | All | AnyOf | Not


@dataclass(frozen=True)
class Criterion:
    id: str
    kind: str  # inclusion or exclusion
    verbatim: str
    when: Condition | None = None
    ref: str | None = None

    @property
    def unmodeled(self) -> bool:
        return self.when is None


@dataclass(frozen=True)
class RuleSet:
    ruleset: str
    version: str
    fact_model: str
    criteria: tuple[Criterion, ...]
    meta: tuple[tuple[str, Any], ...] = ()


@dataclass(frozen=True)
class FactDecl:
    type: str  # number, enum, boolean, code
    unit: str | None = None
    values: tuple[str, ...] = ()
    systems: tuple[str, ...] = ()


@dataclass(frozen=True)
class FactModel:
    name: str
    facts: dict[str, FactDecl] = field(hash=False)


def leaves(c: Condition | None) -> Iterator[Leaf]:
    """Leaves in document order."""
    if isinstance(c, Leaf):
        yield c
    elif isinstance(c, Not):
        yield from leaves(c.child)
    elif c is not None:
        for x in c.children:
            yield from leaves(x)


def facts_read(rs: RuleSet) -> list[str]:
    return list(dict.fromkeys(x.fact for c in rs.criteria for x in leaves(c.when)))


def to_plain(c: Condition | None, mask: bool = False) -> Any:
    """The condition as plain data; with ``mask`` its literals are left out, so that only the shape remains."""
    if c is None:
        return None
    if isinstance(c, All):
        return {"all": [to_plain(x, mask) for x in c.children]}
    if isinstance(c, AnyOf):
        return {"any": [to_plain(x, mask) for x in c.children]}
    if isinstance(c, Not):
        return {"not": to_plain(c.child, mask)}
    out: dict[str, Any] = {"fact": c.fact, "op": c.op}
    if c.value is not None:
        out["value"] = "*" if mask else c.value
    if c.unit is not None:
        out["unit"] = c.unit
    if c.codes is not None:
        out["codes"] = {"system": c.codes.system, "values": "*" if mask else list(c.codes.values)}
    if c.window_days is not None:
        out["windowDays"] = "*" if mask else c.window_days
    return out


def canonical(x: Any) -> str:
    return json.dumps(x, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def replace_at(c: Condition, path: tuple, literal: Any) -> Condition:
    """The condition with one literal replaced; ``path`` as :func:`literals` gives it."""
    if not path or isinstance(c, Leaf):
        key = path[0] if path else "value"
        d = {**c.__dict__, "window_days" if key == "windowDays" else "value": literal}
        return Leaf(**d)
    head, *rest = path
    if isinstance(c, Not):
        return Not(replace_at(c.child, tuple(rest), literal))
    kids = list(c.children)
    kids[head] = replace_at(kids[head], tuple(rest), literal)
    return type(c)(tuple(kids))


def literals(c: Condition | None, at: tuple = ()) -> Iterator[tuple[tuple, Leaf, str, float]]:
    """(path, leaf, ``value`` or ``windowDays``, number) of every tunable number, in document order."""
    if isinstance(c, Leaf):
        if c.window_days is not None:
            yield (*at, "windowDays"), c, "windowDays", c.window_days
        elif c.family == "numeric" and c.value is not None:
            yield (*at, "value"), c, "value", c.value
    elif isinstance(c, Not):
        yield from literals(c.child, (*at, 0))
    elif c is not None:
        for i, x in enumerate(c.children):
            yield from literals(x, (*at, i))
