"""Conditions compiled to native Boolean columns: SQL's three-valued logic is strong Kleene logic, NULL is unknown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlens.functions.facts import finite
from cohortlens.model import All, AnyOf, Condition, FactModel, Leaf, Not

_FAMILY_TYPE = {"numeric": "number", "text": "enum", "boolean": "boolean", "set": "code", "within": "code"}
#: How operators read in a trace.
_OP_TEXT = {"eq": "=", "neq": "≠", "gt": ">", "gte": "≥", "lt": "<", "lte": "≤"}


def unknown() -> Column:
    return F.lit(None).cast("boolean")


class Facts:
    """Columns of a typed wide cohort, by fact; a fact without a column is unknown everywhere."""

    def __init__(self, columns: list[str], model: FactModel):
        self.columns, self.model = set(columns), model

    def get(self, leaf: Leaf) -> Column | None:
        decl = self.model.facts.get(leaf.fact)
        if leaf.fact not in self.columns or decl is None:
            return None
        want = _FAMILY_TYPE.get(leaf.family)
        if want and decl.type != want:
            return None
        return F.col(leaf.fact)


def leaf_column(leaf: Leaf, facts: Facts) -> Column:
    x = facts.get(leaf)
    if x is None:
        return unknown()
    match leaf.family:
        case "exists":
            return F.when(x.isNotNull(), F.lit(True))
        case "set" | "within":
            hit = lambda e: (e["system"] == leaf.codes.system) & e["code"].isin(*leaf.codes.values)
            if leaf.family == "within":  # an undated match within no other hit is unknown
                return F.exists(x, lambda e: hit(e) & (e["daysAgo"] <= leaf.window_days))
            found = F.exists(x, hit)
            return found if leaf.op == "in" else ~found
        case "numeric":
            x, v = finite(x), F.lit(float(leaf.value))
        case _:
            v = F.lit(leaf.value)
    return {"eq": x == v, "neq": x != v, "gt": x > v, "gte": x >= v, "lt": x < v, "lte": x <= v}[leaf.op]


def condition_column(c: Condition, facts: Facts) -> Column:
    match c:
        case All(children):
            return reduce(lambda a, b: a & b, [condition_column(x, facts) for x in children])
        case AnyOf(children):
            return reduce(lambda a, b: a | b, [condition_column(x, facts) for x in children])
        case Not(child):
            return ~condition_column(child, facts)
    return leaf_column(c, facts)


def verdict(kind: str, holds: Column) -> Column:
    """An inclusion passes where its condition holds, an exclusion where it doesn't; unknown stays unknown."""
    good = holds if kind == "inclusion" else ~holds
    return F.when(good.isNull(), "unknown").when(good, "pass").otherwise("fail")


def tri(holds: Column) -> Column:
    return F.when(holds.isNull(), "unknown").when(holds, "true").otherwise("false")


def shown(leaf: Leaf, facts: Facts) -> Column:
    """What a leaf compared, as prose."""
    x, f = facts.get(leaf), leaf.fact
    if x is None:
        return F.lit(f"{f} missing → unknown")
    if leaf.family == "exists":
        said = F.lit(f"{f} recorded")
    elif leaf.family == "set":
        said = F.concat(F.lit(f"{f}: "), F.size(x).cast("string"), F.lit(f" entries, required {'any of' if leaf.op == 'in' else 'none of'} {', '.join(leaf.codes.values)}"))
    elif leaf.family == "within":
        said = F.concat(F.lit(f"{f}: "), F.size(x).cast("string"), F.lit(f" entries, any of {', '.join(leaf.codes.values)} within {leaf.window_days} days"))
    else:
        value = str(leaf.value).lower() if isinstance(leaf.value, bool) else str(leaf.value)
        said = F.concat(F.lit(f"{f} = "), x.cast("string"), F.lit(f", required {_OP_TEXT[leaf.op]} {value}{' ' + leaf.unit if leaf.unit else ''}"))
    return F.when(x.isNull(), F.lit(f"{f} missing → unknown")).otherwise(said)


def trace_nodes(c: Condition, facts: Facts, path: str = "0") -> list[Column]:
    """(path, kind, result, detail) of every node, parents first; nothing is left out by short-circuits."""
    kind = {All: "all", AnyOf: "any", Not: "not"}.get(type(c), "leaf")
    detail = shown(c, facts) if isinstance(c, Leaf) else F.lit(None).cast("string")
    node = F.struct(F.lit(path).alias("path"), F.lit(kind).alias("kind"), tri(condition_column(c, facts)).alias("result"), detail.alias("detail"))
    kids = [c.child] if isinstance(c, Not) else [] if isinstance(c, Leaf) else list(c.children)
    return [node, *(n for i, k in enumerate(kids) for n in trace_nodes(k, facts, f"{path}.{i}"))]


def prose(c: Condition, facts: Facts) -> Column:
    """A condition's outcome in words."""
    match c:
        case All(children):
            return F.concat_ws(" and ", *[prose(x, facts) for x in children])
        case AnyOf(children):
            return F.concat_ws(" or ", *[prose(x, facts) for x in children])
        case Not(child):
            return F.concat(F.lit("not ("), prose(child, facts), F.lit(")"))
    return shown(c, facts)
