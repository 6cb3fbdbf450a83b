"""How results move with one literal: all knobs in one job, from counters and one recompiled criterion each."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.conditions import Facts, condition_column, verdict
from cohortlens.functions.facts import finite
from cohortlens.model import FactModel, Leaf, RuleSet, literals, replace_at
from cohortlens.operators.evaluate import DISPLAY_BANDS, with_results


@dataclass(frozen=True)
class Knob:
    ord: int
    criterion: str
    path: tuple
    leaf: Leaf
    what: str  # value or windowDays
    value: float
    relaxed: float

    @property
    def name(self) -> str:
        return f"{self.criterion}:{'.'.join(map(str, self.path))}"


def relaxed(kind: str, op: str, what: str, v: float) -> float:
    """Windows are halved (1 at least); a lower bound to pass sinks by 5, everything else rises by 5."""
    if what == "windowDays":
        return max(1, math.floor(v / 2 + 0.5))
    down = op in (("gt", "gte") if kind == "inclusion" else ("lt", "lte"))
    return v - 5 if down else v + 5


def knobs(rs: RuleSet) -> list[Knob]:
    return [Knob(i, c.id, path, leaf, what, v, relaxed(c.kind, leaf.op, what, v)) for i, c in enumerate(rs.criteria) for path, leaf, what, v in literals(c.when)]


def baseline(df: DataFrame, rs: RuleSet, model: FactModel) -> DataFrame:
    """The cohort with ``results`` and counters of fails, open modeled criteria, and parked ones."""
    n = lambda f: F.size(F.filter("results", f))
    return with_results(df, rs, model).withColumns(
        {"n_fail": n(lambda r: r["verdict"] == "fail"), "n_open": n(lambda r: (r["verdict"] == "unknown") & ~r["unmodeled"]), "n_parked": n(lambda r: (r["verdict"] == "unknown") & r["unmodeled"])}
    )


def moved_band(base: DataFrame, rs: RuleSet, model: FactModel, knob: Knob, value: float) -> Column:
    """The display band with one literal changed: the old verdict leaves the counters, the new one enters."""
    c = rs.criteria[knob.ord]
    facts = Facts(base.columns, model)
    new = verdict(c.kind, condition_column(replace_at(c.when, knob.path, value), facts))
    old = F.element_at("results", knob.ord + 1)["verdict"]
    one = lambda v, x: (x == v).cast("int")
    fail = F.col("n_fail") - one("fail", old) + one("fail", new)
    open_ = F.col("n_open") - one("unknown", old) + one("unknown", new)
    return F.when(fail > 0, DISPLAY_BANDS[1]).when(open_ > 0, DISPLAY_BANDS[2]).when(F.col("n_parked") > 0, DISPLAY_BANDS[3]).otherwise(DISPLAY_BANDS[0])


def yields(df: DataFrame, rs: RuleSet, model: FactModel) -> DataFrame:
    """(knob_ord, knob, value, relaxed, delta): how many fewer patients fail with each knob relaxed; one scan, one aggregate per knob."""
    base = baseline(df, rs, model)
    ks = [k for k in knobs(rs) if k.relaxed != k.value]
    if not ks:
        return df.sparkSession.createDataFrame([], "knob_ord int, knob string, value double, relaxed double, delta long")
    was = (F.col("n_fail") > 0).cast("long")
    sums = base.agg(*[F.coalesce(F.sum(was - (moved_band(base, rs, model, k, k.relaxed) == DISPLAY_BANDS[1]).cast("long")), F.lit(0)).alias(f"d{i}") for i, k in enumerate(ks)])
    rows = F.array(*[F.struct(F.lit(i).alias("knob_ord"), F.lit(k.name).alias("knob"), F.lit(float(k.value)).alias("value"), F.lit(float(k.relaxed)).alias("relaxed"), F.col(f"d{i}").alias("delta")) for i, k in enumerate(ks)])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def ranked(y: DataFrame) -> DataFrame:
    """Largest yield first, document order among equals."""
    return y.orderBy(F.desc("delta"), "knob_ord")


def top_yields(y: DataFrame) -> DataFrame:
    """(knob_ord, knob, value, relaxed, delta, ranked): the knobs of the largest yield, all that tie for it.

    ranked: whether there is an order at all, which is so if there are two knobs or more and the two
    largest yields differ.
    """
    best = y.agg(F.max("delta").alias("best"), F.count(F.lit(1)).alias("n"))
    tied = y.join(F.broadcast(best), F.col("delta") == F.col("best"))  # one row is broadcast
    alone = F.count(F.lit(1)).over(Window.partitionBy("best")) == 1
    return tied.withColumn("ranked", alone & (F.col("n") > 1)).select("knob_ord", "knob", "value", "relaxed", "delta", "ranked")


def preview(df: DataFrame, rs: RuleSet, model: FactModel, knob: Knob, values: list[float]) -> DataFrame:
    """(value, band, n) of each display band at each value of a knob, in one job."""
    base = baseline(df, rs, model)
    each = F.array(*[F.struct(F.lit(float(v)).alias("value"), moved_band(base, rs, model, knob, v).alias("band")) for v in values])
    got = base.select(F.explode(each).alias("e")).groupBy("e.value", "e.band").agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.createDataFrame([(float(v), b) for v in values for b in DISPLAY_BANDS], "value double, band string")
    return F.broadcast(grid).join(got, ["value", "band"], "left").select("value", "band", F.coalesce("n", F.lit(0)).alias("n"))


def excluded(kind: str, op: str, x: Column, v: float) -> Column:
    """Whether one observed value falls outside the pool at a threshold; for windows ``op`` is lte."""
    cmp = {"eq": x == v, "neq": x != v, "gt": x > v, "gte": x >= v, "lt": x < v, "lte": x <= v}[op]
    return ~cmp if kind == "inclusion" else cmp


def knob_values(df: DataFrame, model: FactModel, knob: Knob) -> DataFrame:
    """(patient, x, note): what a knob is compared with; for windows one row per matching code."""
    if knob.what == "value":
        x = finite(F.col(knob.leaf.fact))
        return df.select("patient", x.alias("x"), F.when(x.isNull(), "not recorded").alias("note"))
    codes = knob.leaf.codes
    hits = F.filter(knob.leaf.fact, lambda e: (e["system"] == codes.system) & e["code"].isin(*codes.values))
    rows = df.select("patient", F.explode_outer(F.when(F.col(knob.leaf.fact).isNotNull(), hits)).alias("e"), F.col(knob.leaf.fact).isNull().alias("absent"))
    x = F.col("e.daysAgo").cast("double")
    return rows.where(F.col("absent") | F.col("e").isNotNull()).select("patient", x.alias("x"), F.when(F.col("absent"), "not recorded").when(x.isNull(), "no date").alias("note"))


def nice_width(low: float, high: float, bins: int = 12) -> float:
    """1, 2, 5 or 10 times a power of ten, for about ``bins`` bins."""
    span = high - low
    if not math.isfinite(span) or span <= 0:
        return 1.0
    power = 10 ** math.floor(math.log10(span / bins))
    return next(m * power for m in (1, 2, 5, 10) if span / (m * power) <= bins or m == 10)


def histogram(values: DataFrame, column: str, width: float, cover: tuple[float, ...] = ()) -> DataFrame:
    """(bin, low, high, n) on a grid of ``width`` over values and ``cover``; the last bin is closed, empty bins are there."""
    ext = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    lo = F.floor(F.least("lo", *[F.lit(float(c)) for c in cover]) / width) if cover else F.floor(F.col("lo") / width)
    hi = F.ceil(F.greatest("hi", *[F.lit(float(c)) for c in cover]) / width) if cover else F.ceil(F.col("hi") / width)
    grid = ext.where("lo is not null").select(lo.alias("first"), F.greatest(hi, lo + 1).alias("last"))
    got = values.where(F.col(column).isNotNull()).crossJoin(F.broadcast(grid)).select(F.least(F.floor(F.col(column) / width), F.col("last") - 1).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    bins = grid.select(F.explode(F.sequence("first", F.col("last") - 1)).alias("bin"))
    return bins.join(got, "bin", "left").select("bin", (F.col("bin") * width).alias("low"), ((F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))
