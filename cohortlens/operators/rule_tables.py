"""Tables of rule sets: conditions flattened to nodes, linted, compared and proved contradictory, many at once.

``criteria`` has one row for each criterion: ruleset, version, fact_model, ord (its place), id, ref, kind,
verbatim, ``when`` (its condition as JSON, null for one that isn't modeled); other columns are ignored.
``models`` has one row for each declared fact: fact_model, fact, type, unit, values, systems.

A condition tree becomes an array of nodes level by level inside its row, so that flattening moves
nothing; only joins with the fact models, between versions and between criteria of one rule set shuffle,
on those keys.  No rule set is looped over on the driver: it learns one number, the deepest nesting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.sources.shared import kept

KEYS = ("ruleset", "version")
#: Declared facts, over all models, up to which they are broadcast.
NEAR = 200_000
#: Combining keys of a condition up to which their number tells its levels; beyond it its brackets are looked at too.
FEW = 3
COLUMNS = (*KEYS, "fact_model", "ord", "id", "ref", "kind", "verbatim", "when")


#: Keys may be written with escapes.
_ESCAPED = "contains(`when`, '\\\\')"
#: How many combining keys a condition's text has at most, which takes no parsing; a path that a variant lacks costs far more than one that it has.
_COMBINING = f"""CASE WHEN {_ESCAPED} THEN 1000000 ELSE (length(`when`) - length(replace(replace(replace(`when`, '"all"', ''), '"any"', ''), '"not"', ''))) div 5 END"""


def levels_of(criteria: DataFrame) -> int:
    """The deepest nesting of a condition (an upper bound of its levels): one more than its combining keys, or by its brackets where those are many."""
    keys = F.expr(_COMBINING)
    many = criteria.agg(F.max(keys)).first()[0] or 0
    if many <= FEW:
        return 1 + many
    brackets = F.regexp_extract_all(F.regexp_replace("when", r'"(?:\\.|[^"\\])*"', ""), F.lit(r"[\[{]|[\]}]"), F.lit(0))
    step = lambda acc, c: F.struct((acc["d"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("d"), F.greatest(acc["m"], acc["d"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("m"))
    deep = F.aggregate(brackets, F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")), step, lambda acc: acc["m"])
    return int(criteria.agg(F.max(F.when(keys > FEW, F.least(keys + 1, deep)).otherwise(keys + 1))).first()[0])


_BELOW = """concat(coalesce(try_variant_get(n.v, '$.all', 'array<variant>'), cast(array() AS array<variant>)), coalesce(try_variant_get(n.v, '$.any', 'array<variant>'), cast(array() AS array<variant>)),
           filter(array(try_variant_get(n.v, '$.not', 'variant')), x -> x IS NOT NULL))"""
_IN_ALL = "try_variant_get(n.v, '$.all', 'array<variant>') IS NOT NULL"
_CHILDREN = f"""flatten(transform({{level}}, n -> transform({_BELOW},
    (c, i) -> named_struct('path', concat(n.path, '.', i), 'parent', n.path, 'needed', n.needed AND {_IN_ALL}, 'v', c))))"""
#: The same for needed nodes alone: children of nodes that aren't ``all`` are not looked for.
_NEEDED_CHILDREN = f"""flatten(transform(filter({{level}}, n -> {_IN_ALL}), n -> transform({_BELOW},
    (c, i) -> named_struct('path', concat(n.path, '.', i), 'parent', n.path, 'needed', true, 'v', c))))"""


def with_nodes(criteria: DataFrame, levels: int | None = None, needed: bool = False) -> DataFrame:
    """The criteria with ``nodes``: (path, parent, needed, v) of each node of the condition, parents first.

    ``needed``: nothing but ``all`` stands above; as an argument, only such nodes are wanted.  An unmodeled criterion has none.
    """
    out = criteria.select(*COLUMNS).withColumn("__v", F.expr("try_parse_json(`when`)"))
    out = out.withColumn("__l0", F.expr("filter(array(named_struct('path', '0', 'parent', cast(NULL AS string), 'needed', true, 'v', __v)), n -> n.v IS NOT NULL)"))
    levels = max(1, levels_of(criteria) if levels is None else levels)
    out = out.withColumn("__c", F.expr(_COMBINING))
    for k in range(1, levels):  # so many keys stand above a node of this level
        kids = F.expr((_NEEDED_CHILDREN if needed else _CHILDREN).format(level=f"__l{k - 1}"))
        out = out.withColumn(f"__l{k}", F.when(F.col("__c") >= k, kids).otherwise(F.slice("__l0", 1, 0)))
    return out.withColumn("nodes", F.concat(*[f"__l{k}" for k in range(levels)])).drop("__v", "__c", *[f"__l{k}" for k in range(levels)])


def node_rows(criteria: DataFrame, levels: int | None = None, needed: bool = False) -> DataFrame:
    """One row for each node (``needed``: for each needed one): the criterion's columns, path, parent, needed, node (all, any, not, leaf) and a leaf's parts."""
    flat = with_nodes(criteria, levels, needed).withColumn("__n", F.explode_outer("nodes")).where("__n.path IS NOT NULL")
    get = lambda path, kind: F.try_variant_get("__n.v", path, kind)
    value = get("$.value", "variant")
    shape = F.schema_of_variant(value)
    kind = F.when(value.isNull(), None).when(shape == "STRING", "text").when(shape == "BOOLEAN", "boolean").otherwise("numeric")
    op = get("$.op", "string")
    node = F.when(get("$.all", "array<variant>").isNotNull(), "all").when(get("$.any", "array<variant>").isNotNull(), "any").when(get("$.not", "variant").isNotNull(), "not").otherwise("leaf")
    flat = flat.withColumns({
        "path": F.col("__n.path"), "parent": F.col("__n.parent"), "needed": F.col("__n.needed"), "node": node, "fact": get("$.fact", "string"), "op": op,
        "family": F.when(node != "leaf", None).when(op.isin("in", "notIn"), "set").when(op == "exists", "exists").when(op == "anyWithin", "within").otherwise(kind),
        "number": F.when(kind == "numeric", get("$.value", "double")), "text": F.when(kind == "text", get("$.value", "string")), "unit": get("$.unit", "string"),
        "system": get("$.codes.system", "string"), "codes": get("$.codes.values", "array<string>"), "window_days": get("$.windowDays", "int"),
    })
    return flat.drop("__n", "nodes")


def lint_rules(criteria: DataFrame, models: DataFrame, levels: int | None = None) -> DataFrame:
    """(ruleset, version, level, code, criterion, path, fact): the findings of every rule set against the model that it names."""
    key = [*KEYS, "fact_model"]
    # nearly all rule sets may name one model: a shuffle by its name would send their criteria to one task
    near = F.broadcast if models.limit(NEAR + 1).count() <= NEAR else (lambda d: d)
    known = near(models.select("fact_model").distinct())
    sets = criteria.select(*key).distinct()
    none = F.lit(None).cast("string")
    missing = sets.join(known, "fact_model", "left_anti").select(*KEYS, F.lit("error").alias("level"), F.lit("fact-model-mismatch").alias("code"), none.alias("criterion"), none.alias("path"), none.alias("fact"))
    unmodeled = criteria.where("`when` IS NULL").select(*KEYS, F.lit("info").alias("level"), F.lit("unmodeled-criterion").alias("code"), F.col("id").alias("criterion"), none.alias("path"), none.alias("fact"))
    leaves = node_rows(criteria, levels).where("node = 'leaf'").select(*key, "id", "path", "fact", "op", "family", "number", "text", F.col("unit").alias("given"), "system")
    declared = near(models.withColumn("declared", F.lit(True)))
    j = leaves.join(known, "fact_model").join(declared, ["fact_model", "fact"], "left")
    want = F.when(F.col("family") == "numeric", "number").when(F.col("family") == "text", "enum").when(F.col("family") == "boolean", "boolean").when(F.col("family").isin("set", "within"), "code")
    code = (
        F.when(F.col("declared").isNull(), "unknown-fact")
        .when(want.isNotNull() & (want != F.col("type")), "type-mismatch")
        .when((F.col("family") == "exists") & F.col("type").isin("enum", "boolean"), "exists-value-type")
        .when((F.col("family") == "text") & ~F.coalesce(F.array_contains("values", F.col("text")), F.lit(False)), "unknown-enum-value")
        .when(F.col("system").isNotNull() & ~F.coalesce(F.array_contains("systems", F.col("system")), F.lit(False)), "unknown-code-system")
        .when((F.col("family") == "numeric") & F.col("unit").isNull() & F.col("given").isNotNull(), "unit-unexpected")
        .when((F.col("family") == "numeric") & F.col("unit").isNotNull() & F.col("given").isNull(), "unit-undeclared")
        .when((F.col("family") == "numeric") & (F.col("unit") != F.col("given")), "unit-mismatch")
    )
    found = j.withColumn("code", code).where("code IS NOT NULL").select(*KEYS, F.lit("error").alias("level"), "code", F.col("id").alias("criterion"), "path", "fact")
    return found.unionByName(unmodeled).unionByName(missing)


# --- comparison of neighbouring versions ---------------------------------------------------------------------


def signatures(criteria: DataFrame, levels: int | None = None) -> DataFrame:
    """Adds identity (what a criterion says, whatever the order of keys), signature (with its reference) and shape (literals left out)."""
    part = "concat_ws('|', n.path, coalesce(try_variant_get(n.v, '$.fact', 'string'), ''), coalesce(try_variant_get(n.v, '$.op', 'string'), ''), coalesce(try_variant_get(n.v, '$.unit', 'string'), ''), coalesce(try_variant_get(n.v, '$.codes.system', 'string'), ''), CASE WHEN try_variant_get(n.v, '$.any', 'variant') IS NOT NULL THEN 'any' WHEN try_variant_get(n.v, '$.not', 'variant') IS NOT NULL THEN 'not' WHEN try_variant_get(n.v, '$.all', 'variant') IS NOT NULL THEN 'all' ELSE concat(try_variant_get(n.v, '$.value', 'variant') IS NOT NULL, try_variant_get(n.v, '$.windowDays', 'variant') IS NOT NULL) END)"
    out = with_nodes(criteria, levels)
    said = F.to_json(F.expr("try_parse_json(`when`)"))
    told = lambda *cols: F.sha2(F.to_json(F.array(*[F.coalesce(c.cast("string"), F.lit("\0")) for c in cols])), 256)
    out = out.withColumn("identity", told(F.col("kind"), F.col("verbatim"), said))
    return out.withColumns({"signature": told(F.col("ref"), F.col("identity")), "shape": told(F.col("kind"), F.expr(f"array_join(transform(nodes, n -> {part}), ';')"), F.col("when").isNull())}).drop("nodes")


def version_pairs(criteria: DataFrame) -> DataFrame:
    """(ruleset, from_version, version) of neighbouring versions, ordered by their three numbers."""
    v = criteria.select(*KEYS).distinct()
    numbers = F.transform(F.split("version", r"\."), lambda x: x.cast("int"))
    return v.select("ruleset", F.lag("version").over(Window.partitionBy("ruleset").orderBy(numbers, "version")).alias("from_version"), "version").where("from_version IS NOT NULL")


def structural_changes(criteria: DataFrame, levels: int | None = None) -> DataFrame:
    """(ruleset, from_version, version, change, id, from_id) of every pair of neighbouring versions.

    change: added, removed, changed, reordered or renamed; a rename is a criterion that is equal but for
    its id, or one of the same shape under a reference that both versions use once.
    """
    pair = ["ruleset", "from_version", "version"]
    c = signatures(criteria, levels).select(*KEYS, "ord", "id", "ref", "identity", "signature", "shape")
    pairs = version_pairs(criteria)
    ref_uses = F.count(F.lit(1)).over(Window.partitionBy("ruleset", "version", "ref"))
    c = c.withColumn("ref_once", F.col("ref").isNotNull() & (ref_uses == 1))
    old = c.withColumnRenamed("version", "from_version").join(pairs, ["ruleset", "from_version"])
    new = c.join(pairs, list(KEYS))
    told = lambda d, side: d.select(*pair, "id", F.struct("ord", "ref", "identity", "signature", "shape", "ref_once").alias(side))
    both = kept(told(old, "a").join(told(new, "b"), [*pair, "id"], "full"), "version-pairs")

    common = both.where("a IS NOT NULL AND b IS NOT NULL")
    place = lambda side: F.row_number().over(Window.partitionBy(*pair).orderBy(f"{side}.ord", "id"))
    common = common.withColumns({"__pa": place("a"), "__pb": place("b")})
    none = F.lit(None).cast("string")
    out = lambda d, change, from_id=none: d.select(*pair, F.lit(change).alias("change"), "id", from_id.alias("from_id"))

    gone, came = both.where("b IS NULL").select(*pair, "id", "a.*"), both.where("a IS NULL").select(*pair, "id", "b.*")

    def matched(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
        """Rows of both sides whose key is unique on each."""
        once = lambda d, name: d.groupBy(*pair, *key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "identity")).alias(name)).where("n = 1").drop("n")
        return once(left, "l").join(once(right, "r"), [*pair, *key]).select(*pair, F.col("l.id").alias("from_id"), F.col("r.id").alias("id"), (F.col("l.identity") != F.col("r.identity")).alias("differs"))

    same = kept(matched(gone, came, ["identity"]), "same")
    rest_gone = gone.where("ref_once").join(same.select(*pair, F.col("from_id").alias("id")), [*pair, "id"], "left_anti")
    rest_came = came.where("ref_once").join(same.select(*pair, "id"), [*pair, "id"], "left_anti")
    renamed = kept(same.unionByName(matched(rest_gone, rest_came, ["ref", "shape"])), "renames")
    return (
        out(came.join(renamed.select(*pair, "id"), [*pair, "id"], "left_anti"), "added")
        .unionByName(out(gone.join(renamed.select(*pair, F.col("from_id").alias("id")), [*pair, "id"], "left_anti"), "removed"))
        .unionByName(out(common.where("a.signature != b.signature"), "changed"))
        .unionByName(out(renamed.where("differs"), "changed"))
        .unionByName(out(common.where("__pa != __pb"), "reordered"))
        .unionByName(renamed.select(*pair, F.lit("renamed").alias("change"), "id", "from_id"))
    )


# --- contradictions ---------------------------------------------------------------------------------------------


def _meet() -> list[Column]:
    """The intersection of rows (low, low_open, high, high_open): ends with their openness.

    Open and closed ends apart, as numbers: these are aggregated by hashing, where pairs would be sorted.
    """
    low_open, low_closed = F.max(F.when(F.col("low_open"), F.col("low"))), F.max(F.when(~F.col("low_open"), F.col("low")))
    high_open, high_closed = F.min(F.when(F.col("high_open"), F.col("high"))), F.min(F.when(~F.col("high_open"), F.col("high")))
    known = ~F.max(F.col("high").isNull())  # an end without a number leaves the high end unknown
    return [
        F.greatest(low_open, low_closed).alias("low"), F.coalesce(low_open >= low_closed, low_open.isNotNull()).alias("low_open"),
        F.when(known, F.least(high_open, high_closed)).alias("high"), F.coalesce(high_open <= high_closed, high_open.isNotNull()).alias("high_open"),
    ]


_EMPTY = "(low > high OR (low = high AND (low_open OR high_open)))"
_POINT = f"(low = high AND NOT {_EMPTY})"


def _required_sets(sets: DataFrame, left: str, right: str, keep: list[str]) -> DataFrame:
    """Pairs of code sets of one rule set, fact and system of which the left one is within the right one, by joining their codes."""
    key = [*KEYS, "fact", "system"]
    one = lambda op, side: sets.where(F.col("op") == op).select(*key, F.struct("ord", "id", "kind", "path", "alone", F.size("codes").alias("n")).alias(side), F.explode("codes").alias("code"))
    met = one(left, "x").join(one(right, "y"), [*key, "code"]).groupBy(*key, "x", "y").agg(F.count(F.lit(1)).alias("shared"))
    return met.where("shared = x.n").select(*key, *keep)


_CRITERION = (*KEYS, "ord", "id", "kind")


#: Leaves with a value, cut down in their row: after an explode each part would be taken out once for the filter and again for its column.
_VALUED = f"""filter(transform(nodes, n -> named_struct('fact', try_variant_get(n.v, '$.fact', 'string'), 'op', try_variant_get(n.v, '$.op', 'string'), 'value', CASE WHEN __c = 0 OR try_variant_get(n.v, '$.all', 'array<variant>') IS NULL
    AND try_variant_get(n.v, '$.any', 'array<variant>') IS NULL AND try_variant_get(n.v, '$.not', 'variant') IS NULL THEN try_variant_get(n.v, '$.value', 'variant') END)),
    x -> x.value IS NOT NULL AND NOT coalesce(x.op IN ('in', 'notIn', 'exists', 'anyWithin'), false))"""


def _numbers(criteria: DataFrame, levels: int | None = None) -> DataFrame:
    """(criterion, fact, op, number): the needed numeric leaves, as :func:`node_rows` has them."""
    levels = levels_of(criteria) if levels is None else levels
    said = criteria.withColumn("when", F.expr(f"""CASE WHEN {_ESCAPED} OR contains(`when`, '"value"') THEN `when` END"""))  # the others have no such leaf: not parsed
    x = with_nodes(said, levels, needed=True).withColumn("__c", F.expr(_COMBINING)).select(*_CRITERION, F.explode(F.expr(_VALUED)).alias("__x"))
    return x.where(~F.schema_of_variant("__x.value").isin("STRING", "BOOLEAN")).select(*_CRITERION, "__x.fact", "__x.op", F.try_variant_get("__x.value", "$", "double").alias("number"))


def _intervals(numeric: DataFrame) -> DataFrame:
    """(criterion, fact, low, low_open, high, high_open): what each criterion needs of a fact."""
    inf = float("inf")
    ends = numeric.where("op <> 'neq'").select(
        *_CRITERION, "fact",
        F.when(F.col("op").isin("eq", "gt", "gte"), F.col("number")).otherwise(F.lit(-inf)).alias("low"), (~F.col("op").isin("eq", "gte")).alias("low_open"),
        F.when(F.col("op").isin("eq", "lt", "lte"), F.col("number")).otherwise(F.lit(inf)).alias("high"), (~F.col("op").isin("eq", "lte")).alias("high_open"),
    )
    return ends.groupBy(*_CRITERION, "fact").agg(*_meet())


def interval_text() -> Column:
    number = lambda x: F.when(x == float("inf"), "∞").when(x == -float("inf"), "-∞").when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))
    return F.concat(F.when(F.col("low_open"), "(").otherwise("["), number(F.col("low")), F.lit(", "), number(F.col("high")), F.when(F.col("high_open"), ")").otherwise("]"))


def admitted_intervals(criteria: DataFrame, levels: int | None = None) -> DataFrame:
    """(ruleset, version, fact, interval, n): what the inclusions of a rule set admit of each fact together; interval ``empty`` if nothing."""
    inclusive = _intervals(_numbers(criteria, levels)).where(f"kind = 'inclusion' AND NOT {_EMPTY}")
    met = inclusive.groupBy(*KEYS, "fact").agg(*_meet(), F.count(F.lit(1)).alias("n"))
    return met.select(*KEYS, "fact", F.when(F.expr(_EMPTY), "empty").otherwise(interval_text()).alias("interval"), "n")


def contradictions(criteria: DataFrame, levels: int | None = None) -> DataFrame:
    """(ruleset, version, level, code, fact, criteria) that no patient can satisfy; ``criteria``: ids, comma-joined.

    Intervals meet by their greatest low and least high end, so that any number of criteria on a fact is
    one aggregate; where nothing is left, the first criterion with the greatest low and the first with the
    least high end are named.  Code sets are compared by joining their codes.
    """
    rows = node_rows(criteria, levels, needed=True).select(*KEYS, "ord", "id", "kind", "path", "needed", "node", "fact", "op", "family", "number", "system", F.array_distinct(F.coalesce("codes", F.array().cast("array<string>"))).alias("codes"))
    rows = kept(rows, "needed-nodes")
    crit = list(_CRITERION)
    finding = lambda d, level, code, ids, fact=F.col("fact"): d.select(*KEYS, F.lit(level).alias("level"), F.lit(code).alias("code"), fact.alias("fact"), ids.alias("criteria"))
    needed = rows
    partial = needed.groupBy(*crit).agg(
        F.max(F.col("node").isin("any", "not") | ((F.col("node") == "leaf") & ~F.coalesce(F.col("family").isin("numeric", "set"), F.lit(False)))).alias("partial"),
        F.max(F.coalesce((F.col("family") == "set") | ((F.col("family") == "numeric") & (F.col("op") == "neq")), F.lit(False))).alias("other"),
        F.max(F.coalesce((F.col("family") == "numeric") & (F.col("op") != "neq"), F.lit(False))).alias("ranged"),
    )
    out = finding(partial.where("partial"), "info", "analysis-incomplete", F.col("id"), F.lit(None).cast("string"))

    numeric = needed.where("family = 'numeric'")
    by_criterion = kept(_intervals(numeric), "intervals")
    holes = numeric.where("op = 'neq'").select(*crit, "fact", F.col("number").alias("hole")).distinct()
    out = out.unionByName(finding(by_criterion.where(_EMPTY), "error", "unsatisfiable-criterion", F.col("id")))
    hit = by_criterion.where(_POINT).join(holes, [*crit, "fact"]).where("low = hole")
    out = out.unionByName(finding(hit, "error", "unsatisfiable-criterion", F.col("id")))

    # code sets; an only set is the whole condition of its criterion
    sets = needed.where("family = 'set'").withColumn("alone", F.col("path") == "0").distinct()
    forbidden = _required_sets(sets, "in", "notIn", ["x", "y"])
    own = forbidden.where("x.id = y.id").select(*KEYS, "fact", "system", F.col("x.id").alias("id")).distinct()
    out = out.unionByName(finding(own, "error", "unsatisfiable-criterion", F.col("id")))
    two = lambda d, a, b: F.concat_ws(",", F.col(f"{a}.id"), F.col(f"{b}.id"))
    ordered = F.when(F.col("x.ord") < F.col("y.ord"), two(None, "x", "y")).otherwise(two(None, "y", "x"))
    between = forbidden.where("x.id <> y.id AND x.kind = 'inclusion' AND y.kind = 'inclusion'").select(*KEYS, "fact", "system", ordered.alias("ids"), F.col("x.id").alias("needs")).distinct()
    out = out.unionByName(finding(between, "error", "contradictory-inclusions", F.col("ids")))
    excluded = _required_sets(sets.where("alone"), "in", "in", ["x", "y"]).where("x.kind = 'inclusion' AND y.kind = 'exclusion'")
    out = out.unionByName(finding(excluded, "error", "unsatisfiable-ruleset", two(None, "x", "y")))

    # what all inclusions of a rule set admit of a fact
    inclusive = by_criterion.where(f"kind = 'inclusion' AND NOT {_EMPTY}")
    # (ord, id) of the first criterion with the greatest low end and of the first with the least high end
    first_low = F.max_by(F.struct("ord", "id"), F.struct("low", "low_open", (-F.col("ord")).alias("o")))
    first_high = F.min_by(F.struct("ord", "id"), F.struct("high", (~F.col("high_open")).alias("c"), "ord"))
    admitted = kept(inclusive.groupBy(*KEYS, "fact").agg(*_meet(), first_low.alias("x"), first_high.alias("y"), F.count(F.lit(1)).alias("n")), "admitted")
    ids = F.when(F.col("x.ord") < F.col("y.ord"), two(None, "x", "y")).otherwise(two(None, "y", "x"))
    apart = admitted.where(f"{_EMPTY} AND n > 1")
    out = out.unionByName(finding(apart, "error", "contradictory-inclusions", ids))
    point = admitted.where(_POINT).select(*KEYS, "fact", "low")
    outside = holes.where("kind = 'inclusion'").join(inclusive.select(*crit, "fact"), [*crit, "fact"], "left_anti")
    pierced = point.join(outside, [*KEYS, "fact"]).where("low = hole")
    out = out.unionByName(finding(pierced, "error", "contradictory-inclusions", F.col("id")))

    # exclusions that cover all that is admitted, where the inclusions don't contradict each other already
    contradicted = apart.select(*KEYS).unionByName(pierced.select(*KEYS)).distinct()
    whole = partial.where("kind = 'exclusion' AND NOT partial AND NOT other AND ranged").select(*crit)
    theirs = by_criterion.join(whole, crit, "left_semi")
    e = theirs.select(*crit, "fact", F.struct("low", "low_open", "high", "high_open").alias("e"), F.expr(_EMPTY).alias("nothing"))
    j = e.join(admitted.where(f"NOT {_EMPTY}").select(*KEYS, "fact", "low", "low_open", "high", "high_open"), [*KEYS, "fact"], "left")
    covers = ~F.col("nothing") & F.col("low").isNotNull() & (
        (F.col("e.low") < F.col("low")) | ((F.col("e.low") == F.col("low")) & (~F.col("e.low_open") | F.col("low_open")))
    ) & ((F.col("e.high") > F.col("high")) | ((F.col("e.high") == F.col("high")) & (~F.col("e.high_open") | F.col("high_open"))))
    full = j.groupBy(*crit).agg(F.min(F.coalesce(covers, F.lit(False))).alias("all"), F.array_join(F.array_sort(F.collect_set("fact")), ",").alias("fact")).where("`all`")
    full = full.join(contradicted, list(KEYS), "left_anti")
    return out.unionByName(finding(full, "error", "unsatisfiable-ruleset", F.col("id")))
