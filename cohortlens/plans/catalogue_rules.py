"""Queries over tables of rule sets that are derived from the line items, with SQL that walks the conditions recursively."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators import cohort, rule_tables
from cohortlens.plans.catalogue import query
from cohortlens.plans.cohort_tables import MODEL

#: The customers' model, and one fact with a unit.
_FACTS = [*((k, d.type, d.unit, d.values, d.systems) for k, d in MODEL.facts.items()), ("weight", "number", "kg", (), ())]


def _leaf(fact: str, op: str, value: str | None = None, rest: str = "") -> str:
    """SQL of a leaf as JSON; value: SQL of a number, or JSON."""
    told = "" if value is None else f""","value":', {value}, '"""
    return f"""concat('{{"fact":"{fact}","op":"{op}"{told}{rest}}}')"""


def _set(op: str, *codes: str, system: str = "priority", fact: str = "orders") -> str:
    return f"""'{{"fact":"{fact}","op":"{op}","codes":{{"system":"{system}","values":[{", ".join('"' + c + '"' for c in codes)}]}}}}'"""


def _node(kind: str, *kids: str) -> str:
    return f"""concat('{{"{kind}":[', {", ',', ".join(kids)}, ']}}')"""


def _not(kid: str) -> str:
    return f"""concat('{{"not":', {kid}, '}}')"""


def _case(by: str, cases: list[str | None]) -> str:
    return f"CASE {by} " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cases) if c) + " END"


#: The rest of a leaf's JSON that follows its value.
_KG, _LB = ',"unit":"kg"', ',"unit":"lb"'
_Q = "CAST(l_quantity AS BIGINT)"
_LINTED = f"""SELECT l_partkey AS ruleset, '1.0.0' AS version, CASE WHEN l_partkey % 10 = 0 THEN 'gone/v1' ELSE 'customer-facts/v1' END AS fact_model, l_orderkey * 8 + l_linenumber AS ord,
  concat('c', l_orderkey, '-', l_linenumber) AS id, CAST(NULL AS STRING) AS ref, CASE WHEN l_linenumber % 2 = 0 THEN 'exclusion' ELSE 'inclusion' END AS kind, 'text' AS verbatim,
  {_case("(l_orderkey + l_linenumber * 3) % 16", [
      None, _leaf("acct_balance", "gte", _Q), _leaf("nope", "gt", _Q), _leaf("segment", "gt", _Q), _leaf("segment", "eq", """concat('"', l_returnflag, '"')"""), _leaf("segment", "eq", """'"BUILDING"'"""),
      _leaf("vip", "eq", "'true'"), _leaf("vip", "exists"), _set("in", "1-URGENT", system="zz"), _leaf("acct_balance", "lt", _Q, _KG),
      _node("all", _leaf("acct_balance", "gt", _Q), _not(_node("any", _leaf("nope", "exists"), _leaf("segment", "eq", "'true'")))), _set("in", "a", fact="acct_balance"),
      _leaf("weight", "gt", _Q), _leaf("weight", "gt", _Q, _LB), _leaf("weight", "gt", _Q, _KG), _not(_not(_not(_set("notIn", "5-LOW")))),
  ])} AS "when" FROM lineitem"""  # fmt: skip
_A, _B = f"{_Q} % 4", f"{_Q} % 6"
_CLASHING = f"""SELECT l_orderkey AS ruleset, '1.0.0' AS version, 'customer-facts/v1' AS fact_model, CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey AS ord, concat('c', l_linenumber, '-', l_partkey) AS id, CAST(NULL AS STRING) AS ref,
  CASE WHEN (l_linenumber + l_orderkey) % 3 = 0 THEN 'exclusion' ELSE 'inclusion' END AS kind, 'text' AS verbatim,
  {_case("l_partkey % 12", [
      _leaf("weight", "gte", _A), _leaf("weight", "lte", _B), _node("all", _leaf("weight", "gt", _A), _leaf("weight", "lt", _B)), _leaf("weight", "eq", _A), _leaf("weight", "neq", _A),
      f"CASE WHEN l_suppkey % 2 = 0 THEN {_set('in', 'A')} ELSE {_set('in', 'A', 'B')} END", _set("notIn", "A", "B"), _node("any", _leaf("weight", "gt", _A), _leaf("acct_balance", "gt", _B)),
      _node("all", _leaf("weight", "eq", _A), _leaf("weight", "neq", _B)), _node("all", _set("in", "A"), _node("all", _set("notIn", "B", "A"))), _leaf("vip", "eq", "'true'"), None,
  ])} AS "when" FROM lineitem"""  # fmt: skip


def _table(spark: SparkSession, d: str, sql: str) -> DataFrame:
    """The rows of a SELECT from the line items that Spark and the oracle share."""
    columns = sql.removeprefix("SELECT ").removesuffix(" FROM lineitem").replace('AS "when"', "AS `when`")
    return spark.read.parquet(f"{d}/lineitem.parquet").selectExpr(*_columns(columns))


def _columns(text: str) -> list[str]:
    """The expressions of a SELECT list, cut at commas outside of brackets and quotes."""
    out, depth, quoted, last = [], 0, False, 0
    for i, c in enumerate(text):
        if c == "'":
            quoted = not quoted
        elif not quoted and c in "()":
            depth += 1 if c == "(" else -1
        elif not quoted and c == "," and depth == 0:
            out.append(text[last:i])
            last = i + 1
    return [*out, text[last:]]


def _models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("customer-facts/v1", *r[:3], list(r[3]), list(r[4])) for r in _FACTS], "fact_model string, fact string, type string, unit string, values array<string>, systems array<string>")


def _list_sql(x) -> str:
    return "[" + ", ".join(f"'{v}'" for v in x) + "]::VARCHAR[]"


_MODEL_SQL = "m(fact, type, unit, vals, systems) AS (VALUES " + ", ".join(f"('{k}', '{t}', {'NULL' if u is None else repr(u)}, {_list_sql(v)}, {_list_sql(s)})" for k, t, u, v, s in _FACTS) + ")"
_KIDS = """coalesce(json_extract(j, '$.all[*]'), []) || coalesce(json_extract(j, '$.any[*]'), []) || CASE WHEN json_extract(j, '$.not') IS NULL THEN [] ELSE [json_extract(j, '$.not')] END"""


def _walked(criteria: str) -> str:
    """The criteria ``c`` and their nodes ``t``, in SQL."""
    return f"""RECURSIVE c AS ({criteria}), t(ruleset, ord, id, kind, fact_model, path, needed, j) AS (
  SELECT ruleset, ord, id, kind, fact_model, '0', true, "when"::JSON FROM c WHERE "when" IS NOT NULL
  UNION ALL SELECT ruleset, ord, id, kind, fact_model, path || '.' || k.i, needed AND json_extract(j, '$.all') IS NOT NULL, k.x FROM t, LATERAL (SELECT unnest({_KIDS}) AS x, generate_subscripts({_KIDS}, 1) - 1 AS i) AS k),
leaf AS (SELECT ruleset, ord, id, kind, fact_model, path, needed, json_extract_string(j, '$.fact') AS fact, json_extract_string(j, '$.op') AS op, json_type(json_extract(j, '$.value')) AS vt, json_extract_string(j, '$.value') AS v,
  json_extract_string(j, '$.unit') AS unit, json_extract_string(j, '$.codes.system') AS system, json_extract_string(j, '$.codes.values[*]') AS codes FROM t WHERE json_extract(j, '$.fact') IS NOT NULL)"""


_LINT_SQL = f"""WITH {_walked(_LINTED)}, {_MODEL_SQL},
j AS (SELECT ruleset, id, path, fact, op, v, l.unit AS given, system, m.type, m.unit, m.vals, m.systems, CASE WHEN op IN ('in', 'notIn') THEN 'code' WHEN op = 'exists' THEN 'exists' WHEN vt = 'VARCHAR' THEN 'enum' WHEN vt = 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS want
  FROM leaf AS l LEFT JOIN m USING (fact) WHERE fact_model = 'customer-facts/v1'),
x AS (SELECT ruleset, 'error' AS level, CASE WHEN type IS NULL THEN 'unknown-fact' WHEN want <> 'exists' AND want <> type THEN 'type-mismatch' WHEN want = 'exists' AND type IN ('enum', 'boolean') THEN 'exists-value-type'
  WHEN want = 'enum' AND NOT list_contains(vals, v) THEN 'unknown-enum-value' WHEN want = 'code' AND NOT list_contains(systems, system) THEN 'unknown-code-system'
  WHEN want = 'number' AND unit IS NULL AND given IS NOT NULL THEN 'unit-unexpected' WHEN want = 'number' AND unit IS NOT NULL AND given IS NULL THEN 'unit-undeclared' WHEN want = 'number' AND unit <> given THEN 'unit-mismatch' END AS code, id AS criterion, path, fact FROM j)
SELECT * FROM x WHERE code IS NOT NULL UNION ALL SELECT ruleset, 'info', 'unmodeled-criterion', id, NULL, NULL FROM c WHERE "when" IS NULL
UNION ALL SELECT DISTINCT ruleset, 'error', 'fact-model-mismatch', NULL, NULL, NULL FROM c WHERE fact_model <> 'customer-facts/v1'"""


@query("lint_rule_findings", _LINT_SQL)
def _(spark, d):
    """One rule set for each part, linted in one job."""
    return rule_tables.lint_rules(_table(spark, d, _LINTED), _models(spark)).drop("version")


@query("finding_levels", f"SELECT l.level, count(x.level) AS n FROM (VALUES ('error'), ('warning'), ('info')) AS l(level) LEFT JOIN ({_LINT_SQL}) AS x ON x.level = l.level GROUP BY l.level")
def _(spark, d):
    return cohort.level_counts(rule_tables.lint_rules(_table(spark, d, _LINTED), _models(spark)))


#: Whole numbers only: an open low end v is 2v + 1 and a closed one 2v, an open high end 2v - 1; nothing is left where low > high.
_ENDS_SQL = f"""{_walked(_CLASHING)},
num AS (SELECT *, v::BIGINT AS n FROM leaf WHERE needed AND vt IN ('BIGINT', 'UBIGINT', 'DOUBLE')),
iv AS (SELECT ruleset, ord, id, kind, fact, coalesce(max(CASE op WHEN 'gt' THEN 2 * n + 1 WHEN 'gte' THEN 2 * n WHEN 'eq' THEN 2 * n END), -1000000) AS lo, coalesce(min(CASE op WHEN 'lt' THEN 2 * n - 1 WHEN 'lte' THEN 2 * n WHEN 'eq' THEN 2 * n END), 1000000) AS hi
  FROM num WHERE op <> 'neq' GROUP BY ALL),
hole AS (SELECT DISTINCT ruleset, ord, id, kind, fact, n FROM num WHERE op = 'neq'),
inc AS (SELECT * FROM iv WHERE kind = 'inclusion' AND lo <= hi),
adm AS (SELECT ruleset, fact, max(lo) AS lo, min(hi) AS hi, count(*) AS n, arg_max(ord, lo * 100000000 - ord) AS xo, arg_max(id, lo * 100000000 - ord) AS xi, arg_min(ord, hi * 100000000 + ord) AS yo, arg_min(id, hi * 100000000 + ord) AS yi FROM inc GROUP BY ALL)"""


@query("interval_algebra", f"""WITH {_ENDS_SQL} SELECT ruleset, fact, n, CASE WHEN lo > hi THEN 'empty' ELSE CASE WHEN lo = -1000000 THEN '(-∞' WHEN lo % 2 = 0 THEN '[' || lo // 2 ELSE '(' || (lo - 1) // 2 END || ', ' ||
  CASE WHEN hi = 1000000 THEN '∞)' WHEN hi % 2 = 0 THEN hi // 2 || ']' ELSE (hi + 1) // 2 || ')' END END AS "interval" FROM adm""")
def _(spark, d):
    """What the inclusions of each order's rule set admit of a fact."""
    return rule_tables.admitted_intervals(_table(spark, d, _CLASHING)).drop("version")


@query("conflict_findings", f"""WITH {_ENDS_SQL},
s AS (SELECT ruleset, ord, id, kind, op, path = '0' AS alone, fact, system, codes FROM leaf WHERE needed AND op IN ('in', 'notIn')),
within AS (SELECT x.ruleset, x.fact, x.ord AS xo, x.id AS xi, x.kind AS xk, y.ord AS yo, y.id AS yi, y.kind AS yk FROM s AS x JOIN s AS y ON x.ruleset = y.ruleset AND x.fact = y.fact AND x.system = y.system AND x.op = 'in' AND y.op = 'notIn' AND list_has_all(y.codes, x.codes)),
apart AS (SELECT ruleset, fact, CASE WHEN xo < yo THEN xi || ',' || yi ELSE yi || ',' || xi END AS criteria FROM adm WHERE lo > hi AND n > 1),
pierced AS (SELECT a.ruleset, a.fact, h.id FROM adm AS a JOIN hole AS h ON a.ruleset = h.ruleset AND a.fact = h.fact AND h.kind = 'inclusion' AND a.lo = a.hi AND a.lo = 2 * h.n
  WHERE NOT EXISTS (SELECT 1 FROM inc WHERE inc.ruleset = h.ruleset AND inc.id = h.id AND inc.fact = h.fact)),
vague AS (SELECT DISTINCT ruleset, id FROM t WHERE needed AND (json_extract(j, '$.any') IS NOT NULL OR json_extract(j, '$.not') IS NOT NULL)
  UNION SELECT ruleset, id FROM leaf WHERE needed AND op NOT IN ('in', 'notIn') AND vt NOT IN ('BIGINT', 'UBIGINT', 'DOUBLE')),
plain AS (SELECT * FROM iv WHERE kind = 'exclusion' AND NOT EXISTS (SELECT 1 FROM vague AS p WHERE p.ruleset = iv.ruleset AND p.id = iv.id) AND NOT EXISTS (SELECT 1 FROM s WHERE s.ruleset = iv.ruleset AND s.id = iv.id)
  AND NOT EXISTS (SELECT 1 FROM hole AS h WHERE h.ruleset = iv.ruleset AND h.id = iv.id))
SELECT ruleset, 'info' AS level, 'analysis-incomplete' AS code, NULL AS fact, id AS criteria FROM vague
UNION ALL SELECT ruleset, 'error', 'unsatisfiable-criterion', fact, id FROM iv WHERE lo > hi
UNION ALL SELECT ruleset, 'error', 'unsatisfiable-criterion', fact, id FROM iv JOIN hole USING (ruleset, ord, id, kind, fact) WHERE lo = hi AND lo = 2 * hole.n
UNION ALL SELECT DISTINCT ruleset, 'error', 'unsatisfiable-criterion', fact, xi FROM within WHERE xi = yi
UNION ALL SELECT ruleset, 'error', 'contradictory-inclusions', fact, ids FROM (SELECT DISTINCT ruleset, fact, xi, CASE WHEN xo < yo THEN xi || ',' || yi ELSE yi || ',' || xi END AS ids FROM within WHERE xi <> yi AND xk = 'inclusion' AND yk = 'inclusion')
UNION ALL SELECT x.ruleset, 'error', 'unsatisfiable-ruleset', x.fact, x.id || ',' || y.id FROM s AS x JOIN s AS y ON x.ruleset = y.ruleset AND x.fact = y.fact AND x.system = y.system AND x.op = 'in' AND y.op = 'in' AND x.alone AND y.alone AND x.kind = 'inclusion' AND y.kind = 'exclusion' AND list_has_all(y.codes, x.codes)
UNION ALL SELECT ruleset, 'error', 'contradictory-inclusions', fact, criteria FROM apart
UNION ALL SELECT ruleset, 'error', 'contradictory-inclusions', fact, id FROM pierced
UNION ALL SELECT p.ruleset, 'error', 'unsatisfiable-ruleset', string_agg(p.fact, ',' ORDER BY p.fact), p.id FROM plain AS p LEFT JOIN adm AS a ON a.ruleset = p.ruleset AND a.fact = p.fact AND a.lo <= a.hi
  WHERE p.ruleset NOT IN (SELECT ruleset FROM apart UNION SELECT ruleset FROM pierced) GROUP BY p.ruleset, p.id HAVING bool_and(coalesce(p.lo <= p.hi AND p.lo <= a.lo AND p.hi >= a.hi, false))""")
def _(spark, d):
    """One rule set for each order: all that no patient can satisfy."""
    return rule_tables.contradictions(_table(spark, d, _CLASHING)).drop("version")


# --- versions ---------------------------------------------------------------------------------------------------

_VERSIONS = """SELECT l_suppkey AS ruleset, year(l_shipdate) AS y, l_partkey % 12 AS k, max(CAST(l_quantity AS BIGINT)) AS q, min(l_orderkey) AS o FROM lineitem GROUP BY l_suppkey, year(l_shipdate), l_partkey % 12 HAVING min(l_orderkey) % 7 <> 0"""
_CONDITION = """CASE WHEN k = 11 THEN NULL WHEN k = 0 OR k = 8 THEN '{"fact":"a","op":"lt","value":7}' WHEN k % 2 = 0 THEN concat('{"all":[{"fact":"a","op":"gt","value":', q, '},{"fact":"b","op":"exists"}]}') ELSE concat('{"fact":"a","op":"lt","value":', q, '}') END"""
#: The same conditions with other places of their keys and another form of their numbers.
_OTHERWISE = """CASE WHEN k = 11 THEN NULL WHEN k = 0 OR k = 8 THEN '{"value": 7.0, "op":"lt", "fact":"a"}' WHEN k % 2 = 0 THEN concat('{"all":[{"op":"gt","value":', q, ',"fact":"a"}, {"op":"exists","fact":"b"}]}') ELSE concat('{"value":', q, '.0,"fact":"a","op":"lt"}') END"""
_PARTS = {
    "id": "CASE WHEN k % 4 = 0 THEN concat('k', k, '-', y) ELSE concat('k', k) END", "ref": "CASE WHEN k % 3 = 0 THEN NULL ELSE concat('R', k) END", "kind": "CASE WHEN k % 2 = 0 THEN 'inclusion' ELSE 'exclusion' END",
    "verbatim": "concat('text ', k)", "ord": "(o % 5) * 100 + k",
}


@query("structural_diff", f"""WITH c AS (SELECT ruleset, y, {", ".join(f"{v} AS {k}" for k, v in _PARTS.items())}, {_CONDITION} AS w FROM ({_VERSIONS})),
p AS (SELECT ruleset, lag(y) OVER (PARTITION BY ruleset ORDER BY y) AS f, y AS t FROM (SELECT DISTINCT ruleset, y FROM c)),
sig AS (SELECT *, concat_ws('|', kind, verbatim, coalesce(w, 'null')) AS ident, concat_ws('|', kind, coalesce(regexp_replace(w, '"value":[0-9]+', '"value"'), 'null')) AS shape, count(*) OVER (PARTITION BY ruleset, y, ref) AS uses FROM c),
a AS (SELECT p.f, p.t, sig.* FROM sig JOIN p ON p.ruleset = sig.ruleset AND p.f = sig.y), b AS (SELECT p.f, p.t, sig.* FROM sig JOIN p ON p.ruleset = sig.ruleset AND p.t = sig.y WHERE p.f IS NOT NULL),
gone AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.ruleset = a.ruleset AND b.t = a.t AND b.id = a.id)), came AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.ruleset = b.ruleset AND a.t = b.t AND a.id = b.id)),
same AS (SELECT g.ruleset, g.t, g.id AS gid, n.id AS nid, false AS differs FROM (SELECT *, count(*) OVER (PARTITION BY ruleset, t, ident) AS n FROM gone) AS g JOIN (SELECT *, count(*) OVER (PARTITION BY ruleset, t, ident) AS n FROM came) AS n USING (ruleset, t, ident) WHERE g.n = 1 AND n.n = 1),
rg AS (SELECT *, count(*) OVER (PARTITION BY ruleset, t, ref, shape) AS n FROM gone WHERE ref IS NOT NULL AND uses = 1 AND (ruleset, t, id) NOT IN (SELECT ruleset, t, gid FROM same)),
rn AS (SELECT *, count(*) OVER (PARTITION BY ruleset, t, ref, shape) AS n FROM came WHERE ref IS NOT NULL AND uses = 1 AND (ruleset, t, id) NOT IN (SELECT ruleset, t, nid FROM same)),
ren AS (SELECT * FROM same UNION ALL SELECT rg.ruleset, rg.t, rg.id, rn.id, rg.ident <> rn.ident FROM rg JOIN rn USING (ruleset, t, ref, shape) WHERE rg.n = 1 AND rn.n = 1),
com AS (SELECT a.ruleset, a.t, a.id, a.ident || coalesce(a.ref, '') <> b.ident || coalesce(b.ref, '') AS differs, row_number() OVER (PARTITION BY a.ruleset, a.t ORDER BY a.ord, a.id) AS pa, row_number() OVER (PARTITION BY a.ruleset, a.t ORDER BY b.ord, b.id) AS pb FROM a JOIN b USING (ruleset, t, id))
SELECT ruleset, t - 1990 AS major, 'added' AS change, id, NULL AS from_id FROM came WHERE (ruleset, t, id) NOT IN (SELECT ruleset, t, nid FROM ren)
UNION ALL SELECT ruleset, t - 1990, 'removed', id, NULL FROM gone WHERE (ruleset, t, id) NOT IN (SELECT ruleset, t, gid FROM ren)
UNION ALL SELECT ruleset, t - 1990, 'changed', id, NULL FROM com WHERE differs UNION ALL SELECT ruleset, t - 1990, 'changed', nid, NULL FROM ren WHERE differs
UNION ALL SELECT ruleset, t - 1990, 'reordered', id, NULL FROM com WHERE pa <> pb UNION ALL SELECT ruleset, t - 1990, 'renamed', nid, gid FROM ren""")
def _(spark, d):
    """One rule set for each supplier, one version for each year; all neighbouring versions are compared in one job."""
    base = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("ruleset"), F.year("l_shipdate").alias("y"), F.expr("l_partkey % 12").alias("k"))
    base = base.agg(F.max(F.col("l_quantity").cast("bigint")).alias("q"), F.min("l_orderkey").alias("o")).where("o % 7 <> 0")
    when = f"CASE WHEN y % 2 = 0 THEN {_CONDITION} ELSE {_OTHERWISE} END AS `when`"
    criteria = base.selectExpr("ruleset", "concat(y - 1990, '.0.0') AS version", "'m' AS fact_model", *(f"{v} AS {k}" for k, v in _PARTS.items()), when)
    out = rule_tables.structural_changes(criteria)
    return out.select("ruleset", F.split("version", r"\.")[0].cast("long").alias("major"), "change", "id", "from_id")
