"""SQL building blocks of the oracles: the cohort's facts and verdicts written in plain DuckDB SQL."""

from __future__ import annotations

FACTS = """
o AS (
  SELECT o_custkey AS patient,
         count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '2001-01-01') AS n_recent,
         avg(o_totalprice) FILTER (WHERE o_orderdate >= TIMESTAMP '2001-01-01' AND o_orderstatus = 'F') AS avg_filled,
         count(*) AS n_orders,
         count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_urgent,
         count(*) FILTER (WHERE o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW')) AS n_low,
         min(date_diff('day', o_orderdate::DATE, DATE '2001-08-02')) FILTER (WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'P') AS urgent_days,
         count(*) FILTER (WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P') AS urgent_undated
  FROM orders GROUP BY o_custkey),
r AS (
  SELECT o_custkey AS patient, sum(l_quantity) AS returned_qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '2001-01-01' GROUP BY o_custkey),
f AS (
  SELECT c_custkey AS patient, c_acctbal AS acct_balance, c_mktsegment AS segment, r_name AS region,
         CASE WHEN n_recent > 0 THEN n_recent::DOUBLE END AS recent_orders,
         floor(avg_filled * 100 + 0.5) / 100 AS avg_filled_value, returned_qty,
         CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal > 9000 END AS vip,
         CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN 0 ELSE coalesce(n_orders, 0) END AS n_orders,
         CASE WHEN c_custkey % 10 = 1 THEN 0 ELSE coalesce(n_urgent, 0) END AS n_urgent,
         CASE WHEN c_custkey % 10 = 1 THEN 0 ELSE coalesce(n_low, 0) END AS n_low,
         CASE WHEN c_custkey % 10 <> 1 THEN urgent_days END AS urgent_days,
         CASE WHEN c_custkey % 10 = 1 THEN 0 ELSE coalesce(urgent_undated, 0) END AS urgent_undated
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
       LEFT JOIN o ON o.patient = c_custkey LEFT JOIN r ON r.patient = c_custkey)"""


def within(days: int | str) -> str:
    return f"(CASE WHEN n_orders IS NULL THEN NULL WHEN urgent_days <= {days} THEN TRUE WHEN urgent_undated > 0 THEN NULL ELSE FALSE END)"


def listed(count: str) -> str:
    return f"(CASE WHEN n_orders IS NULL THEN NULL ELSE {count} > 0 END)"


#: Criteria in plain SQL: (id, kind, condition), NULL for one that isn't modeled.
V1 = (
    ("balance-min", "inclusion", "acct_balance >= 0"),
    ("recent-activity", "inclusion", "recent_orders >= 1"),
    ("segment-open", "inclusion", "segment <> 'MACHINERY'"),
    ("urgent-window", "exclusion", within(90)),
    ("filled-max", "exclusion", "avg_filled_value > 200000"),
    ("chart-note", "exclusion", None),
)
V2 = (
    ("recent-activity", "inclusion", "recent_orders >= 1"),
    ("balance-min", "inclusion", "acct_balance >= -500"),
    ("urgent-recent", "exclusion", within(60)),
    ("filled-max", "exclusion", "avg_filled_value > 150000"),
    ("returns-max", "exclusion", "(returned_qty > 60 AND NOT (vip = TRUE))"),
    ("chart-note", "exclusion", None),
)


def verdict(kind: str, cond: str | None) -> str:
    if cond is None:
        return "'unknown'"
    good, bad = ("pass", "fail") if kind == "inclusion" else ("fail", "pass")
    return f"(CASE WHEN {cond} IS NULL THEN 'unknown' WHEN {cond} THEN '{good}' ELSE '{bad}' END)"


def verdicts(criteria: tuple, name: str) -> str:
    """CTEs ``name`` (long: patient, ord, id, kind, unmodeled, verdict) and ``name_o`` (per patient: overall and counters)."""
    rows = " UNION ALL ".join(f"SELECT patient, {i} AS ord, '{cid}' AS id, '{kind}' AS kind, {cond is None} AS unmodeled, {verdict(kind, cond)} AS verdict FROM f" for i, (cid, kind, cond) in enumerate(criteria))
    return f"""
{name} AS ({rows}),
{name}_n AS (
  SELECT patient, count(*) FILTER (WHERE verdict = 'fail') AS n_fail, count(*) FILTER (WHERE verdict = 'unknown' AND NOT unmodeled) AS n_open,
         count(*) FILTER (WHERE verdict = 'unknown' AND unmodeled) AS n_parked, min(ord) FILTER (WHERE verdict = 'fail') AS first_ord,
         bool_and(unmodeled) FILTER (WHERE verdict = 'fail') AS fail_unmodeled
  FROM {name} GROUP BY patient),
{name}_o AS (
  SELECT *, CASE WHEN n_fail > 0 THEN 'ineligible' WHEN n_open + n_parked > 0 THEN 'undetermined' ELSE 'eligible' END AS overall,
         CASE WHEN n_fail > 0 THEN 'screen-fail' WHEN n_open > 0 THEN 'not-evaluable' WHEN n_parked > 0 THEN 'pending-chart-review' ELSE 'potentially-eligible' END AS display_band
  FROM {name}_n)"""


def criteria_values(criteria: tuple) -> str:
    return "(VALUES " + ", ".join(f"({i}, '{c[0]}')" for i, c in enumerate(criteria)) + ") AS c(ord, id)"


def with_v1(body: str) -> str:
    return f"WITH {FACTS}, {verdicts(V1, 'v')} {body}"


def with_both(body: str) -> str:
    return f"WITH {FACTS}, {verdicts(V1, 'v')}, {verdicts(V2, 'w')} {body}"


def zero_filled(values: tuple, column: str, source: str, source_column: str) -> str:
    vals = ", ".join(f"('{v}')" for v in values)
    return f"SELECT d.x AS {column}, count(s.{source_column}) AS n FROM (VALUES {vals}) AS d(x) LEFT JOIN {source} AS s ON s.{source_column} = d.x GROUP BY d.x"
