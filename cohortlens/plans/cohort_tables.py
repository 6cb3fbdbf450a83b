"""A cohort of customers as a typed wide table of facts, and rule sets over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.facts import round_half_up
from cohortlens.model import FactDecl, FactModel, RuleSet
from cohortlens.sources.documents import parse_ruleset

AS_OF, SINCE = "2001-08-02", "2001-01-01"

MODEL = FactModel(
    "customer-facts/v1",
    {
        "acct_balance": FactDecl("number"),
        "recent_orders": FactDecl("number"),
        "avg_filled_value": FactDecl("number"),
        "returned_qty": FactDecl("number"),
        "segment": FactDecl("enum", values=("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")),
        "region": FactDecl("enum", values=("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")),
        "vip": FactDecl("boolean"),
        "orders": FactDecl("code", systems=("priority",)),
    },
)

V1: RuleSet = parse_ruleset("""
ruleset: credit-review
rulesetVersion: 1.0.0
factModel: customer-facts/v1
status: active
criteria:
  - {id: balance-min, ref: I1, kind: inclusion, verbatim: Account balance not negative, when: {fact: acct_balance, op: gte, value: 0}}
  - {id: recent-activity, ref: I2, kind: inclusion, verbatim: An order this year, when: {fact: recent_orders, op: gte, value: 1}}
  - {id: segment-open, ref: I3, kind: inclusion, verbatim: Not in machinery, when: {fact: segment, op: neq, value: MACHINERY}}
  - {id: urgent-window, ref: E1, kind: exclusion, verbatim: Urgent order within 90 days, when: {fact: orders, op: anyWithin, codes: {system: priority, values: [1-URGENT]}, windowDays: 90}}
  - {id: filled-max, ref: E2, kind: exclusion, verbatim: Filled orders over 200000 on average, when: {fact: avg_filled_value, op: gt, value: 200000}}
  - {id: chart-note, ref: E3, kind: exclusion, verbatim: Reviewer objects, unmodeled: true}
""")

V2: RuleSet = parse_ruleset("""
ruleset: credit-review
rulesetVersion: 2.0.0
factModel: customer-facts/v1
status: draft
criteria:
  - {id: recent-activity, ref: I2, kind: inclusion, verbatim: An order this year, when: {fact: recent_orders, op: gte, value: 1}}
  - {id: balance-min, ref: I1, kind: inclusion, verbatim: Account balance over -500, when: {fact: acct_balance, op: gte, value: -500}}
  - {id: urgent-recent, ref: E1, kind: exclusion, verbatim: Urgent order within 60 days, when: {fact: orders, op: anyWithin, codes: {system: priority, values: [1-URGENT]}, windowDays: 60}}
  - {id: filled-max, ref: E2, kind: exclusion, verbatim: Filled orders over 150000 on average, when: {fact: avg_filled_value, op: gt, value: 150000}}
  - {id: returns-max, ref: E4, kind: exclusion, verbatim: More than 60 items returned, when: {all: [{fact: returned_qty, op: gt, value: 60}, {not: {fact: vip, op: eq, value: true}}]}}
  - {id: chart-note, ref: E3, kind: exclusion, verbatim: Reviewer objects, unmodeled: true}
""")


def facts_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(patient, facts …): one row per customer.

    Orders and line items are aggregated by their customer before they meet the customers, so the
    joins are of one row per customer; nation and region go by Spark's own size check.  An absent
    list of orders stays NULL (unknown), a customer with none has an empty one.
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    since = F.lit(SINCE).cast("timestamp")
    o = read("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    recent = F.col("o_orderdate") >= since
    undated = F.col("o_orderstatus") == "P"
    days = F.when(~undated, F.datediff(F.lit(AS_OF).cast("date"), F.col("o_orderdate").cast("date")))
    per_order = o.groupBy(F.col("o_custkey").alias("patient")).agg(
        F.sum(recent.cast("long")).alias("n_recent"),
        F.avg(F.when(recent & (F.col("o_orderstatus") == "F"), F.col("o_totalprice"))).alias("avg_filled"),
        F.collect_list(F.struct(F.col("o_orderpriority").alias("code"), F.lit("priority").alias("system"), days.cast("int").alias("daysAgo"))).alias("listed"),
    )
    l = read("lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_shipdate") >= since)).groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))  # noqa: E741
    returned = l.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("patient")).agg(F.sum("q").alias("returned_qty"))
    home = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("region"))
    c = read("customer").select(F.col("c_custkey").alias("patient"), F.col("c_acctbal").alias("acct_balance"), F.col("c_mktsegment").alias("segment"), "c_nationkey")
    j = c.join(home, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(per_order, "patient", "left").join(returned, "patient", "left")
    empty = F.array().cast("array<struct<code:string,system:string,daysAgo:int>>")
    orders = F.when(F.col("patient") % 10 == 0, F.lit(None)).when(F.col("patient") % 10 == 1, empty).otherwise(F.coalesce("listed", empty))
    return j.select(
        "patient", "acct_balance", "segment", "region",
        F.when(F.col("n_recent") > 0, F.col("n_recent").cast("double")).alias("recent_orders"),
        round_half_up(F.col("avg_filled")).alias("avg_filled_value"),
        "returned_qty", orders.alias("orders"),
        F.when(F.col("patient") % 7 != 0, F.col("acct_balance") > 9000).alias("vip"),
    )
