"""Queries over rule sets: an order with its customer and lines is a record."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import rules as K
from tessera.plans.registry import query, rows, table

RULES = [
    {"rule_id": "k1", "severity": "block", "message": "high value in a blocked segment", "if": {"all": [{"field": "segment", "op": "contains_any", "value": ["BUILDING", "MACHINERY"]}, {"field": "o_totalprice", "op": "greater_than", "value": 300000}]}},
    {"rule_id": "k2", "severity": "warn", "message": "returned lines", "if": {"any": [{"field": "flags", "op": "contains_all", "value": ["A", "R"]}, {"field": "o_orderstatus", "op": "equals", "value": "P"}]}},
    {"rule_id": "k3", "severity": "warn", "message": "cheap", "if": {"not": {"field": "o_totalprice", "op": "greater_than", "value": 50000}}},
    {"rule_id": "k4", "severity": "block", "message": "urgent and cheap", "if": {"all": [{"field": "priority", "op": "contains_any", "value": ["URGENT"]}, {"field": "o_totalprice", "op": "less_than", "value": 100000}]}},
]
RECORDS = """f AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY 1),
rec AS (SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderpriority AS priority, c_mktsegment AS segment, coalesce(flags, []) AS flags FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN f ON l_orderkey = o_orderkey),
hit AS (
  SELECT o_orderkey, 'k1' AS rule_id, 'block' AS severity, 'high value in a blocked segment' AS message FROM rec WHERE segment IN ('BUILDING', 'MACHINERY') AND o_totalprice > 300000
  UNION ALL SELECT o_orderkey, 'k2', 'warn', 'returned lines' FROM rec WHERE list_has_all(flags, ['A', 'R']) OR o_orderstatus = 'P'
  UNION ALL SELECT o_orderkey, 'k3', 'warn', 'cheap' FROM rec WHERE NOT o_totalprice > 50000
  UNION ALL SELECT o_orderkey, 'k4', 'block', 'urgent and cheap' FROM rec WHERE contains(priority, 'URGENT') AND o_totalprice < 100000)"""


def records(spark, sf_dir):
    o, c, li = (table(spark, sf_dir, t) for t in ("orders", "customer", "lineitem"))
    flags = li.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"))
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(flags, o["o_orderkey"] == flags["l_orderkey"], "left")
    return j.select("o_orderkey", "o_totalprice", "o_orderstatus", F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("segment"), "flags")


@query("k1_findings", f"WITH {RECORDS} SELECT * FROM hit")
def k1(spark, sf_dir):
    return K.findings(records(spark, sf_dir), "o_orderkey", RULES)


@query("k2_predicates", r"""
SELECT p_partkey, regexp_matches(lower(p_name), '(^|[^a-z0-9])red([^a-z0-9]|$)') AS whole_word, true AS has_size, p_size < 10 AS small, p_brand IN ('Brand#11', 'Brand#22') AS equal,
  regexp_matches(regexp_replace(lower(p_type), '[_\s-]+', ' ', 'g'), '(^|[^a-z0-9])' || 'economy' || '([^a-z0-9]|$)') AND regexp_matches(lower(p_name), '(^|[^a-z0-9])red([^a-z0-9]|$)') AS both FROM part""")
def k2(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    p = p.withColumn("words", F.array("p_type", "p_name"))
    leaf = lambda f, op, *v: K.predicate(p, {"field": f, "operator": op, "values": list(v)})
    return p.select("p_partkey", leaf("p_name", "contains_any", "Red ").alias("whole_word"), leaf("p_size", "exists").alias("has_size"),
                    leaf("p_size", "less_than", 10).alias("small"), leaf("p_brand", "equals", "brand#11", " Brand#22").alias("equal"),
                    leaf("words", "contains_all", "economy", "red").alias("both"))


@query("k3_context", "SELECT c_custkey, list_sort(list_distinct(list_concat([lower(c_mktsegment)], list(DISTINCT lower(o_orderpriority)) FILTER (o_orderpriority IS NOT NULL))))::VARCHAR AS context FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment")
def k3(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(F.lower("o_orderpriority")).alias("p"))
    j = c.join(o, c["c_custkey"] == o["o_custkey"], "left")
    both = F.array_sort(F.array_union(F.array(F.lower("c_mktsegment")), F.coalesce("p", F.array().cast("array<string>"))))
    return j.select("c_custkey", F.concat(F.lit("["), F.array_join(both, ", "), F.lit("]")).alias("context"))


CONTEXT_ALIASES = [("goods", "building", "Building"), ("goods", "machine", "machinery"), ("goods", "house", "house"), ("goods", "house", "furniture"), ("goods", "car", "auto")]


@query("k3_built_context", """
WITH c AS (SELECT c_custkey, lower('Buys ' || c_mktsegment) AS t, c_custkey % 100 AS age FROM customer),
n AS (SELECT c_custkey, 'goods' AS kind, name FROM c JOIN (VALUES ('building', 'building'), ('machine', 'machinery'), ('house', 'house'), ('house', 'furniture'), ('car', 'auto')) a(name, alias) ON contains(t, alias)
  UNION SELECT o_custkey, 'priorities', lower(trim(o_orderpriority)) FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer)
  UNION SELECT c_custkey, 'populations', 'child' FROM c WHERE age < 18 UNION SELECT c_custkey, 'populations', 'older_adult' FROM c WHERE age >= 65
  UNION SELECT c_custkey, 'populations', 'pregnancy' FROM c WHERE c_custkey % 7 = 0)
SELECT c_custkey, kind, string_agg(name, ', ' ORDER BY name) AS names FROM n GROUP BY c_custkey, kind""")
def k3_built(spark, sf_dir):
    """Of what customers buy, the priorities of their finished orders, and their age."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Buys "), "c_mktsegment").alias("said"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit("priorities").alias("kind"), F.col("o_orderpriority").alias("name"), F.when(F.col("o_orderstatus") == "F", "active").otherwise("done").alias("status"))
    o = o.join(c.select("c_custkey"), "c_custkey", "left_semi")
    aliases = rows(spark, "kind string, name string, alias string", CONTEXT_ALIASES)
    sex = F.when(F.col("c_custkey") % 7 == 0, "Pregnant").otherwise("none")
    found = K.build_context(c, "c_custkey", "said", aliases, o, F.col("c_custkey") % 100, sex)
    return found.select("c_custkey", "kind", F.array_join("names", ", ").alias("names"))


@query("k4_proximity", "SELECT doc_id, regexp_matches(text, '(?s)the.{0,12}tion|tion.{0,12}the') AS near FROM documents")
def k4(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", K.near(F.col("text"), "the", "tion").alias("near"))


@query("k5_decisions", f"""
WITH {RECORDS}, b AS (SELECT o_orderkey, bool_or(severity = 'block') AS blocked FROM hit GROUP BY 1),
x AS (SELECT hit.o_orderkey, blocked, message, row_number() OVER (PARTITION BY hit.o_orderkey ORDER BY rule_id) AS n FROM hit JOIN b ON hit.o_orderkey = b.o_orderkey WHERE severity = 'block' OR NOT blocked)
SELECT o_orderkey, blocked, string_agg(message, '; ' ORDER BY n) AS messages FROM x WHERE NOT blocked OR n <= 2 GROUP BY 1, 2""")
def k5(spark, sf_dir):
    d = K.decisions(K.findings(records(spark, sf_dir), "o_orderkey", RULES), "o_orderkey")
    return d.withColumn("messages", F.array_join("messages", "; "))


@query("k6_rule_drafts", r"""
WITH s AS (SELECT p_partkey // 500 AS source, row_number() OVER (PARTITION BY p_partkey // 500 ORDER BY p_partkey) AS n, * FROM part)
SELECT source, CASE WHEN p_size % 2 = 0 THEN 'DRAFT_' || source || '_' || n ELSE trim(regexp_replace(upper(p_brand || ' ' || p_name), '[^A-Z0-9_]+', '_', 'g'), '_') END AS rule_id,
  CASE WHEN p_size % 3 = 0 THEN 'warn' ELSE 'block' END AS severity, coalesce(p_type, 'draft_clinical_nutrition') AS category, source::VARCHAR AS cited, 'draft_needs_review' AS review_status FROM s""")
def k6(spark, sf_dir):
    """Parts as rules of sources of 500, every second without an id, every third without a severity."""
    p = table(spark, sf_dir, "part").select(
        F.floor(F.col("p_partkey") / 500).alias("source"), "p_partkey", F.when(F.col("p_size") % 2 != 0, F.concat_ws(" ", "p_brand", "p_name")).alias("rule_id"),
        F.when(F.col("p_size") % 3 != 0, "block").alias("severity"), F.col("p_type").alias("category"), F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("struct<action:string,message:string,recommendation:string>").alias("then"), F.lit(None).cast("struct<source_title:string,evidence_level:string>").alias("evidence"))
    d = K.rule_drafts(p, "source", "p_partkey")
    return d.select("source", "rule_id", "severity", "category", F.col("evidence.source_title").alias("cited"), "review_status")


@query("k7_review_decision", """
WITH s AS (SELECT o_orderkey, regexp_replace(o_orderpriority, '[\\s,.!?:;]+', '', 'g') AS t FROM orders)
SELECT o_orderkey, CASE WHEN contains(t, 'NOT') THEN 'reject' WHEN contains(t, 'SPEC') OR contains(t, 'HIGH') OR contains(t, 'URGENT') THEN 'accept' END AS decision FROM s""".replace("\\\\", "\\"))
def k7(spark, sf_dir):
    """The priorities of orders as replies."""
    decision = K.review_decision(F.col("o_orderpriority"), [*K.REJECTS, "NOT"], [*K.ACCEPTS, "SPEC", "HIGH", "URGENT"])
    return table(spark, sf_dir, "orders").select("o_orderkey", decision.alias("decision"))
