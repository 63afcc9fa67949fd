"""Queries over personal records: events are readings, orders and customers give scalars, texts are composed and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import grams as G
from tessera.operators import records as P
from tessera.plans.registry import query, rows, table


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def customers(spark, sf_dir):
    return table(spark, sf_dir, "customer")


@query("p1_scalars", """
SELECT c_custkey, CASE WHEN c_custkey % 150 BETWEEN 1 AND 120 THEN (c_custkey % 150)::DOUBLE END AS age, 150.0 + c_custkey % 40 AS height, CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS sex FROM customer""")
def p1(spark, sf_dir):
    k = F.col("c_custkey")
    said = F.concat(F.lit("I am "), k % 150, F.lit(" years old, "), F.when(k % 2 == 0, "male").otherwise("female"), F.lit(", height: "), (150 + k % 40), F.lit(" cm"))
    return customers(spark, sf_dir).select("c_custkey", P.guarded(said, r"am (\d+) years", 1, 120).alias("age"), P.guarded(said, r"height: (\d+)", 80, 250).alias("height"), F.regexp_extract(said, r"\b(male|female)\b", 1).alias("sex"))


@query("p2_entities", """
WITH s AS (SELECT c_custkey, 'has ' || c_mktsegment || ' and BUILDING works' AS t FROM customer)
SELECT c_custkey, 'segment:' || lower(c_mktsegment) AS name FROM customer UNION SELECT c_custkey, 'segment:building' FROM customer UNION SELECT c_custkey, 'work' FROM customer WHERE false""")
def p2(spark, sf_dir):
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    vocabulary = rows(spark, "alias string, name string, generic_of string", [(s, f"segment:{s.lower()}", "work") for s in segments] + [("works", "work", None)])
    said = F.concat(F.lit("has "), "c_mktsegment", F.lit(" and BUILDING works"))
    return P.entities(customers(spark, sf_dir).select("c_custkey", said.alias("t")), vocabulary, "c_custkey", "t").select("c_custkey", "name")


@query("p2_dictionary", r"""
WITH w AS (SELECT DISTINCT regexp_extract_all(lower(text), '[a-z]{4,}') AS w FROM benchmark), u AS (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM w),
a AS (SELECT w[i] AS alias FROM u UNION SELECT w[i] || ' ' || w[i + 1] FROM u WHERE i < len(w)),
f AS (SELECT doc_id, alias, string_split(lower(text), alias) AS p FROM documents JOIN a ON contains(lower(text), alias)),
o AS (SELECT doc_id, alias, list_sum([length(x) for x in p[1:i]]) + (i - 1) * length(alias) AS start FROM (SELECT *, unnest(range(1, len(p))) AS i FROM f)),
m AS (SELECT *, start + length(alias) AS stop, max(start + length(alias)) OVER (PARTITION BY doc_id ORDER BY start, length(alias) DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o)
SELECT doc_id, alias, count(*) AS n, CAST(min(start) AS BIGINT) AS first FROM m WHERE reach IS NULL OR reach < stop GROUP BY doc_id, alias""")
def p2_dictionary(spark, sf_dir):
    """Words of four letters or more, and pairs of neighbours among them, of the benchmark as a dictionary over the documents;
    a match inside a longer one goes."""
    w = table(spark, sf_dir, "benchmark").select(T.matches(F.lower("text"), "[a-z]{4,}").alias("w"))
    pairs = F.transform(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get("w", i + 1)))
    aliases = w.select(F.explode(F.concat("w", pairs)).alias("alias")).distinct()
    found = G.dictionary_matches(table(spark, sf_dir, "documents").select("doc_id", "text"), aliases, "doc_id")
    return found.groupBy("doc_id", "alias").agg(F.count("*").alias("n"), F.min("start").cast("long").alias("first"))


@query("p3_metrics", "SELECT event_id, 'egfr' AS name, CAST(user_id AS DOUBLE) AS value, 'ml/min' AS unit FROM events UNION ALL SELECT event_id, 'hba1c', 6.5, '%' FROM events")
def p3(spark, sf_dir):
    said = F.concat(F.lit("egfr "), F.col("user_id"), F.lit(" ml/min, hba1c: 6.5%"))
    return events(spark, sf_dir).select("event_id", F.explode(P.metrics(said, ["egfr", "hba1c"])).alias("m")).select("event_id", "m.*")


@query("p4_readings", """
WITH r AS (SELECT event_id, 'fasting' AS kind, '' AS meal, floor(value) AS value, ts::DATE AS day, NULL::TIMESTAMP AS observed FROM events
  UNION ALL SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'post_meal' ELSE 'pre_meal' END, 'dinner', CAST(5 + user_id % 40 AS DOUBLE), ts::DATE - 1, ts::DATE - INTERVAL 1 DAY + to_hours(12 + event_id % 12) + to_minutes(event_id % 60) FROM events)
SELECT event_id, kind, meal, value, CAST(day AS VARCHAR) AS "on", CAST(observed AS VARCHAR) AS observed FROM r WHERE value BETWEEN 1 AND 35""")
def p4(spark, sf_dir):
    """Two clauses for each event, its value and its user's, with times of day of its id."""
    e = F.col("event_id")
    said = F.concat(F.lit("fasting "), F.floor("value"), F.lit(" mmol, 昨天 下午"), F.when(e % 12 == 0, 12).otherwise(e % 12), F.lit(":"), e % 60,
                    F.when(F.col("user_id") % 2 == 0, " after").otherwise(" before"), F.lit(" dinner "), (5 + F.col("user_id") % 40) * 18, F.lit(" mg/dL; pulse 70"))
    r = events(spark, sf_dir).select("event_id", F.explode(P.readings(said, F.col("ts"))).alias("r"))
    return r.select("event_id", "r.kind", "r.meal", "r.value", F.col("r.on").cast("string").alias("on"), F.col("r.at").cast("string").alias("observed"))


@query("p5_update_merge", """
WITH k AS (SELECT user_id, event_type, date_trunc('minute', ts) AS m, round(value, 1) AS v, min(event_id) AS e FROM events GROUP BY 1, 2, 3, 4)
SELECT user_id, event_type, count(*) AS readings, max_by(v, e) AS last_value FROM k GROUP BY 1, 2""")
def p5(spark, sf_dir):
    once = events(spark, sf_dir).groupBy("user_id", "event_type", F.date_trunc("minute", "ts").alias("m"), F.round("value", 1).alias("v")).agg(F.min("event_id").alias("e"))
    return once.groupBy("user_id", "event_type").agg(F.count("*").alias("readings"), F.max_by("v", "e").alias("last_value"))


@query("p6_scalar_merge", """
WITH c AS (SELECT c_custkey AS user_id, 50.0::DOUBLE + c_custkey % 40 AS now FROM customer WHERE c_custkey % 5 <> 0), p AS (SELECT c_custkey AS user_id, 50.0::DOUBLE + c_custkey % 40 + c_custkey % 6 AS new FROM customer WHERE c_custkey % 7 <> 0)
SELECT coalesce(c.user_id, p.user_id) AS user_id, 'weight_kg' AS field, CASE WHEN abs(now - new) >= 3 THEN now ELSE coalesce(new, now) END AS value, CASE WHEN new IS NULL THEN 'kept' WHEN abs(now - new) >= 3 THEN 'review' ELSE 'accepted' END AS verdict FROM c FULL JOIN p ON c.user_id = p.user_id""")
def p6(spark, sf_dir):
    k = F.col("c_custkey")
    c = customers(spark, sf_dir)
    current = c.filter(k % 5 != 0).select(k.alias("user_id"), F.lit("weight_kg").alias("field"), (50.0 + k % 40).alias("value"))
    proposed = c.filter(k % 7 != 0).select(k.alias("user_id"), F.lit("weight_kg").alias("field"), (50.0 + k % 40 + k % 6).alias("value"))
    return P.merge_scalars(current, proposed, ["user_id", "field"])


@query("p7_item_merge", """
WITH a AS (SELECT o_custkey AS user_id, o_orderpriority AS name, CAST(min(o_orderkey) AS VARCHAR) AS old FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2), b AS (SELECT o_custkey AS user_id, o_orderpriority AS name, CAST(max(o_orderkey) AS VARCHAR) AS new FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1, 2),
n AS (SELECT DISTINCT o_custkey AS user_id, o_orderpriority AS name FROM orders WHERE o_orderstatus = 'P')
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.name, b.name) AS name, concat_ws(' | ', old, new) AS evidence, n.user_id IS NOT NULL AS conflict
FROM a FULL JOIN b ON a.user_id = b.user_id AND a.name = b.name LEFT JOIN n ON n.user_id = coalesce(a.user_id, b.user_id) AND n.name = coalesce(a.name, b.name)""")
def p7(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "user_id").withColumnRenamed("o_orderpriority", "name")
    old = o.filter("o_orderkey % 2 = 0").groupBy("user_id", "name").agg(F.min("o_orderkey").cast("string").alias("evidence"))
    new = o.filter("o_orderkey % 2 = 1").groupBy("user_id", "name").agg(F.max("o_orderkey").cast("string").alias("evidence"))
    return P.merge_items(old, new, o.filter("o_orderstatus = 'P'").select("user_id", "name"), ["user_id", "name"])


@query("p8_review_replay", """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS value, CASE c_custkey % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'pending' END AS state FROM customer""")
def p8(spark, sf_dir):
    c = customers(spark, sf_dir)
    decisions = c.filter("c_custkey % 3 < 2").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "accept").otherwise("reject").alias("decision"))
    return P.resolve(c.select("c_custkey", F.col("c_acctbal").alias("now"), (F.col("c_acctbal") + 1).alias("new")), decisions, "c_custkey")


@query("p9_bmi", "SELECT c_custkey, round((50.0 + c_custkey % 45)::DOUBLE / pow((150.0 + c_custkey % 40)::DOUBLE / 100, 2), 4) AS bmi FROM customer")
def p9(spark, sf_dir):
    k = F.col("c_custkey")
    return customers(spark, sf_dir).select("c_custkey", F.round(P.bmi(50.0 + k % 45, 150.0 + k % 40), 4).alias("bmi"))




def newest():
    return [F.col("ts").desc(), F.col("event_id").desc()]


@query("p10_latest_readings", "SELECT user_id, event_id, value, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE value BETWEEN 1 AND 300) WHERE n <= 5")
def p10(spark, sf_dir):
    r = P.latest(events(spark, sf_dir).filter(F.col("value").between(1, 300)), ["user_id"], newest(), 5)
    return r.select("user_id", "event_id", "value", F.col("n").cast("long").alias("n"))


@query("p11_type_stats", "SELECT user_id, event_type, count(*) AS n, min(value) AS least, max(value) AS most, sum(CAST(value AS DECIMAL(18,4)))::DOUBLE / count(*) AS mean, max_by(value, (ts, event_id)) AS latest FROM events GROUP BY 1, 2")
def p11(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("at", F.struct("ts", "event_id"))
    return P.type_stats(e, ["user_id", "event_type"], "value", "at")


@query("p12_level_alerts", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events),
l AS (SELECT user_id, event_id, n, CASE WHEN value < 3 THEN 'severe_low' WHEN value <= 6 THEN 'low' WHEN value >= 200 THEN 'very_high' WHEN value > 80 THEN 'above_target' END AS code FROM r WHERE n <= 8)
SELECT user_id, event_id, code FROM l WHERE code IS NOT NULL AND (n = 1 OR code <> 'above_target')""")
def p12(spark, sf_dir):
    r = P.latest(events(spark, sf_dir), ["user_id"], newest(), 8).withColumn("code", P.level(F.col("value"), F.lit(80.0), 6, 3, 200))
    return r.filter("code is not null and (n = 1 or code <> 'above_target')").select("user_id", "event_id", "code")


@query("p13_repeated_high", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT user_id, event_type FROM r WHERE n <= 3 GROUP BY 1, 2 HAVING count(*) = 3 AND min(value) > 30""")
def p13(spark, sf_dir):
    r = P.latest(events(spark, sf_dir), ["user_id", "event_type"], newest(), 3)
    return r.groupBy("user_id", "event_type").agg(F.count("*").alias("c"), F.min("value").alias("m")).filter("c = 3 and m > 30").select("user_id", "event_type")


@query("p14_alerts", """
WITH g AS (SELECT *, CASE event_type WHEN 'click' THEN 60.0 WHEN 'view' THEN 50.0 ELSE NULL END AS target FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS m FROM g),
l AS (SELECT user_id, n AS pos, CASE WHEN value < 3 THEN 'severe_low' WHEN value <= 6 THEN 'low' WHEN value >= 200 THEN 'very_high' WHEN value > target THEN 'above_target' END AS code, event_type AS kind FROM r WHERE n <= 8),
a AS (SELECT * FROM l WHERE code IS NOT NULL AND (pos = 1 OR code <> 'above_target') UNION ALL SELECT user_id, 100, 'repeated_high', event_type FROM r WHERE m <= 3 GROUP BY user_id, event_type HAVING count(*) = 3 AND min(value - target) > 0),
o AS (SELECT user_id, code, kind, min(pos) AS pos FROM a GROUP BY 1, 2, 3), p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY pos, code, kind) AS place, code, kind FROM o) SELECT * FROM p WHERE place <= 5""")
def p14(spark, sf_dir):
    a = P.alerts(events(spark, sf_dir), "user_id", "event_type", "value", newest(), {"click": 60.0, "view": 50.0}, 6, 3, 200)
    return a.withColumn("place", F.col("place").cast("long"))


@query("p15_profiles", """
WITH o AS (SELECT o_custkey, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS s, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS items FROM orders GROUP BY 1)
SELECT c_custkey, c_mktsegment, coalesce(n, 0) AS n_items, items, s::DOUBLE AS total FROM customer LEFT JOIN o ON c_custkey = o_custkey""")
def p15(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey"))).alias("i"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("s"))
    j = customers(spark, sf_dir).join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select("c_custkey", "c_mktsegment", F.coalesce(F.when(F.col("i").isNotNull(), F.size("i")), F.lit(0)).cast("long").alias("n_items"),
                    F.array_join(F.transform("i", lambda x: x["o_orderkey"].cast("string")), ",").alias("items"), F.col("s").cast("double").alias("total"))


@query("p16_roster", """
WITH a AS (SELECT user_id AS "user", count(*) AS n, max(ts) AS newest, 'events' AS source FROM events GROUP BY 1 UNION ALL SELECT o_custkey, count(*), max(o_orderdate), 'orders' FROM orders GROUP BY 1)
SELECT "user", string_agg(source, ',' ORDER BY source) AS sources, CAST(sum(n) AS BIGINT) AS total, CAST(max(newest) AS DATE)::VARCHAR AS newest FROM a GROUP BY 1""")
def p16(spark, sf_dir):
    r = P.roster({"events": (events(spark, sf_dir), "user_id", "ts"), "orders": (table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate")})
    return r.withColumn("newest", F.to_date("newest").cast("string"))
