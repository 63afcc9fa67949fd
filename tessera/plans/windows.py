"""Queries over windowed states."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import windows as W
from tessera.operators.documents import page_ranges, pages_of, top_per_key
from tessera.plans.documents import PAGES
from tessera.plans.registry import query, table


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("w1_top_per_key", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts, event_id) AS n FROM events) WHERE n <= 3")
def w1(spark, sf_dir):
    return top_per_key(events(spark, sf_dir), ["user_id"], [F.col("value").desc(), "ts", "event_id"], 3).select("user_id", "event_id")


@query("w2_running_state", """
SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER w AS last_purchase, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS clicks FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def w2(spark, sf_dir):
    order = ["ts", "event_id"]
    clicks = W.recent_count(F.col("event_type") == "click", ["user_id"], order, 1 << 30)
    return events(spark, sf_dir).select("user_id", "event_id", W.carried(F.when(F.col("event_type") == "purchase", F.col("event_id")), ["user_id"], order).alias("last_purchase"), clicks.cast("long").alias("clicks"))


@query("w3_sliding_count", "SELECT event_id, CAST(sum((value > 50)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING) AS BIGINT) AS recent FROM events")
def w3(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", W.recent_count(F.col("value") > 50, ["user_id"], ["ts", "event_id"], 5).cast("long").alias("recent"))


@query("w4_islands", f"""
WITH {PAGES}, k AS (SELECT doc_id, page FROM pg WHERE page % 4 <> 0), i AS (SELECT doc_id, page, page - row_number() OVER (PARTITION BY doc_id ORDER BY page) AS i FROM k)
SELECT doc_id, min(page) AS first, max(page) AS last FROM i GROUP BY doc_id, i""")
def w4(spark, sf_dir):
    return page_ranges(pages_of(table(spark, sf_dir, "documents").select("doc_id", "text")).filter("page % 4 <> 0"))


@query("w5_set_operations", """
SELECT 'union' AS op, count(*) AS n FROM (SELECT l_partkey FROM lineitem UNION SELECT p_partkey FROM part) UNION ALL SELECT 'except', count(*) FROM (SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45)
UNION ALL SELECT 'first_seen', count(*) FROM (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem)""")
def w5(spark, sf_dir):
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    ids = p.select(F.col("p_partkey").alias("k"))
    union = li.select(F.col("l_partkey").alias("k")).union(ids).distinct()
    rest = ids.join(li.filter("l_quantity > 45").select(F.col("l_partkey").alias("k")).distinct(), "k", "left_anti").distinct()
    seen = W.first_seen(li, ["l_suppkey", "l_returnflag"], ["l_shipdate", "l_orderkey"])
    count = lambda df, op: df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return count(union, "union").unionByName(count(rest, "except")).unionByName(count(seen, "first_seen"))


@query("w6_string_aggregation", "SELECT p_brand, string_agg(DISTINCT p_type, '; ' ORDER BY p_type) AS types FROM part GROUP BY p_brand")
def w6(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), "; ").alias("types"))


@query("x1_activity", """
WITH v AS (SELECT *, coalesce(last_value(CASE WHEN value >= 60 THEN 1 WHEN value <= 20 THEN 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS voice FROM events),
a AS (SELECT *, sum(voice) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING) >= 2 AS active, floor(epoch(ts))::BIGINT AS s FROM v),
l AS (SELECT *, last_value(CASE WHEN active THEN s END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM a),
o AS (SELECT *, sum(CASE WHEN active AND (before IS NULL OR s - before > 36000) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seg FROM l)
SELECT event_id, voice, active, CASE WHEN active THEN CAST(seg AS BIGINT) END AS segment FROM o""")
def x1(spark, sf_dir):
    return W.activity(events(spark, sf_dir), "user_id", "ts", "value", 60, 20, 3, 2, 36000).select("event_id", "voice", "active", "segment")


@query("x2_idle_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS o FROM events),
s AS (SELECT user_id, ts, sum(o) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS started, count(*) AS n FROM s GROUP BY user_id, s""")
def x2(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.unix_timestamp("w.start").alias("started"), "n")


@query("x4_daily_quota", "SELECT user_id, CAST(floor(epoch(date_trunc('day', ts))) AS BIGINT) AS day, CAST(sum(length(props)) AS BIGINT) AS used, sum(length(props)) > 20 AS over FROM events GROUP BY 1, 2")
def x4(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    d = e.groupBy("user_id", F.window("ts", "1 day").alias("w")).agg(F.sum(F.length("props")).alias("used"))
    return d.select("user_id", F.unix_timestamp("w.start").alias("day"), "used", (F.col("used") > 20).alias("over"))
