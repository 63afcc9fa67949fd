"""Queries over conversation memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import memory as M
from tessera.plans.registry import query, table


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


@query("m1_messages", "SELECT conv_id, turn, role, md5(trim(text)) AS text_md5 FROM conversations WHERE role <> 'system' AND trim(text) <> ''")
def m1(spark, sf_dir):
    t = turns(spark, sf_dir)
    wrapped = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.col("text").alias("content")))).otherwise(F.col("text"))
    return M.messages(t.withColumn("text", wrapped)).select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query("m2_last_turns", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4")
def m2(spark, sf_dir):
    return M.last_turns(turns(spark, sf_dir), 4).select("conv_id", "turn")


@query("m3_trimmed_history", """
WITH t AS (SELECT *, count(*) OVER w AS n, sum(CASE WHEN role <> 'system' THEN 1 ELSE 0 END) OVER w AS talk, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS u FROM conversations WINDOW w AS (PARTITION BY conv_id))
SELECT conv_id, turn, role FROM t WHERE n <= 5 OR talk <= 4 OR role = 'system' OR u < 2 OR (u = 2 AND role = 'user')""")
def m3(spark, sf_dir):
    return M.trimmed_history(turns(spark, sf_dir), 2).select("conv_id", "turn", "role")


@query("m4_compaction", """
WITH t AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations)
SELECT conv_id, turn, CASE WHEN n <= 6 OR r <= 3 THEN 'kept' ELSE 'to_summarise' END AS part FROM t""")
def m4(spark, sf_dir):
    return M.compaction(turns(spark, sf_dir), 6, 3).select("conv_id", "turn", "part")


@query("m5_rule_summary", r"""
WITH a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS m FROM a WHERE n <= 24 AND (role = 'user' OR regexp_matches(lower(text), 'tion|ung'))),
s AS (SELECT conv_id, string_agg(role || ': ' || substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 180), chr(10) ORDER BY turn) AS s FROM b WHERE m <= 12 GROUP BY conv_id)
SELECT conv_id, md5(substr(s, 1, 2000)) AS summary_md5 FROM s""")
def m5(spark, sf_dir):
    return M.rule_summary(turns(spark, sf_dir), ["tion", "ung"]).select("conv_id", F.md5("summary").alias("summary_md5"))


@query("m6_extraction", r"""
WITH t AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, role) AS text FROM conversations GROUP BY 1),
x AS (SELECT conv_id, 'medicine' AS attribute, unnest(regexp_extract_all(text, '\b(th\w+tion)\b', 1)) AS value FROM t UNION ALL SELECT conv_id, 'advice', unnest(regexp_extract_all(text, '\b(on\w+ing)\b', 1)) FROM t)
SELECT DISTINCT conv_id, attribute, value FROM x""")
def m6(spark, sf_dir):
    joined = F.array_join(F.array_sort(F.collect_list(F.struct("turn", "role", "text")))["text"], "\n")
    t = turns(spark, sf_dir).groupBy("conv_id").agg(joined.alias("text"))
    return M.extracted(t, {"medicine": r"\b(th\w+tion)\b", "advice": r"\b(on\w+ing)\b"})


LAYER = "CASE l_returnflag WHEN 'A' THEN 'factual' WHEN 'N' THEN 'semantic' ELSE 'episodic' END"


def layer():
    return F.when(F.col("l_returnflag") == "A", "factual").when(F.col("l_returnflag") == "N", "semantic").otherwise("episodic")


@query("m7_weights", f"SELECT l_orderkey, l_linenumber, l_discount, CASE {LAYER} WHEN 'factual' THEN 1.0 WHEN 'semantic' THEN greatest(l_discount, 0.2) ELSE greatest(l_discount, 0.15) END AS weight FROM lineitem")
def m7(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", M.prepared_weight(layer(), F.col("l_discount")).alias("weight"))


@query("m8_upsert", """
WITH o AS (SELECT o_custkey AS user_id, o_orderpriority AS dedupe_key, CASE WHEN o_custkey % 2 = 0 THEN 'factual' ELSE 'semantic' END AS layer, o_orderkey, o_orderstatus FROM orders),
a AS (SELECT user_id, dedupe_key, layer, min_by(o_orderstatus, o_orderkey) AS value, CAST(min(o_orderkey) AS VARCHAR) AS evidence FROM o WHERE o_orderkey % 2 = 0 GROUP BY 1, 2, 3),
b AS (SELECT user_id, dedupe_key, layer, max_by(o_orderstatus, o_orderkey) AS new, CAST(max(o_orderkey) AS VARCHAR) AS more FROM o WHERE o_orderkey % 2 = 1 GROUP BY 1, 2, 3)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.dedupe_key, b.dedupe_key) AS dedupe_key, coalesce(a.layer, b.layer) AS layer,
  CASE WHEN coalesce(a.layer, b.layer) = 'factual' AND value IS NOT NULL THEN value ELSE coalesce(new, value) END AS value, concat_ws(',', evidence, more) AS evidence,
  CASE WHEN a.layer = 'factual' AND new <> value THEN new END AS conflict FROM a FULL JOIN b ON a.user_id = b.user_id AND a.dedupe_key = b.dedupe_key""")
def m8(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("dedupe_key"), F.when(F.col("o_custkey") % 2 == 0, "factual").otherwise("semantic").alias("layer"), "o_orderkey", "o_orderstatus")
    keys = ["user_id", "dedupe_key", "layer"]
    old = o.filter("o_orderkey % 2 = 0").groupBy(*keys).agg(F.min_by("o_orderstatus", "o_orderkey").alias("value"), F.array(F.min("o_orderkey").cast("string")).alias("evidence"))
    new = o.filter("o_orderkey % 2 = 1").groupBy(*keys).agg(F.max_by("o_orderstatus", "o_orderkey").alias("value"), F.array(F.max("o_orderkey").cast("string")).alias("evidence"), F.max("o_orderkey").alias("ts"))
    return M.upsert_memories(old, new).withColumn("evidence", F.array_join("evidence", ","))


@query("m9_decay", """
SELECT o_orderkey, round(greatest(0.08, (o_orderkey % 100) / 100.0 * exp(-ln(2.0) * greatest(date_diff('day', o_orderdate::DATE, DATE '2002-01-01'), 0) / CASE WHEN o_orderkey % 2 = 0 THEN 90.0 ELSE 1400.0 END)), 6) AS weight FROM orders""")
def m9(spark, sf_dir):
    age = F.datediff(F.lit("2002-01-01").cast("date"), F.to_date("o_orderdate")).cast("double")
    half = F.when(F.col("o_orderkey") % 2 == 0, 90.0).otherwise(1400.0)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(M.decayed((F.col("o_orderkey") % 100) / 100.0, age, half), 6).alias("weight"))


@query("m10_promotion", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events), k AS (SELECT * FROM r WHERE n <= 40 AND ts >= TIMESTAMP '2024-01-28' - INTERVAL 20 DAY),
g AS (SELECT user_id, event_type AS attribute, count(*) AS n, list(CAST(value AS VARCHAR) ORDER BY n) AS v FROM k GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT user_id, attribute, n, round(least(0.92, 0.65 + 0.05 * n), 4)::DOUBLE AS weight, array_to_string(v[1:3], '; ') AS value FROM g""")
def m10(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("attribute"), F.col("value").cast("string").alias("value"))
    return M.promoted(e, "2024-01-28", 20)


@query("m11_recent_by_layer", f"""
WITH r AS (SELECT l_suppkey, {LAYER} AS layer, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey) AS n FROM lineitem)
SELECT l_suppkey, layer, l_orderkey FROM r WHERE n <= 3 AND l_suppkey <> 7""")
def m11(spark, sf_dir):
    from tessera.operators.documents import top_per_key

    li = table(spark, sf_dir, "lineitem").filter("l_suppkey <> 7").withColumn("layer", layer())
    return top_per_key(li, ["l_suppkey", "layer"], [F.col("l_shipdate").desc(), "l_orderkey", "l_linenumber", "l_partkey"], 3).select("l_suppkey", "layer", "l_orderkey")


@query("m12_sessions", """
SELECT conv_id, substr(min_by(text, turn) FILTER (role = 'user'), 1, 40) AS title, substr(max_by(text, (turn, role)), 1, 80) AS preview, CAST(min(turn) AS BIGINT) AS first_at, CAST(max(turn) AS BIGINT) AS last_at,
  count(*) AS n_messages, bool_or(role = 'tool') AS has_tool, bool_or(contains(text, 'image')) AS has_vision, array_to_string(list(role ORDER BY turn DESC, role DESC)[1:12], ',') AS last_roles FROM conversations GROUP BY conv_id""")
def m12(spark, sf_dir):
    return M.session_rollup(turns(spark, sf_dir), F.col("turn"))


@query("m13_daily_quota", "SELECT user_id, CAST(ts::DATE AS VARCHAR) AS day, CAST(sum(length(props)) AS BIGINT) AS used, sum(length(props)) > 20 AS over FROM events GROUP BY 1, 2")
def m13(spark, sf_dir):
    return M.daily_quota(table(spark, sf_dir, "events"), "user_id", "ts", F.length("props").cast("long"), 20).withColumn("day", F.col("day").cast("string"))
