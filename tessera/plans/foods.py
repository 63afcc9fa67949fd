"""Queries over composition tables and meals: a part is a food, an order a meal, a line an item of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import foods as N
from tessera.plans.registry import query, rows, table
from tessera.sources.scratch import spread


def part(spark, sf_dir):
    return table(spark, sf_dir, "part")


def lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


@query("f1_best_amounts", """
WITH b AS (SELECT l_partkey, l_returnflag, min_by(l_quantity, (l_linenumber, l_quantity)) AS q FROM lineitem GROUP BY 1, 2)
SELECT l_partkey, max(q) FILTER (l_returnflag = 'A') AS a, max(q) FILTER (l_returnflag = 'N') AS n, max(q) FILTER (l_returnflag = 'R') AS r FROM b GROUP BY 1""")
def f1(spark, sf_dir):
    p = N.best_amounts(lines(spark, sf_dir), "l_partkey", "l_returnflag", "l_quantity", "l_linenumber", ["A", "N", "R"])
    return p.select("l_partkey", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))


@query("f2_portion_labels", """
WITH x AS (SELECT l_partkey, substr(concat_ws(' ', CAST(l_linenumber AS VARCHAR), l_returnflag, l_linestatus), 1, 160) AS label, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_returnflag, l_linestatus) AS n FROM lineitem WHERE l_quantity > 0)
SELECT l_partkey, string_agg(label, '; ' ORDER BY n) AS labels FROM x WHERE n <= 8 GROUP BY l_partkey""")
def f2(spark, sf_dir):
    from tessera.operators.documents import top_per_key

    label = F.substring(F.concat_ws(" ", "l_linenumber", "l_returnflag", "l_linestatus"), 1, 160)
    x = lines(spark, sf_dir).filter("l_quantity > 0").select("l_partkey", "l_orderkey", "l_linenumber", label.alias("label"))
    x = top_per_key(x, ["l_partkey"], ["l_orderkey", "l_linenumber", "label"], 8)
    return x.groupBy("l_partkey").agg(F.array_join(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "label")))["label"], "; ").alias("labels"))


CATEGORIES = [("warm", "red|orange"), ("cold", "blue|green")]


@query("f3_category", """
SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'red|orange') THEN 'warm' WHEN regexp_matches(p_name, 'blue|green') THEN 'cold' ELSE 'other' END AS category,
  concat_ws(',', CASE WHEN p_type LIKE '%O%' THEN 'o' END, CASE WHEN p_brand LIKE '%1' THEN 'one' END) AS flags FROM part""")
def f3(spark, sf_dir):
    p = part(spark, sf_dir)
    flags = F.concat(N.labels(F.col("p_type"), [("o", "O")]), N.labels(F.col("p_brand"), [("one", "1$")]))
    return p.select("p_partkey", N.first_label(F.col("p_name"), CATEGORIES, "other").alias("category"), F.array_join(flags, ",").alias("flags"))


@query("f4_aliases", r"""
WITH a AS (SELECT p_partkey, p_name AS alias FROM part UNION SELECT p_partkey, lower(p_name) FROM part UNION SELECT p_partkey, p_brand || ' ' || p_name FROM part)
SELECT p_partkey, alias, 'en' AS language FROM a""")
def f4(spark, sf_dir):
    names = F.array_distinct(F.array("p_name", F.lower("p_name"), F.concat_ws(" ", "p_brand", "p_name")))
    a = part(spark, sf_dir).select("p_partkey", F.explode(names).alias("alias"))
    return a.withColumn("language", F.when(F.col("alias").rlike(f"[{T.CJK}]"), "zh").otherwise("en"))


@query("f5_risk_tags", """
SELECT p_partkey, 'size' AS tag, p_size::DOUBLE AS value FROM part WHERE p_size >= 40 UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part WHERE p_retailprice >= 1500""")
def f5(spark, sf_dir):
    tags = N.threshold_tags({"size": (F.col("p_size"), 40), "price": (F.col("p_retailprice"), 1500)})
    return part(spark, sf_dir).select("p_partkey", F.explode(tags).alias("t")).select("p_partkey", "t.tag", "t.value")


@query("f6_meal_items", """
SELECT p_partkey, v.no, CASE v.no WHEN 2 THEN p_brand ELSE v.name END AS name, CASE v.no WHEN 0 THEN p_size::DOUBLE ELSE v.q END AS quantity, v.unit FROM part,
  (VALUES (0, 'rice', 'g', 0.0), (1, 'soup', '碗', 2.0), (2, NULL, NULL, 1.0), (3, '饭', '碗', 1.5), (4, '菜', '克', 150.0), (5, '豆', 'kg', 0.5)) AS v(no, name, unit, q)""")
def f6(spark, sf_dir):
    said = F.concat(F.lit("今天吃了"), F.col("p_size"), F.lit("g rice，soup 两碗 and "), "p_brand", F.lit("，一半碗饭搭配一百五十克菜半kg豆"))
    m = spread(part(spark, sf_dir)).select("p_partkey", F.posexplode(N.meal_items(said)).alias("no", "i"))
    return m.select("p_partkey", "no", "i.name", "i.quantity", "i.unit")


@query("f7_resolved_grams", """
SELECT l_orderkey, l_linenumber, l_quantity * CASE WHEN l_linenumber % 4 = 0 THEN 1.0 WHEN p_size <= 10 THEN p_size * 10.0 WHEN p_type LIKE 'PROMO%' THEN 55.0 ELSE 100.0 END AS grams,
  CASE WHEN l_linenumber % 4 = 0 THEN 'explicit' WHEN p_size <= 10 THEN 'portion' WHEN p_type LIKE 'PROMO%' THEN 'rule' ELSE 'generic' END AS provenance FROM lineitem JOIN part ON l_partkey = p_partkey""")
def f7(spark, sf_dir):
    p = part(spark, sf_dir)
    portions = p.filter("p_size <= 10").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") * 10.0).alias("portion"))
    x = lines(spark, sf_dir).join(p, F.col("l_partkey") == F.col("p_partkey")).join(portions, "l_partkey", "left")
    grams, source = N.resolved_grams([("explicit", F.when(F.col("l_linenumber") % 4 == 0, 1.0)), ("portion", F.col("portion")),
                                      ("rule", F.when(F.startswith("p_type", F.lit("PROMO")), 55.0)), ("generic", F.lit(100.0))], F.col("l_quantity"))
    return x.select("l_orderkey", "l_linenumber", grams.alias("grams"), source.alias("provenance"))


@query("f8_meal_totals", "SELECT l_orderkey, round(sum(CAST(l_quantity AS DECIMAL(18,4)) * CAST(p_retailprice AS DECIMAL(18,4)) / 100), 4)::DOUBLE AS energy, count(*) AS n_items FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def f8(spark, sf_dir):
    x = lines(spark, sf_dir).join(part(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"))
    return x.groupBy("l_orderkey").agg(F.round(F.sum(N.scaled(F.col("l_quantity"), F.col("p_retailprice"))), 4).cast("double").alias("energy"), F.count("*").alias("n_items"))


@query("f9_resolved_split", "SELECT l_orderkey, count(*) FILTER (p_size < 40) AS resolved, count(*) FILTER (p_size >= 40) AS unresolved FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def f9(spark, sf_dir):
    known = part(spark, sf_dir).filter("p_size < 40").select(F.col("p_partkey").alias("l_partkey"), F.lit(1).alias("known"))
    x = lines(spark, sf_dir).join(known, "l_partkey", "left")
    return x.groupBy("l_orderkey").agg(F.count("known").alias("resolved"), F.count_if(F.col("known").isNull()).alias("unresolved"))


@query("f10_targets", """
WITH t AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE round(400000 / CASE WHEN o_orderkey % 4 = 1 THEN 10.0 ELSE 3.0 END, 1) END AS target FROM orders)
SELECT o_orderkey, target, CASE WHEN target IS NULL THEN 'no_target' WHEN o_totalprice <= target THEN 'ok' WHEN o_totalprice <= target * 1.05 THEN 'near' ELSE 'over' END AS status, round(greatest(target - o_totalprice, 0), 2) AS remaining FROM (SELECT * FROM t) WHERE target IS NOT NULL
UNION ALL SELECT o_orderkey, NULL, 'no_target', NULL FROM t WHERE target IS NULL""")
def f10(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    label = F.when(F.col("o_orderkey") % 4 == 1, "snack").otherwise("meal")
    target = F.when(F.col("o_orderkey") % 4 != 0, N.meal_target(F.lit(400000.0), label))
    left = F.when(target.isNotNull(), F.round(F.greatest(target - F.col("o_totalprice"), F.lit(0.0)), 2))
    return o.select("o_orderkey", target.alias("target"), N.status(F.col("o_totalprice"), target).alias("status"), left.alias("remaining"))


@query("f11_detected_items", """
WITH i AS (SELECT l_orderkey, p_name, CAST(l_quantity AS DECIMAL(18,2)) * CASE WHEN l_linenumber % 2 = 1 THEN 1.00 WHEN p_name LIKE '%widget%' THEN 0.92 WHEN p_name LIKE '%gear%' THEN 1.03 ELSE 1.00 END AS grams FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, sum(grams)::DOUBLE AS grams, any_value(c_mktsegment) = 'BUILDING' AND bool_or(contains(p_name, 'ring') OR contains(p_name, 'bolt')) AS notice FROM i JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def f11(spark, sf_dir):
    """The lines of each order as the JSON of detected items, every second in millilitres; customers of one segment are concerned."""
    x = lines(spark, sf_dir).join(part(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"))
    odd = F.col("l_linenumber") % 2 == 1
    seen = F.struct(F.col("p_name").alias("name"), F.when(odd, F.col("l_quantity")).alias("estimated_grams"), F.when(~odd, F.col("l_quantity")).alias("estimated_ml"))
    said = x.groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list(seen).alias("items"))).alias("payload"))
    items = N.detected_items(said, "l_orderkey", "payload", [("widget", 0.92), ("gear", 1.03)])
    per = items.groupBy("l_orderkey").agg(F.sum(F.col("grams").cast("decimal(18,4)")).cast("double").alias("grams"), F.collect_set("name").alias("names"))
    o, c = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    notice = N.sweet_notice(F.col("names"), F.col("c_mktsegment") == "BUILDING", ["ring", "bolt"])
    return per.join(o, "l_orderkey").join(c, "o_custkey").select("l_orderkey", "grams", notice.alias("notice"))


@query("f12_daily_targets", """
WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS sex, 20 + c_custkey % 50 AS age, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 150.0 + c_custkey % 40 END AS height, 50.0 + c_custkey % 45 AS weight FROM customer),
e AS (SELECT *, round_even(coalesce((10 * weight + 6.25 * height - 5 * age + CASE WHEN sex = 'male' THEN 5 ELSE -161 END) * 1.4, weight * CASE WHEN sex = 'male' THEN 30.0 ELSE 28.0 END)::DOUBLE * CASE WHEN c_custkey % 3 = 0 THEN 0.9::DOUBLE ELSE 1.0 END / 50, 0) * 50 AS energy FROM p),
m AS (SELECT *, energy * CASE WHEN c_custkey % 7 = 0 THEN 0.45::DOUBLE ELSE 0.5 END / 4 AS carb, least(CASE WHEN c_custkey % 11 = 0 THEN weight * 0.8::DOUBLE ELSE greatest(energy * 0.2::DOUBLE / 4, weight * 0.8::DOUBLE) END, energy * 0.35::DOUBLE / 4) AS protein FROM e)
SELECT c_custkey, energy AS energy_kcal, round_even(carb / 5, 0) * 5 AS carbohydrate_g, round_even(protein / 5, 0) * 5 AS protein_g, round_even(greatest(energy - protein * 4 - carb * 4, energy * 0.3::DOUBLE) / 9 / 5, 0) * 5 AS fat_g FROM m""")
def f12(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    t = N.daily_targets(F.when(k % 2 == 0, "male").otherwise("female"), 20 + k % 50, F.when(k % 5 != 0, 150.0 + k % 40), 50.0 + k % 45, F.lit(1.4), k % 3 == 0, k % 7 == 0, k % 11 == 0)
    return c.select("c_custkey", *[v.alias(n) for n, v in t.items()])


@query("f13_intake_records", """
WITH x AS (SELECT event_id, user_id, sha256(concat_ws('|', CAST(user_id AS VARCHAR), event_type, CAST(ts::DATE AS VARCHAR))) AS id FROM events),
o AS (SELECT DISTINCT id FROM x WHERE event_id % 10 = 0), n AS (SELECT id, user_id, event_id, row_number() OVER (PARTITION BY id ORDER BY event_id) AS n FROM x WHERE event_id % 10 <> 0)
SELECT substr(id, 1, 24) AS intake_id, user_id, event_id FROM n WHERE n = 1 AND id NOT IN (SELECT id FROM o)""")
def f13(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    x = e.select("event_id", "user_id", F.sha2(F.concat_ws("|", "user_id", "event_type", F.to_date("ts").cast("string")), 256).alias("id"))
    new = N.new_rows(x.filter("event_id % 10 <> 0"), x.filter("event_id % 10 = 0"), ["id"], ["event_id"])
    return new.select(F.substring("id", 1, 24).alias("intake_id"), "user_id", "event_id")


@query("f14_daily_series", """
WITH u AS (SELECT DISTINCT user_id FROM events), s AS (SELECT user_id, unnest(range(14)) AS i FROM u), d AS (SELECT user_id, DATE '2024-01-20' - CAST(i AS INT) AS day FROM s),
t AS (SELECT user_id, ts::DATE AS day, sum(CAST(value AS DECIMAL(18,2))) AS total FROM events GROUP BY 1, 2)
SELECT d.user_id, CAST(d.day AS VARCHAR) AS day, coalesce(total, 0)::DOUBLE AS total FROM d LEFT JOIN t ON d.user_id = t.user_id AND d.day = t.day""")
def f14(spark, sf_dir):
    s = N.daily_series(table(spark, sf_dir, "events"), "2024-01-20", 14)
    return s.select("user_id", F.col("day").cast("string").alias("day"), "total")


@query("f15_flag_labels", "SELECT p_partkey, concat_ws(',', CASE WHEN p_size > 25 THEN 'large' END, CASE WHEN p_retailprice < 1200 THEN 'cheap' END, CASE WHEN p_partkey % 2 = 0 THEN 'even' END) AS labels FROM part")
def f15(spark, sf_dir):
    flags = {"large": F.col("p_size") > 25, "cheap": F.col("p_retailprice") < 1200, "even": F.col("p_partkey") % 2 == 0}
    return part(spark, sf_dir).select("p_partkey", F.array_join(N.flag_labels(flags), ",").alias("labels"))


@query("f16_portions_read_back", "SELECT DISTINCT p_brand, p_type AS name, CAST(p_size AS DOUBLE) AS grams FROM part")
def f16(spark, sf_dir):
    b = part(spark, sf_dir).groupBy("p_brand").agg(N.portion_string(F.col("p_type"), F.col("p_size")).alias("s"))
    return b.select("p_brand", F.explode(N.portions_of(F.col("s"))).alias("p")).select("p_brand", "p.name", "p.grams")
