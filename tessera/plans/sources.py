"""Queries over sources, sinks and named functions: rows are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.registry import register_functions
from tessera.functions.text import vector_sum
from tessera.plans.registry import query, rows, table
from tessera.sources import tables as S
from tessera.sources.buckets import BucketedTable
from tessera.sources.scratch import new_path


def as_files(df, name, suffix):
    """Each row (stem, value) of df as a text in a folder per stem."""
    path = new_path(df.sparkSession, name)
    df.select("stem", F.col("value")).write.partitionBy("stem").option("lineSep", "\u0001").text(path)
    return path


@query("s1_corpus_scan", "SELECT source, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents WHERE source NOT IN ('src3') GROUP BY source")
def s1(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.when(F.col("source") == "src3", "raw").otherwise(F.col("source")).alias("stem"), F.col("text").alias("value"))
    path = as_files(d, "corpus", "txt")
    found = S.read_corpus(spark, path, skip="/stem=raw/")
    texts = found.select(F.regexp_extract("path", "stem=([^/]+)", 1).alias("source"), F.explode(F.filter(F.split("text", "\u0001"), lambda x: x != "")).alias("t"))
    return texts.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.length("t")).alias("chars"))


@query("s2_composition_import", """
SELECT p_partkey, p_name, p_type AS category, count(l_partkey) AS amounts FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_size >= 10 GROUP BY 1, 2, 3""")
def s2(spark, sf_dir):
    base = new_path(spark, "foods")
    p, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    p.select(F.col("p_partkey").alias("fdc_id"), F.col("p_name").alias("description"), F.hash("p_type").alias("food_category_id")).write.option("header", "true").csv(f"{base}/food")
    p.select(F.hash("p_type").alias("id"), F.col("p_type").alias("name")).distinct().write.option("header", "true").csv(f"{base}/food_category")
    p.filter("p_size >= 10").select(F.col("p_partkey").alias("fdc_id")).write.option("header", "true").csv(f"{base}/foundation_food")
    li.select(F.col("l_partkey").alias("fdc_id"), F.col("l_quantity").alias("amount")).write.option("header", "true").csv(f"{base}/food_nutrient")
    read = lambda n, req: S.read_csv(spark, f"{base}/{n}", req)
    food = read("food", ["fdc_id", "description"]).join(read("foundation_food", ["fdc_id"]), "fdc_id", "left_semi")
    category = read("food_category", ["id", "name"]).withColumnRenamed("id", "food_category_id")
    amounts = read("food_nutrient", ["fdc_id", "amount"]).groupBy("fdc_id").agg(F.count("*").alias("amounts"))
    out = food.join(category, "food_category_id").join(amounts, "fdc_id")
    return out.select(F.col("fdc_id").cast("long").alias("p_partkey"), F.col("description").alias("p_name"), F.col("name").alias("category"), "amounts")


@query("s3_wide_import", "SELECT p_partkey AS food_id, p_name AS food_name, CASE WHEN p_partkey % 10 <> 0 THEN p_retailprice END AS energy FROM part")
def s3(spark, sf_dir):
    path = new_path(spark, "wide")
    energy = F.when(F.col("p_partkey") % 10 == 0, "Tr").otherwise(F.col("p_retailprice").cast("string"))
    table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id（code）"), F.col("p_name").alias("food (name)"), energy.alias("energy（kcal）")).write.option("header", "true").csv(path)
    w = S.read_csv(spark, path, ["id", "food", "energy"], {"id": "food_id", "food": "food_name"}, ["energy"])
    return w.select(F.col("food_id").cast("long").alias("food_id"), "food_name", "energy")


@query("s4_rule_counts", """
SELECT 'severity' AS field, CASE p_size % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'block' ELSE 'warn' END AS value, count(*) AS n FROM part GROUP BY 1, 2
UNION ALL SELECT 'category', coalesce(nullif(p_type, ''), 'unknown'), count(*) FROM part GROUP BY 1, 2""")
def s4(spark, sf_dir):
    """Parts as rule files of 500, every third rule without a severity."""
    path = new_path(spark, "rules")
    severity = F.when(F.col("p_size") % 3 == 1, "block").when(F.col("p_size") % 3 == 2, "warn")
    rule = F.struct(F.col("p_partkey").cast("string").alias("rule_id"), severity.alias("severity"), F.col("p_type").alias("category"))
    files = table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 500).cast("string").alias("version")).agg(F.collect_list(rule).alias("rules"))
    files.write.option("maxRecordsPerFile", 1).json(path)
    return S.rule_counts(S.read_rules(spark, path))


@query("s5_evaluation_set", """
SELECT item_id::VARCHAR AS id, coalesce(text, '') AS question, CASE WHEN item_id % 4 = 0 THEN 'wiki' ELSE 'rag' END AS expected_route, CASE WHEN item_id % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS n_keywords FROM benchmark""")
def s5(spark, sf_dir):
    """Test items as case files of 50, some without a route or keywords."""
    path = new_path(spark, "cases")
    case = F.struct(F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"), F.when(F.col("item_id") % 4 == 0, "wiki").alias("expected_route"),
                    F.when(F.col("item_id") % 2 == 0, F.array(F.substring_index("text", " ", 1))).alias("expected_keywords"))
    files = table(spark, sf_dir, "benchmark").groupBy(F.floor(F.col("item_id") / 50).cast("string").alias("version")).agg(F.collect_list(case).alias("cases"))
    files.write.option("maxRecordsPerFile", 1).json(path)
    return S.read_cases(spark, path).select("id", "question", "expected_route", F.size("expected_keywords").cast("long").alias("n_keywords"))


@query("s6_feed_items", "SELECT page_id, 'page ' || page_id AS title, CASE WHEN page_id % 2 = 0 THEN 'unknown' ELSE 'day ' || page_id % 7 END AS published FROM pages")
def s6(spark, sf_dir):
    """Feeds of about a hundred items, an item a row, between a row that opens the feed and one that closes it."""
    path, p = new_path(spark, "feed"), table(spark, sf_dir, "pages").select("page_id")
    n = 1 + p.count() // 100
    item = F.concat(F.lit("<item><title>page "), "page_id", F.lit("</title><link>"), "page_id", F.lit("</link>"), F.when(F.col("page_id") % 2 == 0, "").otherwise(F.concat(F.lit("<pubDate>day "), F.col("page_id") % 7, F.lit("</pubDate>"))), F.lit("</item>"))
    items = p.select(F.pmod(F.xxhash64("page_id"), F.lit(n)).alias("feed"), F.lit(1).alias("place"), item.alias("value"))
    ends = items.select("feed").distinct().select("feed", F.explode(F.array(F.struct(F.lit(0).alias("place"), F.lit("<rss><channel>").alias("value")), F.struct(F.lit(2).alias("place"), F.lit("</channel></rss>").alias("value")))).alias("e")).select("feed", "e.*")
    items.unionByName(ends).repartition("feed").sortWithinPartitions("feed", "place").drop("place").write.partitionBy("feed").text(path)
    return S.read_feed(spark, path).select(F.col("link").cast("long").alias("page_id"), "title", "published")


@query("s7_article_text", r"""
WITH n AS (SELECT page_id, regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_extract(h, '(?s)<article[^>]*>(.*?)</article>', 1) AS a, array_to_string(regexp_extract_all(h, '(?s)<p[^>]*>(.*?)</p>', 1), chr(10)) AS p FROM n)
SELECT page_id, substr(trim(regexp_replace(regexp_replace(CASE WHEN a <> '' THEN a ELSE p END, '<[^>]+>', '', 'g'), '[ \t\n]+', ' ', 'g')), 1, 2000) AS article FROM b""")
def s7(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.article_text(F.col("html")).alias("article"))


@query("s8_upsert", """
SELECT o_custkey, max_by(o_orderkey, o_orderkey) AS o_orderkey, min(o_orderkey) AS created FROM orders GROUP BY o_custkey""")
def s8(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("created"))
    t = BucketedTable(spark, new_path(spark, "newest"), o.schema, ["o_custkey"])
    for k in range(2):
        t.upsert(o.filter(F.col("o_orderkey") % 2 == k), "o_orderkey", "created")
    return t.read()


@query("s9_insert_or_ignore", """
WITH a AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey % 3 = 0), b AS (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE o_custkey NOT IN (SELECT o_custkey FROM a)""")
def s9(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return S.insert_or_ignore(o.filter("o_orderkey % 3 = 0"), o.filter("o_orderkey % 3 <> 0"), ["o_custkey"], ["o_orderkey"])


@query("s10_replace_documents", "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 4 = 0 THEN 'new' ELSE l_returnflag END AS flag FROM lineitem WHERE l_orderkey % 4 <> 0 OR l_linenumber <= 2")
def s10(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("flag"))
    new = li.filter("l_orderkey % 4 = 0 and l_linenumber <= 2").withColumn("flag", F.lit("new"))
    t = BucketedTable(spark, new_path(spark, "lines"), li.schema, ["l_orderkey"])
    t.replace(li)
    # An order that has no new line keeps none: it is replaced by nothing.
    t.replace(new, gone=li.filter("l_orderkey % 4 = 0"))
    return t.read()


@query("s11_cascade_delete", """
SELECT 'orders' AS name, count(*) AS n FROM orders WHERE o_custkey % 10 <> 0 UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_custkey % 10 <> 0""")
def s11(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    ids = c.select(F.col("c_custkey").alias("id")).filter("id % 10 = 0")
    left = []
    for name, rows, key in (("orders", o, "o_custkey"), ("customer", c, "c_custkey")):
        t = BucketedTable(spark, new_path(spark, name), rows.schema, [key])
        t.replace(rows)
        t.delete(ids)
        left.append(t.read().agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n"))
    return left[0].unionByName(left[1])


@query("s12_schema_evolution", "SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'unknown' ELSE CAST(s_nationkey AS VARCHAR) END AS nation FROM supplier")
def s12(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("nation"))
    return S.evolved(s.filter("id % 2 = 0").drop("nation"), s.filter("id % 2 = 1"), {"nation": "unknown"})


@query("s13_table_counts", """
SELECT 'orders' AS name, count(*) AS rows, count(*) FILTER (o_orderstatus = 'F') AS flagged FROM orders UNION ALL SELECT 'events', count(*), count(*) FILTER (value > 100) FROM events UNION ALL SELECT 'documents', count(*), count(*) FILTER (lang = 'en') FROM documents""")
def s13(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    return S.table_counts({"orders": (t("orders"), F.col("o_orderstatus") == "F"), "events": (t("events"), F.col("value") > 100), "documents": (t("documents"), F.col("lang") == "en")})


@query("s14_json_report", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def s14(spark, sf_dir):
    path = new_path(spark, "report")
    e = table(spark, sf_dir, "events")
    S.write_report(path, e.groupBy("event_type").agg(F.count("*").alias("n")), e.select("event_id", "value"))
    return spark.read.schema("event_type string, n long").json(f"{path}/summary")


@query("s15_manifest", "SELECT lang AS name, max(doc_id) AS at, max_by(source, doc_id) AS title FROM documents GROUP BY lang")
def s15(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    path = as_files(d.select(F.col("lang").alias("stem"), F.col("source").alias("value")), "files", "txt")
    manifest = d.select(F.col("lang").alias("name"), F.col("source").alias("title"), F.col("doc_id").alias("at"))
    return S.listed_files(spark, path, manifest, "stem=([^/]+)/").select("name", "at", "title")


@query("u1_sql_functions", r"SELECT p_partkey, regexp_replace(lower(p_brand || ':' || p_name), '\s+', '', 'g') AS k, len(regexp_extract_all(lower(p_name), '[a-z0-9_+-]+')) AS words FROM part")
def u1(spark, sf_dir):
    register_functions(spark)
    table(spark, sf_dir, "part").createOrReplaceTempView("tessera_part")
    return spark.sql("SELECT p_partkey, tessera_dedupe_key(p_brand, p_name) AS k, CAST(size(tessera_words(p_name)) AS BIGINT) AS words FROM tessera_part")


@query("u1_more_functions", r"""
SELECT doc_id, 'doc_' || substr(sha1(text), 1, 20) AS id, CASE WHEN doc_id % 5 IN (0, 3) THEN 'p.' || greatest(doc_id % 5, 1) ELSE 'pp.' || doc_id % 5 || '-3' END AS pages,
  substr(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '[!?.,;: ]+$', ''), 1, 40) AS title, lang AS lang_read, least(greatest(CAST(n_chars AS DOUBLE), 10), 500) AS clamped, CASE doc_id % 3 WHEN 0 THEN 2000.0::DOUBLE WHEN 1 THEN 100.0::DOUBLE END AS grams
FROM documents""")
def u1_more(spark, sf_dir):
    register_functions(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("tessera_documents")
    return spark.sql(r"""
        SELECT doc_id, tessera_stable_id('doc', text) AS id, tessera_page_label(CAST(doc_id % 5 AS INT), CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 3 END) AS pages,
          tessera_session_title(text) AS title, tessera_front_matter(concat('---\nlang: ', lang, '\n---\n', text))['lang'] AS lang_read,
          tessera_clamp(CAST(n_chars AS STRING), 0D, 10D, 500D) AS clamped, tessera_grams(2D, CASE doc_id % 3 WHEN 0 THEN 'KG' WHEN 1 THEN 'liang' ELSE 'cup' END, 1D) AS grams
        FROM tessera_documents""")


@query("u2_meals", """
SELECT p_partkey, v.no, CASE v.no WHEN 1 THEN p_brand ELSE v.name END AS name, CASE v.no WHEN 0 THEN p_size::DOUBLE ELSE v.q END AS quantity, v.unit FROM part,
  (VALUES (0::BIGINT, 'rice', 'g', 0.0), (1, NULL, NULL, 1.0), (2, 'milk', 'cup', 2.5)) AS v(no, name, unit, q)""")
def u2_meals(spark, sf_dir):
    register_functions(spark)
    table(spark, sf_dir, "part").createOrReplaceTempView("tessera_part")
    return spark.sql("""
        SELECT p_partkey, CAST(m.no AS BIGINT) AS no, m.name, m.quantity, m.unit
        FROM tessera_part, LATERAL tessera_meals(concat(p_size, 'g of rice, ', p_brand, ' and milk 2.5 Cup')) m""")


@query("u2_table_function", """
WITH d AS (SELECT doc_id, text, unnest(range(greatest(CAST(ceil((length(text) - 50) / 250.0) AS BIGINT), 1))) AS no FROM documents) SELECT doc_id, no, md5(substr(text, no * 250 + 1, 300)) AS chunk_md5 FROM d""")
def u2(spark, sf_dir):
    register_functions(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("tessera_documents")
    return spark.sql("SELECT doc_id, CAST(c.no AS BIGINT) AS no, md5(c.chunk) AS chunk_md5 FROM tessera_documents, LATERAL tessera_chunks(text, 300, 50) c")


@query("u2_readings", """
WITH r AS (SELECT event_id, 'fasting' AS kind, floor(value) AS v FROM events UNION ALL SELECT event_id, 'post_meal', CAST(5 + user_id % 40 AS DOUBLE) FROM events)
SELECT event_id, kind, v AS value FROM r WHERE v BETWEEN 1 AND 35""")
def u2_readings(spark, sf_dir):
    register_functions(spark)
    table(spark, sf_dir, "events").createOrReplaceTempView("tessera_events")
    return spark.sql("""
        SELECT event_id, r.kind, tessera_glucose_mmol(r.value, r.unit) AS value
        FROM (SELECT event_id, concat('fasting ', floor(value), ' mmol; after dinner ', (5 + user_id % 40) * 18, ' mg/dl; pulse 70') AS said FROM tessera_events), LATERAL tessera_readings(said) r
        WHERE tessera_glucose_mmol(r.value, r.unit) IS NOT NULL""")


@query("u3_vector_sum", """
WITH e AS (SELECT label, unnest(range(len(embedding))) AS place, unnest(embedding)::DOUBLE AS v FROM embeddings), s AS (SELECT label, place, round(sum(v), 3) + 0.0 AS v FROM e GROUP BY 1, 2)
SELECT label, place, v FROM s""")
def u3_vector_sum(spark, sf_dir):
    e = vector_sum(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return e.select("label", F.posexplode("total").alias("place", "v")).select("label", F.col("place").cast("long").alias("place"), (F.round("v", 3) + 0.0).alias("v"))


@query("u3_aggregates", """
SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types, count(DISTINCT event_id % 16) AS buckets FROM events GROUP BY user_id""")
def u3(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"), F.size(F.collect_set(F.col("event_id") % 16)).cast("long").alias("buckets"))
