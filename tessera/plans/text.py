"""Queries over the text expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import search as S
from tessera.plans.registry import ordered_distinct, query, rows, table

NORMAL = r"""trim(regexp_replace(regexp_replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9))"""
COLLAPSED = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"
WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_+-]+')"


@query("t1_normalize", f"SELECT doc_id, md5({NORMAL}) AS normal_md5, length({COLLAPSED}) AS collapsed_chars FROM documents")
def t1(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(T.normalize(F.col("text"))).alias("normal_md5"), F.length(T.collapse(F.col("text"))).cast("long").alias("collapsed_chars"))


@query("t2_index_tokens", f"""
WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents), d AS (SELECT doc_id, {ordered_distinct('w')} AS t FROM w)
SELECT doc_id, len(t) AS n_tokens, array_to_string(t[1:80], ' ') AS tokens FROM d""")
def t2(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.index_tokens(F.col("text"), None).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join(F.slice("t", 1, 80), " ").alias("tokens"))


SYNONYMS = [(1, "the", "article"), (2, "und", "conjunction"), (3, "de", "preposition"), (4, "de", "von"), (5, "ing", "participle")]
SYNONYM_SQL = "(VALUES (1, 'the', 'article'), (2, 'und', 'conjunction'), (3, 'de', 'preposition'), (4, 'de', 'von'), (5, 'ing', 'participle')) AS v(place, trigger, phrase)"


@query("t3_query_tokens", rf"""
WITH q AS (SELECT item_id, list_concat(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_.+-]+'), regexp_extract_all(lower(coalesce(text, '')), '\d+(?:\.\d+)?')) AS w FROM benchmark)
SELECT item_id, array_to_string({ordered_distinct('w')}, ' ') AS tokens FROM q""")
def t3(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.query_tokens(F.col("text")), " ").alias("tokens"))


@query("t4_expand_queries", f"""
SELECT item_id, concat_ws(' ', text, string_agg(phrase, ' ' ORDER BY place, phrase)) AS expanded
FROM benchmark LEFT JOIN {SYNONYM_SQL} ON contains(lower(text), trigger) GROUP BY item_id, text""")
def t4(spark, sf_dir):
    triggers = rows(spark, "place int, trigger string, phrase string", SYNONYMS)
    return S.expand_queries(table(spark, sf_dir, "benchmark"), triggers).select("item_id", "expanded")


@query("t5_index_text", f"""
WITH w AS (SELECT *, {WORDS} AS w FROM documents), d AS (SELECT *, {ordered_distinct('w')} AS t FROM w)
SELECT doc_id, md5(concat_ws(chr(10), source, lang, text) || chr(10) || chr(10) || array_to_string(t[1:80], ' ')) AS index_md5 FROM d""")
def t5(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(T.index_text(F.col("source"), F.col("lang"), F.col("text"))).alias("index_md5"))


SNIPPET_WORDS = ["nowhere", "tion", "ung"]


@query("t6_snippet", f"""
WITH t AS (SELECT doc_id, {COLLAPSED} AS t FROM documents),
h AS (SELECT doc_id, t, CASE WHEN contains(lower(t), 'nowhere') THEN strpos(lower(t), 'nowhere') WHEN contains(lower(t), 'tion') THEN strpos(lower(t), 'tion')
  WHEN contains(lower(t), 'ung') THEN strpos(lower(t), 'ung') END AS h FROM t),
s AS (SELECT *, greatest(h - 1 - 80, 0) AS a, least(greatest(h - 1 - 80, 0) + 160, length(t)) AS b FROM h)
SELECT doc_id, CASE WHEN h IS NULL THEN substr(t, 1, 160) ELSE CASE WHEN a > 0 THEN '...' ELSE '' END || substr(t, a + 1, b - a) || CASE WHEN b < length(t) THEN '...' ELSE '' END END AS snippet FROM s""")
def t6(spark, sf_dir):
    tokens = F.array(*[F.lit(w) for w in SNIPPET_WORDS])
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text"), tokens).alias("snippet"))


@query("t7_keyword_windows")
def t7(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.keyword_windows(F.col("text"), ["tion", "ung", "que"], 1500, 100, 300).alias("w"))
    return d.select("doc_id", F.posexplode("w").alias("place", "window"))


@query("t8_front_matter", """
SELECT doc_id, lang AS lang_read, source AS title_read, md5(text) AS body_md5, 'page-' || doc_id AS stem FROM documents""")
def t8(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    page = F.concat(F.lit("---\ntitle: "), "source", F.lit("\nlang: "), "lang", F.lit("\n---\n"), "text")
    d = d.select("doc_id", page.alias("p"), F.concat(F.lit("/wiki/page-"), "doc_id", F.lit(".md")).alias("path"))
    meta = T.front_matter(F.col("p"))
    return d.select("doc_id", meta["lang"].alias("lang_read"), T.title(F.col("p"), F.col("path")).alias("title_read"),
                    F.md5(T.body(F.col("p"))).alias("body_md5"), T.title(F.lit("plain"), F.col("path")).alias("stem"))


@query("t9_strip", r"""
SELECT conv_id, turn, text AS stripped, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS letters, replace(text, chr(10), '') AS no_emoji
FROM (SELECT conv_id, turn, regexp_replace(regexp_replace(coalesce(text, ''), '^[\s,.!":\-\[\]]+', ''), '[\s,.!":\-\[\]]+$', '') AS text FROM conversations)""")
def t9(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    decorated = F.concat(F.lit("　😀，【"), "text", F.lit("】！🙂 "))
    s = T.strip_edges(decorated)
    return c.select("conv_id", "turn", s.alias("stripped"), F.length(T.without_punctuation(s)).cast("long").alias("letters"), T.without_emoji(F.concat(s, F.lit("🚀"))).alias("no_emoji"))


@query("t10_plain_text")
def t10(spark, sf_dir):
    """A page with a table, code and a link before each whole text."""
    d = table(spark, sf_dir, "documents")
    page = F.concat(F.lit("# "), "source", F.lit("\n\n| a | b |\n|---|---|\n| "), "lang", F.lit(" | "), F.col("n_chars"), F.lit(" |\n\n```\ncode\n```\n**[x](http://y)** `z`\n\n"), F.coalesce("text", F.lit("")))
    return d.select("doc_id", T.plain_text(page).alias("plain"))


@query("t11_tagged_transcript", "SELECT doc_id, lang AS language, 'HAPPY' AS emotion, 'Speech' AS event, md5(trim(text)) AS content_md5 FROM documents")
def t11(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    t = T.tagged_transcript(F.concat(F.lit("<|"), "lang", F.lit("|><|HAPPY|><|Speech|>"), "text"))
    return d.select("doc_id", t["language"].alias("language"), t["emotion"].alias("emotion"), t["event"].alias("event"), F.md5(t["content"]).alias("content_md5"))


@query("t12_recovered_json", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, false AS broken FROM events")
def t12(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    noisy = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Answer: ```json\n"), "props", F.lit("\n```"))).when(
        F.col("event_id") % 3 == 1, F.concat(F.lit("The result is "), "props", F.lit(" as asked"))).otherwise(F.col("props"))
    found = T.recovered_json(noisy)
    return e.select("event_id", F.get_json_object(found, "$.k").cast("long").alias("k"), T.recovered_json(F.lit("{no")).isNotNull().alias("broken"))


@query("t13_masked", """SELECT event_id, '{"api_key": "***", "inner": {"kind": "' || event_type || '", "token_id": "***"}}' AS masked FROM events""")
def t13(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    j = F.concat(F.lit('{"api_key": "a\\"b'), "event_id", F.lit('", "inner": {"kind": "'), "event_type", F.lit('", "token_id": '), F.col("user_id"), F.lit("}}"))
    return e.select("event_id", T.masked(j, ["api_key", "token", "password", "secret"]).alias("masked"))


@query("t14_chinese_number", "SELECT event_id, CAST(event_id % 100 AS DOUBLE) AS whole, CAST(event_id % 10 AS DOUBLE) + 0.5 AS part, CAST(NULL AS DOUBLE) AS other FROM events")
def t14(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    names = "零一二三四五六七八九"
    digit = lambda c: F.substring(F.lit(names), (c + 1).cast("int"), F.lit(1))
    n = F.col("event_id") % 100
    tens, ones = F.floor(n / 10), n % 10
    said = F.when(n < 10, digit(n)).otherwise(F.concat(F.when(tens == 1, "").otherwise(digit(tens)), F.lit("十"), F.when(ones == 0, "").otherwise(digit(ones))))
    part = F.concat(digit(F.col("event_id") % 10), F.lit("点五"))
    return e.select("event_id", T.chinese_number(said).alias("whole"), T.chinese_number(part).alias("part"), T.chinese_number(F.lit("many")).alias("other"))


@query("t15_units", """
SELECT event_id, CASE WHEN value / 18.0 BETWEEN 1 AND 35 THEN round_even(value / 18.0, 4) END AS mmol,
       CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN value * 1000 WHEN 2 THEN value * 500 ELSE value * 1.0 * 1.03 END AS grams FROM events""")
def t15(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    unit = F.element_at(F.array(*[F.lit(u) for u in ("g", "KG", "jin", "ml")]), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select("event_id", T.glucose_mmol(F.col("value"), F.lit("mg/dL"), 4).alias("mmol"), T.grams_of(F.col("value"), unit, F.lit(1.03)).alias("grams"))


@query("t16_stable_ids", """
SELECT o_orderkey, 'order_' || substr(sha1(concat_ws('|', CAST(o_custkey AS VARCHAR), o_orderpriority, o_orderstatus)), 1, 20) AS stable, sha256(o_orderpriority) AS content FROM orders""")
def t16(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", T.stable_id("order", F.col("o_custkey"), F.col("o_orderpriority"), F.col("o_orderstatus")).alias("stable"), F.sha2("o_orderpriority", 256).alias("content"))


@query("t17_dedupe_key", r"SELECT p_partkey, regexp_replace(lower(concat_ws(':', p_brand, p_type, p_name)), '\s+', '', 'g') AS dedupe_key FROM part")
def t17(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.dedupe_key(F.col("p_brand"), F.col("p_type"), F.col("p_name")).alias("dedupe_key"))


@query("t18_hashed_vector", f"""
WITH w AS (SELECT item_id, {WORDS} AS w FROM benchmark), d AS (SELECT item_id, unnest(({ordered_distinct('w')})[1:80]) AS t FROM w),
b AS (SELECT item_id, sha256(t) AS h FROM d),
x AS (SELECT item_id, CAST(('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2]) AS BIGINT) % 32 AS i, CASE WHEN CAST('0x' || h[9:10] AS BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END AS s FROM b),
v AS (SELECT item_id, i, sum(s) AS v FROM x GROUP BY item_id, i),
n AS (SELECT item_id, sqrt(sum(v * v)) AS n FROM v GROUP BY item_id)
SELECT v.item_id, v.i AS bucket, round(v / n, 6) AS value FROM v JOIN n ON v.item_id = n.item_id WHERE v <> 0""")
def t18(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", T.index_tokens(F.col("text")).alias("t"))
    v = T.hashed_vectors(b, "item_id", "t").select("item_id", F.posexplode("vector").alias("bucket", "v")).filter("v <> 0")
    return v.select("item_id", F.col("bucket").cast("long").alias("bucket"), F.round("v", 6).alias("value"))


@query("t19_similarity", """
WITH a AS (SELECT * FROM embeddings), p AS (SELECT x.vec_id, x.embedding AS a, y.embedding AS b FROM a x JOIN a y ON x.vec_id + 1 = y.vec_id)
SELECT vec_id, round(list_sum(list_transform(list_zip(a, b), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / (sqrt(list_sum(list_transform(a, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b, lambda x: x::DOUBLE * x::DOUBLE)))), 4) AS cosine,
       0.0 AS guarded, 0.5 AS shared FROM p""")
def t19(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    p = e.join(nxt, "vec_id")
    abc, bcd = (F.array(*[F.lit(x) for x in s]) for s in ("abc", "bcd"))
    return p.select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("b")), 4).alias("cosine"),
                    T.cosine(F.col("embedding"), F.slice("b", 1, 3)).alias("guarded"), T.jaccard(abc, bcd).alias("shared"))


@query("t20_numbers", """
SELECT p_partkey, round_even((p_size + p_retailprice) / 2, 2) AS mid, p_retailprice AS one_sided, greatest(5.0, least(30.0, CAST(p_size AS DOUBLE))) AS clamped, 7.0 AS fallback FROM part""")
def t20(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    size, price = F.col("p_size").cast("string"), F.col("p_retailprice").cast("string")
    return p.select("p_partkey", T.midpoint(size, price).alias("mid"), T.midpoint(F.lit("none"), price).alias("one_sided"),
                    T.clamp(size, 0, 5, 30).alias("clamped"), T.clamp(F.lit("x"), 7, 5, 30).alias("fallback"))


@query("t21_session_titles", r"""
WITH c AS (SELECT conv_id, turn, role, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), ' ') AS t FROM conversations),
s AS (SELECT conv_id, min_by(t, (turn, t)) FILTER (role = 'user' AND t <> '') AS said, min_by(t, (turn, role, t)) FILTER (t <> '') AS any_, max_by(t, (turn, role, t)) FILTER (t <> '') AS last FROM c GROUP BY conv_id)
SELECT conv_id, substr(regexp_replace(coalesce(said, any_, ''), '[。！？!?.,，；;：: ]+$', ''), 1, 40) AS title, substr(coalesce(last, ''), 1, 80) AS preview FROM s""")
def t21(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", T.collapse(F.col("text")).alias("t"))
    some = F.col("t") != ""
    s = c.groupBy("conv_id").agg(
        F.min(F.when(some & (F.col("role") == "user"), F.struct("turn", "t"))).alias("said"), F.min(F.when(some, F.struct("turn", "role", "t"))).alias("any"),
        F.max(F.when(some, F.struct("turn", "role", "t"))).alias("last"))
    return s.select("conv_id", T.session_title(F.coalesce("said.t", "any.t", F.lit(""))).alias("title"), F.substring(F.coalesce("last.t", F.lit("")), 1, 80).alias("preview"))


@query("t22_citations", """
WITH n AS (SELECT doc_id, source, CAST(greatest(ceil(length(coalesce(text, '')) / 1500.0), 1) AS INT) AS n FROM documents),
p AS (SELECT doc_id, source, n, unnest(range(1, n + 1, 3)) AS a FROM n)
SELECT doc_id, CAST(a AS INT) AS first, source || ' ' || CASE WHEN least(a + 2, n) = a THEN 'p.' || a ELSE 'pp.' || a || '-' || least(a + 2, n) END || ' [' || doc_id || ':' || a || ']' AS citation FROM p""")
def t22(spark, sf_dir):
    """Every three pages of a document, cited."""
    d = table(spark, sf_dir, "documents")
    n = F.greatest(F.ceil(F.length(F.coalesce("text", F.lit(""))) / 1500), F.lit(1)).cast("int")
    p = d.select("doc_id", "source", n.alias("n")).select("doc_id", "source", "n", F.explode(F.expr("sequence(1, n, 3)")).alias("first"))
    last = F.least(F.col("first") + 2, F.col("n"))
    return p.select("doc_id", "first", T.citation(F.col("source"), F.col("first"), last, F.concat_ws(":", "doc_id", "first")).alias("citation"))


@query("t23_meal_intent", """
WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') || CASE turn % 6 WHEN 0 THEN ' 如果早餐' WHEN 1 THEN ' Dinner' WHEN 2 THEN ' 准备' WHEN 3 THEN ' 刚吃 supper' WHEN 4 THEN ' 推荐 lunch' ELSE '' END AS t FROM conversations)
SELECT conv_id, turn, role, CASE WHEN contains(lower(t), 'breakfast') OR contains(t, '早餐') THEN 'breakfast' WHEN contains(lower(t), 'lunch') THEN 'lunch' WHEN contains(lower(t), 'dinner') OR contains(lower(t), 'supper') THEN 'dinner' WHEN contains(lower(t), 'snack') THEN 'snack' ELSE 'meal' END AS meal,
  NOT ((contains(t, '如果') OR contains(t, '准备') OR contains(t, '推荐')) AND NOT (contains(t, '早餐') OR contains(t, '刚吃'))) AS actual FROM m""")
def t23(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    more = F.element_at(F.array(*[F.lit(x) for x in (" 如果早餐", " Dinner", " 准备", " 刚吃 supper", " 推荐 lunch", "")]), (F.col("turn") % 6 + 1).cast("int"))
    t = F.concat(F.coalesce("text", F.lit("")), more)
    return c.select("conv_id", "turn", "role", T.meal_label(t).alias("meal"), T.is_actual_intake(t).alias("actual"))
