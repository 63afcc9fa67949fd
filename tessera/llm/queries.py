"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, collocations, decontamination, divergence, language_id, line_dedup, mixing, personal_data, quality_rules, secrets, simhash, toxicity, url_filter
from .common import materialize, table

URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = language_id.train(docs, ~held_out)
    return language_id.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    back = chat_format.read_back(chat_format.chat_windows(turns))
    # A digest needs all the text of a conversation in one value; the operator itself never does.
    back = back.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("window", "new_turns", "loss_texts"))).alias("w"),
        F.sum(F.length("text")).alias("formatted_chars"), F.count("*").alias("n_windows"))
    turns_ = F.flatten(F.col("w.new_turns"))
    loss = F.array_join(F.flatten(F.col("w.loss_texts")), "")
    said = F.array_join(F.transform(turns_, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size(turns_).cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars", "n_windows")


OP2_SQL = r"""
WITH t0 AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t1 AS (
  SELECT *, CAST(ceil(strlen(text) / 4.0) AS BIGINT) + 4 AS k,
         row_number() OVER w AS n, first_value(role) OVER w AS role0 FROM t0
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
t2 AS (
  SELECT *, n = 1 AND role = 'system' AS sys,
         CASE WHEN role0 = 'system' THEN first_value(k) OVER w ELSE 0 END AS sk,
         sum(k) OVER w - k AS p FROM t1
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
t3 AS (
  SELECT *, p - CASE WHEN sys THEN 0 ELSE sk END AS s, greatest(1, (2048 - 256 - sk) // 2) AS room FROM t2),
t4 AS (SELECT *, 2 * (s // room) + CASE WHEN k > room THEN 1 ELSE 0 END AS w FROM t3),
shown AS (
  SELECT *, 12 + length(replace(regexp_replace(replace(role, '\', '\\'), '([<\[])((?:\||s>|/s>|<SYS>>|</SYS>>)|/?INST\])', '\1\\\2', 'g'), chr(10), '<\n>')) + 1
            + length(regexp_replace(replace(text, '\', '\\'), '([<\[])((?:\||s>|/s>|<SYS>>|</SYS>>)|/?INST\])', '\1\\\2', 'g')) + 11 AS chars FROM t4),
ends AS (
  SELECT conv_id, w, max(s + k) AS e, lead(w) OVER (PARTITION BY conv_id ORDER BY w) AS nxt FROM shown WHERE NOT sys GROUP BY conv_id, w),
wins AS (SELECT conv_id, greatest(count(*), 1) AS n_windows FROM ends GROUP BY conv_id),
again AS (
  SELECT x.conv_id, sum(x.chars) AS chars FROM shown x JOIN ends e ON x.conv_id = e.conv_id AND x.w = e.w
  WHERE NOT x.sys AND e.nxt IS NOT NULL AND e.e - x.s <= 256 GROUP BY x.conv_id),
c AS (
  SELECT conv_id, count(*) AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum(CASE WHEN NOT sys THEN chars ELSE 0 END) AS own, sum(CASE WHEN sys THEN chars ELSE 0 END) AS sysc FROM shown GROUP BY conv_id)
SELECT c.conv_id, c.n_turns, c.turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(own + coalesce(again.chars, 0) + sysc * coalesce(n_windows, 1) AS BIGINT) AS formatted_chars,
       CAST(coalesce(n_windows, 1) AS BIGINT) AS n_windows
FROM c LEFT JOIN again ON c.conv_id = again.conv_id LEFT JOIN wins ON c.conv_id = wins.conv_id
"""


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.spans_text(F.col("base")), 256).alias("base_sha256"),
        secrets.spans_text(F.concat("base", "linked")).alias("spans"), F.size("links").cast("long").alias("n_links"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_phrases(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
k AS (SELECT item, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i, w FROM b WHERE len(w) > 0),
p AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM k),
x AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n),
o AS (SELECT r, x.n, i, item FROM x JOIN p ON x.n = p.n AND array_to_string(w[i:i + x.n - 1], ' ') = p.s),
h AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT r, n, i FROM o)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM o) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.r = h.r LEFT JOIN t ON d.r = t.r
"""


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    # The list: addresses of pages over 2 % of whose characters outside tags are symbols, and hosts with over twice as large a
    # share of such pages as all hosts together.
    host, path = url_filter.url_parts(F.col("url"))
    shown = F.regexp_replace("html", "<[^>]*>", " ")
    junk = 50 * (F.length(shown) - F.length(F.translate(shown, "#*$%&|", ""))) > F.length(shown)
    judged = pages.select(host.alias("host"), path.alias("path"), F.coalesce(junk, F.lit(False)).cast("int").alias("junk")).filter("host <> ''")
    judged = materialize(judged, "judged")
    all_junk, every = judged.agg(F.coalesce(F.sum("junk"), F.lit(0)), F.count("*")).first()
    hosts = judged.groupBy("host").agg(F.sum("junk").alias("junk"), F.count("*").alias("pages"))
    hosts = hosts.filter(F.col("junk") * every > 2 * F.lit(all_junk) * F.col("pages")).select(F.col("host").alias("key"))
    listed = hosts.unionByName(judged.filter("junk = 1").select(F.concat("host", "path").alias("key")))
    out = url_filter.url_filter(pages.select("page_id", "url"), URL_RULES, listed)
    return out.select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
WITH r(action, rule) AS (VALUES ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')),
rules AS (SELECT action, rule, split_part(rule, '/', 1) AS rh, substr(rule, strpos(rule, '/')) AS rp FROM r),
p AS (
  SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
t AS (SELECT host, path, regexp_replace(html, '<[^>]*>', ' ', 'g') AS t FROM u WHERE host <> ''),
j AS (SELECT host, path, coalesce((length(t) - length(regexp_replace(t, '[#*$%&|]', '', 'g'))) / length(t) > 0.02, false) AS junk FROM t),
bad_host AS (SELECT host FROM j GROUP BY host HAVING count(*) FILTER (junk) * (SELECT count(*) FROM j) > 2 * count(*) * (SELECT count(*) FILTER (junk) FROM j)),
bad_page AS (SELECT DISTINCT host, path FROM j WHERE junk),
best AS (
  SELECT u.page_id, max_by(rule, length(rule)) AS rule, max_by(action, length(rule)) AS action
  FROM u JOIN rules ON (u.host = rh OR ends_with(u.host, '.' || rh)) AND starts_with(u.path, rp) GROUP BY u.page_id)
SELECT u.page_id, u.host, u.path, best.rule,
       coalesce(best.action, CASE WHEN bad_host.host IS NOT NULL OR bad_page.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN best ON u.page_id = best.page_id LEFT JOIN bad_host ON u.host = bad_host.host LEFT JOIN bad_page ON u.host = bad_page.host AND u.path = bad_page.path
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    before = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    out = line_dedup.line_dedup(docs.withColumn("n_lines", before))
    gone = F.aggregate(F.coalesce("removed", F.array().cast("array<struct<from:int,to:int>>")), F.lit(0).cast("long"), lambda a, x: a + x["to"] - x["from"] + 1)
    return out.select("doc_id", "n_lines", gone.alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


OP8_SQL = r"""
WITH l0 AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l1 AS (SELECT doc_id, unnest(range(len(ls))) AS no, unnest(ls) AS raw FROM l0),
l2 AS (SELECT doc_id, no, raw, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS l FROM l1),
l AS (
  SELECT doc_id, no, md5(l) AS l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS w, row_number() OVER o AS i,
         sum(len(regexp_extract_all(l, '[^\x20\x09-\x0D]+'))) OVER o AS e
  FROM l2 WHERE l <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY no)),
ahead AS (
  SELECT doc_id, i, max(i) OVER f AS j FROM l WINDOW f AS (PARTITION BY doc_id ORDER BY e - w RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)),
back AS (
  SELECT doc_id, min(i) OVER f AS i, i AS j FROM l WINDOW f AS (PARTITION BY doc_id ORDER BY e RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
runs AS (SELECT DISTINCT * FROM (SELECT * FROM ahead UNION ALL SELECT * FROM back)),
texts AS (
  SELECT r.doc_id, r.i, r.j, min(no) AS f, max(no) AS t, string_agg(l, ' ' ORDER BY l.i) AS s
  FROM runs r JOIN l ON r.doc_id = l.doc_id AND l.i BETWEEN r.i AND r.j GROUP BY r.doc_id, r.i, r.j HAVING sum(w) >= 50),
seen AS (
  SELECT *, first_value(doc_id) OVER o AS d0, first_value(i) OVER o AS i0, first_value(j) OVER o AS j0 FROM texts WINDOW o AS (PARTITION BY s ORDER BY doc_id, i)),
later AS (SELECT doc_id, f, t FROM seen WHERE doc_id <> d0 OR i > j0),
gone AS (SELECT DISTINCT doc_id, unnest(range(f, t + 1)) AS no FROM later),
kept AS (SELECT l1.doc_id, string_agg(raw, chr(10) ORDER BY l1.no) AS t FROM l1 ANTI JOIN gone ON l1.doc_id = gone.doc_id AND l1.no = gone.no GROUP BY l1.doc_id)
SELECT l0.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS text_sha256
FROM l0 LEFT JOIN kept ON l0.doc_id = kept.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g ON l0.doc_id = g.doc_id
"""


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source),
s1 AS (SELECT source, source_size, n, [5.0, 2.0, 1.0][(n - 1) % 3 + 1]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM s0),
s2 AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER o, 0.0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0.0)) AS rate FROM s1
  WINDOW o AS (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, round(least(cap, max(rate) OVER () * w), 6) AS target FROM s2),
l0 AS (SELECT source, CAST(length(bin(size)) AS DOUBLE) AS l, sum(size) AS sz FROM d GROUP BY 1, 2),
l1 AS (
  SELECT l0.source, l, target, coalesce(sum(sz) OVER o, 0) AS done,
         sum(sz * l) OVER (PARTITION BY l0.source) - coalesce(sum(sz * l) OVER o, 0.0) AS rest
  FROM l0 JOIN s ON l0.source IS NOT DISTINCT FROM s.source
  WINDOW o AS (PARTITION BY l0.source ORDER BY l DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT source, coalesce(max(CASE WHEN rest > 0 THEN (target - 2.0::DOUBLE * done) / rest END), 0.0) AS c FROM l1 GROUP BY source),
e AS (
  SELECT d.*, s.source_size, s.target, round(least(2.0::DOUBLE, c.c * CAST(length(bin(size)) AS DOUBLE)), 9) AS e,
         (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':7'), 1, 13) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source JOIN c ON d.source IS NOT DISTINCT FROM c.source),
q AS (SELECT *, CAST(floor(e) AS BIGINT) AS base, e - floor(e) AS p FROM e),
o AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM q),
r AS (
  SELECT *, target - sum(size * base) OVER (PARTITION BY source) AS room,
         sum(CASE WHEN q IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY q NULLS FIRST, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS upto FROM o)
SELECT doc_id, size, source_size, target,
       CAST(size * (base + CASE WHEN q IS NOT NULL AND upto - size / 2.0 <= room THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return quality_rules.quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
lines AS (
  SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
f AS (
  SELECT d.r, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep ON d.r = rep.r LEFT JOIN lines ON d.r = lines.r),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(CASE WHEN base_failed THEN 1 ELSE 0 END)::DOUBLE AS failed FROM b GROUP BY source),
m AS (SELECT sum(n) AS n, count(*) AS hosts, sum(failed) / sum(n) AS mean, sum(failed * failed / n) / sum(n) AS ff FROM h),
v AS (SELECT *, ff - mean * mean - mean * (1 - mean) * hosts / n AS btw FROM m),
s AS (
  SELECT least(greatest(mean, 1e-6), 1 - 1e-6) AS mean,
         CASE WHEN mean = 0 OR mean = 1 OR btw <= 0 THEN n / hosts ELSE greatest(1.0, mean * (1 - mean) / btw - 1) END AS k FROM v),
x AS (SELECT source, (failed + mean * k) / (n + k) - mean > 0.84 * sqrt(mean * (1 - mean) / (k + 1)) AS bad FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept
FROM b JOIN x ON b.source IS NOT DISTINCT FROM x.source
"""

def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(personal_data.spans_text(F.col("base")), 256).alias("base_sha256"),
        personal_data.spans_text(F.concat("base", "added")).alias("spans"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, term, count(*) AS c FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, sum(c)::HUGEINT AS lc FROM t GROUP BY lang, term HAVING count(*) >= 3),
c AS (SELECT t.lang, source, t.term, sum(c)::HUGEINT AS c, any_value(lc) AS lc FROM t JOIN kept ON t.lang = kept.lang AND t.term = kept.term GROUP BY ALL),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(lc)::HUGEINT AS ln FROM kept GROUP BY lang),
g AS (
  SELECT s.lang, s.source, coalesce(n, 0)::HUGEINT AS n, coalesce(v, 0)::HUGEINT AS v, coalesce(ln, 0)::HUGEINT AS ln
  FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL) x ON s.lang = x.lang AND s.source = x.source LEFT JOIN l ON s.lang = l.lang),
full_ AS (
  SELECT g.lang, g.source, kept.term, 1 + (1000000000 * (coalesce(c.c, 0) + 1)) // (g.n + g.v) AS p
  FROM g JOIN kept ON g.lang = kept.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM full_ a JOIN full_ b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
own AS (
  SELECT c.lang, c.source, c.term, 1 + (1000000000 * (c.c + 1)) // (g.n + g.v) AS p, 1 + (1000000000 * (c.lc + 1)) // (g.ln + g.v) AS q
  FROM c JOIN g ON c.lang = g.lang AND c.source = g.source),
every AS (
  SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM own WHERE p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM every
QUALIFY part = 'pair' OR rank <= 200
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


OP13_SQL = r"""
WITH p AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS s, count(*)::HUGEINT AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k) GROUP BY ALL),
n AS (SELECT lang, sum(f)::HUGEINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, s, f AS a, string_split(s, ' ') AS w FROM g WHERE k > 1 AND f >= 100),
longer AS (
  SELECT lang, s, max(a) AS most FROM (
    SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS s, a
    FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c))) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN longer ON c.lang = longer.lang AND c.s = longer.s WHERE most IS NULL OR 100 * most < 100 * a),
cuts AS (SELECT *, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS j FROM kept)),
sc AS (
  SELECT cuts.lang, cuts.s, a, n, j, gx.f AS l, gy.f AS r, 1000 * a * n // (gx.f * gy.f) AS score
  FROM cuts JOIN n ON n.lang = cuts.lang JOIN g gx ON gx.lang = cuts.lang AND gx.s = x JOIN g gy ON gy.lang = cuts.lang AND gy.s = y),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, s ORDER BY score, j) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, s) AS rank FROM best)
SELECT lang, rank, s AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""



def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_chat_format": op2_chat_format,
        "op3_secrets": op3_secrets,
        "op4_toxicity": op4_toxicity,
        "op5_decontamination": op5_decontamination,
        "op6_simhash": op6_simhash,
        "op7_url_filter": op7_url_filter,
        "op8_line_dedup": op8_line_dedup,
        "op9_mixing": op9_mixing,
        "op10_quality_rules": op10_quality_rules,
        "op11_personal_data": op11_personal_data,
        "op12_source_divergence": op12_source_divergence,
        "op13_collocations": op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": OP2_SQL, "op5_decontamination": OP5_SQL, "op7_url_filter": OP7_SQL, "op8_line_dedup": OP8_SQL, "op9_mixing": OP9_SQL, "op10_quality_rules": OP10_SQL,
            "op12_source_divergence": OP12_SQL, "op13_collocations": OP13_SQL}
