"""Queries over search and ranking: the benchmark texts are asked of the documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import documents as D
from tessera.operators import search as S
from tessera.operators import vectors as V
from tessera.operators.foods import portion_string
from tessera.plans.documents import units
from tessera.plans.registry import ordered_distinct, query, rows, table
from tessera.sources.scratch import materialize, new_path, spread

WORDS = "regexp_extract_all(lower(text), '[a-z0-9_+-]+')"
POSTINGS = f"p AS (SELECT doc_id, tok, count(*) AS tf FROM (SELECT doc_id, unnest({WORDS}) AS tok FROM documents) GROUP BY doc_id, tok)"
TERMS = f"qw AS (SELECT item_id, {WORDS} AS w FROM benchmark), qt AS (SELECT item_id, ({ordered_distinct('w')})[1:80] AS t FROM qw)"
BM25 = f"""{POSTINGS}, dl AS (SELECT doc_id, sum(tf) AS dl FROM p GROUP BY doc_id), st AS (SELECT avg(dl) AS m, count(*) AS n FROM dl),
{TERMS}, t AS (SELECT item_id, unnest(t[1:16]) AS tok FROM qt), f AS (SELECT tok, count(*) AS df FROM p GROUP BY tok),
sc AS (SELECT item_id, p.doc_id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / m)))), 6) AS score
  FROM t JOIN f ON t.tok = f.tok JOIN p ON p.tok = t.tok JOIN dl ON dl.doc_id = p.doc_id, st GROUP BY item_id, p.doc_id),
bm AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc)"""


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark")


@query("r1_postings", f"WITH {POSTINGS} SELECT tok, count(*) AS df, CAST(sum(tf) AS BIGINT) AS occurrences FROM p GROUP BY tok")
def r1(spark, sf_dir):
    return S.indexed(docs(spark, sf_dir)).tokens()


@query("r2_bm25", f"WITH {BM25} SELECT item_id, doc_id, score, rank FROM bm WHERE rank <= 10")
def r2(spark, sf_dir):
    """By an index that is built and searched at once."""
    return S.bm25(S.indexed(docs(spark, sf_dir)), asked(spark, sf_dir), 10).select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query("r3_substring", f"""
WITH {TERMS}, t AS (SELECT item_id, unnest(range(len(t[1:5]))) AS pos, unnest(t[1:5]) AS tok FROM qt),
h AS (SELECT item_id, doc_id, min(pos) AS pos FROM t JOIN documents ON contains(lower(text), tok) GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pos, doc_id) AS rank FROM h) SELECT item_id, doc_id, pos, rank FROM r WHERE rank <= 40""")
def r3(spark, sf_dir):
    return S.substring_hits(docs(spark, sf_dir), asked(spark, sf_dir)).select("item_id", "doc_id", F.col("pos").cast("long").alias("pos"), F.col("rank").cast("long").alias("rank"))


VECTORS = """q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 50 = 0), c AS (SELECT vec_id, label, embedding FROM embeddings),
s AS (SELECT query_id, vec_id, label, round(greatest(0, (list_cosine_similarity(qv::DOUBLE[], embedding::DOUBLE[]) + 1) / 2), 6) AS vector FROM q, c),
vt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vector DESC, vec_id) AS rank FROM s)"""


@query("r4_vector", f"WITH {VECTORS} SELECT query_id, vec_id, vector, rank FROM vt WHERE rank <= 10")
def r4(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return V.vector_top(e, e.filter("vec_id % 50 = 0"), 10).select("query_id", "vec_id", "vector", F.col("rank").cast("long").alias("rank"))


@query("r4_cells", f"WITH {VECTORS} SELECT query_id, vec_id, vector, rank FROM vt WHERE rank <= 10")
def r4_cells(spark, sf_dir):
    """The same by an index of cells: exact by the triangle inequality."""
    e = table(spark, sf_dir, "embeddings")
    index = V.write_cells(e, new_path(spark, "cells"))
    return V.search_cells(index, e.filter("vec_id % 50 = 0"), 10).select("query_id", "vec_id", "vector", F.col("rank").cast("long").alias("rank"))


def hashed_sql(name: str, key: str, source: str) -> str:
    """DuckDB: (key, bucket, v) of the scaled hashed vectors of a table's distinct words, as CTE name."""
    byte = lambda k: f"CAST('0x' || substr(sha256(tok), {2 * k + 1}, 2) AS BIGINT)"
    return f"""{name}0 AS (SELECT {key}, ({byte(0)} + {byte(1)} * 256 + {byte(2)} * 65536 + {byte(3)} * 16777216) % 32 AS bucket, sum(CASE WHEN {byte(4)} % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS v
  FROM (SELECT DISTINCT {key}, unnest({WORDS}) AS tok FROM {source}) GROUP BY 1, 2),
{name} AS (SELECT {key}, bucket, v / sqrt(sum(v * v) OVER (PARTITION BY {key})) AS v FROM {name}0 WHERE v <> 0)"""


@query("r5_fusion", f"""
WITH {BM25}, {hashed_sql('dv', 'doc_id', 'documents')}, {hashed_sql('qv', 'item_id', 'benchmark')},
cs AS (SELECT item_id, doc_id, sum(dv.v * qv.v) AS c FROM qv JOIN dv ON dv.bucket = qv.bucket GROUP BY 1, 2),
vs AS (SELECT item_id, doc_id, round(greatest(0, (coalesce(c, 0) + 1) / 2), 6) AS vector FROM benchmark CROSS JOIN documents LEFT JOIN cs USING (item_id, doc_id)),
vt AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY vector DESC, doc_id) AS rank FROM vs),
m AS (SELECT item_id, doc_id, max(lexical) AS lexical, max(vector) AS vector FROM (SELECT item_id, doc_id, 1.0::DOUBLE / rank AS lexical, 0.0::DOUBLE AS vector FROM bm WHERE rank <= 10 UNION ALL SELECT item_id, doc_id, 0.0, vector FROM vt WHERE rank <= 10) GROUP BY 1, 2)
SELECT item_id, doc_id, round(0.55::DOUBLE * lexical + 0.45::DOUBLE * vector, 6) AS score FROM m""")
def r5(spark, sf_dir):
    d, q = spread(docs(spark, sf_dir).select("doc_id", "text")), asked(spark, sf_dir)
    vector_of = T.hashed_vector(T.index_tokens(F.col("text"), None)).alias("embedding")
    near = V.vector_top(d.select(F.col("doc_id").alias("vec_id"), vector_of), q.select(F.col("item_id").alias("vec_id"), vector_of), 10)
    vector = near.select(F.col("query_id").alias("item_id"), F.col("vec_id").alias("doc_id"), "vector")
    return S.fuse(S.bm25(d, q, 10), vector, ["item_id", "doc_id"]).select("item_id", "doc_id", F.round("score", 6).alias("score"))


def chunks(spark, sf_dir):
    """The documents' chunks as search sees them: doc_id names the chunk; a written table."""
    c = D.chunk_documents(units(spark, sf_dir))
    return materialize(c.select(F.concat_ws(":", "doc_id", F.lpad(F.col("chunk_index").cast("string"), 6, "0")).alias("doc_id"), "text"), "chunks")


#: (place, trigger, phrase): what a query that holds the trigger is widened by.
TRIGGERS = [(0, "the", "of the"), (1, "und", "der die das"), (2, "que", "de la"), (3, "tion", "nation")]


BOOSTS = [(r"\|", "*", 0.55), ("Licensed", "*", 0.18), ("tion", "+", 0.25)]


@query("r6_rescored", f"""
WITH {BM25}, x AS (SELECT item_id, bm.doc_id, rank, 1.0::DOUBLE / rank * CASE WHEN contains(text, '|') THEN 0.55::DOUBLE ELSE 1 END * CASE WHEN contains(text, 'Licensed') THEN 0.18::DOUBLE ELSE 1 END + CASE WHEN contains(text, 'tion') THEN 0.25::DOUBLE ELSE 0 END AS s
  FROM bm JOIN documents d ON d.doc_id = bm.doc_id WHERE rank <= 10)
SELECT item_id, doc_id, round(s, 6) AS score FROM x""")
def r6(spark, sf_dir):
    d = docs(spark, sf_dir)
    found = S.bm25(d, asked(spark, sf_dir), 10).select("item_id", "doc_id", "lexical").join(d.select("doc_id", "text"), "doc_id")
    return found.select("item_id", "doc_id", F.round(S.rescored(F.col("lexical"), F.col("text"), BOOSTS), 6).alias("score"))


#: (query's pattern, source's pattern, text's pattern, op, value)
GATED = [("the", "src1", "", "*", 1.5), ("", "^src2$", "tion", "+", 0.25), ("of", "", r"\|", "*", 0.55)]


@query("r6_gated", f"""
WITH {BM25}, x AS (SELECT bm.item_id, bm.doc_id, 1.0::DOUBLE / rank AS s, b.text AS q, d.source, d.text FROM bm JOIN documents d ON d.doc_id = bm.doc_id JOIN benchmark b ON b.item_id = bm.item_id WHERE rank <= 10),
y AS (SELECT *, CASE WHEN contains(q, 'the') AND contains(source, 'src1') THEN s * 1.5::DOUBLE ELSE s END AS s1 FROM x),
z AS (SELECT *, CASE WHEN source = 'src2' AND contains(text, 'tion') THEN s1 + 0.25::DOUBLE ELSE s1 END AS s2 FROM y)
SELECT item_id, doc_id, round(CASE WHEN contains(q, 'of') AND contains(text, '|') THEN s2 * 0.55::DOUBLE ELSE s2 END, 6) AS score FROM z""")
def r6_gated(spark, sf_dir):
    """Rules that look at the query, the source and the text."""
    d, q = docs(spark, sf_dir), asked(spark, sf_dir)
    found = S.bm25(d, q, 10).select("item_id", "doc_id", "lexical").join(d.select("doc_id", "text", "source"), "doc_id").join(q.select("item_id", F.col("text").alias("query")), "item_id")
    score = S.rescored(F.col("lexical"), F.col("text"), GATED, F.col("query"), F.col("source"))
    return found.select("item_id", "doc_id", F.round(score, 6).alias("score"))


@query("r7_diverse_top")
def r7(spark, sf_dir):
    """By all tokens of the queries and of the chunks."""
    c = chunks(spark, sf_dir)
    found = S.with_text(S.bm25(c, asked(spark, sf_dir), 40, None), c)
    return S.diverse_top(found.select("item_id", "doc_id", F.col("lexical").alias("score"), T.index_tokens(F.col("text"), None).alias("tokens")), "item_id").withColumnRenamed("doc_id", "chunk_id")


@query("r8_hybrid")
def r8(spark, sf_dir):
    triggers = rows(spark, "place int, trigger string, phrase string", TRIGGERS)
    return S.hybrid(chunks(spark, sf_dir), asked(spark, sf_dir), BOOSTS, triggers).withColumnRenamed("doc_id", "chunk_id")


@query("r9_idf_rank", f"""
WITH d AS (SELECT doc_id, {WORDS} AS w, regexp_extract_all(lower(source), '[a-z0-9_+-]+') AS s FROM documents),
b AS (SELECT DISTINCT doc_id, unnest(w) AS tok FROM d), ti AS (SELECT DISTINCT doc_id, unnest(s) AS tok FROM d), n AS (SELECT count(*) AS n FROM documents),
f AS (SELECT tok, count(*) AS df FROM b GROUP BY tok), {TERMS}, t AS (SELECT item_id, unnest(t) AS tok FROM qt),
a AS (SELECT doc_id, tok, sum(w) AS w FROM (SELECT doc_id, tok, 1.0 AS w FROM b UNION ALL SELECT doc_id, tok, 3.0 FROM ti) GROUP BY 1, 2),
sc AS (SELECT item_id, doc_id, round(sum(w * (ln((n + 1) / (coalesce(df, 1) + 1)) + 1)), 6) AS score FROM t JOIN a ON t.tok = a.tok LEFT JOIN f ON f.tok = a.tok, n GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0) SELECT item_id, doc_id, score, rank FROM r WHERE rank <= 10""")
def r9(spark, sf_dir):
    found = S.idf_rank(docs(spark, sf_dir), asked(spark, sf_dir), {"text": 1.0, "source": 3.0})
    return found.select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


RECORDS = """rec AS (
  SELECT 'part' AS type, p_partkey AS id, p_name AS title, lower(p_name || ' ' || p_brand || ' ' || p_type) AS t FROM part
  UNION ALL SELECT 'supplier', s_suppkey, s_name, lower(s_name || ' ' || n_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'customer', c_custkey, c_name, lower(c_name || ' ' || c_mktsegment) FROM customer)"""


def records(spark, sf_dir):
    part, supplier, nation, customer = (table(spark, sf_dir, t) for t in ("part", "supplier", "nation", "customer"))
    p = part.select(F.lit("part").alias("type"), F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("search_text"))
    s = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).select(F.lit("supplier").alias("type"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.concat_ws(" ", "s_name", "n_name").alias("search_text"))
    c = customer.select(F.lit("customer").alias("type"), F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("search_text"))
    return p.unionByName(s).unionByName(c)


def asked_records(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.concat_ws(" ", "p_name", "p_brand").alias("text")).filter("item_id % 50 = 0")


ASKED = r"""q AS (SELECT p_partkey AS item_id, list_concat(regexp_extract_all(lower(p_name || ' ' || p_brand), '[a-z0-9_.+-]+'), regexp_extract_all(lower(p_name || ' ' || p_brand), '\d+(?:\.\d+)?')) AS w FROM part WHERE p_partkey % 50 = 0),
t AS (SELECT DISTINCT item_id, unnest(w) AS tok FROM q), u AS (SELECT * FROM t),
x AS (SELECT item_id, type, id, tok, lower(title) AS title, least((length(t) - length(replace(t, tok, ''))) / length(tok), 4.0) * CASE WHEN regexp_matches(tok, '\d') THEN 4.0 WHEN tok IN ('bmi', 'met') THEN 5.0 ELSE 2.5 END AS s FROM u JOIN rec ON contains(t, tok)),
g AS (SELECT item_id, type, id, round(sum(s) + max(CASE WHEN title = tok THEN 40.0 WHEN contains(title, tok) THEN 18.0 ELSE 0.0 END), 4) AS score FROM x GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, type, id) AS rank FROM g)"""


@query("r10_structured_search", f"WITH {RECORDS}, {ASKED} SELECT item_id, type, id, score, rank FROM r WHERE rank <= 10")
def r10(spark, sf_dir):
    found = S.structured_search(records(spark, sf_dir), asked_records(spark, sf_dir))
    return found.select("item_id", "type", "id", "score", F.col("rank").cast("long").alias("rank"))


@query("r11_source_views", """
SELECT o_orderkey AS id, o_orderpriority AS title, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS search_text
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY o_orderkey, o_orderpriority""")
def r11(spark, sf_dir):
    o, li, p = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    j = o.join(li, o["o_orderkey"] == li["l_orderkey"], "left").join(p, li["l_partkey"] == p["p_partkey"], "left")
    types = F.nullif(F.array_join(F.array_sort(F.collect_set("p_type")), ", "), F.lit(""))
    return j.groupBy(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title")).agg(types.alias("search_text"))


@query("r11_every_source", """
WITH l AS (SELECT l_orderkey, string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS dishes, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS parts FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
v AS (SELECT 'part' AS type, p_partkey AS id, p_name AS title, 'brand: ' || p_brand || '; size: ' || p_size AS content, p_type AS more FROM part
  UNION ALL SELECT 'nation', n_nationkey, n_name, 'region: ' || r_name, NULL FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'supplier', s_suppkey, s_name, 'nation: ' || n_name, NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'customer', c_custkey, c_name, 'segment: ' || c_mktsegment || '; nation: ' || n_name, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'line', l_orderkey * 10 + l_linenumber, p_name, 'flag: ' || l_returnflag || '; status: ' || l_linestatus, p_type FROM lineitem JOIN part ON l_partkey = p_partkey
  UNION ALL SELECT 'order', o_orderkey, o_orderpriority, concat_ws('; ', 'status: ' || o_orderstatus, 'holds: ' || dishes), parts FROM orders LEFT JOIN l ON l_orderkey = o_orderkey
  UNION ALL SELECT 'event', event_id, event_type, 'user: ' || user_id, props FROM events)
SELECT type, id::BIGINT AS id, title, content, md5(concat_ws(' ', title, CASE WHEN type = 'order' THEN coalesce(more, '') ELSE more END, content)) AS search_md5 FROM v""")
def r11_every_source(spark, sf_dir):
    """Seven kinds of records as one table; an order has the distinct names and types of its lines' parts."""
    t = {n: table(spark, sf_dir, n) for n in ("part", "nation", "region", "supplier", "customer", "lineitem", "orders", "events")}
    nation = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    lines = t["lineitem"].join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
    orders = S.distinct_lists(t["orders"].withColumnRenamed("o_orderkey", "l_orderkey"), lines, "l_orderkey", ["p_name", "p_type"])
    c = F.col
    views = [S.source_view(t["part"], "part", "p_partkey", c("p_name"), [("brand: ", c("p_brand")), ("size: ", c("p_size"))], [c("p_type")]),
             S.source_view(nation, "nation", "n_nationkey", c("n_name"), [("region: ", c("r_name"))], []),
             S.source_view(t["supplier"].join(t["nation"], c("s_nationkey") == c("n_nationkey")), "supplier", "s_suppkey", c("s_name"), [("nation: ", c("n_name"))], []),
             S.source_view(t["customer"].join(t["nation"], c("c_nationkey") == c("n_nationkey")), "customer", "c_custkey", c("c_name"), [("segment: ", c("c_mktsegment")), ("nation: ", c("n_name"))], []),
             S.source_view(lines.withColumn("id", c("l_orderkey") * 10 + c("l_linenumber")), "line", "id", c("p_name"), [("flag: ", c("l_returnflag")), ("status: ", c("l_linestatus"))], [c("p_type")]),
             S.source_view(orders, "order", "l_orderkey", c("o_orderpriority"), [("status: ", c("o_orderstatus")), ("holds: ", c("p_name"))], [c("p_type")]),
             S.source_view(t["events"], "event", "event_id", c("event_type"), [("user: ", c("user_id"))], [c("props")])]
    every = reduce(DataFrame.unionByName, [v.withColumn("id", c("id").cast("long")) for v in views])
    return every.select("type", "id", "title", "content", F.md5("search_text").alias("search_md5"))


@query("r12_adjusted", rf"""
WITH {RECORDS}, {ASKED},
j AS (SELECT r.item_id, r.type, r.id, r.score, lower(p.p_name || ' ' || p.p_brand) AS q, lower(rec.title) AS title, rec.t, replace(lower(p.p_name), ' ', '') AS topic, coalesce(lower(l.p_type), '') AS label
  FROM r JOIN part p ON p.p_partkey = r.item_id JOIN rec ON rec.type = r.type AND rec.id = r.id LEFT JOIN part l ON r.type = 'part' AND l.p_partkey = r.id WHERE rank <= 10),
a AS (SELECT *, score + CASE WHEN label = topic THEN 40 WHEN contains(label, topic) OR label <> '' AND contains(topic, label) THEN 18 WHEN contains(t, topic) THEN 30 ELSE 0 END
  + CASE WHEN title = topic THEN 20 WHEN contains(q, title) OR contains(title, topic) THEN 10 ELSE 0 END AS s FROM j),
b AS (SELECT *, CASE WHEN contains(q, 'red') AND contains(t, 'economy') THEN s * 0.25 ELSE s END AS s2 FROM a)
SELECT item_id, type, id, round(CASE WHEN type IN ('supplier', 'customer') THEN s2 + 2.5 ELSE s2 END, 4) AS adjusted FROM b""")
def r12(spark, sf_dir):
    asked = asked_records(spark, sf_dir)
    found = S.structured_search(records(spark, sf_dir), asked).join(records(spark, sf_dir), ["type", "id"])
    found = found.join(asked.select("item_id", F.col("text").alias("query")), "item_id")
    labels = table(spark, sf_dir, "part").select(F.lit("part").alias("type"), F.col("p_partkey").alias("id"), F.col("p_type").alias("label"))
    found = found.join(labels, ["type", "id"], "left").withColumnRenamed("search_text", "text")
    score = S.adjusted(found, [r"brand#\d+"], [("red", "economy", [], 0.25, 0.0), ("", "", ["supplier", "customer"], 1.0, 2.5)])
    return found.select("item_id", "type", "id", F.round(score, 4).alias("adjusted"))


TAGS = {"warm": ["red", "orange"], "cold": ["blue", "green"], "part": ["widget", "gear"]}


@query("r13_domain_tags", """SELECT p_partkey, concat_ws(' ', CASE WHEN contains(p_name, 'red') OR contains(p_name, 'orange') THEN 'warm' END,
  CASE WHEN contains(p_name, 'blue') OR contains(p_name, 'green') THEN 'cold' END, CASE WHEN contains(p_name, 'widget') OR contains(p_name, 'gear') THEN 'part' END) AS tags FROM part""")
def r13(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(S.domain_tags(F.col("p_name"), TAGS), " ").alias("tags"))


LOOKUP = """q AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN p_brand ELSE substr(p_name, 1, 4) END AS q FROM part WHERE p_partkey % 50 = 0),
c AS (SELECT p_partkey AS id, lower(p_name) AS name, p_size % 3 AS st, CASE WHEN p_type LIKE '%POLISHED%' THEN 1 WHEN p_type LIKE '%BRUSHED%' THEN 2 ELSE 0 END AS pt, lower(p_brand) AS alias FROM part),
e AS (SELECT q, id, name, st, pt, 0 AS tier FROM q JOIN c ON lower(q) = name UNION ALL SELECT q, id, name, st, pt, 1 FROM q JOIN c ON lower(q) = alias),
l AS (SELECT q, id, name, st, pt, CASE WHEN starts_with(name, lower(q)) THEN 2 ELSE 3 END AS tier FROM q JOIN c ON contains(name, lower(q)) OR contains(alias, lower(q))),
m AS (SELECT q, id, min(tier) AS tier, min(st) AS st, min(pt) AS pt, min(name) AS name FROM (SELECT * FROM e UNION ALL SELECT * FROM l) GROUP BY q, id),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY tier, st, pt, length(name), id) AS rank FROM m)"""


def looked_up(spark, sf_dir, top):
    p = table(spark, sf_dir, "part")
    q = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.col("p_brand")).otherwise(F.substring("p_name", 1, 4))
    names = p.filter("p_partkey % 50 = 0").select(q.alias("q"))
    processing = F.when(F.contains("p_type", F.lit("POLISHED")), 1).when(F.contains("p_type", F.lit("BRUSHED")), 2).otherwise(0)
    catalogue = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_size") % 3).alias("source_tier"), processing.alias("processing_tier"))
    aliases = p.select(F.col("p_brand").alias("alias"), F.col("p_partkey").alias("id"))
    return S.tiered_lookup(names, catalogue, aliases, top, ("source_tier", "processing_tier"))


@query("r14_tiered_lookup", f"WITH {LOOKUP} SELECT q, id, tier FROM r WHERE rank = 1")
def r14(spark, sf_dir):
    return looked_up(spark, sf_dir, 1).select("q", "id", "tier")


@query("r14_tiered_top", f"WITH {LOOKUP} SELECT q, id, tier, rank FROM r WHERE rank <= 5")
def r14_top(spark, sf_dir):
    return looked_up(spark, sf_dir, 5).select("q", "id", "tier", F.col("rank").cast("long").alias("rank"))


@query("r14_foods_with_portions", f"""
WITH {LOOKUP}, p AS (SELECT l_partkey AS id, string_agg(DISTINCT l_returnflag || '=' || l_quantity || 'g', '; ' ORDER BY l_returnflag || '=' || l_quantity || 'g') AS portions FROM lineitem GROUP BY 1)
SELECT q, r.id, tier, rank, coalesce(portions, '') AS portions FROM r LEFT JOIN p ON r.id = p.id WHERE rank <= 3""")
def r14_foods(spark, sf_dir):
    found = looked_up(spark, sf_dir, 3)
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "id").join(S.small(found.select("id").distinct()), "id", "left_semi")
    portions = lines.groupBy("id").agg(portion_string(F.col("l_returnflag"), F.col("l_quantity")).alias("portions"))
    return found.join(portions, "id", "left").select("q", "id", "tier", F.col("rank").cast("long").alias("rank"), F.coalesce("portions", F.lit("")).alias("portions"))


@query("r15_recall_memories", """
WITH m AS (SELECT vec_id AS id, vec_id // 50 AS user_id, CASE label % 3 WHEN 0 THEN 'factual' WHEN 1 THEN 'semantic' ELSE 'episodic' END AS layer, (vec_id % 97) / 100.0 AS weight, embedding FROM embeddings),
q AS (SELECT vec_id // 50 AS user_id, embedding AS qe FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT m.user_id, id, layer, round(list_cosine_similarity(qe::DOUBLE[], embedding::DOUBLE[]) + weight + CASE layer WHEN 'factual' THEN 0.25 WHEN 'semantic' THEN 0.18 ELSE 0.12 END, 4) AS score FROM m JOIN q ON m.user_id = q.user_id WHERE weight >= 0.1),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, layer ORDER BY score DESC, id) AS rank FROM s)
SELECT user_id, id, layer, score, rank FROM r WHERE rank <= CASE layer WHEN 'factual' THEN 6 ELSE 4 END""")
def r15(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    layer = F.when(F.col("label") % 3 == 0, "factual").when(F.col("label") % 3 == 1, "semantic").otherwise("episodic")
    user = F.floor(F.col("vec_id") / 50).alias("user_id")
    m = e.select(F.col("vec_id").alias("id"), user, layer.alias("layer"), ((F.col("vec_id") % 97) / 100.0).alias("weight"), "embedding")
    found = S.recall_memories(m, e.filter("vec_id % 50 = 0").select(user, "embedding"))
    return found.select("user_id", "id", "layer", "score", F.col("rank").cast("long").alias("rank"))


@query("r16_page_relevance", "SELECT l_orderkey, l_linenumber, l_partkey % 20 <= 9 AND l_partkey % 20 + l_linenumber >= 5 AS relevant FROM lineitem")
def r16(spark, sf_dir):
    start = (F.col("l_partkey") % 20).cast("int")
    span = F.sequence(start, start + F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.arrays_overlap(span, F.sequence(F.lit(5), F.lit(9))).alias("relevant"))


@query("r17_fuzzy_match", """
WITH q AS (SELECT DISTINCT substr(p_name, 1, CAST(k AS INT)) || substr(p_name, CAST(k AS INT) + 2) AS q FROM (SELECT p_name, (p_partkey // 50) % 8 AS k FROM part WHERE p_partkey % 50 = 0)), c AS (SELECT p_partkey AS id, p_name AS name FROM part),
s AS (SELECT q, id, name, round(1 - levenshtein(q, name) / greatest(length(q), length(name)), 6) AS ratio FROM q, c),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY ratio DESC, name, id) AS n FROM s WHERE ratio >= 0.4) SELECT q, id, name, ratio FROM r WHERE n = 1""")
def r17(spark, sf_dir):
    """Names with a letter left out, its place going from the first to the eighth."""
    p = table(spark, sf_dir, "part")
    k = (F.floor(F.col("p_partkey") / 50) % 8).cast("int")
    named = p.filter("p_partkey % 50 = 0").select(F.concat(F.substring("p_name", F.lit(1), k), F.substring("p_name", k + 2, F.length("p_name"))).alias("q"))
    return S.fuzzy_match(named, p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))
