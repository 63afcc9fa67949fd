"""Queries over evaluation: a document is relevant to a benchmark text if it holds ten words of it in a row."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import evaluation as V
from tessera.operators import search as S
from tessera.plans.registry import query, table
from tessera.plans.search import BM25, WORDS
from tessera.sources.scratch import materialize

MEASURED = f"""{BM25}, bw AS (SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, {WORDS} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM bw)),
dw AS (SELECT doc_id, {WORDS} AS w FROM documents),
rel AS (SELECT DISTINCT item_id, doc_id FROM (SELECT doc_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)) x JOIN iw ON iw.n = x.n AND iw.s = x.s),
h AS (SELECT bm.item_id, min(rank) FILTER (rel.doc_id IS NOT NULL) AS first, count(rel.doc_id) AS found FROM bm LEFT JOIN rel ON rel.item_id = bm.item_id AND rel.doc_id = bm.doc_id WHERE rank <= 6 GROUP BY 1),
e AS (SELECT b.item_id, coalesce(first <= 1, false) AS hit_1, coalesce(first <= 3, false) AS hit_3, coalesce(first <= 4, false) AS hit_4, coalesce(first <= 6, false) AS hit_6, round(coalesce(1 / first, 0), 6) AS mrr, round(coalesce(found, 0) / 6, 6) AS precision
  FROM benchmark b LEFT JOIN h ON h.item_id = b.item_id)"""


def measured(spark, sf_dir):
    docs, asked = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return V.ranked_measures(asked, S.bm25(docs, asked, 6), V.sharing_passages(docs, asked))


def cases(spark, sf_dir):
    m = measured(spark, sf_dir)
    return m.withColumn("passed", F.col("hit_6")).withColumn("manual", F.col("item_id") % 8 == 0).withColumn("category", F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd"))


@query("v1_measures", f"""WITH {MEASURED}, pr AS (SELECT item_id, min(doc_id) AS doc_id FROM rel GROUP BY item_id)
SELECT e.*, coalesce(t.doc_id = pr.doc_id, false) AS preferred_top1 FROM e LEFT JOIN pr ON pr.item_id = e.item_id LEFT JOIN (SELECT item_id, doc_id FROM bm WHERE rank = 1) t ON t.item_id = e.item_id""")
def v1(spark, sf_dir):
    """The preferred result of an item is its first relevant document."""
    docs, asked = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    relevant = materialize(V.sharing_passages(docs, asked), "relevant")
    preferred = relevant.groupBy("item_id").agg(F.min("doc_id").alias("doc_id"))
    return V.ranked_measures(asked, materialize(S.bm25(docs, asked, 6), "results"), relevant, preferred=preferred)


@query("v2_keyword_coverage", """
SELECT doc_id, (CASE WHEN contains(t, 'the') THEN 1 ELSE 0 END + CASE WHEN contains(t, 'ofthe') THEN 1 ELSE 0 END + CASE WHEN contains(t, 'und') THEN 1 ELSE 0 END) >= 2 AS covered,
  (CASE WHEN contains(t, 'the') THEN 1 ELSE 0 END + CASE WHEN contains(t, 'ofthe') THEN 1 ELSE 0 END + CASE WHEN contains(t, 'und') THEN 1 ELSE 0 END) >= 1 AS covered_v1
FROM (SELECT doc_id, regexp_replace(lower(text), '[\\s‐-―-]+', '', 'g') AS t FROM documents)""".replace("\\\\", "\\"))
def v2(spark, sf_dir):
    k = F.array(*[F.lit(x) for x in ("the", "of-the", "und")])
    return table(spark, sf_dir, "documents").select("doc_id", V.covered(k, F.col("text")).alias("covered"), V.covered(k, F.col("text"), False).alias("covered_v1"))


@query("v3_failure_class", f"""
WITH {MEASURED} SELECT item_id, CASE WHEN hit_6 THEN CASE WHEN item_id % 4 = 0 THEN 'missing_keywords' WHEN item_id % 4 = 1 THEN 'table_pollution' ELSE '' END ELSE 'wrong_document' END AS failure FROM e""")
def v3(spark, sf_dir):
    m = measured(spark, sf_dir)
    return m.select("item_id", V.failure_class(F.lit(6), F.col("hit_6"), F.col("item_id") % 4 != 0, F.col("item_id") % 4 == 1).alias("failure"))


RATES = "count(*) AS total, count(*) FILTER (item_id % 8 <> 0) AS automated, round(coalesce(avg(hit_6::INT) FILTER (item_id % 8 <> 0), 0), 4) AS pass_rate, round(coalesce(avg(hit_6::INT) FILTER (item_id % 8 <> 0), 0), 4) AS hit_at_6, round(coalesce(avg(hit_3::INT) FILTER (item_id % 8 <> 0), 0), 4) AS recall_at_3, round(coalesce(avg(mrr) FILTER (item_id % 8 <> 0), 0), 4) AS mrr"


@query("v4_summary", f"WITH {MEASURED}, c AS (SELECT *, CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS category FROM e) SELECT category, {RATES} FROM c GROUP BY ROLLUP (category)")
def v4(spark, sf_dir):
    return V.summary(cases(spark, sf_dir), "category")


@query("v5_targets", f"""
WITH {MEASURED}, s AS (SELECT {RATES} FROM e)
SELECT 'hit_at_6' AS metric, hit_at_6 AS value, 0.95::DOUBLE AS target, hit_at_6 >= 0.95 AS met FROM s UNION ALL SELECT 'recall_at_3', recall_at_3, 0.85, recall_at_3 >= 0.85 FROM s UNION ALL SELECT 'mrr', mrr, 0.5, mrr >= 0.5 FROM s""")
def v5(spark, sf_dir):
    return V.against_targets(V.summary(cases(spark, sf_dir)), {"hit_at_6": 0.95, "recall_at_3": 0.85, "mrr": 0.5})


@query("v6_latency", """
WITH r AS (SELECT event_type, count(*) AS runs, count(*) FILTER (value > 5 AND event_id % 9 <> 0) AS valid, sum(CAST(value AS DECIMAL(18,4))) FILTER (value > 5 AND event_id % 9 <> 0) AS t FROM events GROUP BY 1)
SELECT event_type, runs, valid, t::DOUBLE / valid AS mean, CASE WHEN valid < 0.3 * runs THEN 'failed' ELSE 'ok' END AS state FROM r""")
def v6(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return V.latency_rollup(e, "event_type", "value", (F.col("value") > 5) & (F.col("event_id") % 9 != 0))


@query("v7_run_rollup", "SELECT event_type, CAST(grouping(event_type) AS BIGINT) AS is_total, count(*) AS turns, sum(CAST(value AS DECIMAL(18,2)))::DOUBLE AS total_ms, round(avg((value > 30)::INT), 4) AS pass_rate FROM events GROUP BY ROLLUP (event_type)")
def v7(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.rollup("event_type").agg(F.grouping("event_type").cast("long").alias("is_total"), F.count("*").alias("turns"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total_ms"), F.round(F.avg((F.col("value") > 30).cast("int")), 4).alias("pass_rate"))
