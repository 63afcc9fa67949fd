"""Headings that only look like some, and searches whose work is that of distinct classes."""

from __future__ import annotations

import numpy as np

from tessera.operators import grams, vectors
from tessera.operators import search as S
from tessera.plans import documents as PD
from tessera.plans import foods as PF


def test_a_line_that_begins_with_an_address_is_no_heading(spark, tmp_path):
    spark.createDataFrame([(1, "56.187.231.175 said\nmore")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["no"]: (r["section"], r["path"]) for r in PD.d4(spark, str(tmp_path)).collect()}
    assert got == {n: ("Part 0", "Part 0") for n in (0, 1, 3)}


def test_equal_queries_and_equal_records_are_scored_once(spark, monkeypatch):
    pairs = []
    monkeypatch.setattr(S, "containing", lambda *a: pairs.append(grams.containing(*a)) or pairs[-1])
    records = spark.createDataFrame([(k, i, f"{w} {i % 3}", f"{w} of all {i % 3}") for k in ("a", "b") for w, n in (("red", 0), ("blue", 40)) for i in range(n, n + 40)], "type string, id long, title string, search_text string")
    asked = spark.createDataFrame([(i, "red 1" if i % 2 else "all") for i in range(60)], "item_id long, text string")
    got = {}
    for r in S.structured_search(records, asked, 5).orderBy("item_id", "rank").collect():
        got.setdefault(r["item_id"], []).append((r["type"], r["id"], r["score"]))
    red = [("a", i, 24.5) for i in range(1, 40, 3)][:5]
    assert got == {i: red if i % 2 else [("a", j, 2.5) for j in range(5)] for i in range(60)}
    # 160 records that hold "all", 80 "red" and 54 "1": queries do not multiply them.
    assert pairs[0].count() < 60 * 160


def test_texts_that_are_found_in_do_not_go_through_a_shuffle(spark):
    texts = spark.createDataFrame([(i, "some text of many words") for i in range(50)], "id long, t string")
    tokens = spark.createDataFrame([("text",), ("words",), ("word",), ("many w",)], "tok string")
    found = grams.containing(texts, tokens, "t", "tok")
    assert found.count() == 200
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def test_many_tokens_are_looked_up_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(grams, "BROADCAST_ROWS", 2)
    texts = spark.createDataFrame([(1, "some text"), (1, "some text"), (2, "other words"), (3, "te")], "id long, t string")
    tokens = spark.createDataFrame([("text",), ("words",), ("ext",), ("te",), ("none",)], "tok string")
    got = sorted((r["id"], r["tok"]) for r in grams.containing(texts, tokens, "t", "tok").collect())
    assert got == [(1, "ext"), (1, "ext"), (1, "te"), (1, "te"), (1, "text"), (1, "text"), (2, "words"), (3, "te")]


def test_first_documents_of_a_query_by_token_then_document(spark):
    docs = spark.createDataFrame([(i, "alpha beta" if i % 2 else "beta") for i in range(30)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "beta alpha")], "item_id long, text string")
    got = sorted((r["item_id"], r["rank"], r["doc_id"], r["pos"]) for r in S.substring_hits(docs, asked, 20).collect())
    first = [(d, 0) for d in range(1, 30, 2)] + [(d, 1) for d in range(0, 30, 2)]
    assert got == [(1, n + 1, *x) for n, x in enumerate(first[:20])] + [(2, n + 1, d, 0) for n, d in enumerate(range(20))]


def test_a_product_of_vectors_is_bounded(monkeypatch):
    rng = np.random.default_rng(3)
    rows, queries = vectors.shown(rng.normal(size=(500, 8))), rng.normal(size=(40, 8))
    shapes, add = [], vectors._Best.add
    monkeypatch.setattr(vectors, "PRODUCT", 40 * 64)
    monkeypatch.setattr(vectors._Best, "add", lambda self, scores, ids: shapes.append(scores.size) or add(self, scores, ids))
    best = vectors._Best(40, 5)
    best.meet(rows, queries, np.arange(500))
    assert max(shapes) <= 40 * 64 and len(shapes) == 8
    for q, scores in enumerate(vectors.shown(rows @ queries.T).T):
        assert best.ids[q].tolist() == np.lexsort((np.arange(500), -scores))[:5].tolist()


def test_meals_are_read_on_all_cores(spark):
    """A table of parts is one small file, and reading a meal is what takes time."""
    assert PF.f6(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
