"""The stored index, vector search by batches and cells, and the gram index, against plain Python."""

from __future__ import annotations

import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import grams, vectors
from tessera.operators import index as I
from tessera.operators import search as S
from tests.test_search_brute import brute_bm25

SF = "/root/testdata/sf0.001"


def texts_of(n, seed=3):
    """Words by a steep law, so that some are in nearly every text and most in few."""
    rng = random.Random(seed)
    return {i: " ".join(f"w{min(int(rng.paretovariate(0.6)), 400)}" for _ in range(rng.randrange(1, 90))) for i in range(n)}


def queries_of(texts, n=12, seed=5):
    rng = random.Random(seed)
    return {q: " ".join(rng.sample(texts[rng.choice(list(texts))].split(), 1) + rng.choices([w for t in texts.values() for w in t.split()], k=rng.randrange(2, 12))) for q in range(n)}


def frames(spark, texts, queries):
    return (spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(queries.items()), "item_id long, text string"))


def searched(index, q, top):
    found = S.bm25(index, q, top).collect()
    out = {k: {} for k in {r["item_id"] for r in found}}
    for r in found:
        out[r["item_id"]][r["doc_id"]] = 1 / r["rank"]
    return out


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    texts = texts_of(3000)
    queries = queries_of(texts)
    d, q = frames(spark, texts, queries)
    return texts, queries, q, I.write_index(d, f"{tmp_path_factory.mktemp('index')}/a")


@pytest.mark.parametrize("top", [1, 10, 5000])
def test_search_is_exact(corpus, top):
    texts, queries, q, index = corpus
    assert searched(index, q, top) == brute_bm25(texts, queries, top)


def test_fewer_postings_are_scored_than_exist(corpus):
    texts, queries, q, index = corpus
    plan = I.plan_search(index, S.query_terms(q).select("item_id", "tok"), 10)
    scored = plan.candidates.agg(F.sum("n")).first()[0]
    words = {i: set(t.split()) for i, t in texts.items()}
    every = sum(1 for t in queries.values() for w in dict.fromkeys(t.split()) for ws in words.values() if w in ws)
    assert 0 < scored < every / 2


def test_documents_are_added_without_a_rebuild(spark, tmp_path):
    texts = texts_of(400, seed=9)
    first, rest = {k: t for k, t in texts.items() if k < 300}, {k: t for k, t in texts.items() if k >= 300}
    queries = queries_of(texts)
    d, q = frames(spark, first, queries)
    path = f"{tmp_path}/b"
    I.write_index(d, path)
    before = {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    index = I.write_index(frames(spark, rest, queries)[0], path)
    assert searched(index, q, 8) == brute_bm25(texts, queries, 8)
    after = {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    assert before.items() <= after.items() and len(after) > len(before)
    df = Counter(w for t in texts.values() for w in set(t.split()))
    assert {r["tok"]: (r["df"], r["occurrences"]) for r in index.tokens().collect()} == {w: (n, sum(t.split().count(w) for t in texts.values())) for w, n in df.items()}


def test_index_of_nothing_and_of_odd_texts(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a b"), (2, None)], "item_id long, text string")
    assert S.bm25(I.write_index(none, f"{tmp_path}/none"), q).count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (4, "a " * 50000), (None, "b")], "doc_id long, text string")
    found = S.bm25(I.write_index(odd, f"{tmp_path}/odd"), q).collect()
    assert {(r["item_id"], r["doc_id"]) for r in found} == {(1, 4), (1, None)}


# Vectors

def brute_top(rows, queries, top):
    out = {}
    for q, v in queries:
        if v is None:
            continue
        scored = []
        for i, x in rows:
            if x is None or len(x) != len(v) or not len(v):
                continue
            n = np.linalg.norm(x) * np.linalg.norm(v)
            scored.append((-round(max(0.0, (np.dot(x, v) / n + 1) / 2 if n else 0.5), 6), i))
        out |= {(q, i): (-s, k) for k, (s, i) in enumerate(sorted(scored)[:top], 1)}
    return out


def vector_rows(n=700, dims=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    rows = [(i, (centres[rng.integers(12)] + 0.15 * rng.normal(size=dims)).tolist()) for i in range(n)]
    return [*rows, (n, [0.0] * dims), (n + 1, None), (n + 2, [1.0, 2.0]), (n + 3, rows[3][1]), (n + 4, rows[3][1]), (n + 5, [])]


def as_dict(df):
    return {(r["query_id"], r["vec_id"]): (r["vector"], r["rank"]) for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    assert all(got[k] == (pytest.approx(want[k][0], abs=2e-6), want[k][1]) for k in want)


@pytest.fixture(scope="module")
def space(spark, tmp_path_factory):
    rows = vector_rows()
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = [rows[k] for k in (3, 50, 333, 700, 701, 702)]
    return rows, v, q, spark.createDataFrame(q, "vec_id long, embedding array<double>"), vectors.write_cells(v, f"{tmp_path_factory.mktemp('cells')}/a")


def test_vectors_by_batch(spark, space, monkeypatch):
    rows, v, q, qs, _ = space
    same(as_dict(vectors.vector_top(v, qs, 7)), brute_top(rows, q, 7))
    monkeypatch.setattr(vectors, "QUERIES", 2)
    same(as_dict(vectors.vector_top(v.repartition(5), qs, 3)), brute_top(rows, q, 3))
    named = v.withColumn("vec_id", F.concat(F.lit("n"), F.lpad("vec_id", 5, "0")))
    got = {(a, int(b[1:])): x for (a, b), x in as_dict(vectors.vector_top(named, qs, 7)).items()}
    same(got, brute_top(rows, q, 7))
    assert vectors.vector_top(v.limit(0), qs).count() == 0 and vectors.vector_top(v, qs.limit(0)).count() == 0


def test_cells_are_exact_and_leave_cells_out(space):
    rows, v, q, qs, index = space
    same(as_dict(vectors.search_cells(index, qs, 7)), brute_top(rows, q, 7))
    assert index.rows().count() == sum(x is not None for _, x in rows)
    few = vectors.search_cells(index, qs.filter("vec_id = 50"), 7, cells=2)
    assert set(as_dict(few)) <= {(50, i) for i, _ in rows}


def test_cells_recall(space):
    rows, v, _, _, index = space
    q = [r for r in rows if r[0] < 700 and r[0] % 50 == 0]
    want = set(brute_top(rows, q, 10))
    found = set(as_dict(vectors.search_cells(index, v.filter("vec_id < 700 and vec_id % 50 = 0"), 10, cells=4)))
    assert len(found & want) >= 0.9 * len(want)


def test_cells_in_parts(spark, space, tmp_path, monkeypatch):
    rows, v, q, qs, _ = space
    monkeypatch.setattr(vectors, "CELL_ROWS", 20)
    monkeypatch.setattr(vectors, "QUERIES", 2)
    index = vectors.write_cells(v, f"{tmp_path}/parts", cells=5)
    assert index.rows().agg(F.max("part")).first()[0] > 1
    same(as_dict(vectors.search_cells(index, qs, 7)), brute_top(rows, q, 7))
    same(as_dict(vectors.search_cells(vectors.write_cells(v.filter("vec_id >= 700 and vec_id < 703"), f"{tmp_path}/rest"), qs, 7)), brute_top(rows[700:703], q, 7))


# Grams

def test_contained_tokens(spark):
    rng = random.Random(7)
    letters = "abä日 %_."
    texts = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(0, 40)))) for i in range(120)] + [(500, None), (501, ""), (502, "a" * 30000 + "日本x")]
    tokens = list({"".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(80)} | {"日本x", "zz", ""})
    t, k = spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame([(i, x) for i, x in enumerate([*tokens, None])], "k long, tok string")
    found = grams.containing(t, k, "t", "tok")
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    got = sorted((r["id"], r["k"]) for r in found.collect())
    assert got == sorted((i, j) for i, x in texts for j, tok in enumerate(tokens) if x is not None and tok and tok in x)
    assert grams.containing(t, k.limit(0), "t", "tok").count() == 0 and grams.containing(t.limit(0), k, "t", "tok").count() == 0


def test_dictionary_keeps_longest_matches(spark):
    texts = [(1, "New York City is not York; NEW YORK. [a] \\E [a]"), (2, None), (3, "yorkyork")]
    names = [("york", "c"), ("new york", "b"), ("New York City", "a"), ("york city", "d"), ("[a] \\e", "e"), ("York", "again"), ("", "none")]
    got = grams.dictionary_matches(spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame(names, "alias string, name string"), "id", "t")
    assert {(r["id"], r["start"], r["end"], r["name"]) for r in got.collect()} == {
        (1, 0, 13, "a"), (1, 21, 25, "c"), (1, 21, 25, "again"), (1, 27, 35, "b"), (1, 37, 43, "e"), (3, 0, 4, "c"), (3, 0, 4, "again"), (3, 4, 8, "c"), (3, 4, 8, "again")}


def test_structured_search_counts_single_digits_and_spaced_characters(spark):
    records = spark.createDataFrame([("a", 1, "Tea", "tea 7 7"), ("a", 2, "糖", "糖 尿 病 gi"), ("b", 3, None, "sugar 17")], "type string, id long, title string, search_text string")
    asked = spark.createDataFrame([(1, "7"), (2, "糖尿病")], "item_id long, text string")
    got = {(r["item_id"], r["id"]): r["score"] for r in S.structured_search(records, asked).collect()}
    # 7 weighs 4 an occurrence; the run of three weighs 3, its pairs 1.6 each, single characters nothing.
    assert got == {(1, 1): 8.0, (1, 3): 4.0, (2, 2): 6.2}
