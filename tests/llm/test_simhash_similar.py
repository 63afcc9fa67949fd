"""Near copies against Jaccard similarities in plain Python."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from tessera.llm import simhash_similar as N
from tests.llm.test_operators import docs, random_text


def brute_sets(texts, length=5):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({b" ".join(w)} - {b""} if len(w) < length else {b" ".join(w[i : i + length]) for i in range(len(w) - length + 1)})
    return out


def brute(texts, similarity=0.8):
    sets = brute_sets(texts)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            if s == sets[j] or len(s & sets[j]) >= similarity * len(s | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def planted():
    """Texts and copies of them with some words changed: similarities from 0.5 to 1."""
    rng = random.Random(17)
    texts = [None, "", "  ", "One", "one TWO", "ONE two", "Ünïcode É"]
    for _ in range(40):
        words = random_text(rng, rng.randrange(60, 400), 5000).split()
        texts.append(" ".join(words))
        for _ in range(3):
            changed = list(words)
            for at in rng.sample(range(len(words)), max(1, int(len(words) * rng.uniform(0.002, 0.06)))):
                changed[at] += "x"
            texts.append(" ".join(changed))
    return texts


@pytest.mark.parametrize(("tile", "most"), [(1 << 20, 1 << 22), (500, 600)])
def test_components(spark, monkeypatch, tile, most):
    monkeypatch.setattr(N, "TILE", tile)
    monkeypatch.setattr(N, "MOST", most)
    texts = planted()
    out = {r["doc_id"]: r["component_id"] for r in N.similar_documents(docs(spark, texts)).collect()}
    assert [out[i] for i in range(len(texts))] == brute(texts)
    assert N.similar_documents(docs(spark, [])).count() == 0


def test_stage_drops_near_copies(spark, tmp_path):
    texts = planted()
    kept = corpus_pipeline.one_of_each(spark, docs(spark, texts), str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute(texts)))


def test_large_group_of_copies_with_null_and_repeated_ids(spark):
    base = random_text(random.Random(5), 200, 5000)
    d = docs(spark, [base + f" extra{i}" for i in range(400)] + ["quite another text of a few words"])
    d = d.unionByName(d.filter("doc_id < 3")).unionByName(d.filter("doc_id < 5").withColumn("doc_id", d["doc_id"] * None))
    out = N.similar_documents(d).collect()
    assert len(out) == 409 and {r["component_id"] for r in out if r["doc_id"] is None or r["doc_id"] < 400} == {0}
    assert [r["component_id"] for r in out if r["doc_id"] == 400] == [400]
