"""What the findings of round 4 named: a dictionary in one walk over a text, and searches by whole texts."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import grams, tries, vectors
from tessera.plans import records as PR
from tessera.plans import search as PS
from tessera.plans.registry import SQL


def brute_matches(texts, names):
    """Of each key the outermost of the places at which a text is split by an alias."""
    spans: dict = {}
    for k, t in texts:
        for a in {n.lower() for n in names if n}:
            at = (t or "").lower().find(a)
            while at >= 0:
                spans.setdefault(k, set()).add((at, at + len(a), a))
                at = t.lower().find(a, at + len(a))
    inside = lambda x, y: y[0] <= x[0] and x[1] <= y[1] and x[:2] != y[:2]
    return {(k, *x) for k, own in spans.items() for x in own if not any(inside(x, y) for y in own)}


@pytest.mark.parametrize("small", [False, True])
def test_a_dictionary_is_found_in_one_walk_over_a_text(spark, monkeypatch, small):
    """Also of more tokens than a pass has, of texts over a span and of levels without a table; a text is not searched for each alias."""
    if small:
        for name, value in (("BROADCAST_ROWS", 20), ("SPAN", 64), ("TABLE", 8), ("ROWS", 5)):
            monkeypatch.setattr(tries, name, value)
    monkeypatch.setattr(grams, "containing", lambda *a: pytest.fail("looked for alias by alias"))
    rng = random.Random(5)
    letters = "abä日 B𝄞"
    texts = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(0, 90)))) for i in range(60)] + [(70, None), (71, ""), (72, "a" * 300 + "日本x"), (73, "日本x")]
    names = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(90)} | {"日本X", "aaaa", "aba", ""})
    walked, walk = [], tries.Trie.walk
    monkeypatch.setattr(tries.Trie, "walk", lambda self, data: walked.append(len(data)) or walk(self, data))
    got = grams.dictionary_matches(spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame([(n,) for n in names], "alias string"), "id", "t").collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {(r["id"], r["start"], r["end"], r["alias"].lower()) for r in got} == brute_matches(texts, names)


def test_walks_end_with_the_text():
    """An occurrence that begins in a text and ends in the next one is none, and a later one of a token does not begin in an earlier."""
    trie = tries.Trie(["abab", "cd", "d"])
    data, offsets = tries._bytes(pa.array(["xabab", "abc", "", "dababab", "cd"]).slice(1))
    text, start, token = trie.outermost(data, offsets)
    assert list(zip(text.tolist(), start.tolist(), token.tolist(), strict=True)) == [(2, 0, 2), (2, 1, 0), (3, 0, 1)]


def test_the_dictionary_of_odd_documents_is_its_sql(spark, tmp_path):
    """Documents of one id, the same text twice, no id, no text, and letters of more than a byte."""
    said = ["The quick brown fox jumps over", "quick", "Brown fox", "naïve ÜBER schön quickly", "jumps jumps jumps over"]
    docs = [(1, "thequick brown foxes; brown FOX jumps over"), (1, "the quick brown fox"), (2, "ü schön quickly naïve über"), (2, "ü schön quickly naïve über"), (None, "jumps jumps jumps"), (None, "jumps"), (5, None), (6, ""),
            (7, "日本 quick 𝄞 quickly\nbrown fox")]
    pq.write_table(pa.table({"item_id": list(range(len(said))), "text": said}), f"{tmp_path}/benchmark.parquet")
    pq.write_table(pa.table({"doc_id": [d for d, _ in docs], "text": [t for _, t in docs]}), f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    for n in ("benchmark", "documents"):
        db.execute(f"CREATE VIEW {n} AS SELECT * FROM '{tmp_path}/{n}.parquet'")
    want = sorted(db.execute(SQL["p2_dictionary"]).fetchall(), key=str)
    got = sorted((tuple(r) for r in PR.p2_dictionary(spark, str(tmp_path)).select("doc_id", "alias", "n", "first").collect()), key=str)
    assert got == want


# Searches by whole texts

WORD = re.compile("[a-z0-9_+-]+")


def words(text):
    return list(dict.fromkeys(WORD.findall(text.lower())))


def lexical_of(texts, asked, top=40):
    """By all tokens of the texts asked: the inverse of a document's rank."""
    counts = {k: Counter(WORD.findall(t.lower())) for k, t in texts.items()}
    mean, df = sum(sum(c.values()) for c in counts.values()) / len(counts), Counter(t for c in counts.values() for t in c)
    out = {}
    for q, text in asked.items():
        score = Counter()
        for t in words(text):
            for k, c in counts.items():
                if t in c:
                    idf = max(1e-6, math.log((len(counts) - df[t] + 0.5) / (df[t] + 0.5)))
                    score[k] += idf * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
        out[q] = {k: 1 / (n + 1) for n, (_, k) in enumerate(sorted((-round(s, 6), k) for k, s in score.items())[:top])}
    return out


def diverse(scored, top=6):
    kept = []
    for _, k, t in sorted((-s, k, t) for k, s, t in scored):
        if len(kept) < top and not any(len(set(t) & o) / len(set(t) | o) > 0.82 for _, o in kept):
            kept.append((k, set(t)))
    return [k for k, _ in kept]


def vector_of(text, n=32):
    v = [0.0] * n
    for t in words(text):
        h = hashlib.sha256(t.encode()).digest()
        v[int.from_bytes(h[:4], "little") % n] += 1 if h[4] % 2 == 0 else -1
    size = math.sqrt(sum(x * x for x in v)) or 1.0
    return [x / size for x in v]


@pytest.fixture(scope="module")
def long_texts(tmp_path_factory):
    """Texts whose words from the 81st on, and queries whose words from the 17th on, decide; each is one chunk."""
    folder, rng = tmp_path_factory.mktemp("long"), random.Random(2)
    head, rest = [f"a{i}" for i in range(85)], [f"b{i}" for i in range(300)]
    docs = {i: " ".join([*head, *rng.sample(rest, 60)]) for i in range(1, 9)} | {i: " ".join(rng.sample(rest, 70)) for i in range(9, 30)} | {30: "needle alone"}
    asked = {1: " ".join([*(f"z{i}" for i in range(20)), "needle"]), 2: " ".join([*(f"y{i}" for i in range(90)), *rng.sample(rest, 40), *head[:5]]), 3: " ".join(rng.sample(rest, 10))}
    pq.write_table(pa.table({"doc_id": list(docs), "text": list(docs.values())}), f"{folder}/documents.parquet")
    pq.write_table(pa.table({"item_id": list(asked), "text": list(asked.values())}), f"{folder}/benchmark.parquet")
    return str(folder), {f"{k}:000000": t for k, t in docs.items()}, asked


def places(df):
    out: dict = {}
    for r in df.orderBy("item_id", "place").collect():
        out.setdefault(r["item_id"], []).append(r["chunk_id"])
    return out


def test_diverse_top_uses_whole_texts(spark, long_texts):
    folder, texts, asked = long_texts
    want = {q: diverse([(k, s, words(texts[k])) for k, s in found.items()]) for q, found in lexical_of(texts, asked).items()}
    assert want[1] == ["30:000000"] and want != {q: diverse([(k, s, words(texts[k])[:80]) for k, s in found.items()]) for q, found in lexical_of(texts, asked).items()}
    assert places(PS.r7(spark, folder)) == want


def test_hybrid_uses_whole_texts(spark, long_texts):
    folder, texts, asked = long_texts
    asked = {q: " ".join([t, *(p for _, trigger, p in PS.TRIGGERS if trigger in t.lower())]) for q, t in asked.items()}
    lexical, embedded = lexical_of(texts, asked), {k: vector_of(t) for k, t in texts.items()}
    rows = PS.r8(spark, folder).collect()
    for q, text in asked.items():
        v = vector_of(text)
        fused = {k: 0.55 * lexical[q].get(k, 0.0) + 0.45 * round(max(0.0, (sum(a * b for a, b in zip(v, w, strict=True)) + 1) / 2), 6) for k, w in embedded.items()}
        got = {r["chunk_id"]: r["score"] for r in rows if r["item_id"] == q}
        assert got == pytest.approx({k: fused[k] for k in diverse([(k, s, words(texts[k])) for k, s in fused.items()])}, abs=1e-9)
    assert any(r["item_id"] == 1 and r["chunk_id"] == "30:000000" for r in rows)


def test_hashed_vectors_by_batch_are_those_of_the_column(spark):
    """The same numbers as the column's, with and without tokens."""
    texts = [(1, "red b-2 糖尿病 red"), (2, ""), (3, None), (4, "the of the"), (5, " ".join(f"w{i}" for i in range(300)))]
    df = spark.createDataFrame(texts, "k long, text string").select("k", T.index_tokens(F.col("text"), None).alias("tokens"), "text")
    for n in (32, 24):
        want = {r["k"]: r["v"] for r in df.select("k", T.hashed_vector(F.col("tokens"), n).alias("v")).collect()}
        assert {r["k"]: r["embedding"] for r in vectors.hashed_vectors(df.select("k", "tokens"), n).collect()} == want
    null = spark.createDataFrame([(1, None), (2, [])], "k long, tokens array<string>")
    assert [r["embedding"] for r in vectors.hashed_vectors(null, 4).collect()] == [[0.0] * 4] * 2
