"""Chunks and hybrid search over the tables, against plain Python."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.plans import documents as PD
from tessera.plans import search as PS

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


def brute_chunks(units, drop, chars, overlap, share, sep):
    out, buf, pages, section, path = [], [], [], "", ""

    def emit():
        text = "\n\n".join(x for x in buf if x.strip(" ")).strip(" ")
        if text:
            out.append((min(pages), max(pages), section, path, text))

    for u in units:
        text = u["text"].strip(" \n\t")
        if not text or drop and u["heading"]:
            continue
        held = sum(len(x) + sep for x in buf)
        if buf and (held + len(text) > chars or share is not None and u["heading"] and held >= int(chars * share)):
            emit()
            whole = "\n\n".join(buf).strip(" ")
            tail = (whole if len(whole) <= overlap else whole[-overlap:]).strip(" ") if overlap else ""
            buf, pages = ([tail] if tail else []) + [text], [pages[-1], u["page"]]
            section, path = u["section"] or section, u["path"] or path
        else:
            buf.append(text)
            pages.append(u["page"])
            if not section:
                section, path = u["section"], u["path"]
    emit()
    return out


@pytest.mark.parametrize(("query", "args"), [("d5", (True, 850, 150, None, 0)), ("d6", (False, 1800, 120, 0.6, 0)), ("d7", (False, 2400, 0, 0.65, 2))])
def test_chunks_of_the_tables(spark, query, args):
    units: dict = {}
    for r in PD.units(spark, SF).orderBy("doc_id", "page", "no").collect():
        units.setdefault(r["doc_id"], []).append(r)
    want = {(d, k, *c) for d, us in units.items() for k, c in enumerate(brute_chunks(us, *args))}
    got = {tuple(r[c] for c in ("doc_id", "chunk_index", "page_start", "page_end", "section", "path", "text")) for r in getattr(PD, query)(spark, SF).collect()}
    assert got == want


WORD = re.compile("[a-z0-9_+-]+")


def tokens(text):
    return list(dict.fromkeys(WORD.findall(text.lower())))[:80]


def brute_bm25(chunks, queries, top):
    words = {k: Counter(WORD.findall(t.lower())) for k, t in chunks.items()}
    words = {k: c for k, c in words.items() if c}
    mean = sum(sum(c.values()) for c in words.values()) / len(words)
    df = Counter(t for c in words.values() for t in c)
    out = {}
    for q, text in queries.items():
        scores = {}
        for t in tokens(text)[:16]:
            for k, c in words.items():
                if t in c:
                    idf = max(1e-6, math.log((len(words) - df[t] + 0.5) / (df[t] + 0.5)))
                    scores[k] = scores.get(k, 0) + idf * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
        best = sorted((-round(s, 6), k) for k, s in scores.items())[:top]
        out[q] = {k: 1 / (i + 1) for i, (_, k) in enumerate(best)}
    return out


def brute_vector(text, n=32):
    v = [0.0] * n
    for t in tokens(text):
        h = hashlib.sha256(t.encode()).digest()
        v[int.from_bytes(h[:4], "little") % n] += 1 if h[4] % 2 == 0 else -1
    norm = math.sqrt(sum(x * x for x in v)) or 1.0
    return [x / norm for x in v]


def brute_diverse(scored, top=6):
    kept = []
    for _, k, t in sorted((-s, k, t) for k, s, t in scored):
        a = set(t)
        if len(kept) < top and not any((len(a & b) / len(a | b) if a | b else 0) > 0.82 for _, b in kept):
            kept.append((k, a))
    return [k for k, _ in kept]


@pytest.fixture(scope="module")
def corpus(spark):
    chunks = {r["doc_id"]: r["text"] for r in PS.chunks(spark, SF).collect()}
    return chunks, {r["item_id"]: r["text"] for r in PS.asked(spark, SF).collect()}


def in_places(df):
    out: dict = {}
    for r in df.orderBy("item_id", "place").collect():
        out.setdefault(r["item_id"], []).append(r["chunk_id"])
    return out


def test_diverse_top_of_the_tables(spark, corpus):
    chunks, queries = corpus
    want = {q: brute_diverse([(k, s, tokens(chunks[k])) for k, s in found.items()]) for q, found in brute_bm25(chunks, queries, 40).items()}
    assert in_places(PS.r7(spark, SF)) == {q: v for q, v in want.items() if v}


def test_hybrid_of_the_tables(spark, corpus):
    chunks, queries = corpus
    queries = {q: " ".join([t, *(p for _, trigger, p in PS.TRIGGERS if trigger in t.lower())]) for q, t in queries.items()}
    lexical = brute_bm25(chunks, queries, 40)
    vectors = {k: brute_vector(t) for k, t in chunks.items()}
    got = {(r["item_id"], r["chunk_id"]): r["score"] for r in PS.r8(spark, SF).collect()}
    places = in_places(PS.r8(spark, SF))
    agree = 0
    for q, text in queries.items():
        v = brute_vector(text)
        near = sorted((-round(max(0.0, (sum(a * b for a, b in zip(v, w, strict=True)) + 1) / 2), 6), k) for k, w in vectors.items())[:40]
        fused = {k: 0.55 * s for k, s in lexical[q].items()}
        for s, k in near:
            fused[k] = fused.get(k, 0.0) - 0.45 * s
        for k in fused:
            fused[k] = fused[k] * (0.55 if "|" in chunks[k] else 1) * (0.18 if "Licensed" in chunks[k] else 1) + (0.25 if "tion" in chunks[k] else 0)
        best = brute_diverse([(k, s, tokens(chunks[k])) for k, s in fused.items()])
        assert all(abs(got[q, k] - fused[k]) < 1e-9 for k in places[q] if k in fused)
        agree += best == places[q]
    # Sums in another order can swap neighbours whose scores are equal to the last digits.
    assert agree >= 0.95 * len(queries)


def test_every_chunk_has_a_vector(spark):
    from tessera.functions import text as T

    c = PS.chunks(spark, SF).limit(50)
    for r in c.select("text", T.hashed_vector(T.index_tokens(F.col("text"))).alias("v")).collect():
        assert r["v"] == pytest.approx(brute_vector(r["text"]), abs=1e-12)
