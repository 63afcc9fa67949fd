"""Personal data, source divergence and collocations against plain Python, with nulls, empty and long texts, ties, repeats and clashes."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import collocations, divergence, personal_data
from tessera.llm import queries as Q

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows, **more):
    df = spark.createDataFrame([(i, t, lang, source, 0) for i, (t, lang, source) in enumerate(rows)], DOCS)
    for name, value in more.items():
        df = df.withColumn(name, F.lit(value))
    return df


# Personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def passes(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text):
    text, digits = text or "", lambda m: re.sub("[^0-9]", "", m[0])
    found = [(0, *m.span()) for m in EMAIL.finditer(text)]
    found += [(1, *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [(2, *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and passes(digits(m))]
    return found + [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]


PIECES = ["a.b@c.de", "x@y", "a@b.c_d@e.f", "+a@b..c", "1.2.3.4", "256.1.1.1", "000.0255.1.01.9", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824",
          "+49 30 12", "++12345678901(", "é😀ß", "tel:", " 2020-01-02 ", "555-123-4567", "12", " ", "\n", "@anna_b", "bob [at] mail [dot] com", "Dr. Anna Karenina", ".", "_", "%", "-"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    made = ["".join(rng.choice(PIECES) + rng.choice(["", " ", ", "]) for _ in range(rng.randrange(0, 30))) for _ in range(150)]
    return [None, "", "no data at all", "7" * 5000 + " " + "a" * 20000 + "@b.c", "1.1.1.1 " * 3000, *made, *made[:5]]


def test_base_spans_and_counts(spark, texts):
    d = docs(spark, [(t, "en", "s") for t in texts], base=1, kind="x", row="r")
    out = {r["doc_id"]: r for r in personal_data.find_personal_data(d).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        want = base_spans(t)
        assert [tuple(x) for x in out[i]["base"]] == want, t
        assert [out[i][f"n_{k}"] for k in personal_data.KINDS[:4]] == [sum(x[0] == j for x in want) for j in range(4)]
        for kind, start, end in (tuple(x) for x in out[i]["added"]):
            assert kind >= 4 and all(end <= a or b <= start for _, a, b in want)
            assert re.search(personal_data.PATTERNS[kind].replace(r"\p{Lu}", "[A-Z]").replace(r"\p{L}", r"\w"), t[start:end])
    assert {tuple(map(str, out[i]["added"])) for i in range(5, 10)} == {tuple(map(str, out[len(texts) - 5 + i]["added"])) for i in range(5)}


def test_query_digests(spark, texts, tmp_path):
    docs(spark, [(t, "en", "s") for t in texts]).write.parquet(f"{tmp_path}/documents.parquet")
    for r in Q.op11_personal_data(spark, str(tmp_path)).collect():
        said = [f"{personal_data.KINDS[k]}:{a}:{b}" for k, a, b in base_spans(texts[r["doc_id"]])]
        assert r["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert r["spans"].split(",")[: len(said)] == said or not said


def test_weak_spans_need_support(spark):
    """Numbers that look like phones next to a cue are found, bare numbers and dates are left."""
    rows = [(f"Please call my phone: 555-123-{4000 + i} or mail anna{i}@gmail.com", "en", "s") for i in range(60)]
    rows += [(f"On 2020-01-{10 + i % 20} version 1234567{i % 10} was made, page 90{i}8765", "en", "s") for i in range(60)]
    out = {r["doc_id"]: [personal_data.KINDS[x["kind"]] for x in r["added"]] for r in personal_data.find_personal_data(docs(spark, rows)).collect()}
    assert all(out[i] == ["number"] for i in range(60))
    assert all(out[i] == [] for i in range(60, 120))


def expected_estimate(patterns, rounds=30):
    right, wrong, shares = [0.8] * 6, [0.2] * 6, [0.5] * 7

    def chance(kind, votes):
        z = math.log(shares[kind] / (1 - shares[kind]))
        for v, a, b in zip(votes, right, wrong):
            z += math.log(a / b) if v == 1 else math.log((1 - a) / (1 - b)) if v == -1 else 0
        return 1 / (1 + math.exp(-z))

    for _ in range(rounds):
        p = [chance(k, v) for k, v, _ in patterns]
        for j in range(6):
            for side, out, r in ((p, right, 0.8), ([1 - x for x in p], wrong, 0.2)):
                up = sum(n * x for (k, v, n), x in zip(patterns, side) if v[j] == 1)
                down = sum(n * x for (k, v, n), x in zip(patterns, side) if v[j] == -1)
                out[j] = (up + 10 * r) / (up + down + 10)
        for k in range(7):
            own = [(n, x) for (kk, v, n), x in zip(patterns, p) if kk == k]
            shares[k] = (sum(n * x for n, x in own) + 1) / (sum(n for n, _ in own) + 2)
    return [chance(k, v) for k, v, _ in patterns]


def test_expectation_maximisation(spark):
    rng = random.Random(2)
    seen = Counter((rng.randrange(7), tuple(rng.choice([-1, 0, 0, 1, 1]) for _ in range(6))) for _ in range(400))
    patterns = [(k, list(v), n) for (k, v), n in seen.items()]
    df = spark.createDataFrame(patterns, "kind int, votes array<int>, n long")
    got = {(r["kind"], tuple(r["votes"])): r["p"] for r in df.withColumn("p", personal_data.estimate(df)).collect()}
    for (k, v, _), want in zip(patterns, expected_estimate(patterns)):
        assert got[k, tuple(v)] == pytest.approx(want, abs=1e-4)


def test_regression_is_at_its_optimum(spark):
    rng = random.Random(4)
    rows = [([rng.randrange(7), *sorted(rng.sample(range(7, 15), rng.randrange(0, 5)))], float(rng.randrange(1, 50))) for _ in range(60)]
    rows = [(f, n, n * min(0.98, 0.1 + 0.12 * len(f) + 0.05 * f[0])) for f, n in rows]
    df = spark.createDataFrame(rows, "features array<int>, n double, s double")
    got = df.withColumn("p", personal_data.fit(df, rounds=25)).collect()
    w = {}
    # The gradient of the likelihood is the ridge times the weight: log-odds of each row must be the sum of the gradients' parts.
    for i in range(15):
        w[i] = sum(r["s"] - r["n"] * r["p"] for r in got if i in r["features"])
    for r in got:
        assert math.log(r["p"] / (1 - r["p"])) == pytest.approx(sum(w[i] for i in r["features"]), abs=1e-3)


def test_personal_data_of_an_empty_table(spark):
    assert personal_data.find_personal_data(docs(spark, [])).count() == 0


# Source divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def expected_divergence(rows, least=3, top=200):
    rows = [tuple(x or "" for x in r) for r in rows]
    words = [TERM.findall(t.translate(LOWER)) for t, _, _ in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        held = Counter(w for ws, r in zip(words, rows) if r[1] == lang for w in set(ws))
        kept = {w for w, n in held.items() if n >= least}
        counts = {s: Counter() for _, g, s in rows if g == lang}
        for ws, (_, g, s) in zip(words, rows):
            if g == lang:
                counts[s].update(w for w in ws if w in kept)
        every = sum(counts.values(), Counter())
        share = lambda c, w: 1 + 1000000000 * (c[w] + 1) // (sum(c.values()) + len(kept))  # noqa: B023, E731
        for s in counts:
            pairs = [(-sum((share(counts[s], w) - share(counts[o], w)) ** 2 // share(counts[o], w) for w in kept), o.encode()) for o in counts if o != s]
            own = [(-((share(counts[s], w) - share(every, w)) ** 2 // share(every, w)), w.encode()) for w in kept if counts[s][w] and share(counts[s], w) > share(every, w)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(own)[:top])):
                out |= {(lang, s, part, item.decode(), -v, i) for i, (v, item) in enumerate(found, 1)}
    return out


def mixed_rows(n=150):
    rng = random.Random(8)
    words = ["the", "The", "é", "ÉA", "x1y", "foo-bar", "日本", "w", "rare"] + [f"t{c}" for c in "abcdefghij"]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(0, 40))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "ä", None, "z"])) for _ in range(n)]
    return [*rows, (None, None, None), ("", "fr", "only"), ("1 2 3", "fr", "other"), ("solo " * 9, "it", "one"), *rows[:3]]


@pytest.mark.parametrize("block", [256, 1])
def test_divergence(spark, monkeypatch, block):
    """With blocks of about one source, sources are dealt to tiles by hash."""
    monkeypatch.setattr(divergence, "BLOCK", block)
    rows = mixed_rows()
    got = divergence.source_divergence(docs(spark, rows, term="x", n=3, v=1), top=4)
    assert {tuple(r) for r in got.collect()} == expected_divergence(rows, top=4)


def test_divergence_of_small_batches_and_matrices(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 7)
    try:
        rows = mixed_rows(60)
        assert {tuple(r) for r in divergence.source_divergence(docs(spark, rows), cells=8, sent=3, task_rows=20).collect()} == expected_divergence(rows)
    finally:
        spark.conf.set(key, before)


def test_divergence_of_an_empty_table(spark):
    assert divergence.source_divergence(docs(spark, [])).count() == 0
    assert {r["value"] for r in divergence.source_divergence(docs(spark, [("a", "en", "x"), ("b", "en", "y")])).collect()} == {0}


def test_share_is_exact(spark):
    pairs = [(1, 1), (1, 3), (7 * 10**14, 9 * 10**15), (123456789012345, 987654321098765), (9 * 10**15, 9 * 10**15)]
    df = spark.createDataFrame(pairs, "c long, t long")
    got = df.select("c", "t", divergence.share(F.col("c"), F.col("t")).alias("p")).collect()
    assert all(r["p"] == 1 + 10**9 * r["c"] // r["t"] for r in got)


# Collocations


def expected_collocations(rows, least, top=2000, longest=5):
    out = set()
    for lang in {r[1] or "und" for r in rows}:
        f = Counter()
        for text, g, _ in rows:
            if (g or "und") == lang:
                for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
                    w = re.findall(r"[^\x20\x09]+", piece)
                    f.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
        n = sum(c for p, c in f.items() if len(p) == 1)
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        found = []
        for p, a in good.items():
            if any(len(q) > len(p) and b >= a and inside(p, q) for q, b in good.items()):
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out |= {(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)}
    return out


def phrase_rows():
    rng = random.Random(6)
    fixed = ["new york city hall", "on the other hand", "in order to", "ab", "state of the art"]
    rows = []
    for _ in range(120):
        words = [rng.choice(fixed) if rng.random() < 0.4 else f"w{rng.randrange(12)}" for _ in range(rng.randrange(0, 40))]
        text = "".join(w + rng.choice([" ", " ", "\t", ", ", ". ", "\n", "  "]) for w in words)
        rows.append((text.title() if rng.random() < 0.3 else text, rng.choice(["en", "en", "und", None, "de"]), "s"))
    return [*rows, (None, "en", "s"), ("", "xx", "s"), ("to be or not to be " * 300, "it", "s"), ("Ω\x85Ω a b " * 60, "el", "s"), *rows[:2]]


@pytest.mark.parametrize("least", [12, 40])
def test_collocations(spark, least):
    rows = phrase_rows()
    got = collocations.collocations(docs(spark, rows, phrase=1, a="x", prefix="p"), least=least)
    assert {tuple(r) for r in got.collect()} == expected_collocations(rows, least)


def test_collocations_with_full_filters_and_small_batches(spark):
    """A filter with most bits set lets more be counted, not less; stripes cut to small batches are the same."""
    rows = phrase_rows()
    got = collocations.collocations(docs(spark, rows), least=12, top=7, filter_bits=64, sent=5)
    assert {tuple(r) for r in got.collect()} == expected_collocations(rows, 12, top=7)


def test_collocations_of_empty_tables(spark):
    assert collocations.collocations(docs(spark, [])).count() == 0
    assert collocations.collocations(docs(spark, [(None, None, None), ("a b", "en", "s")])).count() == 0
