"""The methods of the dealt operators against slow plain Python, and their edges: empty tables, limits, hot keys."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, decontamination, language_id, line_dedup, mixing, quality_rules, queries, secrets, simhash, toxicity, url_filter
from tests.llm.test_operators import DOCS, WORD, brute_components, brute_hits, brute_lines, brute_quality, brute_targets, docs, labelled, random_text

SF = "/root/testdata/sf0.1"


# Shared helpers

def test_join_hot_is_a_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    left = spark.createDataFrame([(i % 7 if i % 2 else 3, i) for i in range(400)] + [(None, -1), (99, -2)], "k long, x long")
    right = spark.createDataFrame([(k, k * 10) for k in range(7)], "k long, y long")
    counts = left.groupBy("k").agg(F.count("*").alias("n"))
    got = common.join_hot(left, right, ["k"], counts, 402).select("k", "x", "y").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, left.join(right, "k").select("k", "x", "y").collect()))


# Language identification

def test_language_scores_against_plain_loops(spark):
    model = language_id.train(labelled(spark), F.lit(True))
    texts = ["the lazy dog", "Le  renard, brun!", "x", "schläft dann", "fox " * 50]

    def subwords(text):
        b = [32] + [c if c > 127 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in text.encode()] + [32]
        out = []
        for n in (2, 3, 4):
            for i in range(len(b) - n + 1):
                g = b[i : i + n]
                if n == 2 and not (g[0] != 32 or g[1] != 32) or n == 3 and g[1] == 32 or n == 4 and (g[1] == 32 or g[2] == 32):
                    continue
                v = int.from_bytes(bytes(g), "big")
                out.append((((v ^ n * 0x51ED27) & 0xFFFFFFFF) * 2654435761 & 0xFFFFFFFF) >> 17)
        return out

    got = {r["doc_id"]: r for r in language_id.identify(docs(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        ids = subwords(t)
        z = [sum(float(model.table[k][c]) for k in ids) / len(ids) + float(model.bias[c]) for c in range(len(model.languages))]
        e = [math.exp((x - max(z)) / model.temperature) for x in z]
        assert got[i]["lang_pred"] == model.languages[e.index(max(e))]
        assert abs(got[i]["score"] - max(e) / sum(e)) < 1e-5


def test_language_gradient_against_plain_steps():
    """One round over two rows, none kept for calibration, against the same steps written out."""
    rows = [("a", np.array([3, 9], np.int32), np.array([1, 3], np.int32)), ("b", np.array([9, 20], np.int32), np.array([2, 2], np.int32))]
    model = language_id.fit(rows, rate=0.5, rounds=1, seed=4)
    rng = np.random.default_rng(4)
    embed = rng.normal(0, 0.1, (language_id.BUCKETS, language_id.DIMENSIONS)).astype(np.float32).astype(float)
    out, bias = np.zeros((language_id.DIMENSIONS, 2)), np.zeros(2)
    train = rng.permutation(2)
    for step, k in enumerate(rng.permutation(train)):
        lang, ids, counts = rows[k]
        mean = sum(c / counts.sum() * embed[i] for i, c in zip(ids, counts, strict=True))
        p = np.exp(mean @ out + bias)
        p = p / p.sum() - (np.array(["a", "b"]) == lang)
        now = 0.5 * (1 - step / 2)
        back = out @ p
        out, bias = out - now * np.outer(mean, p), bias - 0.01 * now * p
        for i, c in zip(ids, counts, strict=True):
            embed[i] = embed[i] - now * c / counts.sum() * back
    assert np.allclose(model.table[[3, 9, 20]], (embed @ out)[[3, 9, 20]], atol=1e-4)


def test_language_without_rows_and_letters(spark):
    none = language_id.train(docs(spark, []), F.lit(True))
    unlabelled = language_id.train(docs(spark, ["a b"]).withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    for model in (none, unlabelled):
        r = language_id.identify(docs(spark, ["the dog", None]), model).collect()
        assert {(x["lang_pred"], x["score"], x["rejected"]) for x in r} == {("und", 0.0, True)}
    model = language_id.train(labelled(spark), F.lit(True))
    out = language_id.identify(docs(spark, ["² ½ ①", "12_3", "ß", "the dog"], SCORE="clash"), model).collect()
    assert [r["lang_pred"] == "und" for r in sorted(out, key=lambda r: r["doc_id"])] == [True, True, False, False]
    assert [c for c in out[0].asDict() if c.lower() == "score"] == ["score"]


def test_language_sample_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language_id, "fit", lambda sample: seen.append(sample))
    monkeypatch.setattr(language_id, "SAMPLE_BYTES", 20_000)
    language_id.train(labelled(spark, 600), F.lit(True), rows=300)
    assert sum(8 * len(x[1]) for x in seen[0]) <= 20_000 and {x[0] for x in seen[0]} == {"en", "de", "fr"}


# Toxicity

def test_ftrl_against_plain_loops(spark):
    rng = random.Random(2)
    sample = [(int(i % 4 == 0), np.array(sorted(rng.sample(range(40), 6) + ([77] if i % 4 == 0 else [])), np.int32)) for i in range(120)]
    model = toxicity.fit(sample, l1=0.5, rounds=2)
    z, n, zb, nb = {}, {}, 0.0, 0.0
    weight = lambda k: 0.0 if abs(z.get(k, 0)) <= 0.5 else -(z[k] - math.copysign(0.5, z[k])) / ((1 + math.sqrt(n[k])) + 1)
    order = np.random.default_rng(1)
    for _ in range(2):
        for k in order.permutation(len(sample)):
            y, ids = sample[k]
            w = {i: weight(i) for i in ids.tolist()}
            wb = -zb / (1 + math.sqrt(nb))
            g = 1 / (1 + math.exp(-(sum(w.values()) + wb))) - y
            for i in w:
                z[i] = z.get(i, 0) + g - (math.sqrt(n.get(i, 0) + g * g) - math.sqrt(n.get(i, 0))) * w[i]
                n[i] = n.get(i, 0) + g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) * wb
            nb += g * g
    want = {k: weight(k) for k in z if weight(k)}
    assert dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True)) == pytest.approx(want, rel=1e-4)
    assert model.bias == pytest.approx(-zb / (1 + math.sqrt(nb)))


def test_toxicity_scores_against_plain_sums(spark):
    """A word, a pair and a skip pair weigh once a text each."""
    def bucket(text, keep):
        buf = np.frombuffer((text + "\n").encode(), np.uint8)
        texts, found = toxicity.features(buf, np.array([0, len(buf)]))
        return set(found.tolist()) if keep is None else found[keep]

    word, pair = bucket("bad", 0), bucket("very bad", 2)
    model = toxicity.ToxicityModel(*map(np.array, zip(*sorted([(int(word), 2.0), (int(pair), 1.5)]), strict=True)), -3.0)
    texts = ["bad", "Bad bad", "very bad", "very, BAD very bad", "good", None, "verybad"]
    got = [r["score"] for r in toxicity.score(docs(spark, texts), model).orderBy("doc_id").collect()]
    want = [1 / (1 + math.exp(3 - s)) for s in (2, 2, 3.5, 3.5, 0, 0, 0)]
    assert got == pytest.approx(want, rel=1e-5)


def test_toxicity_learns_each_text_of_a_repeated_id(spark):
    rows = [(k // 2, f"bad word{k % 9} stuff" if k % 4 else f"good word{k % 9} stuff", "en", "s", 0) for k in range(80)]
    rows += rows[:10]
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    models = [toxicity.train(x, labels, F.lit(True)) for x in (d, d.orderBy(F.rand(3)).repartition(3))]
    assert models[0].bias == models[1].bias and models[0].weights.tolist() == models[1].weights.tolist()


# Secrets

def test_parts_inside_a_long_base_span_are_not_free():
    text = "AKIA" + "A" * 16 + " and token=" + ".".join(["0123456789abcdef01234567"] * 5) + ".XyZ1234567890abCdefghij"
    base, parts = secrets.scan(text)
    taken = [(a, b) for _, a, b in base]
    assert len(taken) >= 7
    assert all(not weak or kind == 5 or all(b <= x or y <= a for x, y in taken) for kind, _, a, b, weak in parts)


def brute_links(text, reach=400):
    base, parts = secrets.scan(text)
    out = []
    for kind, scope, a, b, _ in parts:
        if kind != 4:
            continue
        near = {}
        for k in (3, 5):
            found = sorted((max(a - y, x - b, 0), 0 if (x, k, y) <= (a, 4, b) else 1, x, y) for kk, s, x, y, _ in parts if kk == k and s == scope)
            found = [f for f in found if f[0] <= reach]
            near[k] = found[0][0] if found else None
        if near[3] is not None:
            out.append(((a, b), near[3], near[5]))
    return sorted(set(out))


def test_links_against_all_pairs(spark):
    rng = random.Random(8)
    pieces = ["user.a@mail.example.com", "client_id=app-12345", "Q7zK9mW2xR4tB8nLpV3cJ6hG", "token = 'abcdef123456'", "10.0.0.7", "https://api.host.example/v1", "\n\n", "word " * 60, "AKIA" + "Q2" * 8]
    texts = [" ".join(rng.choice(pieces) + ("" if rng.random() < 0.5 else str(i)) for i in range(rng.randrange(1, 14))) for _ in range(60)]
    out = {r["doc_id"]: r for r in secrets.find_secrets(docs(spark, texts, links="clash", _h="clash")).collect()}
    some = 0
    for i, t in enumerate(texts):
        got = []
        for x in out[i]["links"]:
            a, b = x["secret"]["start"], x["secret"]["end"]
            away = lambda y: None if y is None else max(a - y["end"], y["start"] - b, 0)  # noqa: B023, E731
            got.append(((a, b), away(x["identifier"]), away(x["endpoint"])))
        assert sorted(set(got)) == brute_links(t), t
        some += len(got)
    assert some > 20
    assert secrets.find_secrets(docs(spark, [])).count() == 0


@pytest.mark.skipif(not __import__("os").path.exists(SF), reason="no test tables here")
def test_links_on_the_tables(spark):
    assert queries.op3_secrets(spark, SF).agg(F.sum("n_links")).first()[0] > 0


# Decontamination

def items_and_texts():
    rng = random.Random(21)
    items = [(i, random_text(rng, rng.choice([2, 9, 10, 14, 30]), 15)) for i in range(20)]
    texts = [random_text(rng, rng.randrange(0, 90), 15) for _ in range(30)] + [None, "", "a " + items[4][1] + " b"]
    return items, texts


def test_passes_agree_with_one(spark, monkeypatch):
    items, texts = items_and_texts()
    bench, d = spark.createDataFrame(items, "item_id long, text string"), docs(spark, texts, N_HIT="clash")
    one = decontamination.find_phrases(d, bench).orderBy("doc_id").collect()
    cut = decontamination.find_phrases(d, bench, cut=True).orderBy("doc_id").collect()
    monkeypatch.setattr(decontamination, "PHRASE_WORDS", 60)
    assert len(decontamination._groups(bench)) > 2
    assert decontamination.find_phrases(d, bench).orderBy("doc_id").collect() == one
    many = decontamination.find_phrases(d, bench, cut=True).orderBy("doc_id").collect()
    for a, b in zip(cut, many, strict=True):
        assert (a["n_hit"], a["item_ids"], a["removed"]) == (b["n_hit"], b["item_ids"], b["removed"])
        assert a["text"] == b["text"] or brute_hits(b["text"], items)[1] == 0
        assert b["text"] is None or brute_hits(b["text"], items)[1] == 0


def test_index_of_every_stretch_finds_the_same():
    items, texts = items_and_texts()
    phrases = decontamination.phrases_of([(str(i), t) for i, t in items])
    column = pa.array(texts, pa.string())
    a, b = decontamination.search_batch(column, phrases), decontamination.search_batch(column, phrases, every_stretch=True)
    for x, y in (("hit_text", "hit_from"), ("item_text", "item")):
        assert set(zip(getattr(a, x).tolist(), getattr(a, y).tolist(), strict=True)) == set(zip(getattr(b, x).tolist(), getattr(b, y).tolist(), strict=True))
    assert len(a.hit_text) > 0


# SimHash

@pytest.mark.parametrize(("tile", "agree"), [(8, 1), (2, 2), (1, 3)])
def test_longer_keys_find_the_same(spark, monkeypatch, tile, agree):
    monkeypatch.setattr(simhash, "TILE", {1: 8, 2: 1 / 2**12, 3: 1 / 2**20}[agree])
    rng = random.Random(31)
    fps = []
    for _ in range(25):
        f = rng.getrandbits(64)
        for _ in range(6):
            fps.append(f)
            f ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
    fps = sorted(set(fps))
    keys, bits = simhash.tile_keys(len(fps), 3)
    assert len(keys[0]) == agree and bits > 0
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    edges = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    root = {f: f for f in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in edges:
        root[find(e["a"])] = find(e["b"])
    groups = {}
    for f, w in zip(signed, brute_components(fps), strict=True):
        groups.setdefault(w, set()).add(find(f))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_simhash_long_texts(spark):
    text = "word other " * 40000
    out = simhash.near_duplicates(docs(spark, [text, text.upper(), "short"])).orderBy("doc_id").collect()
    assert [r["component_id"] for r in out] == [0, 0, 2]


# URL filter

def test_cascade_in_parts_and_passes(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "PART_BITS", 512)
    monkeypatch.setattr(url_filter, "PASS_PARTS", 3)
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = url_filter.build_cascade(keys.filter("substring(key, -1) = '7'"), keys)
    assert len(cascade.parts) > 3
    marked = cascade.mark(keys.unionByName(spark.createDataFrame([(None,)], "key string")), "key", "listed")
    assert marked.count() == 4001
    assert marked.filter("listed <> coalesce(substring(key, -1) = '7', false)").count() == 0


def test_deep_cascade_ends_in_a_list(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "DEEP", 1)
    keys = spark.range(300).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = url_filter.build_cascade(keys.filter("substring(key, -1) = '7'"), keys)
    assert isinstance(cascade.parts[0][-1], url_filter.Listed) and cascade.levels == 2
    assert keys.filter(cascade.contains(F.col("key")) != (F.substring("key", -1, 1) == "7")).count() == 0


def test_url_filter_edges(spark):
    long = "https://www.long.example.net/" + "a/" * 20000
    pages = spark.createDataFrame([(1, long), (2, long), (3, "http://ok.net/a"), (4, "http://ok.net/b?x"), (5, None)], "page_id long, url string").withColumn("_url", F.lit("mine")).withColumn("Verdict", F.lit("clash"))
    rules = [("allow", "org/")]
    listed = spark.createDataFrame([(long.split("://")[1],), ("ok.net/b",), (None,), ("",)], "key string")
    out = {r["page_id"]: r for r in url_filter.url_filter(pages, rules, listed).collect()}
    assert [out[k]["verdict"] for k in range(1, 6)] == ["block", "block", "allow", "block", "allow"]
    assert all(r["_url"] == "mine" and "Verdict" not in r.asDict() for r in out.values())
    assert url_filter.url_filter(pages.limit(0), rules, listed).count() == 0
    assert {r["verdict"] for r in url_filter.url_filter(pages, rules, listed.limit(0)).collect()} == {"allow"}


@pytest.mark.skipif(not __import__("os").path.exists(SF), reason="no test tables here")
def test_url_query_blocks_by_a_cascade_of_levels(spark, monkeypatch):
    built = []
    build = url_filter.build_cascade
    monkeypatch.setattr(url_filter, "build_cascade", lambda *a: built.append(build(*a)) or built[-1])
    out = queries.op7_url_filter(spark, SF)
    assert len(built) == 4 and all(c.levels >= 1 for c in built) and max(c.levels for c in built[2:]) >= 2, "hosts and addresses are both listed"
    assert out.filter("rule is null and verdict = 'block'").count() > 50


# Line dedup

def test_a_line_said_over_and_over_keeps_its_first_fifty_words(spark):
    ten = " ".join(f"w{i}" for i in range(10))
    texts = ["\n".join([ten] * 12), "x\n" + "\n".join([ten] * 7), "\n".join(["a b", ten] * 12)]
    out = [r["text"] for r in line_dedup.line_dedup(docs(spark, texts)).orderBy("doc_id").collect()]
    assert out[0] == "\n".join([ten] * 5) and out[1] == "x"
    assert out == [brute_lines(list(enumerate(texts)))[k] for k in range(3)]


def test_line_dedup_with_hot_lines(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rng = random.Random(77)
    passage = [random_text(rng, 20, 900) for _ in range(6)]
    texts = []
    for _ in range(50):
        a = rng.randrange(4)
        texts.append("\n".join(["Licence"] * rng.randrange(3) + passage[a : a + rng.randrange(1, 6)] + [random_text(rng, 9, 9000)] + ["Licence"]))
    out = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(docs(spark, texts)).collect()}
    assert out == brute_lines(list(enumerate(texts)))
    long = line_dedup.line_dedup(docs(spark, [("one two three " * 20 + "\n") * 3000, None])).orderBy("doc_id").collect()
    assert [len(r["text"].strip("\n").split("\n")) if r["text"] else None for r in long] == [1, None]


# Mixing

def brute_taken(rows, seed=7):
    """Pareto order sampling written out: rows (doc_id, source, size)."""
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    targets = {s: round(t, 6) for s, t in brute_targets(sizes).items()}
    out = {}
    for source in sizes:
        own = [(d, n) for d, s, n in rows if s == source]
        digits = lambda n: max(1, n.bit_length())
        capped, c = set(), 0.0
        while True:  # the rate at which expected words meet the target, large documents at two copies
            rest = [(d, n) for d, n in own if digits(n) not in capped]
            weight = sum(n * digits(n) for d, n in rest)
            c = (targets[source] - 2 * sum(n for d, n in own if digits(n) in capped)) / weight if weight else 0.0
            over = {digits(n) for d, n in rest if n and c * digits(n) > 2}
            if not over or not weight:
                break
            capped |= over
        drawn, room = [], targets[source]
        for d, n in own:
            e = round(2.0 if digits(n) in capped else min(2.0, c * digits(n)), 9)
            base, p = math.floor(e), e - math.floor(e)
            out[d] = n * base
            room -= n * base
            if p > 0:
                u = (int(hashlib.md5(f"{'' if d is None else d}:{seed}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                drawn.append(((u / (1 - u)) / (p / (1 - p)), d, n))
        upto = 0
        for _, d, n in sorted(drawn):
            upto += n
            if upto - n / 2 <= room:
                out[d] += n
    return out


@pytest.mark.parametrize("cells", [256, 4])
def test_mixing_against_plain_draws(spark, monkeypatch, cells):
    monkeypatch.setattr(mixing, "CELLS", cells)
    rng = random.Random(41)
    rows = [(i, rng.choice(["a", "b", "c", None]) if i % 3 else "hot", random_text(rng, rng.choice([0, 1, 3, 40, 900]) if i != 5 else 30000)) for i in range(500)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    want = brute_taken([(i, s, len(WORD.findall(t))) for i, s, t in rows])
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(d).collect()} == want


def test_mixing_of_string_ids_and_nulls(spark):
    rows = [(f"id{i}" if i else None, f"s{i % 40:02d}", "w " * (i % 9)) for i in range(400)] + [(None, None, None), ("id7", "s07", "w " * 7)]
    d = spark.createDataFrame(rows, "doc_id string, source string, text string")
    out = mixing.mix(d).collect()
    assert len(out) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    sizes = {}
    for r in out:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = brute_targets(sizes)
    assert all(abs(r["target"] - want[r["source"]]) < 1e-3 for r in out)


# Quality rules

def test_host_verdicts_against_plain_python(spark):
    rng = random.Random(51)
    rate = {f"h{k}": r for k, r in enumerate([0.02, 0.05, 0.04, 0.5, 0.3, 0.06, 0.0])} | {None: 0.1}
    rows = [(i, "too short" if rng.random() < rate[h] else random_text(rng, 80, 100000), "en", h, 0) for i, h in enumerate(list(rate) * 90)]
    out = quality_rules.quality_rules(spark.createDataFrame(rows, DOCS)).collect()
    figures = {}
    for _, t, _, h, _ in rows:
        n, _, _, _, repeats = brute_quality(t)
        figures.setdefault(h, []).append(n < 50 or 100 * repeats > 50 * n)
    n = sum(map(len, figures.values()))
    mean = sum(map(sum, figures.values())) / n
    spread = sum(len(v) * (sum(v) / len(v)) ** 2 for v in figures.values()) / n - mean**2 - mean * (1 - mean) * len(figures) / n
    k = max(1.0, mean * (1 - mean) / spread - 1) if spread > 0 else n / len(figures)
    bad = {h for h, v in figures.items() if (sum(v) + mean * k) / (len(v) + k) > mean + 0.84 * math.sqrt(mean * (1 - mean) / (k + 1))}
    assert bad == {"h3", "h4"} or bad == {"h3"}
    assert {r["source"] for r in out if r["host_failed"]} == bad
    assert all(r["kept"] == (not r["base_failed"] and r["source"] not in bad) for r in out)


@pytest.mark.skipif(not __import__("os").path.exists(SF), reason="no test tables here")
def test_some_host_of_the_tables_fails(spark):
    out = queries.op10_quality_rules(spark, SF)
    assert out.filter("not kept and not base_failed").count() > 0


def test_words_of_a_fixture():
    assert re.fullmatch(WORD, "a") and decontamination.WORDS.findall("a-b É") == ["a", "b", "É"]


def test_languages_beyond_the_bound_are_unknown(spark):
    rows = [(i, text, lang, "s", 0) for i, (lang, text) in enumerate([("aa", "one two three four"), ("bb", "uno dos tres cuatro"), ("cc", "eins zwei drei vier")] * 30 + [("aa", "one two"), ("bb", "dos tres")])]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = language_id.train(d, F.lit(True), languages=2)
    assert {r["lang_pred"] for r in language_id.identify(d, model).collect()} <= {"aa", "bb"}
