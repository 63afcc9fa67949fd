"""The dealt operators against plain Python on small fixtures, with nulls, empty and long texts, ties, repeats and clashes."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import chat_format, decontamination, language_id, line_dedup, mixing, quality_rules, secrets, simhash, toxicity, url_filter
from tessera.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, **more):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    for name, value in more.items():
        df = df.withColumn(name, F.lit(value))
    return df


def random_text(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# Language identification

LANGUAGES = {"en": "the quick brown fox jumps over the lazy dog and then it sleeps near the old river bank",
             "de": "der schnelle braune fuchs springt über den faulen hund und schläft dann am alten flussufer",
             "fr": "le renard brun rapide saute par dessus le chien paresseux et dort près de la vieille rivière"}


def labelled(spark, n=240):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        lang = list(LANGUAGES)[i % 3]
        words = LANGUAGES[lang].split()
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randrange(5, 60))), lang, f"s{i % 3}", 0))
    return spark.createDataFrame(rows, DOCS)


def test_language_held_out_accuracy_and_und(spark):
    d = labelled(spark)
    model = language_id.train(d, F.col("doc_id") % 5 != 0)
    odd = spark.createDataFrame([(1000, None, None, None, 0), (1001, "", "en", "s", 0), (1002, "12 34 !!", "de", "s", 0), (1003, "les " * 30000, "fr", "s", 0)], DOCS)
    out = {r["doc_id"]: r for r in language_id.identify(d.unionByName(odd), model).collect()}
    test = [r for r in out.values() if r["doc_id"] < 1000 and r["doc_id"] % 5 == 0]
    assert sum(r["lang_pred"] == r["lang"] for r in test) >= 0.97 * len(test)
    assert all(out[k]["lang_pred"] == "und" and out[k]["rejected"] and out[k]["score"] == 0 for k in (1000, 1001, 1002))
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_language_rejects_what_it_never_saw(spark):
    model = language_id.train(labelled(spark), F.lit(True))
    d = docs(spark, ["ÿþýüûú ùøö÷ ÿþýüû ùøö", "the lazy dog sleeps near the river"])
    out = {r["doc_id"]: r["rejected"] for r in language_id.identify(d, model).collect()}
    assert out == {0: True, 1: False}


def test_language_rejects_unlearned_languages_and_keeps_learned(spark):
    """Languages that share letters and subwords with those learned, though none was in training."""
    rng = random.Random(13)

    def made_up(seed, n):  # words of syllables that the language prefers, over letters that all have
        own = random.Random(seed)
        syllables = [a + b for a in "bdfglmnprst" for b in "aeiou"]
        often = [own.choice(syllables) for _ in range(14)]
        return [" ".join("".join(rng.choice(often if rng.random() < 0.85 else syllables) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(30, 120))) for _ in range(n)]

    learned = [(100 * k + i, t, f"l{k}", "s", 0) for k in range(4) for i, t in enumerate(made_up(k, 100))]
    model = language_id.train(spark.createDataFrame(learned, DOCS), F.lit(True))
    fresh = [t for k in range(4) for t in made_up(k, 20)]
    letters = ["".join(rng.choice("abdefgilmnoprstu ") for _ in range(400)) for _ in range(20)]
    unlearned = [t for k in (11, 12, 13) for t in made_up(k, 20)] + letters
    out = [r["rejected"] for r in language_id.identify(docs(spark, fresh + unlearned), model).orderBy("doc_id").collect()]
    assert sum(out[: len(fresh)]) <= 2
    assert sum(out[len(fresh) :]) >= 0.9 * len(unlearned)


def test_language_result_does_not_hang_on_blocks(spark):
    model = language_id.train(labelled(spark), F.lit(True))
    d = labelled(spark, 40)
    one = {r["doc_id"]: r["score"] for r in language_id.identify(d.coalesce(1), model).collect()}
    many = {r["doc_id"]: r["score"] for r in language_id.identify(d.repartition(8), model).collect()}
    assert one == many


def test_language_empty_table_and_clashing_columns(spark):
    model = language_id.train(labelled(spark), F.lit(True))
    assert language_id.identify(docs(spark, []), model).count() == 0
    r = language_id.identify(docs(spark, ["the dog"], score="mine", rejected="mine"), model).first()
    assert isinstance(r["score"], float) and r["rejected"] in (True, False)


# Chat formatting

def turn_rows():
    return [(1, 0, "system", "be kind"), (1, 1, "user", "<|im_end|> [INST] \\ </s>"), (1, 2, "assistant", "a\\b <s> [/INST]\nx"), (1, 3, "user", None), (1, 4, "assistant", ""),
            (2, 0, None, "who"), (2, 1, "assistant", "long " * 900), (2, 2, "user", "ro"), (2, 2, "user", "ro"), (3, 0, "system", "alone"), (None, 0, "user\nx", "y")] + [
            (4, i, "user" if i % 2 == 0 else "assistant", f"turn {i} " * 8) for i in range(600)]


def test_chat_round_trip(spark):
    turns = spark.createDataFrame(turn_rows(), "conv_id long, turn long, role string, text string").withColumn("w", F.lit("clash"))
    back = chat_format.read_back(chat_format.chat_windows(turns, budget=400, history=60)).collect()
    want: dict = {}
    for c, t, r, x in sorted(turn_rows(), key=lambda v: (str(v[0]), v[1], v[2] or "", v[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    got: dict = {}
    loss: dict = {}
    for w in sorted(back, key=lambda r: (str(r["conv_id"]), r["window"])):
        got.setdefault(w["conv_id"], []).extend((t["role"], t["text"]) for t in w["new_turns"])
        loss.setdefault(w["conv_id"], []).extend(w["loss_texts"])
    assert got == want
    assert loss == {c: [x for r, x in v if r == "assistant"] for c, v in want.items()}


def test_chat_of_a_very_long_turn_and_of_none(spark):
    schema, long = "conv_id long, turn long, role string, text string", "<s> [INST] word \\\n" * 60000
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", long)], schema)
    back = sorted(chat_format.read_back(chat_format.chat_windows(turns)).collect(), key=lambda r: r["window"])
    assert [(t["role"], t["text"]) for w in back for t in w["new_turns"]] == [("user", "hi"), ("assistant", long)]
    assert "".join(x for w in back for x in w["loss_texts"]) == long
    assert chat_format.chat_windows(turns.limit(0)).count() == 0


def test_chat_budget_system_and_history(spark):
    turns = spark.createDataFrame(turn_rows(), "conv_id long, turn long, role string, text string")
    out = chat_format.chat_windows(turns, budget=400, history=60).collect()
    assert all(w["n_tokens"] <= 400 for w in out if not w["over_budget"])
    assert [w["conv_id"] for w in out if w["over_budget"]] == [2]
    of4 = [w for w in out if w["conv_id"] == 4]
    assert len(of4) > 5 and sum(w["n_repeated"] > 0 for w in of4) >= len(of4) - 1
    assert all(w["text"].startswith("<|im_start|>system\nbe kind") for w in out if w["conv_id"] == 1)
    controls = ("<s>", "</s>", "[INST]", "[/INST]")
    assert not any(c in w["text"] for w in out for c in controls)
    assert chat_format.chat_windows(turns.limit(0)).count() == 0


# Secret scans

def test_secret_base_spans(spark):
    texts = [None, "", "é password = 'abc123' token:short x", "AKIA" + "A1" * 8 + " " + "deadbeef" * 3, "Api_Key: " + "Z" * 30 + " secret=" + "ab" * 20, "x " * 20000 + "passwd=hunter2hunter2"]
    out = {r["doc_id"]: r for r in secrets.find_secrets(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        a = [m.span() for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
        k = [m.span() for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        h = [m.span() for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        want = sorted([(s, 0, e) for s, e in a] + [(s, 1, e) for s, e in k] + [(s, 2, e) for s, e in h])
        assert [tuple(x) for x in out[i]["base"]] == want
        assert (out[i]["n_assign"], out[i]["n_access"], out[i]["n_hex"]) == (len(a), len(k), len(h))


def test_weak_parts_only_together(spark):
    weak = "Q7zK9mW2xR4tB8nLpV3cJ6hG"
    together = f"client_id=app-12345 uses {weak} at https://api.host.example/v1"
    apart = f"client_id=app-12345\n\n{weak}\n\nhttps://api.host.example/v1"
    far = "client_id=app-12345 " + "word " * 200 + weak
    out = {r["doc_id"]: r["linked"] for r in secrets.find_secrets(docs(spark, [together, apart, far, weak, together])).collect()}
    assert [(x["kind"], together[x["start"] : x["end"]]) for x in out[0]] == [(3, "app-12345"), (4, weak), (5, "https://api.host.example/v1")]
    assert out[4] == out[0] and out[1] == [] and out[2] == [] and out[3] == []


def test_many_parts_in_one_scope(spark):
    text = " ".join(f"client_id=app-{i:05d} Q7zK9mW2xR4tB8nL{i:08d}" for i in range(400))
    r = secrets.find_secrets(docs(spark, [text])).first()
    assert len(r["linked"]) == 800
    assert secrets.find_secrets(docs(spark, [])).count() == 0


# Toxicity

def test_toxicity_held_out(spark):
    rng = random.Random(5)
    texts, labels = [], []
    for i in range(900):
        toxic = i % 9 == 0
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(20, 200))]
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["moron", "scum", "trash"])
        texts.append(" ".join(words))
        labels.append((i, int(toxic)))
    d = docs(spark, texts, score="clash")
    y = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(d, y, F.col("doc_id") % 4 != 2)
    assert 0 < len(model.buckets) < 5000
    out = {r["doc_id"]: r["score"] for r in toxicity.score(d, model).collect()}
    test = [(out[i], t) for i, t in labels if i % 4 == 2]
    right = sum((s >= 0.3) == bool(t) for s, t in test)
    assert right >= 0.97 * len(test)
    empty = toxicity.score(docs(spark, [None, "", "!!"]), model).collect()
    assert len({r["score"] for r in empty}) == 1 and 0 <= empty[0]["score"] < 0.3
    nothing = toxicity.train(d, y.limit(0), F.lit(True))
    assert {round(r["score"], 6) for r in toxicity.score(d, nothing).collect()} == {0.0}
    assert toxicity.score(docs(spark, []), model).count() == 0
    assert toxicity.score(docs(spark, ["scum " * 30000], SCORE="clash"), model).first()["score"] > 0.3


# Decontamination

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_hits(text, items, n=10):
    words = ALNUM.findall(lower(text))
    hit, found = set(), set()
    for item, t in items:
        w = ALNUM.findall(lower(t))
        for k in range(max(1, len(w) - n + 1)) if w else ():
            win = w[k : k + n]
            for p in range(len(words) - len(win) + 1):
                if words[p : p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(11)
    items = [(i, random_text(rng, rng.choice([0, 1, 2, 5, 9, 10, 11, 30]), 12)) for i in range(25)] + [(99, None), (5, "repeated id of an item é Ü")]
    texts = [random_text(rng, rng.randrange(0, 120), 12) for _ in range(60)] + [None, "", "É é ü", "W1-W2_w3", "repeated ID of an ITEM é Ü", random_text(rng, 30000, 50)]
    texts += [texts[3]] * 30
    texts += ["intro. " + (items[7][1] or "").upper() + " tail"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = docs(spark, texts, n_hit="clash")
    out = {r["doc_id"]: r for r in decontamination.find_phrases(d, bench).collect()}
    for i, t in enumerate(texts):
        if len(t or "") < 20000:
            assert (out[i]["n_words"], out[i]["n_hit"], out[i]["item_ids"]) == brute_hits(t, items), i
    cut = {r["doc_id"]: r["text"] for r in decontamination.find_phrases(d, bench, cut=True).collect()}
    assert all(brute_hits(t, items)[1] == 0 for t in cut.values() if len(t or "") < 20000)
    clean = [i for i, t in enumerate(texts) if out[i]["n_hit"] == 0]
    assert all(cut[i] == texts[i] for i in clean)


def test_decontamination_empty_sides(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r["n_hit"] for r in decontamination.find_phrases(docs(spark, ["a b c"]), bench).collect()] == [0]
    assert decontamination.find_phrases(docs(spark, []), bench).count() == 0


def test_suffix_array_and_index():
    rng = np.random.default_rng(2)
    text = np.append(rng.integers(1, 4, 300), 0)
    text[100] = 0
    index = decontamination.FMIndex(text, 4)
    for n in (1, 2, 5):
        for at in range(0, 90, 7):
            p = text[at : at + n]
            which, lo, hi = index.search(p[None, :], np.array([n]))
            got = sorted(index.locate(np.arange(lo[0], hi[0])).tolist())
            assert got == [k for k in range(len(text) - n + 1) if (text[k : k + n] == p).all()]


# SimHash

def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not w:
        return 0
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=3):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash_fingerprints_and_components(spark):
    rng = random.Random(7)
    base = random_text(rng, 400, 5000)
    texts = [None, "", "  ", "One", "one TWO", "Ünïcode É"] + [base] * 5 + [base + f" extra{i}" for i in range(20)] + [random_text(rng, 50, 900) for _ in range(40)]
    out = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark, texts, fp="clash")).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [out[i]["fp"] & (2**64 - 1) for i in range(len(texts))] == fps
    assert [out[i]["component_id"] for i in range(len(texts))] == brute_components(fps)
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("most", [4096, 16])
def test_near_links_with_and_without_split_tiles(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MOST", most)
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = random.Random(9)
    fps = []
    for _ in range(30):
        f = rng.getrandbits(64) & ~0xFFFF if rng.random() < 0.7 else rng.getrandbits(64)  # a common part
        for _ in range(8):
            fps.append(f)
            f ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
    fps = sorted(set(fps))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r["node"]: r["root"] for r in connected_components(simhash.near_links(df)).collect()}
    want = brute_components(fps)
    groups = {}
    for f, w in zip(signed, want, strict=True):
        groups.setdefault(w, set()).add(roots.get(f, f))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(70)]
    star = [(1000, i) for i in range(1001, 1300)]
    roots = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(path + star + [(5, 5)], "a long, b long")).collect()}
    assert {roots[i] for i in range(71)} == {0} and {roots[i] for i in range(1000, 1300)} == {1000}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# URL filters

def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(6000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = keys.filter(F.crc32("key") % 7 == 0)
    cascade = url_filter.build_cascade(listed, keys.unionByName(keys.limit(100)))
    wrong = keys.filter(cascade.contains(F.col("key")) != (F.crc32("key") % 7 == 0)).count()
    assert wrong == 0 and cascade.levels >= 2
    assert not spark.range(1).select(cascade.contains(F.lit(None).cast("string")).alias("x")).first()["x"]


def test_url_rules(spark):
    urls = ["http://A.Example.org/es/1?q", "https://example.org/en/12", "https://x.example.org/en/2", "http://a.com/fr/1", "http://a.com/de/1#x", "http://notexample.org/es/", None, "", "no scheme", "http://other.net", "http://com/de/", "http://org"]
    rules = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit("clash"))
    hosts = spark.createDataFrame([("other.net",), ("unseen.net",)], "key string")
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_filter(pages, rules, hosts).collect()}
    assert out[0] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert out[1][2:] == ("example.org/en/1", "block") and out[2][2:] == ("org/", "allow") and out[3][2:] == ("com/fr/", "allow")
    assert out[4] == ("a.com", "/de/1", "com/de/", "block") and out[5][2:] == ("org/", "allow")
    assert out[6] == out[7] == out[8] == ("", "", None, "allow") and out[9] == ("other.net", "", None, "block")
    assert out[10][2:] == ("com/de/", "block") and out[11] == ("org", "", None, "allow")


# Line dedup

def brute_lines(rows, min_words=50):
    """Every run, of all lengths, whose first occurrence is elsewhere and does not overlap it."""
    seqs = []
    for d, t in rows:
        seqs.append((d, [(no, x.strip(" \t\n\x0b\f\r")) for no, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\x0b\f\r")]))
    seen: dict = {}
    gone: dict = {}
    for d, s in seqs:
        for i in range(len(s)):
            words, run = 0, ()
            for j in range(i, len(s)):
                run += (s[j][1],)
                words += len(WORD.findall(s[j][1]))
                if words >= min_words:
                    at = seen.setdefault(run, (d, i))
                    if at != (d, i) and (at[0] != d or i > at[1] + j - i):
                        gone.setdefault(d, set()).update(range(s[i][0], s[j][0] + 1))
    out = {}
    for d, t in rows:
        out[d] = t if t is None or d not in gone else "\n".join(x for no, x in enumerate(t.split("\n")) if no not in gone[d])
    return out


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(13)
    pool = [random_text(rng, rng.choice([3, 8, 20, 60]), 500) for _ in range(14)]
    texts = []
    for _ in range(40):
        lines = [rng.choice(pool) if rng.random() < 0.7 else random_text(rng, 12, 9000) for _ in range(rng.randrange(0, 15))]
        if rng.random() < 0.3:
            lines.insert(rng.randrange(len(lines) + 1), "  ")
        texts.append("\n".join(lines))
    texts += [texts[5], None, "", "\n\n", "\n".join([pool[0]] * 40), "\t" + "\n".join(pool) + " "]
    d = docs(spark, texts, removed="clash", _h="clash")
    out = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(d).collect()}
    assert out == brute_lines(list(enumerate(texts)))


def test_line_dedup_small_cases(spark):
    passage = " ".join(f"p{i}" for i in range(51))
    d = docs(spark, [f"a\n{passage}\nb", f"c\n{passage}", "short\nline", "short\nline"])
    out = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(d).collect()}
    assert out == {0: f"a\n{passage}\nb", 1: "c", 2: "short\nline", 3: "short\nline"}
    assert line_dedup.line_dedup(docs(spark, [])).count() == 0
    twice = line_dedup.line_dedup(docs(spark, [passage]).unionByName(docs(spark, [passage]))).collect()
    assert [r["text"] for r in twice] == [passage, passage]


# Mixing

def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in capped]
        rate = (total - sum(2 * sizes[s] for s in capped)) / max(1, sum(w[s] for s in rest))
        over = {s for s in rest if rate * w[s] > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in capped else rate * w[s] for s in names}
        capped |= over


def test_mixing_targets_and_takes(spark):
    rng = random.Random(17)
    rows = [(i, random_text(rng, rng.randrange(0, 200)), "en", rng.choice(["a", "b", "c", "d", None, "Z"]) if i % 3 else "hot", 0) for i in range(1500)]
    d = spark.createDataFrame(rows + [(9999, None, None, "a", None)], DOCS).withColumn("target", F.lit("clash")).withColumn("_q", F.lit(1))
    out = mixing.mix(d).collect()
    sizes: dict = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1]))
    want = brute_targets(sizes)
    taken: dict = {}
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        assert abs(r["target"] - want[r["source"]]) < 1e-3 and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 200 for s in want)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(d.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in out}


def test_mixing_of_a_very_long_text(spark):
    out = {r["doc_id"]: r for r in mixing.mix(docs(spark, ["a b c"] * 30 + ["word " * 400000])).collect()}
    assert out[30]["size"] == 400000 and 0 <= out[30]["taken"] <= 800000


def test_mixing_empty(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.mix(docs(spark, [None, ""])).collect()] == [0, 0]


# Quality rules

def brute_quality(text):
    t = text or ""
    w = WORD.findall(t)
    wins: dict = {}
    for i in range(len(w) - 2):
        wins.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {p for v in wins.values() if len(v) > 1 for i in v for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_figures(spark):
    rng = random.Random(19)
    texts = [None, "", " \n\t", "a b c a b c", "a a a a a", "x\nx\n\nx y\nx", "é#*$ %&|<> ü", "one two"] + [random_text(rng, rng.randrange(0, 80), 9) for _ in range(50)] + ["w " * 30000]
    d = docs(spark, texts, n_words="clash", kept="clash", host="clash")
    out = {r["doc_id"]: r for r in quality_rules.quality_rules(d).collect()}
    for i, t in enumerate(texts):
        r = out[i]
        got = tuple(r[c] for c in quality_rules.FIGURES)
        assert got == brute_quality(t), i
        assert r["base_failed"] == (got[0] < 50 or 100 * got[4] > 50 * got[0])
    assert quality_rules.quality_rules(docs(spark, [])).count() == 0


def test_bad_host_takes_its_documents_along(spark):
    rng = random.Random(23)
    good = lambda: random_text(rng, 80, 100000)
    rows = [(i, "too short" if i % 10 else good(), "en", "spam", 0) for i in range(200)] + [(1000 + i, good(), "en", f"host{i % 20}", 0) for i in range(400)]
    out = quality_rules.quality_rules(spark.createDataFrame(rows, DOCS)).collect()
    assert all(not r["kept"] for r in out if r["source"] == "spam")
    assert all(r["kept"] for r in out if r["source"] != "spam")


