"""The pipeline's stages on a small corpus: what each removes and what it leaves alone."""

from __future__ import annotations

import random

import corpus_pipeline
from tests.llm.test_operators import DOCS, LANGUAGES, brute_hits, brute_lines


def corpus():
    rng = random.Random(29)
    rows = []
    for i in range(90):
        lang = list(LANGUAGES)[i % 3]
        words = LANGUAGES[lang].split()
        lines = [" ".join(rng.choice(words) + (f"x{rng.randrange(9)}" if rng.random() < 0.3 else "") for _ in range(rng.randrange(20, 40))) for _ in range(3)]
        rows.append([i, "\n".join(lines), lang, f"s{i % 4}", 0])
    passage = " ".join(f"the{i % 7} old{i} river" for i in range(20))
    rows[10][1] += "\n" + passage
    rows[20][1] += "\n" + passage
    rows[31][1] = rows[30][1]
    rows[40][1] += " sleeps near the seven old river banks of a very far land"
    rows += [[200, None, None, None, None], [201, "123 456", "en", "s1", 0], [None, "the quick brown fox sleeps near the river bank", "en", "s1", 0], [50, rows[50][1], "en", rows[50][3], 0]]
    return [tuple(r) for r in rows], passage, "sleeps near the seven old river banks of a very far land"


def test_stages(spark, tmp_path):
    rows, passage, item = corpus()
    docs = spark.createDataFrame(rows, DOCS).withColumnRenamed("n_chars", "n_chars")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        now = spark.read.parquet(path)
        if name != "mixing":
            assert now.columns == docs.columns
        seen[name] = {(r["doc_id"], r["text"]) for r in now.collect()}
    ids = {n: {d for d, _ in v} for n, v in seen.items()}
    # Nothing without a letter stays; of the others the score rejects two in a hundred at most, and one of this few.
    assert not ids["language_id"] & {200, 201} and len({r[0] for r in rows} - {200, 201} - ids["language_id"]) <= 2

    by_id = sorted(((d, t) for d, t in seen["language_id"] if d is not None), key=lambda x: x[0])
    want = brute_lines(by_id)
    assert {(d, t) for d, t in seen["line_dedup"] if d is not None} == set(want.items())
    assert passage in want[10] and passage not in want[20] and want[31] == ""

    assert sum(t == "" for _, t in seen["simhash"]) <= 1 and ids["simhash"] >= {0, 1, 2, None}
    assert all(brute_hits(t, [(0, item)])[1] == 0 for _, t in seen["decontamination"])
    untouched = {(d, t) for d, t in seen["simhash"] if brute_hits(t, [(0, item)])[1] == 0}
    assert untouched <= seen["decontamination"]
    assert now.columns == [*docs.columns, "size", "source_size", "target", "copy"]
    assert {r["copy"] for r in now.collect()} <= {1, 2}


def test_run_is_all_stages(spark, tmp_path):
    rows, _, item = corpus()
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    once, again = (sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) for _ in range(2))
    assert once == again and once


def test_stages_on_empty_tables_long_texts_and_clashing_columns(spark, tmp_path):
    rows, _, item = corpus()
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/full/benchmark.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/empty/benchmark.parquet")
    long = (500, "\n".join(f"the quick brown fox number {i} sleeps near the old river bank" for i in range(20000)), "en", "s1", 0)
    clash = spark.createDataFrame([*rows, long], DOCS).selectExpr("*", "1 as fp", "'x' as rejected", "2 as component_id", "'y' as removed", "3 as _id")
    for name, stage in corpus_pipeline.STAGES:
        for given in (clash, clash.limit(0)):
            for folder in ("full", "empty"):
                out = stage(spark, given, f"{tmp_path}/{folder}")
                n = out.count()
                assert (n == 0) == (given is not clash), name
                assert name == "mixing" or out.columns == clash.columns
