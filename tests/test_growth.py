"""Work that grows no faster than the input: parts of a stream's state, rows that are handed over together."""

from __future__ import annotations

import math
import os
import re

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import grams, index
from tessera.operators import search as S
from tessera.streaming import streams as X


def test_a_stream_has_a_few_parts_of_state_for_each_core(spark, tmp_path, monkeypatch):
    """A part costs half a second a batch, however few its rows."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(X, "new_path", lambda spark, name: f"{tmp_path}/{name}")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        df = spark.createDataFrame([(i, i % 9, "k", 9.0, i) for i in range(30)], "event_id long, user_id long, event_type string, value double, ts long")
        s = X.stream_of(spark, X.in_drops(df, F.lit(0), 1, 1), df.schema)
        assert X.drained(X.keyed(s, ["user_id"], X.RepeatedHigh(5), "event_id long, user_id long, event_type string"), "r").count() == 12
        assert spark.conf.get("spark.sql.shuffle.partitions") == "64"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    parts = [d for d in os.listdir(tmp_path / "r-state" / "state" / "0") if d.isdigit()]
    assert len(parts) == X.STATE_PARTS * spark.sparkContext.defaultParallelism


def test_rows_of_a_group_are_handed_over_together(monkeypatch):
    big = 1 << 60
    rows = pa.table({"id": [big + i for i in range(40)], "user": [None if i % 5 else i for i in range(40)], "text": [str(i) for i in range(40)],
                     "state_group": pa.array([i % 3 for i in range(40)], pa.int32())})
    out = list(X._packed(iter(rows.to_batches(max_chunksize=7))))
    assert [b.num_rows for b in out] == [3] and out[0]["state_group"].to_pylist() == [0, 1, 2]
    for group, value in zip(*out[0].to_pydict().values(), strict=True):
        got = X._together(iter([pa.table({"packed": [value]}).to_pandas()]))
        assert got["id"].tolist() == [big + i for i in range(group, 40, 3)] and got["text"].tolist() == [str(i) for i in range(group, 40, 3)]
        assert got["user"].tolist() == [None if i % 5 else i for i in range(group, 40, 3)]
    monkeypatch.setattr(X, "PACKED_BYTES", 1)
    assert sum(len(X._together(iter([b.to_pandas()]))) for b in X._packed(iter(rows.to_batches(max_chunksize=7)))) == 40


def test_records_of_the_same_text_are_searched_once(spark, monkeypatch):
    texts = []
    monkeypatch.setattr(S, "containing", lambda *a: texts.append(a[0]) or grams.containing(*a))
    records = spark.createDataFrame([(k, i, "red" if i % 2 else None, "Red of all" if i % 2 else "none") for k in ("b", "a") for i in range(200)], "type string, id long, title string, search_text string")
    asked = spark.createDataFrame([(1, "red"), (2, "none of")], "item_id long, text string")
    got = sorted((r["item_id"], r["rank"], r["type"], r["id"], r["score"]) for r in S.structured_search(records, asked, 3).collect())
    assert got == [(1, n + 1, "a", 2 * n + 1, 42.5) for n in range(3)] + [(2, n + 1, "a", n, 2.5) for n in range(3)]
    assert texts[0].count() == 2


def test_a_text_is_collapsed_once_for_its_snippet(spark):
    docs = spark.createDataFrame([(" a\t\n b  word  c ",), ("x" * 200 + "\n\nword",), (None,), ("\u00a0 y",)], "text string")
    out = docs.select(T.snippet(F.col("text"), F.array(F.lit("none"), F.lit("word"))).alias("s"))
    assert [r["s"] for r in out.collect()] == ["a b word c", "..." + "x" * 79 + " word", "", "\u00a0 y"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1


def test_texts_are_counted_in_parts_of_so_many_words(spark, tmp_path, monkeypatch):
    """A part of the index's texts does not grow with the texts."""
    calls, docs = [], spark.createDataFrame([(i, "some words " * 10) for i in range(100)], "doc_id long, text string")
    kind = type(docs)
    as_was = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda df, *a: calls.append(a) or as_was(df, *a))
    monkeypatch.setattr(index, "PART_WORDS", 150)
    got = index.write_index(docs, f"{tmp_path}/index").tokens().collect()
    assert sorted(tuple(r) for r in got) == [("some", 100, 1000), ("words", 100, 1000)]
    assert (14, "segment") in calls


def test_ranking_keeps_no_table_of_tokens_and_documents(spark):
    docs = spark.createDataFrame([(i, "alpha beta alpha" if i % 2 else "beta", "alpha" if i == 4 else None) for i in range(8)], "doc_id long, text string, source string")
    asked = spark.createDataFrame([(1, "alpha"), (2, "none")], "item_id long, text string")
    out = S.idf_rank(docs, asked, {"text": 1.0, "source": 3.0}, 3)
    idf = math.log(9 / 5) + 1
    assert [(r["item_id"], r["doc_id"], r["score"], r["rank"]) for r in out.orderBy("rank").collect()] == [(1, 4, round(3 * idf, 6), 1), (1, 1, round(idf, 6), 2), (1, 3, round(idf, 6), 3)]
    assert not re.search(r"hashpartitioning\(tok#\d+, doc_id", out._jdf.queryExecution().executedPlan().toString())
