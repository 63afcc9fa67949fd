"""Streams: what the drained form gives equals the batch form, and late rows do not count."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.streaming import streams as X


def stream(spark, rows, schema, n):
    df = spark.createDataFrame(rows, schema)
    return X.stream_of(spark, X.in_drops(df, F.col("drop"), n, 1), df.schema, 1)


def test_late_rows_are_dropped(spark):
    rows = [(f"2024-01-0{d} 01:00:00", "a", d - 1) for d in range(1, 6)] + [("2024-01-01 02:00:00", "a", 5)]
    s = stream(spark, rows, "t string, kind string, drop int", 6).withColumn("ts", F.col("t").cast("timestamp"))
    out = {str(r["window"]["start"])[:10]: r["n"] for r in X.drained(X.windowed_counts(s, "ts", "1 day", "1 day", ["kind"]), "w").collect()}
    assert out["2024-01-01"] == 1


def test_repeated_high_spans_batches(spark):
    rows = [(i, 1, "k", float(v), i, i // 2) for i, v in enumerate([9, 9, 9, 1, 9, 9, 9, 9])]
    s = stream(spark, rows, "event_id long, user_id long, event_type string, value double, ts long, drop int", 4)
    out = X.drained(X.keyed(s, ["user_id", "event_type"], X.RepeatedHigh(5), "event_id long, user_id long, event_type string"), "r")
    assert sorted(r["event_id"] for r in out.collect()) == [2, 6, 7]


def test_sentences_across_batches(spark):
    words = ["Well,", " this is one.", " And", " two", "! rest"]
    rows = [(1, 0, i, w, i == len(words) - 1, i // 2) for i, w in enumerate(words)]
    s = stream(spark, rows, "conv_id long, turn long, no int, fragment string, last boolean, drop int", 3)
    out = X.drained(X.keyed(s, ["conv_id", "turn"], X.Sentences(), "conv_id long, turn long, sentence_no int, sentence string"), "s")
    assert [r["sentence"] for r in sorted(out.collect(), key=lambda r: r["sentence_no"])] == ["Well,", "this is one.", "And two!", "rest"]


def test_upserts_fold_batches(spark):
    s = stream(spark, [(1, 1, 5, 0), (1, 2, 6, 1), (2, 1, 7, 1)], "k int, ts int, created int, drop int", 2)
    out = X.upserted(s.drop("drop"), ["k"], "ts", "u", "created")
    assert sorted(tuple(r) for r in out.collect()) == [(1, 2, 5), (2, 1, 7)]


def test_a_call_of_a_processor_is_for_many_keys(spark, tmp_path):
    """Ids beyond 2^53, null users and null values, over batches, in one group; calls do not grow with keys."""
    big, calls = 1 << 60, tmp_path / "calls"

    class Counted(X.RepeatedHigh):
        def handleInputRows(self, key, rows, timerValues):
            with calls.open("a") as f:
                f.write("x")
            yield from super().handleInputRows(key, rows, timerValues)

    rows = [(big + 100 * i + u, None if u == 7 else u, "k", None if u == 8 and i == 1 else float(9 if u % 2 else i), i, i // 2) for i in range(4) for u in range(40)]
    s = stream(spark, rows, "event_id long, user_id long, event_type string, value double, ts long, drop int", 2)
    out = X.drained(X.keyed(s, ["user_id", "event_type"], Counted(5), "event_id long, user_id long, event_type string", groups=2), "r").collect()
    assert sorted(r["event_id"] for r in out) == sorted(big + 100 * i + u for i in (2, 3) for u in range(1, 40, 2))
    assert sum(r["user_id"] is None for r in out) == 2
    assert 1 <= len(calls.read_text()) <= 4


def test_segments_are_told_no_sooner_than_the_watermark(spark):
    """A later row of the user closes the first segment, but the last watermark, an hour behind, has not passed its end."""
    at = ["00:00:00", "00:00:10", "00:10:00", "00:10:10"]
    rows = [(None, i, f"2024-01-01 {t}", 9.0, 0) for i, t in enumerate(at)] + [(2, 9, "2024-01-01 01:05:00", 1.0, 1)]
    s = stream(spark, rows, "user_id long, event_id long, t string, value double, drop int", 2).withColumn("ts", F.col("t").cast("timestamp")).withWatermark("ts", "1 hour")
    out = X.keyed(s.select("user_id", "event_id", "ts", "value"), ["user_id"], X.Segments(5, 2, 2, 2, 60), "user_id long, segment long, started long, ended long, n long", timers=True)
    assert [(r["user_id"], r["segment"], r["n"]) for r in X.drained(out, "seg").collect()] == [(None, 1, 1)]


def test_segments_close_without_a_watermark_beyond(spark):
    rows = [(1, i, f"2024-01-01 {t}", 9.0, 0) for i, t in enumerate(["00:00:00", "00:00:10", "00:10:00"])]
    s = stream(spark, rows, "user_id long, event_id long, t string, value double, drop int", 1).withColumn("ts", F.col("t").cast("timestamp")).withWatermark("ts", "1 hour")
    out = X.keyed(s.select("user_id", "event_id", "ts", "value"), ["user_id"], X.Segments(5, 2, 2, 2, 60), "user_id long, segment long, started long, ended long, n long", timers=True)
    assert not X.drained(out, "seg").collect()
