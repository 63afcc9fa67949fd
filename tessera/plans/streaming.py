"""Queries over streams: a table lands in a few drops, in the order of time, and the stream is drained."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import records as P
from tessera.plans.registry import query, table
from tessera.sources.scratch import materialize, spread
from tessera.streaming import streams as X

DAYS = 8


def event_stream(spark, sf_dir):
    """Events in four drops of eight days each."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    drop = F.least(F.floor((F.dayofmonth("ts") - 1) / DAYS), F.lit(3))
    return X.landed(e, drop, 4)


def turn_stream(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return X.landed(t, F.least(F.floor(F.col("turn") / 3), F.lit(2)), 3)


@query("x1_activity_stream", """
WITH v AS (SELECT *, coalesce(last_value(CASE WHEN value >= 60 THEN 1 WHEN value <= 20 THEN 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS voice FROM events)
SELECT event_id, voice, sum(voice) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING) >= 2 AS active FROM v""")
def x1_stream(spark, sf_dir):
    s = event_stream(spark, sf_dir).select("event_id", "user_id", "ts", "value")
    return X.drained(X.keyed(s, ["user_id"], X.Activity(60, 20, 3, 2), "event_id long, voice int, active boolean"), "activity")


@query("x1_segments_stream", """
WITH v AS (SELECT *, coalesce(last_value(CASE WHEN value >= 60 THEN 1 WHEN value <= 20 THEN 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS voice FROM events),
a AS (SELECT *, sum(voice) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING) >= 2 AS active, floor(epoch(ts))::BIGINT AS s FROM v),
l AS (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM a WHERE active),
o AS (SELECT *, sum(CASE WHEN before IS NULL OR s - before > 36000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM l)
SELECT user_id, CAST(segment AS BIGINT) AS segment, min(s) AS started, max(s) AS ended, count(*) AS n FROM o GROUP BY user_id, segment
HAVING (max(s) + 36001) * 1000 <= (SELECT epoch_ms(max(ts)) - 3600000 FROM events)""")
def x1_segments(spark, sf_dir):
    """Segments that have ended by the last watermark, an hour behind the newest event."""
    s = event_stream(spark, sf_dir).withWatermark("ts", "1 hour").select("user_id", "event_id", "ts", "value")
    out = X.keyed(s, ["user_id"], X.Segments(60, 20, 3, 2, 36000), "user_id long, segment long, started long, ended long, n long", timers=True)
    return X.drained(out, "segments")


@query("x2_sessions_stream", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS o FROM events),
s AS (SELECT user_id, ts, sum(o) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS started, CAST(floor(epoch(max(ts) + INTERVAL 6 HOUR)) AS BIGINT) AS ended, count(*) AS n FROM s GROUP BY user_id, s
HAVING epoch_ms(max(ts) + INTERVAL 6 HOUR) <= (SELECT epoch_ms(max(ts)) - 3600000 FROM events)""")
def x2_stream(spark, sf_dir):
    """Sessions that the last watermark, an hour behind the newest event, has closed."""
    t = X.drained(X.idle_sessions(event_stream(spark, sf_dir), "user_id", "ts", "6 hours", "1 hour"), "idle")
    return t.select("user_id", F.unix_timestamp("started").alias("started"), F.unix_timestamp("ended").alias("ended"), "n")


@query("x4_quota_stream", "SELECT user_id, CAST(ts::DATE AS VARCHAR) AS day, CAST(sum(length(props)) AS BIGINT) AS used, sum(length(props)) > 20 AS over FROM events GROUP BY 1, 2")
def x4_stream(spark, sf_dir):
    totals = X.daily_totals(event_stream(spark, sf_dir), "user_id", "ts", F.length("props"), "40 days")
    t = X.upserted(totals, ["user_id", "day"], "used", "quota", mode="update")
    return t.select("user_id", F.to_date("day").cast("string").alias("day"), "used", (F.col("used") > 20).alias("over"))


@query("x3_sessions_stream", "SELECT conv_id, max(turn) AS turn, max_by(role, turn) AS role, min(turn) AS created FROM conversations GROUP BY conv_id")
def x3(spark, sf_dir):
    s = turn_stream(spark, sf_dir).select("conv_id", "turn", "role", F.col("turn").alias("created"))
    return X.upserted(s, ["conv_id"], "turn", "sessions", "created")


@query("x5_deduplicated_stream", "SELECT DISTINCT user_id, event_type, CAST(ts::DATE AS VARCHAR) AS day FROM events")
def x5(spark, sf_dir):
    s = event_stream(spark, sf_dir).select("user_id", "event_type", F.date_trunc("day", "ts").alias("day"))
    return X.drained(X.deduplicated(s, ["user_id", "event_type", "day"], "day", "40 days"), "intakes").select("user_id", "event_type", F.to_date("day").cast("string").alias("day"))


@query("x6_alerts_stream", """
SELECT event_id, user_id, event_type FROM (SELECT *, count(*) OVER w AS n, min(value) OVER w AS m FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS 2 PRECEDING)) WHERE n = 3 AND m > 50""")
def x6(spark, sf_dir):
    s = event_stream(spark, sf_dir).select("event_id", "user_id", "event_type", "ts", "value")
    return X.drained(X.keyed(s, ["user_id", "event_type"], X.RepeatedHigh(50), "event_id long, user_id long, event_type string"), "alerts")


@query("x6_every_alert_stream", """
SELECT event_id, user_id, CASE WHEN value < 3 THEN 'severe_low' WHEN value <= 6 THEN 'low' WHEN value >= 200 THEN 'very_high' ELSE 'above_target' END AS code FROM events WHERE value <= 6 OR value > 80
UNION ALL SELECT event_id, user_id, 'repeated_high' FROM (SELECT *, count(*) OVER w AS n, min(value) OVER w AS m FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS 2 PRECEDING)) WHERE n = 3 AND m > 50""")
def x6_every(spark, sf_dir):
    """Alerts of a reading's level, which need no state, and of repeated high readings, in one stream."""
    s = event_stream(spark, sf_dir).select("event_id", "user_id", "event_type", "ts", "value")
    level = s.select("event_id", "user_id", P.level(F.col("value"), F.lit(80.0), 6, 3, 200).alias("code")).filter("code is not null")
    high = X.keyed(s, ["user_id", "event_type"], X.RepeatedHigh(50), "event_id long, user_id long, event_type string")
    return X.drained(level.unionByName(high.select("event_id", "user_id", F.lit("repeated_high").alias("code"))), "alerts")


@query("x7_compaction_stream", """
WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), g AS (SELECT *, (i - 1) // 3 AS batch FROM t)
SELECT conv_id, batch, min(turn) AS first_turn, max(turn) AS last_turn FROM g WHERE n >= 5 + 3 * batch GROUP BY conv_id, batch""")
def x7(spark, sf_dir):
    s = turn_stream(spark, sf_dir).select("conv_id", "turn")
    return X.drained(X.keyed(s, ["conv_id"], X.Compaction(4, 2), "conv_id long, batch int, first_turn long, last_turn long"), "compaction").withColumn("batch", F.col("batch").cast("long"))


def late_stream(spark, sf_dir):
    """Events in drops of days; a last drop repeats the first day's rows, which are behind the watermark by then."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    drop = F.least(F.floor((F.dayofmonth("ts") - 1) / DAYS), F.lit(3))
    every = e.withColumn("drop", drop.cast("int")).unionByName(e.filter(F.dayofmonth("ts") == 1).withColumn("drop", F.lit(4)))
    return X.landed(every, F.col("drop"), 5).drop("drop")


@query("x8_late_rows_stream", """
WITH d AS (SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT CAST(day AS VARCHAR) AS day, event_type, n FROM d WHERE epoch_ms(day + INTERVAL 1 DAY) <= (SELECT epoch_ms(max(ts)) - 86400000 FROM events)""")
def x8(spark, sf_dir):
    """Daily counts of the days that the watermark has closed; late rows do not count."""
    s = late_stream(spark, sf_dir)
    c = X.drained(X.windowed_counts(s, "ts", "1 day", "1 day", ["event_type"]), "late")
    return c.select(F.to_date("window.start").cast("string").alias("day"), "event_type", "n")


@query("x8_progress_stream", """
WITH d AS (SELECT least(floor((dayofmonth(ts) - 1) / 8), 3) AS batch, ts FROM events UNION ALL SELECT 4, ts FROM events WHERE dayofmonth(ts) = 1)
SELECT CAST(batch AS BIGINT) AS batch, count(*) AS n_rows, batch = 4 AS late FROM d GROUP BY batch""")
def x8_progress(spark, sf_dir):
    """The batches of the stream of late rows: how many rows each brought, and which brought rows behind the watermark."""
    s = late_stream(spark, sf_dir).observe("landed", F.count("*").alias("n"))
    return X.drained_with_progress(X.windowed_counts(s, "ts", "1 day", "1 day", ["event_type"]), "late")[1].select("batch", "n_rows", "late")


@query("x9_sentences_stream")
def x9(spark, sf_dir):
    t = spread(table(spark, sf_dir, "conversations").filter("role = 'assistant'")).select("conv_id", "turn", F.split("text", "(?<= )").alias("said"))
    t = t.select("conv_id", "turn", F.size("said").alias("n"), F.posexplode("said").alias("no", "fragment"))
    t = t.select("conv_id", "turn", "no", "fragment", (F.col("no") == F.col("n") - 1).alias("last"))
    # Texts are split once, not for each drop.
    s = X.landed(materialize(t, "fragments"), F.least(F.floor(F.col("no") / 40), F.lit(2)), 3)
    return X.drained(X.keyed(s, ["conv_id", "turn"], X.Sentences(), "conv_id long, turn long, sentence_no int, sentence string"), "sentences")
