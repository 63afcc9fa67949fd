"""Conversation memory: turn selection, compaction, rule extraction, weights, upserts, decay and promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def messages(turns: DataFrame) -> DataFrame:
    """User, assistant and tool turns with text; JSON content is unwrapped."""
    content = F.coalesce(F.get_json_object(F.when(F.startswith(F.ltrim("text"), F.lit("{")), F.col("text")), "$.content"), F.col("text"))
    return turns.filter("role <> 'system'").withColumn("text", F.trim(content)).filter("text <> ''")


def last_turns(turns: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return turns.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def trimmed_history(turns: DataFrame, max_turns: int) -> DataFrame:
    """System turns, and the last max_turns user turns with all that follows each; short conversations stay whole."""
    w = Window.partitionBy("conv_id")
    back = w.orderBy(F.col("turn").desc()).rowsBetween(Window.unboundedPreceding, 0)
    talk = F.col("role") != "system"
    t = turns.withColumn("_all", F.count("*").over(w)).withColumn("_talk", F.sum(talk.cast("int")).over(w))
    t = t.withColumn("_users", F.sum((F.col("role") == "user").cast("int")).over(back))
    short = (F.col("_all") <= 2 * max_turns + 1) | (F.col("_talk") <= 2 * max_turns)
    # A row before the oldest kept user turn has all of them behind it.
    inside = (F.col("_users") < max_turns) | ((F.col("_users") == max_turns) & (F.col("role") == "user"))
    return t.filter(short | ~talk | inside).drop("_all", "_talk", "_users")


def compaction(turns: DataFrame, trigger: int = 18, keep: int = 8) -> DataFrame:
    """turns with part: to_summarise or kept. Past the trigger the last keep stay, reaching back over tool turns at their head."""
    w = Window.partitionBy("conv_id")
    back = w.orderBy(F.col("turn").desc())
    t = turns.withColumn("_all", F.count("*").over(w)).withColumn("_r", F.row_number().over(back))
    # The first turn at or before the cut that is no tool turn ends the reach.
    stop = F.min(F.when((F.col("_r") >= keep) & (F.col("role") != "tool"), F.col("_r"))).over(w)
    kept = (F.col("_all") <= trigger) | (F.col("_r") <= F.greatest(F.coalesce(stop, F.lit(keep)), F.lit(keep)))
    return t.withColumn("part", F.when(kept, "kept").otherwise("to_summarise")).drop("_all", "_r")


def rule_summary(turns: DataFrame, keywords: list[str], window: int = 24, lines: int = 12, clip: int = 180, most: int = 2000) -> DataFrame:
    """(conv_id, summary): of the last window turns the last lines that a user said or that hold a keyword."""
    t = last_turns(turns, window).filter((F.col("role") == "user") | F.lower("text").rlike("|".join(keywords)))
    t = last_turns(t, lines)
    said = F.concat("role", F.lit(": "), F.substring(T.collapse(F.col("text")), 1, clip))
    per = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", said.alias("s")))).alias("x"))
    return per.select("conv_id", F.substring(F.array_join("x.s", "\n"), 1, most).alias("summary"))


def extracted(texts: DataFrame, patterns: dict[str, str], key: str = "conv_id") -> DataFrame:
    """(key, attribute, value) of each pattern's matches; keys without any are noise and give no row."""
    parts = [texts.select(key, F.lit(a).alias("attribute"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(p), F.lit(1)))).alias("value")) for a, p in patterns.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def prepared_weight(layer: Column, importance: Column) -> Column:
    return F.when(layer == "factual", 1.0).when(layer == "semantic", F.greatest(importance, F.lit(0.2))).otherwise(F.greatest(importance, F.lit(0.15)))


def upsert_memories(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Memories (user_id, dedupe_key, layer, value, evidence, ts): a factual one keeps its value and logs a conflict; others
    take the incoming value; evidence is united."""
    keys = ["user_id", "dedupe_key", "layer"]
    newest = incoming.groupBy(*keys).agg(F.max_by("value", "ts").alias("new"), F.flatten(F.array_sort(F.collect_list("evidence"))).alias("more"))
    j = existing.join(newest, keys, "full_outer")
    factual = (F.col("layer") == "factual") & F.col("value").isNotNull()
    clash = factual & F.col("new").isNotNull() & (F.col("new") != F.col("value"))
    return j.select(*keys, F.when(factual, F.col("value")).otherwise(F.coalesce("new", "value")).alias("value"),
                    F.array_union(F.coalesce("evidence", T.empty_strings()), F.coalesce("more", T.empty_strings())).alias("evidence"),
                    F.when(clash, F.col("new")).alias("conflict"))


def decayed(importance: Column, age_days: Column, half_life: Column, least: float = 0.08) -> Column:
    """From the importance, not the last weight, so that repeating it changes nothing."""
    return F.greatest(F.lit(least), importance * F.exp(-F.log(F.lit(2.0)) * F.greatest(age_days, F.lit(0.0)) / F.greatest(half_life, F.lit(0.1))))


def promoted(episodes: DataFrame, now: str, days: int = 30, newest: int = 40, least: int = 3) -> DataFrame:
    """(user_id, attribute, n, weight, value) of attributes with least or more among a user's newest episodes in the window."""
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("id").desc())
    recent = episodes.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= newest).filter(F.col("ts") >= F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days)))
    per = recent.groupBy("user_id", "attribute").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("_n", "value"))).alias("v")).filter(F.col("n") >= least)
    return per.select("user_id", "attribute", "n", F.round(F.least(F.lit(0.92), 0.65 + 0.05 * F.col("n")), 4).alias("weight"), F.array_join(F.slice("v.value", 1, 3), "; ").alias("value"))


def session_rollup(turns: DataFrame, ts: Column) -> DataFrame:
    """Per conversation: title, preview, first and last time, counts, tool and image use, the last twelve roles."""
    t = turns.withColumn("ts", ts)
    order = F.struct("turn", "role")
    return t.groupBy("conv_id").agg(
        F.substring(F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))), 1, 40).alias("title"),
        F.substring(F.max_by("text", order), 1, 80).alias("preview"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"),
        F.count("*").alias("n_messages"), F.bool_or(F.col("role") == "tool").alias("has_tool"), F.bool_or(F.contains("text", F.lit("image"))).alias("has_vision"),
        F.array_join(F.slice(F.reverse(F.array_sort(F.collect_list(order))), 1, 12)["role"], ",").alias("last_roles"))


def daily_quota(rows: DataFrame, key: str, ts: str, amount: Column, limit: float) -> DataFrame:
    return rows.groupBy(key, F.to_date(ts).alias("day")).agg(F.sum(amount).alias("used")).withColumn("over", F.col("used") > limit)
