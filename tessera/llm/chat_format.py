"""Chat formatting into windows of a token budget, in DataFrame functions.

Prefix sums of the turns' tokens deal a conversation's turns to windows. They are taken in two steps, over blocks of a
conversation and then within a block, so that a conversation of any length is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed marks of the template; texts never hold one, because ESCAPED puts a backslash inside each.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Control strings of this and other common templates: the backslash goes after their first character.
CONTROL = r"([<\[])((?:\||s>|/s>|<SYS>>|</SYS>>)|/?INST\])"
TURN_TOKENS = 4
BLOCK = 256


def escape(text: Column) -> Column:
    """Double each backslash, then put one into each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    """Like escape; a role ends at the first line feed, so its own become a mark that escape never yields."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n>"), F.lit("\n")))


def approximate_tokens(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up, and the turn's marks. Pass another column for a tokenizer's own counts."""
    return F.ceil(F.octet_length(text) / 4).cast("long") + TURN_TOKENS


def chat_windows(turns: DataFrame, budget: int = 2048, history: int = 256, target_role: str = "assistant", tokens: Column | None = None) -> DataFrame:
    """One row per window: conv_id, window, text, loss_spans, n_repeated, n_turns, n_tokens and over_budget.

    turns has conv_id, turn, role and text. Turns go in the order of turn, role and text; a null text or role is empty.
    A first turn of role system is retained at the head of every window. New turns fill a window by prefix sums: with
    room = (budget - history - system) / 2, a turn belongs to the room in which its first token falls, so windows hold
    whole turns and stay in the budget as long as no turn is longer than the room. A longer turn has a window of its
    own, flagged over_budget where it does not fit. The last turns of the window before, up to history tokens, come again. Each
    turn is new in exactly one window and only new turns of target_role are under loss_spans (code points of text,
    end exclusive, still escaped). n_repeated turns at the head of a window are repeats. Repeated rows are turns of
    their own; a null conv_id is a conversation of its own. Empty turns give no windows; columns of turns other than the four
    are left out, so no name clashes.
    """
    t = turns.select(
        F.col("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("k", (tokens if tokens is not None else approximate_tokens(F.col("text"))).cast("long"))
    t = t.withColumn("b", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK))

    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    in_block = Window.partitionBy("conv_id", "b").orderBy(*order)
    blocks = t.groupBy("conv_id", "b").agg(
        F.sum("k").alias("bk"),
        F.min_by(F.struct("role", "text", "k"), F.struct("turn", "role", "text")).alias("head"))
    conv = Window.partitionBy("conv_id").orderBy("b")
    blocks = blocks.withColumn("head", F.first("head").over(conv)).withColumn("to", F.sum("bk").over(conv) - F.col("bk"))
    blocks = blocks.withColumn("first_block", F.row_number().over(conv) == 1)
    has_system = F.col("head.role") == "system"
    blocks = blocks.select(
        F.col("conv_id").alias("c2"), F.col("b").alias("b2"), "to", "first_block",
        F.when(has_system, F.col("head.text")).alias("system"), F.when(has_system, F.col("head.k")).otherwise(0).alias("system_k"))

    t = t.withColumn("at", F.sum("k").over(in_block.rowsBetween(Window.unboundedPreceding, 0)) - F.col("k"))
    t = t.withColumn("n_in_block", F.row_number().over(in_block))
    t = t.join(blocks, t["conv_id"].eqNullSafe(blocks["c2"]) & (t["b"] == blocks["b2"]))
    # The system turn stands before all windows: sums start after it.
    t = t.withColumn("is_system", F.col("first_block") & (F.col("n_in_block") == 1) & F.col("system").isNotNull())
    t = t.withColumn("s", F.col("to") + F.col("at") - F.when(F.col("is_system"), 0).otherwise(F.col("system_k")))
    t = t.withColumn("room", F.greatest(F.lit(1), F.floor((F.lit(budget - history) - F.col("system_k")) / 2)))
    # A turn longer than the room starts at its own number: between the rooms before and after it.
    t = t.withColumn("w", 2 * F.floor(F.col("s") / F.col("room")) + F.when(F.col("k") > F.col("room"), 1).otherwise(0))
    t = t.withColumn("w", F.when(F.col("is_system"), 0).otherwise(F.col("w")))

    # Windows of a conversation: where each ends, and which comes next.
    ends = t.filter(~F.col("is_system")).groupBy("conv_id", "w").agg((F.max(F.col("s") + F.col("k"))).alias("end"))
    ends = ends.withColumn("next", F.lead("w").over(Window.partitionBy("conv_id").orderBy("w")))
    ends = ends.withColumn("no", F.row_number().over(Window.partitionBy("conv_id").orderBy("w")) - 1)
    ends = ends.select(F.col("conv_id").alias("c3"), F.col("w").alias("w3"), "end", "next", "no")
    t = t.join(ends, t["conv_id"].eqNullSafe(ends["c3"]) & (t["w"] == ends["w3"]), "left")

    again = ~F.col("is_system") & F.col("next").isNotNull() & (F.col("end") - F.col("s") <= history)
    no = F.coalesce(F.col("no"), F.lit(0))
    spots = F.filter(F.array(
        F.struct(no.alias("no"), F.lit(True).alias("new")),
        F.when(again, F.struct((no + 1).alias("no"), F.lit(False).alias("new"))),
    ), lambda x: x.isNotNull())
    rows = t.withColumn("spot", F.explode(spots))
    turn = F.struct(
        F.col("s"), F.col("turn"), F.col("role"), F.col("text"), F.col("k"), F.col("spot.new").alias("new"))
    grouped = rows.groupBy("conv_id", F.col("spot.no").alias("window")).agg(
        F.array_sort(F.collect_list(F.when(~F.col("is_system"), turn))).alias("turns"),
        F.first("system").alias("system"), F.first("system_k").alias("system_k"), F.max("is_system").alias("has_system"))

    def shown(role: Column, text: Column) -> Column:
        return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE))

    piece = lambda x: F.struct(
        escape_role(x["role"]).alias("role"), escape(x["text"]).alias("text"), x["new"].alias("new"), (x["role"] == target_role).alias("target"))
    head = F.when(F.col("system").isNotNull(), F.array(F.struct(
        F.lit("system").alias("role"), escape(F.col("system")).alias("text"), F.col("has_system").alias("new"), F.lit(target_role == "system").alias("target"))))
    pieces = grouped.withColumn("pieces", F.concat(F.coalesce(head, F.array().cast(
        "array<struct<role:string,text:string,new:boolean,target:boolean>>")), F.transform("turns", piece)))
    pieces = pieces.withColumn("text", F.array_join(F.transform("pieces", lambda x: shown(x["role"], x["text"])), ""))
    span = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + F.length(shown(x["role"], x["text"]))).alias("at"),
            F.when(x["new"] & x["target"], F.array_append(a["spans"], F.struct(
                (a["at"] + F.length(x["role"]) + len(OPEN) + 1).alias("start"),
                (a["at"] + F.length(x["role"]) + len(OPEN) + 1 + F.length(x["text"])).alias("end")))).otherwise(a["spans"]).alias("spans")),
        lambda a: a["spans"])
    n_tokens = F.aggregate("turns", F.lit(0).cast("long"), lambda a, x: a + x["k"]) + F.col("system_k")
    return pieces.select(
        "conv_id", "window", "text", span.alias("loss_spans"),
        F.size(F.filter("pieces", lambda x: ~x["new"])).alias("n_repeated"), F.size("pieces").alias("n_turns"),
        n_tokens.alias("n_tokens"), (n_tokens > budget).alias("over_budget"))


def read_back(windows: DataFrame) -> DataFrame:
    """windows with the new turns (array of role and text) and the loss texts, parsed from the formatted text."""
    parts = F.filter(F.split("text", r"<\|im_end\|>\n", -1), lambda x: x != "")
    body = lambda x: F.substring(x, F.lit(len(OPEN) + 1), F.length(x))
    parsed = F.transform(parts, lambda x: F.struct(
        unescape_role(F.substring_index(body(x), "\n", 1)).alias("role"),
        unescape(F.substring(body(x), F.locate("\n", body(x)) + 1, F.length(x))).alias("text")))
    new = F.slice(parsed, F.col("n_repeated") + 1, F.greatest(F.size(parsed), F.lit(1)))
    loss = F.transform("loss_spans", lambda x: unescape(F.substring(F.col("text"), x["start"] + 1, x["end"] - x["start"])))
    return windows.withColumn("new_turns", new).withColumn("loss_texts", loss)
