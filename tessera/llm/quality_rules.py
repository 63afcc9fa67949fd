"""Document quality rules with host-level verdicts, in DataFrame functions only.

Every rule figure of a document comes from one projection over its own text, so that no text and no word is shuffled.
What is shuffled is one small row per document, pre-aggregated by host.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, join_hot, materialize, unpack, words

SYMBOLS = "#*$%&|<>"
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rule_figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words to docs, whose text column is dropped.

    A null text counts as empty. A word is a maximal run without blanks. n_repeat_words counts the words inside any
    window of three words that occurs at least twice in the text. Windows are compared by the chained 64-bit hash of
    their words, within one text only.
    """
    kept = [c for c in docs.columns if c != text and c not in FIGURES]
    t = docs.select(*kept, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    t = t.select(*kept, "_t", words(F.col("_t")).alias("_w"))
    w, n = F.col("_w"), F.size("_w")
    lines = F.filter(F.split("_t", "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    windows = F.when(n > 2, F.sort_array(F.transform(
        F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))),
        lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i")),
    )))
    t = t.select(
        *kept,
        n.cast("long").alias("n_words"),
        F.length(F.translate("_t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_l"),
        windows.alias("_s"),
    )
    s = F.col("_s")
    twice = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
    starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return t.select(
        *kept, "n_words", "word_chars", "n_symbols",
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
    )


def base_failed(min_words: int = 50, max_repeat_percent: int = 50):
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """(alpha, beta) of a beta prior over the hosts' failure rates, by the method of moments.

    hosts has n and failed. Only three sums reach the driver. Hosts weigh by their documents, and the spread that
    sampling alone would give is taken off. Where no spread is left, the prior is as strong as the mean host is large.
    """
    row = hosts.agg(
        F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.count("*").alias("hosts"),
        F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("ff"),
    ).first()
    if not row["n"]:
        return 1.0, 1.0
    n, hosts_n = float(row["n"]), float(row["hosts"])
    mean = float(row["failed"]) / n
    between = float(row["ff"]) / n - mean * mean - mean * (1 - mean) * hosts_n / n
    if mean in (0.0, 1.0):
        strength = n / hosts_n
    elif between <= 0:
        strength = n / hosts_n
    else:
        strength = max(1.0, mean * (1 - mean) / between - 1)
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    return mean * strength, (1 - mean) * strength


def quality_rules(docs: DataFrame, host: str = "source", spread: float = 0.84, text: str = "text") -> DataFrame:
    """One row per row of docs: its columns without the text, the rule figures, base_failed, host_rate, host_failed and kept.

    host_rate: the host's failure rate, shrunk to the prior. host_failed: it lies more than spread standard deviations of
    the fitted prior above the prior's mean (0.84: about where the prior's upper fifth begins). So the cut follows the corpus: where
    all hosts fail alike, shrinking leaves few or none above it. A null host is a host of its own. An empty table gives
    an empty result; repeated rows are judged each by itself and all count for their host. Added columns replace columns
    of docs of the same name.
    """
    rest = [c for c in docs.columns if c != text]
    packed = docs.select(F.col(text).alias("text"), F.col(host).alias("host"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("__row"))
    # No host has the empty name: null has it.
    named = F.coalesce(F.concat(F.lit("="), F.col("host").cast("string")), F.lit(""))
    each = materialize(rule_figures(packed, "text").withColumn("base_failed", base_failed()).withColumn("_host", named), "quality")
    hosts = each.groupBy("_host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    hosts = materialize(hosts, "hosts")
    alpha, beta = beta_prior(hosts)
    whole = alpha + beta
    cut = alpha / whole + spread * math.sqrt(alpha * beta / (whole * whole * (whole + 1)))
    verdicts = hosts.select("_host", ((F.col("failed") + alpha) / (F.col("n") + whole)).alias("host_rate"))
    out = join_hot(each, verdicts, ["_host"], hosts.select("_host", "n"), hosts.agg(F.sum("n")).first()[0] or 0)
    out = out.withColumn("host_failed", F.col("host_rate") > cut)
    return unpack(out, rest, **{c: F.col(c) for c in (*FIGURES, "base_failed", "host_rate", "host_failed")}, kept=~F.col("base_failed") & ~F.col("host_failed"))
