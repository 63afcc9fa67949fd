"""Rule sets: nested conditions compiled to boolean columns, all rules in one pass over the records."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.grams import containing

#: Populations, and the ages under and from which two of them are.
POPULATIONS, CHILD, OLDER = ("pregnancy", "child", "older_adult"), 18, 65
#: An ASCII word of a rule, and what separates the parts of one.
ASCII_WORD, SEPARATORS = r"[a-z0-9_ -]+", r"[_\s-]+"


def _plain(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def _contains(values: Column, word: str) -> Column:
    """ASCII words match whole, with _, - and blanks as one separator; others as substrings. values: normalised strings."""
    if not word:
        return F.lit(False)
    if re.fullmatch(ASCII_WORD, word):
        w = re.escape(re.sub(SEPARATORS, " ", word).strip())
        return F.exists(values, lambda x: F.trim(F.regexp_replace(x, SEPARATORS, " ")).rlike(rf"(?<![a-z0-9]){w}(?![a-z0-9])"))
    return F.exists(values, lambda x: F.contains(x, F.lit(word)))


def _as_strings(df: DataFrame, field: str) -> Column:
    """The field's value or values, trimmed and lower-cased; none for a null field."""
    is_list = dict(df.dtypes).get(field.split(".")[0], "").startswith("array")
    values = F.col(field).cast("array<string>") if is_list else F.when(F.col(field).isNotNull(), F.array(F.col(field).cast("string")))
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), _plain)


def predicate(df: DataFrame, clause: dict[str, Any]) -> Column:
    """A leaf: field (dotted), operator and values; op and value are taken too.

    Both sides are trimmed and in lower case. equals holds where the field, or an empty text for a null one, is among the
    values; numbers compare with the first value, and what is no number compares false.
    """
    field, op = clause["field"], clause.get("operator", clause.get("op"))
    value = clause.get("values", clause.get("value"))
    words = [str(v if v is not None else "").strip().lower() for v in (value if isinstance(value, list) else [value])]
    if op == "exists":
        return F.col(field).isNotNull()
    if op == "equals":
        return _plain(F.col(field).cast("string")).isin(words)
    if op in ("contains_any", "contains_all"):
        values = _as_strings(df, field)
        join = (lambda a, b: a | b) if op == "contains_any" else (lambda a, b: a & b)
        return reduce(join, [_contains(values, w) for w in words], F.lit(op == "contains_all"))
    number, bound = F.col(field).cast("string").try_cast("double"), F.lit(words[0] if words else None).try_cast("double")
    if op == "greater_than":
        return F.coalesce(number > bound, F.lit(False))
    if op == "less_than":
        return F.coalesce(number < bound, F.lit(False))
    raise ValueError(f"unknown operator {op}")


def condition(leaf: Callable[[dict[str, Any]], Column], node: dict[str, Any]) -> Column:
    """A tree of all, any and not over predicates, which leaf gives; an empty all holds, an empty any does not."""
    if "all" in node:
        return reduce(lambda a, b: a & b, [condition(leaf, n) for n in node["all"]], F.lit(True))
    if "any" in node:
        return reduce(lambda a, b: a | b, [condition(leaf, n) for n in node["any"]], F.lit(False))
    if "not" in node:
        return ~condition(leaf, node["not"])
    return leaf(node)


def findings(df: DataFrame, key: str, rules: list[dict[str, Any]], group: int = 50) -> DataFrame:
    """(key, rule_id, severity, message) for each record and rule that holds, in one scan.

    rules as a rule file has them: rule_id, severity, if and a message, of its own or under then. Predicates that several
    rules share are worked out once a record, in a projection of their own; rules are trees over their results, and each
    group of them is a column, so that no expression grows with the number of rules.
    """
    names: dict[str, str] = {}
    leaves: list[Column] = []

    def leaf(node: dict[str, Any]) -> Column:
        said = json.dumps(node, sort_keys=True, default=str)
        if said not in names:
            names[said] = f"_p{len(names)}"
            leaves.append(predicate(df, node).alias(names[said]))
        return F.col(names[said])

    hits = []
    for at in range(0, len(rules), group):
        hits.append(F.array_compact(F.array(*[F.when(condition(leaf, r["if"]), F.struct(
            F.lit(r["rule_id"]).alias("rule_id"), F.lit(r["severity"]).alias("severity"), F.lit(r["message"] if "message" in r else r["then"]["message"]).alias("message"))) for r in rules[at : at + group]])).alias(f"_g{at}"))
    if not hits:
        return df.select(key, *[F.lit("").alias(c) for c in ("rule_id", "severity", "message")]).limit(0)
    # Results of predicates are kept as an array: a projection that the optimizer doesn't dissolve into the rules.
    places = {n: i for i, n in enumerate(names.values())}
    held = df.select(key, F.explode(F.array(F.struct(*leaves, F.lit(0).alias("_")))).alias("_x")) if places else df.select(key, F.struct(F.lit(0)).alias("_x"))
    held = held.select(key, *[F.col(f"_x.{n}").alias(n) for n in places])
    grouped = held.select(key, *hits)
    return grouped.select(key, F.explode(F.concat(*[F.col(f"_g{at}") for at in range(0, len(rules), group)])).alias("f")).select(key, "f.*")


def build_context(records: DataFrame, key: str, text: str, aliases: DataFrame, items: DataFrame | None = None, age: Column | None = None, sex: Column | None = None) -> DataFrame:
    """(key, kind, names) that rules look at: the sorted names of each kind that a record's text, items, age and sex give.

    aliases (kind, name, alias): a text that contains an alias, letter case aside, has the name. items (key, kind, name, and
    status if there is one): names of those that are active or have no status, trimmed and lowered; empty ones are none.
    Under CHILD years old is a child, from OLDER on an older adult; the sex pregnant tells of pregnancy. Null texts, ages
    and names give nothing; records without a name of any kind have no row.
    """
    low = records.select(key, F.lower(text).alias("_low"))
    found = containing(low, aliases.select("kind", "name", F.lower("alias").alias("_alias")), "_low", "_alias").select(key, "kind", "name")
    if items is not None:
        active = F.coalesce(F.col("status"), F.lit("")).isin("", "active") if "status" in items.columns else F.lit(True)
        found = found.unionByName(items.filter(active).select(key, "kind", _plain(F.col("name")).alias("name")).filter("name <> ''"))
    years = age.try_cast("double") if age is not None else F.lit(None).cast("double")
    bands = F.array_compact(F.array(
        F.when(F.lower(sex) == "pregnant", POPULATIONS[0]) if sex is not None else F.lit(None).cast("string"),
        F.when(years < CHILD, POPULATIONS[1]).when(years >= OLDER, POPULATIONS[2])))
    found = found.unionByName(records.select(key, F.lit("populations").alias("kind"), F.explode(bands).alias("name")))
    return found.groupBy(key, "kind").agg(F.array_sort(F.collect_set("name")).alias("names"))


def near(text: Column, alias: str, marker: str, reach: int = 12) -> Column:
    """The alias within so many characters of a marker, on either side."""
    a, m = re.escape(alias), re.escape(marker)
    return text.rlike(f"(?s){a}.{{0,{reach}}}{m}|{m}.{{0,{reach}}}{a}")


def decisions(found: DataFrame, key: str) -> DataFrame:
    """(key, blocked, messages): the first two messages of blocking findings, else all warnings."""
    block = F.col("severity") == "block"
    per = found.groupBy(key).agg(F.bool_or(block).alias("blocked"), F.array_sort(F.collect_list(F.struct((~block).alias("o"), "rule_id", "severity", "message"))).alias("x"))
    mine = F.filter("x", lambda f: (f["severity"] == "block") | ~F.col("blocked"))
    cut = F.when(F.col("blocked"), F.slice(mine, 1, 2)).otherwise(mine)
    return per.select(key, "blocked", F.transform(cut, lambda f: f["message"]).alias("messages"))


#: What a short reply says that rejects or accepts a proposed update, and the longest such reply.
REJECTS = ["忽略", "不用", "不更新", "不要更新", "别更新", "别改", "不是", "不对", "取消", "先别", "保持原来", "维持原来"]
ACCEPTS = ["确认更新", "确认", "更新", "改成这个", "就按这个", "是的", "对的", "没错", "可以", "是", "对"]
LONGEST_REPLY = 16


def review_decision(text: Column, rejects: list[str] = REJECTS, accepts: list[str] = ACCEPTS, longest: int = LONGEST_REPLY) -> Column:
    """reject, accept or null for a short reply without blanks and punctuation; markers of rejection are looked for first.

    Replies that are null, empty, longer or without a marker decide nothing.
    """
    said = F.regexp_replace(text, r"[\s，。！？,.!?:：；;、]+", "")
    holds = lambda words: F.exists(F.array(*[F.contains(said, F.lit(w)) for w in words]), lambda x: x)
    return F.when((said == "") | (F.length(said) > longest), F.lit(None)).when(holds(rejects), "reject").when(holds(accepts), "accept")


#: What a rule draft has where it says nothing else.
DRAFT_SEVERITY, DRAFT_CATEGORY, DRAFT_ACTION, DRAFT_LEVEL, DRAFT_STATUS = "warn", "draft_clinical_nutrition", "warn", "draft", "draft_needs_review"


def rule_drafts(rules: DataFrame, source: str, order: str) -> DataFrame:
    """rules (rule_id, severity, category, description, then, evidence and the source's column) as drafts to review.

    A rule without an id gets one of its source and its place in it by order, from 1. Ids are in upper case, other
    characters than letters, digits and _ as one _. Missing fields take defaults: a warning, with the source as evidence.
    """
    place = F.row_number().over(Window.partitionBy(source).orderBy(order))
    made = F.concat(F.lit("DRAFT_"), F.upper(F.col(source).cast("string")), F.lit("_"), place)
    rule_id = F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(F.nullif("rule_id", F.lit("")), made)), "[^A-Z0-9_]+", "_"), "^_+|_+$", "")
    then = F.struct(F.lit(DRAFT_ACTION).alias("action"), F.lit("").alias("message"), F.lit("").alias("recommendation"))
    evidence = F.struct(F.col(source).cast("string").alias("source_title"), F.lit(DRAFT_LEVEL).alias("evidence_level"))
    return rules.select(source, rule_id.alias("rule_id"), F.coalesce("severity", F.lit(DRAFT_SEVERITY)).alias("severity"), F.coalesce("category", F.lit(DRAFT_CATEGORY)).alias("category"),
                        F.coalesce("description", F.lit("")).alias("description"), F.coalesce("then", then).alias("then"), F.coalesce("evidence", evidence).alias("evidence"),
                        F.lit(DRAFT_STATUS).alias("review_status"))
