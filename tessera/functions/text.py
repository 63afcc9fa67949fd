"""Text expressions: each is a Catalyst column, for use over whole tables."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CJK = "\u4e00-\u9fff"
STRINGS = "array<string>"


def empty_strings() -> Column:
    return F.array().cast(STRINGS)


def normalize(text: Column) -> Column:
    """Line ends to \\n, runs of blanks to one, three or more line ends to two, trimmed."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    t = F.regexp_replace(F.regexp_replace(t, "[ \t]+", " "), "\n{3,}", "\n\n")
    return F.btrim(t, F.lit(" \n\t"))


def collapse(text: Column) -> Column:
    # A single blank stays as it is, which is most of what stands between words.
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r" \s+|[^\S ]\s*", " "), F.lit(" "))


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def grams(run: Column, n: int) -> Column:
    """All substrings of n characters."""
    last = F.length(run) - n + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(run, i, F.lit(n)))).otherwise(empty_strings())


def _grams_of(n: int):
    return lambda run: grams(run, n)


def index_tokens(text: Column, cap: int | None = 80) -> Column:
    """Words, single CJK characters, then pairs of CJK characters over all of them joined; distinct, first-seen order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    chars = matches(low, f"[{CJK}]")
    tokens = F.array_distinct(F.concat(matches(low, "[a-z0-9_+-]+"), chars, grams(F.array_join(chars, ""), 2)))
    return F.slice(tokens, 1, cap) if cap else tokens


def query_tokens(text: Column) -> Column:
    """Words and CJK runs, three- and two-character grams within runs, numbers; distinct, first-seen order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    runs = matches(low, f"[{CJK}]+")
    parts = [matches(low, f"[a-z0-9_.+-]+|[{CJK}]+"), *(F.flatten(F.transform(runs, _grams_of(n))) for n in (3, 2)), matches(low, r"\d+(?:\.\d+)?")]
    return F.array_distinct(F.concat(*parts))


def index_text(title: Column, section: Column, body: Column) -> Column:
    """Title, section and body with the body's own tokens appended."""
    return F.concat(F.concat_ws("\n", title, section, body), F.lit("\n\n"), F.array_join(index_tokens(body), " "))


def snippet(text: Column, tokens: Column, chars: int = 160) -> Column:
    """Text about the first token that occurs, with dots where it is cut."""
    def about(t: Column, hit: Column) -> Column:
        start = F.greatest(hit - 1 - max(chars // 2, 80), F.lit(0))
        end = F.least(start + chars, F.length(t))
        cut = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(t, start + 1, end - start), F.when(end < F.length(t), "...").otherwise(""))
        return F.when(hit.isNull(), F.substring(t, 1, chars)).otherwise(cut)

    def first(low: Column) -> Column:
        return F.get(F.filter(F.transform(tokens, lambda x: F.call_function("instr", low, x)), lambda x: x > 0), 0)

    # Each step's value is the variable of the next, so that a text is collapsed and put in lower case once.
    steps = F.transform(F.array(collapse(text)), lambda t: F.struct(t.alias("t"), F.lower(t).alias("low")))
    steps = F.transform(steps, lambda s: F.struct(s["t"].alias("t"), first(s["low"]).alias("hit")))
    return F.get(F.transform(steps, lambda s: about(s["t"], s["hit"])), 0)


#: What stands between the windows of an excerpt.
EXCERPT_JOINT = "\n\n---\n\n"


def keyword_windows(text: Column, keywords: Sequence[str], budget: int = 4000, before: int = 500, after: int = 1200) -> Column:
    """Windows about keywords: for each the first occurrence whose window, up to after characters beyond its end, meets none
    taken before; trimmed, until they hold budget characters together. A null text has none."""
    def places(k: str) -> Column:
        """The window of each occurrence, one after the other."""
        gaps = F.split(text, re.escape(k), -1)
        step = lambda a, g: F.struct((a["at"] + F.length(g) + len(k)).alias("at"), F.array_append(a["out"], a["at"] + F.length(g)).alias("out"))
        at = F.aggregate(gaps, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step, lambda a: F.slice(a["out"], 1, F.size(a["out"]) - 1))
        return F.transform(at, lambda x: F.struct(F.greatest(x - before, F.lit(0)).alias("a"), (x + len(k) + after).alias("b")))

    said = [F.when(F.contains(text, F.lit(k)), places(k)) for k in keywords if k]
    spans = F.array_compact(F.array(*said)) if said else F.array().cast("array<array<struct<a:int,b:int>>>")
    start = F.struct(F.array().cast("array<struct<a:int,b:int>>").alias("taken"), empty_strings().alias("out"), F.lit(0).alias("n"), F.length(text).alias("end"), text.alias("text"))
    trimmed = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")

    def step(acc: Column, own: Column) -> Column:
        meets = lambda x, y: ~((F.least(x["b"], acc["end"]) < y["a"]) | (x["a"] > F.least(y["b"], acc["end"])))
        first = F.get(F.filter(own, lambda x: ~F.exists(acc["taken"], lambda y: meets(x, y))), F.lit(0))
        # The window, then its text, are bound once each.
        bound = F.transform(F.array(first), lambda x: F.struct(x.alias("x"), trimmed(F.substring(acc["text"], x["a"] + 1, x["b"] - x["a"])).alias("t")))
        return F.element_at(F.transform(bound, lambda w: F.when(w["x"].isNull() | (acc["n"] >= budget), acc).otherwise(F.struct(
            F.array_append(acc["taken"], w["x"]).alias("taken"), F.array_append(acc["out"], w["t"]).alias("out"), (acc["n"] + F.length(w["t"])).alias("n"), acc["end"].alias("end"), acc["text"].alias("text")))), 1)

    return F.aggregate(spans, start, step, lambda acc: acc["out"])


def keyword_excerpt(text: Column, keywords: Sequence[str], budget: int = 4000, before: int = 500, after: int = 1200) -> Column:
    """The keyword windows with a line of dashes between, cut at budget characters."""
    return F.substring(F.array_join(keyword_windows(text, keywords, budget, before, after), EXCERPT_JOINT), 1, budget)


def front_matter(text: Column) -> Column:
    """The key: value lines between two lines of dashes at the head, as a map."""
    head = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---\n", 1)
    lines = F.filter(F.split(head, "\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))
    return F.map_from_entries(pairs)


def body(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n", "")


def title(text: Column, path: Column) -> Column:
    """From the front matter, else the first heading, else the file's stem."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    heading = F.regexp_extract(body(text), r"(?m)^#\s+(.+)$", 1)
    return F.coalesce(F.try_element_at(front_matter(text), F.lit("title")), F.when(heading != "", F.trim(heading)), stem)


#: The marks that are stripped from the ends of a text.
EDGE_MARKS = "\\s\u3000，,。.！!“”\"：:\\-－、\\[\\]【】"
#: Code point ranges of emoji.
EMOJI = "\\x{1F300}-\\x{1F64F}\\x{1F680}-\\x{1F6FF}\\x{1F900}-\\x{1F9FF}\\x{1FA70}-\\x{1FAFF}\\x{2600}-\\x{27BF}"


def strip_edges(text: Column) -> Column:
    """Without blanks, marks and emoji at the ends."""
    return F.regexp_replace(text, f"^[{EDGE_MARKS}{EMOJI}]+|[{EDGE_MARKS}{EMOJI}]+$", "")


def without_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "")


def without_emoji(text: Column) -> Column:
    return F.regexp_replace(text, f"[{EMOJI}\\n]", "")


#: Characters that tell a formula from a price, as a part of a character class.
FORMULA = r"a-zA-Z\\^_{}+\-()\[\]="


def plain_text(markdown: Column) -> Column:
    """Markdown without its marks; table rows become header = cell lists, and a table of one row a list of its cells.

    Dollar signs about a formula go, those of prices stay.
    """
    t = F.regexp_replace(markdown, r"(?s)```.*?```", "")
    lines = F.split(t, "\n")
    is_row = lambda x: x.rlike(r"^\s*\|.*\|\s*$")
    cells = lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    start = F.struct(F.lit(None).cast(STRINGS).alias("head"), F.lit(0).alias("rows"), empty_strings().alias("out"))
    # A header line that no row followed is a row of its own.
    ended = lambda acc: F.when(acc["head"].isNotNull() & (acc["rows"] == 0), F.array_append(acc["out"], F.array_join(acc["head"], ", "))).otherwise(acc["out"])

    def step(acc: Column, x: Column) -> Column:
        dashes = x.rlike(r"^[\s|:-]+$") & F.contains(x, F.lit("-"))
        paired = F.array_join(F.zip_with(acc["head"], cells(x), lambda h, c: F.concat_ws(" = ", h, c)), ", ")
        return (F.when(~is_row(x), F.struct(F.lit(None).cast(STRINGS).alias("head"), F.lit(0).alias("rows"), F.array_append(ended(acc), x).alias("out")))
                .when(acc["head"].isNull(), F.struct(cells(x).alias("head"), F.lit(0).alias("rows"), acc["out"].alias("out")))
                .when(dashes, acc)
                .otherwise(F.struct(acc["head"].alias("head"), (acc["rows"] + 1).alias("rows"), F.array_append(acc["out"], paired).alias("out"))))

    t = F.array_join(F.aggregate(lines, start, step, ended), "\n")
    for pattern, to in (
        (r"`([^`]*)`", "$1"), (r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^#{1,6}\s*", ""),
        (r"(?m)^>\s?", ""), (r"(?m)^\s*[-*+]\s+", ""), (r"(\*\*|__)(.*?)\1", "$2"), (r"(\*|_)(.*?)\1", "$2"), (r"(?s)\$\$(.*?)\$\$", "$1"),
        # In order: pairs about anything but a formula are kept by a mark that no text holds, the others lose their signs.
        (rf"\$([^$\n{FORMULA}]*)\$|\$([^$\n]*)\$", "\u0001$1\u0001$2"), ("\u0001\u0001", ""), ("\u0001", r"\$"), (r"\n{2,}", "\n"),
    ):
        t = F.regexp_replace(t, pattern, to)
    return F.trim(t)


def tagged_transcript(text: Column) -> Column:
    """(language, emotion, event, content) of <|a|><|b|><|c|>...content."""
    tags = F.regexp_extract_all(text, F.lit(r"<\|([^|>]*)\|>"), F.lit(1))
    return F.struct(F.get(tags, 0).alias("language"), F.get(tags, 1).alias("emotion"), F.get(tags, 2).alias("event"),
                    F.trim(F.regexp_replace(text, r"<\|[^|>]*\|>", "")).alias("content"))


def recovered_json(text: Column) -> Column:
    """The JSON text in a noisy one: bare, fenced, or the widest braces; null where none parses."""
    bare = F.trim(F.regexp_replace(text, "(?s)```(?:json)?(.*?)```", "$1"))
    widest = F.regexp_extract(text, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.coalesce(*[F.when(F.try_parse_json(x).isNotNull() & (x != ""), x) for x in (text, bare, widest)])


def _masked(value, words: tuple[str, ...], mask: str):
    """An object's values masked by key; objects below it, in lists, and in strings that are the JSON of one, likewise."""
    out = {}
    for k, v in value.items():
        if any(w in k.lower() for w in words):
            out[k] = mask
        elif isinstance(v, dict):
            out[k] = _masked(v, words, mask)
        elif isinstance(v, list):
            out[k] = [_masked(x, words, mask) if isinstance(x, dict) else x for x in v]
        else:
            out[k] = _masked_text(v, words, mask) if isinstance(v, str) else v
    return out


def _masked_text(text: str, words: tuple[str, ...], mask: str) -> str:
    try:
        value = json.loads(text) if "{" in text else None
        return json.dumps(_masked(value, words, mask), ensure_ascii=False) if isinstance(value, dict) else text
    except ValueError:
        return text
    except RecursionError:  # deeper than can be read: nothing of it is shown
        return json.dumps(mask)


def masked(json_text: Column, words: Sequence[str], mask: str = "***") -> Column:
    """The JSON of an object with each value masked, whatever it is, whose key contains a sensitive word, letter case aside.

    Objects inside it, in its lists, and in strings that hold JSON are gone through too. Text that is no JSON object stays
    as it is; null stays null. In Arrow batches, as no built-in function goes down to any depth.
    """
    low = tuple(w.lower() for w in words)

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _masked_text(t, low, mask))

    return F.pandas_udf(run, "string")(json_text)


#: Fixed values.
NUMERALS = ("零〇一二两三四五六七八九", "001223456789")


def chinese_number(text: Column) -> Column:
    """A number of numerals with 百, 十 and 点; 半 alone or in front is 0.5 and adds a half elsewhere. Null for anything else."""
    half, said = F.contains(text, F.lit("半")), F.replace(text, F.lit("半"), F.lit(""))
    whole, part = F.substring_index(said, "点", 1), F.when(F.contains(said, F.lit("点")), F.substring_index(said, "点", -1)).otherwise("")
    digits = lambda x: F.translate(x, *NUMERALS)
    head = F.when(F.contains(whole, F.lit("百")), F.substring_index(whole, "百", 1))
    rest = F.substring_index(whole, "百", -1)
    hundreds = F.when(head.isNull(), 0.0).when(head == "", 100.0).when(digits(head).rlike(r"^\d$"), digits(head).try_cast("double") * 100)
    left, right = F.substring_index(rest, "十", 1), F.substring_index(rest, "十", -1)
    tens = F.when(left == "", F.lit("1")).otherwise(digits(left))
    ones = F.when(right == "", F.lit("0")).otherwise(digits(right))
    joined = F.when(F.contains(rest, F.lit("十")), F.concat(tens, ones)).when(head.isNotNull() & (rest == ""), F.lit("0")).otherwise(digits(rest))
    value = F.concat(joined, F.when(part != "", F.concat(F.lit("."), digits(part))).otherwise(""))
    number = F.when(value.rlike(r"^\d+(\.\d+)?$"), value.try_cast("double")) + hundreds
    return F.when(F.startswith(text, F.lit("半")), 0.5).otherwise(number + F.when(half, 0.5).otherwise(0.0))


def glucose_mmol(value: Column, unit: Column, digits: int = 1) -> Column:
    """In mmol/L from mg/dL or mmol/L, to one digit; null outside 1 to 35."""
    v = F.when(F.lower(F.trim(unit)) == "mg/dl", value / 18.0).otherwise(value)
    return F.when(v.between(1.0, 35.0), F.bround(v, digits))


def grams_of(quantity: Column, unit: Column, density: Column) -> Column:
    """Grams of g, kg, jin (500 g), liang (50 g), ml and l (by density); null for other units."""
    factor = F.create_map(*[F.lit(x) for p in (("g", 1.0), ("kg", 1000.0), ("jin", 500.0), ("liang", 50.0)) for x in p])
    volume = F.create_map(*[F.lit(x) for p in (("ml", 1.0), ("l", 1000.0)) for x in p])
    u = F.lower(F.trim(unit))
    return F.coalesce(quantity * F.try_element_at(factor, u), quantity * F.try_element_at(volume, u) * density)


def stable_id(prefix: str, *parts: Column) -> Column:
    raw = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(raw), 1, 20))


def dedupe_key(*parts: Column) -> Column:
    return F.regexp_replace(F.lower(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), r"\s+", "")


def cosine(left: Column, right: Column) -> Column:
    """In double; 0 for vectors of no length or of different dimensions."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    return F.when((F.size(left) == F.size(right)) & (norm > 0), dot(left, right) / norm).otherwise(F.lit(0.0))


def jaccard(left: Column, right: Column) -> Column:
    union = F.size(F.array_union(left, right))
    return F.when(union > 0, F.size(F.array_intersect(left, right)) / union).otherwise(F.lit(0.0))


def clamp(value: Column, default: float, least: float, most: float) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), F.coalesce(value.try_cast("double"), F.lit(default))))


def midpoint(first: Column, second: Column) -> Column:
    a, b = first.try_cast("double"), second.try_cast("double")
    return F.coalesce(F.bround((a + b) / 2, 2), a, b)


def hashed_vector(tokens: Column, dimensions: int = 32) -> Column:
    """A signed bucket for each token by its hash, scaled to length one; all-zero without tokens. Built in place, without a shuffle."""
    def code(t: Column) -> Column:
        """Twice the bucket, by the first four bytes, lowest first; one more where the fifth byte is odd."""
        h = F.sha2(t, 256)
        low = F.substring(h, 1, 2) if 256 % dimensions == 0 else F.concat(*[F.substring(h, 2 * k + 1, 2) for k in (3, 2, 1, 0)])
        odd = (F.locate("1", F.translate(F.substring(h, 10, 1), "3579bdf", "1111111")) > 0).cast("int")
        return (2 * F.pmod(F.conv(low, 16, 10).cast("long"), F.lit(dimensions)).cast("int") + odd).cast("int")

    # Occurrences of a code are what its removal takes away.
    sums = lambda codes: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: (
        F.size(F.array_remove(codes, 2 * i + 1)) - F.size(F.array_remove(codes, 2 * i))).cast("double"))
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    scaled = lambda s: F.transform(s["v"], lambda x: x / F.when(s["n"] > 0, s["n"]).otherwise(1.0))
    # From codes to sums to the scaled vector: each step's value is the variable of the next.
    steps = F.transform(F.array(F.transform(tokens, code)), sums)
    steps = F.transform(F.transform(steps, lambda v: F.struct(v.alias("v"), length(v).alias("n"))), scaled)
    return F.coalesce(F.get(steps, F.lit(0)), F.array_repeat(F.lit(0.0), dimensions))


def hashed_vectors(rows: DataFrame, key: str, tokens: str, dimensions: int = 32) -> DataFrame:
    """(key, vector) of hashed_vector."""
    return rows.select(key, hashed_vector(F.col(tokens), dimensions).alias("vector"))


def vector_sum(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, total): the sum of each group's vectors, in double precision, place by place; shorter ones end early."""
    placed = rows.select(key, F.posexplode(F.col(vector).cast("array<double>")).alias("at", "v"))
    sums = placed.groupBy(key, "at").agg(F.sum("v").alias("v"))
    return sums.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("total"))


def page_label(first: Column, last: Column) -> Column:
    """p.3, or pp.3-5; a missing first page is 1, a missing last page the first."""
    a = F.when(F.coalesce(first, F.lit(0)) == 0, 1).otherwise(first).cast("int")
    b = F.when(F.coalesce(last, F.lit(0)) == 0, a).otherwise(last).cast("int")
    return F.when(a == b, F.concat(F.lit("p."), a)).otherwise(F.concat(F.lit("pp."), a, F.lit("-"), b))


def citation(source: Column, first: Column, last: Column, chunk_id: Column) -> Column:
    """source, its pages, and the chunk in brackets."""
    return F.concat(source, F.lit(" "), page_label(first, last), F.lit(" ["), chunk_id, F.lit("]"))


#: Ends of a title that are stripped, and words by which meals and intent are recognised.
TITLE_ENDS = "。！？!?.,，；;：: "
MEALS = (("breakfast", ("breakfast", "早餐", "早饭")), ("lunch", ("lunch", "午餐", "午饭")), ("dinner", ("dinner", "supper", "晚餐", "晚饭")), ("snack", ("snack", "加餐", "夜宵")))
HYPOTHETICAL = ("如果", "假如", "计划", "打算", "准备", "能不能", "可不可以", "适合吗", "推荐", "建议", "会不会")
ACTUAL = ("吃了", "喝了", "刚吃", "刚喝", "本餐", "这餐", "这一餐", "早餐", "早饭", "午餐", "午饭", "晚餐", "晚饭", "加餐", "夜宵")


def session_title(text: Column, most: int = 40) -> Column:
    """A text on one line, without punctuation at its end, cut to most characters."""
    return F.substring(F.regexp_replace(collapse(text), f"[{TITLE_ENDS}]+$", ""), 1, most)


def holds_any(text: Column, words: Sequence[str]) -> Column:
    return F.coalesce(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w)), F.lit(False))


def meal_label(text: Column, other: str = "meal") -> Column:
    """The first meal any of whose words the text holds."""
    low = F.lower(text)
    return F.coalesce(*[F.when(holds_any(low, words), label) for label, words in MEALS], F.lit(other))


def is_actual_intake(text: Column, said: Column | None = None) -> Column:
    """Whether a sentence tells of food taken: what was said of it outright, else not where it only supposes."""
    supposed = holds_any(text, HYPOTHETICAL) & ~holds_any(text, ACTUAL)
    if said is None:
        return ~supposed
    word = F.lower(F.trim(said))
    return F.when(word.isin("true", "1", "yes", "y", "是", "已吃", "记录"), True).when(word.isin("false", "0", "no", "n", "否", "不记录", "假设"), False).otherwise(~supposed)
