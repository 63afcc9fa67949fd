"""Rows, pairs, fields and facts found in the lines of extracted texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Beginnings of lines that are notes or captions, and names that are no foods.
NOTES = ["注", "WS/", "WSV/", "附 录"]
CAPTIONS = ["表", "食物类别", "证型", "注", "a:", "b:"]
NOT_NAMES = ["单位", "食物", "嘌呤", "含量", "类别", "制品", "附录", "数据来源"]
NOT_FOODS = ["每份", "提供", "能量", "蛋白质", "脂肪", "碳水", "重量"]
#: Fixed value: what may stand before the first figure of a row without being its label.
CAPTION_WORDS = r"^(表\s*[A-Z]?\.\d+|食品|食物|组别|类别|g|kJ|kcal)\s*"


def first_of(text: Column, markers: list[str], start: Column | None = None) -> Column:
    """The least position, from 1, of any marker at or after start; null where there is none."""
    places = [F.call_function("locate", F.lit(m), text, F.lit(1) if start is None else start) for m in markers]
    return F.least(*[F.nullif(p, F.lit(0)) for p in places], F.lit(None).cast("int"), F.lit(None).cast("int"))


def marker_slice(text: Column, starts: list[str], ends: list[str]) -> Column:
    """From the earliest start marker to the nearest end marker after its first character, or to the end; empty without a start."""
    begin = first_of(text, starts)
    end = F.coalesce(first_of(text, ends, begin + 1), F.length(text) + 1)
    return F.when(begin.isNull(), "").otherwise(F.trim(F.substr(text, begin, end - begin)))


def row_label(line: Column) -> Column:
    """What a row says before its first figure, without captions; may be empty."""
    head = F.trim(F.regexp_extract(line, r"^([^0-9]*)", 1))
    return F.trim(F.regexp_replace(F.regexp_replace(head, r"^[ |,，、:-]+|[ |,，、:-]+$", ""), CAPTION_WORDS, ""))


def _lines(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), T.collapse)


def _begins(line: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.startswith(line, F.lit(w))
    return out


def table_rows(text: Column, default_label: str, numeric: bool) -> Column:
    """(label, line) of each line of four characters or more that is no note; numeric ones need a figure. Labels have at most 80."""
    skipped, most = (NOTES, 80) if numeric else (CAPTIONS, 120)
    fits = lambda x: (F.length(x) >= 4) & ~_begins(x, skipped) & (x.rlike(r"\d") if numeric else F.lit(True))
    made = lambda x: F.struct(F.substring(F.coalesce(F.nullif(row_label(x), F.lit("")), F.lit(default_label)), 1, 80).alias("label"), x.alias("line"))
    return F.slice(F.transform(F.filter(_lines(text), fits), made), 1, most)


def carried_pairs(texts: DataFrame, key: str, text: str, longest: int = 30) -> DataFrame:
    """(key, line, category, name, number): each name and number of lines with figures, with the last line before it that
    has none and is short enough as its category."""
    lines = texts.select(key, F.posexplode(_lines(F.col(text))).alias("line", "l")).filter("l <> ''")
    category = F.when(~F.col("l").rlike(r"\d") & (F.length("l") <= longest), F.col("l"))
    carried = F.last(category, ignorenulls=True).over(Window.partitionBy(key).orderBy("line"))
    rows = lines.withColumn("category", carried).filter(F.col("l").rlike(r"\d") & ~_begins(F.col("l"), ["表", "（单位", "b:", "a:"]))
    found = pairs(F.col("l"), r"([一-龥A-Za-z0-9（）()\[\]、,，.·%-]{1,40})\s+(\d+(?:\.\d+)?)")
    rows = rows.select(key, "line", "category", F.explode(found).alias("p"))
    name = F.regexp_replace(F.col("p.name"), "^[ ，,、]+|[ ，,、]+$", "")
    return rows.select(key, "line", "category", name.alias("name"), "p.number").filter((F.col("name") != "") & ~F.col("name").isin(NOT_NAMES))


def pairs(text: Column, pattern: str) -> Column:
    """(name, number) of each match of a pattern whose groups they are."""
    groups = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2)]
    return F.transform(F.arrays_zip(*groups), lambda x: F.struct(x["0"].alias("name"), x["1"].try_cast("double").alias("number")))


def exchange_pairs(text: Column, most: int = 160) -> Column:
    """(name, number) of foods and the grams of a portion, at most so many a text, without lines and names of captions.

    A number has at most four digits and a blank or the line's end behind it. A name may hold figures and blanks, so of
    several numbers in one run the last counts.
    """
    # The short pattern first: the long one starts at every character of a line without portions.
    lines = F.filter(_lines(text), lambda x: x.rlike(r"\s\d{1,4}(\s|$)") & ~_begins(x, ["注", "表", "食品", "食物", "g "]))
    found = F.flatten(F.transform(lines, lambda x: pairs(x, r"([一-龥A-Za-z0-9、,，（）() ]{1,70})\s+(\d{1,4})(?:\s|$)")))
    named = F.transform(found, lambda p: F.struct(
        F.regexp_replace(F.regexp_replace(p["name"], r"\s+", ""), "^[,，、|]+|[,，、|]+$", "").alias("name"), p["number"].alias("number")))
    fits = lambda p: (F.length(p["name"]) >= 2) & ~p["name"].rlike("|".join(NOT_FOODS))
    return F.slice(F.transform(F.filter(named, fits), lambda p: F.struct(F.substring(p["name"], 1, 80).alias("name"), p["number"].alias("number"))), 1, most)


def two_levels(lines: DataFrame, key: str, outer: str, inner: str) -> DataFrame:
    """(key, outer_name, inner_name, first_no, body) of each inner section of lines (key, no, line).

    outer and inner are patterns whose first group is a name. A section is its inner header's lines up to the next header
    of either level; inner_name is null before the first inner header of an outer one.
    """
    w = Window.partitionBy(key).orderBy("no")
    found = lambda p: F.nullif(F.regexp_extract("line", p, 1), F.lit(""))
    s = lines.select(key, "no", "line", found(outer).alias("o"), found(inner).alias("i"))
    s = s.withColumn("span", F.count_if(F.coalesce("o", "i").isNotNull()).over(w)).withColumn("outer_name", F.last("o", ignorenulls=True).over(w))
    head = F.struct("no", F.when(F.col("o").isNull(), F.col("i")).alias("i"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.coalesce("o", "i").isNull(), F.struct("no", "line")))), lambda x: x["line"]), "\n")
    per = s.groupBy(key, "span").agg(F.first("outer_name").alias("outer_name"), F.min(head).alias("h"), body.alias("body"))
    return per.select(key, "outer_name", F.col("h.i").alias("inner_name"), F.col("h.no").alias("first_no"), "body")


def labelled_fields(text: Column, labels: dict[str, str]) -> Column:
    """A struct of each field: what follows its label up to the nearest later label; empty where the label is missing."""
    names = list(labels)

    def field(n: int) -> Column:
        label = labels[names[n]]
        begin = F.nullif(F.call_function("locate", F.lit(label), text), F.lit(0)) + len(label)
        later = [labels[x] for x in names[n + 1 :]]
        end = F.coalesce(first_of(text, later, begin) if later else F.lit(None).cast("int"), F.length(text) + 1)
        return F.when(begin.isNull(), "").otherwise(F.trim(F.substr(text, begin, end - begin)))

    return F.struct(*[field(n).alias(name) for n, name in enumerate(names)])


def ingredients(text: Column) -> Column:
    """(name, amount, unit) of each part that ends in an amount; parts are cut at commas, semicolons and brackets."""
    dried = F.replace(F.coalesce(text, F.lit("")), F.lit("【干】"), F.lit("干"))
    amount, units = "[0-9]+(?:\\.[0-9]+)?", "g|mL|ml|克|毫升|枚|片|个|次"
    # A lambda computes what it names as often as it is named, so the search for the name is done once for each part, and the
    # amount is what stands behind it. What follows the unit is not read.
    parts = F.transform(F.split(F.translate(dried, "（），、；;", "," * 6), ","), lambda x: F.ltrim(x, F.lit(" 。.")))
    cut = F.transform(parts, lambda x: F.struct(x.alias("x"), F.regexp_extract(x, rf"^(.+?){amount}\s*(?:{units})", 1).alias("head")))
    rest = lambda p: F.substr(p["x"], F.length(p["head"]) + 1)
    cut = F.transform(F.filter(cut, lambda p: p["head"] != ""), lambda p: F.struct(p["head"].alias("head"), rest(p).alias("rest")))

    def made(p: Column) -> Column:
        group = lambda i: F.regexp_extract(p["rest"], rf"^({amount})\s*({units})", i)
        return F.struct(F.regexp_replace(F.trim(p["head"]), r"^\*+|\*+$", "").alias("name"), group(1).try_cast("double").alias("amount"), group(2).alias("unit"))

    return F.filter(F.transform(cut, made), lambda i: i["amount"].isNotNull() & ~i["name"].isin("", "主要材料", "材料"))


#: Names of meals, in the order they are looked for, and beginnings of lines of a plan that are no dishes.
MEALS = ["早餐", "中餐", "午餐", "晚餐", "加餐"]
NOT_DISHES = ["注：", "2.", "宏量营养素", "油、盐"]
PLAN_TOTAL = "本食谱提供能量"


def recipe_tree(plans: DataFrame, key: str, text: str, meals: list[str] = MEALS) -> DataFrame:
    """(key, meal_no, meal, dish_no, dish, ingredient_no, name, amount, unit): the tree of each plan's text, a row a leaf.

    A plan's first line is its title. A line that is or begins with a meal's name opens the meal, and what follows the
    name is its first dish; other lines are dishes of the open meal. A dish is named by what stands before its bracket. A
    dish without ingredients has one row with nulls; a meal without dishes, lines before the first meal, and null or empty
    texts have none. Only lines of one plan meet in a window.
    """
    lines = plans.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\r?\n")).alias("no", "l")).filter("no > 0")
    lines = lines.withColumn("l", F.trim("l")).filter((F.col("l") != "") & ~_begins(F.col("l"), NOT_DISHES))
    opened = F.coalesce(*[F.when((F.col("l") == m) | F.startswith("l", F.lit(m + " ")), m) for m in meals])
    s = lines.withColumn("opened", opened)
    s = s.withColumn("said", F.when(F.col("opened").isNull(), F.col("l")).otherwise(F.trim(F.substr("l", F.length("opened") + 1))))
    w = Window.partitionBy(key).orderBy("no")
    s = s.withColumn("meal_no", F.count("opened").over(w)).withColumn("meal", F.last("opened", ignorenulls=True).over(w))
    # Dishes are numbered by what their plan has had so far, less what it had before the meal: all windows share one sort.
    s = s.withColumn("is_dish", (F.col("said") != "") & (F.col("opened").isNotNull() | ~F.startswith("l", F.lit(PLAN_TOTAL))))
    s = s.withColumn("so_far", F.count_if("is_dish").over(w))
    before = F.when(F.col("opened").isNotNull(), F.col("so_far") - F.col("is_dish").cast("int"))
    s = s.withColumn("dish_no", (F.col("so_far") - F.last(before, ignorenulls=True).over(w)).cast("int")).filter("meal_no > 0 and is_dish")
    named = F.coalesce(F.nullif(F.trim(F.split_part("said", F.lit("（"), F.lit(1))), F.lit("")), F.substring("said", 1, 40))
    s = s.select(key, "meal_no", "meal", "dish_no", named.alias("dish"), F.posexplode_outer(ingredients(F.col("said"))).alias("ingredient_no", "i"))
    return s.select(key, "meal_no", "meal", "dish_no", "dish", "ingredient_no", "i.*")


def plan_nutrition(text: Column) -> Column:
    """(energy_kcal, protein_g, carbohydrate_g, fat_g, protein_pct, carbohydrate_pct, fat_pct) of a plan's closing sentence.

    The exact form of the sentence goes before the form with ranges, whose middle counts; what neither says is null.
    """
    one, span = r"([0-9.]+)", r"([0-9.]+)(?:[～~-]([0-9.]+))?"
    exact = rf"(?s)本食谱提供能量约为\s*([0-9]+)\s*kcal.*?蛋白质\s*{one}\s*g，碳水化合物\s*{one}\s*g.*?脂肪\s*{one}\s*g"
    ranged = rf"(?s)本食谱可提供能量.*?总值为{span}kcal.*?蛋白质{span}g.*?碳水化合物{span}g.*?脂肪{span}g"
    share = rf"(?s)蛋白质\s*{one}%.*?碳水化合物\s*{one}%.*?脂肪\s*{one}%"
    compact = F.regexp_replace(text, r"\s+", "")
    names = ["energy_kcal", "protein_g", "carbohydrate_g", "fat_g"]
    amounts = [F.coalesce(F.regexp_extract(text, exact, i + 1).try_cast("double"),
                          T.midpoint(F.regexp_extract(compact, ranged, 2 * i + 1), F.regexp_extract(compact, ranged, 2 * i + 2))).alias(n) for i, n in enumerate(names)]
    shares = [F.regexp_extract(text, share, i + 1).try_cast("double").alias(n) for i, n in enumerate(["protein_pct", "carbohydrate_pct", "fat_pct"])]
    return F.struct(*amounts, *shares)


def rule_targets(pages: DataFrame, key: str, page: str, text: str, rules: list[tuple[list[str], list[str], list[tuple[str, str]]]]) -> DataFrame:
    """(key, nutrient, target, page) of rules (all of these, any of these, targets), with the first page that gives each.

    An empty list of phrases always fits. Phrases are looked for in a page's text without blanks. A null text gives no target.
    """
    said = F.regexp_replace(text, r"\s+", "")
    found = []
    for every, some, targets in rules:
        fits = reduce(lambda a, b: a & b, [F.contains(said, F.lit(p)) for p in every], F.lit(True))
        if some:
            fits = fits & reduce(lambda a, b: a | b, [F.contains(said, F.lit(p)) for p in some])
        found += [F.when(fits, F.struct(F.lit(n).alias("nutrient"), F.lit(v).alias("target"))) for n, v in targets]
    t = pages.select(key, page, F.explode(F.array_compact(F.array(*found))).alias("t"))
    return t.groupBy(key, "t.nutrient", "t.target").agg(F.min(page).alias("page"))


def fact(text: Column, name: str, unit: str, reach: int = 40) -> Column:
    """The first number, with a unit, at most reach characters after a name; the middle of a range; null without one."""
    pattern = rf"(?s){name}[^0-9]{{0,{reach}}}([0-9]+(?:\.[0-9]+)?)(?:\s*[～~-]\s*([0-9]+(?:\.[0-9]+)?))?\s*{unit}"
    return T.midpoint(F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2))


def title_key(title: Column) -> Column:
    """A title without bracketed parts and version stamps, lower-cased and collapsed."""
    plain = F.regexp_replace(F.regexp_replace(title, r"\([^)]*\)", " "), r"-v\d{14}(?:-\d+)?", " ")
    return F.lower(F.regexp_replace(T.collapse(plain), "^[ _-]+|[ _-]+$", ""))


def newest_entries(entries: DataFrame, title: str, order: str) -> DataFrame:
    """(title_key, order) of the newest entry of each title; entries without a title are all kept."""
    keyed = entries.select(title_key(F.col(title)).alias("title_key"), order)
    none = F.coalesce("title_key", F.lit("")) == ""
    # Partial aggregation: a title that many entries share is not gathered.
    return keyed.filter(~none).groupBy("title_key").agg(F.max(order).alias(order)).unionByName(keyed.filter(none))


def reviewed(rows: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """rows (key, status) with each one's decision (key, decision) in place of its status."""
    return rows.join(decisions, key, "left").withColumn("status", F.coalesce("decision", "status")).drop("decision")


def unsynced(rows: DataFrame, indexed: DataFrame, key: str) -> DataFrame:
    """The rows whose key the index does not hold; rows without a key are among them."""
    return rows.join(indexed.select(key).distinct(), key, "left_anti")
