"""Composition tables and meals: priorities, portions, tags, item resolution, totals and targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

Rule = tuple[str, str]


def best_amounts(amounts: DataFrame, key: str, column: str, value: str, priority: str, columns: list) -> DataFrame:
    """Pivot of the amount of best priority for each key and column."""
    best = amounts.groupBy(key, column).agg(F.min_by(value, F.struct(priority, value)).alias(value))
    return best.groupBy(key).pivot(column, columns).agg(F.first(value))


def labels(text: Column, rules: list[Rule]) -> Column:
    """All names of rules (name, pattern) that match."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), n) for n, p in rules]))


def first_label(text: Column, rules: list[Rule], other: str) -> Column:
    return F.coalesce(F.get(labels(text, rules), 0), F.lit(other))


def threshold_tags(values: dict[str, tuple[Column, float]]) -> Column:
    """(tag, value) of each named value at or above its threshold."""
    every = F.array(*[F.struct(F.lit(n).alias("tag"), v.cast("double").alias("value"), (v >= least).alias("hit")) for n, (v, least) in values.items()])
    return F.filter(every, lambda x: x["hit"])


#: Separators and joining words of meal items, words of a sentence that name no food, describing words of a
#: food, numerals and units of a quantity.
SEPARATORS = r"[，,、。；;+\n]+|以及|还有|另外|外加|再加|加上|搭配|配上|配着|配了|和|\band\b"
FILLERS = "早餐|早饭|午餐|中饭|晚餐|晚饭|加餐|这一餐|这餐|一餐|我|今天|早上|中午|晚上|刚才|大概|大约|约|吃了|喝了|吃|喝|有"
DESCRIBING = "一个|一只|一枚|一颗|一份|大份|小份|中等|普通|熟的|生的"
QUANTITY = r"\d+(?:\.\d+)?|[零〇一二两三四五六七八九十百半]+"
UNITS = "毫升|ml|公斤|千克|kg|克|g|斤|两|汤匙|茶匙|大勺|小勺|勺子|勺|杯|碗|片|个|只|枚|颗|块|份|根|条|包|袋|盒|瓶|l|piece|cup|bowl|slice"


def meal_items(text: Column) -> Column:
    """(name, quantity, unit) for each item of a meal sentence.

    A quantity is a number with a unit, before or after the name; an item without one counts 1. A fragment with several
    quantities is cut where each begins, what precedes the first is dropped. Null and empty texts have no items.
    """
    number_unit = f"({QUANTITY})\\s*({UNITS}(?![a-z]))"
    said = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), f"(?i){SEPARATORS}", "，"), FILLERS, "")
    marked = lambda x: F.regexp_replace(x, f"(?i){number_unit}", "\x01$1$2")
    cut = lambda x: F.when(F.regexp_count(x, F.lit(f"(?i){number_unit}")) > 1, F.filter(F.split(marked(x), "\x01"), lambda _, i: i > 0)).otherwise(F.array(x))
    parts = F.transform(F.flatten(F.transform(F.split(said, "，"), cut)), lambda x: F.trim(x))

    def item(x: Column) -> Column:
        lead, trail = f"(?i)^{number_unit}\\s*(?:of\\s+)?(.+)$", f"(?i)^(.+?){number_unit}$"
        group = lambda p, i: F.regexp_extract(x, p, i)
        number = lambda n: F.coalesce(n.try_cast("double"), T.chinese_number(n), F.lit(1.0))
        name = lambda n: F.regexp_replace(F.regexp_replace(n, DESCRIBING, ""), r"^[ 的左右上下约]+|[ 的左右上下约]+$", "")
        made = lambda n, q, u: F.struct(name(n).alias("name"), number(q).alias("quantity"), F.nullif(u, F.lit("")).alias("unit"))
        return F.when(group(lead, 1) != "", made(group(lead, 3), group(lead, 1), group(lead, 2))).when(
            group(trail, 2) != "", made(group(trail, 1), group(trail, 2), group(trail, 3))).otherwise(made(x, F.lit("1"), F.lit("")))

    return F.filter(F.transform(F.filter(parts, lambda x: x != ""), item), lambda i: i["name"] != "")


def resolved_grams(steps: list[tuple[str, Column]], quantity: Column) -> tuple[Column, Column]:
    """(grams, provenance): the first step that has grams a unit, times the quantity."""
    grams = F.coalesce(*[g for _, g in steps]) * quantity
    source = F.coalesce(*[F.when(g.isNotNull(), F.lit(n)) for n, g in steps])
    return grams, source


def scaled(grams: Column, per_100g: Column) -> Column:
    """In decimal, so that sums are the same in any order."""
    return (grams.cast("decimal(18,4)") * per_100g.cast("decimal(18,4)") / F.lit(100)).cast("decimal(28,6)")


def status(consumed: Column, target: Column) -> Column:
    return F.when(target.isNull(), "no_target").when(consumed <= target, "ok").when(consumed <= target * 1.05, "near").otherwise("over")


def meal_target(day: Column, label: Column) -> Column:
    return F.round(day / F.when(label == "snack", 10.0).otherwise(3.0), 1)


def nearest(value: Column, step: int) -> Column:
    return F.bround(value / step, 0) * step


def daily_targets(sex: Column, age: Column, height: Column, weight: Column, activity: Column, lose: Column, diabetes: Column, renal: Column) -> dict[str, Column]:
    """Energy by Mifflin-St Jeor where all inputs are known, else by weight; macronutrients by share, adjusted.

    activity is the factor; lose takes a tenth off; diabetes lowers the carbohydrate share; renal holds protein at
    0.8 g a kg. Null without a weight.
    """
    mifflin = 10 * weight + 6.25 * height - 5 * age + F.when(sex == "male", 5).otherwise(-161)
    energy = F.coalesce(mifflin * activity, weight * F.when(sex == "male", 30.0).otherwise(28.0))
    energy = nearest(energy * F.when(lose, 0.9).otherwise(1.0), 50)
    carbohydrate = energy * F.when(diabetes, 0.45).otherwise(0.5) / 4
    floor = weight * 0.8
    protein = F.least(F.when(renal, floor).otherwise(F.greatest(energy * 0.2 / 4, floor)), energy * 0.35 / 4)
    fat = F.greatest(energy - protein * 4 - carbohydrate * 4, energy * 0.3) / 9
    return {"energy_kcal": energy, "carbohydrate_g": nearest(carbohydrate, 5), "protein_g": nearest(protein, 5), "fat_g": nearest(fat, 5)}


def daily_series(intakes: DataFrame, end: str, days: int, key: str = "user_id", ts: str = "ts", value: str = "value") -> DataFrame:
    """(key, day, total) for each of the last days days and each key, 0 where a day has none."""
    days = max(1, min(180, days))
    last = F.to_date(F.lit(end))
    spine = intakes.select(key).distinct().select(key, F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    sums = intakes.withColumn("day", F.to_date(ts)).filter(F.col("day").between(F.date_sub(last, days - 1), last)).groupBy(key, "day").agg(
        F.sum(F.col(value).cast("decimal(18,2)")).alias("total"))
    return spine.join(sums, [key, "day"], "left").select(key, "day", F.coalesce("total", F.lit(0)).cast("double").alias("total"))


def new_rows(incoming: DataFrame, existing: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Incoming rows whose key exists in neither the existing rows nor an earlier incoming row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = incoming.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return first.join(existing.select(*keys).distinct(), keys, "left_anti")


#: Grams a millilitre of kinds of drinks, by words in their names; names of sweet drinks and dishes.
DENSITIES = [("奶|milk", 1.03)]
SWEET = ["奶茶", "含糖", "甜饮", "甜品", "果汁", "可乐", "sugar", "sweet", "milk tea", "dessert"]
#: What is read of the JSON of detected items.
DETECTED = ("items array<struct<name string, food_name string, quantity double, unit string, estimated_grams double, estimated_ml double, "
            "brand_or_variant string, risk_tags array<string>>>")


def detected_items(found: DataFrame, key: str, payload: str, densities: list[tuple[str, float]] = DENSITIES) -> DataFrame:
    """(key, place, name, quantity, unit, grams) of the detected items in a JSON text.

    Grams are the estimated ones, else the estimated millilitres by the density of the first kind that name, brand or tags
    match (1 without one), else null. Items without a name, null texts and texts that are no JSON have no rows.
    """
    i = found.select(key, F.posexplode(F.from_json(payload, DETECTED)["items"]).alias("place", "i"))
    name = F.trim(F.coalesce(F.nullif("i.name", F.lit("")), "i.food_name", F.lit("")))
    i = i.withColumn("name", name).filter("name <> ''")
    said = F.lower(F.concat_ws(" ", "name", "i.brand_or_variant", "i.risk_tags"))
    density = F.coalesce(*[F.when(said.rlike(p), d) for p, d in densities], F.lit(1.0))
    grams = F.coalesce("i.estimated_grams", F.col("i.estimated_ml") * density)
    return i.select(key, "place", "name", F.coalesce("i.quantity", F.lit(1.0)).alias("quantity"), F.nullif(F.trim("i.unit"), F.lit("")).alias("unit"), grams.alias("grams"))


def sweet_notice(names: Column, concerned: Column, words: list[str] = SWEET) -> Column:
    """Whether a concerned person's list of names holds a word of something sweet; false for null lists."""
    said = F.lower(F.array_join(names, " "))
    return F.coalesce(concerned, F.lit(False)) & F.coalesce(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(said, w)), F.lit(False))


def flag_labels(flags: dict[str, Column]) -> Column:
    """The names of the flags that hold, in the order given; an unknown flag does not hold."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]))


def portion_string(name: Column, grams: Column) -> Column:
    """One "name=12.0g" of each distinct pair of a group, in order; an aggregate."""
    return F.array_join(F.array_sort(F.collect_set(F.concat(name, F.lit("="), grams.cast("double"), F.lit("g")))), "; ")


def portions_of(text: Column) -> Column:
    """(name, grams) of a portion string's parts, cut at the first =; grams that are no number are null, parts without = are passed over."""
    def part(x: Column) -> Column:
        group = lambda i: F.trim(F.regexp_extract(x, "(?s)^([^=]*)=(.*)$", i))
        return F.struct(group(1).alias("name"), F.regexp_replace(group(2), "g$", "").try_cast("double").alias("grams"))

    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: F.contains(x, F.lit("="))), part)
