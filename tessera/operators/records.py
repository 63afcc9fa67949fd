"""Personal records: extraction from text, conflict-checked merges, readings and alerts, rosters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.grams import containing


def guarded(text: Column, pattern: str, least: float, most: float) -> Column:
    """The number that the pattern's first group finds, null outside the range."""
    v = F.regexp_extract(text, pattern, 1).try_cast("double")
    return F.when(v.between(least, most), v)


def entities(texts: DataFrame, aliases: DataFrame, key: str, text: str, clip: int = 80) -> DataFrame:
    """(key, name, evidence) of aliases (alias, name, generic_of) in the texts; a generic name goes where a specific one is.

    Aliases are looked for by their rarest grams, so there may be any number. An empty one is in nothing.
    """
    t = texts.select(key, F.lower(text).alias("_t"), F.col(text).alias("_raw"))
    hit = containing(t, aliases.withColumn("_alias", F.lower("alias")), "_t", "_alias")
    at = F.call_function("instr", F.col("_t"), F.lower("alias"))
    found = hit.groupBy(key, "name").agg(F.min_by(F.substring("_raw", F.greatest(at - 20, F.lit(1)), F.lit(clip)), F.struct(at, "alias")).alias("evidence"), F.first("generic_of").alias("generic_of"))
    covered = found.filter("generic_of is not null").select(key, F.col("generic_of").alias("name")).distinct()
    return found.join(covered, [key, "name"], "left_anti").select(key, "name", "evidence")


def metrics(text: Column, names: list[str]) -> Column:
    """(name, value, unit) of each "name value unit" in the text."""
    p = rf"({'|'.join(names)})\s*[:=]?\s*([\d.]+)\s*([A-Za-z%/]*)"
    groups = [F.regexp_extract_all(text, F.lit(p), F.lit(i)) for i in (1, 2, 3)]
    return F.transform(F.arrays_zip(*groups), lambda x: F.struct(x["0"].alias("name"), x["1"].try_cast("double").alias("value"), x["2"].alias("unit")))


#: What a clause says of a reading's kind and meal, in the order looked for, of the day, and of the time of day.
READING_KINDS = [("fasting", "空腹|fasting"), ("pre_meal", "餐前|饭前|before"), ("postprandial_2h", "[餐饭]后(2|两)小时|餐二|2 ?h(ours?)? after"),
                 ("post_meal", "餐后|饭后|after"), ("bedtime", "睡前|bedtime")]
MEAL_CONTEXTS = [("breakfast", "早餐|breakfast"), ("lunch", "午餐|中饭|lunch"), ("dinner", "晚餐|晚饭|dinner")]
DAYS_BACK = [(2, "前天"), (1, "昨天|昨日|yesterday")]
TIME_OF_DAY = r"(凌晨|早上|上午|中午|下午|晚上|今晚|今早)?\s*(\d{1,2})[:：点](\d{1,2})?"
AFTERNOON = ["下午", "晚上", "今晚"]
#: Units of a reading, those of mg/dl first.
READING_UNITS = [("mg/dl", "(?i)mg/dl|毫克每分升"), ("mmol", "(?i)mmol(?:/l)?|毫摩尔")]


def readings(text: Column, base: Column) -> Column:
    """(kind, meal, value, on, at) of each clause with a value and a unit.

    The clause's words give the kind (random without one), the meal (empty without one) and the days back from base; at is
    the last time of day that the clause names, on that day, and null where it names none or none that exists. Values
    out of range, null and empty texts have no readings.
    """
    units = "|".join(p.removeprefix("(?i)") for _, p in READING_UNITS)
    value = rf"(?i)(\d+(?:\.\d+)?)\s*({units})"

    def says(c: Column, pattern: str) -> Column:
        # Plain words need no regular expression.
        plain = not set(pattern) & set("\\[](){}.*+?^$")
        return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in pattern.split("|")]) if plain else c.rlike(pattern)

    def named(c: Column, rules: list, other) -> Column:
        return F.coalesce(*[F.when(says(c, p), F.lit(n)) for n, p in rules], F.lit(other))

    # A lambda computes what it names as often as it is named, so each step hands on what the next ones need more than once.
    def found(c: Column) -> Column:
        return F.struct(
            c.alias("c"), F.regexp_extract(c, value, 1).try_cast("double").alias("raw"), F.regexp_extract(c, value, 2).rlike(READING_UNITS[0][1]).alias("mg"),
            F.try_element_at(F.regexp_extract_all(c, F.lit(TIME_OF_DAY), F.lit(0)), F.lit(-1)).alias("time"),
            F.date_sub(F.to_date(base), named(c, DAYS_BACK, 0)).alias("on"))

    def timed(x: Column) -> Column:
        part = lambda i: F.regexp_extract(x["time"], TIME_OF_DAY, i)
        value = T.glucose_mmol(x["raw"], F.when(x["mg"], "mg/dl").otherwise("mmol"))
        return F.struct(x.alias("x"), value.alias("value"), F.coalesce(part(1), F.lit("")).alias("period"), part(2).try_cast("int").alias("hour"), F.coalesce(part(3).try_cast("int"), F.lit(0)).alias("minute"))

    def told(x: Column) -> Column:
        period, hour = x["period"], x["hour"]
        hour = F.when(period.isin(AFTERNOON) & (hour < 12), hour + 12).when((period == "中午") & (hour < 11), hour + 12).otherwise(hour)
        return F.struct(x["x"].alias("x"), x["value"].alias("value"), hour.alias("hour"), x["minute"].alias("minute"))

    def reading(y: Column) -> Column:
        x, hour, minute = y["x"], y["hour"], y["minute"]
        at = F.when((hour <= 23) & (minute <= 59), x["on"].cast("timestamp_ntz") + F.make_interval(hours=hour, mins=minute))
        return F.struct(named(x["c"], READING_KINDS, "random").alias("kind"), named(x["c"], MEAL_CONTEXTS, "").alias("meal"),
                        y["value"].alias("value"), x["on"].alias("on"), at.alias("at"))

    clauses = F.filter(F.split(F.translate(text, ",;，；。", "\n" * 5), "\n"), lambda c: c.rlike(value))
    for step in (found, timed, told, reading):
        clauses = F.transform(clauses, step)
    return F.filter(clauses, lambda r: r["value"].isNotNull())


def bmi(weight_kg: Column, height_cm: Column) -> Column:
    """Null without a weight or a height above 0."""
    return F.when(height_cm > 0, weight_kg / F.pow(height_cm / 100, F.lit(2)))


def conflict(field: Column, now: Column, proposed: Column) -> Column:
    """Whether a proposed number differs from the present one by more than its field tolerates."""
    diff = F.abs(now - proposed)
    return F.when(now.isNull() | proposed.isNull(), F.lit(False)).when(field == "sex", now != proposed).when(field == "age_years", diff > 1).when(
        field == "height_cm", diff >= 2).when(field == "weight_kg", diff >= 3).when(now == 0, diff > 0).otherwise(diff / F.abs(now) >= 0.2)


def merge_scalars(current: DataFrame, proposed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value, verdict): accepted values win, a conflict keeps the present value and is for review."""
    c, p = current.withColumnRenamed("value", "now"), proposed.withColumnRenamed("value", "new")
    j = c.join(p, keys, "full_outer")
    clash = conflict(F.col(keys[-1]), F.col("now"), F.col("new"))
    return j.select(*keys, F.when(clash, F.col("now")).otherwise(F.coalesce("new", "now")).alias("value"),
                    F.when(F.col("new").isNull(), "kept").when(clash, "review").otherwise("accepted").alias("verdict"))


def merge_items(current: DataFrame, incoming: DataFrame, negated: DataFrame, keys: list[str]) -> DataFrame:
    """Items by key with evidence joined; an item that is also negated is in conflict."""
    c, i = current.withColumnRenamed("evidence", "old"), incoming.withColumnRenamed("evidence", "new")
    j = c.join(i, keys, "full_outer").join(negated.select(*keys, F.lit(True).alias("no")).distinct(), keys, "left")
    return j.select(*keys, F.concat_ws(" | ", "old", F.when(F.col("old").isNull() | (F.col("old") != F.col("new")), F.col("new"))).alias("evidence"), F.coalesce("no", F.lit(False)).alias("conflict"))


def resolve(reviews: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Review rows (key, now, new) with their decision: the value that holds, and the state."""
    j = reviews.join(decisions, key, "left")
    return j.select(key, F.when(F.col("decision") == "accept", F.col("new")).otherwise(F.col("now")).alias("value"),
                    F.when(F.col("decision").isNull(), "pending").otherwise(F.concat("decision", F.lit("ed"))).alias("state"))


def latest(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("n") <= n)


def type_stats(rows: DataFrame, keys: list[str], value: str, ts: str) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"),
        (F.sum(F.col(value).cast("decimal(18,4)")).cast("double") / F.count("*")).alias("mean"), F.max_by(value, ts).alias("latest"))


def level(value: Column, target: Column, low: float, very_low: float, high: float) -> Column:
    return (F.when(value < very_low, "severe_low").when(value <= low, "low").when(value >= high, "very_high").when(value > target, "above_target"))


def alerts(rows: DataFrame, key: str, kind: str, value: str, order: list, targets: dict[str, float], low: float, very_low: float, high: float, first: int = 5) -> DataFrame:
    """(key, place, code, kind): levels of the newest reading and urgent ones of the next seven, and kinds whose last
    three readings are all above target; each (code, kind) once, at most first a key."""
    target = reduce(lambda c, t: c.when(F.col(kind) == t[0], t[1]), list(targets.items())[1:], F.when(F.col(kind) == next(iter(targets)), next(iter(targets.values()))))
    r = latest(rows, [key], order, 8).withColumn("code", level(F.col(value), target, low, very_low, high))
    one = r.filter(F.col("code").isNotNull() & ((F.col("n") == 1) | (F.col("code") != "above_target"))).select(key, F.col("n").alias("at"), "code", F.col(kind).alias("kind"))
    three = latest(rows, [key, kind], order, 3).groupBy(key, kind).agg(F.count("*").alias("c"), F.min(F.col(value) - target).alias("over")).filter("c = 3 and over > 0")
    every = one.unionByName(three.select(key, F.lit(100).alias("at"), F.lit("repeated_high").alias("code"), F.col(kind).alias("kind")))
    once = every.groupBy(key, "code", "kind").agg(F.min("at").alias("at"))
    return latest(once, [key], [F.col("at"), F.col("code"), F.col("kind")], first).select(key, F.col("n").alias("place"), "code", "kind")


def roster(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(user, sources, total, newest) over activity tables (df, user column, time column)."""
    every = reduce(DataFrame.unionByName, [df.groupBy(F.col(u).alias("user")).agg(F.count("*").alias("n"), F.max(t).alias("newest")).withColumn("source", F.lit(name)) for name, (df, u, t) in tables.items()])
    return every.groupBy("user").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.sum("n").alias("total"), F.max("newest").alias("newest"))
