"""What the findings of round 3 named: work that is done once and no longer once for each use."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

from tessera.operators import extraction as X
from tessera.operators import records as P
from tessera.streaming import streams as S


def patterns_in(df) -> int:
    """Regular expressions in the plan of df."""
    return len(re.findall(r"rlike|regexp", df._jdf.queryExecution().analyzed().toString().lower()))


def test_a_clause_is_searched_once_for_each_of_its_facts(spark):
    """Two for the value and its unit, one for the time and three for its parts, one to choose clauses, one for mg and one for a kind, over two days."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    df = spark.createDataFrame([("yesterday 下午3:20 after dinner 180 MG/dL; 中午12点 空腹 6.25 mmol, pulse 70",)], "t string")
    said = df.select(P.readings(F.col("t"), F.lit("2024-05-03 10:00:00").cast("timestamp_ntz")).alias("r"))
    assert [(r["kind"], r["meal"], r["value"], str(r["on"]), str(r["at"])) for r in said.first()["r"]] == [
        ("post_meal", "dinner", 10.0, "2024-05-02", "2024-05-02 15:20:00"), ("fasting", "", 6.2, "2024-05-03", "2024-05-03 12:00:00")]
    assert patterns_in(said) <= 12


def test_ingredients_and_dishes_are_found_once(spark):
    """A part's name is searched for once, not for each group, and the windows of a plan share one order."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    text = "plan\n早餐 粥（ . *米*50g，水2.5 ml 煮【干】枣3枚）\n早餐x\n\n午餐\n汤（盐）\n本食谱提供能量约为 1\n早餐 本食谱提供能量"
    df = spark.createDataFrame([(1, text)], "id int, t string")
    tree = X.recipe_tree(df, "id", "t")
    assert [tuple(r)[1:] for r in tree.orderBy("meal_no", "dish_no", "ingredient_no").collect()] == [
        (1, "早餐", 1, "粥", 0, "米", 50.0, "g"), (1, "早餐", 1, "粥", 1, "水", 2.5, "ml"), (1, "早餐", 2, "早餐x", None, None, None, None),
        (2, "午餐", 1, "汤", None, None, None, None), (3, "早餐", 1, "本食谱提供能量", None, None, None, None)]
    assert patterns_in(df.select(X.ingredients(F.col("t")).alias("i"))) <= 4
    assert tree._jdf.queryExecution().executedPlan().toString().count("Sort [") <= 1


def test_a_drop_has_more_files_with_more_rows_and_is_one_batch(spark, monkeypatch):
    monkeypatch.setattr(S, "FILE_ROWS", 5)
    df = spark.range(60).withColumn("drop", F.col("id") % 2)
    files = []
    monkeypatch.setattr(S, "stream_of", lambda _, path, schema, n: files.append((n, spark.read.parquet(path).select(F.input_file_name()).distinct().count())))
    S.landed(df, F.col("drop"), 2)
    assert files == [(6, 12)]


def test_the_state_of_a_group_is_one_value(spark):
    """Nulls, whole numbers beyond 2^53 and lists come back as they were kept."""
    class Held:
        def __init__(self):
            self.value = None

        def getValueState(self, name, schema):
            assert schema == "rows binary"
            return self

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    high, turns = S.RepeatedHigh(1), S.Compaction(4, 2)
    high.init(Held()), turns.init(Held())
    high.keep(pd.DataFrame({"state_key": ["a", "b"], "value": [1.5, float("nan")]}))
    assert [(k, None if v != v else v) for k, v in high.kept_rows()] == [("a", 1.5), ("b", None)]
    turns.keep(pd.DataFrame({"state_key": ["a", "b"], "turns": [[(1 << 60) + 1], []], "batches": [3, 0]}))
    assert [(k, list(t), b) for k, t, b in turns.kept_rows()] == [("a", [(1 << 60) + 1], 3), ("b", [], 0)]
    high.keep(pd.DataFrame({"state_key": [], "value": []}))
    assert not list(high.kept_rows())
