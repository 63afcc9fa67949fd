"""Operators that SQL does not express: small fixtures with rows derived by hand, and invariants."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import documents as D
from tessera.operators import extraction as X
from tessera.operators import foods as N
from tessera.operators import memory as M
from tessera.operators import records as P
from tessera.operators import rules as K
from tessera.operators import search as S
from tessera.sources import tables as Z


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# Text

def test_index_and_query_tokens(spark):
    assert one(spark, T.index_tokens(F.lit("Red 糖尿，病 red b-2"))) == ["red", "b-2", "糖", "尿", "病", "糖尿", "尿病"]
    assert one(spark, T.query_tokens(F.lit("糖尿病 x1 2.5，病"))) == ["糖尿病", "x1", "2.5", "病", "糖尿", "尿病", "1"]
    assert one(spark, T.index_tokens(F.lit(None).cast("string"))) == []


def test_markdown_to_text(spark):
    md = "# Title\n\n**bold** and `code` [link](http://x)\n> quote\n| a | b |\n|---|---|\n| 1 | 2 |\n```\ngone\n```\n- item"
    assert one(spark, T.plain_text(F.lit(md))) == "Title\nbold and code link\nquote\na = 1, b = 2\nitem"


def test_markdown_keeps_one_row_tables_and_prices(spark):
    assert one(spark, T.plain_text(F.lit("| only | row |\ntext $5, $6 for $a^2$ is $7"))) == "only, row\ntext $5, $6 for a^2 is $7"


def test_labels_of_pages_meals_and_intent(spark):
    assert [one(spark, T.page_label(F.lit(a), F.lit(b))) for a, b in ((3, 3), (3, 5), (None, None), (4, None))] == ["p.3", "pp.3-5", "p.1", "p.4"]
    assert one(spark, T.citation(F.lit("book"), F.lit(1), F.lit(2), F.lit("c7"))) == "book pp.1-2 [c7]"
    assert [one(spark, T.meal_label(F.lit(t))) for t in ("My Supper", "早饭吃了", "bread")] == ["dinner", "breakfast", "meal"]
    assert [one(spark, T.is_actual_intake(F.lit(t))) for t in ("如果吃米饭", "如果早餐吃", "bread")] == [False, True, True]
    assert one(spark, T.is_actual_intake(F.lit("bread"), F.lit(" No"))) is False
    assert one(spark, T.session_title(F.lit("  What now?! \n"))) == "What now"


def test_fuzzy_match_finds_names_with_any_letter_wrong(spark):
    names = ["alpha song", "beta song", "gamma ray", "x"]
    wrong = ["zlpha song", "lpha song", "gamma rya", "bet asong", "qqqqqqqqqq"]
    out = {r["q"]: r["name"] for r in S.fuzzy_match(spark.createDataFrame([(w,) for w in wrong], "q string"), spark.createDataFrame(list(enumerate(names)), "id long, name string")).collect()}
    assert out == {"zlpha song": "alpha song", "lpha song": "alpha song", "gamma rya": "gamma ray", "bet asong": "beta song"}


def test_queries_in_blocks_are_all_answered(spark):
    corpus = spark.createDataFrame([(i, [float(i), 1.0, 2.0]) for i in range(40)] + [(99, [1.0])], "vec_id long, embedding array<double>")
    whole = S.vector_top(corpus, corpus, 3).orderBy("query_id", "rank").collect()
    blocked = S.in_blocks(corpus.select(F.col("vec_id").alias("q")), lambda b: corpus.join(b, F.col("vec_id") >= F.col("q")).select("vec_id", "q"), rows=7)
    assert blocked.count() == sum(1 for i in [*range(40), 99] for j in [*range(40), 99] if j >= i)
    assert whole == S.vector_top(corpus, corpus, 3).orderBy("query_id", "rank").collect() and len(whole) == 121


def test_keyword_windows_skip_covered_hits_and_keep_the_budget(spark):
    text = "x" * 100 + "alpha" + "y" * 20 + "beta" + "z" * 400 + "gamma"
    out = one(spark, T.keyword_windows(F.lit(text), ["alpha", "beta", "gamma", "none"], 1000, 10, 50))
    assert [w[:15] for w in out] == ["x" * 10 + "alpha", "z" * 10 + "gamma"]
    assert len(one(spark, T.keyword_windows(F.lit(text), ["alpha", "gamma"], 60, 10, 50))) == 1


@pytest.mark.parametrize("said,number", [("零", 0), ("十", 10), ("二十五", 25), ("十二", 12), ("三点五", 3.5), ("一二", 12), ("很多", None), ("", None)])
def test_chinese_numbers(spark, said, number):
    assert one(spark, T.chinese_number(F.lit(said))) == number


def test_recovered_and_masked_json(spark):
    assert one(spark, T.recovered_json(F.lit('so: ```json\n{"a": [1]}\n``` ok'))) is not None
    assert one(spark, T.recovered_json(F.lit("none"))) is None
    assert one(spark, T.masked(F.lit('{"a": {"my_Token": "x\\"y", "b": 1}, "secret": 5}'), ["token", "secret"])) == '{"a": {"my_Token": "***", "b": 1}, "secret": "***"}'


# Documents

def test_sentences_are_packed_to_the_target(spark):
    out = one(spark, D.packed_sentences(F.lit("One two. Three four. Five six! Seven."), 20))
    assert out == ["One two. Three four.", "Five six! Seven."]


def test_line_paragraphs(spark):
    out = one(spark, D.line_paragraphs(F.lit("a\nb\n\nc\n# H\nd\n" + "e" * 896 + "\nf"), most=900))
    assert out == ["a\nb", "c", "# H\nd\n" + "e" * 896, "f"]


def packed(spark, units, **params):
    df = spark.createDataFrame([(1, i + 1, 0, t, s, p, False) for i, (t, s, p) in enumerate(units)], "doc_id long, page int, no int, text string, section string, path string, heading boolean")
    return [r.asDict() for r in D.chunk_documents(df, **params).orderBy("chunk_index").collect()]


def test_chunks_overlap_and_carry_pages_and_sections(spark):
    out = packed(spark, [("a" * 60, "S1", "S1"), ("b" * 60, "S1", "S1"), ("c" * 30, "S2", "S2")], chunk_chars=100, overlap=20)
    assert [(c["page_start"], c["page_end"], c["section"]) for c in out] == [(1, 1, "S1"), (1, 2, "S1"), (2, 3, "S2")]
    assert out[1]["text"] == "a" * 20 + "\n\n" + "b" * 60 and out[2]["text"] == "b" * 20 + "\n\n" + "c" * 30


def test_chunks_keep_all_units_and_the_limit(spark):
    rng = random.Random(1)
    units = [(f"u{i} " + "x" * rng.randrange(200), "S", "S") for i in range(120)]
    out = packed(spark, units, chunk_chars=500, overlap=0)
    assert "\n\n".join(c["text"] for c in out) == "\n\n".join(t.strip() for t, _, _ in units)
    assert all(len(c["text"].replace("\n\n", "")) <= 500 for c in out)


def test_newest_versions(spark):
    paths = ["/w/a-20240101000000", "/w/a-20240201000000", "/w/a", "/w/b", "/v/a"]
    out = {r["path"] for r in D.newest_versions(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert out == {"/w/a-20240201000000", "/w/b", "/v/a"}


# Search

def test_diverse_top_keeps_no_near_copies(spark):
    rows = [(1, 10, 0.9, ["a", "b", "c"]), (1, 11, 0.8, ["a", "b", "c"]), (1, 12, 0.7, ["a", "b", "d"]), (1, 13, 0.6, ["x"]), (1, 14, 0.5, ["y"])]
    out = S.diverse_top(spark.createDataFrame(rows, "item_id long, doc_id long, score double, tokens array<string>"), "item_id", top=3).collect()
    assert [(r["place"], r["doc_id"]) for r in out] == [(1, 10), (2, 12), (3, 13)]


def test_hybrid_finds_the_document_with_the_words(spark):
    docs = spark.createDataFrame([(i, f"common words number{i} topic{i % 5}") for i in range(30)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "number7 topic2"), (2, "nothing here")], "item_id long, text string")
    out = S.hybrid(docs, asked, [("zzz", "*", 0.1)], top=3).collect()
    assert next(r["doc_id"] for r in out if r["item_id"] == 1 and r["place"] == 1) == 7


# Foods, records, memory, rules

def test_meal_sentences(spark):
    out = one(spark, N.meal_items(F.lit("200g rice，两碗汤、苹果一个 and tea")))
    assert [(i["name"], i["quantity"], i["unit"]) for i in out] == [("rice", 200, "g"), ("汤", 2, "碗"), ("苹果", 1, "个"), ("tea", 1, None)]


def test_readings_with_relative_days(spark):
    out = one(spark, P.readings(F.lit("fasting 6.1 mmol, yesterday after lunch 180 mg/dl, 99 mmol"), F.lit("2024-05-02").cast("date")))
    assert [(r["kind"], r["value"], r["on"]) for r in out] == [("fasting", 6.1, datetime.date(2024, 5, 2)), ("post_meal", 10.0, datetime.date(2024, 5, 1))]


def test_readings_with_kinds_meals_and_times(spark):
    said = "空腹血糖 5.6 mmol/L，前天晚上8点30早餐前血糖 7 毫摩尔，昨天餐后2小时 180毫克每分升，睡前 25:70 6 mmol；50 mmol，中午 1点午餐后 6.5mmol，血糖高"
    out = one(spark, P.readings(F.lit(said), F.lit("2024-05-03 10:00:00").cast("timestamp_ntz")))
    day, at = datetime.date, datetime.datetime
    assert [(r["kind"], r["meal"], r["value"], r["on"], r["at"]) for r in out] == [
        ("fasting", "", 5.6, day(2024, 5, 3), None), ("pre_meal", "breakfast", 7.0, day(2024, 5, 1), at(2024, 5, 1, 20, 30)),
        ("postprandial_2h", "", 10.0, day(2024, 5, 2), None), ("bedtime", "", 6.0, day(2024, 5, 3), None), ("post_meal", "lunch", 6.5, day(2024, 5, 3), at(2024, 5, 3, 13, 0))]
    assert one(spark, P.readings(F.lit(None).cast("string"), F.lit("2024-05-03").cast("date"))) in (None, [])


def test_out_of_range_values_give_nothing(spark):
    assert one(spark, P.guarded(F.lit("am 400 years"), r"am (\d+) years", 1, 120)) is None
    assert one(spark, T.glucose_mmol(F.lit(700.0), F.lit("mg/dL"))) is None


def turns(spark, roles):
    return spark.createDataFrame([(1, i, r, f"t{i}") for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string")


def test_history_keeps_tool_turns_with_their_call(spark):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "assistant", "user", "assistant"]
    kept = sorted(r["turn"] for r in M.trimmed_history(turns(spark, roles), 2).collect())
    assert kept == [0, 3, 4, 5, 6, 7, 8]
    assert M.trimmed_history(turns(spark, roles[:5]), 2).count() == 5


def test_compaction_reaches_back_over_tool_turns(spark):
    roles = ["user", "assistant", "user", "assistant", "tool", "tool", "assistant", "user"]
    kept = sorted(r["turn"] for r in M.compaction(turns(spark, roles), 5, 4).filter("part = 'kept'").collect())
    assert kept == [3, 4, 5, 6, 7]


def test_decay_falls_with_age_and_upsert_is_idempotent(spark):
    w = [one(spark, M.decayed(F.lit(0.9), F.lit(float(a)), F.lit(14.0))) for a in (0, 7, 14, 1000)]
    assert w[0] == 0.9 and abs(w[2] - 0.45) < 1e-9 and w[3] == 0.08 and w == sorted(w, reverse=True)
    old = spark.createDataFrame([("u", "k", "semantic", "v", ["e1"])], "user_id string, dedupe_key string, layer string, value string, evidence array<string>")
    new = spark.createDataFrame([("u", "k", "semantic", "w", ["e2"], 1)], "user_id string, dedupe_key string, layer string, value string, evidence array<string>, ts long")
    first = M.upsert_memories(old, new)
    again = M.upsert_memories(first.drop("conflict"), new)
    assert first.collect() == again.collect()


def test_rules_nest_and_missing_fields_are_false(spark):
    df = spark.createDataFrame([(1, ["Aspirin 100"], None), (2, ["paracetamol"], "80")], "id long, drugs array<string>, weight string")
    rule = {"rule_id": "r", "severity": "warn", "message": "m", "if": {"all": [{"field": "drugs", "op": "contains_any", "value": ["aspirin", "para"]}, {"not": {"field": "weight", "op": "greater_than", "value": 70}}]}}
    assert [r["id"] for r in K.findings(df, "id", [rule]).collect()] == [1]


def test_rules_of_a_file_and_its_normalisation(spark):
    df = spark.createDataFrame([(1, "Low-sodium salt", "Brand", "7"), (2, "lowsodium", "other", "x"), (3, None, None, None), (4, "西柚汁", " BRAND ", "5")], "id long, food string, brand string, n string")
    leaf = lambda op, f, *v: [r["x"] for r in df.orderBy("id").select(K.predicate(df, {"field": f, "operator": op, "values": list(v)}).alias("x")).collect()]
    assert leaf("contains_any", "food", "low_sodium  salt", "pomelo") == [True, False, False, False]
    assert leaf("contains_any", "food", "西柚") == [False, False, False, True]
    assert leaf("equals", "brand", "x", "brand ") == [True, False, False, True]
    assert leaf("greater_than", "n", 6) == [True, False, False, False] and leaf("exists", "n") == [True, True, False, True]
    rule = {"rule_id": "g", "severity": "block", "if": {"all": [{"field": "food", "operator": "contains_any", "values": ["salt"]}]}, "then": {"message": "m"}}
    assert [tuple(r) for r in K.findings(df, "id", [rule]).collect()] == [(1, "g", "block", "m")]


@pytest.mark.parametrize("said,want", [("是的！", "accept"), ("确认 更新。", "accept"), ("不是", "reject"), ("不对，先别 更新", "reject"), ("我还想再考虑一下然后再告诉你是的", "accept"), ("我还想再考虑一下然后再告诉你是的吧", None), ("hm", None), ("", None), (None, None)])
def test_review_decision(spark, said, want):
    assert one(spark, K.review_decision(F.lit(said).cast("string"))) == want


def test_rule_drafts_take_ids_and_defaults(spark):
    kind = "source string, at int, rule_id string, severity string, category string, description string, then struct<action:string,message:string,recommendation:string>, evidence struct<source_title:string,evidence_level:string>"
    rows = [("guide 1", 1, " low-salt rule!", "block", "c", "d", ("a", "m", "r"), ("t", "l")), ("guide 1", 2, None, None, None, None, None, None)]
    got = K.rule_drafts(spark.createDataFrame(rows, kind), "source", "at").collect()
    by_id = {r["rule_id"]: r for r in got}
    assert set(by_id) == {"LOW_SALT_RULE", "DRAFT_GUIDE_1_2"} and {r["review_status"] for r in got} == {"draft_needs_review"}
    made = by_id["DRAFT_GUIDE_1_2"]
    assert (made["severity"], made["category"], made["then"]["action"], made["evidence"]["source_title"]) == ("warn", "draft_clinical_nutrition", "warn", "guide 1")


# Sinks

def test_upsert_twice_is_upsert_once(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, ts int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "k int, v string, ts int")
    once = Z.upsert(old, new, ["k"], "ts")
    assert sorted(once.collect()) == sorted(Z.upsert(once, new, ["k"], "ts").collect()) == [(1, "a", 1), (2, "c", 2), (3, "d", 2)]


def test_csv_import_checks_its_columns(spark, tmp_path):
    (tmp_path / "f.csv").write_text("id（code）,energy (kcal)\n1,12.5\n2,Tr\n")
    df = Z.read_csv(spark, str(tmp_path / "f.csv"), ["id", "energy"], numbers=["energy"])
    assert [tuple(r) for r in df.collect()] == [("1", 12.5), ("2", None)]
    with pytest.raises(ValueError):
        Z.read_csv(spark, str(tmp_path / "f.csv"), ["protein"])


def test_corpus_scan_skips_and_decodes(spark, tmp_path):
    for name, content in (("a.md", "é".encode()), ("raw/b.md", b"x"), ("README.md", b"x"), ("c.txt", b"\xe9"), ("d.bin", b"x")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    out = {r["path"].rsplit("/", 1)[1]: r["text"] for r in Z.read_corpus(spark, str(tmp_path)).collect()}
    assert out == {"a.md": "é", "c.txt": "é"}


def test_meal_sentences_of_several_quantities(spark):
    def of(said):
        return [(i["name"], i["quantity"], i["unit"]) for i in one(spark, N.meal_items(F.lit(said)))]

    assert of("我早餐吃了一百五十克米饭两杯牛奶，还有半个苹果") == [("米饭", 150, "克"), ("牛奶", 2, "杯"), ("苹果", 0.5, "个")]
    assert of("一些菜") == [("一些菜", 1, None)] and of("鸡蛋3个") == [("鸡蛋", 3, "个")]
    assert of("") == [] and one(spark, N.meal_items(F.lit(None).cast("string"))) == []


@pytest.mark.parametrize("said,number", [("半", 0.5), ("一百", 100), ("百", 100), ("二百五十", 250), ("一百零五", 105), ("三半", 3.5), ("百里", None)])
def test_hundreds_and_halves(spark, said, number):
    assert one(spark, T.chinese_number(F.lit(said))) == number


def test_marker_rows(spark):
    cut = one(spark, X.marker_slice(F.lit("x END b START one 1\ntwo END three END"), ["START", "none"], ["END", "three"]))
    assert cut == "START one 1\ntwo"
    assert one(spark, X.marker_slice(F.lit("nothing here"), ["START"], ["END"])) == ""
    rows = one(spark, X.table_rows(F.lit("注 1 note\nrice | 12 30\n 4444 5\nplain words\nab"), "row", True))
    assert [(r["label"], r["line"]) for r in rows] == [("rice", "rice | 12 30"), ("row", "4444 5")]
    assert [r["label"] for r in one(spark, X.table_rows(F.lit("表 one\nplain words\nab"), "row", False))] == ["plain words"]
    assert one(spark, X.table_rows(F.lit(None).cast("string"), "row", True)) == []


def test_portions_and_carried_categories(spark):
    got = one(spark, X.exchange_pairs(F.lit("rice cake 25 \n每份能量 90\n注 oil 10\nmilk 240; red 7 bean 30\nx 5")))
    # A name may hold figures and blanks, so it reaches to the last number of its run.
    assert [(p["name"], p["number"]) for p in got] == [("ricecake", 25), ("red7bean", 30)]
    texts = spark.createDataFrame([(1, "肉类\n牛肉 83.7 羊肉 109\n\n蔬菜\n菠菜 13"), (2, "a 1"), (3, None)], "id long, text string")
    got = sorted((r["id"], r["line"], r["category"] or "", r["name"], r["number"]) for r in X.carried_pairs(texts, "id", "text").collect())
    assert got == [(1, 1, "肉类", "牛肉", 83.7), (1, 1, "肉类", "羊肉", 109), (1, 4, "蔬菜", "菠菜", 13), (2, 0, "", "a", 1)]


def test_two_levels_and_labelled_fields(spark):
    said = "# A\n- one\nx\ny\n- two\n# B\nz"
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(said.split("\n"))], "id long, no int, line string")
    got = [(r["outer_name"], r["inner_name"], r["first_no"], r["body"]) for r in X.two_levels(lines, "id", "^# (.*)$", "^- (.*)$").orderBy("first_no").collect()]
    assert got == [("A", None, 0, ""), ("A", "one", 1, "x\ny"), ("A", "two", 4, ""), ("B", None, 5, "z")]
    fields = one(spark, X.labelled_fields(F.lit("主要材料：米50g，*山药*3片 制作方法：煮 注意：慎用"), {"ingredients": "主要材料：", "method": "制作方法：", "usage": "用法用量：", "cautions": "注意："}))
    assert fields.asDict() == {"ingredients": "米50g，*山药*3片", "method": "煮", "usage": "", "cautions": "慎用"}
    got = one(spark, X.ingredients(F.lit(fields["ingredients"])))
    assert [(i["name"], i["amount"], i["unit"]) for i in got] == [("米", 50, "g"), ("山药", 3, "片")]


def test_facts_and_titles(spark):
    assert one(spark, X.fact(F.lit("能量约为 1500～1700 kcal，蛋白质 60 g"), "能量", "kcal")) == 1600
    assert one(spark, X.fact(F.lit("蛋白质 60 g"), "能量", "kcal")) is None
    assert one(spark, X.title_key(F.lit(" Guide (old)  to Food-v20240102030405-2 "))) == "guide to food"
    entries = spark.createDataFrame([("Guide", 1), ("guide (b)", 3), (None, 2), ("", 4)], "title string, id long")
    assert sorted((r["title_key"] or "", r["id"]) for r in X.newest_entries(entries, "title", "id").collect()) == [("", 2), ("", 4), ("guide", 3)]


def test_portion_strings(spark):
    assert [(p["name"], p["grams"]) for p in one(spark, N.portions_of(F.lit("cup=12.0g; big slice = 30 g;bad;=4g; x=yg")))] == [("cup", 12.0), ("big slice", 30.0), ("", 4.0), ("x", None)]


def test_detected_items_and_sweet_notice(spark):
    said = '{"items": [{"name": "Milk", "estimated_ml": 200, "quantity": 2, "unit": "cup"}, {"food_name": "tea", "estimated_ml": 100, "risk_tags": ["含奶"]}, {"name": " "}, {"name": "rice", "estimated_grams": 50, "estimated_ml": 9}, {"name": "egg"}]}'
    df = spark.createDataFrame([(1, said), (2, None), (3, "no JSON"), (4, "{}")], "id long, payload string")
    got = sorted((r["id"], r["name"], r["quantity"], r["unit"] or "", r["grams"] or 0) for r in N.detected_items(df, "id", "payload").collect())
    assert got == [(1, "Milk", 2, "cup", 206), (1, "egg", 1, "", 0), (1, "rice", 1, "", 50), (1, "tea", 1, "", 103)]
    notice = lambda names, sick: one(spark, N.sweet_notice(F.lit(None).cast("array<string>") if names is None else F.array(*[F.lit(n) for n in names]), F.lit(sick)))
    assert notice(["rice", "Milk Tea"], True) and not notice(["Milk Tea"], False) and not notice(["rice"], True) and not notice(None, True)


def test_recipe_tree(spark):
    said = "春季食谱 1\nno meal yet 5g\n早餐 粥（米 50g，*山药【干】 3.5 片。）\n水\n注：note\n加餐\n（糖 5g）\n晚餐\n本食谱提供能量约为 1500kcal"
    df = spark.createDataFrame([(1, said), (2, ""), (3, None), (4, "早餐 title only（米 5g）")], "id long, text string")
    got = [tuple(r) for r in X.recipe_tree(df, "id", "text").orderBy("meal_no", "dish_no", "ingredient_no").collect()]
    assert got == [(1, 1, "早餐", 1, "粥", 0, "米", 50, "g"), (1, 1, "早餐", 1, "粥", 1, "山药干", 3.5, "片"), (1, 1, "早餐", 2, "水", None, None, None, None),
                   (1, 2, "加餐", 1, "（糖 5g）", 0, "糖", 5, "g")]


def test_plan_nutrition_and_rule_targets(spark):
    exact = one(spark, X.plan_nutrition(F.lit("本食谱提供能量约为 1500 kcal，\n其中蛋白质 60.5 g，碳水化合物 200 g，脂肪 40 g；蛋白质 16%，碳水化合物 54%，脂肪 24%")))
    assert tuple(exact) == (1500, 60.5, 200, 40, 16, 54, 24)
    ranged = one(spark, X.plan_nutrition(F.lit("本食谱可提供能量及营养，总值为 1500～1700 kcal，蛋白质 60-70 g，碳水化合物 200 g，脂肪 40 g")))
    assert tuple(ranged) == (1600, 65, 200, 40, None, None, None)
    assert tuple(one(spark, X.plan_nutrition(F.lit("no facts")))) == (None,) * 7
    pages = spark.createDataFrame([(1, 2, "a b\nx"), (1, 1, "ab y"), (1, 3, "ab"), (2, 1, None)], "id long, page int, text string")
    assert [tuple(r) for r in X.rule_targets(pages, "id", "page", "text", [(["ab"], ["x", "y"], [("n", "<2")])]).collect()] == [(1, "n", "<2", 1)]


def test_adjusted_scores(spark):
    rows = [("rice 多少", "table", "rice", "rice", "rice 5", 1.0), ("rice 多少", "plan", "fried rice", None, "rice", 1.0), ("多少", "plan", "x", "x", "x", 1.0)]
    found = spark.createDataFrame(rows, "query string, type string, title string, label string, text string, score double")
    got = [r["s"] for r in found.select(S.adjusted(found, ["多少"], [("", "rice", ["plan"], 0.5, 1.0)]).alias("s")).collect()]
    assert got == [1 + 40 + 20, (1 + 30 + 10) * 0.5 + 1, 1.0]
