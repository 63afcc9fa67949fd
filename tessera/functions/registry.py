"""Named functions for SQL: text expressions as SQL functions, and table functions for LATERAL joins. All run in the JVM."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class SqlFunction:
    name: str
    parameters: str
    returns: str
    body: str


#: The registry: name, declared parameters, result type and SQL body.
FUNCTIONS = [
    SqlFunction("tessera_collapse", "t STRING", "STRING", r"trim(regexp_replace(t, '\\s+', ' '))"),
    SqlFunction("tessera_dedupe_key", "a STRING, b STRING", "STRING", r"regexp_replace(lower(concat_ws(':', a, b)), '\\s+', '')"),
    SqlFunction("tessera_words", "t STRING", "ARRAY<STRING>", "regexp_extract_all(lower(t), '([a-z0-9_+-]+)', 1)"),
    SqlFunction("tessera_jaccard", "a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "coalesce(try_divide(size(array_intersect(a, b)), size(array_union(a, b))), 0D)"),
    SqlFunction("tessera_normalize", "t STRING", "STRING", r"trim(regexp_replace(regexp_replace(replace(t, '\\r\\n', '\\n'), '[ \\t]+', ' '), '\\n{3,}', '\\n\\n'))"),
    SqlFunction("tessera_content_id", "t STRING", "STRING", "sha2(t, 256)"),
    SqlFunction("tessera_midpoint", "a DOUBLE, b DOUBLE", "DOUBLE", "coalesce(bround((a + b) / 2, 2), a, b)"),
    SqlFunction("tessera_glucose_mmol", "v DOUBLE, unit STRING", "DOUBLE",
                "CASE WHEN (CASE WHEN lower(trim(unit)) = 'mg/dl' THEN v / 18 ELSE v END) BETWEEN 1 AND 35 THEN bround(CASE WHEN lower(trim(unit)) = 'mg/dl' THEN v / 18 ELSE v END, 1) END"),
    SqlFunction("tessera_index_tokens", "t STRING", "ARRAY<STRING>",
                "slice(array_distinct(concat(regexp_extract_all(lower(coalesce(t, '')), '([a-z0-9_+-]+)', 1), regexp_extract_all(lower(coalesce(t, '')), '([一-鿿])', 1), "
                "regexp_extract_all(array_join(regexp_extract_all(lower(coalesce(t, '')), '([一-鿿])', 1), ''), '(?=(.{2}))', 1))), 1, 80)"),
    SqlFunction("tessera_strip_edges", "t STRING", "STRING", r"regexp_replace(t, '^[\\s　，,。.!！“”\":：\\-－、\\[\\]【】]+|[\\s　，,。.!！“”\":：\\-－、\\[\\]【】]+$', '')"),
    SqlFunction("tessera_stable_id", "prefix STRING, raw STRING", "STRING", "concat(prefix, '_', substr(sha1(coalesce(raw, '')), 1, 20))"),
    SqlFunction("tessera_page_label", "a INT, b INT", "STRING",
                "CASE WHEN coalesce(nullif(b, 0), nullif(a, 0), 1) = coalesce(nullif(a, 0), 1) THEN concat('p.', coalesce(nullif(a, 0), 1)) ELSE concat('pp.', coalesce(nullif(a, 0), 1), '-', b) END"),
    SqlFunction("tessera_session_title", "t STRING", "STRING", r"substr(regexp_replace(trim(regexp_replace(coalesce(t, ''), '\\s+', ' ')), '[。！？!?.,，；;：: ]+$', ''), 1, 40)"),
    SqlFunction("tessera_meal_label", "t STRING", "STRING",
                "CASE WHEN lower(t) RLIKE 'breakfast|早餐|早饭' THEN 'breakfast' WHEN lower(t) RLIKE 'lunch|午餐|午饭' THEN 'lunch' WHEN lower(t) RLIKE 'dinner|supper|晚餐|晚饭' THEN 'dinner' "
                "WHEN lower(t) RLIKE 'snack|加餐|夜宵' THEN 'snack' ELSE 'meal' END"),
    SqlFunction("tessera_front_matter", "t STRING", "MAP<STRING, STRING>",
                r"map_from_entries(transform(filter(split(regexp_extract(t, '(?s)\\A---\n(.*?)\n---\n', 1), '\n'), x -> contains(x, ':')), "
                r"x -> struct(trim(substring_index(x, ':', 1)), trim(regexp_replace(x, '^[^:]*:', '')))))"),
    SqlFunction("tessera_grams", "quantity DOUBLE, unit STRING, density DOUBLE", "DOUBLE",
                "quantity * CASE lower(trim(unit)) WHEN 'g' THEN 1D WHEN 'kg' THEN 1000D WHEN 'jin' THEN 500D WHEN 'liang' THEN 50D WHEN 'ml' THEN density WHEN 'l' THEN 1000D * density END"),
    SqlFunction("tessera_cosine", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE",
                "CASE WHEN size(a) = size(b) THEN coalesce(try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x), "
                "sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x))), 0D) ELSE 0D END"),
    SqlFunction("tessera_clamp", "v STRING, other DOUBLE, low DOUBLE, high DOUBLE", "DOUBLE", "greatest(low, least(high, coalesce(try_cast(v AS DOUBLE), other)))"),
    #: Each item of a meal sentence: a name with a quantity and unit before or after it; an item without one counts 1.
    SqlFunction("tessera_meals", "t STRING", "TABLE(no INT, name STRING, quantity DOUBLE, unit STRING)",
                r"SELECT pos, trim(regexp_replace(regexp_replace(c, '(?i)(\\d+(?:\\.\\d+)?)\\s*(kg|g|ml|l|cup|bowl|piece|slice)(?![a-z])', ''), '^\\s*of ', '')), "
                r"coalesce(try_cast(regexp_extract(c, '(?i)(\\d+(?:\\.\\d+)?)\\s*(kg|g|ml|l|cup|bowl|piece|slice)(?![a-z])', 1) AS DOUBLE), 1D), "
                r"nullif(lower(regexp_extract(c, '(?i)(\\d+(?:\\.\\d+)?)\\s*(kg|g|ml|l|cup|bowl|piece|slice)(?![a-z])', 2)), '') "
                r"FROM posexplode(filter(transform(split(coalesce(t, ''), '(?i)[，,、。；;+\n]+|\\band\\b'), x -> trim(x)), x -> x <> '')) AS p(pos, c)"),
    #: Overlapping pieces of a text; an empty or null text is one empty piece.
    SqlFunction("tessera_chunks", "t STRING, size INT, overlap INT", "TABLE(no INT, chunk STRING)",
                "SELECT pos, piece FROM posexplode(transform(sequence(0, greatest(0, length(coalesce(t, '')) - overlap - 1), greatest(1, size - overlap)), "
                "x -> substr(coalesce(t, ''), x + 1, size))) AS p(pos, piece)"),
    #: Each clause of a text that has a value with a unit.
    SqlFunction("tessera_readings", "t STRING", "TABLE(kind STRING, value DOUBLE, unit STRING)",
                "SELECT CASE WHEN c RLIKE 'fasting|空腹' THEN 'fasting' WHEN c RLIKE 'after|餐后' THEN 'post_meal' ELSE 'random' END, "
                "try_cast(regexp_extract(c, '([0-9.]+) *(mmol|mg/dl)', 1) AS DOUBLE), regexp_extract(c, '([0-9.]+) *(mmol|mg/dl)', 2) "
                "FROM explode(split(t, '[,;，；。]')) AS p(c) WHERE c RLIKE '[0-9.]+ *(mmol|mg/dl)'"),
]


def register_functions(spark: SparkSession) -> list[str]:
    """Declare all functions in the session; returns their names."""
    for f in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {f.name}({f.parameters}) RETURNS {f.returns} RETURN {f.body}")
    return [f.name for f in FUNCTIONS]
