"""Reading corpora, feeds, pages and composition files; sinks with upsert, ignore, replace and cascade semantics.

Plain Parquet has no row updates, so a sink is a function from the old table and the new rows to the new table, which
the caller writes to a new path or version.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Suffixes of the files of a corpus.
TEXT_SUFFIXES = ("md", "markdown", "txt", "csv", "tsv", "json")


def read_corpus(spark: SparkSession, root: str, suffixes: tuple[str, ...] = TEXT_SUFFIXES, skip: str = r"(?i)/(raw|templates)/|/readme\.") -> DataFrame:
    """(path, text) of text files under root, by suffix, without raw and template folders and readme files.

    Bytes that are not valid UTF-8 are read as Latin-1.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(root)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    return f.filter(~F.col("path").rlike(skip)).select("path", text.alias("text"))


def read_csv(spark: SparkSession, path: str, required: list[str], renames: dict[str, str] | None = None, numbers: list[str] | None = None) -> DataFrame:
    """A CSV file with headers normalised (full-width brackets, notes in brackets dropped), required columns checked, columns
    renamed, and numbers parsed to null where they are none."""
    df = spark.read.option("header", "true").csv(path)
    import re

    names = [re.sub(r"\s+", " ", re.sub(r"\(.*?\)", "", c.replace("（", "(").replace("）", ")"))).strip() for c in df.columns]
    df = df.toDF(*names)
    missing = [c for c in required if c not in names]
    if missing:
        raise ValueError(f"the file lacks the columns {missing}")
    for old, new in (renames or {}).items():
        df = df.withColumnRenamed(old, new)
    for c in numbers or []:
        df = df.withColumn(c, F.col(c).try_cast("double"))
    return df


#: What a rule file and a file of evaluation cases hold.
RULE_FILE = ("version string, rules array<struct<rule_id string, severity string, category string, description string, review_status string, "
             "then struct<action string, message string, recommendation string>, evidence struct<source_title string, evidence_level string>>>")
CASE_FILE = ("version string, cases array<struct<id string, category string, question string, expected_route string, expected_sources array<string>, "
             "expected_keywords array<string>, reference_answer string, must_not_contain array<string>>>")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """A row for each rule of rule files: version and the rule's fields, null where a rule lacks one; files of one JSON each."""
    f = spark.read.schema(RULE_FILE).option("multiLine", "true").json(path)
    return f.select("version", F.explode("rules").alias("r")).select("version", "r.*")


def rule_counts(rules: DataFrame) -> DataFrame:
    """(field, value, n): rules by severity and by category; a null or empty one counts as unknown."""
    named = lambda c: F.struct(F.lit(c).alias("field"), F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")).alias("value"))
    return rules.select(F.explode(F.array(named("severity"), named("category"))).alias("x")).select("x.*").groupBy("field", "value").agg(F.count("*").alias("n"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """A row for each case of evaluation files: missing texts are empty, missing lists empty lists, and the route is rag."""
    f = spark.read.schema(CASE_FILE).option("multiLine", "true").json(path).select("version", F.explode("cases").alias("c")).select("version", "c.*")
    lists = [c for c, kind in f.dtypes if kind.startswith("array")]
    other = {"expected_route": "rag"}
    return f.select(*[F.coalesce(c, F.array().cast("array<string>") if c in lists else F.lit(other.get(c, ""))).alias(c) for c in f.columns])


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """(title, link, description, published) of the items of landed RSS files, with defaults for what an item lacks."""
    x = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, description string, pubDate string").load(path)
    return x.select(F.coalesce("title", F.lit("untitled")).alias("title"), F.coalesce("link", F.lit("")).alias("link"),
                    F.coalesce("description", F.lit("")).alias("description"), F.coalesce("pubDate", F.lit("unknown")).alias("published"))


def article_text(html: Column, most: int = 2000) -> Column:
    """The text of the article block if there is one, else of all paragraphs joined, cut to most characters."""
    no_scripts = F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", "")
    block = F.regexp_extract(no_scripts, r"(?s)<article[^>]*>(.*?)</article>", 1)
    paragraphs = F.array_join(F.regexp_extract_all(no_scripts, F.lit(r"(?s)<p[^>]*>(.*?)</p>"), F.lit(1)), "\n")
    plain = F.regexp_replace(F.when(block != "", block).otherwise(paragraphs), r"<[^>]+>", "")
    return F.substring(F.trim(F.regexp_replace(plain, r"[ \t\n]+", " ")), 1, most)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], recency: str, created: str | None = None) -> DataFrame:
    """The newest row of each key; created keeps its earliest value. Of rows of equal recency the one with the largest other
    columns, in their order, is the newest."""
    every = old.unionByName(new)
    w = Window.partitionBy(*keys)
    rest = [F.col(c).desc() for c in old.columns if c not in (*keys, recency)]
    newest = every.withColumn("_n", F.row_number().over(w.orderBy(F.col(recency).desc(), *rest)))
    if created:
        newest = newest.withColumn(created, F.min(created).over(w))
    return newest.filter("_n = 1").drop("_n")


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """old and, of each new key that it lacks, the first row."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
    return old.unionByName(first.join(old.select(*keys).distinct(), keys, "left_anti").select(*old.columns))


def replace_documents(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of the documents in new replace all of theirs in old."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new)


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], ids: DataFrame) -> dict[str, DataFrame]:
    """Each table (df, key) without the rows of ids (id)."""
    return {name: df.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_anti") for name, (df, key) in tables.items()}


def evolved(old: DataFrame, new: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Both tables with the columns of either; columns that rows lack take the defaults."""
    df = old.unionByName(new, allowMissingColumns=True)
    return df.select(*[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in df.columns])


def table_counts(tables: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(name, rows, flagged) for tables (df, condition)."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("rows"), F.count_if(c).alias("flagged")).select(F.lit(n).alias("name"), "rows", "flagged") for n, (df, c) in tables.items()])


def write_report(path: str, summary: DataFrame, details: DataFrame) -> None:
    """A JSON report: the summary and the details, a row a line."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    details.write.mode("overwrite").json(f"{path}/details")


def listed_files(spark: SparkSession, root: str, manifest: DataFrame, name: str = r"([^/]+)$") -> DataFrame:
    """(name, files, bytes) under root, by the part of the path that the pattern finds, with the newest manifest entry (name, title, at)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.groupBy(F.regexp_extract("path", name, 1).alias("name")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    newest = manifest.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy(F.col("at").desc()))).filter("_n = 1").drop("_n")
    return files.join(newest, "name", "left")
