"""A corpus pipeline of five operators: language, lines, near duplicates, test phrases, mixture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, pack, table
from tessera.llm.decontamination import find_phrases
from tessera.llm.language_id import identify, train
from tessera.llm.line_dedup import line_dedup
from tessera.llm.mixing import mix
from tessera.llm.simhash_similar import similar_documents


def _as_documents(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, n_chars counted again where there is one."""
    return docs.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns])


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model does not reject: those with a letter, and not unlike all it has learned.

    Null and empty texts go, as they are in no language. Where no document has a language nothing is known and all go.
    Repeated rows are judged each by itself; an empty table gives an empty one. Columns of docs of any name come through.
    """
    model = train(docs, F.lit(True))
    return identify(docs, model, keep_text=True).filter("not rejected").select(*[f"`{c}`" for c in docs.columns])


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of runs of lines of 50 words or more.

    Rows that agree in doc_id and text are one document and keep the same lines. Null and empty texts stay as they are;
    an empty table gives an empty one. Columns of docs of any name come through.
    """
    return _as_documents(line_dedup(docs), docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard similarity 0.8) the document of the smallest doc_id, and
    of several with that doc_id one.

    A null doc_id comes after all others. Texts without a word are one group. An empty table gives an empty one.
    """
    def identity(hashed: Column) -> Column:
        return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), hashed)

    near = similar_documents(docs.select("doc_id", "text"), 5, 0.8)
    kept = near.filter("first").select(identity(F.col("text_hash")).alias("_id")).distinct()
    rows = pack(docs, "doc_id", "text").select(identity(F.xxhash64("text")).alias("_id"), "__row")
    return rows.groupBy("_id").agg(F.first("__row").alias("__row")).join(kept.hint("merge"), "_id", "left_semi").select("__row.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words inside passages of the benchmark, and with a line feed in each one's place.

    Null and empty texts stay as they are, repeated rows are cut each by itself; an empty table gives an empty one, and an
    empty benchmark cuts nothing. Columns of docs of any name come through.
    """
    return _as_documents(find_phrases(docs, table(spark, sf_dir, "benchmark"), cut=True), docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: a row for each copy of each document taken, with copy, size, source_size and target.

    Null and empty texts have size 0 and are worth no words. A null source is a source of its own. Columns of docs named
    like the added ones are replaced. An empty table gives an empty one.
    """
    mixed = mix(docs).filter("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies", "taken")


STAGES = [
    ("language_id", known_language),
    ("line_dedup", unrepeated_lines),
    ("simhash", one_of_each),
    ("decontamination", without_benchmark),
    ("mixing", mixture),
]

#: The model of the first stage can't be written in SQL; the tests hold every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each on the written table of the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
