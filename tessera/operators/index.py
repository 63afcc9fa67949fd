"""A stored block-max index: posting blocks written once, searched by bounds, extended without a rebuild.

Documents are dealt to segments of about BLOCK documents of like length. A block is what one segment has of one token: its
documents, how often each holds it, their lengths, and the largest count and smallest length, which bound any score in it.
Blocks are partitioned by a hash of the token and sorted by it, so a search reads the files of its tokens, and no row or
task grows with how frequent a token is.

A search scores the rarest tokens of each query first; the k-th best of these partial scores is a threshold that the final
k-th best can't be under. Tokens whose largest possible scores add up to less decide nothing alone: only blocks of the other
tokens make candidates, segments whose blocks can't reach the threshold are passed over, and what is left is completed. Results
are exact.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.joins import BROADCAST_ROWS, small
from tessera.sources.scratch import materialize, spread

WORD = "[a-z0-9_+-]+"
#: Documents of a segment, about; buckets of the tables by a hash of the token.
BLOCK, BUCKETS = 128, 32
#: Words of a part of the texts, about: what a task counts at once.
PART_WORDS = 1_000_000
#: What rounding may take from a bound.
SLACK = 1e-5


def _bucket(tok: Column) -> Column:
    return F.pmod(F.xxhash64(tok), F.lit(BUCKETS)).cast("int")


@dataclass
class Index:
    """The tables of an index in a folder that all executors share."""

    spark: SparkSession
    path: str

    def blocks(self) -> DataFrame:
        """(tok, segment, docs, tfs, lengths, n, occurrences, max_tf, min_length, bucket)"""
        kind = dict(self.lengths().dtypes)["doc_id"]
        return self.spark.read.schema(
            f"tok string, segment long, docs array<{kind}>, tfs array<int>, lengths array<int>, n long, occurrences long, max_tf int, min_length int, bucket int").parquet(f"{self.path}/blocks")

    def lengths(self) -> DataFrame:
        """(doc_id, length, added) of each document with a word; added numbers the times documents were added."""
        return self.spark.read.parquet(f"{self.path}/lengths")

    def tokens(self) -> DataFrame:
        """(tok, df, occurrences) of the whole index."""
        return self.blocks().groupBy("tok").agg(F.sum("n").alias("df"), F.sum("occurrences").alias("occurrences"))


def write_index(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> Index:
    """An index of docs at path, or the documents added to the index there; ids should be new to it.

    Texts that are null or without a word are in no block. What is there is neither read, but for the number of times
    documents were added, nor rewritten.
    """
    index = Index(docs.sparkSession, path)
    d = spread(docs.select(F.col(key).alias("doc_id"), F.lower(F.coalesce(text, F.lit(""))).alias("low")))
    d = d.withColumn("length", F.regexp_count("low", F.lit(WORD)))
    kind = F.floor(4 * F.log2(F.greatest("length", F.lit(1)))).cast("long")
    try:
        added = index.lengths().agg(F.max("added")).first()[0]
    except Exception as e:  # the first documents: no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        added = None
    added = 0 if added is None else added + 1
    # No filter by length before this: it would be moved to the scan, which may have fewer tasks.
    lengths = materialize(d.select("doc_id", "length", kind.alias("kind")), "lengths")
    # At most four kinds for each doubling of the length.
    kinds = lengths.groupBy("kind").agg(F.count("*").alias("n"), F.sum("length").alias("words")).collect()
    sizes = {r["kind"]: r["n"] for r in kinds}
    # Parts of so many words, as a task's counts would else take more memory the more texts there are.
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-sum(r["words"] for r in kinds) // PART_WORDS))
    segments = F.create_map(*[F.lit(x).cast("long") for k, n in sorted(sizes.items() or [(0, 1)]) for x in (k, -(-n // BLOCK))])
    # Texts are shuffled once, by segment: a segment's words are then counted and gathered where its documents are.
    segment = F.lit(added << 48) + kind * F.lit(1 << 40) + F.pmod(F.xxhash64("doc_id"), segments[kind])
    d = d.withColumn("segment", segment).repartition(parts, "segment")
    words = d.select("segment", "doc_id", "length", F.explode(T.matches(F.col("low"), WORD)).alias("tok"))
    counts = words.groupBy("segment", "tok", "doc_id", "length").agg(F.count("*").cast("int").alias("tf"))
    # What goes to the buckets is the documents, and a number of each with its count and length; the bounds are made there.
    pair = F.shiftleft(F.col("tf").cast("long"), 32).bitwiseOR(F.col("length").cast("long"))
    packed = counts.groupBy("segment", "tok").agg(F.sort_array(F.collect_list(F.struct("doc_id", pair.alias("pair")))).alias("p"))
    packed = packed.select("tok", "segment", F.col("p.doc_id").alias("docs"), F.col("p.pair").alias("pairs"), _bucket(F.col("tok")).alias("bucket")).hint("rebalance", "bucket")
    tfs = F.transform("pairs", lambda x: F.shiftright(x, 32).cast("int"))
    lengths_of = F.transform("pairs", lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))
    blocks = packed.select("tok", "segment", "docs", tfs.alias("tfs"), lengths_of.alias("lengths"), "bucket").select(
        "tok", "segment", "docs", "tfs", "lengths", F.size("docs").cast("long").alias("n"), F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x).alias("occurrences"),
        F.array_max("tfs").alias("max_tf"), F.array_min("lengths").alias("min_length"), "bucket")
    # Large buckets are split and small ones put together by size; files of a bucket are sorted by token.
    blocks.sortWithinPartitions("bucket", "tok", "segment").write.mode("append").partitionBy("bucket").parquet(f"{path}/blocks")
    lengths.filter("length > 0").select("doc_id", "length", F.lit(added).alias("added")).write.mode("append").parquet(f"{path}/lengths")
    return index


def _norm(tf: Column, length: Column, mean: float, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def _postings(blocks: DataFrame, *more: str) -> DataFrame:
    return blocks.select(*more, F.explode(F.arrays_zip("docs", "tfs", "lengths")).alias("p")).select(
        *more, F.col("p.docs").alias("doc_id"), F.col("p.tfs").alias("tf"), F.col("p.lengths").alias("length"))


def _k_th(scored: DataFrame, k: int) -> DataFrame:
    """(item_id, least): the k-th largest score of each item that has so many."""
    w = Window.partitionBy("item_id").orderBy(F.col("score").desc())
    return scored.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == k).select("item_id", F.col("score").alias("least"))


@dataclass
class Plan:
    """What a search reads: terms with their bounds, thresholds and whether they decide; the blocks that may matter."""

    terms: DataFrame
    candidates: DataFrame
    mean: float
    marked: Callable[[DataFrame], DataFrame]


def plan_search(index: Index, terms: DataFrame, top: int, k1: float = 1.2, b: float = 0.75, seed: int = 4) -> Plan:
    """terms: (item_id, tok), a few distinct tokens an item. Its candidates are (item_id, tok, segment, …) of blocks to score."""
    stats = index.lengths().agg(F.avg("length").alias("mean"), F.count("*").alias("n")).first()
    n, mean = stats["n"], stats["mean"] or 1.0
    terms = materialize(terms.withColumn("bucket", _bucket(F.col("tok"))), "asked")
    # Tables made of terms alone have no more rows than these: where they are few, each is broadcast without a count of its own.
    marked = F.broadcast if terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small
    asked = marked(terms.select("bucket", "tok").distinct())
    # Only the bounds of the blocks are read here, and only in the buckets of the tokens asked for.
    bounds = index.blocks().select("bucket", "tok", "segment", "n", "max_tf", "min_length").join(asked, ["bucket", "tok"], "left_semi")
    bounds = materialize(bounds, "bounds")
    per = bounds.groupBy("bucket", "tok").agg(F.sum("n").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_length").alias("min_length"))
    idf = F.greatest(F.lit(1e-6), F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    most = idf * _norm(F.col("max_tf"), F.col("min_length"), mean, k1, b)
    terms = terms.join(per.select("bucket", "tok", "df", idf.alias("idf"), most.alias("most")), ["bucket", "tok"])
    down = Window.partitionBy("item_id").orderBy(F.col("most").desc(), "tok").rowsBetween(Window.unboundedPreceding, -1)
    up = Window.partitionBy("item_id").orderBy("most", F.col("tok").desc()).rowsBetween(Window.unboundedPreceding, 0)
    terms = terms.withColumn("before", F.coalesce(F.sum("df").over(down), F.lit(0))).withColumn("upto", F.sum("most").over(up))
    terms = materialize(terms, "terms")
    share = (F.col("idf") * _norm(F.col("tf"), F.col("length"), mean, k1, b)).alias("share")
    rare = marked(terms.filter(F.col("before") < seed * top).select("bucket", "tok", "item_id", "idf"))
    seeds = _postings(index.blocks().join(rare, ["bucket", "tok"]), "item_id", "idf").select("item_id", "doc_id", share)
    least = _k_th(seeds.groupBy("item_id", "doc_id").agg(F.sum("share").alias("score")), top)
    terms = terms.join(least, "item_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)) - SLACK)
    terms = materialize(terms.withColumn("decides", F.col("upto") >= F.col("least")), "terms")
    # Segments: the blocks of the deciding tokens together with all that the others may add.
    deciding = marked(terms.filter("decides").select("bucket", "tok", "item_id", "idf", "least"))
    others = terms.groupBy("item_id").agg(F.sum(F.when(~F.col("decides"), F.col("most")).otherwise(0.0)).alias("others"))
    reach = bounds.join(deciding, ["bucket", "tok"]).groupBy("item_id", "segment").agg(
        F.sum(F.col("idf") * _norm(F.col("max_tf"), F.col("min_length"), mean, k1, b)).alias("reach"), F.max("least").alias("least"))
    reach = reach.join(marked(others), "item_id").filter(F.col("reach") + F.col("others") >= F.col("least")).select("item_id", "segment", "others")
    found = index.blocks().join(deciding, ["bucket", "tok"]).join(reach, ["item_id", "segment"])
    return Plan(terms, found, mean, marked)


def search(index: Index, terms: DataFrame, top: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(item_id, doc_id, score, rank): the best top documents for each item of terms (item_id, tok) by BM25, ties by doc_id."""
    plan = plan_search(index, terms, top, k1, b)
    share = (F.col("idf") * _norm(F.col("tf"), F.col("length"), plan.mean, k1, b)).alias("share")
    partial = _postings(plan.candidates, "item_id", "segment", "idf", "least", "others").select("item_id", "segment", "doc_id", "least", "others", share)
    partial = partial.groupBy("item_id", "segment", "doc_id", "least", "others").agg(F.sum("share").alias("score"))
    # A second threshold, by all deciding tokens, before the rest is looked up.
    partial = materialize(partial.filter(F.col("score") + F.col("others") >= F.col("least")), "partial")
    again = _k_th(partial, top).withColumnRenamed("least", "more")
    left = partial.join(plan.marked(again), "item_id", "left").filter(F.col("score") + F.col("others") >= F.greatest("least", F.coalesce("more", F.lit(0.0)) - SLACK))
    rest = plan.terms.filter(~F.col("decides")).select("item_id", "bucket", "tok", "idf")
    left = materialize(left, "left")
    asked = small(left.select("item_id", "segment", "doc_id").join(plan.marked(rest), "item_id"))
    held = index.blocks().select("bucket", "tok", "segment", "docs", "tfs", "lengths").join(plan.marked(rest.select("bucket", "tok").distinct()), ["bucket", "tok"], "left_semi")
    at = F.array_position("docs", F.col("doc_id")).cast("int")
    more = asked.join(held, ["bucket", "tok", "segment"]).withColumn("at", at).filter("at > 0").select(
        "item_id", "doc_id", F.element_at("tfs", F.col("at")).alias("tf"), F.element_at("lengths", F.col("at")).alias("length"), "idf")
    every = left.select("item_id", "doc_id", F.col("score").alias("share")).unionByName(more.select("item_id", "doc_id", share))
    scored = every.groupBy("item_id", "doc_id").agg(F.round(F.sum("share"), 6).alias("score"))
    w = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)

