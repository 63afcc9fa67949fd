"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions.

Only rows (source, size, odds) are worked on, pre-aggregated by source, and never the texts. A hot source is never gathered in
one task: its cut-off is found by three histograms of 256 cells of the order variable, each inside the cell of the one before
that holds the cut-off, so that one of 16.8 million parts of a source is left to be sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, join_hot, materialize, pack, unpack

CYCLE = (5, 2, 1)
CELLS, DEPTH = 256, 3
#: Sources up to which the tables with one row a source are broadcast.
BROADCAST_SOURCES = 200_000


def _uniform(key: Column, seed: int) -> Column:
    """A reproducible number in (0, 1) for a document."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = CYCLE) -> DataFrame:
    """(source, source_size, target) for rows (source, size).

    Sources by code point, null last, weigh as weights say, repeating. They split share times all words by weight; what
    a source would get above most times its size goes to the others by weight until none is above. Sources may be many:
    they are numbered by a range partitioning, and each round of the split is one sum over them.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = materialize(s.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()), "mix-ordered")
    # As many rows as there were partitions.
    parts = s.groupBy("_part").agg(F.count("*").alias("_rows"))
    parts = parts.withColumn("_base", F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).drop("_rows")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last()))
    s = s.withColumn("_n", within).join(F.broadcast(parts), "_part").withColumn("_n", F.col("_base") + F.col("_n"))
    pick = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("_n") - 1) % len(weights) + 1).cast("int"))
    s = materialize(s.select("source", "source_size", pick.alias("_w"), (F.col("source_size") * most).alias("_cap")), "mix-weighed")

    words, weight = s.agg(F.sum("source_size"), F.sum("_w")).first()
    rate, capped = 0.0, 0
    while words:
        # The rate only rises, and with it the sources that stop at their cap, until no more do.
        over = s.filter(F.col("_cap") <= rate * F.col("_w")).agg(F.count("*"), F.sum("_cap"), F.sum("_w")).first()
        if over[0] == capped and rate > 0 or over[2] == weight:
            break
        capped, rate = over[0], (words * share - (over[1] or 0.0)) / (weight - (over[2] or 0.0))
    target = F.least(F.col("_cap"), rate * F.col("_w"))
    return s.select("source", "source_size", F.round(target, 6).alias("target"))


def _name(source: Column) -> Column:
    """The source as a string that is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _level(size: Column) -> Column:
    """Binary digits of the size: the weight of a document's inclusion; few values, so that sources reduce to short tables."""
    return F.length(F.bin(size)).cast("double")


def mix(docs: DataFrame, seed: int = 7, share: float = 1.5, most: float = 2.0, text: str = "text") -> DataFrame:
    """docs with size, source_size, target, copies and taken (words that the mix takes: copies times size).

    A document's expected copies are in proportion to the binary digits of its size, most at the most, and sum to its
    source's target in words. Their whole part is certain. The fraction is drawn by Pareto order sampling: documents in
    the order of their random odds divided by their inclusion odds, up to the target. Draws hang on doc_id and seed
    alone, so reruns agree; doc_id may be of any type, and null. Null texts have size 0 and a null source is a source of its own. Rows that agree in doc_id
    and size are drawn alike. Empty tables give empty results. Added columns replace columns of docs of the same name.
    """
    size = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    drawn = pack(docs, "doc_id", "source", text).withColumn("size", size).drop(text)
    key = F.struct("doc_id", F.col("size").alias("s"))
    rows = materialize(drawn.select("source", "size", "doc_id"), "mix-sizes")
    targets = source_targets(rows, share, most)

    # At most 64 rows a source.
    levels = rows.groupBy("source", _level(F.col("size")).alias("_l")).agg(F.sum("size").alias("_s"), F.count("*").alias("n"))
    per = levels.join(targets.select(F.col("source").alias("_src"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_src"))).drop("_src")
    of = Window.partitionBy("source")
    higher = of.orderBy(F.col("_l").desc()).rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.sum("_s").over(higher), F.lit(0))
    left = F.sum(F.col("_s") * F.col("_l")).over(of) - F.coalesce(F.sum(F.col("_s") * F.col("_l")).over(higher), F.lit(0.0))
    per = per.withColumn("_c", F.when(left > 0, (F.col("target") - most * done) / left))
    sources = materialize(
        per.groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"),
                                  F.coalesce(F.max("_c"), F.lit(0.0)).alias("_c"), F.sum("n").alias("n")).withColumn("_src", _name(F.col("source"))), "mix-sources")
    few = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    total = sources.agg(F.sum("n")).first()[0] or 0

    def to_sources(df: DataFrame, s: DataFrame) -> DataFrame:
        """df with the columns of s, which has one row for each source; a hot source's rows stay where they are."""
        return df.join(F.broadcast(s), "_src") if few else join_hot(df, s, ["_src"], sources.select("_src", "n"), total)

    def completed(s: DataFrame) -> DataFrame:
        """s with rows of nulls for the sources that it lacks."""
        return sources.select("_src").join(s, "_src", "left")

    def with_odds(df: DataFrame) -> DataFrame:
        df = df.withColumn("_e", F.round(F.least(F.lit(float(most)), F.col("_c") * _level(F.col("size"))), 9))
        df = df.withColumn("_base", F.floor("_e").cast("long")).withColumn("_p", F.col("_e") - F.col("_base"))
        u = _uniform(F.col("doc_id"), seed)
        return df.withColumn("_q", F.when(F.col("_p") > 0, (u / (1 - u)) / (F.col("_p") / (1 - F.col("_p")))))

    odds = with_odds(to_sources(rows.withColumn("_src", _name(F.col("source"))), sources.select("_src", "_c")))
    odds = materialize(odds.select("_src", "size", "doc_id", "_base", "_q"), "mix-odds")
    of = Window.partitionBy("_src")
    certain = odds.groupBy("_src").agg(F.sum(F.col("size") * F.col("_base")).alias("_certain"))
    # _room: words that are left for the drawn. The cell in which they run out holds the cut-off; sources without one take all.
    edge = sources.join(certain, "_src").select("_src", (F.col("target") - F.col("_certain")).alias("_room"))
    place = F.col("_q") / (1 + F.col("_q"))
    at_edge = odds.filter("_q is not null").withColumn("_x", place).drop("_base")
    edge = materialize(edge.withColumn("_low", F.lit(0.0)), "mix-edges")
    for depth in range(1, DEPTH + 1):
        width = float(CELLS) ** -depth
        met = to_sources(at_edge, edge).filter((F.col("_x") >= F.col("_low")) & (F.col("_x") < F.col("_low") + width * CELLS))
        cells = met.groupBy("_src", F.floor(F.col("_x") / width).alias("_cell")).agg(F.sum("size").alias("_s"), F.first("_room").alias("_room"))
        up_to = of.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
        cells = cells.withColumn("_to", F.sum("_s").over(up_to)).filter(F.col("_to") > F.col("_room"))
        edge = cells.groupBy("_src").agg(F.min_by(F.struct(
            (F.col("_cell") * width).alias("low"), (F.col("_room") - F.col("_to") + F.col("_s")).alias("room")), "_cell").alias("_e"))
        edge = materialize(completed(edge.select("_src", F.col("_e.low").alias("_low"), F.col("_e.room").alias("_room"))), "mix-edges")

    last = to_sources(at_edge, edge).filter((F.col("_x") >= F.col("_low")) & (F.col("_x") < F.col("_low") + float(CELLS) ** -DEPTH))
    through = of.orderBy("_q", key).rowsBetween(Window.unboundedPreceding, 0)
    cut = last.withColumn("_to", F.sum("size").over(through)).filter(F.col("_to") - F.col("size") / 2 <= F.col("_room"))
    cut = cut.groupBy("_src").agg(F.max(F.struct(F.col("_q"), key.alias("k"))).alias("_cut"))
    final = sources.drop("source", "n").join(edge.select("_src", "_low"), "_src").join(completed(cut), "_src")
    final = materialize(final, "mix-cuts")

    out = with_odds(to_sources(drawn.withColumn("_src", _name(F.col("source"))), final)).withColumn("_x", place)
    chosen = F.col("_low").isNull() | (F.col("_x") < F.col("_low")) | F.coalesce(F.struct(F.col("_q"), key.alias("k")) <= F.col("_cut"), F.lit(False))
    copies = F.col("_base") + F.when(F.col("_p") > 0, chosen.cast("long")).otherwise(0)
    return unpack(out, docs.columns, size=F.col("size"), source_size=F.col("source_size"), target=F.col("target"), copies=copies, taken=copies * F.col("size"))
