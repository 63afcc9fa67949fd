"""Line dedup by a suffix array over line identities, in DataFrame functions.

A document is the sequence of the identities of its lines with words. Distributed prefix doubling ranks all suffixes by
their first 1, 2, 4, ... lines. Ranks are true suffix-array places (how many suffixes sort before), so suffixes that
share a rank are an interval of the array whose common prefix is at least so many lines long. The interval at the depth
where a suffix reaches min_words words holds all copies of that run; its earliest member stays, the others are deleted.
Common lines and passages are hot keys: their rows are joined in place (join_hot), and running sums go by blocks. Only rows (document, line number, numbers) are shuffled until the last join, never lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, WORD, join_hot, materialize, others, pack, unpack

#: Blocks that a running sum over many rows is taken in: the sums of the blocks first, then within each.
BLOCKS = 256


def _first_ranks(lines: DataFrame) -> DataFrame:
    """(h, g, r, n) of line identities (h, g) that occur n times, twice or more: r is how many lines sort before."""
    each = lines.groupBy("h", "g").agg(F.count("*").alias("n")).filter("n > 1")
    each = each.withColumn("bucket", F.expr(f"shiftrightunsigned(h, {64 - 12})").cast("int"))
    sums = each.groupBy("bucket").agg(F.sum("n").alias("s"))
    sums = sums.withColumn("base", F.sum("s").over(Window.orderBy("bucket")) - F.col("s")).select("bucket", "base")
    within = Window.partitionBy("bucket").orderBy("h", "g").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("to", F.sum("n").over(within)).join(F.broadcast(sums), "bucket")
    return placed.select("h", "g", (F.col("base") + F.col("to") - F.col("n")).alias("r"), "n")


def _double(ranks: DataFrame, step: int, most: int) -> DataFrame:
    """From (d, i, r) at depth step to depth 2 * step; suffixes that are alone at a depth go. Ranks are under most."""
    at = Window.partitionBy("d").orderBy("i").rangeBetween(step, step)
    pairs = materialize(ranks.withColumn("r2", F.max("r").over(at)).filter("r2 is not null"), "rank-pairs")
    counts = pairs.groupBy("r", "r2").agg(F.count("*").alias("n")).withColumn("b", F.floor(F.col("r2") * BLOCKS / most))
    counts = materialize(counts, "rank-counts")
    # A common line may have any number of successors: their running sum goes by blocks of r2.
    sums = counts.groupBy("r", "b").agg(F.sum("n").alias("s"))
    sums = sums.withColumn("base", F.sum("s").over(Window.partitionBy("r").orderBy("b")) - F.col("s")).select("r", "b", "base")
    within = Window.partitionBy("r", "b").orderBy("r2").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("to", F.sum("n").over(within)).join(sums, ["r", "b"]).filter("n > 1")
    placed = placed.select("r", "r2", (F.col("r") + F.col("base") + F.col("to") - F.col("n")).alias("r3"))
    joined = join_hot(pairs, placed, ["r", "r2"], counts, counts.agg(F.sum("n")).first()[0] or 0)
    return materialize(joined.select("d", "i", F.col("r3").alias("r")), "ranks")


def repeated_runs(docs: DataFrame, min_words: int = 50, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, _h, removed): per document with later copies, the merged ranges (from, to) of line numbers, from 0, to delete."""
    split = docs.select(F.col(key), F.xxhash64(text).alias("_h"), F.split(text, "\n", -1).alias("_l"))
    one = split.select(key, "_h", F.posexplode("_l").alias("no", "l"))
    one = one.withColumn("l", F.btrim("l", F.lit(BLANKS))).filter("l <> ''")
    one = one.select(
        F.struct(F.col(key).alias("k"), F.col("_h").alias("h")).alias("d"), "no", F.xxhash64("l").alias("h"), F.hash("l").alias("g"),
        F.regexp_count("l", F.lit(WORD)).cast("long").alias("w"))
    lines = materialize(one.dropDuplicates(["d", "no"]), "lines")
    known = materialize(_first_ranks(lines), "line-ranks")
    repeated = known.agg(F.sum("n")).first()[0] or 0

    # Numbers among the lines with words, and words before each: over whole documents, then only repeated lines go on.
    of = Window.partitionBy("d").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    counted = lines.withColumn("i", F.count("*").over(of)).withColumn("e", F.sum("w").over(of))
    met = join_hot(counted, known.drop("n"), ["h", "g"], known, repeated)
    rows = materialize(met.select("d", "no", "i", "w", "e", (F.col("e") - F.col("w")).alias("p"), "r"), "line-rows")

    # The shortest runs of min_words words that begin at a line, and that end at one: together they cover every longer run.
    ahead = Window.partitionBy("d").orderBy("p").rangeBetween(0, min_words - 1)
    back = Window.partitionBy("d").orderBy("e").rangeBetween(1 - min_words, 0)

    def runs(frame: Window) -> DataFrame:
        out = rows.select(
            "d", F.min("i").over(frame).alias("i"), F.max("i").over(frame).alias("j"), F.min("no").over(frame).alias("from"),
            F.max("no").over(frame).alias("to"), F.count("*").over(frame).alias("m"), F.sum("w").over(frame).alias("words"))
        return out.filter((F.col("words") >= min_words) & (F.col("j") - F.col("i") + 1 == F.col("m"))).drop("words")

    runs_ = materialize(runs(ahead).unionByName(runs(back)).distinct(), "runs")
    longest = runs_.agg(F.max("m")).first()[0] or 0
    level = rows.select("d", "i", "r")
    step, later = 1, None
    while step <= longest:
        here = runs_.filter((F.col("m") >= step) & (F.col("m") < 2 * step))
        # Depth m is covered by two ranks of depth step.
        a, b = level.select("d", "i", F.col("r").alias("ra")), level.select("d", F.col("i").alias("_i"), F.col("r").alias("rb"))
        here = here.join(a, ["d", "i"]).withColumn("_i", F.col("i") + F.col("m") - step)
        here = materialize(here.join(b, ["d", "_i"]).select("d", "i", "from", "to", "m", "ra", "rb"), "intervals")
        first = here.groupBy("m", "ra", "rb").agg(F.min(F.struct("d", "i")).alias("first"), F.count("*").alias("n")).filter("n > 1")
        first = materialize(first, "first-copies")
        copies = join_hot(here, first.drop("n"), ["m", "ra", "rb"], first, first.agg(F.sum("n")).first()[0] or 0)
        # A run of like lines overlaps itself: what is part of the copy that stays is no copy.
        apart = (F.col("d") != F.col("first.d")) | (F.col("i") >= F.col("first.i") + F.col("m"))
        copies = copies.filter((F.struct("d", "i") > F.col("first")) & apart).select("d", "from", "to")
        later = copies if later is None else later.unionByName(copies)
        if 2 * step <= longest:
            level = _double(level, step, max(1, repeated))
        step *= 2
    if later is None:
        later = runs_.select("d", "from", "to")

    # Union of the ranges.
    order = Window.partitionBy("d").orderBy("from", "to")
    known_to = F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = later.withColumn("opens", F.when(F.col("from") <= known_to + 1, 0).otherwise(1))
    marked = marked.withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = marked.groupBy("d", "run").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    return merged.groupBy("d").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("removed")).select(
        F.col("d.k").alias(key), F.col("d.h").alias("_h"), "removed")


def _kept_lines(lines: Column, removed: Column) -> Column:
    """Lines outside the ranges, which are ascending and apart."""
    n = F.size(removed)
    gaps = F.transform(F.sequence(F.lit(0), n), lambda k: F.struct(
        F.when(k == 0, 0).otherwise(F.get(removed, k - 1)["to"] + 1).alias("a"), F.when(k == n, F.size(lines)).otherwise(F.get(removed, k)["from"]).alias("b")))
    return F.flatten(F.transform(gaps, lambda g: F.slice(lines, g["a"] + 1, F.greatest(g["b"] - g["a"], F.lit(0)))))


def line_dedup(docs: DataFrame, min_words: int = 50, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with removed (ranges of deleted line numbers) and the text without them.

    A run of consecutive lines with min_words words or more that occurs before, in the order of key and line, is a later
    copy and is deleted; lines without words inside it go too, and between runs do not count as lines. A later copy
    that overlaps the first in the same document is not one: of a line said over and over, the first lines that make
    min_words words stay. Lines compare without blanks at their ends, by 96 bits of two hashes. Rows that agree in key and
    text are one document. Null and empty texts stay as they are, and an empty table gives an empty result; a text all
    of whose lines are later copies becomes empty. A column removed of docs is replaced.
    """
    # The texts are shuffled here, once.
    found = repeated_runs(docs, min_words, text, key).select(F.col(key).alias("_k"), F.col("_h").alias("_g"), "removed").hint("merge")
    packed = pack(docs, key, text)
    out = packed.join(found, packed[key].eqNullSafe(F.col("_k")) & (F.xxhash64(packed[text]) == F.col("_g")), "left")
    rest = F.array_join(_kept_lines(F.split(text, "\n", -1), F.col("removed")), "\n")
    columns = [*others(docs.columns, "removed"), "removed"]
    done = unpack(out, docs.columns, removed=F.col("removed"), **{text: F.when(F.col("removed").isNotNull(), rest).otherwise(F.col(text))})
    return done.select(*columns)
