"""Connected components of a table of edges, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node that an edge to another node touches; root is the same for all of a component.

    Rounds: each node points at the smallest of itself and its neighbours, pointers are followed to their ends, and the
    edges move to the nodes pointed at; those within one node vanish. Every round's tables are written, so a lost
    executor costs one round. Sums go by node with partial aggregation, and joins on a node that very many edges or
    pointers share are made where those rows are (join_hot), so a hub is never gathered. The nodes left at least halve
    from round to round.
    """
    now = materialize(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct(), "edges")
    rounds: list[DataFrame] = []

    def lookup(left: DataFrame, key: str, right: DataFrame, written: DataFrame | None = None) -> DataFrame:
        """left.join(right, key); written is a table with left's keys, where left itself isn't one."""
        written = left if written is None else written
        return join_hot(left, right, [key], written.groupBy(key).agg(F.count("*").alias("n")), written.count())

    while now.limit(1).count():
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "pointers")
        while True:
            step = up.select(F.col("u").alias("m"), F.col("m").alias("m2"))
            far = materialize(lookup(up, "m", step).select("u", F.col("m2").alias("m"), (F.col("m2") != F.col("m")).alias("moved")), "pointers")
            up = far.select("u", "m")
            if not far.filter("moved").limit(1).count():
                break
        rounds.append(up)
        left = lookup(now, "u", up).select(F.col("m").alias("a"), "v")
        moved = lookup(left, "v", up.select(F.col("u").alias("v"), F.col("m").alias("b")), now).select(
            F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
        now = materialize(moved.filter("u <> v").distinct(), "edges")
    if not rounds:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = rounds[0].select(F.col("u").alias("node"), F.col("m").alias("root"))
    for up in rounds[1:]:
        # A root of one round may be no node of the next.
        next_ = up.select(F.col("u").alias("root"), F.col("m").alias("to")).unionByName(
            out.select("root").distinct().join(up.select(F.col("u").alias("root")), "root", "left_anti").withColumn("to", F.col("root")))
        out = materialize(lookup(out, "root", next_).select("node", F.col("to").alias("root")), "roots")
    return out
