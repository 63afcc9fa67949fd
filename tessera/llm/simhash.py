"""SimHash near-duplicates by tiled exact comparison.

Fingerprints that differ in at most three of 64 bits agree in one of four parts of 16 bits, in two of five parts, and in three of six.
Each distinct fingerprint goes to one tile for each part, or each choice of parts, by the leading bits of what must agree: as many
bits as keep tiles near a set size, so the comparisons grow in proportion to the input. Four parts do up to 134 million
fingerprints, more take longer keys. Within a tile all pairs are compared by exclusive-or and bit counts in
numpy, block by block, and blocks whose population counts differ beyond the radius are skipped. A tile that grew too
large, because one part is common, is compared as pairs of sub-tiles in separate tasks. A task returns a spanning
forest of the links it found, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, join_hot, materialize
from .components import connected_components

#: Tiles too large for a task, up to which their list is broadcast.
LARGE_TILES = 200_000
#: Fingerprints that a tile is meant to hold, and the most that one task compares with each other.
TILE, MOST = 2048, 4096
BLOCK = 512


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint of a text: a bit is set if over half of its shingles' XXH64 (seed 42) have it."""
    words = (text or "").encode().lower().split()  # folds A-Z only, splits at ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    digest = xxhash.xxh64_digest
    if len(words) < shingle:
        raw = digest(joined, 42)
    else:
        raw = b"".join([digest(joined[a : b - 1], 42) for a, b in zip([0, *ends], ends[shingle - 1 :], strict=False)])
    n = len(raw) // 8
    counts = np.zeros(64, np.int64)
    bits = np.frombuffer(raw, np.uint8).reshape(n, 8)
    for at in range(0, n, 4096):
        counts += np.unpackbits(bits[at : at + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3) -> DataFrame:
    """(key, fp) for each row of docs; fp is the fingerprint as a signed 64-bit number. A null text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], [key, "fp"])

    bounded_batches(docs.sparkSession)
    return docs.select(key, text).mapInArrow(run, T.StructType([docs.schema[key], T.StructField("fp", T.LongType())]))


def _links(left: np.ndarray, right: np.ndarray | None, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and column numbers of linked pairs, block by block; within left alone where right is None."""
    counts = np.bitwise_count(left).astype(np.int16)
    other = left if right is None else right
    other_counts = counts if right is None else np.bitwise_count(right).astype(np.int16)
    for i in range(0, len(left), BLOCK):
        rows = left[i : i + BLOCK]
        for j in range(i if right is None else 0, len(other), BLOCK):
            # Both sides are in the order of their population counts.
            ahead = int(other_counts[j]) - int(counts[min(i + BLOCK, len(left)) - 1])
            behind = int(counts[i]) - int(other_counts[min(j + BLOCK, len(other)) - 1])
            if ahead > radius:
                break
            if behind > radius:
                continue
            near = np.bitwise_count(rows[:, None] ^ other[None, j : j + BLOCK]) <= radius
            a, b = np.nonzero(near)
            keep = a + i < b + j if right is None else slice(None)
            yield a[keep] + i, b[keep] + j


def _forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for the nodes that are not their component's root, from links taken a block at a time."""
    root = np.arange(n)
    for a, b in links:
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            high, low = np.maximum(x, y), np.minimum(x, y)
            np.minimum.at(root, high, low)
            while True:  # point every node at its root again
                up = root[root]
                if (up == root).all():
                    break
                root = up
    node = np.flatnonzero(root != np.arange(n))
    return node, root[node]


def _ordered(fps: np.ndarray) -> np.ndarray:
    return fps[np.lexsort((fps, np.bitwise_count(fps)))]


def _compare_tile(tile: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Edges (a, b) of a spanning forest. side 0 and 1: only pairs across; side 0 alone: all pairs."""
    fps, side = tile["fp"].to_numpy().view(np.uint64), tile["side"].to_numpy()
    left, right = _ordered(fps[side == 0]), _ordered(fps[side == 1])
    if len(right):
        every = np.concatenate((left, right))
        links = ((a, b + len(left)) for a, b in _links(left, right, radius))
    else:
        every, links = left, _links(left, None, radius)
    node, root = _forest(len(every), links)
    return pd.DataFrame({"a": every[node].view(np.int64), "b": every[root].view(np.int64)})


def tile_keys(n: int, radius: int) -> tuple[list[list[tuple[int, int]]], int]:
    """For n fingerprints: the keys, each a choice of parts (lowest bit, bits), and the leading bits of a key to use.

    Of radius + k parts at least k agree in a linked pair; k is the least whose keys are long enough for n. With no bits
    to use there is one tile, which holds all.
    """
    need = max(0, math.ceil(math.log2(max(1, n) / TILE)))
    if need == 0:
        return [[(0, 0)]], 0
    for agree in (1, 2, 3):
        parts = radius + agree
        edges = [64 * k // parts for k in range(parts + 1)]
        chosen = [list(c) for c in combinations([(a, b - a) for a, b in zip(edges, edges[1:], strict=False)], agree)]
        least = min(sum(width for _, width in c) for c in chosen)
        if need <= least:
            break
    return chosen, min(need, least)


def near_links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs within the radius (under 16), for distinct rows (fp)."""
    if radius > 15:
        raise ValueError("equal parts are no help beyond 15 bits")
    keys, bits = tile_keys(distinct.count(), radius)

    def value(parts: list[tuple[int, int]]) -> str:
        whole, text = 0, "0L"
        for low, width in parts:
            text = f"(shiftleft({text}, {width}) | (shiftrightunsigned(fp, {low}) & {(1 << width) - 1}L))"
            whole += width
        return f"shiftright({text}, {whole - bits})"

    part = F.explode(F.array(*[F.struct(F.lit(k).alias("part"), F.expr(value(parts)).alias("value")) for k, parts in enumerate(keys)])).alias("x")
    rows = distinct.select("fp", part).select("fp", "x.part", "x.value")
    sizes = materialize(rows.groupBy("part", "value").agg(F.count("*").alias("n")), "tile-sizes")
    large = sizes.filter(F.col("n") > MOST)
    n_large = large.limit(LARGE_TILES + 1).count()
    plain = rows
    if n_large:
        listed = F.broadcast(large) if n_large <= LARGE_TILES else large
        plain = rows.join(listed, ["part", "value"], "left_anti")
    tiles = plain.select("part", "value", F.lit(0).alias("x"), F.lit(0).alias("y"), "fp", F.lit(0).alias("side"))
    if n_large:
        # Sub-tiles: by population count, and where still too many by a hash.
        rows = rows.join(listed.drop("n"), ["part", "value"]).withColumn("pop", F.bit_count("fp"))
        cells = rows.groupBy("part", "value", "pop").agg(F.count("*").alias("n")).withColumn("m", F.ceil(F.col("n") / (MOST // 2)).cast("int"))
        cells = materialize(cells, "tile-cells")
        # The sub-tiles that a sub-tile is held against, one short row for each population count of a tile.
        beside = cells.select("part", "value", F.col("pop").alias("pop2"), F.col("m").alias("m2"))
        beside = cells.join(beside, ["part", "value"]).filter(F.abs(F.col("pop") - F.col("pop2")) <= radius).groupBy("part", "value", "pop", "m").agg(
            F.collect_list(F.struct("pop2", "m2")).alias("beside"))
        near = join_hot(rows, beside, ["part", "value", "pop"], cells, cells.agg(F.sum("n")).first()[0])
        near = near.withColumn("sub", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int")).withColumn("s", F.explode("beside"))
        near = near.withColumn("sub2", F.explode(F.sequence(F.lit(0), F.col("s.m2") - 1)))
        own, its = F.col("pop") * 65536 + F.col("sub"), F.col("s.pop2") * 65536 + F.col("sub2")
        tiles = tiles.unionByName(near.select(
            "part", "value", F.least(own, its).alias("x"), F.greatest(own, its).alias("y"), "fp", (own > its).cast("int").alias("side")))

    return tiles.groupBy("part", "value", "x", "y").applyInPandas(lambda tile: _compare_tile(tile, radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 3, text: str = "text", key: str = "doc_id", shingle: int = 3) -> DataFrame:
    """(key, fp, component_id) for each row of docs: component_id is the smallest key of all documents that links reach.

    Fingerprints within the radius (under 16) are linked. Texts without a word have fingerprint zero and link like any other. Rows of
    equal texts have equal fingerprints and are one node. Null keys count only where a component has no other. Other
    columns are left out. An empty table gives an empty result. Near copies at a similarity of shingles, which differ
    in more bits, are the business of simhash_similar.
    """
    each = materialize(fingerprints(docs, text, key, shingle), "fingerprints")
    nodes = materialize(each.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("n")), "fingerprint-nodes")
    edges = near_links(nodes.select("fp"), radius)
    roots = connected_components(edges)
    joined = materialize(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "fingerprint-roots")
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = materialize(joined.join(least, "root").select("fp", "component_id", "n"), "fingerprint-components")
    out = join_hot(each, by_fp.drop("n"), ["fp"], by_fp, by_fp.agg(F.sum("n")).first()[0] or 0)
    return out.select(key, "fp", "component_id")
