"""SimHash near-duplicates at a Jaccard similarity of word shingles.

At a similarity of 0.8 two fingerprints differ in about ten of 64 bits, which no blocking by equal parts reaches.
Fingerprints are therefore dealt to tiles by minima: a set of shingles has BANDS keys, each of ROWS minima under different hashes, and sets
that share a key are joined to the least set of the key, so a key of any size costs one row a set. A pair of similarity 0.8
shares no key with a probability of (1 - 0.8**4)**28 = 4e-7, a nearer one with less. Within a tile all fingerprints are compared by
exclusive-or and bit counts, in blocks, those skipped whose population counts differ beyond the radius. Pairs within it and
not yet in one component are links if their sets' exact similarity says so.

A group of tiles that one task can't hold is compared as pairs of cells, so its cost grows with the square of the
different near copies that hang together (exact copies are one node, at any number).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, join_hot, materialize
from .components import connected_components
from .simhash import _links

BANDS, ROWS = 28, 4
#: Shingles that a task's sets are meant to have together, and the most of a group that one task compares.
TILE, MOST = 1 << 20, 1 << 22
CHUNK = 2048

_RNG = np.random.default_rng(11)
_XOR = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)
_ODD = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
_MIX = _RNG.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) | np.uint64(1)


def shingles(text: str | None, length: int = 5) -> np.ndarray:
    """The distinct XXH64 of a text's runs of length words, in order; of all its words where it has fewer."""
    words = (text or "").encode().lower().split()  # folds A-Z only, splits at ASCII blanks only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) < length:
        raw = digest(joined, 42)
    else:
        ends = list(accumulate((len(w) + 1 for w in words)))
        raw = b"".join([digest(joined[a : b - 1], 42) for a, b in zip([0, *ends], ends[length - 1 :], strict=False)])
    return np.unique(np.frombuffer(raw, np.uint64))


def node_of(shingle_set: np.ndarray) -> int:
    """A signed 64-bit number for the set."""
    return int(np.array([xxhash.xxh64_intdigest(shingle_set.tobytes(), 7)], np.uint64).view(np.int64)[0])


def band_keys(shingle_set: np.ndarray) -> np.ndarray:
    """The keys of a set that isn't empty."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(shingle_set), CHUNK):
        np.minimum(least, ((shingle_set[None, at : at + CHUNK] ^ _XOR) * _ODD).min(axis=1), out=least)
    mixed = (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64) ^ np.arange(BANDS, dtype=np.uint64)
    return mixed.view(np.int64)


def fingerprint_of(shingle_set: np.ndarray) -> int:
    """A bit is set if over half of the set's hashes have it."""
    counts = np.zeros(64, np.int64)
    bits = shingle_set.view(np.uint8).reshape(-1, 8)
    for at in range(0, len(bits), CHUNK):
        counts += np.unpackbits(bits[at : at + CHUNK], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(bits)).tobytes(), "big")


def _similarities(one: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """The Jaccard similarity of a set with each of others; all are sorted and not empty."""
    sizes = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    at = np.minimum(np.searchsorted(one, every), len(one) - 1)
    common = np.add.reduceat((one[at] == every).astype(np.int64), np.concatenate(([0], np.cumsum(sizes)[:-1])))
    return common / (len(one) + sizes - common)


def linked(sets: list[np.ndarray], similarity: float, radius: int) -> np.ndarray:
    """The number of each set's component, whose links are the pairs within the radius of at least that similarity.

    Sets that are in one component already are not held against each other again, so a group of copies costs little
    more than its exclusive-ors.
    """
    fps = np.array([fingerprint_of(s) for s in sets], np.uint64)
    order = np.lexsort((fps, np.bitwise_count(fps)))
    root = np.arange(len(sets))
    for a, b in _links(fps[order], None, radius):
        a, b = order[a], order[b]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
        cuts = np.flatnonzero(a[1:] != a[:-1]) + 1
        for one, others in zip(a[np.concatenate(([0], cuts))] if len(a) else (), np.split(b, cuts), strict=True) if len(a) else ():
            others = others[root[others] != root[one]]
            if len(others):
                near = others[_similarities(sets[one], [sets[k] for k in others]) >= similarity - 1e-9]
                if len(near):
                    together = np.unique(root[np.append(near, one)])
                    root[np.isin(root, together)] = together[0]
    return root


def _sets(docs: DataFrame, text: str, length: int, keep: list[str], full: bool) -> DataFrame:
    """keep, node and size for each row of docs; the set itself where full, else its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, more = [], [], []
            for t in batch.column(batch.schema.get_field_index(text)):
                s = shingles(t.as_py(), length)
                nodes.append(node_of(s))
                sizes.append(len(s))
                more.append(s.tobytes() if full else band_keys(s) if len(s) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(more, pa.binary() if full else pa.list_(pa.int64()))],
                [*keep, "node", "size", "more"])

    bounded_batches(docs.sparkSession)
    added = [T.StructField("node", T.LongType()), T.StructField("size", T.LongType()), T.StructField("more", T.BinaryType() if full else T.ArrayType(T.LongType()))]
    return docs.mapInArrow(run, T.StructType([docs.schema[c] for c in keep] + added))


def _edges(tile: pd.DataFrame, similarity: float, radius: int) -> pd.DataFrame:
    """Of each group in a tile, edges from its nodes to their component's first."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for _, group in tile.sort_values(["root", "node"]).groupby("root", sort=False):
        nodes = group["node"].to_numpy()
        found = linked([np.frombuffer(s, np.uint64) for s in group["more"]], similarity, radius)
        far = np.flatnonzero(found != np.arange(len(found)))
        a.append(nodes[far])
        b.append(nodes[found[far]])
    return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 24, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, text_hash, node, component_id, first) for each row of docs.

    Linked are texts whose sets of shingles (runs of shingle words; A-Z folded) have at least the Jaccard similarity, and
    fingerprints within the radius (at 0.8 five deviations beyond the distance to expect). component_id is the smallest
    key of all documents that links reach; first marks the rows of the component that have the smallest key, null last, and among
    those the smallest text_hash. Equal sets are one node; texts without a word are one node that links to no other.
    Rows of equal key and text have equal results. An empty table gives an empty result.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    each = materialize(_sets(rows, "text", shingle, ["key", "h"], False), "near-sets")
    sample = F.min(F.struct(F.col("key").isNull().alias("no_key"), "key", "h")).alias("sample")
    nodes = each.groupBy("node").agg(sample, F.max("size").alias("size"), F.count("*").alias("n"), F.first("more").alias("more"))
    nodes = materialize(nodes, "near-nodes")

    # Each row of a key that has several nodes points at the least of them.
    keys = nodes.select("node", F.explode("more").alias("band"))
    nodes = nodes.drop("more")
    several = keys.groupBy("band").agg(F.min("node").alias("least"), F.count("*").alias("n")).filter("n > 1")
    several = materialize(several, "near-bands")
    met = join_hot(keys, several.drop("n"), ["band"], several, several.agg(F.sum("n")).first()[0] or 0)
    maybe = materialize(met.filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct(), "near-candidates")
    groups = connected_components(maybe)
    chosen = materialize(groups.join(nodes, "node"), "near-groups")
    totals = materialize(chosen.groupBy("root").agg(F.sum("size").alias("total"), F.count("*").alias("n")), "near-totals")

    # The sets of the candidates; a set comes from one row, though others may have its key and text.
    of = chosen.select(F.col("sample.key").alias("key2"), F.col("sample.h").alias("h2"), F.col("node").alias("want"), "root")
    picked = rows.join(of.hint("merge"), F.col("key").eqNullSafe(F.col("key2")) & (F.col("h") == F.col("h2")))
    full = _sets(picked.select("text", "want", "root"), "text", shingle, ["want", "root"], True).filter("node = want")
    full = materialize(full.groupBy("node", "root", "size").agg(F.first("more").alias("more")), "near-full")
    full = join_hot(full, totals.drop("n"), ["root"], totals, totals.agg(F.sum("n")).first()[0] or 0)

    # Small groups share tasks. A large one is compared as pairs of cells of sets of near sizes.
    small = full.filter(F.col("total") <= MOST)
    tasks = max(1, int((totals.filter(F.col("total") <= MOST).agg(F.sum("total")).first()[0] or 0) // TILE))
    tiles = small.select(F.lit(0).cast("long").alias("g"), F.pmod(F.xxhash64("root"), F.lit(tasks)).alias("x"), F.lit(0).cast("long").alias("y"), "root", "node", "more")
    if totals.filter(F.col("total") > MOST).limit(1).count():
        large = full.filter(F.col("total") > MOST).withColumn("step", F.floor(F.log("size") / F.log(F.lit(1 / similarity)) + 1e-9))
        large = materialize(large, "near-large")
        cells = materialize(large.groupBy("root", "step").agg(F.ceil(F.sum("size") / (MOST // 2)).alias("m"), F.count("*").alias("n")), "near-cells")
        # The cells of each step and its neighbours, one short row a step.
        beside = cells.select("root", F.col("step").alias("step2"), F.col("m").alias("m2"))
        beside = cells.join(beside, "root").filter("abs(step - step2) <= 1").groupBy("root", "step", "m").agg(
            F.collect_list(F.struct("step2", "m2")).alias("beside"))
        large = join_hot(large, beside, ["root", "step"], cells, cells.agg(F.sum("n")).first()[0] or 0)
        large = large.withColumn("own", F.col("step") * 1048576 + F.pmod(F.xxhash64("node"), F.col("m")))
        pairs = large.withColumn("s", F.explode("beside")).withColumn("sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s.m2") - 1)))
        pairs = pairs.withColumn("its", F.col("s.step2") * 1048576 + F.col("sub"))
        tiles = tiles.unionByName(pairs.select(F.col("root").alias("g"), F.least("own", "its").alias("x"), F.greatest("own", "its").alias("y"), "root", "node", "more"))
    links = tiles.groupBy("g", "x", "y").applyInPandas(lambda tile: _edges(tile, similarity, radius), "a long, b long")

    roots = connected_components(links)
    joined = materialize(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "near-roots")
    least = joined.groupBy("root").agg(F.min("sample").alias("least"), F.sum("n").alias("n"))
    by_node = joined.join(least.drop("n"), "root").select("node", "least", "n")
    by_node = materialize(by_node, "near-components")
    out = join_hot(each, by_node.drop("n"), ["node"], by_node, by_node.agg(F.sum("n")).first()[0] or 0)
    first = F.col("key").eqNullSafe(F.col("least.key")) & (F.col("h") == F.col("least.h"))
    return out.select(F.col("key").alias(key), F.col("h").alias("text_hash"), "node", F.col("least.key").alias("component_id"), first.alias("first"))
