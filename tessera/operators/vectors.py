"""Nearest vectors by cosine: matrix products by Arrow batch with a running top-k, and an index of cells.

A task holds a block of queries as a matrix and the best rows for each so far; a batch of rows costs one product. Rows of
(query, vector) pairs never exist: each task sends the best of its rows. The index deals vectors to cells about centres of
k-means and keeps each cell's radius. A query first searches the cells nearest to it; its k-th best distance then leaves
out, by the triangle inequality, all cells that can't hold a nearer row, so the result is exact. Given a number of cells it
searches the nearest only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tessera.operators.joins import small
from tessera.sources.scratch import materialize, spread

#: Queries of a block: their matrix is what a task holds of them.
QUERIES = 4096
#: Scores of one product: 8 MB of them, of which a handful of copies are in memory at once, whatever the Arrow batch.
PRODUCT = 1 << 20
#: Rows of a cell in one task, about.
CELL_ROWS = 50_000
#: Rows on which centres are fit, and cells at most.
SAMPLE_ROWS, MOST_CELLS = 50_000, 256
SLACK = 1e-6


def _matrix(lists) -> np.ndarray:
    """The rows of an Arrow list array of one length as a matrix."""
    n = len(lists)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _units(lists, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of an Arrow list array have so many numbers, and those scaled to length one; those without length stay zero."""
    lengths = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == dims)
    m = _matrix(lists.take(pa.array(at)))
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return at, m / np.where(length > 0, length, 1.0)


def unit(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """rows with unit, the vector of length one in double precision, and dims; a vector without length stays zero, a null one
    goes."""
    v = F.col(vector).cast("array<double>")
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    rows = rows.filter(F.col(vector).isNotNull()).withColumn("_v", F.struct(v.alias("v"), length.alias("n")))
    scaled = F.transform("_v.v", lambda x: F.when(F.col("_v.n") > 0, x / F.col("_v.n")).otherwise(0.0))
    return rows.withColumn("unit", scaled).withColumn("dims", F.size("unit")).drop("_v")


def hashed_vectors(rows: DataFrame, dimensions: int = 32) -> DataFrame:
    """(the first column of rows, embedding) of rows (key, tokens): hashed_vector of the tokens by Arrow batch, in which each distinct
    token is hashed once."""
    key = rows.schema.fields[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            words = lists.flatten().dictionary_encode()
            hashes = [hashlib.sha256(w.encode()).digest() for w in words.dictionary.to_pylist()]
            bucket = np.array([int.from_bytes(h[:4], "little") % dimensions for h in hashes], np.int64)
            sign = np.array([1.0 - 2.0 * (h[4] % 2) for h in hashes], np.float64)
            at, place = words.indices.to_numpy(), np.repeat(np.arange(len(n)), n) * dimensions
            v = np.bincount(place + bucket[at], sign[at], len(n) * dimensions).reshape(-1, dimensions)
            length = np.sqrt((v * v).sum(axis=1, keepdims=True))
            v = v / np.where(length > 0, length, 1.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * dimensions, pa.int32()), pa.array(v.ravel()))], [key.name, "embedding"])

    return rows.mapInArrow(run, StructType([key, StructField("embedding", ArrayType(DoubleType()))]))


class _Best:
    """The best rows for each query so far: by score descending, then id."""

    def __init__(self, queries: int, top: int):
        self.scores: list[np.ndarray] = [np.zeros(0)] * queries
        self.ids: list[np.ndarray] | None = None
        self.top = top

    def meet(self, rows: np.ndarray, queries: np.ndarray, ids: np.ndarray) -> None:
        """Rows of unit vectors against all queries, some rows at a time."""
        step = max(1, PRODUCT // max(1, len(queries)))
        for a in range(0, len(rows), step):
            self.add(shown(rows[a : a + step] @ queries.T), ids[a : a + step])

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores of rows by queries."""
        top = self.top
        if ids.dtype == object:  # strings
            ids = ids.astype(str)
        if self.ids is None:
            self.ids = [ids[:0]] * len(self.scores)
        floor = np.array([s[top - 1] if len(s) >= top else -1.0 for s in self.scores])
        if len(ids) > top:
            floor = np.maximum(floor, np.partition(scores, len(ids) - top, axis=0)[len(ids) - top])
        for q in np.flatnonzero((scores >= floor).any(axis=0)):
            at = np.flatnonzero(scores[:, q] >= floor[q])
            s, i = np.r_[self.scores[q], scores[at, q]], np.r_[self.ids[q], ids[at]]
            order = np.lexsort((i, -s))[:top]
            self.scores[q], self.ids[q] = s[order], i[order]

    def rows(self, query_ids: np.ndarray) -> pa.RecordBatch:
        n = [len(s) for s in self.scores]
        ids = pa.array(np.concatenate(self.ids)) if self.ids else pa.nulls(0)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, n)), ids, pa.array(np.concatenate([*self.scores, np.zeros(0)]))], ["query_id", "vec_id", "vector"])


FOUND = "query_id long, vec_id long, vector double"


def shown(cos: np.ndarray) -> np.ndarray:
    return np.round(np.maximum(0.0, (cos + 1) / 2), 6)


def merged(found: DataFrame, top: int) -> DataFrame:
    """(query_id, vec_id, vector, rank): the best of what the tasks sent."""
    w = Window.partitionBy("query_id").orderBy(F.col("vector").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def vector_top(corpus: DataFrame, queries: DataFrame, top: int = 10) -> DataFrame:
    """(query_id, vec_id, vector, rank) by cosine, shown as (cosine + 1) / 2, at least 0; other dimensions don't match.

    corpus and queries have vec_id (whole numbers; the corpus may have strings) and embedding. Every query meets the whole corpus, exactly: blocks of
    QUERIES queries of one dimension are sent to all tasks as a matrix, one pass over the corpus for each: pass a written table
    where vectors are costly to make. A vector without
    length is at right angles to all; null vectors match nothing.
    """
    spark = corpus.sparkSession
    q = materialize(unit(queries.select(F.col("vec_id").cast("long").alias("query_id"), "embedding")).select("query_id", "unit", "dims"), "query-vectors")
    kind = "string" if dict(corpus.dtypes)["vec_id"] == "string" else "long"
    c = corpus.select(F.col("vec_id").cast(kind).alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    out = None
    for dims, n in sorted((r["dims"], r["count"]) for r in q.groupBy("dims").count().collect()):
        parts = max(1, math.ceil(n / QUERIES))
        for k in range(parts):
            block = q.filter((F.col("dims") == dims) & (F.pmod(F.xxhash64("query_id"), F.lit(parts)) == k)).toArrow()
            if not block.num_rows:
                continue
            sent = spark.sparkContext.broadcast((block.column("query_id").to_numpy(), _matrix(block.column("unit").combine_chunks())))

            def run(batches: Iterator[pa.RecordBatch], sent=sent, dims=dims) -> Iterator[pa.RecordBatch]:
                ids, m = sent.value
                best = _Best(len(ids), top)
                for batch in batches:
                    at, v = _units(batch.column(1), dims)
                    if dims and len(at):
                        best.meet(v, m, batch.column(0).to_numpy(zero_copy_only=False)[at])
                if best.ids is not None:
                    yield best.rows(ids)

            found = c.mapInArrow(run, f"query_id long, vec_id {kind}, vector double")
            out = found if out is None else out.unionByName(found)
    return merged(out if out is not None else spark.createDataFrame([], f"query_id long, vec_id {kind}, vector double"), top)


@dataclass
class Cells:
    """An index of cells in a folder that all executors share."""

    spark: SparkSession
    path: str

    def rows(self) -> DataFrame:
        """(vec_id, unit, dims, gap, part, cell): gap is the distance from the centre, part a share of a large cell."""
        return self.spark.read.schema("vec_id long, unit array<double>, dims int, gap double, part int, cell int").parquet(f"{self.path}/rows")

    def cells(self) -> DataFrame:
        """(cell, dims, centre, n, radius); cells under zero hold what has no centre: other dimensions, no length."""
        return self.spark.read.parquet(f"{self.path}/cells")


def _nearest(centres):
    """A function of Arrow batches: (…, unit) with cell and gap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = centres.value
        for batch in batches:
            v = _matrix(batch.column("unit"))
            near, gap = np.zeros(len(v), np.int32), np.zeros(len(v))
            if len(v):
                cos = v @ m.T
                near = cos.argmax(axis=1).astype(np.int32)
                gap = np.sqrt(((v - m[near]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near), pa.array(gap)], [*batch.schema.names, "cell", "gap"])

    return run


def write_cells(vectors: DataFrame, path: str, cells: int | None = None, rounds: int = 4) -> Cells:
    """An index of vectors (vec_id, embedding) at path.

    Centres are fit by k-means on a sample of SAMPLE_ROWS vectors, by a hash of the id, of the dimension most have; every
    row is indexed. By default there are about the square root of the rows as cells, at most MOST_CELLS.
    """
    spark = vectors.sparkSession
    v = materialize(unit(spread(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))).select("vec_id", "unit", "dims"), "vectors")
    has = F.exists("unit", lambda x: x != 0)
    sizes = v.filter(has).groupBy("dims").count().orderBy(F.col("count").desc(), "dims").first()
    index = Cells(spark, path)
    if sizes is None:
        rest = v.select("*", F.lit(0.0).alias("gap"), (-F.col("dims") - 1).alias("cell"))
        return _written(index, rest, None)
    dims, n = sizes
    k = cells or max(1, min(MOST_CELLS, round(math.sqrt(n))))
    drawn = F.pmod(F.xxhash64("vec_id", F.lit("cells")), F.lit(1 << 30))
    own = v.filter(has & (F.col("dims") == dims))
    sample = materialize(own.filter(drawn < min(1.0, SAMPLE_ROWS / n) * (1 << 30)).select("unit"), "cell-sample")
    first = sample.orderBy(F.xxhash64("unit")).limit(k).toArrow()
    centres = _matrix(first.column("unit").combine_chunks()) if first.num_rows else np.eye(1, dims)
    for _ in range(rounds):
        placed = sample.mapInArrow(_nearest(spark.sparkContext.broadcast(centres)), "unit array<double>, cell int, gap double")
        sums = placed.select("cell", F.posexplode("unit").alias("at", "x")).groupBy("cell", "at").agg(F.sum("x").alias("x"))
        got = sums.toArrow()  # a number for each place of each centre
        new = np.zeros_like(centres)
        new[got.column("cell").to_numpy(), got.column("at").to_numpy()] = got.column("x").to_numpy()
        length = np.sqrt((new**2).sum(axis=1))
        centres[length > 0] = new[length > 0] / length[length > 0, None]
    near = own.mapInArrow(_nearest(spark.sparkContext.broadcast(centres)), "vec_id long, unit array<double>, dims int, cell int, gap double")
    rest = v.filter(~(has & (F.col("dims") == dims))).select("vec_id", "unit", "dims", (-F.col("dims") - 1).alias("cell"), F.lit(0.0).alias("gap"))
    return _written(index, near.unionByName(rest), centres)


def _written(index: Cells, rows: DataFrame, centres: np.ndarray | None) -> Cells:
    rows = materialize(rows.select("vec_id", "unit", "dims", "gap", "cell"), "placed")
    sizes = rows.groupBy("cell", "dims").agg(F.count("*").alias("n"), F.max("gap").alias("radius"))
    known = [(i, c.tolist()) for i, c in enumerate(centres)] if centres is not None else []
    at = index.spark.createDataFrame(known, "cell int, centre array<double>")
    sizes.join(at, "cell", "left").select("cell", "dims", "centre", "n", "radius").write.parquet(f"{index.path}/cells")
    parts = F.broadcast(index.cells().select("cell", F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("parts")))
    dealt = rows.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    dealt.select("vec_id", "unit", "dims", "gap", "part", "cell").repartitionByRange("cell", "part").sortWithinPartitions("cell", "part").write.partitionBy("cell").parquet(f"{index.path}/rows")
    return index


def _searched(index: Cells, pairs: DataFrame, top: int) -> DataFrame:
    """What the cells of pairs (query_id, unit, cell) hold of each query's best: rows of tasks, not yet merged.

    Rows of a cell's part and blocks of its queries meet in one task, the queries first.
    """
    parts = index.cells().select("cell", F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("parts"))
    counts = pairs.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
    counts = small(materialize(counts, "asked-cells"))
    block = F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block")
    asked = pairs.join(counts, "cell").join(small(parts), "cell").select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), block, F.lit(0).alias("kind"), F.col("query_id").alias("id"), "unit")
    held = index.rows().join(counts, "cell").select(
        "cell", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), F.col("vec_id").alias("id"), "unit")
    keys = ["cell", "part", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, units, m, best = None, [], [], None, None
        for batch in batches:
            table = np.stack([batch.column(c).to_numpy() for c in (*keys, "kind")], axis=1)
            cuts = np.flatnonzero((table[1:] != table[:-1]).any(axis=1)) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(table)], strict=True):
                if a == b:
                    continue
                if key != tuple(table[a, :3]):
                    if best is not None and best.ids is not None:
                        yield best.rows(np.concatenate(ids))
                    key, ids, units, m, best = tuple(table[a, :3]), [], [], None, None
                part = batch.slice(a, b - a)
                rows = _matrix(part.column("unit"))
                if table[a, 3] == 0:
                    ids.append(part.column("id").to_numpy())
                    units.append(rows)
                elif ids:
                    if best is None:
                        m, best = np.concatenate(units), _Best(sum(map(len, ids)), top)
                    if rows.shape[1]:
                        best.meet(rows, m, part.column("id").to_numpy())
        if best is not None and best.ids is not None:
            yield best.rows(np.concatenate(ids))

    dealt = asked.unionByName(held).repartition(*keys).sortWithinPartitions(*keys, "kind")
    return dealt.mapInArrow(run, FOUND)


def search_cells(index: Cells, queries: DataFrame, top: int = 10, cells: int | None = None) -> DataFrame:
    """(query_id, vec_id, vector, rank) as vector_top gives it.

    Without cells the result is exact: each query searches its nearest cells with top rows in them and then those that may
    hold a nearer row than its last one. With cells it searches so many, the nearest, and all without a centre.
    """
    spark = index.spark
    q = materialize(unit(queries.select(F.col("vec_id").cast("long").alias("query_id"), "embedding")).select("query_id", "unit", "dims"), "query-vectors")
    table = index.cells().toArrow()  # at most MOST_CELLS, or as many as asked for, and one for each dimension
    sent = spark.sparkContext.broadcast([table.column(c).to_pylist() for c in ("cell", "dims", "centre", "n", "radius")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, of_dims, centre, n, radius = sent.value
        placed = [i for i, c in enumerate(centre) if c is not None]
        m = np.array([centre[i] for i in placed])
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for k, (qid, v, dims) in enumerate(zip(batch.column("query_id").to_pylist(), batch.column("unit").to_pylist(), batch.column("dims").to_pylist(), strict=True)):
                away = np.zeros(0)
                if placed and dims == m.shape[1]:
                    away = np.sqrt(np.maximum(0.0, ((m - np.array(v)) ** 2).sum(axis=1)))
                order, held = np.argsort(away, kind="stable"), 0
                for place, j in enumerate(order):
                    i = placed[j]
                    # Cells that are searched first, and for the others how near a row in them can be.
                    now = place < cells if cells else held < top
                    held += n[i]
                    for x, y in zip(out, (k, own[i], now, max(0.0, float(away[j]) - radius[i])), strict=True):
                        x.append(y)
                for i in range(len(own)):
                    if centre[i] is None and of_dims[i] == dims:
                        for x, y in zip(out, (k, own[i], True, 0.0), strict=True):
                            x.append(y)
            at = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id").take(at), batch.column("unit").take(at), pa.array(out[1], pa.int32()), pa.array(out[2], pa.bool_()), pa.array(out[3], pa.float64())],
                ["query_id", "unit", "cell", "now", "least"])

    pairs = spread(q).mapInArrow(run, "query_id long, unit array<double>, cell int, now boolean, least double")
    pairs = materialize(pairs if cells is None else pairs.filter("now"), "query-cells")
    first = materialize(_searched(index, pairs.filter("now").select("query_id", "unit", "cell"), top), "found")
    if cells:
        return merged(first, top)
    # The k-th best score as a distance of unit vectors: no cell beyond it can hold a better row. A query without length has none.
    score = merged(first, top).filter(F.col("rank") == top).select("query_id", F.sqrt(F.greatest(2 - 2 * (2 * F.col("vector") - 1), F.lit(0.0)) + SLACK * 8).alias("most"))
    left = pairs.filter("not now").join(small(score), "query_id", "left").filter((F.col("least") <= F.coalesce("most", F.lit(3.0)) + SLACK) | ~F.exists("unit", lambda x: x != 0))
    second = _searched(index, left.select("query_id", "unit", "cell"), top)
    return merged(first.unionByName(second), top)
