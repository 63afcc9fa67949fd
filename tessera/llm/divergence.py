"""Source divergence audit: how the term frequencies of each source part from those of the others and of its language.

Texts are read as bytes: bytes.translate lowers letters and blanks separators in one pass, bytes.split gives the terms and
a Counter for each document its counts. What leaves a batch is sparse: a row for each (language, source) with the terms that
occur, how often and in how many documents; Spark sums them. Sums over all kept terms, absent ones included, are done on
tiles of sources by terms in numpy: every task has a share of the terms, and of the sources of a language at most two
blocks, so that neither the pairs of sources of a term nor a language's terms meet in one row or task.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, join_hot, materialize

#: Each byte as counted: A to Z lowered, other ASCII but a to z a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Sources of a block: a tile has at most about two of them.
BLOCK = 256
#: Cells of a tile's matrix at a time.
CELLS = 1 << 20
SENT = 100_000
#: Rows of a tile in one task, about.
ROWS = 1 << 18
#: Parts of a group's terms that are ranked apart first.
SALTS = 32


def _counted(batches: Iterator[pa.RecordBatch], sent: int) -> Iterator[pa.RecordBatch]:
    """(lang, source, terms, counts, documents) of each batch of (lang, source, text as bytes)."""
    for batch in batches:
        counts: defaultdict[tuple, Counter] = defaultdict(Counter)
        held: defaultdict[tuple, Counter] = defaultdict(Counter)
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            one = Counter(text.translate(FOLD).split())
            counts[lang, source].update(one)
            held[lang, source].update(one.keys())
        for (lang, source), c in counts.items():
            terms = list(c)
            for i in range(0, len(terms), sent):
                some = terms[i : i + sent]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x]) for x in (lang, source)] + [
                        pa.array([some], pa.list_(pa.binary())).cast(pa.list_(pa.string())),
                        pa.array([[c[t] for t in some]], pa.list_(pa.int64())), pa.array([[held[lang, source][t] for t in some]], pa.list_(pa.int64()))],
                    ["lang", "source", "terms", "counts", "documents"])


def share(count: Column, total: Column) -> Column:
    """1 + floor(1000000000 * count / total) for count <= total, exact: three digits at a time."""
    first, rest = F.expr("0L"), count
    for _ in range(3):
        first, rest = first * 1000 + F.call_function("div", rest * 1000, total), rest * 1000 % total
    return first + 1


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _tiles(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """Partial sums of each ordered pair of a tile's sources over the terms of its bucket.

    Rows come sorted by tile and bucket, first the sources (no term, p of an absent term), then those of the terms, by term.
    """
    key: tuple | None = None
    sources: dict[str, int] = {}
    absent = blocks = sums = None
    seen = kept = 0
    held: list[pa.Table] = []

    def add(rows: pa.Table) -> None:
        """Add whole terms of the present key."""
        nonlocal seen
        if not rows.num_rows:
            return
        terms = rows.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
        at = np.fromiter(map(sources.__getitem__, rows.column("source").to_pylist()), np.int64, rows.num_rows)
        p = rows.column("p").to_numpy()
        n = int(terms.max()) + 1
        seen += n
        step = max(1, cells // len(sources))
        for t in range(0, n, step):
            a, b = np.searchsorted(terms, (t, t + step))
            m = np.repeat(absent[:, None], min(step, n - t), axis=1)
            m[at[a:b], terms[a:b] - t] = p[a:b]
            for i in range(len(sources)):
                d = m[i] - m
                sums[i] += (d * d // m).sum(axis=1)

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal held
        if key is None:
            return
        if held:
            add(pa.concat_tables(held))
            held = []
        names = np.array(list(sources), object)
        _, one, other, _ = key
        for i, name in enumerate(names):
            # Pairs between the tile's two blocks; both lie in one block on the diagonal.
            mine = np.flatnonzero(blocks == (other if blocks[i] == one else one))
            mine = mine[mine != i]
            z = absent[i] - absent[mine]
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * len(mine), pa.string()), pa.array([name] * len(mine), pa.string()), pa.array(names[mine], pa.string()), pa.array(sums[i][mine]),
                 pa.array(np.full(len(mine), seen)), pa.array(z * z // absent[mine]), pa.array(np.full(len(mine), kept))],
                ["lang", "source", "item", "value", "seen", "absent", "v"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        keys = list(zip(*(table.column(c).to_pylist() for c in ("lang", "one", "other", "bucket")), strict=True))
        a = 0
        while a < len(keys):
            b = a
            while b < len(keys) and keys[b] == keys[a]:
                b += 1
            rows = table.slice(a, b - a)
            if keys[a] != key:
                yield from close()
                key, sources, seen, absent, blocks, sums = keys[a], {}, 0, np.zeros(0, np.int64), np.zeros(0, np.int64), None
            heads = rows.filter(pc.is_null(rows.column("term")))
            if heads.num_rows:
                for s in heads.column("source").to_pylist():
                    sources[s] = len(sources)
                absent, blocks = np.r_[absent, heads.column("p").to_numpy()], np.r_[blocks, heads.column("block").to_numpy()]
                kept = heads.column("v")[0].as_py()
                sums = np.zeros((len(sources), len(sources)), np.int64)
            rows = rows.slice(heads.num_rows)
            if rows.num_rows:
                held.append(rows)
                whole = pa.concat_tables(held)
                last = pc.index(whole.column("term"), whole.column("term")[-1]).as_py()
                add(whole.slice(0, last))  # the last term may go on in the next batch
                held = [whole.slice(last)]
            a = b
    yield from close()


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = 3, top: int = 200,
                      cells: int = CELLS, sent: int = SENT, task_rows: int = ROWS) -> DataFrame:
    """lang, source, part, item, value, rank: divergence of each source from the others (pair) and its own terms (term).

    Null text, lang and source are ''. A language keeps the terms in at least least of its documents; a group gives each a
    share of a thousand million, plus one, with add-one smoothing. Part pair has, for each group, all other sources of its
    language by the sum of floor((p - q)^2 / q) over all kept terms, absent ones included (0 where none is kept); part term
    the top terms whose share is above the language's. Ranks are by value descending, then item ascending. All arithmetic is
    on integers. cells, sent and task_rows bound the memory of a task and don't change the result. Repeated rows count each; an empty table gives an empty result. Columns of docs other than the three are
    left out, so no name clashes. A text may be as long as a batch of Arrow holds.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    given = docs.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).cast("binary").alias("text"))
    sparse = given.mapInArrow(lambda batches: _counted(batches, sent), "lang string, source string, terms array<string>, counts array<long>, documents array<long>")
    entries = sparse.select("lang", "source", F.explode(F.arrays_zip("terms", "counts", "documents")).alias("e"))
    counts = entries.groupBy("lang", "source", F.col("e.terms").alias("term")).agg(F.sum("e.counts").alias("n"), F.sum("e.documents").alias("documents"))
    of_term = Window.partitionBy("lang", "term")
    kept = counts.withColumn("held", F.sum("documents").over(of_term)).withColumn("ln", F.sum("n").over(of_term))
    kept = kept.withColumn("new", (F.row_number().over(of_term.orderBy("source")) == 1).cast("long"))
    kept = materialize(kept.filter(F.col("held") >= least).drop("held", "documents"), "terms")

    per_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("new").alias("new"), F.count("*").alias("rows"))
    groups = given.select("lang", "source").distinct().join(per_group, ["lang", "source"], "left").fillna(0, ["total", "new", "rows"])
    groups = materialize(groups, "groups")
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("new").alias("v"), F.count("*").alias("sources"), F.sum("rows").alias("lang_rows"))
    groups = materialize(groups.join(langs, "lang"), "groups")
    blocks = F.ceil(F.col("sources") / BLOCK)
    # A language's terms are dealt to as many buckets as its rows need, so partial sums stay few beside them.
    buckets = F.floor(F.col("lang_rows") / task_rows) + 1
    groups = groups.select("lang", "source", "total", "lang_total", "v", "rows", buckets.alias("buckets"), blocks.alias("blocks"), F.pmod(F.xxhash64("source"), blocks).alias("block"))
    p = share(F.col("n") + 1, F.col("total") + F.col("v")).alias("p")
    known = groups.drop("rows")
    terms = join_hot(kept.select("lang", "source", "term", "n", "ln"), known, ["lang", "source"], groups.select("lang", "source", F.col("rows").alias("n")), kept.count())
    terms = terms.select("lang", "source", "term", "block", "blocks", F.pmod(F.xxhash64("term"), "buckets").alias("bucket"), p, share(F.col("ln") + 1, F.col("lang_total") + F.col("v")).alias("q"))
    terms = materialize(terms, "shares")

    # Own terms: the best of each share of a group's terms, then of those.
    own = terms.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    order = [F.col("value").desc(), F.col("item")]
    salt = F.pmod(F.xxhash64("item"), F.lit(SALTS)).alias("salt")
    own = own.select("*", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    own = own.drop("salt").withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).filter(F.col("rank") <= top)

    # Pairs: the rows of each source in the tiles of its block with each block of its language.
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("with")
    tile = [F.least("block", "with").alias("one"), F.greatest("block", "with").alias("other")]
    heads = groups.select("*", every).withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)))
    heads = heads.select("lang", *tile, "bucket", F.lit(None).cast("string").alias("term"), "source", "block", share(F.lit(1).cast("long"), F.greatest(F.col("v") + F.col("total"), F.lit(1))).alias("p"), "v")
    rows = terms.select("*", every).select("lang", *tile, "bucket", "term", "source", "block", "p", F.lit(0).cast("long").alias("v"))
    keys = ["lang", "one", "other", "bucket"]
    dealt = heads.unionByName(rows).repartition(*keys).sortWithinPartitions(*keys, F.col("term").asc_nulls_first())
    sums = dealt.mapInArrow(lambda batches: _tiles(batches, cells), "lang string, source string, item string, value long, seen long, absent long, v long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.max("absent").alias("absent"), F.max("v").alias("v"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("value") + (F.col("v") - F.col("seen")) * F.col("absent")).alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
    return own.unionByName(pairs).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
