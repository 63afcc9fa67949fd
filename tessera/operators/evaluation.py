"""Retrieval measures and run rollups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.joins import BROADCAST_ROWS
from tessera.operators.scoring import WORD
from tessera.operators.search import small
from tessera.sources.scratch import materialize, spread


def ranked_measures(cases: DataFrame, results: DataFrame, relevant: DataFrame, key: str = "item_id", item: str = "doc_id", cuts: tuple[int, ...] = (1, 3, 4, 6), preferred: DataFrame | None = None) -> DataFrame:
    """Per case of cases: hit@k, reciprocal rank and precision at the last cut; a case without results scores 0. With
    preferred (key, item) also preferred_top1: whether the first result is the case's preferred one."""
    hit = results.join(relevant.select(key, item).distinct().withColumn("_hit", F.lit(1)), [key, item], "left")
    per = hit.filter(F.col("rank") <= cuts[-1]).groupBy(key).agg(F.min(F.when(F.col("_hit") == 1, F.col("rank"))).alias("first"), F.count("_hit").alias("found"))
    j = cases.select(key).join(per, key, "left")
    also = []
    if preferred is not None:
        top = results.filter(F.col("rank") == 1).select(key, item).join(preferred.select(key, item).distinct(), [key, item], "left_semi").select(key, F.lit(True).alias("_top"))
        j = j.join(top, key, "left")
        also = [F.coalesce("_top", F.lit(False)).alias("preferred_top1")]
    return j.select(key, *also, *[F.coalesce(F.col("first") <= k, F.lit(False)).alias(f"hit_{k}") for k in cuts],
                    F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.coalesce(F.col("found"), F.lit(0)) / cuts[-1], 6).alias("precision"))


def covered(keywords: Column, text: Column, share_up: bool = True) -> Column:
    """Whether half of the keywords (rounded up, or down but at least one) occur, without regard to dashes and blanks."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"[\s‐-―-]+", "")
    found = F.size(F.filter(keywords, lambda k: F.contains(plain(text), plain(k))))
    need = F.ceil(F.size(keywords) / 2) if share_up else F.greatest(F.floor(F.size(keywords) / 2), F.lit(1))
    return found >= need


def failure_class(n_results: Column, source_ok: Column, keywords_ok: Column, table_first: Column) -> Column:
    return F.when(n_results == 0, "missing_context").when(~source_ok, "wrong_document").when(~keywords_ok, "missing_keywords").when(table_first, "table_pollution").otherwise("")


def summary(cases: DataFrame, group: str | None = None) -> DataFrame:
    """Rates over cases (passed, hit_6, hit_3, mrr, manual): manual cases only count. With group a rollup."""
    auto = ~F.col("manual")
    rate = lambda c: F.round(F.coalesce(F.avg(F.when(auto, c.cast("double"))), F.lit(0.0)), 4)
    g = cases.rollup(group) if group else cases.groupBy()
    return g.agg(F.count("*").alias("total"), F.count_if(auto).alias("automated"), rate(F.col("passed")).alias("pass_rate"),
                 rate(F.col("hit_6")).alias("hit_at_6"), rate(F.col("hit_3")).alias("recall_at_3"), rate(F.col("mrr")).alias("mrr"))


def against_targets(summary_row: DataFrame, targets: dict[str, float]) -> DataFrame:
    """(metric, value, target, met) for each target."""
    pairs = ", ".join(f"'{m}', cast({m} as double), cast({t} as double)" for m, t in targets.items())
    return summary_row.selectExpr(f"stack({len(targets)}, {pairs}) as (metric, value, target)").withColumn("met", F.col("value") >= F.col("target"))


def latency_rollup(runs: DataFrame, service: str, latency: str, ok: Column, sigmas: float | None = None) -> DataFrame:
    """Per service: mean of valid runs, successes of all, state (under 30 % failed), order (working by mean, then failed)."""
    valid = ok & (F.col(latency) > 0)
    r = runs.withColumn("_ok", valid)
    if sigmas is not None:
        s = r.filter("_ok").groupBy(service).agg(F.avg(latency).alias("_m"), F.stddev(latency).alias("_s"))
        r = r.join(s, service, "left").withColumn("_ok", F.col("_ok") & (F.abs(F.col(latency) - F.col("_m")) <= sigmas * F.coalesce("_s", F.lit(0.0))))
    per = r.groupBy(service).agg(F.count("*").alias("runs"), F.count_if("_ok").alias("valid"), F.sum(F.when(F.col("_ok"), F.col(latency).cast("decimal(18,4)"))).alias("_t"))
    return per.select(service, "runs", "valid", (F.col("_t").cast("double") / F.col("valid")).alias("mean"), F.when(F.col("valid") < 0.3 * F.col("runs"), "failed").otherwise("ok").alias("state"))


#: The base of the hash of a window of numbered words.
BASE = np.uint64(0x9E3779B97F4A7C15)


def _hashes(numbers: np.ndarray, n: int) -> np.ndarray:
    """A hash of each window of n numbers."""
    h = np.zeros(len(numbers) - n + 1, np.uint64)
    for j in range(n):
        h = h * BASE + numbers[j : j + len(h)]
    return h


def _like_windows(docs: DataFrame, runs: dict[int, list[str]]) -> DataFrame:
    """(doc_id, n, run): the windows of docs that have the hash of one of runs, by length; of other windows few by chance."""
    number = {w: i + 1 for i, w in enumerate(sorted({w for r in runs.values() for x in r for w in x.split(" ")}))}
    known = {n: np.unique(np.concatenate([_hashes(np.array([number[w] for w in x.split(" ")], np.uint64), n) for x in r])) for n, r in runs.items()}
    sent = docs.sparkSession.sparkContext.broadcast((number, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, known = sent.value
        for batch in batches:
            at, lengths, out = [], [], []
            for k, low in enumerate(batch.column(1).to_pylist()):
                words = WORD.findall(low)
                numbers = np.array([number.get(w, 0) for w in words], np.uint64)
                for n, hashes in known.items():
                    if len(words) >= n:
                        h = _hashes(numbers, n)
                        found = {" ".join(words[i : i + n]) for i in np.flatnonzero(hashes[np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)] == h).tolist()}
                        at += [k] * len(found)
                        lengths += [n] * len(found)
                        out += found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(lengths, pa.int32()), pa.array(out, pa.string())], ["doc_id", "n", "run"])

    low = spread(docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("low")))
    return low.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n int, run string")


def sharing_passages(docs: DataFrame, items: DataFrame, words: int = 10) -> DataFrame:
    """(item_id, doc_id) where the document holds so many consecutive words of the item (all, where it has fewer), in any case.

    Windows compare by two hashes. Up to a checked count the items' windows go to the documents: a window of a document is only put
    together where the numbers of its words hash like an item's.
    """
    def windows(df: DataFrame, key: str, n: Column) -> DataFrame:
        w = df.select(key, T.matches(F.lower("text"), "[a-z0-9_+-]+").alias("w")).withColumn("n", n).filter((F.col("n") > 0) & (F.size("w") >= F.col("n")))
        at = w.select(key, "w", "n", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).alias("i"))
        run = F.array_join(F.slice("w", F.col("i"), F.col("n")), " ")
        return at.select(key, "n", run.alias("run"))

    hashed = lambda df, key: df.select(key, "n", F.xxhash64("run").alias("h"), F.hash("run").alias("g"))
    said = materialize(windows(items, "item_id", F.least(F.size("w"), F.lit(words))), "item-windows")
    own = hashed(said, "item_id").distinct()
    distinct = said.select("n", "run").distinct()
    if 0 < distinct.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        runs: dict[int, list[str]] = {}
        for r in distinct.collect():
            runs.setdefault(r["n"], []).append(r["run"])
        return hashed(_like_windows(docs, runs), "doc_id").join(small(own), ["n", "h", "g"]).select("item_id", "doc_id").distinct()
    lengths = [r["n"] for r in own.select("n").distinct().collect()]  # at most words of them
    hit = None
    for n in lengths:
        found = hashed(windows(docs, "doc_id", F.lit(n)), "doc_id").join(small(own.filter(F.col("n") == n)), ["n", "h", "g"]).select("item_id", "doc_id")
        hit = found if hit is None else hit.unionByName(found)
    return hit.distinct() if hit is not None else items.select("item_id").limit(0).join(docs.select("doc_id").limit(0))
