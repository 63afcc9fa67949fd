"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Trained on a bounded sample on the driver; per-coordinate rates and the L1 term leave few weights, which are broadcast
as two short arrays. Scoring is one pass over the documents in numpy blocks, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import ALNUM, FOLD, blocks, hashes, mix, owners, spans
from .common import bounded_batches, materialize, others

BUCKETS = 1 << 20
#: Labelled documents that training reads at most, and the bytes of their features.
SAMPLE_ROWS, SAMPLE_BYTES = 12000, 96 << 20


def features(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each word, pair of neighbours, and pair of words with one between, in a block of texts."""
    buf = FOLD[buf]
    s, e = spans(buf, ALNUM)
    h, own = hashes(buf, s, e), owners(s, starts)
    texts, found = [own], [h]
    for gap in (1, 2):
        same = own[gap:] == own[:-gap]
        texts.append(own[gap:][same])
        found.append(mix(h[:-gap][same] * np.uint64(2 * gap + 1) + h[gap:][same]))
    return np.concatenate(texts), (np.concatenate(found) >> np.uint64(44)).astype(np.int32)


def _per_text(texts: np.ndarray, buckets: np.ndarray, n: int) -> list[np.ndarray]:
    """The distinct buckets of each text."""
    key = np.unique(texts * BUCKETS + buckets)
    cuts = np.searchsorted(key, np.arange(1, n) * BUCKETS)
    return [(x % BUCKETS).astype(np.int32) for x in np.split(key, cuts)]


@dataclass
class ToxicityModel:
    buckets: np.ndarray  # with a weight other than zero, ascending
    weights: np.ndarray
    bias: float


def fit(sample: list[tuple[int, np.ndarray]], alpha: float = 1.0, beta: float = 1.0, l1: float = 12.0, l2: float = 1.0, least_rows: int = 5, rounds: int = 8, seed: int = 1) -> ToxicityModel:
    """From rows (label, distinct buckets), one update a row and round. The bias is not penalised.

    Buckets of fewer than least_rows rows get no weight: they would only learn single rows by heart. Without rows nothing is
    known, and every text scores next to 0.
    """
    if not sample:
        return ToxicityModel(np.zeros(0, np.int32), np.zeros(0, np.float32), -35.0)
    rows_of = np.zeros(BUCKETS, np.int32)
    for _, ids in sample:
        rows_of[ids] += 1
    sample = [(y, ids[rows_of[ids] >= least_rows]) for y, ids in sample]
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    zb = nb = 0.0
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for k in rng.permutation(len(sample)):
            y, ids = sample[k]
            zi, ni = z[ids], n[ids]
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            wb = -zb / ((beta + np.sqrt(nb)) / alpha)
            g = 1 / (1 + np.exp(-min(35.0, max(-35.0, w.sum() + wb)))) - y
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[ids] = zi + g - sigma * w
            n[ids] = ni + g * g
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * wb
            nb += g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    some = np.flatnonzero(w)
    return ToxicityModel(some.astype(np.int32), w[some].astype(np.float32), float(-zb / ((beta + np.sqrt(nb)) / alpha)))


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, text: str = "text", rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fit on at most rows documents, and SAMPLE_BYTES of features, that may_learn and have a label, drawn by a hash of
    doc_id at their natural rate. Without such documents, or in an empty table, the model scores all texts alike.

    Labels are joined by doc_id before any text is read into features; only buckets reach the driver. Of rows that agree in
    doc_id and text one is learned; of those that agree in doc_id alone each, in an order that a hash of both gives.
    """
    bounded_batches(docs.sparkSession)
    known = labels.select("doc_id", "toxic").filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(may_learn)
    n = known.count()
    if not n:
        return fit([])
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("toxicity sample")), F.lit(1 << 30))
    chosen = known.withColumn("_u", drawn).filter(F.col("_u") <= int(min(1.0, 1.1 * rows / n) * (1 << 30)))
    # Bounded by rows: a share of the labels that falls as they grow.
    pairs = docs.select("doc_id", text).join(F.broadcast(chosen), "doc_id").select("toxic", text, F.xxhash64("doc_id", text, F.lit("toxicity sample")).alias("_u"))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for first, end, buf, starts in blocks(batch.column(1)):
                out += [x.tobytes() for x in _per_text(*features(buf, starts), end - first)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), batch.column(2), pa.array(out, pa.binary())], ["y", "u", "ids"])

    # One row for repeated documents; the first rows by u that fit in the bytes are taken.
    sampled = materialize(pairs.mapInArrow(collect, "y int, u long, ids binary").dropDuplicates(["u", "y"]), "toxicity-sample")
    held, last = 0, None
    for k, r in enumerate(sorted(sampled.select("u", F.octet_length("ids").alias("b")).collect())):
        held += r["b"]
        if k == 0 or k < rows and held <= SAMPLE_BYTES:
            last = r["u"]
    if last is None:
        return fit([])
    table = sampled.filter(F.col("u") <= last).toArrow().sort_by([("u", "ascending"), ("ids", "ascending")])
    return fit([(y, np.frombuffer(ids, np.int32)) for y, ids in zip(table["y"].to_pylist(), table["ids"].to_pylist(), strict=True)])


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """docs without the text, with score (0 to 1). A null or empty text has the score of the bias alone.

    Each feature counts once a text, however often it occurs. Repeated rows are scored each by itself; an empty table
    gives an empty result. A column score of docs is replaced, in any case.
    """
    given = [c for c in others(docs.columns, "score") if c != text]
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        weight = np.zeros(BUCKETS, np.float32)
        weight[m.buckets] = m.weights
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            total = np.full(len(column), m.bias)
            for first, end, buf, starts in blocks(column):
                texts, buckets = features(buf, starts)
                some = weight[buckets] != 0
                key = np.unique(texts[some] * BUCKETS + buckets[some])
                total[first:end] += np.bincount(key // BUCKETS, weights=weight[key % BUCKETS], minlength=end - first)
            p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in given), pa.array(p)], [*given, "score"])

    return docs.mapInArrow(run, T.StructType([docs.schema[c] for c in given] + [T.StructField("score", T.DoubleType())]))
