"""Language identification: averaged hashed subword embeddings with a linear softmax.

The model is trained on a bounded sample by stochastic gradient descent in numpy on the driver. Scoring is one pass
over the documents, in blocks of bytes, without a shuffle: because the mean of embeddings goes through a linear layer,
the model reduces to one row of class scores per bucket, a table of fixed size.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import blocks
from .common import bounded_batches, materialize, others

BUCKETS = 1 << 15
DIMENSIONS = 16
#: Labelled documents that training reads at most, over all languages; the bytes of their subword counts.
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 64 << 20
#: Languages that a model knows at most: its table of 32768 buckets takes 128 KB for each, 131 MB in all.
MOST_LANGUAGES = 1000
#: Of the subword distribution of a language, the part that is spread evenly over all buckets; and the allowance for short texts.
EVEN, SLACK = 0.02, 3.0
LETTER = regex.compile(r"\p{L}")

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _subwords(buf: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
    """For each text of a block, the buckets of its subwords: runs of 2 to 4 bytes in a word and the blanks about it."""
    b = np.concatenate(([32], _FOLD[buf])).astype(np.uint32)  # text k lies between the blanks at starts[k] and starts[k + 1]
    inner = b != 32
    grams = b
    hashed = []
    for n in (2, 3, 4):
        grams = (grams[:-1] << np.uint32(8)) | b[n - 1 :]
        whole = inner[:-1] | inner[1:] if n == 2 else (inner[1:-1] if n == 3 else inner[1:-2] & inner[2:-1])
        h = ((grams ^ np.uint32(n * 0x51ED27)) * np.uint32(2654435761)) >> np.uint32(32 - 15)
        hashed.append((n, h.astype(np.int32), whole))
    for k in range(len(starts) - 1):
        lo, hi = int(starts[k]), int(starts[k + 1]) + 1
        yield np.concatenate([h[lo : max(lo, hi - n + 1)][whole[lo : max(lo, hi - n + 1)]] for n, h, whole in hashed])


def bags(texts: pa.Array) -> Iterator[np.ndarray]:
    """The counts of each text's subwords, by bucket."""
    for _, _, buf, starts in blocks(texts):
        for ids in _subwords(buf, starts):
            yield np.bincount(ids, minlength=BUCKETS)


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # of a bucket's class scores
    bias: np.ndarray
    likeness: np.ndarray  # of a bucket: log of its largest share in a learned language, over an even share
    temperature: float = 1.0
    least_score: float = 0.0
    least_likeness: float = -math.inf
    _joint: np.ndarray | None = None

    def judge(self, ids: np.ndarray) -> tuple[int, float, bool]:
        """(language, calibrated probability, rejected) of a text's subwords."""
        n = max(1, len(ids))
        if self._joint is None:
            self._joint = np.concatenate((self.table, self.likeness[:, None]), axis=1)
        sums = self._joint
        total = np.zeros(sums.shape[1])
        for at in range(0, len(ids), 1 << 16):
            total += sums[ids[at : at + (1 << 16)]].sum(axis=0, dtype=np.float64)
        z = (total[:-1] / n + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return k, float(p[k]), bool(p[k] < self.least_score or _likeness(total[-1], len(ids)) < self.least_likeness)


def _likeness(total: float, n: float) -> float:
    """The mean over a text's n subwords, and more for a short text, whose mean is less certain."""
    return total / max(1.0, n) + SLACK / math.sqrt(max(1.0, n))


def fit(sample: list[tuple[str, np.ndarray, np.ndarray]], rate: float = 4.0, rounds: int = 12, seed: int = 1, most_error: float = 0.01, most_rejected: float = 0.02) -> LanguageModel:
    """From rows (language, buckets, counts), each seen so many rounds. A fifth of them is kept from training for the calibration.
    Without rows the model knows no language.

    Calibration: one temperature minimises the log loss of the kept rows; a text is rejected under the least score at
    which the accepted rows' error is at most most_error, but no higher than rejects a share most_rejected of the kept
    rows, or where its likeness to what was learned is under a bound. That bound lies half way between the likeness that
    all but 1 in 200 of the kept rows have and the highest that 95 in 100 rows of a language stay under where the
    language is left out of what was learned. A language as like the others as kept rows are can't be told from them
    and doesn't count; subwords at random always do.
    """
    languages = sorted({x[0] for x in sample})
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), np.zeros(BUCKETS, np.float32))
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out = np.zeros((DIMENSIONS, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    order = rng.permutation(len(sample))
    kept, train = order[: len(sample) // 5], order[len(sample) // 5 :]
    spread = np.zeros((len(languages), BUCKETS))
    for k in train:
        lang, ids, counts = sample[k]
        spread[languages.index(lang), ids] += counts / max(1, counts.sum())
    spread = (1 - EVEN) * spread / np.maximum(1e-12, spread.sum(axis=1, keepdims=True)) + EVEN / BUCKETS
    likeness = np.log(spread.max(axis=0) * BUCKETS).astype(np.float32)
    steps, step = rounds * len(train), 0
    for _ in range(rounds):
        for k in rng.permutation(train):
            lang, ids, counts = sample[k]
            share = (counts / max(1, counts.sum())).astype(np.float32)
            mean = share @ embed[ids]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[languages.index(lang)] -= 1
            now = rate * (1 - step / steps)
            back = out @ p
            out -= now * np.outer(mean, p)
            bias -= 0.01 * now * p
            embed[ids] -= now * share[:, None] * back
            step += 1
    model = LanguageModel(languages, embed @ out, bias, likeness)
    rows = kept if len(kept) else train
    logits, gold, like = [], [], []
    for k in rows:
        lang, ids, counts = sample[k]
        logits.append(counts.astype(np.float32) @ model.table[ids] / max(1, counts.sum()) + bias)
        gold.append(languages.index(lang))
        if counts.sum():
            like.append(_likeness(counts @ likeness[ids], counts.sum()))
    z, gold_ = np.array(logits), np.array(gold)

    def probabilities(t: float) -> np.ndarray:
        e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return e / e.sum(axis=1, keepdims=True)

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(probabilities(t)[np.arange(len(gold_)), gold_], 1e-12)).mean())

    model.temperature = min((float(t) for t in np.geomspace(0.02, 5, 60)), key=loss)
    p = probabilities(model.temperature)
    top, right = p.max(axis=1), p.argmax(axis=1) == gold_
    by_score = np.argsort(top)
    for k in range(len(by_score)):
        if (~right[by_score[k:]]).mean() <= most_error:
            model.least_score = float(top[by_score[k]]) if k else 0.0
            break
    else:
        model.least_score = 1.0
    model.least_score = min(model.least_score, float(np.quantile(top, most_rejected, method="lower")))
    if like:
        known = float(np.quantile(like, 0.005, method="lower"))
        unknown = [float(likeness.mean())]
        for k, lang in enumerate(languages if len(languages) > 1 else []):
            others = np.log(np.delete(spread, k, axis=0).max(axis=0) * BUCKETS).astype(np.float32)
            unknown.append(float(np.quantile([_likeness(c @ others[i], c.sum()) for x, i, c in sample if x == lang and c.sum()] or [math.inf], 0.95)))
        model.least_likeness = (known + max([u for u in unknown if u < known], default=known)) / 2
    return model


def train(docs: DataFrame, may_learn: Column, text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS, languages: int = MOST_LANGUAGES) -> LanguageModel:
    """Fit on at most rows documents, and SAMPLE_BYTES of counts, of those that may_learn and have a language, in equal
    parts by language. A model knows the languages most frequent among them, up to languages (ties by name), as its table is
    sent to all executors; texts of others are judged as of a language it never saw. Without such documents, or in an empty table, the model knows no language.

    The sample is taken by a hash of doc_id and text, so reruns agree; only counts of subwords reach the driver, never texts.
    """
    bounded_batches(docs.sparkSession)
    drawn = F.pmod(F.xxhash64("doc_id", text, F.lit("language sample")), F.lit(1 << 40))
    labelled = docs.select("doc_id", text, lang).filter(may_learn & F.col(lang).isNotNull()).withColumn("_u", drawn)
    per = {r[lang]: r["count"] for r in labelled.groupBy(lang).count().orderBy(F.col("count").desc(), lang).limit(languages).collect()}
    if not per:
        return fit([])
    each = max(1, rows // len(per))

    def up_to(cuts: dict[str, int]) -> Column:
        return F.create_map(*[F.lit(x) for k, v in sorted(cuts.items()) for x in (k, v)])

    chosen = labelled.filter(F.col("_u") <= up_to({k: int(min(1.0, 1.2 * each / n) * (1 << 40)) for k, n in per.items()})[F.col(lang)]).select(lang, text, "_u")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = [], []
            for bag in bags(batch.column(1)):
                some = np.flatnonzero(bag)
                ids.append(some.astype(np.int32).tobytes())
                counts.append(bag[some].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["lang", "u", "ids", "counts"])

    # One row for repeated documents. The table has at most about 1.2 times rows; of each language the first rows by u that fit in its bytes are taken.
    sampled = chosen.mapInArrow(count, "lang string, u long, ids binary, counts binary").dropDuplicates(["lang", "u"])
    sampled = materialize(sampled, "language-sample")
    sizes = sampled.select("lang", "u", (2 * F.octet_length("ids")).alias("b")).collect()
    used, held, last = defaultdict(int), defaultdict(int), {}
    for r in sorted(sizes, key=lambda r: (r["lang"], r["u"])):
        used[r["lang"]] += 1
        held[r["lang"]] += r["b"]
        if used[r["lang"]] == 1 or used[r["lang"]] <= each and held[r["lang"]] <= SAMPLE_BYTES // len(per):
            last[r["lang"]] = r["u"]
    if not last:
        return fit([])
    table = sampled.filter(F.col("u") <= up_to(last)[F.col("lang")]).toArrow().sort_by([("lang", "ascending"), ("u", "ascending")])
    return fit([(name, np.frombuffer(ids, np.int32), np.frombuffer(counts, np.int32))
                for name, ids, counts in zip(*(table[c].to_pylist() for c in ("lang", "ids", "counts")), strict=True)])


ADDED = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep_text: bool = False) -> DataFrame:
    """docs with lang_pred, score and rejected; the text column only with keep_text.

    A null text, or one without a letter (Unicode category L), is und with score 0 and rejected, and so is any text
    where the model knows no language. Others get a learned language, its calibrated probability, and rejected where
    the calibration says so. An empty table gives an empty result; repeated rows are judged each by itself. Added
    columns replace columns of docs of the same name, in any case.
    """
    given = [c for c in others(docs.columns, *(f.name for f in ADDED)) if keep_text or c != text]
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            lang, score, rejected = [], [], []
            subwords = (ids for _, _, buf, starts in blocks(column) for ids in _subwords(buf, starts))
            for t, ids in zip(column, subwords, strict=True):
                if not m.languages or not LETTER.search(t.as_py() or ""):
                    lang.append("und")
                    score.append(0.0)
                    rejected.append(True)
                    continue
                k, p, out = m.judge(ids)
                lang.append(m.languages[k])
                score.append(p)
                rejected.append(out)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in given), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                [*given, *(f.name for f in ADDED)])

    return docs.mapInArrow(run, T.StructType([docs.schema[c] for c in given] + ADDED))
