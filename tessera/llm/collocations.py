"""Phrase collocations by stripes: each prefix keys an associative counter of the words that follow it.

Level k has the stripes of prefixes of k - 1 words. A task counts them for a batch of texts in numpy and sends their entries
packed. Stripes of one prefix are merged element by element, by a sum for each (prefix, next word), so that no row or
task holds the whole stripe of a frequent prefix. An entry is an extension and so the count of a phrase, the sum of the
stripe of the empty prefix is the number of words, and the largest entries of the stripes tell which phrases are always part of
a longer one.

A phrase is frequent only if all phrases inside it are. The texts are read four times: for words; for hashes of pairs of
frequent words, a number each; for pairs and triples of pairs whose hashes are frequent; for longer phrases of frequent
triples. What is frequent is told by a Bloom filter of 64 million bits at any size of the input, built by Spark and sent
to the tasks. Bits or hashes that others share only let more be counted; the counts themselves are exact.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, join_hot, materialize

#: Each byte as counted: A to Z lowered, what ends a piece as a full stop, a tab as a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 46 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
EDGE = b"."
#: Bits of the filter between levels.
FILTER_BITS = 1 << 26
#: Entries of stripes in a batch on the way to Spark.
SENT = 100_000
#: Parts of a language's phrases that are ranked apart first.
SALTS = 32


def _mixed(words: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hashes of all k neighbouring word hashes."""
    n = len(words) - k + 1
    h = np.full(max(n, 0), seed, np.uint64)
    for j in range(k if n > 0 else 0):
        h = (h ^ words[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash in a filter of a power of two of bits."""
    most = np.uint64(bits - 1)
    return h & most, (h >> np.uint64(36)) & most


def _held(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), bool)
    for at in _places(h, 64 * len(bits)):
        out &= (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out


def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), 7)


def _short(h: np.ndarray) -> np.ndarray:
    """32 bits of each hash."""
    return h >> np.uint64(32)


def _long(short: np.ndarray) -> np.ndarray:
    """A hash of 64 bits for each of 32."""
    return _mixed(short, 1, 11)


@dataclass
class Likely:
    """Phrases of k words that may be frequent: those that the filter holds, by their hashes or by 32 bits of them."""

    k: int
    short: bool
    bits: Broadcast

    def of(self, words: np.ndarray, seed: int) -> np.ndarray:
        h = _mixed(words, self.k, seed)
        return _held(self.bits.value, _long(_short(h)) if self.short else h)


def _numbered(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The words of texts as numbers, 0 where a piece ends, and the words by number."""
    tokens = EDGE.join(texts).translate(FOLD).replace(EDGE, b" . ").split()
    ids: defaultdict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    ids[EDGE]  # edges have number 0
    return np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens)), list(ids)


def _fits(w: np.ndarray, held: np.ndarray | None, base: int, k: int) -> np.ndarray:
    """Where phrases of k words begin that hold no edge and, of base words, only likely ones."""
    n = max(0, len(w) - k + 1)
    fits = np.ones(n, bool)
    for j in range(k):
        fits &= w[j : j + n] != 0
    for j in range(k - base + 1 if held is not None else 0):
        fits &= held[j : j + n]
    return np.flatnonzero(fits)


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, list[bytes], np.ndarray]]:
    """(lang, words as numbers, words, hashes of the words in place) of each language of a batch (lang, text)."""
    texts = defaultdict(list)
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        texts[lang].append(text)
    for lang, own in texts.items():
        w, names = _numbered(own)
        yield lang, w, names, np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))[w]


def _entries(docs: DataFrame, ks: list[int], likely: Likely | None, sent: int) -> DataFrame:
    """(k, lang, prefix, word, a): the merged stripes of phrases of k words, for all ks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, w, names, hashes in _by_lang(batch):
                held = likely.of(hashes, _seed(lang)) if likely else None
                words = pa.array(names, pa.binary()).cast(pa.string())
                for k in ks:
                    yield from packed(lang, w, words, k, _fits(w, held, likely.k if likely else 0, k))

    def packed(lang: str, w: np.ndarray, words: pa.Array, k: int, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows of up to sent entries: the prefixes, and of each entry its prefix, word and count."""
        most, prefix = len(words), np.zeros(len(at), np.int64)
        for j in range(k - 1):  # numbers of prefixes, exact: no hashes
            prefix = np.unique(prefix * most + w[at + j], return_inverse=True)[1]
        pair, first, count = np.unique(prefix * most + w[at + k - 1], return_index=True, return_counts=True)
        where, prefix = at[first], pair // most
        for a in range(0, len(pair), sent):
            own, one, of = np.unique(prefix[a : a + sent], return_index=True, return_inverse=True)
            said = [words.take(pa.array(w[where[a + one] + j])) for j in range(k - 1)]
            texts = pc.binary_join_element_wise(*said, " ") if said else pa.array([""] * len(own), pa.string())
            nexts = words.take(pa.array(w[where[a : a + sent] + k - 1]))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (texts, pa.array(of.astype(np.int32)), nexts, pa.array(count[a : a + sent]))]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([lang]), *lists], ["k", "lang", "prefixes", "at", "words", "counts"])

    stripes = docs.mapInArrow(run, "k int, lang string, prefixes array<string>, at array<int>, words array<string>, counts array<long>")
    entries = stripes.select("k", "lang", "prefixes", F.explode(F.arrays_zip("at", "words", "counts")).alias("e"))
    entries = entries.select("k", "lang", F.get("prefixes", F.col("e.at")).alias("prefix"), F.col("e.words").alias("word"), F.col("e.counts").alias("n"))
    return entries.groupBy("k", "lang", "prefix", "word").agg(F.sum("n").alias("a"))


def _pairs(docs: DataFrame, likely: Likely, sent: int) -> DataFrame:
    """(hash, a): how often pairs of likely words of one short hash occur, in any language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for lang, w, _, hashes in _by_lang(batch):
                at = _fits(w, likely.of(hashes, _seed(lang)), 1, 2)
                found.append(_short(_mixed(hashes, 2, _seed(lang))[at] if len(at) else hashes[:0]))
            keys, n = np.unique(np.concatenate(found), return_counts=True)
            for a in range(0, len(keys), sent):
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in (keys[a : a + sent].astype(np.int64), n[a : a + sent].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(lists, ["hashes", "counts"])

    found = docs.mapInArrow(run, "hashes array<long>, counts array<int>").select(F.explode(F.arrays_zip("hashes", "counts")).alias("e"))
    return found.groupBy(F.col("e.hashes").alias("hash")).agg(F.sum("e.counts").alias("a"))


def _filter(hashed: DataFrame, size: int) -> Broadcast:
    """The Bloom filter of the hashes in a table's only column, as an array of 64 bits each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_places(h, size)).astype(np.int64))], ["bit"])

    parts = hashed.mapInArrow(run, "bit long").groupBy(F.expr("shiftright(bit, 6)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 AS int)))").alias("bits"))
    got = parts.toArrow()  # a row for each 64 bits of the filter at most, 1,048,576 by default
    bits = np.zeros(size >> 6, np.int64)
    bits[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    return hashed.sparkSession.sparkContext.broadcast(bits.view(np.uint64))


def _hashes(phrases: DataFrame) -> DataFrame:
    """The hash of each (lang, phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.empty(len(batch), np.uint64)
            for i, (lang, phrase) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                words = np.array([xxhash.xxh64_intdigest(x) for x in phrase.encode().split(b" ")], np.uint64)
                h[i] = _mixed(words, len(words), _seed(lang))[0]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    return phrases.select("lang", "phrase").mapInArrow(run, "h long")


def _lengthened(hashes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_long(batch.column(0).to_numpy().view(np.uint64)).view(np.int64))], ["h"])

    return hashes.mapInArrow(run, "h long")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5, top: int = 2000,
                 filter_bits: int = FILTER_BITS, sent: int = SENT) -> DataFrame:
    """The best top phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A-Z are lowered, texts cut at .,;:!? and line ends into pieces and those at blanks and tabs into words. Candidates are the
    phrases of 2 to longest words that occur least times or more in a language. The score is the lowest over all cuts of
    floor(1000 * a * n / (l * r)); the rank orders by score and a descending, then by phrase. A candidate that is always part of
    a longer one is left out: one word more on either side shows it, as no phrase between the two can be rarer than the
    longer or more frequent than the shorter. filter_bits (a power of two from 64 on) and sent bound memory and
    don't change the result. A null text is empty, a null lang is 'und', as is one so called; an empty
    table gives an empty result. Repeated rows count each. Columns of docs other than the two are left out, so no name
    clashes. A text may be as long as a batch of Arrow holds.
    """
    spark = docs.sparkSession
    bounded_batches(spark, megabytes=8)
    given = docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.coalesce(text, F.lit("")).cast("binary").alias("text"))

    def phrases(entries: DataFrame) -> DataFrame:
        phrase = F.when(F.col("prefix") == "", F.col("word")).otherwise(F.concat_ws(" ", "prefix", "word")).alias("phrase")
        return entries.filter(F.col("a") >= least).select("lang", phrase, "prefix", "a", F.col("k").alias("m"))

    words = materialize(_entries(given, [1], None, sent), "stripes")
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    likely = Likely(1, False, _filter(_hashes(phrases(words)), filter_bits))
    pairs = _pairs(given, likely, sent).filter(F.col("a") >= least).select("hash")
    likely = Likely(2, True, _filter(_lengthened(pairs), filter_bits))
    levels = [materialize(phrases(_entries(given, [k for k in (2, 3) if k <= longest], likely, sent)), "stripes")]
    if longest > 3:
        likely = Likely(3, False, _filter(_hashes(levels[0].filter("m = 3")), filter_bits))
        levels.append(materialize(phrases(_entries(given, list(range(4, longest + 1)), likely, sent)), "stripes"))
    candidates = reduce(DataFrame.unionByName, levels)
    counts = phrases(words).unionByName(candidates.filter(F.col("m") < longest)).select("lang", "phrase", F.col("a").alias("f"))

    # Largest entries of stripes with one word more, after the phrase (its own stripe) and before it.
    longer = candidates.filter("m > 2").select("lang", "a", F.explode(F.array("prefix", F.expr("substring(phrase, locate(' ', phrase) + 1)"))).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    candidates = candidates.join(most.hint("merge"), ["lang", "phrase"], "left").filter("most is null or most < a")
    candidates = materialize(candidates.select("lang", "phrase", "m", "a"), "candidates")
    cut = F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k")
    cuts = candidates.select("lang", "phrase", "a", cut).withColumn("first", F.expr("substring_index(phrase, ' ', k)"))
    cuts = materialize(cuts.withColumn("rest", F.expr("substring(phrase, length(first) + 2)")), "cuts")
    total = cuts.count()
    for side, name in (("first", "l"), ("rest", "r")):
        keys = ["lang", side]
        cuts = join_hot(cuts, counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), keys, cuts.groupBy(*keys).agg(F.count("*").alias("n")), total)
    cuts = join_hot(cuts, totals, ["lang"], candidates.groupBy("lang").agg(F.sum(F.col("m") - 1).alias("n")), total)
    wide = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  products may pass 64 bits
    scored = cuts.withColumn("x", (wide("a") * wide("n")).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")).withColumn("y", wide("l") * wide("r"))
    scored = scored.withColumn("score", F.expr("x div y"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt")
    part = best.select("*", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

