"""Benchmark decontamination with an FM-index per training shard.

A shard is one Arrow batch of documents. Its word sequence is cut to the stretches whose word pairs all occur in some
test phrase (no other stretch can hold a phrase), indexed, and searched backward for all phrases at once. The
documents are never shuffled; what a task holds is one batch and the phrases of one group of test items. A test set of
more than PHRASE_WORDS words is dealt to groups, each of which takes a pass of its own over the documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import ALNUM, FOLD, blocks, hashes, owners, spans
from .common import bounded_batches, materialize, others

WINDOW = 10
#: Words of test items that one pass over the documents carries, about; more items take more passes.
PHRASE_WORDS = 2_000_000
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Symbols of one index.
SHARD_SYMBOLS = 1 << 20
SAMPLE = 8
WORD_CHARACTER = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def suffix_array(ranks: np.ndarray) -> np.ndarray:
    """By prefix doubling, until all ranks differ: the last symbol must differ from all others."""
    n, step = len(ranks), 1
    ranks = np.unique(ranks, return_inverse=True)[1].astype(np.int64)
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = ranks[step:] + 1
        key = ranks * (n + 1) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        ranks[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        if ranks[order[-1]] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Of a sequence of symbols; 0 separates stretches and is in no phrase."""

    def __init__(self, text: np.ndarray, symbols: int):
        n = len(text)
        apart = text == 0
        gaps = int(apart.sum())
        # Separators differ from each other, so that no comparison runs past one.
        ranks = np.where(apart, np.cumsum(apart) - 1, text.astype(np.int64) - 1 + gaps)
        sa = suffix_array(ranks)
        self.bwt = text[sa - 1]
        self.bwt[sa == 0] = 0
        self.below = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
        # Positions that lead a stretch are kept too: no step back goes past a separator.
        self.kept = (sa % SAMPLE == 0) | (self.bwt == 0)
        self.kept_at = np.cumsum(self.kept) - 1
        self.positions = sa[self.kept]
        # A wavelet tree in matrix form: a level for each bit, zeros before ones.
        self.levels = []
        now = self.bwt
        for bit in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            ones = ((now >> bit) & 1).astype(bool)
            upto = np.concatenate(([0], np.cumsum(ones))).astype(np.int32)
            self.levels.append((bit, upto, n - int(upto[-1])))
            now = np.concatenate((now[~ones], now[ones]))
        self.first = self._descend(np.arange(symbols), np.zeros(symbols, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, upto, zeros in self.levels:
            ones = upto[at]
            at = np.where((symbol >> bit) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of symbol are among the first at symbols of the transform."""
        return self._descend(symbol, at) - self.first[symbol]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, first row, end row) of the phrases that occur. phrases: right-aligned, one a row."""
        width = phrases.shape[1]
        live = np.arange(len(phrases))
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.bwt), np.int64)
        out = []
        for step in range(1, width + 1):
            c = phrases[live, width - step]
            lo, hi = self.below[c] + self.rank(c, lo), self.below[c] + self.rank(c, hi)
            found = lo < hi
            live, lo, hi = live[found], lo[found], hi[found]
            ended = lengths[live] == step
            out.append((live[ended], lo[ended], hi[ended]))
            live, lo, hi = live[~ended], lo[~ended], hi[~ended]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, walking back to sampled ones."""
        out = np.zeros(len(rows), np.int64)
        todo, row, steps = np.arange(len(rows)), rows, 0
        while len(todo):
            known = self.kept[row]
            out[todo[known]] = self.positions[self.kept_at[row[known]]] + steps
            todo, row, steps = todo[~known], row[~known], steps + 1
            c = self.bwt[row]
            row = self.below[c] + self.rank(c, row)
        return out


@dataclass
class Phrases:
    vocabulary: np.ndarray  # sorted hashes; symbol k + 1 is vocabulary[k]
    pairs: np.ndarray  # sorted keys of neighbouring symbols
    windows: np.ndarray  # right-aligned symbols
    lengths: np.ndarray
    items: list[np.ndarray]  # the items of each window
    names: list[str]

    @property
    def shortest(self) -> int:
        return int(self.lengths.min()) if len(self.lengths) else 0


def phrases_of(items: list[tuple[str, str]], window: int = WINDOW) -> Phrases:
    """The windows of test items (id, text). Items without a word have none."""
    texts = pa.array([t for _, t in items], pa.string())
    words: list[np.ndarray] = []
    for _, _, buf, starts in blocks(texts):
        buf = FOLD[buf]
        s, e = spans(buf, ALNUM)
        h, own = hashes(buf, s, e), owners(s, starts)
        words += [h[own == k] for k in range(len(starts) - 1)]
    vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
    found: dict[tuple[int, ...], set[int]] = {}
    pairs = set()
    for i, h in enumerate(words):
        ids = (np.searchsorted(vocabulary, h) + 1).tolist()
        pairs.update(zip(ids, ids[1:], strict=False))
        for k in range(max(1, len(ids) - window + 1)) if ids else ():
            found.setdefault(tuple(ids[k : k + window]), set()).add(i)
    keys = list(found)
    right = np.zeros((len(keys), window), np.int64)
    for r, key in enumerate(keys):
        right[r, window - len(key) :] = key
    v = len(vocabulary) + 1
    return Phrases(
        vocabulary, np.array(sorted(a * v + b for a, b in pairs), np.int64), right, np.array([len(k) for k in keys], np.int64),
        [np.array(sorted(found[k])) for k in keys], [name for name, _ in items])


def _among(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_keys, keys), max(0, len(sorted_keys) - 1))
    return at, sorted_keys[at] == keys if len(sorted_keys) else np.zeros(len(keys), bool)


@dataclass
class Found:
    """Of one batch: words of each text, and of the words inside occurrences their text and byte span (buffer-free)."""

    n_words: np.ndarray
    hit_text: np.ndarray
    hit_from: np.ndarray
    hit_to: np.ndarray
    item_text: np.ndarray
    item: np.ndarray


def search_batch(texts: pa.Array, phrases: Phrases, every_stretch: bool = False) -> Found:
    """Occurrences in a batch. every_stretch: index all texts' words, not only stretches that can hold a phrase."""
    n = len(texts)
    n_words = np.zeros(n, np.int64)
    none = np.zeros(0, np.int64)
    kept: list[tuple[np.ndarray, ...]] = []
    shards: list[Found] = []
    held = 0

    def flush() -> None:
        nonlocal kept, held
        if kept:
            shards.append(_search_shard(phrases, *(np.concatenate(x) for x in zip(*kept, strict=True))))
        kept, held = [], 0

    v = len(phrases.vocabulary) + 1
    for first, end, buf, starts in blocks(texts):
        buf = FOLD[buf]
        s, e = spans(buf, ALNUM)
        own = owners(s, starts)
        n_words[first:end] = np.bincount(own, minlength=end - first)
        if not len(phrases.lengths):
            continue
        at, known = _among(phrases.vocabulary, hashes(buf, s, e))
        ids = np.where(known, at + 1, 0)
        # A word stays if it is in a stretch, all of whose neighbours are pairs of a phrase, as long as the shortest phrase.
        if every_stretch:
            if len(ids):
                kept.append((ids, own, own + first, s - starts[own], e - starts[own]))
                held += len(ids)
            if held >= SHARD_SYMBOLS:
                flush()
            continue
        linked = np.zeros(len(ids) + 1, bool)
        maybe = np.flatnonzero(known[1:] & known[:-1] & (own[1:] == own[:-1]))
        linked[maybe[_among(phrases.pairs, ids[maybe] * v + ids[maybe + 1])[1]] + 1] = True
        head = np.flatnonzero(known & ~linked[:-1])  # a known word that the one before does not lead to
        tail = np.flatnonzero(known & ~linked[1:]) + 1
        long = tail - head >= phrases.shortest
        head, tail = head[long], tail[long]
        if not len(head):
            continue
        size = tail - head
        words = np.repeat(head - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        stretch = np.repeat(np.arange(len(head)), size)
        kept.append((ids[words], stretch, own[words] + first, s[words] - starts[own[words]], e[words] - starts[own[words]]))
        held += len(words)
        if held >= SHARD_SYMBOLS:
            flush()
    flush()
    if not shards:
        return Found(n_words, none, none, none, none, none)
    return Found(n_words, *(np.concatenate([getattr(x, k) for x in shards]) for k in ("hit_text", "hit_from", "hit_to", "item_text", "item")))


def _search_shard(phrases: Phrases, ids: np.ndarray, stretch: np.ndarray, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> Found:
    # Separators go behind each stretch.
    last = np.flatnonzero(np.concatenate(((stretch[1:] != stretch[:-1]) | (text[1:] != text[:-1]), [True])))
    shift = np.zeros(len(ids), np.int64)
    shift[last[:-1] + 1] = 1
    place = np.arange(len(ids)) + np.cumsum(shift)
    sequence = np.zeros(len(ids) + len(last), np.int64)
    sequence[place] = ids
    word = np.full(len(sequence), -1, np.int64)
    word[place] = np.arange(len(ids))
    index = FMIndex(sequence, len(phrases.vocabulary) + 1)
    which, lo, hi = index.search(phrases.windows, phrases.lengths)
    count = hi - lo
    which = np.repeat(which, count)
    rows = np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
    at = index.locate(rows)
    # Merge: words inside any occurrence.
    edge = np.zeros(len(sequence) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + phrases.lengths[which], -1)
    hit = word[np.flatnonzero(np.cumsum(edge)[:-1] > 0)]
    owner = text[word[at]]
    sizes = np.array([len(phrases.items[w]) for w in which], np.int64)
    items = np.concatenate([phrases.items[w] for w in which]) if len(which) else np.zeros(0, np.int64)
    each = np.unique(np.repeat(owner, sizes) * len(phrases.names) + items)
    return Found(None, text[hit], start[hit], end[hit], each // max(1, len(phrases.names)), each % max(1, len(phrases.names)))


def _points(text: str, offsets: np.ndarray) -> np.ndarray:
    """Code points before byte offsets of a text."""
    lead = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
    return np.concatenate(([0], np.cumsum(lead)))[offsets]


RESULT = [
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("item_ids", T.ArrayType(T.StringType())),
    T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))]
_RESULT_TYPES = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]


def _merged(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, joined where they meet or no word lies between."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and (a <= out[-1][1] or not WORD_CHARACTER.search(text, out[-1][1], a)):
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scan(texts: pa.Array, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, list[set[str]], dict[int, list[tuple[int, int]]]]:
    """Words and hit words of each text, its items, and the spans to remove by row."""
    items: list[set[str]] = [set() for _ in range(len(texts))]
    found = search_batch(texts, phrases)
    hits = np.unique(np.stack((found.hit_text, found.hit_from, found.hit_to), axis=1), axis=0)
    for t, i in zip(found.item_text.tolist(), found.item.tolist(), strict=True):
        items[t].add(phrases.names[i])
    removed: dict[int, list[tuple[int, int]]] = {}
    for part in np.split(hits, np.flatnonzero(np.diff(hits[:, 0])) + 1) if len(hits) else ():
        t = int(part[0, 0])
        text = texts[t].as_py()
        removed[t] = _merged(text, list(zip(_points(text, part[:, 1]).tolist(), _points(text, part[:, 2]).tolist(), strict=True)))
    return found.n_words, np.bincount(hits[:, 0], minlength=len(texts)), items, removed


def _without(text: str, parts: list[tuple[int, int]]) -> str:
    for a, b in reversed(parts):
        text = text[:a] + "\n" + text[b:]
    return text


def _groups(benchmark: DataFrame) -> list[DataFrame]:
    """The test items in groups of about PHRASE_WORDS words, by a hash of their ids."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.regexp_count("text", F.lit(WORDS.pattern)))).first()[0] or 0
    n = max(1, -(-total // PHRASE_WORDS))
    return [items.filter(F.coalesce(F.pmod(F.xxhash64("item_id"), F.lit(n)), F.lit(0)) == k) for k in range(n)]


def _phrases(group: DataFrame, window: int) -> Phrases:
    return phrases_of(sorted((str(r["item_id"]), r["text"]) for r in group.collect()), window)


def find_phrases(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", cut: bool = False) -> DataFrame:
    """docs with n_words, n_hit, item_ids (sorted as strings) and removed (spans in code points, merged).

    benchmark has item_id and text, of any number of items. Words are runs of digits, letters a to z (A to Z folded) and characters beyond
    ASCII. A phrase is a window of so many consecutive words of an item, or the whole of a shorter one. Without cut the
    text column is left out of the result; with it, texts come back without the removed spans, each replaced by a line
    feed, searched again until none is left. Null texts have no words and stay null; an empty benchmark hits nothing, an
    empty table gives an empty result;
    repeated item ids are one item, repeated documents are searched each by itself. Added columns replace columns of
    docs of the same name, in any case.
    """
    bounded_batches(docs.sparkSession)
    groups = _groups(benchmark)
    given = [c for c in others(docs.columns, *(f.name for f in RESULT)) if cut or c != text]
    columns = list(dict.fromkeys([*given, text]))
    names = [f.name for f in RESULT]
    found = _search(docs.select(*[f"`{c}`" for c in columns]), groups, window, text, columns, cut and len(groups) == 1)
    if cut and len(groups) > 1:
        # What is cut out can bring words together: all groups again, until nothing is found.
        found = materialize(found, "phrases-found")
        now = _cut(found, text).select(F.col(f"`{text}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in [*columns, *names]]).alias("__row"))
        while True:
            again = materialize(_search(now, groups, window, "text", ["text", "__row"], False), "phrases-found")
            if not again.filter("n_hit > 0").limit(1).count():
                break
            now = _cut(again, "text").select("text", "__row")
        found = now.select(*[(F.col("text") if c == text else F.col("__row").getField(c)).alias(c) for c in [*columns, *names]])
    return found.select(*[f"`{c}`" for c in given], *names)


def _search(docs: DataFrame, groups: list[DataFrame], window: int, text: str, columns: list[str], cut: bool) -> DataFrame:
    """columns and RESULT, by one pass a group."""
    found = _pass(docs, _phrases(groups[0], window), text, columns, cut, False)
    for group in groups[1:]:
        found = _pass(materialize(found, "phrases-found"), _phrases(group, window), text, columns, False, True)
    return found


def _cut(found: DataFrame, text: str) -> DataFrame:
    """The texts without the removed spans, each replaced by a line feed."""
    spans, whole = F.col("removed"), F.col(f"`{text}`")
    n = F.size(spans)
    pieces = F.transform(F.sequence(F.lit(0), n), lambda k: F.substring(
        whole, (F.when(k == 0, 0).otherwise(F.get(spans, k - 1)["end"]) + 1).cast("int"),
        (F.when(k == n, F.length(whole)).otherwise(F.get(spans, k)["start"]) - F.when(k == 0, 0).otherwise(F.get(spans, k - 1)["end"])).cast("int")))
    return found.withColumn(text, F.when(n > 0, F.array_join(pieces, "\n")).otherwise(whole))


def _pass(docs: DataFrame, phrases: Phrases, text: str, columns: list[str], cut: bool, before: bool) -> DataFrame:
    """columns and RESULT of docs; before: docs has RESULT from other phrases, and what these hit is added to it."""
    shared = docs.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            values = {c: batch.column(batch.schema.get_field_index(c)) for c in columns}
            n_words, n_hit, items, removed = _scan(values[text], own)
            if before:
                n_hit = n_hit.copy()
                for t, (parts, names) in enumerate(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("removed", "item_ids")), strict=True)):
                    items[t].update(names)
                    if parts:
                        whole = values[text][t].as_py()
                        removed[t] = _merged(whole, [(x["start"], x["end"]) for x in parts] + removed.get(t, []))
                        n_hit[t] = sum(len(WORDS.findall(whole, a, b)) for a, b in removed[t])
            result = [
                pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(x) for x in items], _RESULT_TYPES[2]),
                pa.array([[{"start": a, "end": b} for a, b in removed.get(t, [])] for t in range(len(items))], _RESULT_TYPES[3])]
            if cut and removed:
                texts = values[text].to_pylist()
                while removed:
                    for t, parts in removed.items():
                        texts[t] = _without(texts[t], parts)
                    again = sorted(removed)
                    more = _scan(pa.array([texts[t] for t in again], pa.string()), own)[3]
                    removed = {again[t]: parts for t, parts in more.items()}
                values[text] = pa.array(texts, values[text].type)
            yield pa.RecordBatch.from_arrays([*(values[c] for c in columns), *result], [*columns, *(f.name for f in RESULT)])

    return docs.mapInArrow(run, T.StructType([docs.schema[c] for c in columns] + RESULT))
