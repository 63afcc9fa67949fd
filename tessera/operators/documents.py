"""Document ingestion: pages to paragraphs, sections, chunks, quality and coverage, each as joins, windows and folds.

A fold runs over the ordered units of one document, as the packing of chunks is sequential within a document;
documents run in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

def pages_of(docs: DataFrame, chars: int = 1500) -> DataFrame:
    """(doc_id, page, text): a document cut every so many characters; an empty document has one empty page."""
    t = F.coalesce("text", F.lit(""))
    n = F.greatest(F.ceil(F.length(t) / chars).cast("int"), F.lit(1))
    return docs.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(
        i.alias("page"), F.substring(t, (i - 1) * chars + 1, F.lit(chars)).alias("text")))).alias("p")).select("doc_id", "p.*")


def register(docs: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """One row per content: the first doc_id, the newest name, and how many documents have it."""
    every = docs if previous is None else docs.unionByName(previous)
    return every.groupBy(F.sha2("text", 256).alias("content_sha256")).agg(
        F.min_by("doc_id", "doc_id").alias("document_id"), F.max_by("source", "doc_id").alias("name"), F.count("*").alias("n_copies"))


def packed_sentences(text: Column, target: int) -> Column:
    """Sentences put together up to target characters."""
    start = F.struct(T.empty_strings().alias("out"), F.lit("").alias("cur"))
    fold = F.aggregate(
        F.split(text, "(?<=[。！？.!?；;])"), start,
        lambda a, s: F.when((a["cur"] != "") & (F.length(a["cur"]) + F.length(s) > target),
                            F.struct(F.array_append(a["out"], F.trim(a["cur"])).alias("out"), s.alias("cur")))
        .otherwise(F.struct(a["out"].alias("out"), F.concat(a["cur"], s).alias("cur"))),
        lambda a: F.array_append(a["out"], F.trim(a["cur"])))
    return F.filter(fold, lambda x: x != "")


def paragraphs(text: Column, target: int = 600) -> Column:
    """Paragraphs between blank lines; those over twice the target (at least 1000) are packed again by sentences."""
    parts = F.filter(F.transform(F.split(T.normalize(text), r"\n\s*\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.flatten(F.transform(parts, lambda p: F.when(F.length(p) > max(1000, 2 * target), packed_sentences(p, target)).otherwise(F.array(p))))


def line_paragraphs(text: Column, heading: str = r"^#{1,6} ", most: int = 900) -> Column:
    """Lines joined to paragraphs: a blank line, a heading or more than most characters starts a new one."""
    lines = F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), lambda x: F.trim(x))
    start = F.struct(T.empty_strings().alias("out"), T.empty_strings().alias("cur"))
    size = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + F.length(x))
    closed = lambda a: F.when(F.size(a["cur"]) > 0, F.array_append(a["out"], F.array_join(a["cur"], "\n"))).otherwise(a["out"])

    def step(a: Column, x: Column) -> Column:
        ends = x.rlike(heading) | (size(a["cur"]) + F.length(x) > most)
        return F.when(x == "", F.struct(closed(a).alias("out"), T.empty_strings().alias("cur"))).when(
            (F.size(a["cur"]) > 0) & ends, F.struct(closed(a).alias("out"), F.array(x).alias("cur"))).otherwise(
            F.struct(a["out"].alias("out"), F.array_append(a["cur"], x).alias("cur")))

    return F.aggregate(lines, start, step, closed)


def sentences(text: Column) -> Column:
    parts = F.split(T.collapse(text), r"(?<=[。！？；;])\s*|(?<=\.)\s+")
    return F.filter(F.transform(parts, lambda x: F.btrim(x, F.lit(" ，,；;。"))), lambda x: x != "")


def heading_of(paragraph: Column) -> Column:
    """The heading that a paragraph is: a Markdown heading, or a short numbered line; null for others."""
    marked = F.regexp_extract(F.trim(paragraph), r"^#{1,6}\s+(.+)$", 1)
    numbered = (F.length(F.trim(paragraph)) <= 80) & F.trim(paragraph).rlike(r"^\d+[.、]")
    return F.when(marked != "", F.substring(F.trim(marked), 1, 160)).when(numbered, F.trim(paragraph))


def section_paths(units: DataFrame, may_head: Column | None = None) -> DataFrame:
    """units (doc_id, page, no, text) with section and path carried down from headings.

    A heading of level one (one #, or a number with a dot) resets the path; any other replaces the second level. Where it is
    known which units may be headings, may_head says so, and others are none whatever they look like.
    """
    h = heading_of(F.col("text")) if may_head is None else F.when(may_head, heading_of(F.col("text")))
    top = h.isNotNull() & ~F.col("text").rlike(r"^#{2,6}\s")
    order = Window.partitionBy("doc_id").orderBy("page", "no").rowsBetween(Window.unboundedPreceding, 0)
    u = units.withColumn("heading", h.isNotNull()).withColumn("_top", F.when(top, h)).withColumn("_n", F.sum(top.cast("int")).over(order))
    u = u.withColumn("_first", F.last("_top", ignorenulls=True).over(order))
    under = Window.partitionBy("doc_id", "_n").orderBy("page", "no").rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("_second", F.last(F.when(h.isNotNull() & F.col("_top").isNull(), h), ignorenulls=True).over(under))
    return u.select("doc_id", "page", "no", "text", "heading", F.coalesce("_second", "_first", F.lit("")).alias("section"), F.concat_ws(" > ", "_first", "_second").alias("path"))


class _Packer:
    """Units of one document, in order, packed greedily to chunks; holds the units of the chunk that is being filled."""

    def __init__(self, chunk_chars: int, overlap: int, heading_share: float | None, separator: int):
        self.chunk_chars, self.overlap, self.separator = chunk_chars, overlap, separator
        self.heading_at = None if heading_share is None else int(chunk_chars * heading_share)
        self.start([], 0, [], "", "")
        self.made = 0

    def start(self, texts: list[str], held: int, pages: list[int], section: str, path: str) -> None:
        self.texts, self.held, self.section, self.path = texts, held, section, path
        self.first, self.last, self.page = min(pages, default=None), max(pages, default=None), pages[-1] if pages else None

    def chunk(self) -> tuple | None:
        text = "\n\n".join(x for x in self.texts if x.strip(" ")).strip(" ")
        if not text:
            return None
        self.made += 1
        return self.made - 1, self.first, self.last, self.section, self.path, text

    def add(self, text: str, page: int, section: str, path: str, heading: bool) -> tuple | None:
        """The chunk that ends before this unit, if one does."""
        full = self.held + len(text) > self.chunk_chars or self.heading_at is not None and heading and self.held >= self.heading_at
        if self.texts and full:
            done = self.chunk()
            whole = "\n\n".join(self.texts).strip(" ") if self.overlap > 0 else ""
            tail = whole[-self.overlap :].strip(" ") if whole else ""
            kept = [tail] if tail else []
            self.start([*kept, text], sum(len(x) + self.separator for x in (*kept, text)), [self.page, page], section or self.section, path or self.path)
            return done
        self.texts.append(text)
        self.held += len(text) + self.separator
        self.first, self.last, self.page = (page, page, page) if self.first is None else (min(self.first, page), max(self.last, page), page)
        if not self.section:
            self.section, self.path = section, path
        return None


def chunk_documents(units: DataFrame, drop_headings: bool = True, chunk_chars: int = 850, overlap: int = 150, heading_share: float | None = None, separator: int = 0) -> DataFrame:
    """(doc_id, chunk_index, page_start, page_end, section, path, text) from the units of section_paths, packed greedily to
    chunks of about chunk_chars characters.

    A chunk begins with the last overlap characters of the one before and the page on which that ended. Its section is
    the one at its beginning. With heading_share a heading also ends a chunk that is so far filled; separator counts so many
    characters for each joint. Units are sorted by Spark and read in Arrow batches with the open chunk carried from batch to
    batch: a document is never one row, however long it is. Units without a character are left out.
    """
    u = units.withColumn("text", F.btrim("text", F.lit(" \n\t"))).filter("text <> ''")
    u = u.filter("not heading") if drop_headings else u
    key = dict(units.dtypes)["doc_id"]
    names = ["doc_id", "chunk_index", "page_start", "page_end", "section", "path", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, packer, out = None, None, []
        for batch in batches:
            for d, page, text, section, path, heading, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if packer is None or d != doc:
                    if packer is not None and (done := packer.chunk()):
                        out.append((doc, *done))
                    doc, packer = d, _Packer(chunk_chars, overlap, heading_share, separator)
                if done := packer.add(text, page, section, path, heading):
                    out.append((doc, *done))
            yield as_batch(out, batch.schema.field(0).type)
            out = []
        if packer is not None and (done := packer.chunk()):
            yield as_batch([(doc, *done)], batch.schema.field(0).type)

    def as_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    # A window gathers and sorts documents as the fold needs them, without a shuffle where section_paths left them together.
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "no", "text"))
    dealt = u.select("doc_id", F.col("page").cast("int").alias("page"), "text", "section", "path", "heading", place.alias("place"))
    return dealt.mapInArrow(run, f"doc_id {key}, chunk_index int, page_start int, page_end int, section string, path string, text string")


def classified(text: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """The name of the first rule (name, pattern) that the text matches."""
    out = F.lit(other)
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def page_quality(pages: DataFrame) -> DataFrame:
    """Per document: counts of readable, empty and thin pages, the mean, likely_scanned, needs_ocr and status."""
    n = F.length(F.trim("text"))
    q = pages.groupBy("doc_id").agg(
        F.count("*").alias("page_count"), F.count_if(n >= 80).alias("readable"), F.count_if(n == 0).alias("empty"),
        F.count_if((n > 0) & (n < 80)).alias("low_text"), F.sum(n).alias("total_chars"))
    scanned = (F.col("readable") == 0) & (F.col("empty") + F.col("low_text") >= F.floor(F.col("page_count") * 0.8))
    mean = F.col("total_chars") / F.col("page_count")
    issue = (F.col("readable") / F.col("page_count") < 0.35) | (F.bround(mean, 1) < 60)
    ocr = scanned | (F.col("total_chars") == 0)
    return q.select("*", F.round(mean, 4).alias("mean_chars"), scanned.alias("likely_scanned"), ocr.alias("needs_ocr"),
                    F.when(ocr, "needs_ocr").when(issue, "needs_manual_check").otherwise("ok").alias("status"))


def page_ranges(pages: DataFrame, group: str = "doc_id") -> DataFrame:
    """Consecutive page numbers as ranges (group, first, last)."""
    island = F.col("page") - F.row_number().over(Window.partitionBy(group).orderBy("page"))
    return pages.select(group, "page").distinct().withColumn("_i", island).groupBy(group, "_i").agg(
        F.min("page").alias("first"), F.max("page").alias("last")).drop("_i")


def uncovered_ranges(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Ranges of pages that no block (doc_id, first, last) covers."""
    covered = blocks.select("doc_id", F.explode(F.sequence("first", "last")).alias("page")).distinct()
    return page_ranges(pages.join(covered, ["doc_id", "page"], "left_anti"))


def coverage(pages: DataFrame, sets: dict[str, DataFrame]) -> DataFrame:
    """pages with routes: the names of the page sets (doc_id, page) that hold each page, in the order given."""
    out = pages.select("doc_id", "page")
    for name, pages_in in sets.items():
        out = out.join(pages_in.select("doc_id", "page").distinct().withColumn(f"_{name}", F.lit(True)), ["doc_id", "page"], "left")
    routes = F.array_compact(F.array(*[F.when(F.col(f"_{n}"), n) for n in sets]))
    return out.select("doc_id", "page", routes.alias("routes"), (F.size(routes) == 0).alias("uncovered"))


def block_texts(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """The page-labelled text of each block (doc_id, first, last): a range join kept within documents."""
    b = blocks.select(F.col("doc_id").alias("_d"), "first", "last")
    joined = pages.join(b, (F.col("doc_id") == F.col("_d")) & F.col("page").between(F.col("first"), F.col("last")))
    parts = F.array_sort(F.collect_list(F.struct("page", "text")))
    return joined.groupBy("doc_id", "first", "last").agg(F.array_join(F.transform(
        parts, lambda x: F.concat(F.lit("[page "), x["page"], F.lit("]\n"), x["text"])), "\n").alias("block_text"))


def topic_pages(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, topic, source_pages, items) of items (key, topic, page, text): of each document's topic the pages it is on, in
    order and each once, and its texts, the first of those that agree but for case and blanks, in the order of their pages.

    What a topic has in one document is one row, so rows are bounded by documents. Null and blank texts add pages only.
    """
    said = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    first = items.withColumn("_k", said).filter("_k <> ''").groupBy(key, "topic", "_k").agg(F.min(F.struct("page", "text")).alias("i"))
    texts = first.groupBy(key, "topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("i.page", "_k", "i.text"))), lambda x: x["text"]).alias("items"))
    pages = items.groupBy(key, "topic").agg(F.array_sort(F.collect_set("page")).alias("source_pages"))
    same = [key, "topic"]
    return pages.join(texts, same, "left").select(*same, "source_pages", F.coalesce("items", T.empty_strings()).alias("items"))


#: Characters of a payload that a row to review shows.
REVIEW_CHARS = 2000


def validated_routes(rows: DataFrame, key: str, kind: str, payload: str, schemas: dict[str, tuple[str, list[str], dict[str, str]]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """({kind: (key, and the schema's fields)}, review (key, kind, errors, payload)) of JSON payloads by kind.

    A schema is the fields as DDL, those that must be there, and checks (what is wrong: condition that must hold; it may be
    null). A payload that is no JSON of the fields' types, lacks a field or fails a check, and a kind without a schema, is for
    review with all that is wrong with it, its payload cut to REVIEW_CHARS characters. Each row goes to one table.
    """
    typed, review = {}, []
    for name, (fields, required, checks) in schemas.items():
        own = rows.filter(F.col(kind) == name).select(key, F.col(kind).alias("kind"), F.col(payload).alias("payload"), F.from_json(
            F.coalesce(payload, F.lit("")), f"{fields}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("j"))
        own = own.select(key, "kind", "payload", "j.*")
        broken = F.col("_corrupt").isNotNull() | F.coalesce(F.trim("payload"), F.lit("")).eqNullSafe("")
        wrong = [F.when(~broken & F.col(f).isNull(), f"{f} is missing") for f in required] + [F.when(~broken & ~F.expr(c), said) for said, c in checks.items()]
        own = own.withColumn("errors", F.array_compact(F.array(F.when(broken, "not valid JSON"), *wrong)))
        typed[name] = own.filter(F.size("errors") == 0).drop("errors", "_corrupt", "kind", "payload")
        review.append(own.filter(F.size("errors") > 0).select(key, "kind", "errors", F.substring("payload", 1, REVIEW_CHARS).alias("payload")))
    known = F.coalesce(F.col(kind).isin(list(schemas)), F.lit(False))
    rest = rows.filter(~known).select(key, F.col(kind).alias("kind"), F.array(F.lit("no schema")).alias("errors"), F.substring(payload, 1, REVIEW_CHARS).alias("payload"))
    return typed, reduce(DataFrame.unionByName, review, rest)


def index_status(chunks: DataFrame, vectors: DataFrame, keys: list[str]) -> DataFrame:
    """(first key, chunks, embedded, status) of documents by their chunks (keys, text) and the vectors (keys) there are.

    A chunk counts from 80 characters on. Without one a document needs OCR; else all, some or none of them have a vector.
    """
    held = chunks.join(vectors.select(*keys).distinct().withColumn("_v", F.lit(True)), keys, "left")
    ok = F.coalesce(F.length(F.trim("text")) >= 80, F.lit(False))
    c = held.groupBy(keys[0]).agg(F.count_if(ok).alias("chunks"), F.count_if(ok & F.col("_v").isNotNull()).alias("embedded"))
    status = F.when(F.col("chunks") == 0, "needs_ocr").when(F.col("embedded") == F.col("chunks"), "indexed").when(F.col("embedded") > 0, "indexed_partial_vector").otherwise("indexed_lexical_only")
    return c.select(keys[0], "chunks", "embedded", status.alias("status"))


def newest_versions(files: DataFrame) -> DataFrame:
    """files (path): of directories base-YYYYMMDDHHMMSS the newest per parent and base; an unversioned twin is hidden."""
    f = files.select("path", F.regexp_extract("path", r"^(.*)/([^/]+?)(?:-(\d{14}))?$", 1).alias("parent"), F.regexp_extract("path", r"^(.*)/([^/]+?)(?:-(\d{14}))?$", 2).alias("base"),
                     F.regexp_extract("path", r"^(.*)/([^/]+?)(?:-(\d{14}))?$", 3).alias("version"))
    newest = Window.partitionBy("parent", "base").orderBy(F.col("version").desc(), "path")
    return f.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def top_per_key(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")
