"""Secret scans with multipart credential linking.

One pass over the documents finds the base kinds and the parts that mean little alone: access identifiers (named ids,
e-mail addresses), secrets (random runs) and endpoints (urls, IPv4 addresses). Parts are then joined by interval within
their scope (a stretch without a blank line): a sorted sweep gives each part the nearest complementary part on either
side, so a scope with many parts makes no pairs. Weak parts are reported only where what they need lies within reach;
each secret so met is a link with its nearest identifier and endpoint. Only parts are shuffled, never texts.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialize

KINDS = ("assign", "access", "hex", "linked_id", "linked_secret", "linked_endpoint")
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
HEX = re.compile(r"[0-9a-f]+")
NAMED_ID = re.compile(r"""(?:client|access|account|key|tenant)[_-]?(?:key[_-]?)?id["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{6,})""", re.IGNORECASE | re.ASCII)
NAMED_ID_WORDS = ("id=", "id:", 'id"', "id'", "id ")
EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+")
ENDPOINT = re.compile(r"[a-z][a-z0-9+.-]{1,11}://[^\s\"'<>]{4,}")
ADDRESS = re.compile(r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9.]*[0-9])")
BLANK_LINE = re.compile(r"\n[ \t\r]*\n")
#: Bits a character that a run needs to count as a possible secret.
LEAST_ENTROPY = 3.5


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int, bool]]]:
    """Base spans (kind, start, end), and parts (kind 3 to 5, scope, start, end, weak); base kinds are strong parts."""
    low = text.lower()
    base: list[tuple[int, int, int]] = []
    parts: list[tuple[int, int, int, bool]] = []
    if any(w in low for w in ASSIGN_WORDS):
        base += [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        base += [(1, *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    runs = [m.span() for m in RUN.finditer(text)]
    for a, b in runs:  # every run of 24 hexadecimal digits lies in one
        base += [(2, *m.span()) for m in HEX.finditer(text, a, b) if m.end() - m.start() >= 24]
    if "://" in text:
        parts += [(5, *m.span(), True) for m in ENDPOINT.finditer(text)]
    if "id" in low and any(w in low for w in NAMED_ID_WORDS):
        parts += [(3, *m.span(1), True) for m in NAMED_ID.finditer(text)]
    if "@" in text:
        parts += [(3, *m.span(), True) for m in EMAIL.finditer(text)]
    parts += [(5, *m.span(), True) for m in ADDRESS.finditer(text)]
    # Base spans joined where they overlap: starts and ends both ascend, so the last that begins before b decides.
    starts, ends = [], []
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def free(a: int, b: int) -> bool:
        k = bisect_left(starts, b)
        return not k or ends[k - 1] <= a

    for a, b in runs:
        s = text[a:b]
        if free(a, b) and any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and "/" not in s[:1] and _entropy(s) >= LEAST_ENTROPY:
            parts.append((4, a, b, True))
    parts = [x for x in parts if x[0] == 5 or free(x[1], x[2])]
    if not parts:
        return base, []
    parts += [(3 if kind == 1 else 4, a, b, False) for kind, a, b in base]
    scopes = [m.start() for m in BLANK_LINE.finditer(text)]
    return base, [(kind, bisect_right(scopes, a), a, b, weak) for kind, a, b, weak in parts]


def find_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id", reach: int = 400) -> DataFrame:
    """One row per row of docs: key, n_assign, n_access, n_hex, base, linked (arrays of start, kind number and end) and links.

    Offsets are code points, ends exclusive. base holds every match of the base kinds. A weak part is in linked only
    where its complement lies in the same scope within reach characters: an identifier or a secret needs the other of
    the two, an endpoint needs both. links has, for each secret (base or weak) that has an identifier within reach, the
    spans secret, identifier (the nearest, the one before on a tie) and endpoint (likewise, null where none is within
    reach). A null text is empty. Rows of equal key and text have equal results; an empty table gives an empty result.
    Columns of docs other than key and text are left out, so no name clashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, parts = [], []
            for t in batch.column(2):
                b, p = scan(t.as_py() or "")
                base.append([{"start": x, "kind": k, "end": y} for x, k, y in sorted((x, k, y) for k, x, y in b)])
                parts.append([{"kind": k, "scope": s, "start": x, "end": y, "weak": w} for k, s, x, y, w in p])
            span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
            part = pa.list_(pa.struct([("kind", pa.int32()), ("scope", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("weak", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base, span), pa.array(parts, part)], [key, "_h", "base", "parts"])

    bounded_batches(docs.sparkSession)
    given = docs.select(F.col(key), F.xxhash64(text).alias("_h"), F.col(text))
    kind = docs.schema[key].dataType.simpleString()
    scanned = materialize(given.mapInArrow(
        run, f"`{key}` {kind}, _h long, base array<struct<start:long,kind:int,end:long>>, parts array<struct<kind:int,scope:long,start:long,end:long,weak:boolean>>"), "secrets")

    def has(k: int) -> Column:
        return F.exists("parts", lambda x: x["kind"] == k)

    rows = scanned.filter(has(3) & has(4)).dropDuplicates([key, "_h"]).select(key, "_h", F.explode("parts").alias("p")).select(key, "_h", "p.*")
    scope = Window.partitionBy(key, "_h", "scope").orderBy("start", "end", "kind")
    back, ahead = scope.rowsBetween(Window.unboundedPreceding, 0), scope.rowsBetween(0, Window.unboundedFollowing)
    span = F.struct("start", "kind", "end")

    def near(k: int) -> Column:
        """The nearest part of kind k that ends before or starts after within reach, else null."""
        of_kind = F.col("kind") == k
        before = F.max(F.when(of_kind, F.struct(F.col("end").alias("at"), span.alias("s")))).over(back)
        after = F.min(F.when(of_kind, F.struct(F.col("start").alias("at"), span.alias("s")))).over(ahead)
        away = F.when(before.isNotNull(), F.greatest(F.col("start") - before["at"], F.lit(0))), F.when(after.isNotNull(), F.greatest(after["at"] - F.col("end"), F.lit(0)))
        found = F.when(away[1].isNull() | (away[0] <= away[1]), F.struct(away[0].alias("away"), before["s"].alias("s"))).otherwise(
            F.struct(away[1].alias("away"), after["s"].alias("s")))
        return F.when(found["away"] <= reach, found["s"])

    met = rows.withColumn("id", near(3)).withColumn("secret", near(4)).withColumn("endpoint", near(5))
    met = met.filter(F.col("id").isNotNull() & F.col("secret").isNotNull())
    linked = met.groupBy(key, "_h").agg(
        F.array_sort(F.collect_set(F.when(F.col("weak"), span))).alias("linked"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == 4, F.struct(
            span.alias("secret"), F.col("id").alias("identifier"), F.col("endpoint").alias("endpoint"))))).alias("links"))
    linked = linked.select(F.col(key).alias("_k"), F.col("_h").alias("_g"), "linked", "links")
    out = scanned.join(linked, scanned[key].eqNullSafe(F.col("_k")) & (F.col("_h") == F.col("_g")), "left")

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")

    return out.select(
        key, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), "base",
        F.coalesce("linked", F.array().cast("array<struct<start:long,kind:int,end:long>>")).alias("linked"), F.coalesce("links", F.array().cast(
            "array<struct<secret:struct<start:long,kind:int,end:long>,identifier:struct<start:long,kind:int,end:long>,endpoint:struct<start:long,kind:int,end:long>>>")).alias("links"))


def spans_text(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["end"])), ",")
