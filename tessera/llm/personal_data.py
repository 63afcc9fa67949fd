"""Personal data by weak supervision, in DataFrame functions.

Patterns find spans: the base kinds, which stay whatever is learned, and weaker ones (numbers with separators, handles and
written-out addresses, names after a title). Labelers vote on each span or abstain: checks of its own shape (patterns), lists
of names, providers and role accounts (gazetteers), and what stands before and after it (context). Expectation-maximisation
over the counts of vote patterns estimates how reliable each labeler is without a label; the spans' probabilities under
it train a logistic regression over features of spans, which also judges those on which all labelers abstain. Weak spans that
it finds personal are added.

Texts are read once and never shuffled: what moves is a row for each match, with some characters on either side. Votes and
features take few values, so both fits run on tables of patterns (at most 5103 and 1792 rows) at any size of the input,
and only sums of as many numbers as there are parameters come to the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("email", "ip", "card", "phone", "number", "handle", "name")
BASE = 4
#: A match may begin where the one before ended, or where its run of characters begins: later starts in a run find no more.
PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    r"(?<![A-Za-z0-9_.+@/-])\(?[0-9](?:[ ()./-]{0,2}[0-9]){5,29}(?![A-Za-z0-9_@])",
    r"(?<![A-Za-z0-9._%+@-])(?:@[A-Za-z][A-Za-z0-9_]{2,29}(?![A-Za-z0-9_@])|[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63} ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z]{2,20})",
    r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.? \p{Lu}\p{L}{1,30}(?: \p{Lu}\p{L}{1,30})?",
)
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Gazetteers and context words.
NAMES = "anna|ana|maria|marie|peter|pierre|pedro|paul|pablo|john|jean|juan|johann|hans|klaus|karl|carlos|james|jose|mary|emma|sophie|laura|thomas|david|michael|luis|louis|claire|julia"
ROLES = "info|support|admin|sales|noreply|no-reply|contact|webmaster|postmaster|office|help|service|news|team"
PROVIDERS = "gmail|yahoo|hotmail|outlook|gmx|web|icloud|aol|orange|free|protonmail"
CUES = ("e-?mail|mail|contact|write|schreib|correo|courriel", r"\bip\b|address|adresse|host|login|user", "card|karte|carte|tarjeta|visa|master|credit", "tel|phone|call|fax|mobil|handy|movil|portable",
        "tel|phone|call|fax|mobil|handy|card|karte|account|konto|passport|ausweis|born|birth|ssn|tax", "e-?mail|mail|contact|follow|twitter|instagram|profile|user", "sign|dear|by|von|par|por|patient|author|name")
OTHER = r"version|page|seite|isbn|issn|price|preis|prix|total|chapter|figure|section|line|row|table|[$€£%#=*/]\s*$"
#: Characters kept on either side of a match.
BEFORE, AFTER = 40, 20
VOTES, FEATURES = 6, 8
#: Pseudo-counts of a labeler's votes on personal and other spans before any are seen, and the share of votes taken for right.
PRIOR_VOTES, PRIOR_RIGHT = 10.0, 0.8


def _matches(text: Column, kind: int) -> Column:
    """[gap before a match: its length, last and first characters; the match]; the last entry has no match. Null where none is."""
    pattern = PATTERNS[kind]
    found = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda g, m: F.struct(F.length(g).alias("gap"), F.right(g, F.lit(BEFORE)).alias("before"), F.left(g, F.lit(AFTER)).alias("head"), m.alias("m")))
    there = {0: F.contains(text, F.lit("@")), 3: F.contains(text, F.lit("+")), 5: text.rlike(r"@|[(\[]at[)\]]")}.get(kind)
    return F.when(there & text.rlike(pattern) if there is not None else text.rlike(pattern), found)


def _luhn(digits: Column) -> Column:
    doubled = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    each = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(i % 2 == 1, doubled(x.cast("int"))).otherwise(x.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _by_kind(values: list[Column]) -> Column:
    out = F.when(F.col("kind") == 0, values[0])
    for k, v in enumerate(values[1:], 1):
        out = out.when(F.col("kind") == k, v)
    return out


def _votes() -> Column:
    """1 for personal, -1 for other, 0 for neither, of each labeler."""
    m, digits = F.lower("m"), F.col("digits")
    before, after = F.lower("before"), F.lower("after")
    kind, n = F.col("kind"), F.length("digits")
    yes = lambda c, no=F.lit(False): F.when(c, 1).when(no, -1).otherwise(0)
    number = kind.isin(2, 3, 4)
    return F.array(
        F.when(kind < BASE, yes(F.col("base"), ~F.col("base"))).otherwise(yes(F.lit(False), (kind == BASE) & F.when(n.between(13, 19), ~_luhn(digits)).otherwise(False))),
        yes(number & m.rlike(r"^[+(]?[0-9]{1,4}[)]?[ ./-][(]?[0-9]{2,4}[)]?[ ./-]?[0-9]{3,5}(?:[ ./-][0-9]{2,5})*$"),
            number & (m.rlike(r"^(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}$|^[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}$|^[0-9]+(?:\.[0-9]+)?$") | (digits.rlike("^([0-9])\\1+$")))),
        yes((kind.isin(0, 5) & m.rlike(rf"@(?:{PROVIDERS})\.")) | ((kind.isin(0, 5, 6)) & m.rlike(rf"(?:^|[^a-z])(?:{NAMES})(?:[^a-z]|$)")),
            (kind.isin(0, 5) & m.rlike(rf"^(?:{ROLES})[@.+0-9-]")) | ((kind == 1) & m.rlike(r"^(?:0|10|127|192\.168|255)\."))),
        yes(_by_kind([before.rlike(c) for c in CUES])),
        yes(F.lit(False), before.rlike(rf"(?:{OTHER})[^.!?]{{0,12}}$") | after.rlike(r"^\s*(?:%|[$€£]|kg|km|mm|pages|seiten)")),
        yes(((before == "") | before.rlike(r"[\s(:,;\"<]$")) & ((after == "") | after.rlike(r"^[\s),;:.!?\">]")), before.rlike(r"[\p{L}0-9_=]$") | after.rlike(r"^[\p{L}0-9_=]")))


def _features() -> Column:
    """Numbers of the features that a span has; the first are its kind."""
    n, before, after = F.length("digits"), F.col("before"), F.col("after")
    distinct = F.size(F.array_distinct(F.split("digits", "")))
    has = [n >= 9, n.between(10, 15), (n > 0) & (distinct <= 3), F.col("m").rlike(r"[ ()/-]"), F.length("m") > 24,
           (before == "") | before.rlike(r"\s$"), (after == "") | after.rlike(r"^[\s.,]"), before.rlike(r":\s*$")]
    return F.array_compact(F.array(F.col("kind"), *[F.when(c, len(KINDS) + i) for i, c in enumerate(has)]))


def _solved(a: list[list[float]], b: list[float]) -> list[float]:
    """x of a x = b for a positive definite a."""
    n, rows = len(b), [[*r, y] for r, y in zip(a, b, strict=True)]
    for i in range(n):
        for j in range(i + 1, n):
            r = rows[j][i] / rows[i][i]
            rows[j] = [y - r * x for x, y in zip(rows[i], rows[j], strict=True)]
    x = [0.0] * n
    for i in reversed(range(n)):
        x[i] = (rows[i][n] - sum(rows[i][j] * x[j] for j in range(i + 1, n))) / rows[i][i]
    return x


def _numbers(values: list[float]) -> Column:
    return F.lit([float(v) for v in values])


def estimate(patterns: DataFrame, rounds: int = 30) -> Column:
    """The probability that a span of (kind, votes) is personal, by expectation-maximisation over patterns (kind, votes, n).

    Each labeler has a chance to say yes on personal spans and one on others, when it votes; each kind a share of personal
    spans. All start from, and are held by, the prior that most votes are right; with no pattern they stay there.
    """
    right, wrong = [PRIOR_RIGHT] * VOTES, [1 - PRIOR_RIGHT] * VOTES
    shares = [0.5] * len(KINDS)

    def chance() -> Column:
        up = _numbers([math.log(a / b) for a, b in zip(right, wrong, strict=True)])
        down = _numbers([math.log((1 - a) / (1 - b)) for a, b in zip(right, wrong, strict=True)])
        prior = F.element_at(_numbers([math.log(s / (1 - s)) for s in shares]), F.col("kind") + 1)
        said = F.transform("votes", lambda v, j: F.when(v == 1, F.element_at(up, j + 1)).when(v == -1, F.element_at(down, j + 1)).otherwise(0.0))
        return 1 / (1 + F.exp(-F.aggregate(said, prior, lambda a, x: a + x)))

    for _ in range(rounds):
        said = F.concat(F.transform("votes", lambda v, j: F.struct(j.alias("j"), v.alias("v"))), F.array(F.struct(F.lit(-1).alias("j"), F.col("kind").alias("v"))))
        sums = patterns.select("n", chance().alias("p"), F.explode(said).alias("s")).groupBy("s.j", "s.v").agg(F.sum(F.col("n") * F.col("p")), F.sum(F.col("n") * (1 - F.col("p"))))
        got = {(j, v): (p, q) for j, v, p, q in sums.collect()}  # at most three rows a labeler and one a kind
        of = lambda j, v: got.get((j, v), (0.0, 0.0))
        before = [*right, *wrong, *shares]
        for j in range(VOTES):
            right[j], wrong[j] = (round((of(j, 1)[i] + PRIOR_VOTES * r) / (of(j, 1)[i] + of(j, -1)[i] + PRIOR_VOTES), 9) for i, r in ((0, PRIOR_RIGHT), (1, 1 - PRIOR_RIGHT)))
        shares = [round((of(-1, k)[0] + 1) / (sum(of(-1, k)) + 2), 9) for k in range(len(KINDS))]
        if max(abs(a - b) for a, b in zip(before, [*right, *wrong, *shares], strict=True)) < 1e-6:
            break
    return chance()


def fit(rows: DataFrame, rounds: int = 8, ridge: float = 1.0) -> Column:
    """The probability by features, a logistic regression fit by Newton's method to rows (features, n, s): n spans whose
    probabilities sum to s."""
    size = len(KINDS) + FEATURES
    w = [0.0] * size

    def chance() -> Column:
        held = _numbers(w)
        return 1 / (1 + F.exp(-F.aggregate(F.transform("features", lambda i: F.element_at(held, i + 1)), F.lit(0.0), lambda a, x: a + x)))

    for _ in range(rounds):
        p, n = F.col("p"), F.col("n")
        cell = lambda i, j, v: F.struct(i.alias("i"), j.alias("j"), v.alias("v"))
        cells = F.concat(
            F.flatten(F.transform("features", lambda i: F.transform("features", lambda j: cell(i, j, n * p * (1 - p))))),
            F.transform("features", lambda i: cell(i, F.lit(-1), F.col("s") - n * p)))
        sums = rows.withColumn("p", chance()).select(F.explode(cells).alias("c")).groupBy("c.i", "c.j").agg(F.sum("c.v")).collect()
        a, b = [[ridge * (i == j) for j in range(size)] for i in range(size)], [-ridge * x for x in w]
        for i, j, v in sums:  # as many as the matrix and the vector have numbers
            if j < 0:
                b[i] += v
            else:
                a[i][j] += v
        step = _solved(a, b)
        w = [round(x + max(-4.0, min(4.0, y)), 9) for x, y in zip(w, step, strict=True)]
        if max(map(abs, step)) < 1e-6:
            break
    return chance()


def find_personal_data(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = 0.5) -> DataFrame:
    """One row per row of docs: key, n_email, n_ip, n_card, n_phone, base and added (arrays of kind number, start, end).

    Offsets are code points, ends exclusive. base holds, by kind and start, the leftmost non-overlapping matches of each base
    kind that pass its check; base spans of several kinds may overlap. added holds the weak spans that overlap no base span
    and that the classifier gives a probability of least or more. A null text is empty. Repeated rows are judged each
    by itself and alike; an empty table gives an empty result. Columns of docs other than key and text are left out, so
    no name clashes.
    """
    shown = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), *[_matches(shown, k).alias(f"k{k}") for k in range(len(KINDS))])
    found = materialize(found, "matches")

    def numbered(k: int) -> Column:
        each = F.transform(f"k{k}", lambda x, i: F.struct(F.lit(k).alias("kind"), i.alias("i"), x.alias("x")))
        return F.coalesce(each, F.array().cast("array<struct<kind:int,i:int,x:struct<gap:int,before:string,head:string,m:string>>>"))

    rows = found.select("row", F.explode(F.concat(*map(numbered, range(len(KINDS))))).alias("c")).select("row", "c.kind", "c.i", "c.x.*").repartition("row")
    order = Window.partitionBy("row", "kind").orderBy("i")
    length = F.coalesce(F.length("m"), F.lit(0))
    rows = rows.withColumn("end", F.sum(F.col("gap") + length).over(order).cast("long")).withColumn("after", F.lead("head").over(order)).filter("m is not null")
    rows = rows.withColumn("start", F.col("end") - F.length("m")).withColumn("digits", F.regexp_replace("m", "[^0-9]", ""))
    n = F.length("digits")
    valid = _by_kind([F.lit(True), F.col("m").rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"), F.when(n.between(13, 19), _luhn(F.col("digits"))).otherwise(False), n.between(9, 15), *[F.lit(False)] * (len(KINDS) - BASE)])
    rows = rows.withColumn("base", valid)
    by_start = Window.partitionBy("row").orderBy("start", "end", "kind")
    back, ahead = by_start.rowsBetween(Window.unboundedPreceding, 0), by_start.rowsBetween(0, Window.unboundedFollowing)
    reached = F.coalesce(F.max(F.when(F.col("base"), F.col("end"))).over(back), F.lit(0).cast("long"))
    next_ = F.coalesce(F.min(F.when(F.col("base"), F.col("start"))).over(ahead), F.col("end"))
    rows = rows.withColumn("free", (reached <= F.col("start")) & (next_ >= F.col("end")))
    spans = materialize(rows.select("row", "kind", "start", "end", "base", "free", _votes().alias("votes"), _features().alias("features")), "spans")

    patterns = materialize(spans.groupBy("kind", "votes", "features").agg(F.count("*").alias("n")).coalesce(1), "patterns")
    chance = estimate(materialize(patterns.groupBy("kind", "votes").agg(F.sum("n").alias("n")).coalesce(1), "votes"))
    # Spans on which no labeler voted teach nothing.
    taught = patterns.filter(F.exists("votes", lambda v: v != 0)).withColumn("p", chance)
    taught = taught.groupBy("features").agg(F.sum("n").cast("double").alias("n"), F.sum(F.col("n") * F.col("p")).alias("s"))
    judged = fit(materialize(taught.coalesce(1), "taught"))

    span = F.struct("kind", "start", "end")
    extra = ~F.col("base") & (F.col("kind") >= BASE) & F.col("free") & (judged >= least)
    kept = spans.filter(F.col("base") | (F.col("kind") >= BASE)).groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(F.col("base"), span))).alias("base"), F.array_sort(F.collect_list(F.when(extra, span))).alias("added"))
    out = found.select("key", "row").join(kept.hint("merge"), "row", "left")
    none = F.array().cast("array<struct<kind:int,start:long,end:long>>")
    out = out.withColumn("base", F.coalesce("base", none)).withColumn("added", F.coalesce("added", none))

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    return out.select(F.col("key").alias(key), *map(count, range(BASE)), "base", "added")


def spans_text(spans: Column) -> Column:
    """kind:start:end by kind, then start, comma-joined."""
    names = F.lit(list(KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")
