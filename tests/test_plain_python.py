"""Queries that SQL doesn't express well, over the whole tables against plain Python."""

from __future__ import annotations

import re
from pathlib import Path

import pytest

from tessera.plans import documents as PD
from tessera.plans import streaming as PX
from tessera.plans import text as PT

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


def texts(spark):
    return [(r["doc_id"], r["text"] or "", r["lang"], r["source"], r["n_chars"]) for r in PD.docs(spark, SF).collect()]


def normalized(text):
    t = re.sub("\r\n?", "\n", text)
    t = re.sub("\n{3,}", "\n\n", re.sub("[ \t]+", " ", t))
    return t.strip(" \n\t")


def packed(text, target):
    out, now = [], ""
    for s in re.split("(?<=[。！？.!?；;])", text):
        if now and len(now) + len(s) > target:
            out.append(now.strip(" "))
            now = s
        else:
            now += s
    return [x for x in [*out, now.strip(" ")] if x]


def test_paragraphs(spark):
    want = set()
    for d, text, *_ in texts(spark):
        parts = [p.strip(" ") for p in re.split(r"\n\s*\n", normalized(text.replace("\n", "\n\n")))]
        whole = [x for p in parts if p for x in (packed(p, 600) if len(p) > 1200 else [p])]
        want |= {(d, i, p) for i, p in enumerate(whole)}
    assert {tuple(r) for r in PD.d2(spark, SF).collect()} == want


def test_line_paragraphs_and_their_sentences(spark):
    want = set()
    for d, text, *_ in texts(spark):
        out, cur = [], []
        for x in re.sub("\r\n?", "\n", text).split("\n"):
            x = x.strip(" ")
            if not x or cur and (re.match("#{1,6} ", x) or sum(map(len, cur)) + len(x) > 900):
                if cur:
                    out.append("\n".join(cur))
                cur = [x] if x else []
            else:
                cur.append(x)
        if cur:
            out.append("\n".join(cur))
        for i, p in enumerate(out):
            said = re.split(r"(?<=[。！？；;])\s*|(?<=\.)\s+", re.sub(r"\s+", " ", p).strip(" "))
            want.add((d, i, sum(bool(s.strip(" ，,；;。")) for s in said), len(p)))
    assert {tuple(r) for r in PD.d3(spark, SF).collect()} == want


def test_plain_text_of_pages(spark):
    """The page before each text has one table, one code block and one link; the texts have marks of their own only by chance."""
    got = {r["doc_id"]: r["plain"] for r in PT.t10(spark, SF).collect()}
    for d, text, lang, source, n in texts(spark):
        head, _, rest = got[d].partition("\nx z")
        assert head == f"{source}\na = {lang}, b = {n}"
        assert not re.search(r"(?m)^#{1,6}\s|^>\s?|^\s*[-*+]\s|```|\*\*", rest)
        # What is left of the text are its words in their order.
        words = lambda t: re.findall(r"\w+", re.sub(r"[_*]", "", t))
        assert words(rest) == words(text)


def test_sentences_of_the_stream(spark):
    want = set()
    pause, stop = "，,、。.！!？?；;：:\n", "。.！!？?；;\n"
    for r in PX.table(spark, SF, "conversations").filter("role = 'assistant'").collect():
        text, k = r["text"], 0
        if text is None:
            continue
        while True:
            marks = stop if k else pause
            at = next((i for i, c in enumerate(text) if c in marks), None)
            piece = text if at is None else text[: at + 1]
            if piece.strip():
                want.add((r["conv_id"], r["turn"], k, piece.strip()))
                k += 1
            if at is None:
                break
            text = text[at + 1 :]
    assert {tuple(r) for r in PX.x9(spark, SF).collect()} == want
