"""Cleaning, sections and packing against plain loops over lists of lines."""

import random
import re
from math import ceil

import pytest
from pyspark.sql import functions as F

from sieveline.operators import sections as S
from sieveline.plans import scripture

from .compare import same
from .conftest import SF

OPTIONS = dict(drop_lines=["^FURNITURE"], inline=[r"fol\. \d+"], strip="_", drop_paragraphs=r"^\[\d+\]", keep_caps_after="^CHAPTER", drop_captions=True, join_broken=True, drop_garbage=True)


def share(text):
    chars = re.sub(r"\s", "", text)
    return len(re.sub("[^A-Za-z]", "", chars)) / len(chars) if chars else 0


def caps(text):
    n = re.sub("[^A-Za-z]", "", text)
    return len(n) >= 4 and sum(c.isupper() for c in n) / len(n) >= 0.7


def plain_clean(lines, drop_lines=(), inline=(), strip=None, drop_paragraphs=None, keep_caps_after=None, drop_captions=False, join_broken=False, drop_garbage=False):
    kept, skipping, before = [], False, ""
    for raw in lines:
        t = raw.strip()
        if drop_paragraphs:
            if t == "":
                skipping = False
            elif not before and re.search(drop_paragraphs, t):
                skipping = True
            before = t
            if skipping:
                continue
        if strip:
            raw = re.sub(strip, "", raw)
        for p in inline:
            raw = re.sub(p, " ", raw)
        x = re.sub(r"\s+", " ", raw).strip()
        garbage = drop_garbage and sum(bool(re.search(S.WORD, w)) for w in x.split(" ")) / len(x.split(" ")) < 0.5
        if x == "" or not (re.fullmatch(r"\d+", x) or any(re.search(p, x) for p in drop_lines) or (len(x) < 40 and share(x) < 0.6) or garbage):
            kept.append(x)
    if keep_caps_after:
        left, k = 0, 0
        while k < len(kept):
            if kept[k] == "":
                k += 1
                continue
            e = k
            while e < len(kept) and kept[e] != "":
                e += 1
            all_caps = all(map(caps, kept[k:e]))
            if re.search(keep_caps_after, kept[k]):
                left = 3
            elif all_caps and not left:
                kept[k:e] = [""] * (e - k)
            left = left - 1 if all_caps and left else 0
            k = e
    if drop_captions:
        for k, x in enumerate(kept):
            if x and re.search("[a-z]", x) and not (k and kept[k - 1]) and not (k + 1 < len(kept) and kept[k + 1]):
                if (len(x) < 100 and not re.search(S.CAPTION_END, x)) if re.match("[A-Z]", x) else (len(x) < 60 and not re.search(S.TAIL_END, x)):
                    kept[k] = ""
    if join_broken:
        for k in range(len(kept) - 2, 0, -1):
            if kept[k] == "" and re.search("[a-z,;-]$", kept[k - 1]) and re.match('["“]?[a-z]', kept[k + 1]):
                del kept[k]
    for k in range(len(kept) - 1):
        if re.search("[a-z]-$", kept[k]) and re.match("[a-z]", kept[k + 1]):
            word, _, rest = kept[k + 1].partition(" ")
            kept[k], kept[k + 1] = kept[k][:-1] + word, rest
    return kept


def heading(x):
    n = re.sub("[^A-Za-z]", "", x)
    mostly = len(n) >= 4 and sum(c.isupper() for c in n) / len(n) > 0.85 and not re.search(r"[.,;:]$", re.sub(r"\.$", "", x))
    return 0 < len(x) <= 70 and bool(re.search(S.NUMBERED_HEADING, x) or mostly)


def plain_sections(lines, default):
    out, para, now = [], [], (default, [])

    def end():
        if para:
            now[1].append(re.sub(r"\s+", " ", " ".join(para)).strip())
            para.clear()

    for x in [*lines, ""]:
        if x == "":
            end()
        elif heading(x):
            end()
            out.append(now)
            now = (x, [])
        else:
            para.append(x)
    return [s for s in [*out, now] if s[1]]


def title(h):
    return h if re.search("[a-z]", h) else " ".join(w if re.search(r"^[IVXLC]+\.?$", w) else w[:1] + w[1:].lower() for w in h.split(" "))


def plain_chunks(found, prefix, target, numbers):
    out = []
    for h, paras in found:
        units = [u for p in paras if len(p) >= 20 and share(p) >= 0.75 for u in ([p] if ceil(len(p) / 4) <= target else re.split(S.SENTENCE_END, p))]
        runs, total = [], 0
        for u in units:
            t = ceil(len(u) / 4)
            if not runs or total + t > target:
                runs.append([])
                total = 0
            runs[-1].append(u)
            total += t
        head, no, seen = f"{prefix}, {title(h)}" if h else prefix, 1, {}
        numbered = numbers and any(re.search(S.PARAGRAPH_NUMBER, u) for u in units)
        for part, run in enumerate(runs):
            lo = None
            for u in run:
                m = re.search(S.PARAGRAPH_NUMBER, u)
                no = max(no, int(m[1])) if m and numbered else no
                lo = no if lo is None else lo
            ref = f"{head} §{lo}" + (f"–{no}" if no > lo else "") if numbered else head + (f" (part {part + 1})" if part else "")
            seen[ref] = seen.get(ref, 0) + 1
            ref += f" (part {seen[ref]})" if seen[ref] > 1 else ""
            out.append((ref, ref + "\n\n" + "\n\n".join(run)))
    return out


POOL = ["", "", "", "the king went out to meet them in the plain beyond the river and", "and he said un-", "un-", "ces-", "to them, rise.", "CHAPTER IV", "THE LIFE OF ABBA ANTONY", "MARGIN NOTE HERE", "12", "[614] Luke ii. 29.", "FURNITURE 9",
        "a lone tail", "The cannibal gives a drink", "=%/ 7 ~", "x1 k2 z%5 q/7 aa", "1. First his teaching began with a long saying. And went on.", "7. Seventh of them all, which is a good thing to say here.", "_Italic_ words fol. 29 in a line of prose that runs over forty letters.", "  spaced   out line of words ends with com-", "BOOK ii."]


def noise(seed, n):
    rng = random.Random(seed)
    return [rng.choice(POOL) for _ in range(n)]


@pytest.mark.parametrize("options", [{}, OPTIONS, dict(drop_captions=True), dict(join_broken=True), dict(keep_caps_after="^CHAPTER")])
def test_clean_sections_and_chunks_equal_loops(spark, options):
    docs = {k: noise(k, 150) for k in range(12)} | {90: [], 91: ["un-"] * 7 + ["end"], 92: ["ab ces-", "un-", "un-", "un- x-", "y"]}
    lines = spark.createDataFrame([(d, k, x) for d, xs in docs.items() for k, x in enumerate(xs)], "doc long, pos int, line string")
    clean = S.clean_lines(lines, **options)
    got = {}
    for r in clean.orderBy("doc", "pos").collect():
        got.setdefault(r["doc"], []).append(r["line"])
    want = {d: plain_clean(xs, **options) for d, xs in docs.items()}
    assert got == {d: xs for d, xs in want.items() if xs}
    found = S.to_sections(clean, "Preface")
    by = {}
    for r in found.orderBy("doc", "section", "para").collect():
        by.setdefault((r["doc"], r["section"], r["heading"]), []).append(r["text"])
    plain = {d: plain_sections(xs, "Preface") for d, xs in want.items()}
    assert [(k[0], k[2], v) for k, v in by.items()] == [(d, h, ps) for d in sorted(plain) for h, ps in plain[d]]
    for numbers in (False, True):
        chunks = S.chunk_sections(found, F.concat(F.lit("Text "), F.col("doc").cast("string")), 30, numbers).orderBy("doc", "section", "chunk").collect()
        assert [(r["doc"], r["ref"], r["content"]) for r in chunks] == [(d, *c) for d in sorted(plain) for c in plain_chunks(plain[d], f"Text {d}", 30, numbers)]
        assert all(r["tokens"] == ceil(len(r["content"]) / 4) for r in chunks)


def test_queries_equal_loops(spark):
    docs = {}
    for r in scripture.lines(spark, SF).orderBy("doc", "pos").collect():
        docs.setdefault(r["doc"], []).append(r["line"])
    want = {d: plain_clean(xs, drop_captions=True, join_broken=True) for d, xs in docs.items()}
    got = {}
    for r in scripture.clean_text(spark, SF).orderBy("doc", "pos").collect():
        got.setdefault(r["doc"], []).append(r["line"])
    assert got == {d: xs for d, xs in want.items() if xs}
    plain = {d: plain_sections(xs, "Preface") for d, xs in want.items()}
    rows = scripture.text_sections(spark, SF).orderBy("doc", "section", "para").collect()
    assert [(r["doc"], r["heading"], r["text"]) for r in rows] == [(d, h, p) for d in sorted(plain) for h, ps in plain[d] for p in ps] and len({r["heading"] for r in rows}) > 20
    chunks = scripture.section_chunks(spark, SF).orderBy("doc", "section", "chunk").collect()
    assert [(r["doc"], r["ref"], r["content"]) for r in chunks] == [(d, *c) for d in sorted(plain) for c in plain_chunks(plain[d], f"Document {d}", scripture.TARGET, False)]


def test_verse_chunks_equal_sql(spark):
    same(scripture.verse_chunks(spark, SF), scripture.VERSES, SF)


def test_front_and_back_matter(spark):
    lines = ["junk", "BOOK I", "END", "text of the book goes on here", "END of it", "licence"]
    d = spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)] + [(2, 0, "END"), (2, 1, "no start here"), (3, 0, None)], "doc long, pos int, line string")
    got = [(r["doc"], r["line"]) for r in S.clean_lines(d, start_at="^BOOK I$", end_at="^END").orderBy("doc", "pos").collect()]
    assert got == [(1, "BOOK I"), (2, "END"), (2, "no start here"), (3, "")]


def test_verses_break_at_headings_and_paragraphs(spark):
    rows = [("GEN", "Genesis", k, 1 + k // 3, 1 + k % 3, "x" * 40, k in (2, 3), {4: "Flood", 6: ""}.get(k)) for k in range(8)] + [("GEN", "Genesis", 9, 9, 9, None, False, None), (None, "?", 0, 1, 1, "y", False, None)]
    v = spark.createDataFrame(rows, "book string, name string, pos int, chapter int, verse int, text string, paragraph_start boolean, heading string")
    got = [(r["ref"], r["verse_end"], r["content"].split("\n")[0]) for r in S.chunk_verses(v, 30).orderBy("book", "chunk").collect()]
    assert got == [("? 1:1", 1, "? 1:1"), ("Genesis 1:1-2", 2, "Genesis 1:1-2"), ("Genesis 1:3-2:1", None, "Genesis 1:3-2:1"), ("Genesis 2:2-3", 3, "Genesis 2:2-3 — Flood"), ("Genesis 3:1-2", 2, "Genesis 3:1-2")]
    assert S.chunk_verses(v.limit(0)).count() == 0


def test_long_groups_are_packed_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        d = spark.range(100).select(F.lit(1).alias("g"), F.col("id").alias("o"))
        got = [r["chunk"] for r in S.packed(d, ["g"], ["o"], F.lit(3), 10).orderBy("o").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [k // 3 for k in range(100)]
