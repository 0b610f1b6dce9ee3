"""Marked-up scripture against a plain reading from marker to marker."""

import random
import re

from sieveline.operators import sections, usfm
from sieveline.plans import scripture

from .conftest import SF

CUT = re.compile(rf"(?=\\(?:{usfm.BLOCKS})(?=\s|$))")


def inline(t):
    t = re.sub(r"\\(f|fe|x)\s.*?\\\1\*", "", t)
    t = re.sub(r"\\\+?w\s([^|\\]*?)(\|[^\\]*)?\\\+?w\*", r"\1", t)
    t = re.sub(r"\\\+?[a-z]+\d?(\s|$)", "", re.sub(r"\\\+?[a-z]+\d?\*", "", t))
    return re.sub(r"\s+", " ", t).strip()


def plain(doc, text):
    code = re.search(r"^\\id\s+([0-9A-Z]{3})", text or "", re.M)
    if not code:
        return []
    body = re.sub(r"\r\n?", "\n", text)
    for n in usfm.NOTES:
        body = re.sub(rf"(?s)\\{n}\s.*?\\{n}\*", "", body)
    out, now, chapter, heading, fresh, lead = [], None, 0, None, True, ""
    for pos, seg in enumerate(x for x in CUT.split(body.replace("\n", " ")) if x):
        m = re.match(r"(?s)^\\([a-z]+\d?)(?:\s+(.*))?$", seg)
        marker, rest = (m[1], (m[2] or "").strip()) if m else ("", "")
        if marker in ("c", "v", "d") or re.match(r"^s\d?$", marker):
            now = None
        if marker == "c":
            chapter, fresh, lead = int(rest.split()[0]), True, ""
        elif marker == "v":
            v = re.match(r"(?s)^(\d+)(?:-\d+)?\s*(.*)$", rest)
            if v:
                now = [doc, code[1], pos, chapter, int(v[1]), (inline(lead) + " " if lead.strip() else "") + v[2], fresh, heading or None]
                out.append(now)
                lead, heading, fresh = "", None, False
        elif marker == "d":
            lead += " " + rest
        elif re.match(r"^s\d?$", marker):
            heading, fresh = inline(rest), True
        elif re.match(usfm.PARAGRAPHS, marker):
            if now:
                now[5] += " " + rest
            else:
                lead += " " + rest
            fresh = True
        elif now and not re.match(usfm.SKIPPED, marker):
            now[5] += " " + seg
    return [tuple([*r[:5], inline(r[5]), *r[6:]]) for r in out if inline(r[5])]


def rows(df):
    return [tuple(r) for r in df.orderBy("doc", "pos").collect()]


def test_verses_of_odd_markup_equal_a_plain_reading(spark):
    rng = random.Random(8)
    pool = ["\\c 1", "\\c 2 more", "\\v 1 In the \\w beginning|strong=\"H1\"\\w* was", "\\v 2-3 and \\add then\\add* it", "\\v x no number", "\\v 7", "\\p", "\\q1 a line of verse", "\\q2", "\\d A psalm of \\nd him\\nd*.", "\\s Heading one", "\\s2 ", "\\b",
            "\\r (a reference)", "\\m text goes on \\f + \\fr 1:1 \\ft a note\nover \\v lines\\f* here", "plain text", "\\zz unknown", "\\x - \\xo 1 \\xt Gen\\x* and", "\\mt1 Title", "\\toc1 T", "\\wj said\\wj* he", "\r\n"]
    books = [(k, "\\id GEN x\n" + "\n".join(rng.choice(pool) for _ in range(60))) for k in range(40)]
    books += [(90, "no code \\c 1 \\v 1 lost"), (91, None), (92, ""), (93, "\\id 1JN\n\\c 3\n\\v 16 " + "long " * 40_000), (94, "\\id EXO")]
    got = rows(usfm.verses(spark.createDataFrame(books, "doc long, text string")))
    assert got == [r for d, t in books for r in plain(d, t)] and len(got) > 200


def test_query_equals_a_plain_reading(spark):
    books = scripture.marked_books(spark, SF).orderBy("doc").collect()
    assert rows(scripture.marked_verses(spark, SF)) == [r for b in books for r in plain(b["doc"], b["text"])]


def test_verses_go_on_to_chunks(spark):
    from pyspark.sql import functions as F

    v = usfm.verses(spark.createDataFrame([(1, "\\id GEN\n\\c 1\n\\p\n\\v 1 One.\n\\v 2 Two.\n\\s New\n\\p\n\\v 3 Three.")], "doc long, text string"))
    got = sections.chunk_verses(v.select(F.col("code").alias("book"), F.lit("Genesis").alias("name"), "pos", "chapter", "verse", "text", "paragraph_start", "heading"), 600)
    assert [r["content"] for r in got.orderBy("chunk").collect()] == ["Genesis 1:1-2\n\nOne. Two.", "Genesis 1:3 — New\n\nThree."]
    assert usfm.verses(spark.createDataFrame([], "doc long, text string")).count() == 0
