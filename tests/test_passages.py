import random
import re

import pytest
from pyspark.sql import functions as F

from sieveline.functions import text as T
from sieveline.operators import passages as P
from sieveline.plans import scripture

from .compare import same
from .conftest import SF


@pytest.mark.parametrize("name", ["passage_prefixes", "passage_spans", "expected_ranks", "passage_texts"])
def test_query_equals_its_sql(spark, name):
    run, sql = scripture.CATALOG[name]
    same(run(spark, SF), sql, SF)


def test_prefixes_of_any_case_and_a_word(spark):
    c = spark.createDataFrame([("a", 1, "Book I, Part 2", "The Flood"), ("a", 2, "book ii", None), ("a", 3, None, "x"), ("b", 4, "Book I", "flood"), (None, 5, "Book I", "flood"), ("a", 6, "B_ok%", "")], "source string, pos int, ref string, content string")
    p = spark.createDataFrame([(1, "a", "BOOK I", None), (2, "a", "book i", "flood"), (3, "a", "", None), (4, "a", "Book I, Part 2 and on", None), (5, None, "Book", None), (6, "a", None, None), (7, "a", "B_", None), (8, "c", "Book", None)], "id int, source string, ref string, match string")
    got = {}
    for r in P.prefix_hits(p, c).collect():
        got.setdefault(r["id"], set()).add(r["pos"])
    assert got == {1: {1, 2}, 2: {1}, 3: {1, 2, 6}, 7: {6}}
    report = {r["id"]: (r["hits"], r["first"], r["found"]) for r in P.resolution(p, P.prefix_hits(p, c)).collect()}
    assert report[1] == (2, "Book I, Part 2; book ii", True) and report[5] == (0, "", False) and len(report) == 8


def test_spans_that_meet(spark):
    c = spark.createDataFrame([(1, "Ruth 1:1-10"), (2, "Ruth 1:11-2:4"), (3, "Ruth 2:5-3:18"), (4, "Luke 1:1"), (5, "no ref"), (6, None), (7, "Ruth 3:1-2:1")], "pos int, ref string")
    p = spark.createDataFrame([(1, "Ruth 1:10-11"), (2, "Ruth 2"), (3, "Ruth 1:1-999999999:1"), (4, "Luke 2:1"), (5, "Mark 1"), (6, None), (7, "Ruth 2:9-1:1"), (8, "Ruth 2:4")], "id int, ref string")
    got = {}
    for r in P.span_hits(p, c).collect():
        got.setdefault(r["id"], set()).add(r["pos"])
    assert got == {1: {1, 2}, 2: {2, 3}, 3: {1, 2, 3}, 8: {2}}
    assert P.span_hits(p.limit(0), c).count() == 0 and P.resolution(p, P.span_hits(p, c.limit(0))).where("found").count() == 0


def test_lists_of_spans(spark):
    cases = {
        "15:18, 20": [(15, 18, 15, 18), (15, 20, 15, 20)], "51:1–2, 10–12": [(51, 1, 51, 2), (51, 10, 51, 12)], "31:20-32:6": [(31, 20, 32, 6)],
        "51": [(51, 1, 51, 999)], "51-53": [(51, 1, 51, 999)], "3, 4:5, 6": [(3, 1, 3, 999), (4, 5, 4, 5), (4, 6, 4, 6)], "1:2-3:4, 9": [(1, 2, 3, 4), (3, 9, 3, 9)],
        "": None, "1:2,": None, "5-6:7": None, "a": None, "1:2-": None, "1:1234567890": None, None: None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "r string").select("r", T.parse_spans(F.col("r")).alias("s")).collect()
    assert {r["r"]: r["s"] and [tuple(s) for s in r["s"]] for r in rows} == cases
    refs = [("Psalm 51:1-2, 10",), (" 1 Samuel  3 ",), ("Psalm",), ("Psalm x 3:a",), (None,), ("",)]
    got = [r["x"] for r in spark.createDataFrame(refs, "r string").select(T.parse_ref_list(F.col("r")).alias("x")).collect()]
    assert got[0]["book"] == "Psalm" and len(got[0]["spans"]) == 2 and got[1]["book"] == "1 Samuel" and got[2:] == [None] * 4


def test_ranks_of_what_is_expected(spark):
    results = spark.createDataFrame([(1, 1, "Luke 1:1-3"), (1, 2, "Ruth 2:1-3:4"), (1, 3, "The Ladder, Step 5"), (2, 1, "Ruth 3:1"), (None, 1, "Ruth 3:1"), (1, 4, None)], "id int, rank int, ref string")
    expected = spark.createDataFrame([(1, "Ruth 3:2"), (1, "Ruth 3:2"), (1, "THE LADDER"), (1, "Luke 1:9"), (2, "Ruth"), (2, "Luke 1:1"), (None, "Ruth 3:1"), (2, None), (3, "Ruth 3:1"), (1, "")], "id int, ref string")
    got = {(r["id"], r["ref"]): r["rank"] for r in P.expected_ranks(expected, results).collect()}
    assert got == {(1, "Ruth 3:2"): 2, (1, "THE LADDER"): 3, (1, "Luke 1:9"): 0, (2, "Ruth"): 1, (2, "Luke 1:1"): 0, (None, "Ruth 3:1"): 0, (2, None): 0, (3, "Ruth 3:1"): 0, (1, ""): 1}
    assert P.expected_ranks(expected.limit(0), results).count() == 0 and P.expected_ranks(expected, results.limit(0)).where("rank > 0").count() == 0


def plain_passage(ref, books, refused, unaligned):
    """A passage's text by plain loops over a book's chapters of verses."""
    m = re.match(r"^\s*(.+?)\s+([0-9][0-9:,\s–-]*)$", ref or "")
    if not m or m[1] not in books:
        return None
    chapter, out = 0, []
    for part in m[2].replace("–", "-").split(","):
        x = re.fullmatch(r"\s*(\d+):(\d+)(?:-(?:(\d+):)?(\d+))?\s*", part)
        y = re.fullmatch(r"\s*(\d+)(?:-(\d+))?\s*", part)
        if x:
            first = (int(x[1]), int(x[2]))
            chapter = int(x[3] or x[1])
            last = (chapter, int(x[4] or x[2]))
        elif y and chapter:
            first, last = (chapter, int(y[1])), (chapter, int(y[2] or y[1]))
        elif y:
            first, last = (int(y[1]), 1), (int(y[1]), 999)
        else:
            return None
        for c in range(first[0], last[0] + 1):
            if not 1 <= c <= len(books[m[1]]):
                return None
            verses = books[m[1]][c - 1]
            start = first[1] if c == first[0] else 1
            stop = min(last[1], len(verses)) if c == last[0] else len(verses)
            if start > len(verses):
                return None
            while stop < len(verses) and not verses[stop - 1]:
                stop += 1
            if (m[1], c) in unaligned and stop >= unaligned[m[1], c]:
                return None
            out += [v for v in verses[max(start, 1) - 1 : stop] if v]
    return None if not out or any(re.search(refused, v) for v in out) else " ".join(out)


def test_texts_of_passages_against_plain_loops(spark):
    rng = random.Random(3)
    books = {b: [["" if rng.random() < 0.2 else f"{b[0].lower() if rng.random() < 0.95 else 'X'}{c}.{v}" for v in range(1, rng.randint(2, 9))] for c in range(1, 6)] for b in ("Ruth", "1 Kings")}
    unaligned = {("Ruth", 1): 4, ("1 Kings", 3): 1}
    part = lambda: rng.choice([f"{rng.randint(1, 6)}:{rng.randint(1, 8)}", f"{rng.randint(1, 5)}:{rng.randint(1, 6)}-{rng.randint(1, 9)}", f"{rng.randint(1, 3)}:{rng.randint(1, 5)}-{rng.randint(2, 5)}:{rng.randint(1, 7)}", f"{rng.randint(1, 6)}", f"{rng.randint(1, 4)}–{rng.randint(1, 6)}"])
    refs = [f"{rng.choice(['Ruth', '1 Kings', 'Luke'])} {', '.join(part() for _ in range(rng.randint(1, 3)))}" for _ in range(400)] + [None, "", "Ruth", "Ruth 1:1,", "Ruth 1:1-999999999:2"]
    v = spark.createDataFrame([(b, c, n, t or rng.choice([None, ""])) for b, cs in books.items() for c, vs in enumerate(cs, 1) for n, t in enumerate(vs, 1)], "book string, chapter int, verse int, text string")
    u = spark.createDataFrame([(b, c, n) for (b, c), n in unaligned.items()], "book string, chapter int, verse int")
    got = {r["id"]: r for r in P.passage_texts(spark.createDataFrame(list(enumerate(refs)), "id int, ref string"), v, "X", u).collect()}
    want = [plain_passage(r, books, "X", unaligned) for r in refs]
    assert len(got) == len(refs) and [got[k]["text"] for k in range(len(refs))] == want
    assert sum(w is not None for w in want) > 60 and all((got[k]["ref"] is None) == (w is None) for k, w in enumerate(want))
