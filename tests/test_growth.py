"""Steps whose memory or time grew faster than their input: what is done once, and where."""

import unicodedata

from pyspark.sql import functions as F

from sieveline.functions import text as X
from sieveline.operators import curation as C
from sieveline.operators import passages as P
from sieveline.operators import reports as R
from sieveline.operators import sections as S


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rankings_are_made_once_for_each_set_of_tags(spark):
    q = spark.range(300).select(F.col("id").alias("query_id"), F.array((F.col("id") % 3).cast("string"), F.lit("x")).alias("tags"))
    e = spark.createDataFrame([(1, ["0", "x"], 0, 1), (2, ["1"], 1, 2), (3, ["x", "2"], 1, 3)], "id int, tags array<string>, first int, seq int")
    got = C.rank_entities(q, e)
    assert "Aggregate [query_id" in plan_of(got) and "Aggregate [set" in plan_of(got)
    assert not any("query_id" in a and "seq" in a for a in plan_of(got).splitlines() if "Aggregate" in a)
    assert [tuple(r)[1:] for r in got.where("query_id = 7").orderBy("rank").collect()] == [(2, 1, 1.0, 1), (3, 1, 0.5, 2), (1, 1, 0.5, 3)]


def test_a_query_in_two_rows_counts_its_tags_twice(spark):
    q = spark.createDataFrame([(1, ["a", "b"]), (1, ["a"]), (2, None)], "query int, tags array<string>")
    p = spark.createDataFrame([(5, ["a"], 0, 5), (6, ["b"], 1, 6), (7, ["c"], 1, 7)], "id int, tags array<string>, preferred int, seq int")
    got = R.group_ranking(q, p, 1)
    assert [tuple(r) for r in got.orderBy("place").collect()] == [(1, 5, 2, 1, True), (1, 6, 1, 2, False)]
    assert not any("query" in a and "seq" in a for a in plan_of(got).splitlines() if "Aggregate" in a)


def test_quotas_count_groups_in_their_own_order(spark):
    rows = spark.createDataFrame([(1, None, 10, 1), (1, None, 11, 2), (1, None, 12, 3), (2, "a", 10, 1), (2, "b", 10, 2), (2, "b", 11, 3), (None, "a", 1, 1)], "o int, group string, item int, rank int")
    got = C.within_quota(rows, "o", "item", 8)
    assert "Join" not in plan_of(got)
    assert [tuple(r) for r in got.orderBy("o", "pos").collect()] == [(1, None, 10, 1), (1, None, 11, 2), (2, "a", 10, 1), (2, "b", 11, 2)]


def test_text_is_made_plain_once_for_all_stems(spark):
    d = spark.createDataFrame([(1, "The end"), (2, None), (3, "nothing")], "id int, text string")
    got = C.match_tags(d, {"article": ["the ", "le "], "last": ["end"]})
    assert plan_of(got).count("lower(") == 1
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(1, ["article", "last"]), (2, []), (3, [])]


def test_passages_of_one_prefix_are_looked_up_once(spark):
    p = spark.range(200).select("id", F.when(F.col("id") % 5 > 0, "s").alias("source"), F.when(F.col("id") % 2 == 0, "Part 1").otherwise("part 12").alias("ref"), F.when(F.col("id") % 3 == 0, "EN").alias("match"))
    p = p.unionByName(p.where("id = 1").withColumn("ref", F.lit("part 3")))
    c = spark.range(60).select(F.lit("s").alias("source"), F.col("id").alias("pos"), F.concat(F.lit("Part "), (F.col("id") % 20).cast("string")).alias("ref"), F.when(F.col("id") % 4 > 0, "when").otherwise("on").alias("content"))
    got = P.prefix_resolution(p, c)
    want = P.resolution(p, P.prefix_hits(p, c))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert any("Aggregate [key#" in a for a in plan_of(got).splitlines())


def test_composition_sends_only_unsettled_texts_to_python(spark):
    texts = ["plain", "café “q”", "é", "가", "Å", "á̧", "አማ", "क़", "\U0001d15e", None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    rows = d.select("t", X.composed(F.col("t")).alias("c"), F.col("t").rlike(X.unsettled()).alias("u")).collect()
    assert all(r["c"] == (r["t"] if r["t"] is None else unicodedata.normalize("NFC", r["t"])) for r in rows)
    assert [bool(r["u"]) for r in rows] == [False, False, True, True, True, True, False, True, True, False, False]


def test_sections_read_their_lines_once(spark):
    lines = spark.createDataFrame([(1, k, x) for k, x in enumerate(["before it all", "", "CHAPTER IV", "", "one", "two", "THE LONG ROAD", "three"])], "doc int, pos int, line string")
    got = S.to_sections(S.clean_lines(lines), "Preface")
    assert "Join" not in plan_of(got)
    assert [tuple(r)[1:] for r in got.orderBy("section").collect()] == [(0, "Preface", 1, "before it all"), (1, "CHAPTER IV", 1, "one two"), (2, "THE LONG ROAD", 1, "three")]


def test_marked_verses_read_their_segments_once(spark):
    from sieveline.operators import usfm

    t = "\\id GEN x\n\\c 1\n\\d A title\n\\p\n\\v 1 one\n\\q two\n\\s1 Head\n\\p of\n\\v 2 three\n\\c 2\n\\v 1 four"
    got = usfm.verses(spark.createDataFrame([(1, t)], "doc int, text string"))
    assert "Join" not in plan_of(got)
    assert [tuple(r)[3:] for r in got.orderBy("pos").collect()] == [(1, 1, "A title one two", True, None), (1, 2, "of three", True, "Head"), (2, 1, "four", True, None)]
