import datetime as dt
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.functions import numeric as N
from sieveline.functions import text as X
from sieveline.operators import ingest, metrics, mining, retrieval, stats
from sieveline.plans import retrieval as plans
from sieveline.sources import tables
from sieveline.sources.shared import written
from sieveline.streaming import state


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_terms_and_sentences(spark):
    assert one(spark, X.content_terms(F.lit("The cities verify 2024 classes, series & buses"))) == ["city", "verify", "2024", "classe", "sery", "buse"]
    assert one(spark, X.sentences(F.lit("One. Two!  Three? four"))) == ["One.", "Two!", "Three?", "four"]
    assert one(spark, X.paragraphs(F.lit("a  b\n\n \n c\n\n"))) == ["a b", "c"]


def test_sentences_keep_their_first_digits(spark):
    """the place of a sentence was taken for the characters to trim, so that sentence 1 lost its leading ones."""
    assert one(spark, X.sentences(F.lit("0 a.  11 b1! 2 c2. 3"))) == ["0 a.", "11 b1!", "2 c2.", "3"]


def test_entities_keep_counts(spark):
    got = one(spark, X.entity_mentions(F.lit("The Graph Model beats BERT-2. However GNN wins; Graph Model again.")))
    assert sorted(got) == sorted(["Graph Model", "BERT-2", "GNN", "Graph Model", "BERT-2", "GNN"])


@pytest.mark.parametrize("ref, want", [("2 Samuel 11:1-27", ("2 Samuel", 11, 1, 11, 27)), ("Genesis 1:31-2:3", ("Genesis", 1, 31, 2, 3)), ("Psalm 51", ("Psalm", 51, 1, 51, 999)), ("Jude 1:5", ("Jude", 1, 5, 1, 5)), ("nothing", None)])
def test_parse_ref(spark, ref, want):
    got = one(spark, X.parse_ref(F.lit(ref)))
    assert (tuple(got) if got else None) == want


def test_sanitize_fold_script_json(spark):
    assert one(spark, X.sanitize(F.lit("é\x00\tx"))) == "é\tx"
    assert one(spark, X.fold_ethiopic(F.lit("ሠሐዐፀኀ"))) == "ሰሀአጸሀ"
    assert one(spark, X.text_script(F.lit("123"))) is None
    assert one(spark, X.parse_json_loose(F.lit('say ```json\n{"k": 3}\n``` ok'), "k int"))["k"] == 3


def test_vector_rules(spark):
    d = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, N.cosine(d(1, 0), d(1, 1))) == pytest.approx(math.sqrt(0.5))
    assert one(spark, N.cosine(d(0, 0), d(1, 1))) is None and one(spark, N.cosine(d(1), d(1, 1))) is None
    assert one(spark, tables.parse_vector(F.lit("[1, 2.5]"))) == [1.0, 2.5] and one(spark, tables.parse_vector(F.lit("[1, null]"))) is None


def test_fnv_and_prng(spark):
    h = 2166136261
    for c in b"entity|a|b":
        h = ((h ^ c) * 16777619) & 0xFFFFFFFF
    assert one(spark, N.fnv1a(F.lit("entity|a|b"))) == h / 2**32
    a, want = 42, []
    for _ in range(5):
        a = (a + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((a ^ (a >> 15)) * (a | 1)) & 0xFFFFFFFF
        t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
        want.append(((t ^ (t >> 14)) & 0xFFFFFFFF) / 2**32)
    assert [r["x"] for r in stats.prng(spark, 42, 5).orderBy("k").collect()] == want


def test_calendar(spark):
    day = lambda y, m, d: (dt.date(y, m, d) - dt.date(1970, 1, 1)).days
    got = one(spark, N.church_day(F.lit(day(2023, 9, 12)).cast("long")))
    assert (got["year"], got["month"], got["day"], got["feast"]) == (2016, 1, 1, "enkutatash")
    assert one(spark, N.easter(F.lit(2024))) == day(2024, 5, 5) and one(spark, N.easter(F.lit(2023))) == day(2023, 4, 16)


def test_metric_edges(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (3, 12, 1)], "query_id long, id long, rank int")
    truth = spark.createDataFrame([(1, 11), (1, 99), (2, 5)], "query_id long, id long")
    rows = {(r["query_id"], r["k"]): r for r in metrics.score_rankings(q, hits, truth, (1, 3)).collect()}
    assert rows[1, 1]["recall"] == 0 and rows[1, 3]["recall"] == 0.5 and rows[1, 3]["precision"] == 0.5 and rows[1, 3]["mrr"] == 0.5
    assert rows[2, 3]["recall"] == 0 and rows[2, 3]["precision"] == 0 and rows[3, 3]["recall"] is None


def test_two_quantile_rules(spark):
    d = spark.createDataFrame([(float(x),) for x in range(1, 11)], "v double")
    r = metrics.ranks(d, [], "v", {"a": 0.5}, {"b": 0.5}).first()
    assert (r["a"], r["b"]) == (5.0, 6.0)
    assert d.where("v > 99").agg(metrics.nearest_rank("v", 0.5).alias("a")).first()["a"] == 0


def test_bootstrap_equals_a_loop(spark):
    values = [0.0, 1.0, 0.5, 0.25, 1.0, 0.0, 0.75]
    draws = iter([r["x"] for r in stats.prng(spark, 7, 200 * 7).orderBy("k").collect()])
    want = [sum(values[int(next(draws) * 7)] for _ in range(7)) / 7 for _ in range(200)]
    d = spark.createDataFrame(list(enumerate(values)), "pos long, x double")
    assert [r["m"] for r in stats.resampled_means(d, 200, 7).orderBy("i").collect()] == want


def test_mcnemar_holm_kappa(spark):
    pairs = [(True, False)] * 2 + [(False, True)] * 9 + [(True, True)] * 5
    r = stats.mcnemar(spark.createDataFrame(pairs, "a boolean, b boolean")).first()
    want = 2 * sum(math.comb(11, i) for i in range(3)) / 2**11
    assert r["p_value"] == pytest.approx(want) and r["statistic"] == pytest.approx(36 / 11)
    h = stats.holm(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "test string, p double")).orderBy("test").collect()
    assert [x["adjusted"] for x in h] == pytest.approx([0.03, 0.06, 0.06])
    k = stats.kappa(spark.createDataFrame([("x", "x")] * 4, "a string, b string")).first()
    assert k["kappa"] == 1.0 and not k["weak"]


def test_packing_moves_on():
    rng = random.Random(3)
    for _ in range(300):
        sizes, target = [rng.randint(1, 40) for _ in range(rng.randint(0, 30))], rng.randint(5, 60)
        runs = ingest.pack(sizes, target, target // 6)
        assert not sizes and not runs or runs[0][0] == 0 and runs[-1][1] == len(sizes)
        for (a, b), (c, d) in zip(runs, runs[1:]):
            assert a < c <= b <= d
        assert all(sum(sizes[a:b]) <= target or b - a == 1 for a, b in runs)


def test_chunks_and_stripping(spark):
    text = "\n\n".join(f"Paragraph {k} " + "word " * 30 for k in range(12))
    p = spark.createDataFrame([(1, 1, text), (2, 1, ""), (3, 1, None)], "doc_id long, page int, page_text string")
    c = ingest.chunk_pages(p, 100).orderBy("chunk").collect()
    assert {r["doc_id"] for r in c} == {1} and all(r["tokens"] <= 101 for r in c) and "Paragraph 11" in c[-1]["content"]
    pages = [(1, k, f"body {'x' * 50} {k}\nPage {k}\nhead") for k in range(4)] + [(2, 0, "head"), (2, 1, "head")]
    got = {(r["doc_id"], r["page"]): r["page_text"] for r in ingest.strip_repeated_lines(spark.createDataFrame(pages, "doc_id long, page int, page_text string")).collect()}
    assert all(got[1, k] == f"body {'x' * 50} {k}" for k in range(4)) and got[2, 0] == "head"


def test_plan_is_idle_on_a_second_run(spark):
    e = spark.createDataFrame([(1, "a", ["x", "y"]), (2, "b", ["x"])], "key long, digest string, tags array<string>")
    x = e.select("key", "digest", F.lit(True).alias("embedded"), F.reverse("tags").alias("tags"))
    assert {r["action"] for r in ingest.ingest_plan(e, x).collect()} == {"done"}
    assert {r["action"] for r in ingest.ingest_plan(e, x.limit(0)).collect()} == {"embed"}


def test_gates_and_overlap_filter(spark):
    b = spark.createDataFrame([("a", 0.0), ("b", 1.0), ("c", 2.0)], "metric string, value double")
    a = spark.createDataFrame([("a", 5.0), ("b", 1.5)], "metric string, value double")
    t = spark.createDataFrame([(m, 0.2) for m in "abc"], "metric string, threshold double")
    got = {r["metric"]: (r["failed"], r["note"]) for r in metrics.resource_gate(b, a, t).collect()}
    assert got == {"a": (False, "baseline is zero"), "b": (True, None), "c": (False, "missing")}
    tags = F.array(F.lit("x"), F.lit(None).cast("string"))
    assert one(spark, retrieval.overlap_filter(tags, F.array(F.lit("x")))) is True and one(spark, retrieval.overlap_filter(tags, F.array(F.lit("q")))) is False


def test_run_files(spark):
    lines = [("f", 0, '{"type":"run","runId":"r1","startedAt":"2024"}'), ("f", 1, '{"type":"result","questionId":"q","error":null}'), ("f", 2, '{"type":'), ("g", 0, '{"type":"run","runId":"r2"}'), ("g", 1, '{"type":"result","questionId":"q","error":"x"}'), ("h", 0, '{"type":"result"}')]
    usable, results = tables.runs(spark.createDataFrame(lines, "file string, line int, value string"), "questionId string, error string")
    assert [r["run_id"] for r in usable.collect()] == ["r1"] and results.count() == 2
    head, rows = tables.jsonl(spark.createDataFrame([("# note",), ('{"id":"a"}',), ("",)], "value string"), "id string")
    assert head.count() == 1 and [r["id"] for r in rows.collect()] == ["a"]


def events(n, seed):
    rng, at = random.Random(seed), dt.datetime(2024, 1, 1)
    return [(rng.randint(0, 4), i, at + dt.timedelta(seconds=60 * i)) for i in range(n)]


def by_hand(rows, most, window):
    seen, out = {}, {}
    for key, i, ts in sorted(rows, key=lambda r: (r[2], r[1])):
        recent = [t for t in seen.get(key, []) if (ts - t).total_seconds() < window]
        out[i] = len(recent) < most
        seen[key] = recent + [ts] * out[i]
    return out


def test_limiter_equals_a_loop(spark):
    rows = events(400, 5)
    d = spark.createDataFrame(rows, "key long, event_id long, ts timestamp")
    got = {r["event_id"]: r["admitted"] for r in state.limit_events(d, 2, 900.0).collect()}
    assert got == by_hand(rows, 2, 900) and not all(got.values())


def test_limiter_stream(spark, tmp_path):
    rows = events(60, 6)
    source = str(tmp_path / "in")
    d = spark.createDataFrame(rows, "key long, event_id long, ts timestamp")
    for k in range(3):
        d.where(f"event_id >= {20 * k} and event_id < {20 * k + 20}").coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.05)
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = state.limit_stream(stream, 2, 900.0).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["event_id"]: r["admitted"] for r in spark.table("limited").collect()}
    assert got == by_hand(rows, 2, 900)


def test_counters_claims_and_cache(spark):
    e = spark.createDataFrame([("a", 1, dt.datetime(2024, 1, 1, 22)), ("a", 2, dt.datetime(2024, 1, 1, 20)), ("", 3, dt.datetime(2024, 1, 1))], "name string, event_id long, ts timestamp")
    assert sorted(r["n"] for r in state.daily_counts(e).collect()) == [1, 1]
    assert {r["event_id"] for r in state.claims(e.where("name = 'a'"), ["name"]).collect()} == {2}
    c = spark.createDataFrame([("k", "old", dt.datetime(2024, 1, 1)), ("k", "new", dt.datetime(2024, 1, 2, 1))], "key string, body string, at timestamp")
    assert state.fresh(c, dt.datetime(2024, 1, 2, 2)).first()["body"] == "new"


def test_log_factorial(spark):
    import math

    from pyspark.sql import functions as F

    got = spark.createDataFrame([(k,) for k in (0, 1, 2, 7, 100, 10**6, 10**12)], "k long").select("k", stats.log_factorial(F.col("k")).alias("x")).collect()
    assert all(abs(r["x"] - math.lgamma(r["k"] + 1)) <= 1e-9 + 1e-12 * abs(r["x"]) for r in got)


def test_report_rules_on_nulls(spark):
    from pyspark.sql import functions as F

    from sieveline.operators import reports as R

    rows = [(None, None, None, None, None), ("e", 1.0, 1.0, "x", ["a"]), (None, 0.0, 1.0, "It does NOT say so", ["a", "b"]), (None, None, 0.0, "", [])]
    d = spark.createDataFrame(rows, "error string, correctness double, hit double, answer string, tags array<string>")
    got = d.select(R.failed(F.col("error"), F.col("correctness"), F.col("hit")).alias("f"), R.refuses(F.col("answer")).alias("r"), R.covers(F.col("tags"), F.array(F.lit("a"))).alias("c")).collect()
    assert [tuple(r) for r in got] == [(False, False, False), (True, False, True), (True, True, True), (True, False, False)]
    n = spark.range(0, 1001).select("id", R.roman(F.col("id")).alias("r")).select("id", "r", R.from_roman(F.col("r")).alias("back")).collect()
    assert all(r["back"] == (r["id"] or None) for r in n) and n[444]["r"] == "CCCCXLIV" and n[99]["r"] == "XCIX"
    bad = spark.createDataFrame([("IIX",), ("IVI",), ("",), ("abc",), (None,), ("xiv",), ("CD",), ("XIV",)], "t string").select(R.from_roman(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in bad] == [None, None, None, None, None, None, None, 14]
    flagged = spark.createDataFrame([(1, True), (2, None), (3, False), (4, True)], "k long, s boolean")
    assert {r["k"]: r["place"] for r in R.flagged_last(flagged, "s", "k").collect()} == {2: 1, 3: 2, 1: 3, 4: 4}
    assert R.flagged_last(flagged.limit(0), "s", "k").count() == 0 and R.latest_finished(spark.createDataFrame([], "run_id long, started timestamp, finished timestamp")).count() == 0


def test_limiter_keeps_null_keys(spark):
    rows = [(None, 1, "2024-01-01 00:00:00"), (2**60 + 1, 2, "2024-01-01 00:00:01"), (None, 3, "2024-01-01 00:00:02"), (None, 4, "2024-01-01 00:00:03")]
    d = spark.createDataFrame(rows, "key long, event_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = {r["event_id"]: (r["key"], r["admitted"]) for r in state.limit_events(d, 2, 900.0).collect()}
    assert got == {1: (None, True), 2: (2**60 + 1, True), 3: (None, True), 4: (None, False)}


def test_numbers_too_long(spark):
    assert one(spark, X.citations(F.lit("It is so [99999999999]. Or [2].")))[0]["marker"] == 2**31 - 1
    assert one(spark, X.parse_ref(F.lit("Mark 99999999999:1"))) is None


@pytest.mark.parametrize("block", [1 << 26, 64])
def test_dense_search_by_tags_and_lengths(spark, monkeypatch, block):
    """Tags, null and empty tags, ties, zero, null and longer vectors, against a plain loop, in one block and in many."""
    monkeypatch.setattr(retrieval, "QUERY_BYTES", block)
    monkeypatch.setattr(retrieval, "PRODUCT", 3)
    rng = np.random.RandomState(4)
    vectors = [rng.randint(-2, 3, 3).astype(float).tolist() for _ in range(40)] + [None, [0.0] * 3, [1.0, None, 2.0], [1.0, 2.0]]
    base = [(k, v, [k % 3, None] if k % 5 else None) for k, v in enumerate(vectors)]
    asked = [(100 + k, v, [None, [], [1], [0, 1, 1], [2, None]][k % 5]) for k, v in enumerate(vectors[:12] + vectors[-4:])]
    b = spark.createDataFrame(base, "id long, vector array<double>, tags array<long>")
    q = spark.createDataFrame(asked, "query_id long, vector array<double>, tags array<long>")

    def plain(tagged):
        out = set()
        for qid, u, wanted in asked:
            found = []
            for i, v, tags in base:
                if u is None or v is None or None in u or None in v or len(u) != len(v) or not any(u) or not any(v):
                    continue
                if not tagged or not wanted or set(wanted) & set(tags or ()) - {None}:
                    c = np.dot(u, v) / np.sqrt(np.dot(u, u) * np.dot(v, v))
                    found.append((-round(c, 6) + 0.0, i))
            out |= {(qid, i, n + 1) for n, (_, i) in enumerate(sorted(found)[:4])}
        return out

    for tagged in (False, True):
        got = retrieval.dense_topk(q if tagged else q.drop("tags"), b if tagged else b.drop("tags"), 4)
        assert {(r["query_id"], r["id"], r["rank"]) for r in got.collect()} == plain(tagged)


def test_near_duplicates_finds_planted_ones(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, a, 5), (2, b, 6), (3, [0.99, 0.05, 0.0], 5), (4, [0.5, 0.5, 0.7], 6), (5, [0.0, 2.0, 0.1], 9)]
    d = spark.createDataFrame(rows, "id long, vector array<double>, doc long")
    got = mining.near_duplicates(d.where("id <= 2").withColumnRenamed("id", "query_id"), d, 0.85).collect()
    assert {(r["id"], r["labelled_id"], r["same_doc"]) for r in got} == {(3, 1, True), (5, 2, False)}


def test_markers_follow_the_interval_first(spark):
    from pyspark.sql import functions as F

    from sieveline.operators import reports as R

    rows = [(0.01, 0.2, 0.06), (-0.1, 0.2, 0.0001), (0.1, 0.2, 0.0001), (-0.2, -0.1, 0.005), (0.0, 0.2, 0.04), (0.1, 0.2, None)]
    d = spark.createDataFrame(rows, "lo double, hi double, p double")
    assert [r["m"] for r in d.select(R.significance(F.col("lo"), F.col("hi"), F.col("p")).alias("m")).collect()] == ["*", "ns", "***", "**", "ns", "*"]


@pytest.mark.parametrize("top, others, p", [(7, 0, 0.015625), (7, 1, 0.0703125), (6, 4, 0.75390625), (3, 0, 0.25), (5200, 4800, 6.6e-5)])
def test_a_majority_is_no_direction(spark, top, others, p):
    from sieveline.operators import curation

    rows = [(1, 0)] * top + [(0, 1)] * others + [(1, 1), (0, 0)] * 3
    r = curation.agreement(spark.createDataFrame([("g", *x) for x in rows], "g string, a int, b int"), "g").first()
    assert r["bias_p"] == pytest.approx(p, rel=0.05) and (r["flag"] == "BIASED") == (p < 0.05)


def test_recall_of_documents_and_metrics_by_name(spark):
    q = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "query_id string")
    hits = spark.createDataFrame([("a", 1, "x", 1), ("a", 2, "x", 2), ("a", 3, "y", 4), ("a", 9, "w", 30), ("b", 1, "x", 1), ("d", 5, "v", 25)], "query_id string, id int, doc string, rank int")
    truth = spark.createDataFrame([("a", 3), ("a", 9), ("b", 7), ("d", 5)], "query_id string, id int")
    docs = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), ("a", "z"), ("b", "q"), ("d", "v")], "query_id string, doc string")
    got = {(r["query_id"], r["metric"]): r["value"] for r in metrics.score_names(q, hits, truth, docs).collect()}
    assert len(got) == 4 * 31
    assert [got["a", f"docRecall@{k}"] for k in (1, 3, 5, 10, 20)] == [0.333333, 0.333333, 0.666667, 0.666667, 0.666667]
    assert got["b", "docRecall@20"] == 0 and got["c", "docRecall@1"] is None and got["c", "mrr"] is None and got["b", "mrr"] == 0
    assert got["a", "mrr"] == 0.25 and got["a", "mrr@3"] == 0 and got["d", "mrr"] == 0.04 and got["d", "mrr@20"] == 0 and got["a", "recall@5"] == 0.5
    assert metrics.score_names(q.limit(0), hits, truth, docs).count() == 0


def test_best_sums_in_blocks_equal_all_pairs(spark, monkeypatch):
    """F11-F13, F15: pairs of queries and documents were rows of two exchanges."""
    rng = random.Random(5)
    asked = [(q, f"t{t}", float(rng.randint(1, 9))) for q in range(7) for t in rng.sample(range(30), 6)]
    held = [(d, f"t{t}", float(rng.randint(1, 9))) for d in range(50) for t in rng.sample(range(30), 8)]
    q, c = spark.createDataFrame(asked, "query_id int, term string, weight double"), spark.createDataFrame(held, "id long, term string, value double")
    want = {}
    for a, t, w in asked:
        for d, u, v in held:
            if t == u:
                want[a, d] = want.get((a, d), 0.0) + w * v
    for name, size in (("PRODUCT", 1 << 22), ("PRODUCT", 20), ("QUERY_BYTES", 300)):
        monkeypatch.setattr(retrieval, name, size)
        got = retrieval.top(retrieval.best_sums(q, c, 5, 1.0), "query_id", [F.desc("score"), F.asc("id")], 5)
        for a in range(7):
            best = sorted(((-s, d) for (x, d), s in want.items() if x == a))[:5]
            assert [(r["id"], r["score"]) for r in got.where(f"query_id = {a}").orderBy("rank").collect()] == [(d, -s) for s, d in best]


def test_norms_of_frequent_and_rare_terms(spark, monkeypatch):
    d = spark.createDataFrame([(1, "alpha beta beta gamma"), (2, "alpha delta"), (3, "alpha beta"), (4, "")], "id long, text string")
    want = {r["id"]: r["norm"] for r in retrieval.norms(d, written(retrieval.idf(d), "weights")).collect()}
    monkeypatch.setattr(retrieval, "HOT", 2)
    got = {r["id"]: r["norm"] for r in retrieval.norms(d, written(retrieval.idf(d), "weights")).collect()}
    assert got == pytest.approx(want) and set(got) == {1, 2, 3}


@pytest.mark.parametrize(("block", "at_once"), [(1 << 26, 1 << 20), (300, 40)])
def test_holders_are_all_texts_that_contain_a_passage(spark, monkeypatch, block, at_once):
    """passages of fewer than eight words, and those that begin or end within a word, were in no document."""
    monkeypatch.setattr(retrieval, "QUERY_BYTES", block)
    monkeypatch.setattr(retrieval, "SOUGHT", at_once)
    rng = random.Random(11)
    texts = ["one two three", "xone two threes", "", None, "ab\tcd", "é" * 40, "a\0b", *(" ".join(rng.choices(["ab", "abc", "b", "ca", "é", "日本"], k=rng.randint(1, 60))) for _ in range(40))]
    long = [t[a : a + n] for t in texts if t for a, n in ((rng.randrange(len(t)), rng.randint(1, 90)) for _ in range(3))]
    asked = ["one two three", "two", "", None, "b\tc", "é", "é" * 33, "\0", "not there", "one two three ", *long]
    d, q = spark.createDataFrame(list(enumerate(texts)), "id long, text string"), spark.createDataFrame([(f"q{k}", t) for k, t in enumerate(asked)], "query_id string, text string")
    want = sorted((f"q{k}", i) for k, p in enumerate(asked) for i, t in enumerate(texts) if p is not None and t is not None and p in t)
    assert sorted(map(tuple, plans.holders(q, d).collect())) == want
    assert plans.holders(q.limit(0), d).count() == plans.holders(q, d.limit(0)).count() == 0


def test_long_texts_with_one_beginning_are_told_apart():
    texts = [(b"x" * 50 + str(k).encode()) for k in range(300)] + [b"x" * 31]
    got = sorted((a, p) for at, passage in retrieval.Passages(texts).within(b"x" * 60 + b"17 xx") for a, p in zip(at.tolist(), passage.tolist()))
    assert got == sorted([(10, 17), (10, 1)] + [(k, 300) for k in range(30)])
