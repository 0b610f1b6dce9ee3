from sieveline.llm import chat_format, quality_rules
from sieveline.llm.common import materialise

from ..compare import same
from ..conftest import SF


def test_quality_query_equals_sql(spark):
    same(quality_rules.query(spark, SF), quality_rules.SQL, SF)


def test_chat_query_equals_sql(spark):
    same(chat_format.query(spark, SF), chat_format.SQL, SF)


def test_quality_of_odd_documents(spark, odd_docs, no_docs):
    got = quality_rules.quality_verdicts(odd_docs).toPandas()
    assert len(got) == odd_docs.count() and got[got.n_words == 0].base_failed.all() and not (got.base_failed & got.kept).any()
    kept = quality_rules.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == got.kept.sum()
    assert quality_rules.quality_verdicts(no_docs).count() == 0 and quality_rules.keep_good(no_docs).count() == 0


def test_repeated_windows_by_hand(spark):
    texts = ["a b c d e f a b c d e", "x " * 12, "a b c d", "p q r s t u v p q r s t u v"]
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.quality_verdicts(spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")).collect()}
    for k, t in enumerate(texts):
        w = t.split()
        wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        assert got[k] == len({i + j for i, x in enumerate(wins) if wins.count(x) > 1 for j in range(5)})


def test_symbol_junk_goes_and_prose_stays(spark):
    rows = [(k, f"plain words number {k} in a quiet line of prose that goes on for a while", "en", "s") for k in range(150)] + [(999, "word### " * 3 + "other$$$ thing&&& more*** and%%% then||| some<<< text>>> here### now***", "en", "s")]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[999] and all(got[k] for k in range(150))


def test_snapshots_collapse(spark):
    a = [("user", "hi"), ("assistant", "yo"), ("user", None), ("assistant", "")]
    logs = {1: a[:1], 2: a[:2], 3: a, 4: a, 5: a[:2] + [("user", "")], 6: [("assistant", "hi")], None: [("user", "q")]}
    rows = [(c, t, role, text, "x") for c, turns in logs.items() for t, (role, text) in enumerate(turns)]
    rows += rows[:3] + [(7, None, None, None, None), (8, 5, "user", "t"), (8, 5, "user", "u")][:1] + [(8, 5, "user", "t", "x"), (8, 5, "user", "u", "x")]
    d = spark.createDataFrame([r if len(r) == 5 else (*r, "x") for r in rows], "conv_id long, turn long, role string, text string, k string")
    got = {r["conv_id"]: r for r in chat_format.format_chats(d).collect()}
    assert set(got) == {3, 5, 6, None, 7, 8} and got[3]["n_copies"] == 2 and got[8]["n_turns"] == 2
    assert got[5]["rendered"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert chat_format.format_chats(d.limit(0)).count() == 0


def test_rolling_hash_over_chunks(spark):
    rows = [(c, t, "user", f"turn {t}") for c, n in ((1, 700), (2, 600), (3, 601)) for t in range(n)] + [(3, 900, "user", "other")]
    got = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select("conv_id", "n_turns").collect()
    assert {tuple(r) for r in got} == {(1, 700), (3, 602)}


def test_rejected_row_leaves_its_twin_of_another_source(spark):
    """One id and text under two sources: a fence of source a rejects it, b's own does not."""
    line = lambda k, n: " ".join(f"word{k}x{j}" + "#" * (j < n) for j in range(30))
    rows = [(k, line(k, 0), "en", "a") for k in range(150)] + [(1000 + k, line(k, 12), "en", None) for k in range(150)]
    rows += [(5000, line(999, 12), "en", "a"), (5000, line(999, 12), "en", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = quality_rules.quality_verdicts(d).where("doc_id = 5000").collect()
    kept = quality_rules.keep_good(d)
    assert sorted(r["kept"] for r in got) == [False, True]
    assert [r["source"] for r in kept.where("doc_id = 5000").collect()] == [None] and kept.count() == quality_rules.quality_verdicts(d).where("kept").count()


def test_thresholds_follow_their_group_at_every_size(spark):
    """Two sources that differ in every measure: each measure has another threshold; a small one leans on its language."""
    plain = lambda k: "\n".join(" ".join(f"w{k}q{i}{j}" for j in range(12)) for i in range(4))
    other = lambda k: "\n".join([" ".join(f"longerword{k}q{i}{j}#" for j in range(12)) for i in range(8)] + [f"longer {k} line"] * 3 + [f"aa{k} bb cc dd ee"] * 2)
    rows = []
    for lang, n in (("l1", 60), ("l2", 400)):
        rows += [(k, plain(k), lang, "a") for k in range(n)] + [(10_000 + k, other(k), lang, "b") for k in range(n)] + [(20_000, plain(20_000), lang, "c")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    m = materialise(quality_rules.measure(d.selectExpr("doc_id", "text q_text", "lang lk", "source sk"), "q_text").drop("q_text"), "measured")
    got = {(r["lk"], r["sk"]): r for r in quality_rules.thresholds(m).collect()}
    for lang in ("l1", "l2"):
        high = {s: [got[lang, s][f"f_{x}"]["high"] for x in quality_rules.FLOORS] for s in "abc"}
        assert all(x < y for x, y in zip(high["a"], high["b"])) and all(x <= y for x, y in zip(high["a"], high["c"]))
