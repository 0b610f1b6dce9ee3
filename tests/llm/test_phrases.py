import random
import re
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from sieveline.llm import phrases

from ..compare import same
from ..conftest import SF

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, support, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    often = {p: c for p, c in f.items() if c >= support}
    held = Counter()
    for (lang, *w), c in often.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                held[(lang, *w[i : i + k])] = max(held[(lang, *w[i : i + k])], c)
    out = []
    for (lang, *w), a in often.items():
        if len(w) > 1 and 100 * held[(lang, *w)] < 80 * a:
            cuts = [(2000000 * a // (f[(lang, *w[:k])] + f[(lang, *w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.append((lang, -score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    got, rank = [], Counter()
    for lang, score, a, p, l, r in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            got.append((lang, rank[lang], p.decode(), -a, l, r, n[lang], -score))
    return got


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    words = ["the", "The", "of", "a", "New", "york", "city", "hall", "é", "中", "x" * 300, "it's"]
    rows = []
    for k in range(400):
        t = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\x0b", "   "]) for _ in range(rng.randint(0, 60)))
        rows.append((k, t, rng.choice(["en", "fr", None, "und", ""]), "src", 1))
    rows += [(None, None, "en", None, None), (1, "", None, "s", 0), (2, "new york city hall " * 3000, "en", "s", 0)] + [rows[5]] * 40
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n string, f long")


def test_phrases_equal_brute_force(texts):
    rows = [(r["lang"], r["text"]) for r in texts.collect()]
    for support, top in ((30, 2000), (5, 40), (300, 7)):
        assert rows_of(phrases.collocations(texts, support, top)) == sorted(brute(rows, support, top))


def test_phrases_without_help_of_bitmaps(texts, monkeypatch):
    """Few buckets let everything pass, tiny batches cut long texts: the result stays."""
    monkeypatch.setattr(phrases, "MOST_BITS", 3)
    monkeypatch.setattr(phrases, "LEAST_BITS", 3)
    rows = [(r["lang"], r["text"]) for r in texts.collect()]
    assert rows_of(phrases.collocations(texts, 20, 100)) == sorted(brute(rows, 20, 100))


def test_phrases_of_nothing(spark, no_docs, odd_docs):
    assert phrases.collocations(no_docs).count() == 0
    rows = [(r["lang"], r["text"]) for r in odd_docs.collect()]
    assert rows_of(phrases.collocations(odd_docs, 3)) == sorted(brute(rows, 3, 2000))


def test_phrases_equal_sql(spark):
    sf = SF.replace("0.001", "0.01")
    same(phrases.query(spark, sf), phrases.SQL, sf)


def test_long_texts_are_cut_at_piece_ends():
    text = b"a b c. d e f, g h" * 50
    parts = list(phrases.cut([text, b"", b"no end here at all"], 40))
    assert b"".join(t for k, t in parts if k == 0) == text and all(t[-1:] in b".," for k, t in parts[:-3]) and len(parts) > 10


def test_words_with_one_hash_are_counted_apart():
    runs = phrases.Runs([b"aa bb aa cc bb aa"], ["en"])
    same_id = np.zeros(6, dtype=np.uint64)
    one, count = phrases.word_counts(runs, same_id, same_id)
    got = {runs.buf[runs.start[k] : runs.end[k]].tobytes(): c for k, c in zip(one, count)}
    assert got == {b"aa": 3, b"bb": 2, b"cc": 1}


def test_a_task_holds_little_beside_its_texts(monkeypatch):
    """Numbers of 8 bytes for each byte of a batch, and rows of a whole batch at once, took over 300 MB of a worker."""
    monkeypatch.setattr(phrases, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(60_000)]
    texts = [" ".join(rng.choices(words, k=3000)) for _ in range(300)]
    batch = pa.record_batch({"text": texts, "lang": ["en"] * len(texts)})
    for n in (1, 2):
        tracemalloc.start()
        sizes, words_out = [], 0
        for out in phrases.one_pass(n, phrases.Hasher(0), None, 16, 30)([batch]):
            sizes.append(out.num_rows)
            words_out += sum(c for c, kind in zip(out.column("c").to_pylist(), out.column("kind").to_pylist()) if kind == 0)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert max(sizes) <= 1 << 15 and words_out == (3000 - n + 1) * 300
        assert peak < 100 << 20, peak


def test_ids_do_not_depend_on_the_place(monkeypatch):
    text = b"one two  three\tone " + b"x" * 300 + b" two, y" * 40
    runs = phrases.Runs([text], ["en"])
    whole = phrases.Hasher(0).ids(runs.buf, runs.start, runs.end)
    one, count = phrases.word_counts(runs, whole, whole)
    monkeypatch.setattr(phrases, "STRETCH", 20)
    assert (phrases.Hasher(0).ids(runs.buf, runs.start, runs.end) == whole).all()
    assert all((x == y).all() for x, y in zip(phrases.word_counts(runs, whole, whole), (one, count)))
    assert len(list(phrases.stretches(runs.start, runs.end))) > 10


def test_texts_reach_tasks_in_small_batches(spark, monkeypatch):
    inner = phrases.one_pass

    def watched(*args):
        run = inner(*args)

        def task(given):
            def small():
                for batch in given:
                    if batch.nbytes > 4 << 20:
                        raise ValueError(f"{batch.nbytes} bytes at once")
                    yield batch

            yield from run(small())

        return task

    monkeypatch.setattr(phrases, "one_pass", watched)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(0, 100, 1, 1).selectExpr("'en' AS lang", "repeat('one more word. ', 10000) AS text")
    every, _, totals = phrases.frequent_phrases(docs)
    assert totals.collect()[0]["n"] == 3_000_000
    assert {r["f"] for r in every.collect()} == {1_000_000}
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_bitmaps_are_packed_by_the_step_that_adds(spark, monkeypatch):
    def second(*_):
        raise AssertionError("a second Python step")

    blocks = [(part, s, np.full(1 << 16, 1, np.uint8).tobytes()) for part in range(70) for s in range(2) if part < 40 or s]
    d = spark.createDataFrame(blocks, "part int, slice int, block binary")
    monkeypatch.setattr(type(d), "mapInPandas", second)
    got = np.unpackbits(phrases.bitmap(d, 17, 50), bitorder="little")
    assert not got[: 1 << 16].any() and got[1 << 16 :].all()
