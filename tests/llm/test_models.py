import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from sieveline.llm import hmm_score, language_id, mixing
from sieveline.llm.common import Words

from ..conftest import SF


def test_words_match_split():
    texts = [b"", b"  a bb\tccc\n", b"x", "é\x0b ß".encode(), b" \n"]
    w = Words(texts)
    assert [bytes(w.buf[a:b]) for a, b in zip(w.start, w.end)] == [x for t in texts for x in t.split()] and w.counts.tolist() == [len(t.split()) for t in texts]
    h = Words([b"a b a", b"b a", b"ab"]).hashes()
    assert h[0] == h[2] == h[4] and h[1] == h[3] and len({h[0], h[1], h[5]}) == 3


@pytest.mark.parametrize("segment", [1, 5, 512])
def test_recursions_against_plain_loops(monkeypatch, segment):
    monkeypatch.setattr(hmm_score, "SEGMENT", segment)
    rng = np.random.RandomState(0)
    sizes = np.array([0, 3, 17, 1, 30])
    classes = rng.randint(0, 20, sizes.sum()).astype(np.int64)
    counts = np.bincount(classes, minlength=hmm_score.CLASSES + 1).astype(float)
    start, move, emit = model = hmm_score.first_model(counts)
    k, batch = len(start), hmm_score.Batch(classes, sizes)
    out = [np.zeros(k), np.zeros((k, k)), np.zeros((hmm_score.CLASSES + 1, k))]
    batch.expected(model, out)
    want, logs, at = [np.zeros_like(x) for x in out], [], 0
    for n in sizes:
        seq = [*classes[at : at + n], hmm_score.END]
        at += n
        a = [start]
        for o in seq:
            a.append((a[-1] @ move) * emit[o])
        b = [np.ones(k)]
        for o in seq[::-1]:
            b.insert(0, move @ (emit[o] * b[0]))
        z = a[-1].sum()
        logs.append(math.log(z))
        want[0] += a[0] * b[0] / z
        for t, o in enumerate(seq):
            want[1] += np.outer(a[t], emit[o] * b[t + 1]) * move / z
            want[2][o] += a[t + 1] * b[t + 1] / z
    assert np.allclose(batch.log_likelihood(model), logs, rtol=1e-12)
    assert all(np.allclose(x, y, atol=1e-4) for x, y in zip(out, want))


def test_scores_of_a_table(spark):
    got = hmm_score.query(spark, SF).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    words = {d: (t or "").encode().lower().split() for d, t in zip(docs.doc_id, docs.text)}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in words}
    c = Counter(x for d, w in words.items() if not held[d] for x in [*w, None])
    n, v = sum(c.values()), len(c)
    for d, w in words.items():
        r = got.loc[d]
        assert r.held_out == held[d] and r.n_tokens == len(w) + 1 and r.train_tokens == n and r.n_known == sum(c[x] > 0 for x in [*w, None])
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in [*w, None]), abs=1e-6)
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum() and (got.score < 0).all()


def test_scores_of_odd_documents(spark, odd_docs, no_docs):
    from pyspark.sql import functions as F

    held = F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False)).alias("held")
    got = hmm_score.scores(odd_docs.select("doc_id", "text", held), 1).toPandas()
    assert len(got) == odd_docs.count() and got.score.notna().all() and (got.n_tokens >= 1).all()
    assert hmm_score.scores(no_docs.select("doc_id", "text", held), 1).count() == 0
    none = hmm_score.scores(odd_docs.select("doc_id", "text", F.lit(True).alias("held")), 1).toPandas()
    assert (none.base_score == 0).all() and (none.train_tokens == 0).all() and (none.n_known == 0).all()


def test_language_accuracy_on_held_out(spark):
    got = language_id.query(spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    m = got.merge(docs[["doc_id", "lang"]], on="doc_id")
    m = m[m.held_out]
    assert (m.lang == m.lang_pred).mean() > 0.98 and got.score.between(0, 1).all() and len(got) == len(docs)
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h in zip(got.doc_id, got.held_out))


def test_code_lengths_against_a_plain_tree(spark):
    rows = [("aa", "the cat sat on the mat the end"), ("aa", "then the hat"), ("bb", "der hund und die katze der hut")] * 3
    grams = language_id.gram_counts(spark.createDataFrame(rows, "lang string, text string")).toPandas()
    trees = language_id.Trees(["aa", "bb"], grams)

    def bits(text, lang):
        counts, total = {}, Counter()
        for l, t in rows:
            if l == lang:
                s = language_id.START + t.encode()
                for i in range(3, len(s)):
                    for k in range(4):
                        counts.setdefault(s[i - k : i], Counter())[s[i]] += 1

        def p(ctx, byte):
            c = counts.get(ctx)
            if not c:
                return p(ctx[1:], byte) if ctx else 1 / 256
            n, d = sum(c.values()), len(c)
            return c[byte] / (n + d) if c[byte] else d / (n + d) * (p(ctx[1:], byte) if ctx else 1 / 256)

        s = language_id.START + text.encode().lower()
        return -sum(math.log2(p(s[i - 3 : i], s[i])) for i in range(3, len(s)))

    texts = ["the hund", "", "KATZE sat", "zq~é"]
    got = trees.code_lengths([t.encode() for t in texts])
    assert np.allclose(got, [[bits(t, "aa"), bits(t, "bb")] for t in texts], atol=1e-9)


def test_language_of_odd_documents(spark, odd_docs, no_docs):
    trees = language_id.train(odd_docs)
    got = language_id.predict(odd_docs, trees).toPandas()
    assert len(got) == odd_docs.count() and set(got.lang_pred) <= {"und", "en", "fr"} and (got[got.lang_pred == "und"].score == 0).all()
    assert language_id.predict(odd_docs, language_id.train(no_docs)).where("lang_pred <> 'und'").count() == 0
    assert language_id.predict(no_docs, trees).count() == 0


def test_six_hundred_small_languages_in_passes(spark):
    """Every language keeps its own contexts, and passes give what one pass gives."""
    rng = np.random.RandomState(3)
    words = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(6)] for _ in range(600)]
    rows = [(k * 2 + i, " ".join(rng.permutation(w)), f"l{k:03}") for k, w in enumerate(words) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, many = language_id.train(docs), language_id.train(docs, pass_grams=9000)
    assert len(one.passes) == 1 and len(many.passes) > 2 and sum(map(len, many.passes)) == 600
    a, b = (language_id.predict(docs, m).toPandas().sort_values("doc_id", ignore_index=True) for m in (one, many))
    assert a.lang_pred.tolist() == b.lang_pred.tolist() == [r[2] for r in rows] and np.allclose(a.score, b.score)


def test_targets_stop_at_three_times():
    t = mixing.targets([10, 1000, 1000, 5])
    assert t[0] == 30 and t[3] == 15 and sum(t) == pytest.approx(2015) and t[1] == pytest.approx(2 * t[2])
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]


def test_permutation_is_one():
    for n in (1, 2, 3, 7, 64, 1000):
        assert sorted(mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 99)).tolist()) == list(range(n))
    assert mixing.permuted(np.arange(50), np.full(50, 50), np.full(50, 1)).tolist() != mixing.permuted(np.arange(50), np.full(50, 50), np.full(50, 2)).tolist()


def test_mix_of_a_table(spark):
    a, b = (mixing.query(spark, "/root/testdata/sf0.01").toPandas().sort_values("doc_id", ignore_index=True) for _ in range(2))
    assert a.equals(b) and (a.taken <= 3 * a["size"]).all()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas().set_index("doc_id")
    assert all(len(docs.text[d].split()) == s for d, s in zip(a.doc_id, a["size"]) if docs.text[d].isascii())
    by = a.assign(source=docs.source.reindex(a.doc_id).to_numpy()).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"), own=("size", "sum"))
    assert (by["size"] == by.own).all() and (abs(by.taken / by.target - 1) < 0.03).all() and by.target.sum() == pytest.approx(a["size"].sum())


def test_mix_counts_agree_with_the_documents(spark, odd_docs, no_docs):
    counts = mixing.mix_counts(odd_docs).toPandas()
    assert len(counts) == odd_docs.count()
    mixed = mixing.mixed_documents(odd_docs)
    assert mixed.schema == odd_docs.schema
    out = mixed.toPandas()
    assert sum(len(t.encode().split()) for t in out.text) == counts.taken.sum() and (out.n_chars.fillna(0) == out.text.map(len)).all()
    assert mixing.mix_counts(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0


def test_rows_equal_but_for_other_columns_are_mixed_apart(spark):
    text = " ".join(f"w{k}" for k in range(700))
    rows = [(1, text, "en", "a", "x"), (1, text, "fr", "a", None), (1, text, "de", "a", "z"), (2, text, "en", "a", "y"), (3, text, "en", "b", "q"), (None, text, "en", None, "n"), (None, text, "fr", None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, h string")
    counts = mixing.mix_counts(docs).collect()
    out = mixing.mixed_documents(docs).collect()
    want = sum(1 for r in counts if r["taken"] > 0)
    assert len({(r["doc_id"], r["lang"], r["source"], r["h"]) for r in out}) == want and want >= 6
    assert sum(len(r["text"].split()) for r in out) == sum(r["taken"] for r in counts)


def test_word_emissions_are_probabilities():
    rng = np.random.default_rng(2)
    k, per = hmm_score.STATES, 9
    count, number = np.zeros(hmm_score.CLASSES + 1), np.zeros(hmm_score.CLASSES + 1)
    classes = np.repeat(np.arange(5), per)
    c = rng.integers(1, 200, len(classes)).astype(float)
    packed = hmm_score.pack_shares(rng.dirichlet(np.ones(k), len(classes)))
    sums = np.zeros((hmm_score.CLASSES + 1, k))
    np.add.at(sums, classes, c[:, None] * hmm_score.unpack_shares(packed))
    count[:5], number[:5] = np.bincount(classes, c), per
    emit = rng.dirichlet(np.ones(hmm_score.CLASSES + 1), k).T
    e = hmm_score.Emissions(emit, count, number, sums)
    seen = e.table(classes, c, packed)[:-1]
    unseen = e.table(np.arange(5), np.zeros(5), np.zeros(5, np.int64))[:-1]
    assert np.allclose([seen[classes == j].sum(0) + unseen[j] for j in range(5)], emit[:5])


def test_mix_against_a_plain_draw(spark):
    """Every document's taken words: each slot of a source's quota maps to a block, each block to its documents' words."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    key = F.pmod(F.xxhash64(F.col("doc_id"), F.xxhash64("text")), F.lit(mixing.CHUNKS)).alias("chunk")
    rows = sorted(docs.select(F.floor(key).alias("chunk"), "doc_id", F.xxhash64("text").alias("h"), "source", "text").collect(), key=lambda r: r[:3])
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s))
    size = {r["doc_id"]: len([w for w in re.split(r"[\x20\x09-\x0D]+", r["text"] or "") if w]) for r in rows}
    goals = mixing.targets([sum(size[r["doc_id"]] for r in rows if r["source"] == s) for s in sources])
    want = {}
    for k, s in enumerate(sources):
        mine = [r["doc_id"] for r in rows if r["source"] == s]
        owner = [d for d in mine for _ in range(size[d])]
        blocks = math.ceil(len(owner) / mixing.BLOCK)
        times = Counter()
        for slot in range(min(round(goals[k] * blocks / len(owner)), 3 * blocks)):
            n, epoch = slot % blocks, slot // blocks
            turn = mixing.mix64(np.array([k], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(epoch + mixing.SEED))
            times[int(mixing.permuted(np.array([n]), np.array([blocks]), turn)[0])] += 1
        got = Counter()
        for at, d in enumerate(owner):
            got[d] += times[at // mixing.BLOCK]
        want |= {d: got[d] for d in mine}
    assert {r["doc_id"]: r["taken"] for r in mixing.query(spark, SF).collect()} == want


def test_texts_are_packed_from_small_batches(spark, monkeypatch):
    inner = hmm_score.byte_chunks

    def watched(pdf, *args):
        if pdf["text"].str.len().sum() > 4 << 20:
            raise ValueError("too much text at once")
        return inner(pdf, *args)

    monkeypatch.setattr(hmm_score, "byte_chunks", watched)
    docs = spark.range(0, 100, 1, 1).selectExpr("id AS doc_id", "repeat('one more word ', 10000) AS text", "id % 5 = 1 AS held")
    got = hmm_score.scores(docs, 1).toPandas()
    assert len(got) == 100 and (got["n_tokens"] == 30001).all() and (got["train_tokens"] == 80 * 30001).all()


def test_emissions_of_many_words_take_little_beside_their_table():
    rng, n, k = np.random.RandomState(1), 200_001, hmm_score.STATES
    classes, c = rng.randint(0, hmm_score.CLASSES, n), rng.randint(0, 9, n).astype(float)
    packed = hmm_score.pack_shares(np.full((n, k), 1 / k))
    ones = np.ones(hmm_score.CLASSES + 1)
    e = hmm_score.Emissions(np.ones((hmm_score.CLASSES + 1, k)), ones * 100, ones * 50, np.ones((hmm_score.CLASSES + 1, k)))
    tracemalloc.start()
    table = e.table(classes, c, packed)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2 * table.nbytes
    some = np.arange(0, n, 997)
    assert (table[some] == e.table(classes[some], c[some], packed[some])[:-1]).all() and (table[-1] == 1).all()
