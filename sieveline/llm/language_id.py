"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of order up to ORDER: a byte seen n times of N in a context with d distinct
bytes has probability n / (N + d); any other byte escapes with d / (N + d) to the next shorter context, at
last to 1/256 for each byte (escape method C, without exclusion). The trees are frozen after training; a text's
code length under a tree is the exact sum of -log2 over all its bytes, and the shortest code wins.

Training uses a bounded sample: about SAMPLE documents per language, chosen by a hash of the row, all of their
text. Byte 4-gram counts are summed by Spark, and every context and byte of the sample is kept, as sorted sparse
arrays per language. Languages are dealt into passes of about PASS_GRAMS distinct 4-grams (some 100 MB of trees; a
language is never split), one after the other, so that neither the driver nor a broadcast holds more than one pass;
the best code so far travels with the rows. The driver also holds one short row per language.

Defined results: null text, or a text without a letter, is `und` with score 0, and so is every text if no
language was learned; a null doc_id is not held out; ties go to the first language in code point order; repeated
rows each get a row; an empty table gives an empty result; ASCII case is folded; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_chunks, doc_fold, materialise

NAME = "op7_language_id"
ORDER = 3
SAMPLE, PASS_GRAMS = 2000, 4_000_000
FOLDS, HELD_OUT = 4, 2
START = b"\n" * ORDER  # the context before a text


def _flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts, folded, each after its START, in one array, and the place where each text begins."""
    buf = np.frombuffer(b"".join(START + t.lower() for t in texts), dtype=np.uint8)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    return buf, np.cumsum(size + ORDER) - size


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n): counts of each byte with the ORDER bytes before it, in labelled (text, lang)."""

    def run(frames):
        for pdf in frames:
            for lang, part in pdf.groupby("lang"):
                for _, _, texts in byte_chunks(part, "text"):
                    buf, begin = _flat(texts)
                    code = buf.astype(np.uint32)
                    gram = (code[:-3] << 24) | (code[1:-2] << 16) | (code[2:-1] << 8) | code[3:]
                    inside = np.ones(len(gram), dtype=bool)  # a gram that ends in a START belongs to no text
                    for k in range(ORDER):
                        at = begin - ORDER + k - ORDER
                        inside[at[(at >= 0) & (at < len(gram))]] = False
                    value, n = np.unique(gram[inside], return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": value.astype(np.int64), "n": n.astype(np.int64)})

    return labelled.mapInPandas(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Trees:
    """The frozen trees of some languages. Per order k: sorted codes of context and byte with their bits, and sorted
    contexts with the bits of their escape."""

    def __init__(self, langs: list[str], grams: pd.DataFrame):
        self.langs = langs
        code, n, of = grams["gram"].to_numpy().astype(np.int64), grams["n"].to_numpy().astype(np.float64), grams["lang"].to_numpy()
        order = np.argsort(of, kind="stable")
        cuts = {lang: part for lang, part in zip(*self._runs(of[order], order))}
        self.orders = [[self._order(code[cuts[lang]], n[cuts[lang]], k) for k in range(ORDER, -1, -1)] for lang in langs]

    @staticmethod
    def _runs(sorted_keys: np.ndarray, rows: np.ndarray):
        first = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))) if len(rows) else np.zeros(0, int)
        return sorted_keys[first], np.split(rows, first[1:])

    @staticmethod
    def _order(code: np.ndarray, n: np.ndarray, k: int):
        """Bits of the bytes and of the escape in the contexts of k bytes."""
        seen, at = np.unique(code & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
        count = np.bincount(at, n)
        contexts, at = np.unique(seen >> 8, return_inverse=True)
        total, kinds = np.bincount(at, count), np.bincount(at).astype(np.float64)
        return seen, np.log2((total + kinds)[at] / count), contexts, np.log2((total + kinds) / kinds)

    def bits(self, number: int, code: np.ndarray) -> np.ndarray:
        """Bits of each 4-gram's last byte after its first three in one language: the longest context that saw it, after escapes."""
        out, todo = np.full(len(code), 8.0), np.arange(len(code))  # 1/256 after the last escape
        for k, (seen, cost, contexts, escape) in zip(range(ORDER, -1, -1), self.orders[number]):
            now = code[todo] & ((1 << 8 * (k + 1)) - 1)
            at = np.minimum(np.searchsorted(seen, now), len(seen) - 1)
            hit = seen[at] == now
            out[todo[hit]] += cost[at[hit]] - 8
            todo, now = todo[~hit], now[~hit] >> 8
            at = np.minimum(np.searchsorted(contexts, now), len(contexts) - 1)
            known = contexts[at] == now
            out[todo[known]] += escape[at[known]]
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language's tree."""
        out = np.zeros((len(texts), len(self.langs)))
        size = np.array([len(t) for t in texts])
        some = np.flatnonzero(size)
        if not len(some):
            return out
        buf, begin = _flat(texts)
        b = buf.astype(np.uint32)
        code, at = np.unique((b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:], return_inverse=True)
        code = code.astype(np.int64)
        # between the end of a text and the next lie the ORDER bytes of a START: sum them apart
        edges = np.stack((begin[some] - ORDER, begin[some] - ORDER + size[some]), 1).ravel()
        for k in range(len(self.langs)):
            out[some, k] = np.add.reduceat(np.append(self.bits(k, code)[at], 0.0), edges)[0::2]
        return out


@dataclass
class Model:
    """4-gram counts (lang, gram, n) of the sample as a table, and the languages of each pass over it."""

    grams: DataFrame | None
    passes: list[list[str]]

    def trees(self, langs: list[str]) -> Trees:
        mine = self.grams if len(self.passes) == 1 else self.grams.where(F.col("lang").isin(langs))
        return Trees(langs, mine.toPandas())  # PASS_GRAMS rows, or one language's


def train(docs: DataFrame, sample: int = SAMPLE, pass_grams: int = PASS_GRAMS) -> Model:
    """The model of docs (doc_id, text, lang), all of which may be learned from."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = known.groupBy("lang").count().collect()  # a row per language
    if not counts:
        return Model(None, [])
    parts = 1 << 30
    share = docs.sparkSession.createDataFrame([(r["lang"], min(parts, int(parts * sample / r["count"]))) for r in counts], "lang string, share long")
    chosen = known.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)) < F.col("share"))
    grams = materialise(gram_counts(chosen.select("text", "lang")), "grams")
    passes, held = [], 0
    for r in sorted(grams.groupBy("lang").count().collect(), key=lambda r: r["lang"]):
        if not passes or held + r["count"] > pass_grams:
            passes.append([])
            held = 0
        passes[-1].append(r["lang"])
        held += r["count"]
    return Model(grams, passes)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) per row of docs (doc_id, text): only the text is looked at.

    score is 2^-bits of the best language over the sum of all languages'. A pass brings the rows' text, best language,
    its bits and that sum along; passes but the last are written to the shared folder, so a task holds one pass's trees."""
    context = docs.sparkSession.sparkContext
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not model.passes:
        return d.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    d = d.withColumn("lang", F.lit(None).cast("string")).withColumn("bits", F.lit(float("inf"))).withColumn("lead", F.lit(0.0))
    carried = "doc_id long, text string, lang string, bits double, lead double"

    def step(shared, last: bool):
        def run(frames):
            t = shared.value
            names = np.array(t.langs, dtype=object)
            for pdf in frames:
                for a, b, texts in byte_chunks(pdf, "text", 1 << 20):
                    part = pdf.iloc[a:b].copy()
                    letters = np.array([isinstance(x, str) and any(map(str.isalpha, x)) for x in part["text"]], dtype=bool)
                    lang, bits, lead = (part[c].to_numpy().copy() for c in ("lang", "bits", "lead"))
                    lang = lang.astype(object)
                    if letters.any():
                        got = t.code_lengths(texts)[letters]
                        best, before = got.min(1), bits[letters]
                        now = np.minimum(best, before)
                        lead[letters] = lead[letters] * np.exp2(now - before) + np.exp2(now[:, None] - got).sum(1)
                        lang[letters] = np.where(best < before, names[got.argmin(1)], lang[letters])
                        bits[letters] = now
                    if last:
                        score = np.where(letters, 1 / np.maximum(lead, 1.0), 0.0)
                        yield pd.DataFrame({"doc_id": part["doc_id"], "lang_pred": np.where(letters, lang, "und"), "score": score})
                    else:
                        yield part.assign(lang=lang, bits=bits, lead=lead)

        return run

    for k, langs in enumerate(model.passes):
        shared, last = context.broadcast(model.trees(langs)), k == len(model.passes) - 1
        d = d.mapInPandas(step(shared, last), "doc_id long, lang_pred string, score double" if last else carried)
        if not last:
            d = materialise(d, "coded")
            shared.destroy()
    return d


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(doc_fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    out = predict(docs, train(docs.where(~held)))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
