"""Phrase collocation mining by hashed counting (PCY and DHP) with Apriori pruning.

Level n counts phrases of n words exactly, and in the same pass over the texts counts phrases of n + 1 words
into buckets. A bucket that stays under the support holds no frequent phrase, so its bit is 0 in the bitmap
that is broadcast to the next pass. A second bitmap holds the phrases of n words found frequent (Apriori: both
shorter phrases of a frequent one are frequent). Bitmaps have false positives only, and what passes them is
counted exactly, so that the result depends on neither hashes nor the number of buckets.

A word is known by a 64-bit hash. That no two words of a language share one is checked on the vocabulary (and
byte by byte where a task groups words); if two did, all would be hashed anew. Counts are grouped by the
tuple of word ids, which is exact. Bucket counts saturate at the support, which changes no bit, and are
merged by slices in a tree with a fan-in of FAN. A bitmap has at most 2**MOST_BITS bits, so at most 4 MB.

Defined results: null text is empty, null lang is `und`; rows repeated count again; texts without words and an
empty table give nothing; very long texts are cut at piece ends only; other columns are ignored; ties are
ranked by the phrase in UTF-8 byte order.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, mix64, small_batches

NAME = "op11_phrases"
SUPPORT, LONGEST, TOP = 30, 4, 2000
LEAST_BITS, MOST_BITS = 16, 25
SLICE, FAN = 1 << 16, 64
CHUNK = 1 << 20  # bytes of text that one numpy pass takes
STRETCH = 1 << 18  # bytes of them that have 8-byte numbers at once
TEXTS, ROWS = 256, 1 << 13  # texts taken out of an Arrow batch, rows put into one, at once
GROUP = 16 << 20  # bytes of a Parquet row group of counts, which a task holds until it is written
SEEDS = range(5)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?\n\x0b\x0c\r"]] = True
_SPACE = _BREAK.copy()
_SPACE[[9, 32]] = True
_END = re.compile(rb"[.,;:!?\x0A-\x0D]")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def stretches(start: np.ndarray, end: np.ndarray):
    """(from, to) of runs of words that lie within STRETCH bytes; a longer word is a run of its own."""
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + STRETCH, side="right")))
        yield at, to
        at = to


class Hasher:
    """64-bit ids of words from a seed: prefix sums of byte values times powers of an odd number."""

    def __init__(self, seed: int):
        rng = np.random.RandomState(7919 + seed)
        self.byte = rng.randint(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.randint(0, 2**62)) * 2 + 1
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 2**64))):
                p = np.full(n, base, dtype=np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def ids(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.empty(len(start), dtype=np.uint64)
        for at, to in stretches(start, end):
            lo, n = start[at], int(end[to - 1] - start[at])
            self.powers(n + 1)
            run = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(self.byte[buf[lo : lo + n]] * self.up[:n], out=run[1:])
            a, b = start[at:to] - lo, end[at:to] - lo
            out[at:to] = mix64((run[b] - run[a]) * self.down[a] + (b - a).astype(np.uint64))
        return out


class Bits(NamedTuple):
    """What later passes know: broadcast bitmaps by phrase length; buckets may be frequent, exact ones are."""

    bits: int
    buckets: dict
    exact: dict


def has(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def bucket(g: np.ndarray, bits: int) -> np.ndarray:
    return g >> np.uint64(64 - bits)


def mark(g: np.ndarray, bits: int) -> np.ndarray:
    return g & np.uint64((1 << bits) - 1)


def lang_key(lang: str) -> np.uint64:
    """A hash of a language for bitmaps only; counts are grouped by the language itself."""
    h = 14695981039346656037
    for b in lang.encode("utf-8", "surrogatepass"):
        h = (h ^ b) * 1099511628211 % 2**64
    return np.uint64(h)


def joined(g: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Hash of phrases one word longer than those of g."""
    return mix64(g * _MIX + more)


def cut(texts, limit: int = CHUNK):
    """(index, text) with texts longer than limit cut after the next piece end, which no phrase crosses."""
    for k, t in enumerate(texts):
        at = 0
        while len(t) - at > limit:
            m = _END.search(t, at + limit)
            if m is None:
                break
            yield k, t[at : m.end()]
            at = m.end()
        yield k, t[at:] if at else t


def batches(given, limit: int = CHUNK):
    """(texts, languages) of about limit bytes each, over all Arrow batches of a task."""
    held, langs, size = [], [], 0
    for batch in given:
        for at in range(0, batch.num_rows, TEXTS):
            some = batch.slice(at, TEXTS)
            texts = (t or b"" for t in some.column("text").cast(pa.binary()).to_pylist())
            names = some.column("lang").to_pylist()
            for k, t in cut(texts, limit):
                held.append(t)
                langs.append(names[k])
                size += len(t) + 1
                if size >= limit:
                    yield held, langs
                    held, langs, size = [], [], 0
    if held:
        yield held, langs


class Runs:
    """Words of a batch: places in the buffer, language of each, and whether the next word is in the same piece."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        self.buf = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[self.buf])).view(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        stops = np.cumsum(_BREAK[self.buf], dtype=np.int32)[self.start] if len(self.start) else np.zeros(0, np.int32)
        self.next = np.append(stops[1:] == stops[:-1], False)[: len(self.start)]
        self.names, codes = np.unique(np.array(langs, dtype=object), return_inverse=True)
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.lang = codes[np.searchsorted(ends, self.start, side="right")].astype(np.int64)

    def keys(self) -> np.ndarray:
        return np.array([lang_key(n) for n in self.names], dtype=np.uint64)[self.lang]


def groups(order_by: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first places in it, sizes) of runs of equal columns after sorting by a hash of them."""
    order = np.argsort(order_by)
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    first = np.flatnonzero(new)
    return order, first, np.diff(np.append(first, len(order)))


def word_counts(runs: Runs, ids: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one occurrence, count) of each word and language, whatever the hashes: bytes are compared."""
    order, first, count = groups(g, [runs.lang, ids])
    one = order[first]
    model = np.empty(len(g), dtype=np.int64)
    model[order] = np.repeat(one, count)
    size = runs.end - runs.start
    alike = bool((size == size[model]).all())
    for at, to in stretches(runs.start, runs.end) if alike else ():
        shift = np.repeat(runs.start[model[at:to]] - runs.start[at:to], size[at:to])
        byte = runs.start[at] + np.flatnonzero(~_SPACE[runs.buf[runs.start[at] : runs.end[to - 1]]])
        alike = alike and bool((runs.buf[byte] == runs.buf[byte + shift]).all())
    if alike:
        return one, count
    found: dict = {}
    for k, (a, b, c) in enumerate(zip(runs.start.tolist(), runs.end.tolist(), runs.lang.tolist())):
        found.setdefault((c, runs.buf[a:b].tobytes()), [k, 0])[1] += 1
    pairs = np.array(list(found.values()), dtype=np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def positions(n: int, runs: Runs, g1: np.ndarray, known: Bits, exact_upto: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the phrases of n words that no bitmap rules out."""
    at, g = np.arange(len(g1)), g1
    for k in range(1, n + 1):
        if k > 1:
            ok = np.zeros(len(g1) + 1, dtype=bool)
            ok[at] = True
            two = ok[at + 1] & runs.next[at] if k == 2 else ok[at + 1]
            at, g = at[two], g[two]
            g = joined(g, g1[at + k - 1])
        if k in known.buckets:
            keep = has(known.buckets[k], bucket(g, known.bits))
            at, g = at[keep], g[keep]
        if k <= exact_upto and k in known.exact:
            keep = has(known.exact[k], mark(g, known.bits))
            at, g = at[keep], g[keep]
    return at, g


COUNTS = "kind int, lang string, i1 long, i2 long, i3 long, i4 long, word string, c long, part int, slice int, block binary"


TYPES = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in COUNTS.split(", "))])


def rows(n: int, **columns) -> pa.RecordBatch:
    """n rows of COUNTS; columns not given are null."""
    cols = {c: v if isinstance(v, (pa.Array, int)) else pa.array(v, TYPES.field(c).type) for c, v in columns.items()}
    cols = {c: pa.repeat(pa.scalar(v, TYPES.field(c).type), n) if isinstance(v, int) else v for c, v in cols.items()}
    return pa.RecordBatch.from_arrays([cols[f.name] if f.name in cols else pa.nulls(n, f.type) for f in TYPES], schema=TYPES)


def strings(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The slices of a buffer as an array of strings."""
    size = end - start
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    data = buf[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)]
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def block_rows(array: np.ndarray, part: int, first: int = 0) -> dict:
    """part, slice (numbered from first) and block of the slices that hold anything."""
    parts = array.reshape(-1, min(SLICE, len(array)))
    some = np.flatnonzero(parts.any(axis=1))
    return {"part": np.full(len(some), part), "slice": first + some, "block": [parts[s].tobytes() for s in some]}


def one_pass(n: int, hasher: Hasher, known, bits: int, support: int):
    """Task of level n: partial counts of phrases of n words (kind 0), buckets of n + 1 (kind 1), words (kind 2)."""
    kind = np.uint8 if support < 256 else np.uint32

    def counted(texts, langs, tables, array):
        # what one stretch of texts needs goes with this call, before the next one is read
        runs = Runs(texts, langs)
        if not len(runs.start):
            return
        ids = hasher.ids(runs.buf, runs.start, runs.end)
        g1 = mix64(ids ^ runs.keys())
        at, g = positions(n, runs, g1, tables, n - 1)
        if n < LONGEST:
            ok = np.zeros(len(g1) + 1, dtype=bool)
            ok[at] = True
            two = ok[at + 1] & runs.next[at] if n == 1 else ok[at + 1]
            b = np.sort(bucket(joined(g[two], g1[at[two] + n]), bits))
            if len(b):
                first = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
                where = b[first].astype(np.int64)
                array[where] = np.minimum(array[where].astype(np.int64) + np.diff(np.append(first, len(b))), support)
                del first, where
            del ok, two, b
        if n == 1:
            one, count = word_counts(runs, ids, g1)
            total = np.bincount(runs.lang, minlength=len(runs.names))
            yield rows(len(total), kind=2, lang=runs.names, c=total)
        else:
            order, first, count = groups(g, [runs.lang[at], *(ids[at + k] for k in range(n))])
            one = at[order[first]]
            del order, first
        del g1, at, g
        names = pa.array(runs.names, pa.string())
        for k in range(0, len(one), ROWS):
            some = one[k : k + ROWS]
            cols = {f"i{j + 1}": ids[some + j].view(np.int64) if j < n else 0 for j in range(4)}
            if n == 1:
                cols["word"] = strings(runs.buf, runs.start[some], runs.end[some])
            yield rows(len(some), kind=0, lang=names.take(pa.array(runs.lang[some])), **cols, c=count[k : k + ROWS])

    def run(given):
        tables = known.value if known is not None else Bits(bits, {}, {})
        array = np.zeros(1 << bits, dtype=kind)
        part = TaskContext.get().partitionId()
        for texts, langs in batches(given):
            yield from counted(texts, langs, tables, array)
        if array.any():
            for at in range(0, len(array), 16 * SLICE):
                some = block_rows(array[at : at + 16 * SLICE], part, at // SLICE)
                yield rows(len(some["block"]), kind=1, **some)

    return run


def bitmap(blocks: DataFrame, bits: int, support: int) -> np.ndarray:
    """The bitmap of buckets that reach the support: blocks are added in a tree, then packed, at most 4 MB in all."""
    kind = np.uint8 if support < 256 else np.uint32
    width = min(SLICE, 1 << bits)

    def adder(last: bool):
        # the last level packs its sums itself: a Python step after it would start a second worker beside each
        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros(width, dtype=np.int64)
            for b in pdf["block"]:
                total = np.minimum(total + np.frombuffer(b, dtype=kind), support)
            block = np.packbits(total >= support, bitorder="little") if last else total.astype(kind)
            return pd.DataFrame({"part": pdf["part"].iloc[:1] // FAN, "slice": pdf["slice"].iloc[:1], "block": [block.tobytes()]})

        return add

    d = blocks.select("part", "slice", "block")
    parts = (blocks.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        parts = -(-parts // FAN)
        d = d.groupBy("slice", F.floor(F.col("part") / FAN)).applyInPandas(adder(parts == 1), "part int, slice int, block binary")
        if parts == 1:
            break

    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for r in d.select("slice", "block").toLocalIterator():
        at = r["slice"] * width // 8
        out[at : at + width // 8] = np.frombuffer(r["block"], dtype=np.uint8)
    return out


def exact_blocks(frequent: DataFrame, n: int, bits: int, support: int) -> DataFrame:
    """Blocks with the support in each bucket that a frequent phrase of n words marks."""
    kind = np.uint8 if support < 256 else np.uint32

    def run(frames):
        array, part = np.zeros(1 << bits, dtype=kind), TaskContext.get().partitionId()
        for pdf in frames:
            keys = pdf["lang"].map({x: lang_key(x) for x in pdf["lang"].unique()}).to_numpy(dtype=np.uint64)
            words = [mix64(pdf[f"i{k + 1}"].to_numpy(dtype=np.int64).view(np.uint64) ^ keys) for k in range(n)]
            g = words[0]
            for more in words[1:]:
                g = joined(g, more)
            array[mark(g, bits).astype(np.int64)] = support
        if array.any():
            yield pd.DataFrame(block_rows(array, part))

    return frequent.select("lang", *(f"i{k + 1}" for k in range(n))).mapInPandas(run, "part int, slice int, block binary")


KEY = ["lang", "n", "i1", "i2", "i3", "i4"]


def vocabulary(texts: DataFrame, bits: int, support: int) -> tuple[Hasher, DataFrame, DataFrame]:
    """(hasher, level-1 rows, frequent words) with a hash that keeps the words of every language apart.

    Words that share an id differ in a second, unrelated 64-bit hash."""
    for seed in SEEDS:
        hasher = Hasher(seed)
        with small_batches(texts.sparkSession):
            got = materialise(texts.mapInArrow(one_pass(1, hasher, None, bits, support), COUNTS), "phrases-1", GROUP)
        check = F.xxhash64("word")
        words = got.where("kind = 0").groupBy("lang", "i1").agg(F.sum("c").alias("f"), F.min(check).alias("low"), F.max(check).alias("high"))
        words = materialise(words.where(F.col("f") >= support), "words")
        if not words.where("low <> high").head(1):
            return hasher, got, words.drop("low", "high")
    raise ValueError("two words share their hash under every seed")


def frequent_phrases(docs: DataFrame, support: int = SUPPORT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases, words, totals): lang, n, i1..i4, f of all frequent phrases; lang, i1, word, in part repeated; lang, n of words."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (chars // 64).bit_length()))
    hasher, got, words = vocabulary(texts, bits, support)
    named = got.where("kind = 0").select("lang", "i1", "word")
    totals = materialise(got.where("kind = 2").groupBy("lang").agg(F.sum("c").alias("n")), "totals")
    zero = F.lit(0).cast("long")
    levels = [words.select("lang", F.lit(1).alias("n"), "i1", zero.alias("i2"), zero.alias("i3"), zero.alias("i4"), "f")]
    known = Bits(bits, {}, {})
    for n in range(2, LONGEST + 1):
        known.exact[n - 1] = bitmap(exact_blocks(levels[-1], n - 1, bits, support), bits, support)
        known.buckets[n] = bitmap(got.where("kind = 1"), bits, support)
        if not known.buckets[n].any() or not known.exact[n - 1].any():
            break
        shared = spark.sparkContext.broadcast(known)
        with small_batches(spark):
            got = materialise(texts.mapInArrow(one_pass(n, hasher, shared, bits, support), COUNTS), f"phrases-{n}", GROUP)
        found = got.where("kind = 0").groupBy("lang", "i1", "i2", "i3", "i4").agg(F.sum("c").alias("f")).where(F.col("f") >= support)
        levels.append(materialise(found.select("lang", F.lit(n).alias("n"), "i1", "i2", "i3", "i4", "f"), f"level-{n}"))
    every = levels[0]
    for d in levels[1:]:
        every = every.unionByName(d)
    return every, named, totals


def part_of(first: int, n: int) -> list:
    """Key columns of the n words of a phrase from word `first` on."""
    cols = [F.col(f"i{first + k + 1}") if k < n else F.lit(0).cast("long") for k in range(4)]
    return [F.lit(n).alias("n"), *(c.alias(f"i{k + 1}") for k, c in enumerate(cols))]


def scored(every: DataFrame) -> DataFrame:
    """Candidates (phrases of two words or more) with a, l, r and score of their lowest-scoring cut.

    Every part of a frequent phrase is frequent, so all parts are found among the frequent phrases."""
    cand = every.where("n > 1")
    names = [f"q{k}" for k in range(6)]
    asks = []
    for n in range(2, LONGEST + 1):
        for k in range(1, n):
            for side, parts in (("l", part_of(0, k)), ("r", part_of(k, n - k))):
                asks.append(F.when(F.col("n") == n, F.struct(F.lit(f"{side}{k}").alias("ask"), *parts)))
    own = [F.col(c).alias(q) for c, q in zip(KEY[1:], names)]
    asked = cand.select("lang", *own, F.col("f").alias("a"), F.explode(F.filter(F.array(*asks), lambda x: x.isNotNull())).alias("s")).select("lang", *names[:5], "a", "s.*")
    hits = asked.join(every.select(*KEY, "f"), KEY)
    cols = [F.max(F.when(F.col("ask") == c, F.col("f"))).alias(c) for k in range(1, LONGEST) for c in (f"l{k}", f"r{k}")]
    d = hits.groupBy("lang", *names[:5]).agg(F.max("a").alias("a"), *cols)
    cuts = []
    for k in range(1, LONGEST):
        score = F.expr(f"cast(a as decimal(20,0)) * 2000000 div (cast(l{k} as decimal(20,0)) + r{k})")
        cuts.append(F.when(F.col("q0") > k, F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))))
    d = d.withColumn("cut", F.array_min(F.filter(F.array(*cuts), lambda x: x.isNotNull())))
    return d.select("lang", *(F.col(q).alias(c) for q, c in zip(names, KEY[1:])), "a", "cut.l", "cut.r", "cut.score")


def inside(every: DataFrame) -> DataFrame:
    """KEY and the count m of the most frequent longer candidate that holds the phrase."""
    parts = [F.when(F.col("n") == n, F.struct(*part_of(at, k))) for n in range(3, LONGEST + 1) for k in range(2, n) for at in range(n - k + 1)]
    d = every.where("n > 2").select("lang", "f", F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("s"))
    return d.groupBy("lang", *(F.col(f"s.{c}").alias(c) for c in KEY[1:])).agg(F.max("f").alias("m"))


def collocations(docs: DataFrame, support: int = SUPPORT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `top` phrases."""
    every, words, totals = frequent_phrases(docs, support)
    d = scored(every).join(inside(every), KEY, "left")
    d = d.where("m is null or cast(m as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * 80").drop("m")
    # the words are looked up for phrases up to the place of the top-th alone; ties there are settled below
    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    d = materialise(d.withColumn("__rank", F.rank().over(best)).where(F.col("__rank") <= top).drop("__rank"), "best")
    each = d.select("*", F.posexplode(F.slice(F.array("i1", "i2", "i3", "i4"), 1, F.col("n"))).alias("at", "i"))
    ids = each.select("lang", "i").distinct()
    spelt = words.withColumnRenamed("i1", "i").join(ids, ["lang", "i"], "left_semi").distinct()
    named = each.join(spelt, ["lang", "i"])
    phrase = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    named = named.groupBy(*KEY, "a", "l", "r", "score").agg(phrase.alias("phrase"))
    final = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = named.drop("n").withColumn("rank", F.row_number().over(final).cast("long")).where(F.col("rank") <= top)
    return out.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
o AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS size) t),
totals AS (SELECT lang, count(*) AS n FROM o WHERE size = 1 GROUP BY lang),
f AS (SELECT lang, size, phrase, count(*) AS f FROM o GROUP BY lang, size, phrase HAVING count(*) >= 30),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
parts AS (SELECT lang, size, phrase, f AS a, k, array_to_string(w[:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp FROM c, (SELECT unnest([1, 2, 3]) AS k) t WHERE k < size),
cuts AS (SELECT parts.*, l.f AS l, r.f AS r, 2000000::HUGEINT * a // (l.f::HUGEINT + r.f) AS score FROM parts JOIN f l ON l.lang = parts.lang AND l.phrase = lp JOIN f r ON r.lang = parts.lang AND r.phrase = rp),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
subs AS (SELECT lang, f, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM c, (SELECT unnest([2, 3]) AS k) t, (SELECT unnest([1, 2, 3]) AS i) u WHERE k < size AND i + k - 1 <= size),
longer AS (SELECT lang, phrase, max(f) AS m FROM subs GROUP BY lang, phrase),
held AS (SELECT low.lang, low.phrase FROM low JOIN longer USING (lang, phrase) WHERE 100::HUGEINT * m >= 80::HUGEINT * a),
ranked AS (SELECT low.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low ANTI JOIN held USING (lang, phrase))
SELECT ranked.lang, rank, phrase, a, l, r, totals.n AS n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
