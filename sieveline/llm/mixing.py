"""Mixing sources to target weights over fixed-length blocks.

1. Pack: each source's documents, in a fixed pseudorandom order, form one stream of words that is cut into
   blocks of BLOCK words. 2. Draw: every output shard of SHARD slots draws its source counts from a multinomial
   with the target shares; a source's slots are numbered over the shards, surplus over its exact quota is
   dropped and what is missing goes to a settling shard, so that quotas hold. 3. Map: slot n of a source is
   block perm(n mod blocks) of epoch n div blocks, perm a keyed Feistel permutation per source and epoch.
   4. Join: blocks are joined by (source, index). No block comes more than three times as no quota exceeds
   three epochs.

Defined results: null text has no words and is never taken; null source is the last source; rows repeated
with one doc_id and text are separate documents of the stream; a corpus without words takes nothing; an empty
table gives an empty result; extra columns are kept by mixed_documents. At most MAX_SOURCES sources.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, mix64, prefix_offsets, words_of

NAME = "op6_mixing"
BLOCK, SHARD, SEED, CHUNKS = 128, 1024, 17, 1024
WEIGHTS, MOST = (5, 2, 1), 3
MAX_SOURCES = 100_000  # source statistics and shares are kept on the driver
ROUNDS = 4


def targets(sizes: list[int]) -> list[float]:
    """Target words of each source: weights share the total, no source above MOST times its size."""
    weight = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        level = left / sum(weight[i] for i in free)
        over = [i for i in free if weight[i] * level > MOST * sizes[i]]
        if not over:
            for i in free:
                out[i] = weight[i] * level
            break
        for i in over:
            out[i] = float(MOST * sizes[i])
            left -= out[i]
            free.remove(i)
    return out


def permuted(n: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Position n under a pseudorandom permutation of range(size), keyed; all arrays alike in length."""
    half = np.array([(int(s - 1).bit_length() + 1) // 2 for s in np.unique(size)], dtype=np.uint64)
    w = np.maximum(half[np.searchsorted(np.unique(size), size)], 1)
    mask = (np.uint64(1) << w) - np.uint64(1)
    x, limit, key = n.astype(np.uint64), size.astype(np.uint64), key.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> w[todo], x[todo] & mask[todo]
        for r in range(ROUNDS):
            left, right = right, left ^ (mix64(right * np.uint64(ROUNDS) + np.uint64(r) + key[todo]) & mask[todo])
        x[todo] = (left << w[todo]) | right
        todo = todo[x[todo] >= limit[todo]]  # walk on until the value is in range
    return x.astype(np.int64)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, h, sk (source key), size per row."""
    sk = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), sk.alias("sk"), F.size(words_of(F.col("text"))).cast("long").alias("size"))


def source_table(sizes: DataFrame) -> list[tuple]:
    """(k, sk, source size, target, blocks, quota) per source in code point order, null last."""
    found = sizes.groupBy("sk").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found = sorted(found, key=lambda r: (r["sk"] == "null", r["sk"]))
    goal = targets([r["n"] for r in found])
    out = []
    for k, (r, t) in enumerate(zip(found, goal)):
        blocks = -(-r["n"] // BLOCK)
        quota = min(round(t * blocks / r["n"]), MOST * blocks) if r["n"] else 0
        out.append((k, r["sk"], r["n"], t, blocks, quota))
    return out


def slots(spark: SparkSession, sources: list[tuple]) -> DataFrame:
    """(shard, k, epoch, block): the mixture, one row per slot."""
    quotas = np.array([s[5] for s in sources], dtype=np.int64)
    total = int(quotas.sum())
    shards = -(-total // SHARD)
    share = quotas / max(total, 1)

    def draw(frames):
        for pdf in frames:
            for shard in pdf["id"]:
                size = min(SHARD, total - shard * SHARD)
                counts = np.random.Generator(np.random.Philox(key=[SEED, int(shard)])).multinomial(size, share)
                at = np.flatnonzero(counts)
                yield pd.DataFrame({"shard": shard, "k": at.astype(np.int32), "n": counts[at].astype(np.int64)})

    drawn = materialise(spark.range(shards).mapInPandas(draw, "shard long, k int, n long"), "drawn")
    table = F.broadcast(spark.createDataFrame([(s[0], s[4], s[5]) for s in sources], "k int, blocks long, quota long"))  # MAX_SOURCES rows
    placed = prefix_offsets(drawn, ["k"], ["shard"], F.floor(F.col("shard") / 1024), "n", "at").join(table, "k")
    placed = placed.select("shard", "k", "blocks", "at", F.least("n", F.greatest(F.col("quota") - F.col("at"), F.lit(0))).alias("n"))
    sums = drawn.groupBy("k").agg(F.sum("n").alias("at"))
    short = table.join(sums, "k", "left").withColumn("at", F.coalesce("at", F.lit(0)))
    short = short.select((F.lit(shards) + F.col("k")).cast("long").alias("shard"), "k", "blocks", "at", (F.col("quota") - F.col("at")).alias("n"))
    each = placed.unionByName(short).where("n > 0").withColumn("s", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)))

    def mapped(frames):
        for pdf in frames:
            n, size, k = (pdf[c].to_numpy() for c in ("s", "blocks", "k"))
            epoch = n // size
            key = mix64(k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + epoch.astype(np.uint64) + np.uint64(SEED))
            yield pd.DataFrame({"shard": pdf["shard"], "k": k, "epoch": epoch, "block": permuted(n % size, size, key)})

    return each.select("shard", "k", "blocks", "s").mapInPandas(mapped, "shard long, k int, epoch long, block long")


def pieces(sizes: DataFrame, sources: list[tuple]) -> DataFrame:
    """(doc_id, h, sk, k, start, size, block, at, n): the part of each document that lies in each block."""
    spark = sizes.sparkSession
    table = F.broadcast(spark.createDataFrame([(s[0], s[1]) for s in sources], "k int, sk string"))  # MAX_SOURCES rows
    order = F.pmod(F.xxhash64("doc_id", "h"), F.lit(CHUNKS))
    d = prefix_offsets(sizes.where("size > 0"), ["sk"], ["doc_id", "h"], order, "size", "start").join(table, "sk")
    d = d.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK))))
    at = F.greatest(F.col("block") * BLOCK - F.col("start"), F.lit(0))
    end = F.least((F.col("block") + 1) * BLOCK - F.col("start"), F.col("size"))
    return d.select("doc_id", "h", "sk", "k", "start", "size", "block", at.alias("at"), (end - at).alias("n"))


def mix_counts(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken for every row of docs (doc_id, text, source)."""
    spark = docs.sparkSession
    sizes = materialise(sized(docs), "sizes")
    sources = source_table(sizes)
    times = slots(spark, sources).groupBy("k", "block").agg(F.count("*").alias("times"))
    taken = pieces(sizes, sources).join(times, ["k", "block"], "left")
    taken = taken.groupBy("k", "sk", "start", "doc_id", "size").agg(F.sum(F.col("n") * F.coalesce("times", F.lit(0))).alias("taken"))
    every = taken.select("doc_id", "sk", "size", "taken").unionByName(sizes.where("size = 0").select("doc_id", "sk", "size", F.lit(0).cast("long").alias("taken")))
    table = F.broadcast(spark.createDataFrame([(s[1], s[2], s[3]) for s in sources], "sk string, source_size long, target double"))
    return every.join(table, "sk").select("doc_id", "size", "source_size", "target", "taken")


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut(text: str, size: int, spans: list[tuple[int, int]]) -> str:
    """The spans (first word, words) of a text; neighbours are joined, others stand on lines of their own."""
    if sum(n for _, n in spans) == size:
        return text
    words = [m.span() for m in _WORD.finditer(text)]
    out: list[list[int]] = []
    for at, n in sorted(spans):
        if out and out[-1][1] == at:
            out[-1][1] = at + n
        else:
            out.append([at, at + n])
    return "\n".join(text[words[a][0] : words[b - 1][1]] for a, b in out)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mixture as documents: one row per document and epoch that takes words of it, with all columns.

    text holds the taken blocks' words as they stand in the document, n_chars (if there) its length. Rows equal in doc_id,
    text and source are told apart by number: the n-th in order of their other columns gets the n-th taken place of them."""
    spark = docs.sparkSession
    sizes = materialise(sized(docs), "sizes")
    sources = source_table(sizes)
    got = pieces(sizes, sources).join(slots(spark, sources).select("k", "epoch", "block"), ["k", "block"])
    spans = got.groupBy("doc_id", "h", "sk", "start", "size", "epoch").agg(F.collect_list(F.struct("at", "n")).alias("__spans"))
    spans = spans.withColumn("__n", F.dense_rank().over(W.partitionBy("doc_id", "h", "sk").orderBy("start")))
    spans = spans.select(F.col("doc_id").alias("__d"), F.col("h").alias("__h"), F.col("sk").alias("__s"), F.col("size").alias("__size"), F.col("__n").alias("__at"), "__spans")
    keys = [F.col("doc_id").cast("long").alias("__kd"), F.xxhash64("text").alias("__kh"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")).alias("__ks")]
    others = F.to_json(F.struct(*[F.col(c) for c in docs.columns if c not in ("text", "doc_id")]), {"ignoreNullFields": "false"})
    d = docs.select("*", *keys, others.alias("__o"))
    d = d.withColumn("__k", F.row_number().over(W.partitionBy("__kd", "__kh", "__ks").orderBy("__o"))).drop("__o")
    joined = d.join(spans, d["__kd"].eqNullSafe(spans["__d"]) & (d["__kh"] == spans["__h"]) & (d["__ks"] == spans["__s"]) & (d["__k"] == spans["__at"]))
    schema = docs.schema
    columns = schema.names

    def write(frames):
        for pdf in frames:
            pdf["text"] = [cut(t, n, [(s["at"], s["n"]) for s in spans]) for t, n, spans in zip(pdf["text"], pdf["__size"], pdf["__spans"])]
            if "n_chars" in pdf:
                pdf["n_chars"] = pdf["text"].map(len).astype(pdf["n_chars"].dtype)
            yield pdf[columns]

    return joined.drop("__kd", "__kh", "__ks", "__k", "__d", "__h", "__s", "__at").mapInPandas(write, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
