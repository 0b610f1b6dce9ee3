"""Chat formatting: collapse cumulative snapshots, then render (built-in functions only).

A logged conversation that is a prefix of a longer one, turn by turn, is a snapshot of it. Each turn's hash
depends on its position, role and text; the xor of the first k turn hashes (two independent 64-bit ones) is
the rolling hash of the prefix of k turns. A conversation stays if no longer one has its hash as a prefix
(anti-join); of equal ones the smallest conv_id stays. What stays is rendered, one row per conversation.

Defined results: turns are ordered by (turn, role, text), nulls first; rows equal in all four columns are one
turn logged twice; null role renders as an empty role, null text as an empty text, and both differ from
empty strings in hashes; all rows with a null conv_id are one conversation; an empty table gives an empty
result; other columns are ignored. A rendered conversation is one value, so it must fit one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

NAME = "op8_chat_format"
CHUNK = 256  # turns whose rolling hash one window task computes


def turns(conversations: DataFrame) -> DataFrame:
    """Distinct turns with their position k from 1 and the rolling hashes h1, h2 of the prefix that they end.

    Turn numbers fall into chunks of CHUNK; counts and hashes are rolled inside a chunk, then over the few
    chunks of a conversation, so that a huge conversation is spread over its chunks."""
    d = conversations.select("conv_id", "turn", "role", "text").distinct()
    d = d.withColumn("ck", F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))).withColumn("chunk", F.floor(F.coalesce(F.col("turn"), F.lit(0)) / CHUNK))
    # a null turn sorts first of all, so it belongs to the chunk before every other
    d = d.withColumn("chunk", F.when(F.col("turn").isNull(), F.lit(-(2**62))).otherwise(F.col("chunk")))
    w = W.partitionBy("ck", "chunk").orderBy("turn", "role", "text")
    d = d.withColumn("at", F.row_number().over(w).cast("long"))
    counts = d.groupBy("ck", "chunk").agg(F.count("*").alias("n"))
    before = W.partitionBy("ck").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    d = d.join(counts, ["ck", "chunk"]).withColumn("k", F.col("at") + F.col("base")).drop("at", "base")
    mark = lambda c: F.concat(F.when(F.col(c).isNull(), "0").otherwise("1"), F.coalesce(F.col(c), F.lit("")))
    d = d.withColumn("t1", F.xxhash64("k", mark("role"), mark("text"))).withColumn("t2", F.xxhash64(mark("text"), F.lit("2"), mark("role"), "k"))
    upto = W.partitionBy("ck", "chunk").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("r1", F.bit_xor("t1").over(upto)).withColumn("r2", F.bit_xor("t2").over(upto))
    sums = d.groupBy("ck", "chunk").agg(F.bit_xor("t1").alias("s1"), F.bit_xor("t2").alias("s2"))
    sums = sums.withColumn("b1", F.coalesce(F.bit_xor("s1").over(before), F.lit(0))).withColumn("b2", F.coalesce(F.bit_xor("s2").over(before), F.lit(0)))
    d = d.join(sums.drop("s1", "s2"), ["ck", "chunk"])
    return d.select("ck", "conv_id", "k", "role", "text", F.col("r1").bitwiseXOR(F.col("b1")).alias("h1"), F.col("r2").bitwiseXOR(F.col("b2")).alias("h2"))


def maximal(rolled: DataFrame) -> DataFrame:
    """One row per conversation that stays: ck, conv_id, n_turns, n_copies (equal conversations, itself included)."""
    last = rolled.groupBy("ck").agg(F.max("k").alias("n"), F.max("conv_id").alias("conv_id"))
    keyed = rolled.select("ck", "k", "h1", "h2").join(last, "ck")
    whole = keyed.where("k = n").groupBy("k", "h1", "h2").agg(F.min(F.struct("conv_id", "ck")).alias("who"), F.count("*").alias("n_copies"))
    inside = keyed.where("k < n").select("k", "h1", "h2").distinct()
    kept = whole.join(inside, ["k", "h1", "h2"], "left_anti")
    return kept.select("who.ck", "who.conv_id", F.col("k").alias("n_turns"), "n_copies")


def render(rolled: DataFrame, kept: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies and the rendered text of each conversation of kept."""
    part = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    parts = rolled.join(kept.select("ck"), "ck", "left_semi").select("ck", F.struct("k", part.alias("p")).alias("s"))
    texts = parts.groupBy("ck").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda x: x["p"]), "").alias("rendered"))
    return kept.join(texts, "ck").select("conv_id", "n_turns", "n_copies", "rendered")


def format_chats(conversations: DataFrame) -> DataFrame:
    rolled = materialise(turns(conversations), "turns")
    return render(rolled, materialise(maximal(rolled), "maximal"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = r"""
WITH d AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k FROM d),
p AS (SELECT conv_id, k, md5(string_agg(coalesce('1' || role, '0') || chr(1) || coalesce('1' || text, '0'), chr(2)) OVER (PARTITION BY conv_id ORDER BY k)) AS h,
    count(*) OVER (PARTITION BY conv_id) AS n FROM o),
f AS (SELECT min(conv_id) AS conv_id, k AS n_turns, count(*) AS n_copies, h FROM p WHERE k = n GROUP BY k, h),
x AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k < p.n AND p.k = f.n_turns AND p.h = f.h))
SELECT x.conv_id, x.n_turns, x.n_copies, string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY k) AS rendered
FROM x JOIN o ON o.conv_id IS NOT DISTINCT FROM x.conv_id GROUP BY x.conv_id, x.n_turns, x.n_copies
"""
