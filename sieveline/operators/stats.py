"""Seeded, reproducible statistics over paired results."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import draws, mulberry32
from ..sources.shared import numbered, written


#: Values in one block, so that no row or task holds all values of a large group; draws of one task from one block; draws made at once.
BLOCK, TASK_DRAWS, CHUNK = 1 << 20, 1 << 27, 1 << 16


def _packed(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """One block of values as bytes of doubles in order; a null is zero there and marked in `some`."""
    pdf = pdf.sort_values("at")
    some = pdf["some"].to_numpy(dtype=bool)
    xs = np.where(some, pdf["x"].to_numpy(dtype=np.float64), 0.0)
    return pd.DataFrame({"__g": [key[0]], "__n": [key[1]], "b": [key[2]], "xs": [xs.tobytes()], "some": [None if some.all() else some.tobytes()]})


def _folded(seed: int, block: int):
    """Sums of the draws of resamples i0 .. i1-1 that fall into a block, each folded draw by draw."""

    def run(frames):
        for pdf in frames:
            for g, n, b, i0, i1, xs, some in pdf[["__g", "__n", "b", "i0", "i1", "xs", "some"]].itertuples(index=False, name=None):
                x, fine = np.frombuffer(xs), None if some is None else np.frombuffer(some, dtype=bool)
                parts, counts = np.zeros(i1 - i0), np.zeros(i1 - i0, dtype=np.int64)
                for i in range(i0, i1):
                    total, count = 0.0, 0
                    for at in range(0, n, CHUNK):
                        p = np.floor(draws(seed, i * n + at, min(CHUNK, n - at)) * n).astype(np.int64)
                        if n > block:
                            p = p[(p >= b * block) & (p < (b + 1) * block)] - b * block
                        got = x[p]
                        if len(got):
                            got[0] += total
                            total = np.add.accumulate(got)[-1]
                            count += len(p) if fine is None else int(fine[p].sum())
                    parts[i - i0], counts[i - i0] = total, count
                yield pd.DataFrame({"__g": g, "i": np.arange(i0, i1), "b": b, "part": parts, "count": counts})

    return run


def resampled_means(values: DataFrame, iters: int, seed: int, by: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """(by, i, m): means of `iters` seeded resamples of each group's values (by, pos, x), drawn in order of pos.

    Values are numbered and packed into blocks. Each block meets ranges of resamples, about TASK_DRAWS draws to a range;
    the draws of a range are made where it lies and those that fall into the block are folded. So draws are never rows,
    a block travels once per range, and only the groups' sizes are ever small enough to be sent to all tasks. Sums of
    blocks are added in order. A group of one block is folded draw by draw, as a loop would; larger ones differ from a
    loop by rounding alone. Null values add nothing. Draw k of the stream is a function of k, so resamples need nothing
    from each other. The seeded stream starts anew for each group."""
    by = by or []
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = numbered(values.select(*by, "pos", "x"), by, ["pos"])
    sizes = d.groupBy(*by).agg(F.count("*").alias("__n")).where("__n > 0")
    sizes = written(sizes.withColumn("__g", F.monotonically_increasing_id()), "groups")
    cells = d.join(sizes, by or F.lit(True)).select("__g", "__n", F.floor(F.col("at") / block).alias("b"), "at", F.col("x").cast("double").alias("x"), F.col("x").isNotNull().alias("some"))
    packed = cells.groupBy("__g", "__n", "b").applyInPandas(_packed, "__g long, __n long, b long, xs binary, some binary")
    step = F.greatest(F.lit(1), F.floor(F.lit(TASK_DRAWS) / F.col("__n"))).cast("long")
    rows = packed.withColumn("i0", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(iters - 1).cast("long"), step)))
    rows = rows.withColumn("i1", F.least(F.col("i0") + step, F.lit(iters).cast("long"))).repartition(parts, "__g", "b", "i0")
    folded = rows.mapInPandas(_folded(seed, block), "__g long, i long, b long, part double, count long")
    sums = folded.groupBy("__g", "i").agg(F.sort_array(F.collect_list(F.struct("b", "part"))).alias("parts"), F.sum("count").alias("count"))
    m = F.when(F.col("count") > 0, F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["part"]) / F.col("__n"))
    return sums.join(sizes, "__g").select(*by, "i", m.alias("m"))


def interval(means: DataFrame, iters: int, alpha: float, by: list[str]) -> DataFrame:
    """(by, lo, hi, p_value) of resampled means: nearest-rank quantiles and the two-sided share at or beyond 0."""
    low, high = (F.count_if(F.col("m") <= 0) + 1) / (iters + 1), (F.count_if(F.col("m") >= 0) + 1) / (iters + 1)
    ends = [F.expr(f"percentile_disc({q}) within group (order by m)").alias(c) for c, q in (("lo", alpha / 2), ("hi", 1 - alpha / 2))]
    return means.groupBy(*by).agg(*ends, F.least(F.lit(1.0), 2 * F.least(low, high)).alias("p_value"))


def bootstrap_ci(values: DataFrame, iters: int = 10_000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """(n, mean, lo, hi): percentile bootstrap of the mean with nearest-rank quantiles; a row of nulls without values."""
    ends = interval(resampled_means(values, iters, seed), iters, alpha, [])
    return values.agg(F.count("*").alias("n"), F.avg("x").alias("mean")).join(ends, F.lit(True)).select("n", *[F.round(c, 9).alias(c) for c in ("mean", "lo", "hi")])


def paired_bootstrap(pairs: DataFrame, iters: int = 10_000, alpha: float = 0.05, seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """(by, n, mean_diff, lo, hi, p_value, discordant) of pairs (by, pos, a, b), already joined on the question; by is not null."""
    by = by or []
    diffs = pairs.select(*by, "pos", (F.col("a") - F.col("b")).alias("x"))
    ends = interval(resampled_means(diffs, iters, seed, by), iters, alpha, by)
    sums = diffs.groupBy(*by).agg(F.count("*").alias("n"), F.avg("x").alias("mean_diff"), F.count_if(F.col("x") != 0).alias("discordant"))
    return sums.join(ends, by or F.lit(True)).select(*by, "n", "discordant", *[F.round(c, 9).alias(c) for c in ("mean_diff", "lo", "hi", "p_value")])


#: Bernoulli terms of Stirling's series of the log factorial.
STIRLING = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188]


def log_factorial(x: Column) -> Column:
    """ln x!: Stirling's series of x + 9, of which the nine factors too many are taken off; within 1e-12 of it, relative to its size."""
    y = x.cast("double") + 10
    series = sum((F.lit(c) / F.pow(y, F.lit(2 * k + 1)) for k, c in enumerate(STIRLING)), F.lit(0.5 * math.log(2 * math.pi)))
    return (y - 0.5) * F.log(y) - y + series - sum((F.log(x.cast("double") + k) for k in range(2, 10)), F.log(x.cast("double") + 1))


def mcnemar(pairs: DataFrame) -> DataFrame:
    """(b01, b10, n, statistic, p_value) of boolean pairs (a, b): exact two-sided binomial, p 1 without discordance.

    The driver sees the two counts; the terms of the tail are rows of a distributed range and added up there."""
    c = pairs.agg(F.count_if(F.col("a") & ~F.col("b")).alias("b01"), F.count_if(~F.col("a") & F.col("b")).alias("b10")).first()
    n, k = c["b01"] + c["b10"], min(c["b01"], c["b10"])
    i, whole = F.col("id"), log_factorial(F.lit(n))
    terms = pairs.sparkSession.range(k + 1).select(F.exp(whole - log_factorial(i) - log_factorial(F.lit(n) - i) - n * math.log(2)).alias("t"))
    p = F.lit(1.0) if n == 0 else F.round(F.least(F.lit(1.0), 2 * F.sum("t")), 9)
    statistic = round((abs(c["b01"] - c["b10"]) - 1) ** 2 / n, 9) if n else 0.0
    return terms.agg(p.alias("p_value")).select(F.lit(c["b01"]).cast("long").alias("b01"), F.lit(c["b10"]).cast("long").alias("b10"), F.lit(n).cast("long").alias("n"), F.lit(statistic).cast("double").alias("statistic"), "p_value")


def holm(tests: DataFrame, alpha: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """tests (by, test, p) with adjusted and reject: running maximum of (m - rank) * p in each family, capped at 1."""
    by = by or []
    w = W.partitionBy(*by).orderBy("p", "test")  # one row per test of a report
    scaled = F.least(F.lit(1.0), (F.count("*").over(W.partitionBy(*by)) - F.row_number().over(w) + 1) * F.col("p"))
    out = tests.withColumn("scaled", scaled).withColumn("adjusted", F.round(F.max("scaled").over(w.rowsBetween(W.unboundedPreceding, 0)), 9))
    return out.select(*by, "test", F.round("p", 9).alias("p"), "adjusted", (F.col("adjusted") <= alpha).alias("reject"))


def kappa(pairs: DataFrame) -> DataFrame:
    """(n, agreement, kappa, weak) of nominal labels (a, b); perfect agreement on one class counts as 1."""
    cells = pairs.groupBy("a", "b").agg(F.count("*").alias("c"))
    total = cells.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"))
    left, right = cells.groupBy("a").agg(F.sum("c").alias("ca")), cells.groupBy(F.col("b").alias("a")).agg(F.sum("c").alias("cb"))
    chance = left.join(right, "a").agg(F.coalesce(F.sum(F.col("ca") * F.col("cb")), F.lit(0)).alias("e"))
    t = total.join(chance, F.lit(True))
    n = F.col("n").cast("double")
    o, e = F.col("same") / n, F.col("e") / (n * n)
    k = F.when(e == 1, F.when(o == 1, 1.0).otherwise(0.0)).otherwise(F.try_divide(o - e, 1 - e))
    return t.select("n", F.round(o, 9).alias("agreement"), F.round(k, 9).alias("kappa"), (k < 0.6).alias("weak"))


def z_quantile(p: float) -> float:
    """Inverse normal distribution function."""
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def min_detectable(rates: DataFrame, alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """(n, rate, half_width, unpaired, paired) of rows (n, rate, correlation)."""
    za, zb = z_quantile(1 - alpha / 2), z_quantile(power)
    v = F.col("rate") * (1 - F.col("rate"))
    return rates.select(
        "n", F.round("rate", 9).alias("rate"), F.round(za * F.sqrt(v / F.col("n")), 6).alias("half_width"),
        F.round((za + zb) * F.sqrt(2 * v / F.col("n")), 6).alias("unpaired"), F.round((za + zb) * F.sqrt(2 * v * (1 - F.col("correlation")) / F.col("n")), 6).alias("paired"),
    )


def prng(spark: SparkSession, seed: int, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("k"), F.element_at(mulberry32(seed, F.array("id")), 1).alias("x"))
