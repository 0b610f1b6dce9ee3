"""Paired series of runs, sweeps over arms and leak-free splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import written
from .metrics import finite
from .stats import holm, paired_bootstrap

#: Metrics that are counts where fewer is better, spend by name, the order of kinds, preferred metrics.
COUNTS = ["danglingCitations"]
SPEND = {"costUsd": "usd", "totalMs": "ms"}
KINDS = ["rate", "count", "usd", "ms"]
PREFERRED = ["correctness", "faithfulness", "recall@10", "recall@5"]


def kind_of(metric: Column) -> Column:
    """Kind of a metric by name: a rate unless it is listed."""
    spend = F.coalesce(*[F.when(metric == k, v) for k, v in SPEND.items()])
    return F.when(metric.isin(COUNTS), "count").otherwise(F.coalesce(spend, F.lit("rate")))


def metric_place(metric: Column) -> Column:
    """Sort key: kind, then family without regard to case, then the cutoff after the last @ as a number (none first)."""
    cutoff = F.regexp_extract(metric, r"@(\d+(?:\.\d+)?)$", 1)
    family = F.when(cutoff == "", metric).otherwise(F.regexp_replace(metric, r"@[^@]*$", ""))
    kind = F.array_position(F.array(*map(F.lit, KINDS)), kind_of(metric))
    return F.struct(kind.alias("kind"), F.lower(family).alias("family"), F.coalesce(F.when(cutoff != "", cutoff).cast("double"), F.lit(-1.0)).alias("cutoff"), metric.alias("name"))


def paired_series(base: DataFrame, arms: DataFrame) -> DataFrame:
    """(run, metric, id, a, b): values of the baseline (id, error, metric, value) with those of each arm (run, id, ...).

    A question that failed in either run, or whose value is null or not finite in either, is missing, not zero; a metric
    that only one side has pairs on nothing. One equi-join on (id, metric) for all arms and metrics; null ids pair never."""
    fine = lambda d, name, *more: d.where(F.col("error").isNull()).select(*more, "id", "metric", finite(F.col("value")).alias(name)).where(F.col(name).isNotNull())
    return fine(arms, "b", "run").join(fine(base, "a"), ["id", "metric"]).select("run", "metric", "id", "a", "b")


def series_report(pairs: DataFrame) -> DataFrame:
    """(run, place, metric, kind, higher_is_better, n, mean_a, mean_b, delta) of paired series, in reading order."""
    s = pairs.groupBy("run", "metric").agg(F.count("*").alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg(F.col("b") - F.col("a")).alias("delta"))
    place = F.row_number().over(W.partitionBy("run").orderBy(metric_place(F.col("metric"))))  # a row a metric
    kind = kind_of(F.col("metric"))
    return s.select("run", place.cast("long").alias("place"), "metric", kind.alias("kind"), (kind == "rate").alias("higher_is_better"), "n", *[F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "delta")])


def sweep(pairs: DataFrame, metric: str | None = None, iters: int = 10_000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """(run, tests, survivors, metric, delta, lo, hi, p, adjusted, reject) of each arm against the baseline.

    All series of all arms are resampled in one plan; each arm's p-values are a Holm family of their own. The metric
    shown is the one asked for (nulls where an arm lacks it), else the first preferred one, else the first rate, else the first in order."""
    p = paired_bootstrap(pairs.select("run", "metric", F.col("id").alias("pos"), F.col("b").alias("a"), F.col("a").alias("b")), iters, alpha, seed, ["run", "metric"])
    tests = holm(p.select("run", F.col("metric").alias("test"), F.col("p_value").alias("p")), alpha, ["run"]).withColumnRenamed("test", "metric")
    rows = p.join(tests, ["run", "metric"])
    rank = F.array_position(F.array(*map(F.lit, PREFERRED)), F.col("metric"))
    first = F.struct(F.when(rank == 0, len(PREFERRED) + 1).otherwise(rank).alias("r"), metric_place(F.col("metric")).alias("p"))
    row = F.struct("metric", F.col("mean_diff").alias("delta"), "lo", "hi", "p", "adjusted", "reject")
    shown = F.min_by(row, first) if metric is None else F.max(F.when(F.col("metric") == metric, row))
    out = rows.groupBy("run").agg(F.count("*").alias("tests"), F.count_if("reject").alias("survivors"), shown.alias("s"))
    return out.select("run", "tests", "survivors", "s.*")


def families(items: DataFrame, quotas: dict[str, int], pinned: list[str]) -> DataFrame:
    """(root, place, c0.., fits): each family of items (id, root, type), with its members of each quota's type.

    `fits` is false for a family that holds a pinned type or one without a quota: it can never be drawn."""
    members = [F.count_if(F.col("type") == t).alias(f"c{k}") for k, t in enumerate(quotas)]
    wrong = F.col("type").isNull() | F.col("type").isin(pinned) | ~F.col("type").isin(list(quotas))
    return items.where(F.col("root").isNotNull()).groupBy("root").agg(*members, (F.count_if(wrong) == 0).alias("fits"))


def leak_free_split(items: DataFrame, quotas: dict[str, int], pinned: list[str], first: str | None, order: Column, strict: bool = True) -> tuple[DataFrame, dict[str, int]]:
    """(items with split, what the quotas still lack): whole families go to the holdout until quotas by type are full.

    Families come in `order` (an expression of root), those with a member of type `first` before all others, as they
    are the scarce ones. A family is taken unless it would overshoot any quota. Done in rounds instead of one by
    one: quotas only shrink, so families with more members of a type than is left go for good; of the next ones (at most
    one more than the quotas' sum, as each fills something) those up to the first running sum over a quota
    are what the sequential choice takes, and the one that breaks it is skipped for good. A round ends with a quota
    below some family's need, so there are few. Items with a null root stay in dev, as do pinned types. Raises where
    quotas lack something, unless `strict` is false."""
    names, need = list(quotas), dict(quotas)
    cols = [f"c{k}" for k in range(len(names))]
    fam = families(items, quotas, pinned).where("fits").withColumn("place", F.struct(order.alias("key"), "root"))
    fam = written(fam, "families")
    taken: list[DataFrame] = []
    phases = [F.col(f"c{names.index(first)}") > 0, F.col(f"c{names.index(first)}") == 0] if first else [F.lit(True)]
    for phase in phases:
        after = None
        while sum(need.values()) > 0:
            open_ = fam.where(phase)
            for c, t in zip(cols, names):
                open_ = open_.where(F.col(c) <= need[t])
            if after is not None:
                open_ = open_.join(after, F.col("place") > F.col("__after")).drop("__after")  # one row
            if first and phase is phases[0] and need[first] <= 0:
                break
            batch = open_.orderBy("place").limit(sum(need.values()) + 1)
            run = W.orderBy("place").rowsBetween(W.unboundedPreceding, 0)  # as many rows as quotas at most
            over = F.lit(False)
            for c, t in zip(cols, names):
                over = over | (F.sum(c).over(run) > need[t])
            batch = written(batch.withColumn("over", over.cast("int")).withColumn("over", F.max("over").over(run)), "batch")
            won = batch.where("over = 0")
            sums = won.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in cols]).first()
            if sums["n"] == 0 and not batch.where("over = 1").head(1):
                break
            need = {t: need[t] - sums[c] for c, t in zip(cols, names)}
            taken.append(won.select("root"))
            after = batch.where("over = 1").agg(F.min("place").alias("p"))
            if after.first()["p"] is None:
                break
            after = after.select(F.col("p").alias("__after"))
    roots = None
    for d in taken:
        roots = d if roots is None else roots.unionByName(d)
    if strict and any(need.values()):
        raise ValueError("quotas lack " + ", ".join(f"{n} {t}" for t, n in need.items() if n))
    if roots is None:
        return items.withColumn("split", F.lit("dev")), need
    mark = roots.distinct().withColumn("split", F.lit("holdout"))
    return items.join(mark, "root", "left").withColumn("split", F.coalesce("split", F.lit("dev"))).select(*items.columns, "split"), need
