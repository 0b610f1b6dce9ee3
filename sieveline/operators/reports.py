"""Rules and rollups of result tables: failures, refusals, significance, splits, usage, groups and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .curation import with_tag_sets

#: Fixed value: how a refusal reads.
REFUSAL = r"(?i)not covered by these documents|do(?:es)? not (?:contain|say|mention)"
#: Roman numerals of one to nine and tens; hundreds are so many C.
ONES = ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]
TENS = ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"]


def failed(error: Column, correctness: Column, hit: Column) -> Column:
    """Whether a result failed: an error, else correctness below 1, else no hit; unknown measures do not fail."""
    return F.when(error.isNotNull(), True).when(correctness.isNotNull(), correctness < 1).when(hit.isNotNull(), hit == 0).otherwise(False)


def refuses(answer: Column, pattern: str = REFUSAL) -> Column:
    """Whether an answer declines; null answers do not."""
    return F.coalesce(answer.rlike(pattern), F.lit(False))


def covers(tags: Column, wanted: Column) -> Column:
    """Whether every wanted tag is among the tags (null arrays are empty)."""
    empty = F.array().cast("array<string>")
    return F.size(F.array_except(F.coalesce(wanted, empty), F.coalesce(tags, empty))) == 0


def significance(low: Column, high: Column, p: Column) -> Column:
    """'ns' where the interval holds 0, else one star or more by the p value: the interval decides, whatever p is."""
    return F.when((low <= 0) & (high >= 0), "ns").when(p < 0.001, "***").when(p < 0.01, "**").otherwise("*")


def roman(n: Column) -> Column:
    """Roman numeral of a positive number, in letters up to C; null for others."""
    digit = lambda table, d: F.element_at(F.array(*[F.lit(x) for x in table]), (d + 1).cast("int"))
    return F.when(n > 0, F.concat(F.repeat(F.lit("C"), F.floor(n / 100).cast("int")), digit(TENS, F.floor(n / 10) % 10), digit(ONES, n % 10)))


def from_roman(text: Column) -> Column:
    """Number of a numeral that `roman` writes; null for anything else, small letters included."""
    worth = lambda c: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100)) for x in kv]), c), F.lit(0))
    values = F.transform(F.split(text, ""), worth)
    # a smaller value before a larger one is taken off
    signed = F.transform(values, lambda v, i: F.when(v < F.coalesce(F.get(values, i + 1), F.lit(0)), -v).otherwise(v))
    n = F.aggregate(signed, F.lit(0), lambda s, v: s + v)
    return F.when(text == roman(n), n)


def streak_day(start: Column, today: Column) -> Column:
    """Day number of a streak: 1 on its first day, never below."""
    return F.greatest(F.lit(1), F.date_diff(today, start) + 1)


def recent(df: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    """Rows whose time lies in the last `days` days before now; a range on the column itself, which scans can push down."""
    return df.where((F.col(at) > now - F.expr(f"interval {days} days")) & (F.col(at) <= now))


def usage(df: DataFrame, at: str, provider: str, keep_days: int) -> DataFrame:
    """(day, provider, n) per UTC day of the table's last day and the keep_days days before it."""
    d = df.select(F.to_date(at).alias("day"), F.col(provider).alias("provider")).groupBy("day", "provider").agg(F.count("*").alias("n"))
    return d.join(F.broadcast(d.agg(F.max("day").alias("last"))), F.col("day") >= F.date_sub("last", keep_days)).drop("last")  # one row


def memberships(items: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, n): items (id, tags) with any of a group's tags (group, tag); an item counts once in each group."""
    return items.select("id", F.explode(F.array_distinct("tags")).alias("tag")).join(groups, "tag").select("group", "id").distinct().groupBy("group").agg(F.count("*").alias("n"))


def captured_counts(df: DataFrame, text: str, pattern: str) -> DataFrame:
    """(found, n): rows by what the pattern's first group captures; rows without a match are left out."""
    got = F.regexp_extract(text, pattern, 1)
    return df.where(F.col(text).rlike(pattern)).groupBy(got.alias("found")).agg(F.count("*").alias("n"))


def split_rates(results: DataFrame, gate_first: float, gate_second: float) -> DataFrame:
    """(split, n, first, second, passed) of results (split, first, second): mean hits and whether both reach their gates."""
    d = results.groupBy("split").agg(F.count("*").alias("n"), F.avg(F.col("first").cast("double")).alias("first"), F.avg(F.col("second").cast("double")).alias("second"))
    passed = (F.col("first") >= gate_first) & (F.col("second") >= gate_second)
    return d.select("split", "n", F.round("first", 6).alias("first"), F.round("second", 6).alias("second"), passed.alias("passed"))


def fixed_groups(df: DataFrame, by: str, order: list[str], size: int) -> DataFrame:
    """df with `batch`: groups of `size` rows in order inside each key."""
    return df.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(by).orderBy(*order)) - 1) / size))


def latest_finished(runs: DataFrame, n: int = 100) -> DataFrame:
    """The n latest runs (run_id, started, finished) that have ended, newest first."""
    return runs.where("finished is not null").orderBy(F.desc("started"), "run_id").limit(n)


def flagged_last(df: DataFrame, flag: str, order: str) -> DataFrame:
    """df with `place`, from 1: clean rows first, each part in its order. Places come from per-range counts, not one task."""
    d = df.withColumn("__f", F.coalesce(F.col(flag).cast("int"), F.lit(0))).orderBy("__f", order).withColumn("__k", F.spark_partition_id())
    inner = W.partitionBy("__k").orderBy("__f", order)
    d = d.withColumn("__r", F.row_number().over(inner))
    sums = d.groupBy("__k").agg(F.count("*").alias("__c"))  # a row per range partition
    sums = sums.withColumn("__b", F.coalesce(F.sum("__c").over(W.orderBy("__k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return d.join(F.broadcast(sums.drop("__c")), "__k").withColumn("place", F.col("__r") + F.col("__b")).drop("__f", "__k", "__r", "__b")


def group_ranking(asked: DataFrame, people: DataFrame, first: int = 7) -> DataFrame:
    """(query, id, matched, place, in_walk): people (id, tags, preferred, seq) that share a tag with a query (query, tags), best first.

    Each distinct set of tags is ranked once, and queries are joined with its ranking. A ranking is a row per 1,024 places."""
    w = with_tag_sets(asked, "query")
    a = w.select("set").distinct().repartition("set").select("set", F.explode("set").alias("tag"))
    p = people.select("id", "preferred", "seq", F.explode(F.array_distinct("tags")).alias("tag"))
    m = a.join(p, "tag").groupBy("set", "id", "preferred", "seq").agg(F.count("*").alias("matched"))
    m = m.withColumn("place", F.row_number().over(W.partitionBy("set").orderBy(F.desc("matched"), F.desc("preferred"), "seq")))
    ranking = m.groupBy("set", F.floor(F.col("place") / 1024).alias("__block")).agg(F.sort_array(F.collect_list(F.struct("place", "id", "matched"))).alias("r"))
    d = w.join(ranking, "set").select("query", F.explode("r").alias("r")).select("query", "r.id", "r.matched", "r.place")
    return d.withColumn("in_walk", F.col("place") <= first)
