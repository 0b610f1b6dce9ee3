"""Tagging, curated ranking, quotas, balanced samples, claims and label upkeep."""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stats import log_factorial


def plain(text: Column) -> Column:
    """Lower-case words between single spaces, for matching stems at word starts."""
    t = F.regexp_replace(F.regexp_replace(F.lower(text), "[’']", "'"), "[^a-z' ]+", " ")
    return F.concat(F.lit(" "), F.regexp_replace(t, " +", " "), F.lit(" "))


def match_tags(messages: DataFrame, stems: dict[str, list[str]]) -> DataFrame:
    """(id, tags) of messages (id, text): tags one of whose stems starts a word. The dictionary is part of the plan."""
    d = messages.select("id", plain(F.col("text")).alias("__t"))  # a column of its own: inside a lambda it would be made anew for every stem
    hits = [F.when(reduce(or_, [F.contains("__t", F.lit(f" {s}")) for s in words]), F.lit(tag)) for tag, words in stems.items()]
    return d.select("id", F.array_compact(F.array(*hits)).alias("tags"))


def phrase_kind(text: Column, phrases: dict[str, list[str]], soft: str) -> Column:
    """First kind one of whose phrases occurs; `ask` where only the soft signal does; null else."""
    t = F.lower(text)
    out = None
    for kind, words in phrases.items():
        found = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(t, w))
        out = F.when(found, kind) if out is None else out.when(found, kind)
    return out.when(t.rlike(soft), "ask")


def with_tag_sets(asked: DataFrame, query: str, tags: str = "tags") -> DataFrame:
    """(query, set): the tags of every query, sorted; a tag of several rows of one query counts as often. Queries without tags go.

    What a query finds depends on its tags alone, so searches answer each distinct set once. The rows are dealt out before
    they are grouped, as a small file of many queries is one task."""
    d = asked.select(query, F.array_distinct(tags).alias("__t")).where(F.size("__t") > 0).repartition(query)
    return d.groupBy(query).agg(F.sort_array(F.flatten(F.collect_list("__t"))).alias("set"))


def rank_entities(wanted: DataFrame, entities: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, id, matched, rarity, rank): entities (id, tags, first, seq) that share a tag with wanted (query_id, tags).

    More shared tags, then rarer ones (sum of 1 / holders), then `first`, then seq. An equi join on the tag, made once for each
    distinct set of tags; its k best are one row that queries are joined with."""
    e = entities.select("id", "first", "seq", F.explode(F.array_distinct("tags")).alias("tag"))
    holders = e.groupBy("tag").agg(F.count("*").alias("holders"))
    w = with_tag_sets(wanted, "query_id")
    q = w.select("set").distinct().repartition("set").select("set", F.explode("set").alias("tag"))
    s = q.join(e.join(holders, "tag"), "tag").groupBy("set", "id", "first", "seq").agg(F.count("*").alias("matched"), F.round(F.sum(1 / F.col("holders")), 6).alias("rarity"))
    o = W.partitionBy("set").orderBy(F.desc("matched"), F.desc("rarity"), F.desc("first"), "seq")
    s = s.withColumn("rank", F.row_number().over(o)).where(F.col("rank") <= k)
    best = s.groupBy("set").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "matched", "rarity"))).alias("best"))
    return w.join(best, "set").select("query_id", F.explode("best").alias("b")).select("query_id", "b.id", "b.matched", "b.rarity", "b.rank")


def within_quota(rows: DataFrame, by: str, item: str, total: int, share: float = 0.7, least: int = 2) -> DataFrame:
    """Rows (by, group, item, rank) in per-group quotas of max(least, share * total / groups), one row per item, at most `total`.

    Rows are dealt out by `by` once, into all shuffle partitions: several sorts of a partition are in memory at the same time, so
    small ones are not merged. Groups are counted where they begin in the first order, null ones not."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = rows.select(by, "group", item, "rank").where(F.col(by).isNotNull()).repartition(parts, by)
    d = d.withColumn("k", F.row_number().over(W.partitionBy(by, "group").orderBy("rank", item)))
    d = d.withColumn("groups", F.count(F.when((F.col("k") == 1) & F.col("group").isNotNull(), 1)).over(W.partitionBy(by)))
    d = d.where(F.col("k") <= F.greatest(F.lit(least), F.floor(F.try_divide(F.lit(share * total), F.col("groups")))))
    d = d.withColumn("seen", F.row_number().over(W.partitionBy(by, item).orderBy("rank", "group"))).where("seen = 1")
    return d.withColumn("pos", F.row_number().over(W.partitionBy(by).orderBy("rank", "group", item))).where(F.col("pos") <= total).select(by, "group", item, "pos")


def balanced(rows: DataFrame, key: str, flag: str, n: int) -> DataFrame:
    """n rows, half flagged and half not in md5 order; what one half lacks the other fills."""
    order = [F.md5(F.col(key).cast("string")), F.col(key)]
    d = rows.withColumn("k", F.row_number().over(W.partitionBy(flag).orderBy(*order))).where(F.col("k") <= n)
    d = d.withColumn("late", F.col("k") > n // 2)
    return d.orderBy("late", "k", F.desc(flag)).limit(n).select(key, flag)


def proportional(rows: DataFrame, key: str, by: str, n: int) -> DataFrame:
    """About n rows: of each type its rounded share, one at least, in order of key."""
    sizes = rows.groupBy(by).agg(F.count("*").alias("c"))
    total = sizes.agg(F.sum("c").alias("t"))
    quota = sizes.join(total, F.lit(True)).select(by, F.greatest(F.lit(1), F.floor(F.col("c") * n / F.col("t") + 0.5)).alias("quota"))
    d = rows.withColumn("k", F.row_number().over(W.partitionBy(by).orderBy(key)))
    return d.join(quota, by).where("k <= quota").select(key, by)


def claim_batch(subscribers: DataFrame, day: int, n: int) -> DataFrame:
    """The first n subscribers (id, last_day) by id not yet served on the day, marked as served."""
    return subscribers.where(F.coalesce("last_day", F.lit(-1)) < day).orderBy("id").limit(n).select("id", F.lit(day).alias("last_day"))


def correct_labels(labels: DataFrame, corrections: DataFrame, key: str, field: str) -> DataFrame:
    """labels with corrections (key, to, evidence) applied to field once, and an audit array of what changed."""
    j = labels.join(corrections, key, "left")
    changed = F.col("to").isNotNull() & ~F.col("to").eqNullSafe(F.col(field))
    audit = F.when(changed, F.array(F.concat_ws("|", F.lit(field), F.col(field).cast("string"), F.col("to").cast("string"), F.col("evidence")))).otherwise(F.array())
    return j.withColumn("audit", audit).withColumn(field, F.when(changed, F.col("to")).otherwise(F.col(field))).select(*labels.columns, "audit")


def sign_test(top: Column, others: Column) -> Column:
    """Exact two-sided p value of top against others. Terms more than 40 standard deviations off add nothing to a double."""
    n = (top + others).cast("double")
    whole, k = log_factorial(n), F.least(top, others).cast("long")
    far = F.greatest(F.lit(0).cast("long"), k - 40 * F.ceil(F.sqrt(n + 1)).cast("long"))
    terms = F.transform(F.sequence(far, k), lambda i: F.exp(whole - log_factorial(i) - log_factorial(n - i) - n * math.log(2)))
    return F.least(F.lit(1.0), 2 * F.aggregate(terms, F.lit(0.0), lambda s, t: s + t))


def agreement(pairs: DataFrame, by: str, alpha: float = 0.05) -> DataFrame:
    """(by, n, agreement, kappa, skew, bias_p, flag) of binary labels a and b per group, with the first flag that applies.

    Labels are biased where one kind of three or more disagreements outnumbers the other by more than a sign test (bias_p)
    puts down to chance: a majority alone is no direction. Rows whose labels are adjudicated are left out by the caller."""
    c = pairs.groupBy(by).agg(F.count("*").alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("o"), F.avg(F.col("a").cast("double")).alias("pa"), F.avg(F.col("b").cast("double")).alias("pb"),
                              F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("b10"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("b01"))
    e = F.round(F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb")), 12)
    k = F.when(e == 1, F.when(F.col("o") == 1, 1.0).otherwise(0.0)).otherwise(F.try_divide(F.col("o") - e, 1 - e))
    skew = F.greatest("pa", 1 - F.col("pa"))
    apart = (F.col("b10") + F.col("b01") >= 3) & (F.col("b10") != F.col("b01"))
    p = F.when(apart, F.round(sign_test(F.greatest("b10", "b01"), F.least("b10", "b01")), 9))
    flag = F.when(p < alpha, "BIASED").when(F.col("pa") == 1, "NO NEGATIVES").when(skew >= 0.9, "SKEWED").when(k < 0.6, "WEAK")
    return c.select(by, "n", F.round("o", 6).alias("agreement"), F.round(k, 6).alias("kappa"), F.round(skew, 6).alias("skew"), p.alias("bias_p"), flag.alias("flag"))


def context_block(hits: DataFrame) -> DataFrame:
    """(query_id, context): ranked hits (query_id, rank, title, text) as one numbered block."""
    part = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("title", F.lit("(unknown)")), F.lit("\n"), F.col("text"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("rank", part.alias("p")))), lambda x: x["p"])
    return hits.groupBy("query_id").agg(F.array_join(parts, "\n\n").alias("context"))
