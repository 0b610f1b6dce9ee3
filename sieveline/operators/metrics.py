"""Retrieval metrics per question, run aggregates, paired comparison and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import numbered

CUTOFFS = (1, 3, 5, 10, 20)


def score_rankings(questions: DataFrame, hits: DataFrame, truth: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """(query_id, k, recall, precision, mrr, ndcg, hit_rate) for each question and cutoff.

    hits (query_id, id, rank), truth (query_id, id) distinct. No relevant row: null; relevant but missed: 0."""
    n = truth.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    return score_marked(questions, hits.join(truth.withColumn("hit", F.lit(1)), ["query_id", "id"], "left"), n, cutoffs)


def score_marked(questions: DataFrame, marked: DataFrame, n: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """score_rankings of hits marked already (query_id, id, rank, hit 1 or 0 or null) with n (query_id, n_relevant): truth need not be listed."""
    ks = F.array(*[F.lit(k) for k in cutoffs])
    ranks = marked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", F.coalesce("hit", F.lit(0)).alias("hit")))).alias("r"))
    q = questions.select("query_id").join(n, "query_id", "left").join(ranks, "query_id", "left").withColumn("k", F.explode(ks))
    window = F.filter(F.coalesce("r", F.array()), lambda x: x["rank"] <= F.col("k"))
    q = q.withColumn("w", window).withColumn("h", F.filter("w", lambda x: x["hit"] == 1))
    gain = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + 1 / F.log2(x["rank"] + 1))
    best = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.col("k")).cast("int")), F.lit(0.0), lambda s, x: s + 1 / F.log2(x + 1))
    known = F.col("n_relevant") > 0
    found = F.size(F.array_distinct(F.transform("h", lambda x: x["id"])))
    return q.select(
        "query_id", "k",
        F.when(known, F.round(found / F.col("n_relevant"), 6)).alias("recall"),
        F.when(known, F.round(F.when(F.size("w") == 0, 0.0).otherwise(F.try_divide(F.size("h"), F.size("w"))), 6)).alias("precision"),
        F.when(known, F.round(F.coalesce(1 / F.array_min(F.transform("h", lambda x: x["rank"])), F.lit(0.0)), 6)).alias("mrr"),
        F.when(known, F.round(gain(F.col("h")) / best, 6)).alias("ndcg"),
        F.when(known, (F.size("h") > 0).cast("double")).alias("hit_rate"),
    )


def doc_recall(questions: DataFrame, hits: DataFrame, truth: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """(query_id, k, doc_recall): share of a question's relevant documents, truth (query_id, doc), that hits (query_id, doc, rank)
    hold in the first k, a document counted once. No relevant document: null; relevant but missed: 0."""
    t = truth.select("query_id", "doc").distinct()
    first = hits.join(t, ["query_id", "doc"]).groupBy("query_id", "doc").agg(F.min("rank").alias("rank"))
    found = first.groupBy("query_id").agg(F.array(*[F.count_if(F.col("rank") <= k) for k in cutoffs]).alias("found"))
    q = questions.select("query_id").join(t.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").join(found, "query_id", "left")
    q = q.select("query_id", "n", "found", F.posexplode(F.array(*[F.lit(k) for k in cutoffs])).alias("at", "k"))
    return q.select("query_id", "k", F.when(F.col("n") > 0, F.round(F.coalesce(F.get("found", "at"), F.lit(0)) / F.col("n"), 6)).alias("doc_recall"))


def score_names(questions: DataFrame, hits: DataFrame, truth: DataFrame, doc_truth: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """(query_id, metric, value): mrr over all hits (query_id, id, doc, rank) and six metrics at each cutoff, named like "recall@5"."""
    hits = hits.select("query_id", "id", "doc", "rank")
    per = score_rankings(questions, hits.drop("doc"), truth, cutoffs).join(doc_recall(questions, hits.drop("id"), doc_truth, cutoffs), ["query_id", "k"])
    names = {"recall": "recall", "precision": "precision", "ndcg": "ndcg", "hitRate": "hit_rate", "docRecall": "doc_recall", "mrr": "mrr"}
    each = F.array(*[F.struct(F.concat(F.lit(f"{n}@"), F.col("k").cast("string")).alias("metric"), F.col(c).alias("value")) for n, c in names.items()])
    best = hits.join(truth.select("query_id", "id").distinct(), ["query_id", "id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    known = truth.select("query_id").distinct().withColumn("known", F.lit(True))
    whole = questions.select("query_id").join(known, "query_id", "left").join(best, "query_id", "left")
    whole = whole.select("query_id", F.lit("mrr").alias("metric"), F.when(F.col("known"), F.round(F.coalesce(1 / F.col("rank"), F.lit(0.0)), 6)).alias("value"))
    return per.select("query_id", F.inline(each)).unionByName(whole)


def nearest_rank(column: str, q: float) -> Column:
    """Aggregate: the ceil(q * n)-th smallest value, 0 for none."""
    return F.coalesce(F.expr(f"percentile_disc({q}) within group (order by {column})"), F.lit(0))


def ranks(df: DataFrame, by: list[str], value: str, near: dict[str, float], floor: dict[str, float]) -> DataFrame:
    """(by, one column per name): quantiles by nearest rank (the ceil(q * n)-th smallest) and by floor (index floor(q * n)
    from 0, clamped), nulls left out. Values are numbered where they lie and looked up by number; no group is gathered."""
    d = numbered(df.where(F.col(value).isNotNull()).select(*by, value), by, [value])
    sizes = d.groupBy(*by).agg(F.count("*").alias("n"))
    keys = [F.col(c).alias(f"__k{k}") for k, c in enumerate(by)]
    want = {c: F.greatest(F.ceil(q * F.col("n")) - 1, F.lit(0)) for c, q in near.items()} | {c: F.least(F.col("n") - 1, F.floor(q * F.col("n"))) for c, q in floor.items()}
    asked = sizes.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("__q"), x.cast("long").alias("__at")) for c, x in want.items()])).alias("__w")).select(*[f"__k{k}" for k in range(len(by))], "__w.*")
    on = F.col("at") == F.col("__at")
    for k, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"__k{k}"))
    hits = d.join(asked, on)
    return hits.groupBy(*by).agg(*[F.max(F.when(F.col("__q") == c, F.col(value))).alias(c) for c in want])


def run_aggregate(results: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per run: counts, mean metrics over answerable questions, refusal over the others, cost, latency.

    results (run_id, type, error, degraded, cost, total_ms, refusal, metrics...); error rows are missing data."""
    ok = F.col("error").isNull()
    answerable, refused = ok & ~F.col("type").eqNullSafe("unanswerable"), ok & (F.col("type") == "unanswerable")
    pick = lambda q: F.coalesce(F.expr(f"percentile_disc({q}) within group (order by case when error is null then total_ms end)"), F.lit(0.0))
    return results.groupBy("run_id").agg(
        F.count("*").alias("questions"), F.count_if(~ok).alias("errors"), F.count_if(ok & F.col("degraded")).alias("degraded"),
        *[F.round(F.avg(F.when(answerable, F.col(m))), 6).alias(m) for m in metrics],
        F.round(F.avg(F.when(refused, F.col("refusal"))), 6).alias("refusal"),
        F.round(F.coalesce(F.sum(F.when(ok, F.col("cost"))), F.lit(0.0)), 4).alias("cost"),
        F.round(F.coalesce(F.try_divide(F.sum(F.when(ok, F.col("cost"))), F.count_if(ok)), F.lit(0.0)), 6).alias("cost_per_question"),
        pick(0.5).alias("p50"), pick(0.95).alias("p95"),
    )


def finite(x: Column) -> Column:
    """The number, or null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def paired(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b) where both runs (keys, value, error) have a finite value and no error."""
    fine = lambda r, n: r.where(F.col("error").isNull()).select(*keys, finite(F.col("value")).alias(n)).where(F.col(n).isNotNull())
    return fine(a, "a").join(fine(b, "b"), keys)


def resource_gate(before: DataFrame, after: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(metric, before, after, delta, failed, note): relative growth over the threshold; a zero baseline never fails."""
    j = thresholds.join(before.withColumnRenamed("value", "before"), "metric", "left").join(after.withColumnRenamed("value", "after"), "metric", "left")
    zero = F.col("before") == 0
    delta = F.when(zero & (F.col("after") == 0), 0.0).when(zero, float("inf")).otherwise(F.try_divide(F.col("after") - F.col("before"), F.col("before")))
    missing = F.col("before").isNull() | F.col("after").isNull()
    return j.select(
        "metric", "before", "after", F.when(~missing, F.round(delta, 6)).alias("delta"),
        F.when(missing | zero, False).otherwise(delta > F.col("threshold")).alias("failed"),
        F.when(missing, "missing").when(zero & (F.col("after") == 0), "both zero").when(zero, "baseline is zero").alias("note"),
    )


def lower_is_better(metric: Column) -> Column:
    return metric.isin("danglingCitations") | metric.rlike("(?i)cost|ms$")


def worst_regressions(pairs: DataFrame, limit: int) -> DataFrame:
    """Questions (id, metric, a = before, b = after) that got worse, worst first."""
    delta = F.when(lower_is_better(F.col("metric")), F.col("a") - F.col("b")).otherwise(F.col("b") - F.col("a"))
    return pairs.withColumn("delta", F.round(delta, 6)).where("delta < 0").orderBy("delta", "metric", "id").limit(limit)
