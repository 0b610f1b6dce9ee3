"""Queries of paired series, sweeps, diverse choices and leak-free splits, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import fnv1a
from ..operators import mining as C
from ..operators import series as O
from ..sources.tables import table
from .evaluation import imul
from .retrieval import CATALOG as RETRIEVAL
from .retrieval import chunks

ITERS = 300


def results(spark, sf_dir):
    """Events as results: a run per event type, a question per user; some fail, some lack a metric."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    r = e.groupBy(F.col("event_type").alias("run"), F.col("user_id").alias("id")).agg(
        F.round(F.avg(F.col("k") % 7) / 7, 9).alias("recall@5"), F.round(F.avg(F.col("k") % 3) / 3, 9).alias("recall@10"), F.count_if(F.col("k") % 5 == 0).cast("double").alias("danglingCitations"),
        F.round(F.sum("value") / 1000, 9).alias("costUsd"), F.round(F.max("value"), 9).alias("totalMs"),
    )
    names = ["recall@5", "recall@10", "danglingCitations", "costUsd", "totalMs"]
    m = r.unpivot(["run", "id"], names, "metric", "value")
    gone = (F.col("metric") == "recall@10") & (F.col("id") % 4 == 1)
    return m.withColumn("value", F.when(~gone, F.col("value"))).withColumn("error", F.when((F.col("id") + F.length("run")) % 11 == 0, "failed"))


def series_of(spark, sf_dir):
    r = results(spark, sf_dir)
    return O.paired_series(r.where("run = 'click'").drop("run"), r.where("run <> 'click'"))


def metric_series(spark, sf_dir):
    return O.series_report(series_of(spark, sf_dir))


def sweep_report(spark, sf_dir):
    return O.sweep(series_of(spark, sf_dir), iters=ITERS)


def sweep_of_metric(spark, sf_dir):
    return O.sweep(series_of(spark, sf_dir), "danglingCitations", iters=ITERS)


def diverse_pairs(spark, sf_dir):
    """The 50 most specific pairs, one per entity and per two documents."""
    tie = fnv1a(F.concat_ws("|", "entity", "pair"))
    return C.diverse_entity_pairs(chunks(spark, sf_dir), 0.15, [tie.alias("t"), F.col("a"), F.col("b")], 50).select("entity", "a", "b", "df", "tf", "score")


def split_items(spark, sf_dir):
    kind = F.when(F.col("role") == "user", "factoid").when(F.col("role") == "assistant", F.when(F.col("turn") > 2, "paraphrase").otherwise("factoid")).otherwise("aggregation")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("root"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), kind.alias("type")).distinct()


def holdout_split(spark, sf_dir):
    """A fifth of the questions of two types as holdout, drawn by conversations."""
    items = split_items(spark, sf_dir)
    sizes = {r["type"]: r["n"] for r in items.where("type <> 'aggregation'").groupBy("type").agg(F.count("*").alias("n")).collect()}  # two types
    quotas = {t: sizes.get(t, 0) // 5 for t in ("factoid", "paraphrase")}
    out, _ = O.leak_free_split(items, quotas, ["aggregation"], "paraphrase", F.md5(F.col("root").cast("string")), strict=False)
    return out.select("id", "type", "split")


RESULTS = """r AS (SELECT event_type AS run, user_id AS id, round(avg(k % 7) / 7, 9) AS r5, CASE WHEN user_id % 4 <> 1 THEN round(avg(k % 3) / 3, 9) END AS r10, CAST(count(CASE WHEN k % 5 = 0 THEN 1 END) AS DOUBLE) AS dc, round(sum(value) / 1000, 9) AS usd, round(max(value), 9) AS ms
    FROM (SELECT *, CAST(props ->> '$.k' AS INT) AS k FROM events) GROUP BY 1, 2),
l AS (SELECT run, id, 'recall@5' AS metric, 0 AS o, 'rate' AS kind, r5 AS value FROM r UNION ALL SELECT run, id, 'recall@10', 1, 'rate', r10 FROM r UNION ALL SELECT run, id, 'danglingCitations', 2, 'count', dc FROM r UNION ALL SELECT run, id, 'costUsd', 3, 'usd', usd FROM r UNION ALL SELECT run, id, 'totalMs', 4, 'ms', ms FROM r),
f AS (SELECT * FROM l WHERE (id + length(run)) % 11 <> 0 AND value IS NOT NULL),
p AS (SELECT y.run, y.metric, y.o, y.kind, y.id, x.value AS a, y.value AS b FROM f y JOIN f x ON x.id = y.id AND x.metric = y.metric AND x.run = 'click' AND y.run <> 'click')"""
SWEEP = f"""WITH {RESULTS}, v AS (SELECT run, metric, o, row_number() OVER (PARTITION BY run, metric ORDER BY id) - 1 AS r, b - a AS x FROM p), n AS (SELECT run, metric, count(*) AS n, avg(x) AS mean FROM v GROUP BY 1, 2),
s AS (SELECT DISTINCT n FROM n), k AS (SELECT i, j, n, (42 + (i * n + j + 1) * 1831565813) & 4294967295 AS a FROM s, range(0, {ITERS}) r(i), LATERAL (SELECT unnest(range(0, n)) AS j)),
k1 AS (SELECT i, j, n, {imul('xor(a, a >> 15)', 'a | 1')} AS t FROM k), k2 AS (SELECT i, j, n, xor(t, (t + {imul('xor(t, t >> 7)', 't | 61')}) & 4294967295) AS t FROM k1),
k3 AS (SELECT i, n, CAST(floor(xor(t, t >> 14) / 4294967296.0 * n) AS BIGINT) AS r FROM k2),
m AS (SELECT run, metric, i, round(sum(x) / any_value(n.n), 12) AS m FROM n JOIN k3 USING (n) JOIN v USING (run, metric, r) GROUP BY run, metric, i),
t AS (SELECT run, metric, quantile_disc(m, 0.025) AS lo, quantile_disc(m, 0.975) AS hi, least(1.0, 2 * least((count(CASE WHEN m <= 0 THEN 1 END) + 1) / {ITERS + 1}, (count(CASE WHEN m >= 0 THEN 1 END) + 1) / {ITERS + 1})) AS p FROM m GROUP BY 1, 2),
h AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY run) - row_number() OVER (PARTITION BY run ORDER BY p, metric) + 1) * round(p, 9)) AS scaled FROM t),
a AS (SELECT *, round(max(scaled) OVER (PARTITION BY run ORDER BY p, metric ROWS UNBOUNDED PRECEDING), 9) AS adjusted FROM h),
c AS (SELECT run, count(*) AS tests, count(CASE WHEN adjusted <= 0.05 THEN 1 END) AS survivors FROM a GROUP BY run)
SELECT c.run, tests, survivors, a.metric, round(n.mean, 9) AS delta, round(lo, 9) AS lo, round(hi, 9) AS hi, round(p, 9) AS p, adjusted, adjusted <= 0.05 AS reject FROM c JOIN a ON a.run = c.run AND a.metric = '{{metric}}' JOIN n ON n.run = a.run AND n.metric = a.metric"""
DIVERSE = """, w AS (SELECT *, a || '|' || b AS pair, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(entity || '|' || a || '|' || b, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: {fnv}) AS tie FROM q),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY score DESC, tie, a, b, entity, pair) AS place FROM w),
g AS (SELECT 0::BIGINT AS place, 0 AS n, []::VARCHAR[] AS es, []::VARCHAR[] AS ps UNION ALL
    SELECT min(o.place), any_value(n) + 1, list_append(any_value(es), arg_min(o.entity, o.place)), list_append(any_value(ps), arg_min(o.pair, o.place))
    FROM g, o WHERE n < 50 AND o.place > g.place AND NOT list_contains(es, o.entity) AND NOT list_contains(ps, o.pair) HAVING count(*) > 0)
SELECT entity, a, b, df, tf, score FROM o JOIN g USING (place)"""
SPLIT = """WITH RECURSIVE i AS (SELECT DISTINCT conv_id AS root, conv_id * 1000 + turn AS id, CASE WHEN role = 'user' THEN 'factoid' WHEN role = 'assistant' THEN CASE WHEN turn > 2 THEN 'paraphrase' ELSE 'factoid' END ELSE 'aggregation' END AS type FROM conversations),
q AS (SELECT count(CASE WHEN type = 'factoid' THEN 1 END) // 5 AS qf, count(CASE WHEN type = 'paraphrase' THEN 1 END) // 5 AS qp FROM i),
f AS (SELECT root, count(CASE WHEN type = 'factoid' THEN 1 END) AS cf, count(CASE WHEN type = 'paraphrase' THEN 1 END) AS cp FROM i GROUP BY root HAVING count(CASE WHEN type = 'aggregation' THEN 1 END) = 0),
o AS (SELECT *, row_number() OVER (ORDER BY cp = 0, md5(CAST(root AS VARCHAR)), root) AS place FROM f),
g AS (SELECT 0::BIGINT AS place, NULL::BIGINT AS root, false AS won, qf AS nf, qp AS np FROM q UNION ALL
    SELECT o.place, o.root, cf <= nf AND cp <= np, CASE WHEN cf <= nf AND cp <= np THEN nf - cf ELSE nf END, CASE WHEN cf <= nf AND cp <= np THEN np - cp ELSE np END FROM g JOIN o ON o.place = g.place + 1)
SELECT id, type, CASE WHEN g.won THEN 'holdout' ELSE 'dev' END AS split FROM i LEFT JOIN g USING (root)"""

_pairs = RETRIEVAL["cross_document_pairs"][1]

CATALOG = {
    "metric_series": (metric_series, f"WITH {RESULTS} SELECT run, row_number() OVER (PARTITION BY run ORDER BY o) AS place, metric, kind, kind = 'rate' AS higher_is_better, count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(b - a), 6) AS delta FROM p GROUP BY run, o, metric, kind"),
    "sweep_report": (sweep_report, SWEEP.format(metric="recall@10")),
    "sweep_of_metric": (sweep_of_metric, SWEEP.format(metric="danglingCitations")),
    "diverse_pairs": (diverse_pairs, f"WITH RECURSIVE q AS ({_pairs})" + DIVERSE.format(fnv=imul("xor(h, c)", "16777619::BIGINT"))),
    "holdout_split": (holdout_split, SPLIT),
}
