"""Report queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as R
from ..sources import run_store
from ..sources.tables import table


def results(spark, sf_dir):
    """labels as results: an error for every 11th document, quality as correctness (unknown for every 7th), toxic as hit."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "labels").select("doc_id", F.when(d % 11 == 0, F.lit("e")).alias("error"), F.when(d % 7 > 0, F.col("quality")).alias("correctness"), F.col("toxic").alias("hit"))


def stored_runs(spark, sf_dir):
    """(runs, results): orders as runs of forty variants, their lines as results, of which only returned ones have no error."""
    run_id = lambda c: F.md5(F.col(c).cast("string")).alias("run_id")
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), run_id("o_orderkey"), F.concat(F.lit("v"), (F.col("o_custkey") % 40).cast("string")).alias("variant"), F.col("o_orderdate").alias("started_at"))
    lines = table(spark, sf_dir, "lineitem").groupBy(run_id("l_orderkey"), F.col("l_linenumber").alias("question_id"))
    lines = lines.agg(F.when(F.count_if(F.col("l_returnflag") == "A") == 0, "e").alias("error"), F.sum("l_quantity").alias("score"))
    return runs.withColumn("file", F.concat(F.lit("runs/"), "run_id", F.lit(".jsonl"))), lines


def resolved_runs(spark, sf_dir):
    """Runs asked for by the beginning of an id, variant, file, whole id, or something that is none."""
    runs, lines = stored_runs(spark, sf_dir)
    k, ident = F.col("c_custkey"), F.md5(F.col("c_custkey").cast("string"))
    ref = F.when(k % 5 == 0, F.substring(ident, 1, 6)).when(k % 5 == 1, F.concat(F.lit("v"), (k % 60).cast("string"))).when(k % 5 == 2, F.concat(F.lit("kept/"), ident, F.lit(".jsonl"))).when(k % 5 == 3, ident).otherwise(F.concat(F.lit("w"), k.cast("string")))
    return run_store.resolved(table(spark, sf_dir, "customer").select(ref.alias("ref")), run_store.usable_runs(runs, lines))


def backfilled_results(spark, sf_dir):
    """A store of every run's first three questions, all with an error, after a backfill of the runs that have a good result."""
    runs, lines = stored_runs(spark, sf_dir)
    store = lines.where("question_id <= 3").withColumn("error", F.lit("old")).withColumn("score", F.lit(0.0))
    return run_store.backfilled(store, runs, lines)


def linked_items(spark, sf_dir):
    """Customers with links to others, some of which do not exist."""
    k = F.col("c_custkey")
    return run_store.parents_first(table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 3 > 0, k * 7 % 2000).alias("parent"), "c_nationkey"))


def failures(spark, sf_dir):
    return results(spark, sf_dir).select("doc_id", R.failed(F.col("error"), F.col("correctness"), F.col("hit")).alias("failed"))


def refusals(spark, sf_dir):
    """Turns as answers; some end in a refusal of one of its forms, some in what only resembles one."""
    k = (F.col("conv_id") * 8 + F.col("turn")) % 9
    said = F.when(k == 0, "That is NOT covered by these documents.").when(k == 1, "The text does not say.").when(k == 2, "They do not mention it").when(k == 3, "It does not matter.").otherwise("")
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count_if(R.refuses(F.concat_ws(" ", "text", said))).alias("refused"), F.count("*").alias("n"))


def remaining_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 9 > 0, F.col("embedding")))
    return e.groupBy("label").agg(F.count_if(F.col("embedding").isNull()).alias("remaining"))


def superset(spark, sf_dir):
    tags = lambda c, *ms: F.array(*[F.concat(F.lit("t"), (F.col(c) % m).cast("string")) for m in ms])
    return table(spark, sf_dir, "customer").where(R.covers(tags("c_custkey", 5, 7, 11), tags("c_nationkey", 3, 2))).select("c_custkey")


def stale_window(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return R.recent(e, "ts", F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"), 5).groupBy("event_type").agg(F.count("*").alias("n"))


def by_question_type(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 4).alias("quality"), F.round(F.avg("toxic"), 4).alias("toxic"))


def memberships(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array("o_orderpriority", "o_orderstatus").alias("tags"))
    groups = items.sparkSession.createDataFrame([("urgent", "1-URGENT"), ("urgent", "2-HIGH"), ("open", "O"), ("open", "P"), ("urgent", "P")], "group string, tag string")
    return R.memberships(items, groups)


def captured(spark, sf_dir):
    return R.captured_counts(table(spark, sf_dir, "pages"), "url", "https?://([^/]+)")


def split_rates(spark, sf_dir):
    d = table(spark, sf_dir, "labels").select(F.when(F.col("doc_id") % 4 == 0, "holdout").otherwise("dev").alias("split"), F.col("quality").alias("first"), (1 - F.col("toxic")).alias("second"))
    return R.split_rates(d, 0.8, 0.7)


def daily_usage(spark, sf_dir):
    return R.usage(table(spark, sf_dir, "events"), "ts", "event_type", 7).withColumn("day", F.col("day").cast("string"))


def fixed_groups(spark, sf_dir):
    d = R.fixed_groups(table(spark, sf_dir, "lineitem"), "l_suppkey", ["l_orderkey", "l_linenumber"], 10)
    return d.groupBy("l_suppkey", "batch").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_order"))


def streaks(spark, sf_dir):
    last = F.lit("2024-01-15").cast("date")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min(F.to_date("ts")).alias("start")).select("user_id", R.streak_day(F.col("start"), last).cast("long").alias("day"))


def latest_runs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return R.latest_finished(o.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("finished")))


def flagged_last(spark, sf_dir):
    return R.flagged_last(table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("suspect")), "suspect", "doc_id")


def group_ranking(spark, sf_dir):
    tag = lambda c, m: F.concat(F.lit(f"m{m}-"), (F.col(c) % m).cast("string"))
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query"), F.array(tag("c_custkey", 3), tag("c_custkey", 7)).alias("tags"))
    people = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.array(tag("n_nationkey", 3), tag("n_nationkey", 7)).alias("tags"), (F.col("n_regionkey") == 1).cast("int").alias("preferred"), F.col("n_nationkey").alias("seq"))
    return R.group_ranking(asked, people)


def shared_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").intersect(table(spark, sf_dir, "labels").select("doc_id"))


def numerals(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 999 + 1).cast("int").alias("n"))
    r = R.roman(F.col("n"))
    return p.select("p_partkey", r.alias("numeral"), R.from_roman(r).alias("back"), R.from_roman(F.lower(r)).alias("not_canonical"))


def markers(spark, sf_dir):
    """Signed differences per supplier with a normal interval; the marker by interval and a stand-in p value."""
    moved = F.col("l_quantity") - 25.5 + F.col("l_suppkey") % 13 * 0.5 - 3
    s = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg(moved), 9).alias("m"), F.count("*").alias("n"))
    half, p = 28 / F.sqrt("n"), F.exp(-F.col("m") * F.col("m") * F.col("n") / 400)
    return s.select("l_suppkey", R.significance(F.col("m") - half, F.col("m") + half, p).alias("marker"))


T = lambda c, m: f"'m{m}-' || {c} % {m}"
NUMERAL = "repeat('C', CAST(n // 100 AS INT)) || " + " || ".join(f"({names!r})[CAST(n // {d} AS INT) % 10 + 1]" for names, d in ((R.TENS, 10), (R.ONES, 1)))

CATALOG = {
    "failures": (failures, "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN true WHEN doc_id % 7 > 0 AND quality IS NOT NULL THEN quality < 1 WHEN toxic IS NOT NULL THEN toxic = 0 ELSE false END AS failed FROM labels"),
    "refusals": (refusals, "SELECT role, count(CASE WHEN (conv_id * 8 + turn) % 9 <= 2 OR regexp_matches(text, '(?i)not covered by these documents|do(es)? not (contain|say|mention)') THEN 1 END) AS refused, count(*) AS n FROM conversations GROUP BY 1"),
    "remaining_vectors": (remaining_vectors, "SELECT label, count(CASE WHEN embedding IS NULL OR vec_id % 9 = 0 THEN 1 END) AS remaining FROM embeddings GROUP BY 1"),
    "superset": (superset, "SELECT c_custkey FROM customer WHERE c_nationkey % 3 IN (c_custkey % 5, c_custkey % 7, c_custkey % 11) AND c_nationkey % 2 IN (c_custkey % 5, c_custkey % 7, c_custkey % 11)"),
    "stale_window": (stale_window, "SELECT event_type, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-15 12:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1"),
    "by_question_type": (by_question_type, "SELECT lang, count(*) AS n, round(avg(quality), 4) AS quality, round(avg(toxic), 4) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY 1"),
    "memberships": (memberships, "SELECT 'urgent' AS \"group\", count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_orderstatus = 'P' HAVING count(*) > 0 UNION ALL SELECT 'open', count(*) FROM orders WHERE o_orderstatus IN ('O', 'P') HAVING count(*) > 0"),
    "captured_counts": (captured, "SELECT regexp_extract(url, 'https?://([^/]+)', 1) AS found, count(*) AS n FROM pages WHERE regexp_matches(url, 'https?://([^/]+)') GROUP BY 1"),
    "split_rates": (split_rates, "SELECT split, n, round(f, 6) AS first, round(s, 6) AS second, f >= 0.8 AND s >= 0.7 AS passed FROM (SELECT CASE WHEN doc_id % 4 = 0 THEN 'holdout' ELSE 'dev' END AS split, count(*) AS n, avg(quality) AS f, avg(1 - toxic) AS s FROM labels GROUP BY 1)"),
    "daily_usage": (daily_usage, "WITH e AS (SELECT CAST(ts AS DATE) AS day, event_type AS provider, count(*) AS n FROM events GROUP BY 1, 2) SELECT CAST(day AS VARCHAR) AS day, provider, n FROM e WHERE day >= (SELECT max(day) FROM e) - 7"),
    "fixed_groups": (fixed_groups, "WITH k AS (SELECT *, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1) // 10 AS batch FROM lineitem) SELECT l_suppkey, batch, count(*) AS n, min(l_orderkey) AS first_order FROM k GROUP BY 1, 2"),
    "streaks": (streaks, "SELECT user_id, greatest(1, DATE '2024-01-15' - CAST(min(ts) AS DATE) + 1) AS day FROM events GROUP BY 1"),
    "resolved_runs": (resolved_runs, """WITH r AS (SELECT o_orderkey AS pos, md5(CAST(o_orderkey AS VARCHAR)) AS run_id, 'v' || o_custkey % 40 AS variant, o_orderdate AS s, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') AS u FROM orders),
a AS (SELECT DISTINCT CASE c_custkey % 5 WHEN 0 THEN left(m, 6) WHEN 1 THEN 'v' || c_custkey % 60 WHEN 2 THEN 'kept/' || m || '.jsonl' WHEN 3 THEN m ELSE 'w' || c_custkey END AS ref FROM (SELECT c_custkey, md5(CAST(c_custkey AS VARCHAR)) AS m FROM customer)),
h AS (SELECT ref, pos AS o, run_id, u FROM a JOIN r ON ref = 'kept/' || run_id || '.jsonl' UNION ALL SELECT ref, pos, run_id, u FROM a JOIN r ON ref = left(run_id, 6) UNION ALL SELECT ref, pos, run_id, u FROM a JOIN r ON ref = run_id
    UNION ALL SELECT ref, row_number() OVER (PARTITION BY ref ORDER BY s DESC, pos), run_id, u FROM a JOIN r ON ref = variant WHERE u),
b AS (SELECT ref, arg_min(run_id, o) AS run_id, arg_min(u, o) AS u FROM h GROUP BY ref)
SELECT a.ref, run_id, CASE WHEN run_id IS NULL THEN 'unknown' WHEN NOT u THEN 'unusable' END AS problem FROM a LEFT JOIN b USING (ref)"""),
    "backfilled_results": (backfilled_results, """WITH g AS (SELECT l_orderkey, bool_or(l_returnflag = 'A') AS good FROM lineitem GROUP BY 1)
SELECT md5(CAST(l_orderkey AS VARCHAR)) AS run_id, l_linenumber AS question_id, CASE WHEN NOT good THEN 'old' WHEN NOT bool_or(l_returnflag = 'A') THEN 'e' END AS error, CASE WHEN good THEN sum(l_quantity) ELSE 0 END AS score
FROM lineitem JOIN g USING (l_orderkey) WHERE good OR l_linenumber <= 3 GROUP BY l_orderkey, l_linenumber, good"""),
    "linked_items": (linked_items, "SELECT c.c_custkey AS id, p.c_custkey AS parent, c.c_nationkey, CASE WHEN p.c_custkey IS NULL THEN 0 ELSE 1 END AS wave FROM customer c LEFT JOIN customer p ON c.c_custkey % 3 > 0 AND p.c_custkey = c.c_custkey * 7 % 2000"),
    "latest_runs": (latest_runs, "SELECT o_orderkey AS run_id, o_orderdate AS started, o_orderdate AS finished FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100"),
    "flagged_last": (flagged_last, "SELECT doc_id, toxic = 1 AS suspect, row_number() OVER (ORDER BY coalesce(toxic = 1, false), doc_id) AS place FROM labels"),
    "group_ranking": (group_ranking, f"WITH a AS (SELECT c_custkey AS query, unnest([{T('c_custkey', 3)}, {T('c_custkey', 7)}]) AS tag FROM customer), p AS (SELECT n_nationkey AS id, n_regionkey = 1 AS f, unnest([{T('n_nationkey', 3)}, {T('n_nationkey', 7)}]) AS tag FROM nation), m AS (SELECT query, id, f, count(*) AS matched FROM a JOIN p USING (tag) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY matched DESC, f DESC, id) AS place FROM m) SELECT query, id, matched, place, place <= 7 AS in_walk FROM r"),
    "shared_keys": (shared_keys, "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels"),
    "numerals": (numerals, f"SELECT p_partkey, {NUMERAL} AS numeral, CAST(n AS INT) AS back, CAST(NULL AS INT) AS not_canonical FROM (SELECT p_partkey, p_partkey % 999 + 1 AS n FROM part)"),
    "markers": (markers, "WITH s AS (SELECT l_suppkey, round(avg(l_quantity - 25.5 + l_suppkey % 13 * 0.5 - 3), 9) AS m, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_suppkey, CASE WHEN m - 28 / sqrt(n) <= 0 AND m + 28 / sqrt(n) >= 0 THEN 'ns' WHEN exp(-m * m * n / 400) < 0.001 THEN '***' WHEN exp(-m * m * n / 400) < 0.01 THEN '**' ELSE '*' END AS marker FROM s"),
}
