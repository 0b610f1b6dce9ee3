"""Statistics, ingestion, text, calendar and event queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as X
from ..operators import ingest as I
from ..operators import metrics as M
from ..operators import stats as P
from ..sources import tables as S
from ..sources.tables import table
from ..streaming import state as R


def raters(spark, sf_dir):
    """Labels as paired outcomes in order of doc_id: a is quality, b is toxic."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pos"), F.col("quality").cast("double").alias("a"), F.col("toxic").cast("double").alias("b"))


#: Draw k of the seeded stream in SQL, and the resampled means of values x (n of them, numbered from 0).
def imul(a: str, b: str) -> str:
    return f"(((({a}) & 65535) * ({b}) + (((({a}) >> 16) * ({b}) & 65535) << 16)) & 4294967295)"


def draws_sql(iters: int, seed: int) -> str:
    return f"""n AS (SELECT count(*) AS n FROM v), k AS (SELECT i, j, n, ({seed} + (i * n + j + 1) * 1831565813) & 4294967295 AS a FROM n, range(0, {iters}) r(i), range(0, n) s(j)),
k1 AS (SELECT i, j, n, {imul('xor(a, a >> 15)', 'a | 1')} AS t FROM k),
k2 AS (SELECT i, j, n, xor(t, (t + {imul('xor(t, t >> 7)', 't | 61')}) & 4294967295) AS t FROM k1),
k3 AS (SELECT i, n, CAST(floor(xor(t, t >> 14) / 4294967296.0 * n) AS BIGINT) AS p FROM k2),
m AS (SELECT i, sum(x) / any_value(n) AS m FROM k3 JOIN v ON v.r = k3.p GROUP BY i)"""


V = "v AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS r, CAST({x} AS DOUBLE) AS x FROM labels)"


def bootstrap_ci(spark, sf_dir):
    return P.bootstrap_ci(raters(spark, sf_dir).select("pos", F.col("a").alias("x")), 2000)


def paired_bootstrap(spark, sf_dir):
    return P.paired_bootstrap(raters(spark, sf_dir), 2000)


def prng_stream(spark, sf_dir):
    return P.prng(spark, 42, 1000)


def mcnemar(spark, sf_dir):
    return P.mcnemar(raters(spark, sf_dir).select((F.col("a") == 1).alias("a"), (F.col("b") == 1).alias("b")))


def kappa(spark, sf_dir):
    return P.kappa(raters(spark, sf_dir).select("a", "b"))


def holm(spark, sf_dir):
    """One test per return flag and ship mode stand-in: share of discounts above 5 %, as a p-value-like number."""
    t = table(spark, sf_dir, "lineitem").groupBy(F.concat("l_returnflag", F.lit("-"), F.col("l_linenumber").cast("string")).alias("test")).agg(F.round(F.avg(F.when(F.col("l_discount") > 0.05, 1.0).otherwise(0.0)) / 20, 6).alias("p"))
    return P.holm(t)


def min_detectable(spark, sf_dir):
    r = raters(spark, sf_dir).agg(F.count("*").alias("n"), F.avg("a").alias("rate"), F.coalesce(F.corr("a", "b"), F.lit(0.0)).alias("correlation"))
    return P.min_detectable(r)


def pearson(spark, sf_dir):
    """Correlation of quantity and price per return flag; 0 where one is constant."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.coalesce(F.corr("l_quantity", "l_extendedprice"), F.lit(0.0)), 6).alias("r"))


def percentiles(spark, sf_dir):
    """Both quantile rules side by side per order status."""
    return M.ranks(table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_totalprice", {"p50": 0.5, "p95": 0.95}, {"f50": 0.5, "f95": 0.95})


def results(spark, sf_dir):
    """Events as run results: a run per event type, k cycles through errors, degraded and unanswerable questions."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("run_id"), "event_id", F.when(k % 10 == 0, "unanswerable").otherwise("factoid").alias("type"), F.when(k % 13 == 0, "failed").alias("error"),
        (k % 7 == 0).alias("degraded"), (F.col("value") / 1000).alias("cost"), F.col("value").alias("total_ms"), (k % 2).cast("double").alias("refusal"),
        F.when(k % 3 > 0, k / 100.0).alias("recall"), F.when(k % 5 > 0, F.col("value")).alias("ndcg"),
    )


RESULTS = """r AS (SELECT event_type AS run_id, event_id, k % 10 = 0 AS un, k % 13 = 0 AS err, k % 7 = 0 AS degraded, value / 1000 AS cost, value, k % 2 AS refusal, CASE WHEN k % 3 > 0 THEN k / 100.0 END AS recall, CASE WHEN k % 5 > 0 THEN value END AS ndcg
FROM (SELECT *, CAST(props ->> '$.k' AS INT) AS k FROM events))"""


def run_aggregate(spark, sf_dir):
    return M.run_aggregate(results(spark, sf_dir), ["recall", "ndcg"])


def runs_of(spark, sf_dir):
    """Two runs on one set of questions: users' days; a clicks, b views, in mean value."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    run = lambda t: e.where(F.col("event_type") == t).groupBy("user_id", "day").agg(F.avg("value").alias("value")).withColumn("error", F.when(F.col("user_id") % 11 == 0, "failed"))
    return run("click"), run("view")


def run_compare(spark, sf_dir):
    p = M.paired(*runs_of(spark, sf_dir), ["user_id", "day"])
    return p.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("a"), 6).alias("mean_a"), F.round(F.avg("b"), 6).alias("mean_b"), F.round(F.avg(F.col("a") - F.col("b")), 6).alias("delta"))


def worst_regressions(spark, sf_dir):
    p = M.paired(*runs_of(spark, sf_dir), ["user_id", "day"])
    rows = p.select(F.concat_ws("/", F.col("user_id").cast("string"), F.col("day").cast("string")).alias("id"), F.lit("recall").alias("metric"), F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))
    return M.worst_regressions(rows, 20)


def resource_gate(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("late", F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz"))
    part = lambda late: e.where(F.col("late") == late).groupBy(F.col("event_type").alias("metric")).agg(F.round(F.sum("value"), 4).alias("value"))
    return M.resource_gate(part(False), part(True), e.select(F.col("event_type").alias("metric"), F.lit(0.01).alias("threshold")).distinct())


def quality_gate(spark, sf_dir):
    """Fails where quality falls behind toxic by over 0.05 with a confidence interval without zero."""
    r = P.paired_bootstrap(raters(spark, sf_dir), 1000)
    past = F.col("mean_diff") < -0.05
    return r.select("n", "mean_diff", "lo", "hi", (past & ((F.col("lo") > 0) | (F.col("hi") < 0))).alias("failed"))


def kept_pages(spark, sf_dir):
    kept, skipped = S.pages(table(spark, sf_dir, "documents"))
    return kept.groupBy("doc_id").agg(F.count("*").alias("kept"), F.sum(X.count_tokens(F.col("page_text"))).alias("tokens")).join(skipped.groupBy("doc_id").agg(F.count("*").alias("skipped")), "doc_id", "left").withColumn("skipped", F.coalesce("skipped", F.lit(0)))


def page_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "page_text"))


def chunk_pages(spark, sf_dir):
    """Chunks of whole documents as pages, 200 tokens with 15 % overlap."""
    return I.chunk_pages(table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), F.col("text").alias("page_text")), 200)


def conversation_pages(spark, sf_dir):
    """Turns as pages of lines, each with a running footer of its conversation."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.concat("text", F.lit("\nPage "), F.col("turn").cast("string"), F.lit("\nrunning head")).alias("page_text"))


def strip_repeated_lines(spark, sf_dir):
    return I.strip_repeated_lines(conversation_pages(spark, sf_dir))


def source_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", X.count_tokens(F.col("text")).alias("t"))
    return d.groupBy("source").agg(F.count("*").alias("documents"), F.sum("t").alias("tokens"), F.round(F.avg("t"), 6).alias("mean_tokens"), F.max("t").alias("most"))


def line_shapes(spark, sf_dir):
    return I.line_shapes(page_lines(spark, sf_dir).select(F.col("page_text").alias("line")))


def ingest_plan(spark, sf_dir):
    """Documents as expected chunks; stored ones miss some ids, hold changed texts, missing vectors and other tags."""
    d = table(spark, sf_dir, "documents")
    tags = lambda a, b: F.array(F.col(a), F.col(b))
    expected = d.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("key"), F.md5("text").alias("digest"), tags("lang", "source").alias("tags"))
    stored = d.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("key"), F.md5(F.when(F.col("doc_id") % 11 == 0, F.upper("text")).otherwise(F.col("text"))).alias("digest"), (F.col("doc_id") % 13 != 0).alias("embedded"), F.when(F.col("doc_id") % 17 == 0, F.array("lang")).otherwise(tags("source", "lang")).alias("tags"))
    return I.ingest_plan(expected, stored)


def chunk_state(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"), (F.col("doc_id") % 13 != 0).alias("embedded"))


def upsert_latest(spark, sf_dir):
    return S.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], ["ts", "event_id"])


def sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence"))


def citations(spark, sf_dir):
    """Answers with markers after the first and the last sentence; markers beyond five hits dangle."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    marked = F.concat(F.col("text"), F.lit(" See [1][2]. And [") , (F.col("turn") + 3).cast("string"), F.lit("] also."))
    found = c.select("conv_id", "turn", F.posexplode(X.citations(marked)).alias("pos", "c")).select("conv_id", "turn", "pos", "c.marker", "c.sentence")
    return found.withColumn("dangling", ~F.col("marker").between(1, 5))


def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.html_to_plain(F.col("html")).alias("plain"))


def url_slugs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.slug(F.col("url")).alias("slug"))


def scripts(spark, sf_dir):
    """Majority script of every text, after folding homophones."""
    return table(spark, sf_dir, "documents").select("doc_id", X.text_script(X.fold_ethiopic(F.concat("text", F.when(F.col("doc_id") % 9 == 0, F.repeat(F.lit("ሠሐ"), 9000)).otherwise("")))).alias("script"), F.round(X.letter_ratio(F.col("text")), 6).alias("letters"))


def parsed_refs(spark, sf_dir):
    """Line items as references to spans of verses."""
    ref = lambda n: F.concat(F.lit("Order "), F.col("l_orderkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string"), F.lit("-"), (F.col("l_linenumber") + n).cast("string"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("Order "), F.col("l_orderkey").cast("string"))).otherwise(ref(2)).alias("ref"))
    return li.withColumn("p", X.parse_ref(F.col("ref"))).select("l_orderkey", "l_linenumber", "p.*")


def overlapping_spans(spark, sf_dir):
    """Shipping windows of line items that overlap an order's fortnight: an interval join within the order."""
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("timestamp_ntz"))
    spans = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("book"), day("l_shipdate").alias("s"), (day("l_shipdate") + 3).alias("e"))
    passages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("book"), (day("o_orderdate") + 30).alias("s"), (day("o_orderdate") + 44).alias("e"))
    return I.overlapping(spans, passages)


def ethiopian_calendar(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(N.addis_day(F.col("o_orderdate")).alias("epoch")).distinct()
    return days.select("epoch", N.church_day(F.col("epoch")).alias("c")).select("epoch", "c.*")


def daily_counts(spark, sf_dir):
    return R.daily_counts(table(spark, sf_dir, "events").withColumnRenamed("event_type", "name"))


def feedback_by_figure(spark, sf_dir):
    """Events as feedback on the figures that k names: helpful where value is above 50."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events").select(F.explode(F.array((k % 10), (k % 7) + 10)).alias("figure"), (F.col("value") > 50).alias("helpful"))
    return e.groupBy("figure").agg(F.count_if("helpful").alias("yes"), F.count_if(~F.col("helpful")).alias("no"), F.round(100.0 * F.count_if("helpful") / F.count("*")).cast("int").alias("percent"))


def recent_days(spark, sf_dir):
    """The last 14 days of each user up to the last day of all, with a flag for days with a purchase."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    last = e.agg(F.max("day").alias("last"))
    grid = e.select("user_id").distinct().join(F.broadcast(last), F.lit(True)).select("user_id", F.explode(F.sequence(F.date_sub("last", 13), F.col("last"))).alias("day"))
    done = e.where("event_type = 'purchase'").select("user_id", "day").distinct().withColumn("on", F.lit(True))
    return grid.join(done, ["user_id", "day"], "left").select("user_id", F.col("day").cast("string").alias("day"), F.coalesce("on", F.lit(False)).alias("marked"))


def daily_claims(spark, sf_dir):
    return R.claims(table(spark, sf_dir, "events").withColumn("day", F.to_date("ts").cast("string")), ["user_id", "day"])


def sliding_limiter(spark, sf_dir):
    """Two events per user in six hours."""
    return R.limit_events(table(spark, sf_dir, "events").withColumnRenamed("user_id", "key"), 2, 21_600.0)


def cost_rollup(spark, sf_dir):
    """Quantities priced by a table of prices per return flag; a flag without a price costs nothing."""
    prices = spark.createDataFrame([("A", 0.5), ("R", 0.25)], "flag string, usd double")
    li = table(spark, sf_dir, "lineitem")
    priced = li.join(F.broadcast(prices), li["l_returnflag"] == prices["flag"], "left")  # a fixed table
    return priced.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum(F.col("l_quantity") * F.coalesce("usd", F.lit(0.0))), 4).alias("usd"), F.sum("l_quantity").alias("units"))


def fixed_order(spark, sf_dir):
    """Customers in an order that follows no name: the tie hash of their id."""
    return table(spark, sf_dir, "customer").select("c_custkey", N.fnv1a(F.concat(F.lit("customer|"), F.col("c_custkey").cast("string"))).alias("h"))


def share_vs_target(spark, sf_dir):
    """Languages against target shares: relative deviation and whether it is within a quarter."""
    goal = spark.createDataFrame([("en", 0.55), ("fr", 0.15), ("de", 0.15), ("es", 0.15)], "lang string, target double")
    d = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    total = d.agg(F.sum("n").alias("total"))
    j = goal.join(d, "lang", "left").join(total, F.lit(True)).withColumn("share", F.coalesce("n", F.lit(0)) / F.col("total"))
    off = F.col("share") / F.col("target") - 1
    return j.select("lang", F.round("share", 6).alias("share"), F.round(off, 6).alias("deviation"), (F.abs(off) <= 0.25).alias("ok"))


def data_rules(spark, sf_dir):
    """Violations (rule, key) of keys, ranges and references."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rule = lambda df, name, key: df.select(F.lit(name).alias("rule"), F.col(key).cast("long").alias("key"))
    twice = o.groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 25")
    out = rule(twice, "over 25 orders", "o_custkey")
    out = out.unionByName(rule(o.where("o_totalprice > 400000"), "price", "o_orderkey"))
    out = out.unionByName(rule(o.where(~F.col("o_orderstatus").isin("O", "F")), "status", "o_orderkey"))
    return out.unionByName(rule(c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti"), "no orders", "c_custkey"))


def cache_misses(spark, sf_dir):
    """Distinct texts still to compute when every document divisible by 3 has left its result in the cache."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    cache = d.where("doc_id % 3 = 0").select("key").distinct().withColumn("value", F.lit(1))
    _, misses = S.with_cache(d, cache)
    return misses.groupBy("key").agg(F.min("doc_id").alias("doc_id"))


def json_rows(spark, sf_dir):
    """Event properties as JSON lines, read with a schema."""
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int").alias("p")).groupBy("p.k").agg(F.count("*").alias("n"))


CHURCH = """WITH d AS (SELECT DISTINCT CAST(floor((epoch(o_orderdate) + 10800) / 86400) AS BIGINT) AS epoch FROM orders),
e AS (SELECT epoch, epoch + 716732 AS dd, DATE '1970-01-01' + CAST(epoch AS INT) AS g FROM d),
f AS (SELECT *, dd % 1461 AS r, (dd % 1461) // 1460 AS leap, year(g) AS gy, month(g) = 1 AND day(g) = 7 AS genna FROM e),
h AS (SELECT *, r % 365 + 365 * leap AS nn, (19 * (gy % 19) + 15) % 30 AS moon FROM f),
i AS (SELECT *, 4 * (dd // 1461) + r // 365 - leap AS year, nn // 30 + 1 AS month, nn % 30 + 1 AS day, moon + (2 * (gy % 4) + 4 * (gy % 7) - moon + 34) % 7 + 114 AS en FROM h),
j AS (SELECT *, epoch - (datediff('day', DATE '1970-01-01', make_date(gy, en // 31, en % 31 + 1)) + gy // 100 - gy // 400 - 2) AS af, (epoch + 4) % 7 AS weekday FROM i),
k AS (SELECT *, CASE WHEN month = 1 AND day = 1 THEN 'enkutatash' WHEN month = 1 AND day = 17 THEN 'meskel' WHEN genna THEN 'genna' WHEN month = 5 AND day = 10 THEN 'gehad' WHEN month = 5 AND day = 11 THEN 'timket'
    WHEN month = 12 AND day = 13 THEN 'debre_tabor' WHEN month = 12 AND day = 16 THEN 'filseta' WHEN af = -7 THEN 'hosanna' WHEN af = -2 THEN 'siklet' WHEN af = 0 THEN 'fasika' WHEN af = 39 THEN 'erget' WHEN af = 49 THEN 'paraclete' END AS feast FROM j),
l AS (SELECT *, CASE WHEN af BETWEEN -69 AND -67 THEN 'nineveh' WHEN af BETWEEN -55 AND -1 THEN 'hudade' WHEN af >= 50 AND month >= 9 AND (month < 11 OR (month = 11 AND day <= 4)) THEN 'hawaryat'
    WHEN (month = 3 AND day >= 15) OR (month = 4 AND day <= 28 AND NOT genna) THEN 'nebiyat' WHEN month = 12 AND day <= 15 THEN 'filseta' WHEN feast = 'gehad' THEN 'gehad'
    WHEN NOT af BETWEEN 0 AND 49 AND feast IS NULL AND weekday = 3 THEN 'wednesday' WHEN NOT af BETWEEN 0 AND 49 AND feast IS NULL AND weekday = 5 THEN 'friday' END AS fast FROM k)
SELECT epoch, year, month, day, weekday, feast, CASE WHEN month <= 12 THEN CASE day """ + " ".join(f"WHEN {k} THEN '{v}'" for k, v in N.MONTHLY.items()) + """ END END AS monthly, fast, CASE WHEN fast = 'hudade' THEN af + 56 END AS lent_day FROM l"""
HTML = r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis'),
    '<br\s*/?>|</p>|</div>|</li>', ' ', 'gi'), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS plain FROM pages"""
PAIRED = """e AS (SELECT *, CAST(ts AS DATE) AS day FROM events), a AS (SELECT user_id, day, avg(value) AS a FROM e WHERE event_type = 'click' AND user_id % 11 <> 0 GROUP BY ALL),
b AS (SELECT user_id, day, avg(value) AS b FROM e WHERE event_type = 'view' AND user_id % 11 <> 0 GROUP BY ALL), p AS (SELECT * FROM a JOIN b USING (user_id, day))"""
PAIR_SQL = f"""WITH {V.format(x='quality - toxic')}, {{draws}}
SELECT n, {{more}} round((SELECT avg(x) FROM v), 9) AS mean_diff, round(quantile_disc(m, 0.025), 9) AS lo, round(quantile_disc(m, 0.975), 9) AS hi{{p}} FROM m, n GROUP BY n"""
Z = {p: P.z_quantile(p) for p in (0.975, 0.8)}

CATALOG = {
    "bootstrap_ci": (bootstrap_ci, f"WITH {V.format(x='quality')}, {draws_sql(2000, 42)} SELECT n, round((SELECT avg(x) FROM v), 9) AS mean, round(quantile_disc(m, 0.025), 9) AS lo, round(quantile_disc(m, 0.975), 9) AS hi FROM m, n GROUP BY n"),
    "paired_bootstrap": (paired_bootstrap, PAIR_SQL.format(draws=draws_sql(2000, 42), more="(SELECT count(*) FROM v WHERE x <> 0) AS discordant,", p=", round(least(1.0, 2 * least((count(CASE WHEN m <= 0 THEN 1 END) + 1) / 2001, (count(CASE WHEN m >= 0 THEN 1 END) + 1) / 2001)), 9) AS p_value")),
    "quality_gate": (quality_gate, "WITH q AS (" + PAIR_SQL.format(draws=draws_sql(1000, 42), more="", p="") + ") SELECT *, mean_diff < -0.05 AND (lo > 0 OR hi < 0) AS failed FROM q"),
    "prng_stream": (prng_stream, f"WITH k AS (SELECT k, (42 + (k + 1) * 1831565813) & 4294967295 AS a FROM range(0, 1000) r(k)), k1 AS (SELECT k, {imul('xor(a, a >> 15)', 'a | 1')} AS t FROM k), k2 AS (SELECT k, xor(t, (t + {imul('xor(t, t >> 7)', 't | 61')}) & 4294967295) AS t FROM k1) SELECT k, xor(t, t >> 14) / 4294967296.0 AS x FROM k2"),
    "mcnemar": (mcnemar, "WITH c AS (SELECT count(CASE WHEN quality = 1 AND toxic <> 1 THEN 1 END) AS b01, count(CASE WHEN quality <> 1 AND toxic = 1 THEN 1 END) AS b10 FROM labels), d AS (SELECT *, b01 + b10 AS n FROM c) SELECT b01, b10, n, round(CASE WHEN n = 0 THEN 0 ELSE pow(abs(b01 - b10) - 1, 2) / n END, 9) AS statistic, CASE WHEN n = 0 THEN 1.0 ELSE round(least(1.0, 2 * list_sum(list_transform(range(0, least(b01, b10) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))))), 9) END AS p_value FROM d"),
    "kappa": (kappa, "WITH c AS (SELECT quality AS a, toxic AS b, count(*) AS c FROM labels GROUP BY ALL), t AS (SELECT CAST(sum(c) AS BIGINT) AS n, sum(CASE WHEN a = b THEN c ELSE 0 END) AS same FROM c), e AS (SELECT coalesce(sum(ca * cb), 0) AS e FROM (SELECT a, sum(c) AS ca FROM c GROUP BY a) JOIN (SELECT b AS a, sum(c) AS cb FROM c GROUP BY b) USING (a)), k AS (SELECT n, same / CAST(n AS DOUBLE) AS o, e / (CAST(n AS DOUBLE) * n) AS e FROM t, e) SELECT n, round(o, 9) AS agreement, round(CASE WHEN e = 1 THEN CASE WHEN o = 1 THEN 1 ELSE 0 END ELSE (o - e) / (1 - e) END, 9) AS kappa, CASE WHEN e = 1 THEN CASE WHEN o = 1 THEN 1 ELSE 0 END ELSE (o - e) / (1 - e) END < 0.6 AS weak FROM k"),
    "holm": (holm, "WITH t AS (SELECT l_returnflag || '-' || l_linenumber AS test, round(avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END) / 20, 6) AS p FROM lineitem GROUP BY 1), s AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, test) + 1) * p) AS scaled FROM t), a AS (SELECT test, p, round(max(scaled) OVER (ORDER BY p, test), 9) AS adjusted FROM s) SELECT test, round(p, 9) AS p, adjusted, adjusted <= 0.05 AS reject FROM a"),
    "min_detectable": (min_detectable, f"WITH r AS (SELECT count(*) AS n, avg(quality) AS rate, coalesce(corr(quality, toxic), 0) AS c FROM labels) SELECT n, round(rate, 9) AS rate, round({Z[0.975]} * sqrt(rate * (1 - rate) / n), 6) AS half_width, round({Z[0.975] + Z[0.8]} * sqrt(2 * rate * (1 - rate) / n), 6) AS unpaired, round({Z[0.975] + Z[0.8]} * sqrt(2 * rate * (1 - rate) * (1 - c) / n), 6) AS paired FROM r"),
    "pearson": (pearson, "SELECT l_returnflag, round(coalesce(corr(l_quantity, l_extendedprice), 0), 6) AS r FROM lineitem GROUP BY 1"),
    "percentiles": (percentiles, "WITH s AS (SELECT o_orderstatus, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) SELECT o_orderstatus, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.95) AS p95, max(CASE WHEN i = least(n - 1, floor(0.5 * n)) THEN v END) AS f50, max(CASE WHEN i = least(n - 1, floor(0.95 * n)) THEN v END) AS f95 FROM s GROUP BY 1"),
    "run_aggregate": (run_aggregate, f"WITH {RESULTS} SELECT run_id, count(*) AS questions, count(CASE WHEN err THEN 1 END) AS errors, count(CASE WHEN NOT err AND degraded THEN 1 END) AS degraded, round(avg(CASE WHEN NOT err AND NOT un THEN recall END), 6) AS recall, round(avg(CASE WHEN NOT err AND NOT un THEN ndcg END), 6) AS ndcg, round(avg(CASE WHEN NOT err AND un THEN refusal END), 6) AS refusal, round(coalesce(sum(CASE WHEN NOT err THEN cost END), 0), 4) AS cost, round(coalesce(sum(CASE WHEN NOT err THEN cost END) / count(CASE WHEN NOT err THEN 1 END), 0), 6) AS cost_per_question, quantile_disc(CASE WHEN NOT err THEN value END, 0.5) AS p50, quantile_disc(CASE WHEN NOT err THEN value END, 0.95) AS p95 FROM r GROUP BY 1"),
    "run_compare": (run_compare, f"WITH {PAIRED} SELECT user_id, count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(a - b), 6) AS delta FROM p GROUP BY 1"),
    "worst_regressions": (worst_regressions, f"WITH {PAIRED}, q AS (SELECT user_id || '/' || day AS id, 'recall' AS metric, round(a, 4) AS a, round(b, 4) AS b FROM p) SELECT *, round(b - a, 6) AS delta FROM q WHERE round(b - a, 6) < 0 ORDER BY delta, metric, id LIMIT 20"),
    "resource_gate": (resource_gate, "WITH s AS (SELECT event_type AS metric, round(sum(CASE WHEN ts < TIMESTAMP '2024-01-16' THEN value END), 4) AS before, round(sum(CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN value END), 4) AS after FROM events GROUP BY 1) SELECT metric, before, after, round((after - before) / before, 6) AS delta, (after - before) / before > 0.01 AS failed, CAST(NULL AS VARCHAR) AS note FROM s"),
    "kept_pages": (kept_pages, "WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents) SELECT doc_id, count(*) AS kept, CAST(sum(ceil(length(t) / 4.0)) AS BIGINT) AS tokens, any_value(s) AS skipped FROM (SELECT *, count(CASE WHEN length(trim(t)) < 50 THEN 1 END) OVER (PARTITION BY doc_id) AS s FROM p) WHERE length(trim(t)) >= 50 GROUP BY 1"),
    "chunk_pages": (chunk_pages, None),
    "strip_repeated_lines": (strip_repeated_lines, None),
    "source_stats": (source_stats, "SELECT source, count(*) AS documents, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens, round(avg(ceil(length(text) / 4.0)), 6) AS mean_tokens, CAST(max(ceil(length(text) / 4.0)) AS BIGINT) AS most FROM documents GROUP BY 1"),
    "line_shapes": (line_shapes, "SELECT shape, count(*) AS n FROM (SELECT regexp_replace(trim(t), '[0-9]', '#', 'g') AS shape FROM (SELECT unnest(string_split(text, chr(10))) AS t FROM documents)) WHERE shape <> '' AND length(shape) <= 60 GROUP BY 1 HAVING count(*) >= 4 ORDER BY n DESC, shape LIMIT 30"),
    "ingest_plan": (ingest_plan, "WITH e AS (SELECT doc_id AS key, md5(text) AS d FROM documents WHERE doc_id % 7 <> 0), x AS (SELECT doc_id AS key, md5(CASE WHEN doc_id % 11 = 0 THEN upper(text) ELSE text END) AS d FROM documents WHERE doc_id % 5 <> 0) SELECT coalesce(e.key, x.key) AS key, CASE WHEN e.key IS NULL THEN 'stale' WHEN x.key IS NOT NULL AND x.key % 13 <> 0 AND e.d = x.d THEN CASE WHEN x.key % 17 = 0 THEN 'retag' ELSE 'done' END ELSE 'embed' END AS action FROM e FULL JOIN x ON e.key = x.key"),
    "chunk_state": (chunk_state, "SELECT doc_id, md5(text) AS digest, doc_id % 13 <> 0 AS embedded FROM documents"),
    "upsert_latest": (upsert_latest, "SELECT user_id, event_type, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"),
    "sentences": (sentences, r"WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents) SELECT doc_id, i - 1 AS pos, s[i] AS sentence FROM s, range(1, 100000) r(i) WHERE i <= len(s)"),
    "citations": (citations, r"""WITH c AS (SELECT conv_id, turn, t0 || ' See [1][2]. And [' || (turn + 3) || '] also.' AS t FROM (SELECT conv_id, turn, min(text) AS t0 FROM conversations WHERE role = 'assistant' GROUP BY conv_id, turn)),
s AS (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM c),
m AS (SELECT conv_id, turn, flatten(list_transform(s, lambda x: list_transform(regexp_extract_all(x, '\[([0-9]+)\]', 1), lambda y: {'marker': CAST(y AS INT), 'sentence': trim(regexp_replace(x, '\s*\[[0-9]+\]', '', 'g'))}))) AS m FROM s)
SELECT conv_id, turn, i - 1 AS pos, m[i].marker AS marker, m[i].sentence AS sentence, NOT m[i].marker BETWEEN 1 AND 5 AS dangling FROM m, range(1, 1000) r(i) WHERE i <= len(m)"""),
    "html_text": (html_text, HTML),
    "url_slugs": (url_slugs, "SELECT page_id, regexp_replace(substr(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', '') AS slug FROM pages"),
    "scripts": (scripts, "SELECT doc_id, CASE WHEN en + am = 0 THEN NULL WHEN am > en THEN 'am' ELSE 'en' END AS script, round(CASE WHEN length(text) = 0 THEN 0 ELSE en / length(text) END, 6) AS letters FROM (SELECT *, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS en, CASE WHEN doc_id % 9 = 0 THEN 18000 ELSE 0 END AS am FROM documents)"),
    "parsed_refs": (parsed_refs, "SELECT l_orderkey, l_linenumber, 'Order' AS book, l_orderkey AS c1, CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE l_linenumber END AS v1, l_orderkey AS c2, CASE WHEN l_partkey % 3 = 0 THEN 999 ELSE l_linenumber + 2 END AS v2 FROM lineitem"),
    "overlapping_spans": (overlapping_spans, "SELECT l_orderkey * 10 + l_linenumber AS span, o_orderkey AS passage FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND datediff('day', o_orderdate, l_shipdate) <= 44 AND datediff('day', o_orderdate, l_shipdate) + 3 >= 30"),
    "ethiopian_calendar": (ethiopian_calendar, CHURCH),
    "daily_counts": (daily_counts, "SELECT CAST(floor((epoch(ts) + 10800) / 86400) AS BIGINT) AS day, event_type AS name, count(*) AS n FROM events GROUP BY ALL"),
    "feedback_by_figure": (feedback_by_figure, "SELECT figure, count(CASE WHEN helpful THEN 1 END) AS yes, count(CASE WHEN NOT helpful THEN 1 END) AS no, CAST(round(100.0 * count(CASE WHEN helpful THEN 1 END) / count(*)) AS INT) AS percent FROM (SELECT unnest([k % 10, k % 7 + 10]) AS figure, value > 50 AS helpful FROM (SELECT value, CAST(props ->> '$.k' AS INT) AS k FROM events)) GROUP BY 1"),
    "recent_days": (recent_days, "WITH e AS (SELECT *, CAST(ts AS DATE) AS day FROM events), g AS (SELECT user_id, CAST((SELECT max(day) FROM e) - CAST(i AS INT) AS DATE) AS day FROM (SELECT DISTINCT user_id FROM e), range(0, 14) r(i)) SELECT user_id, CAST(day AS VARCHAR) AS day, EXISTS (SELECT 1 FROM e WHERE e.user_id = g.user_id AND e.day = g.day AND event_type = 'purchase') AS marked FROM g"),
    "daily_claims": (daily_claims, "SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL"),
    "sliding_limiter": (sliding_limiter, None),
    "cost_rollup": (cost_rollup, "SELECT l_returnflag, l_linestatus, round(sum(l_quantity * CASE l_returnflag WHEN 'A' THEN 0.5 WHEN 'R' THEN 0.25 ELSE 0 END), 4) AS usd, sum(l_quantity) AS units FROM lineitem GROUP BY ALL"),
    "fixed_order": (fixed_order, f"SELECT c_custkey, list_reduce(list_prepend(2166136261, list_transform(string_split('customer|' || c_custkey, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: {imul('xor(h, c)', '16777619')}) / 4294967296.0 AS h FROM customer"),
    "share_vs_target": (share_vs_target, "WITH g(lang, target) AS (VALUES ('en', 0.55), ('fr', 0.15), ('de', 0.15), ('es', 0.15)), s AS (SELECT g.lang, CAST(target AS DOUBLE) AS target, (SELECT count(*) FROM documents d WHERE d.lang = g.lang) / (SELECT count(*) FROM documents) AS share FROM g) SELECT lang, round(share, 6) AS share, round(share / target - 1, 6) AS deviation, abs(share / target - 1) <= 0.25 AS ok FROM s"),
    "data_rules": (data_rules, "SELECT 'over 25 orders' AS rule, o_custkey AS key FROM orders GROUP BY 2 HAVING count(*) > 25 UNION ALL SELECT 'price', o_orderkey FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT 'status', o_orderkey FROM orders WHERE o_orderstatus NOT IN ('O', 'F') UNION ALL SELECT 'no orders', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "cache_misses": (cache_misses, "WITH d AS (SELECT doc_id, sha256(text) AS key FROM documents) SELECT key, min(doc_id) AS doc_id FROM d WHERE key NOT IN (SELECT key FROM d WHERE doc_id % 3 = 0) GROUP BY 1"),
    "json_rows": (json_rows, "SELECT CAST(props ->> '$.k' AS INT) AS k, count(*) AS n FROM events GROUP BY 1"),
}
