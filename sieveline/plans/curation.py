"""Curation queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curation as C
from ..sources import tables as S
from ..sources.tables import table

STEMS = {"article": ["the ", "le ", "der "], "relation": ["of ", "de ", "und "], "motion": ["hast", "than", "ander"], "absence": ["none", "sans", "ohne"]}
PHRASES = {"first": ["in the", "dans le"], "second": ["of the", "und die"]}
SOFT = "that|nicht"


def tags(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return C.match_tags(d, STEMS).select(F.col("id").alias("doc_id"), F.array_join("tags", ",").alias("tags"))


def phrase_kinds(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", C.phrase_kind(F.col("text"), PHRASES, SOFT).alias("kind"))


def entity_ranking(spark, sf_dir):
    """Customers as questions, nations as entities, both with tags derived from their keys."""
    tag = lambda c, m: F.concat(F.lit(f"m{m}-"), F.pmod(F.col(c), F.lit(m)).cast("string"))
    q = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), F.array(tag("c_custkey", 3), tag("c_custkey", 7), tag("c_custkey", 5)).alias("tags"))
    n = table(spark, sf_dir, "nation")
    e = n.select(F.col("n_nationkey").alias("id"), F.array(tag("n_nationkey", 3), tag("n_nationkey", 7), tag("n_nationkey", 5)).alias("tags"), (F.col("n_regionkey") == 0).cast("int").alias("first"), F.col("n_nationkey").alias("seq"))
    return C.rank_entities(q, e)


def quotas(spark, sf_dir):
    """Line items of an order in quotas per return flag, eight at most, one per part."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("group"), "l_partkey", F.col("l_linenumber").alias("rank"))
    return C.within_quota(li, "l_orderkey", "l_partkey", 8).withColumnRenamed("group", "flag")


def balanced_sample(spark, sf_dir):
    return C.balanced(table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("flagged")), "doc_id", "flagged", 40)


def proportional_subset(spark, sf_dir):
    return C.proportional(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang", 60)


def claimed_batch(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_custkey") % 9).alias("last_day"))
    return C.claim_batch(c, 5, 50)


def corrected_labels(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    fix = lab.where("doc_id % 10 = 0").select("doc_id", F.lit(1).cast(lab.schema["toxic"].dataType).alias("to"), F.lit("seen").alias("evidence"))
    return C.correct_labels(lab, fix, "doc_id", "toxic").withColumn("audit", F.array_join("audit", ";"))


def agreement_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return C.agreement(table(spark, sf_dir, "labels").join(d, "doc_id").select("lang", F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b")), "lang")


def context_blocks(spark, sf_dir):
    """Turns of a conversation as ranked hits titled by their role."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.min("text").alias("text"))
    return C.context_block(c.select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).alias("rank"), F.when(F.col("role") == "user", F.col("role")).alias("title"), "text"))


def cascade(spark, sf_dir):
    """Line items that stay after orders of 1995 are deleted, counted per ship year."""
    gone = table(spark, sf_dir, "orders").where(F.year("o_orderdate") == 1995).select(F.col("o_orderkey").alias("l_orderkey"))
    return S.cascade_delete(table(spark, sf_dir, "lineitem"), gone, "l_orderkey").groupBy(F.year("l_shipdate").alias("year")).agg(F.count("*").alias("n"))


def replaced_children(spark, sf_dir):
    """Per-order flags after the orders divisible by 5 got one fresh child each."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    fresh = li.where("l_orderkey % 5 = 0").select("l_orderkey").distinct().withColumn("l_linenumber", F.lit(99))
    return S.replace_children(li, fresh, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_linenumber").alias("last"))


def series_ratio(spark, sf_dir):
    """Ceiling of recall at 5: mean of min(5, n) / n over orders with n items, per priority."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = table(spark, sf_dir, "orders").join(n, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.groupBy("o_orderpriority").agg(F.round(F.avg(F.least(F.lit(5), "n") / F.col("n")), 6).alias("ceiling"), F.count("*").alias("orders"))


def counter_rollup(spark, sf_dir):
    """Totals of the last 30 days by event type, those of the last day, and the share of users."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    last = e.agg(F.max("day").alias("last"))
    j = e.join(F.broadcast(last), F.lit(True)).where(F.col("day") > F.date_sub("last", 30))
    return j.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("day") == F.col("last")).alias("today"), F.count_distinct("user_id").alias("users"))


PLAIN = "(' ' || regexp_replace(regexp_replace(regexp_replace(lower(text), '[’'']', '''', 'g'), '[^a-z'' ]+', ' ', 'g'), ' +', ' ', 'g') || ' ')"
TAGS = ", ".join(f"CASE WHEN {' OR '.join(f'contains(t, chr(32) || ' + chr(39) + s + chr(39) + ')' for s in words)} THEN '{tag}' END" for tag, words in STEMS.items())
KINDS = " ".join(f"WHEN {' OR '.join(f'contains(lower(text), ' + chr(39) + w + chr(39) + ')' for w in words)} THEN '{kind}'" for kind, words in PHRASES.items())
EACH = "unnest(['m3-' || {0} % 3, 'm7-' || {0} % 7, 'm5-' || {0} % 5])"

CATALOG = {
    "tags": (tags, f"SELECT doc_id, array_to_string(list_filter([{TAGS}], lambda x: x IS NOT NULL), ',') AS tags FROM (SELECT doc_id, {PLAIN} AS t FROM documents)"),
    "phrase_kinds": (phrase_kinds, f"SELECT conv_id, turn, CASE {KINDS} WHEN regexp_matches(lower(text), '{SOFT}') THEN 'ask' END AS kind FROM conversations"),
    "entity_ranking": (entity_ranking, f"WITH e AS (SELECT n_nationkey AS id, CAST(n_regionkey = 0 AS INT) AS f, {EACH.format('n_nationkey')} AS tag FROM nation), h AS (SELECT tag, count(*) AS holders FROM e GROUP BY 1), q AS (SELECT c_custkey AS query_id, {EACH.format('c_custkey')} AS tag FROM customer), s AS (SELECT query_id, id, f, count(*) AS matched, round(sum(1 / holders), 6) AS rarity FROM q JOIN e USING (tag) JOIN h USING (tag) GROUP BY ALL) SELECT query_id, id, matched, rarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, rarity DESC, f DESC, id) AS rank FROM s) WHERE rank <= 3"),
    "quotas": (quotas, "WITH n AS (SELECT l_orderkey, count(DISTINCT l_returnflag) AS g FROM lineitem GROUP BY 1), k AS (SELECT l_orderkey, l_returnflag AS flag, l_partkey, l_linenumber AS r, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey) AS k, greatest(2, floor(0.7 * 8 / g)) AS quota FROM lineitem JOIN n USING (l_orderkey)), s AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY r, flag) AS seen FROM k WHERE k <= quota), p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY r, flag, l_partkey) AS pos FROM s WHERE seen = 1) SELECT l_orderkey, flag, l_partkey, pos FROM p WHERE pos <= 8"),
    "balanced_sample": (balanced_sample, "WITH k AS (SELECT doc_id, toxic = 1 AS flagged, row_number() OVER (PARTITION BY toxic = 1 ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS k FROM labels) SELECT doc_id, flagged FROM k WHERE k <= 40 ORDER BY k > 20, k, flagged DESC LIMIT 40"),
    "proportional_subset": (proportional_subset, "WITH k AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY lang) AS c, count(*) OVER () AS t FROM documents) SELECT doc_id, lang FROM k WHERE k <= greatest(1, floor(c * 60 / t + 0.5))"),
    "claimed_batch": (claimed_batch, "SELECT c_custkey AS id, 5 AS last_day FROM customer WHERE coalesce(CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 9 END, -1) < 5 ORDER BY c_custkey LIMIT 50"),
    "corrected_labels": (corrected_labels, "SELECT doc_id, quality, CASE WHEN doc_id % 10 = 0 THEN 1 ELSE toxic END AS toxic, CASE WHEN doc_id % 10 = 0 AND toxic IS DISTINCT FROM 1 THEN 'toxic|' || toxic || '|1|seen' ELSE '' END AS audit FROM labels"),
    "agreement_report": (agreement_report, "WITH c AS (SELECT lang, count(*) AS n, avg(CAST(quality = 1 - toxic AS INT)) AS o, avg(quality) AS pa, avg(1 - toxic) AS pb, count(CASE WHEN quality = 1 AND toxic = 1 THEN 1 END) AS b10, count(CASE WHEN quality = 0 AND toxic = 0 THEN 1 END) AS b01 FROM labels JOIN documents USING (doc_id) GROUP BY 1), e AS (SELECT *, round(pa * pb + (1 - pa) * (1 - pb), 12) AS e FROM c), k AS (SELECT *, CASE WHEN e = 1 THEN CASE WHEN o = 1 THEN 1 ELSE 0 END ELSE (o - e) / (1 - e) END AS k, greatest(pa, 1 - pa) AS s, CASE WHEN b10 + b01 >= 3 AND b10 <> b01 THEN round(least(1.0, 2 * list_sum(list_transform(range(0, least(b10, b01) + 1), lambda i: exp(lgamma(b10 + b01 + 1) - lgamma(i + 1) - lgamma(b10 + b01 - i + 1) - (b10 + b01) * ln(2))))), 9) END AS p FROM e) SELECT lang, n, round(o, 6) AS agreement, round(k, 6) AS kappa, round(s, 6) AS skew, p AS bias_p, CASE WHEN p < 0.05 THEN 'BIASED' WHEN pa = 1 THEN 'NO NEGATIVES' WHEN s >= 0.9 THEN 'SKEWED' WHEN k < 0.6 THEN 'WEAK' END AS flag FROM k"),
    "context_blocks": (context_blocks, "WITH c AS (SELECT conv_id, turn, min(role) AS role, min(text) AS text FROM conversations GROUP BY 1, 2) SELECT conv_id AS query_id, string_agg('[' || (turn + 1) || '] ' || CASE WHEN role = 'user' THEN role ELSE '(unknown)' END || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS context FROM c GROUP BY 1"),
    "cascade": (cascade, "SELECT year(l_shipdate) AS year, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1995) GROUP BY 1"),
    "replaced_children": (replaced_children, "SELECT l_orderkey, CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE count(*) END AS n, CASE WHEN l_orderkey % 5 = 0 THEN 99 ELSE max(l_linenumber) END AS last FROM lineitem GROUP BY 1"),
    "series_ratio": (series_ratio, "WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT o_orderpriority, round(avg(least(5, n) / n), 6) AS ceiling, count(*) AS orders FROM orders JOIN n ON o_orderkey = l_orderkey GROUP BY 1"),
    "counter_rollup": (counter_rollup, "WITH e AS (SELECT *, CAST(ts AS DATE) AS day, max(CAST(ts AS DATE)) OVER () AS last FROM events) SELECT event_type, count(*) AS n, count(CASE WHEN day = last THEN 1 END) AS today, count(DISTINCT user_id) AS users FROM e WHERE day > last - INTERVAL 30 DAY GROUP BY 1"),
}
