"""Quality rules with thresholds that adapt to language and source (built-in functions only).

Each document's measures fall into the buckets of a relative-error quantile sketch (buckets 1.02**k wide,
after Masson et al. 2019). Sketches are bucket counts, so they merge by adding: counts per (lang, source)
give those per lang and those of the corpus. A group's thresholds come from its own sketch merged with its language's
and the corpus's, each scaled to PRIOR documents, so that small groups lean on those and large ones on their own, at
every size by one rule. A measure is out of line above q90 + SPREAD * (q90 - q50) + its floor; mean word length
also below q10 - SPREAD * (q50 - q10) - its floor. Floors are small against what junk shows; they are all there is of
a threshold where fewer than a tenth of a group shows a measure at all. Thresholds are then joined to the documents.

Defined results: null text has no words and fails the base rules; null lang or source is a group of its own;
repeated rows each get a verdict; an empty table gives an empty result; other columns are kept where the
operator returns documents and ignored in the verdict, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, words_of

NAME = "op1_quality_rules"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
GAMMA, SPREAD, PRIOR, SCALE, SALTS = 1.02, 3, 5, 100_000, 16  # sketch counts are in 1 / SCALE documents
SMALL = 1_000_000  # rejected documents up to which their keys are broadcast
#: measure -> floor in its own unit (per mille; hundredths of a character for word length)
FLOORS = {"symbols": 10, "dup_lines": 200, "repeats": 100, "word_length": 50}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the base measures, base_failed and the per-document rates appended (names start with q_)."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = docs.select("*", words_of(F.col(text)).alias("q_words"), lines.alias("q_lines"))
    w = F.col("q_words")
    n = F.size(w)
    hashes = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WINDOW)]))
    d = d.select(
        "*",
        n.cast("long").alias("q_n_words"),
        F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("q_word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("q_n_symbols"),
        F.size("q_lines").cast("long").alias("q_n_lines"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("q_n_dup_lines"),
        F.slice(hashes, 1, F.greatest(n - (WINDOW - 1), F.lit(0))).alias("q_hashes"),
    ).drop("q_words", "q_lines")
    repeated = F.size(F.array_distinct("q_hashes")) < F.size("q_hashes")
    # only texts with a repeated window sort theirs; equal neighbours are the repeated ones
    d = d.withColumn("q_sorted", F.when(repeated, F.sort_array(F.transform("q_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = F.col("q_sorted")
    same = lambda x, y: F.get(s, y)["h"].eqNullSafe(x["h"])
    twice = F.filter(s, lambda x, i: same(x, i + 1) | F.when(i > 0, same(x, i - 1)).otherwise(F.lit(False)))
    d = d.withColumn("q_at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    p = F.col("q_at")
    steps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
    d = d.withColumn("q_n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("q_hashes", "q_sorted", "q_at")
    words = F.greatest("q_n_words", F.lit(1))
    rate = lambda top, bottom: F.floor(top / bottom)
    return d.select(
        "*",
        ((F.col("q_n_words") < MIN_WORDS) | (100 * F.col("q_n_repeat_words") > REPEAT_PERCENT * F.col("q_n_words"))).alias("q_base_failed"),
        rate(F.col("q_n_symbols") * 1000, F.greatest("q_word_chars", F.lit(1))).alias("q_symbols"),
        rate(F.col("q_n_dup_lines") * 1000, F.greatest("q_n_lines", F.lit(1))).alias("q_dup_lines"),
        rate(F.col("q_n_repeat_words") * 1000, words).alias("q_repeats"),
        rate(F.col("q_word_chars") * 100, words).alias("q_word_length"),
    ).drop("q_n_lines")


def sketches(measured: DataFrame) -> DataFrame:
    """Merged bucket counts of each group: (lk, sk, measure, bucket, n), n in 1 / SCALE documents."""
    pairs = F.explode(F.create_map(*[x for m in FLOORS for x in (F.lit(m), F.col(f"q_{m}"))])).alias("measure", "v")
    v = measured.where("not q_base_failed").select("lk", "sk", pairs)
    bucket = F.when(F.col("v") < 1, 0).otherwise(1 + F.ceil(F.log(F.col("v").cast("double")) / F.log(F.lit(GAMMA))))
    own = materialise(v.groupBy("lk", "sk", "measure", bucket.cast("long").alias("bucket")).agg(F.count("*").alias("n")), "sketches")
    lang = own.groupBy("lk", "measure", "bucket").agg(F.sum("n").alias("n"))
    whole = lang.groupBy("measure", "bucket").agg(F.sum("n").alias("n"))  # some thousand buckets, by the log of the largest value

    def scaled(d: DataFrame, *keys: str) -> DataFrame:
        total = d.groupBy(*keys).agg(F.sum("n").alias("total"))
        return d.join(total, list(keys)).withColumn("n", F.expr(f"{PRIOR * SCALE} * n div total")).drop("total")

    groups = own.select("lk", "sk", "measure").distinct()
    columns = ["lk", "sk", "measure", "bucket", "n"]
    parts = [own.withColumn("n", F.col("n") * SCALE), groups.join(scaled(lang, "lk", "measure"), ["lk", "measure"]), groups.join(F.broadcast(scaled(whole, "measure")), "measure")]
    merged = parts[0].select(columns).unionByName(parts[1].select(columns)).unionByName(parts[2].select(columns))
    return merged.groupBy("lk", "sk", "measure", "bucket").agg(F.sum("n").alias("n"))


def thresholds(measured: DataFrame) -> DataFrame:
    """(lk, sk, one struct f_<measure> (low, high) per measure) from the quantiles of each group's merged sketch."""
    from pyspark.sql import Window as W

    g = W.partitionBy("lk", "sk", "measure")
    c = sketches(measured).withColumn("upto", F.sum("n").over(g.orderBy("bucket"))).withColumn("total", F.sum("n").over(g))
    q = lambda p: F.min(F.when(F.col("upto") * 100 >= F.col("total") * p, F.when(F.col("bucket") < 1, 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bucket") - 1))))
    at = c.groupBy("lk", "sk", "measure").agg(q(10).alias("q10"), q(50).alias("q50"), q(90).alias("q90"))
    floor = F.create_map(*[F.lit(x) for kv in FLOORS.items() for x in kv])[F.col("measure")]
    at = at.withColumn("high", F.col("q90") + SPREAD * (F.col("q90") - F.col("q50")) + floor)
    at = at.withColumn("low", F.when(F.col("measure") == "word_length", F.col("q10") - SPREAD * (F.col("q50") - F.col("q10")) - floor).otherwise(F.lit(-1.0)))
    return at.groupBy("lk", "sk").agg(*[F.max(F.when(F.col("measure") == m, F.struct("low", "high"))).alias(f"f_{m}") for m in FLOORS])


def judge(measured: DataFrame) -> DataFrame:
    """measured rows with q_kept. The thresholds are repeated over SALTS so that a hot group's rows spread."""
    table = thresholds(measured).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    d = measured.withColumn("salt", F.pmod(F.xxhash64("q_key"), F.lit(SALTS)).cast("int"))
    out = d.join(table, ["lk", "sk", "salt"], "left").drop("salt")
    fine = F.lit(True)
    for m in FLOORS:
        fine = fine & F.coalesce(F.col(f"q_{m}").between(F.col(f"f_{m}")["low"], F.col(f"f_{m}")["high"]), F.lit(True))
    return out.withColumn("q_kept", ~F.col("q_base_failed") & fine).drop("lk", "sk", *[f"f_{m}" for m in FLOORS])


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the base measures, base_failed and kept for every row of docs (doc_id, text, lang, source)."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    d = docs.select("doc_id", F.col("text").alias("q_text"), key("lang").alias("lk"), key("source").alias("sk"))
    d = measure(d, "q_text").drop("q_text").withColumn("q_key", F.xxhash64("doc_id"))
    out = judge(materialise(d, "quality"))
    return out.select("doc_id", *[F.col(f"q_{c}").alias(c) for c in BASE], F.col("q_base_failed").alias("base_failed"), F.col("q_kept").alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns. Rows repeated under one doc_id have a verdict per text, lang and source."""
    verdicts = quality_verdicts(docs.withColumn("doc_id", F.struct("doc_id", F.xxhash64("text").alias("t"), "lang", "source")))
    bad = verdicts.where("not kept").select(*[F.col(f"doc_id.{c}").alias(b) for c, b in (("doc_id", "b_id"), ("t", "b_t"), ("lang", "b_lang"), ("source", "b_source"))]).distinct()
    bad = materialise(bad, "rejected")
    if bad.count() <= SMALL:
        bad = F.broadcast(bad)  # about 100 MB at most; beyond that the join shuffles the documents
    same = [docs[c].eqNullSafe(bad[f"b_{c}"]) for c in ("lang", "source")]
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["b_id"]) & (F.xxhash64(docs["text"]) == bad["b_t"]) & same[0] & same[1], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
    coalesce('=' || lang, 'null') AS lk, coalesce('=' || source, 'null') AS sk FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
wins AS (SELECT rid, i, ws[i:i + 4] AS win FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM wins) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, range(0, 5) r(k) GROUP BY rid),
m AS (SELECT d.*, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, len(ls) AS n_lines,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
    FROM d JOIN w USING (rid) LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
    [n_symbols * 1000 // greatest(word_chars, 1), n_dup_lines * 1000 // greatest(n_lines, 1),
     n_repeat_words * 1000 // greatest(n_words, 1), word_chars * 100 // greatest(n_words, 1)] AS vs FROM m),
h AS (SELECT lk, sk, k, CASE WHEN v < 1 THEN 0 ELSE 1 + ceil(ln(CAST(v AS DOUBLE)) / ln(CAST({GAMMA} AS DOUBLE))) END AS bucket, count(*) AS n
    FROM (SELECT lk, sk, k, vs[k] AS v FROM b, range(1, 5) r(k) WHERE NOT base_failed) GROUP BY ALL),
lg AS (SELECT lk, k, bucket, CAST(sum(n) AS BIGINT) AS n, CAST(sum(sum(n)) OVER (PARTITION BY lk, k) AS BIGINT) AS total FROM h GROUP BY lk, k, bucket),
al AS (SELECT k, bucket, CAST(sum(n) AS BIGINT) AS n, CAST(sum(sum(n)) OVER (PARTITION BY k) AS BIGINT) AS total FROM h GROUP BY k, bucket),
gr AS (SELECT DISTINCT lk, sk, k FROM h),
mg AS (SELECT lk, sk, k, bucket, sum(n) AS n FROM (SELECT lk, sk, k, bucket, n * {SCALE} AS n FROM h
    UNION ALL SELECT gr.lk, gr.sk, gr.k, bucket, {PRIOR * SCALE} * n // total FROM gr JOIN lg ON gr.lk = lg.lk AND gr.k = lg.k
    UNION ALL SELECT gr.lk, gr.sk, gr.k, bucket, {PRIOR * SCALE} * n // total FROM gr JOIN al ON gr.k = al.k) GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY lk, sk, k ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lk, sk, k) AS total,
    CASE WHEN bucket < 1 THEN 0.0 ELSE pow(CAST({GAMMA} AS DOUBLE), bucket - 1) END AS vv FROM mg),
q AS (SELECT lk, sk, k, min(CASE WHEN upto * 100 >= total * 10 THEN vv END) AS q10,
    min(CASE WHEN upto * 100 >= total * 50 THEN vv END) AS q50, min(CASE WHEN upto * 100 >= total * 90 THEN vv END) AS q90 FROM c GROUP BY ALL),
p AS (SELECT lk, sk, k, q90 + {SPREAD} * (q90 - q50) + {list(FLOORS.values())}[k] AS high,
    CASE WHEN k = 4 THEN q10 - {SPREAD} * (q50 - q10) - {FLOORS['word_length']} ELSE -1 END AS low FROM q),
bad AS (SELECT DISTINCT rid FROM b JOIN p USING (lk, sk) WHERE NOT base_failed AND NOT vs[k] BETWEEN low AND high)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.rid IS NULL AS kept
FROM b LEFT JOIN bad USING (rid)
"""
