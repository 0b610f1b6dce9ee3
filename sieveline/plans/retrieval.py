"""Retrieval, metric and mining queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import metrics as M
from ..operators import mining as C
from ..operators import retrieval as R
from ..sources.shared import written
from ..sources.tables import table

STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
NAMES = ", ".join(f"'{w}'" for w in X.ENTITY_STOPWORDS)


def stem_sql(t: str) -> str:
    return f"""CASE WHEN regexp_matches({t}, '^[0-9]+$') OR length({t}) <= 3 THEN {t} WHEN regexp_matches({t}, '[^aeiou]ies$') THEN substr({t}, 1, length({t}) - 3) || 'y'
    WHEN regexp_matches({t}, '(ss|us|is)$') THEN {t} WHEN suffix({t}, 's') THEN substr({t}, 1, length({t}) - 1) ELSE {t} END"""


def terms_sql(rows: str, key: str, text: str = "text") -> str:
    """SELECT key, term of the content terms of rows."""
    return f"SELECT {key}, {stem_sql('t')} AS term FROM (SELECT {key}, unnest(regexp_split_to_array(lower({text}), '[^a-z0-9]+')) AS t FROM {rows}) WHERE length(t) >= 2 AND t NOT IN ({STOP})"


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Query vectors (ids divisible by 20) and all vectors."""
    e = table(spark, sf_dir, "embeddings")
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return b, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


SIMILAR = """q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS u, label AS ql FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, ql, vec_id AS id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), u), 6) AS similarity FROM embeddings, q)"""


def ranked(rows: str, order: str, k: int) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank FROM {rows}) WHERE rank <= {k}"


def dense_topk(spark, sf_dir):
    q, base = vectors(spark, sf_dir)
    return R.dense_topk(q, base.drop("label")).select("query_id", "id", "similarity", "rank")


def dense_topk_filtered(spark, sf_dir):
    q, base = vectors(spark, sf_dir)
    # even tags are labels, odd ones their remainders
    tags = F.array(2 * F.col("label"), 2 * F.pmod("label", F.lit(3)) + 1).cast("array<long>")
    wanted = F.array(2 * F.pmod("query_id", F.lit(3)) + 1).cast("array<long>")
    found = R.dense_topk(q.withColumn("tags", wanted), base.withColumn("tags", tags), 10)
    return found.join(base.select("id", "label"), "id").select("query_id", "id", "label", "similarity", "rank")


def keyword_topk(spark, sf_dir):
    q, d = texts(spark, sf_dir)
    return R.keyword_topk(q, d).select("query_id", "id", "matched", "tf", "rank")


KEYWORD = f"""qt AS (SELECT DISTINCT query_id, term FROM ({terms_sql('(SELECT item_id AS query_id, text FROM benchmark)', 'query_id')})),
dt AS (SELECT id, term, count(*) AS tf FROM ({terms_sql('(SELECT doc_id AS id, text FROM documents)', 'id')}) GROUP BY ALL),
ks AS (SELECT query_id, id, count(*) AS matched, CAST(sum(tf) AS BIGINT) AS tf FROM qt JOIN dt USING (term) GROUP BY ALL),
kr AS ({ranked('ks', 'matched DESC, tf DESC, id', 20)})"""

TFIDF = f"""nn AS (SELECT count(*) AS n FROM documents),
df AS (SELECT term, count(*) AS df, ln((SELECT n FROM nn) / CAST(1 + count(*) AS DOUBLE)) + 1 AS idf FROM dt GROUP BY term),
qraw AS (SELECT query_id, term, count(*) AS tf FROM ({terms_sql('(SELECT item_id AS query_id, text FROM benchmark)', 'query_id')}) GROUP BY ALL),
qw AS (SELECT query_id, term, tf * coalesce(idf, ln((SELECT n FROM nn)) + 1) AS w FROM qraw LEFT JOIN df USING (term)),
qv AS (SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS w FROM qw),
dv AS (SELECT id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)) AS w FROM dt JOIN df USING (term)),
ts AS (SELECT query_id, id, round(sum(qv.w * dv.w), 6) AS similarity FROM qv JOIN dv USING (term) GROUP BY ALL),
tr AS ({ranked('ts', 'similarity DESC, id', 20)})"""

FUSED = f"""fu AS (SELECT query_id, id, max(r1) AS r1, max(r2) AS r2 FROM (SELECT query_id, id, rank AS r1, NULL AS r2 FROM tr UNION ALL SELECT query_id, id, NULL, rank FROM kr) GROUP BY ALL),
fs AS (SELECT *, round(coalesce(CAST(1 AS DOUBLE) / (60 + r1), 0) + coalesce(CAST(1 AS DOUBLE) / (60 + r2), 0), 9) AS score FROM fu),
fr AS ({ranked('fs', 'score DESC, r1 NULLS LAST, r2 NULLS LAST, id', 8)})"""


def tfidf_topk(spark, sf_dir):
    return R.tfidf_topk(*texts(spark, sf_dir)).select("query_id", "id", "similarity", "rank")


def rrf_hybrid(spark, sf_dir):
    q, d = texts(spark, sf_dir)
    return R.fuse(R.tfidf_topk(q, d), R.keyword_topk(q, d)).select("query_id", "id", "r1", "r2", "score", "rank")


def hybrid_recall(spark, sf_dir):
    """The flagship: hybrid top 8 of every benchmark item and its metrics against literal containment."""
    q, d = texts(spark, sf_dir)
    return M.score_rankings(q, R.fuse(R.tfidf_topk(q, d), R.keyword_topk(q, d)), holders(q, d))


def score_names(spark, sf_dir):
    """All metrics of keyword search by name; a source stands for the document that holds its chunks."""
    q, d = texts(spark, sf_dir)
    source = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("doc"))
    truth = holders(q, d)
    return M.score_names(q, R.keyword_topk(q, d).select("query_id", "id", "rank").join(source, "id"), truth, truth.join(source, "id").select("query_id", "doc"))


def holders(q, d):
    """(query_id, id): documents (id, text) that hold the text of a question (query_id, text), wherever it stands and however short it is."""
    return R.containing(q, d).distinct()


def metrics_sql(questions: str, hits: str, truth: str) -> str:
    return f"""ks5 AS (SELECT unnest([1, 3, 5, 10, 20]) AS k), nr AS (SELECT query_id, count(*) AS n FROM {truth} GROUP BY 1),
qk AS (SELECT q.query_id, k, n FROM {questions} q CROSS JOIN ks5 LEFT JOIN nr USING (query_id)),
hm AS (SELECT h.query_id, h.id, h.rank, t.id IS NOT NULL AS hit FROM {hits} h LEFT JOIN {truth} t ON t.query_id = h.query_id AND t.id = h.id),
ag AS (SELECT qk.query_id, qk.k, any_value(n) AS n, count(hm.id) AS w, count(DISTINCT CASE WHEN hit THEN hm.id END) AS found, count(CASE WHEN hit THEN 1 END) AS hits,
    min(CASE WHEN hit THEN rank END) AS first, coalesce(sum(CASE WHEN hit THEN 1 / log2(rank + 1) END), 0) AS dcg FROM qk LEFT JOIN hm ON hm.query_id = qk.query_id AND hm.rank <= qk.k GROUP BY 1, 2)
SELECT query_id, k, CASE WHEN n > 0 THEN round(found / n, 6) END AS recall, CASE WHEN n > 0 THEN round(CASE WHEN w = 0 THEN 0 ELSE hits / w END, 6) END AS precision,
    CASE WHEN n > 0 THEN round(coalesce(1 / first, 0), 6) END AS mrr,
    CASE WHEN n > 0 THEN round(dcg / list_sum(list_transform(range(1, least(n, k) + 1), lambda i: 1 / log2(i + 1))), 6) END AS ndcg,
    CASE WHEN n > 0 THEN CAST(hits > 0 AS DOUBLE) END AS hit_rate FROM ag"""


def retrieval_metrics(spark, sf_dir):
    q, base = vectors(spark, sf_dir)
    hits = R.dense_topk(q, base.drop("label"), 21).where("id <> query_id")
    hits = R.top(hits.drop("rank"), "query_id", [F.desc("similarity"), F.asc("id")], 20)
    # relevant rows of a query are counted by label, itself left out, and only its hits are looked up
    labels = base.select("id", "label")
    asked = labels.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("label").alias("asked"))
    sizes = labels.groupBy(F.col("label").alias("asked")).agg((F.count("*") - 1).alias("n_relevant"))
    marked = hits.join(asked, "query_id").join(labels, "id").withColumn("hit", (F.col("label") == F.col("asked")).cast("int"))
    return M.score_marked(q, marked.select("query_id", "id", "rank", "hit"), asked.join(sizes, "asked").select("query_id", "n_relevant"))


def multi_query_union(spark, sf_dir):
    q, d = texts(spark, sf_dir)
    w = q.withColumn("w", F.split("text", " ")).withColumn("half", F.floor(F.size("w") / 2).cast("int"))
    parts = w.select("query_id", F.posexplode(F.array(F.array_join(F.slice("w", 1, F.col("half")), " "), F.array_join(F.slice("w", F.col("half") + 1, F.size("w")), " "))).alias("part", "text"))
    return R.multi_query(parts, d).select("query_id", "id", "score", "rank")


HALVES = "(SELECT {'query_id': item_id, 'part': p} AS query_id, array_to_string(CASE WHEN p = 0 THEN w[1:len(w)//2] ELSE w[len(w)//2+1:] END, ' ') AS text FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), range(0, 2) r(p))"
_PARTS = (KEYWORD + ", " + TFIDF + ", " + FUSED).replace("(SELECT item_id AS query_id, text FROM benchmark)", HALVES)


def document_frequency(spark, sf_dir):
    _, d = texts(spark, sf_dir)
    return R.idf(d).select("term", "df", F.round("idf", 9).alias("idf"))


def lexical_containment(spark, sf_dir):
    """Overlap of each benchmark item with the documents it scores best against."""
    q, d = texts(spark, sf_dir)
    best = written(R.keyword_topk(q, d, 3).select("query_id", "id"), "best")
    return C.containment(q.join(best, "query_id"), d, R.idf(d), d.count())


def tfidf_pairs(spark, sf_dir):
    """Nearest earlier item of each benchmark item."""
    q, d = texts(spark, sf_dir)
    return C.similar_earlier(q.withColumn("pos", F.col("query_id")), R.idf(d), d.count())


NEAREST = """vt AS (SELECT a.query_id, b.query_id AS nearest_id, round(sum(a.w * b.w), 6) AS similarity FROM qv a JOIN qv b ON a.term = b.term AND b.query_id < a.query_id GROUP BY ALL),
ne AS (SELECT query_id, nearest_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, nearest_id) AS n FROM vt) WHERE n = 1)"""
OVERLAP = """ov AS (SELECT query_id, id, round(coalesce(sum(CASE WHEN d.term IS NOT NULL THEN w END), 0) / sum(w), 6) AS overlap FROM (SELECT kr.query_id, kr.id, qt.term, coalesce(idf, ln((SELECT n FROM nn)) + 1) AS w
    FROM kr JOIN qt ON qt.query_id = kr.query_id LEFT JOIN df ON df.term = qt.term WHERE rank <= {k}) x LEFT JOIN (SELECT id AS did, term FROM dt) d ON d.did = x.id AND d.term = x.term GROUP BY ALL)"""


def question_triage(spark, sf_dir):
    q, d = texts(spark, sf_dir)
    weights, n = written(R.idf(d), "weights"), d.count()
    best = written(R.keyword_topk(q, d, 1).select("query_id", "id"), "best")
    over = C.containment(q.join(best, "query_id"), d, weights, n)
    return C.triage(q.withColumn("pos", F.col("query_id")), over, weights, n)


def near_duplicate_scan(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("doc"))
    return C.near_duplicates(e.where("id % 20 = 0").withColumnRenamed("id", "query_id"), e, 0.85)


def chunks(spark, sf_dir):
    """Document lines as chunks: id is document * 100000 + line."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return d.select((F.col("doc_id") * 100000 + F.col("line")).alias("id"), F.col("doc_id").alias("doc"), "text")


MENTIONS = rf"""ch AS (SELECT doc_id * 100000 + i - 1 AS id, doc_id AS doc, ls[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), range(1, 100000) r(i) WHERE i <= len(ls)),
ph AS (SELECT id, doc, unnest(list_filter(regexp_extract_all(text, '\b[A-Z][a-zA-Z0-9''-]+(?:\s+[A-Z][a-zA-Z0-9''-]+)*'), lambda p: length(p) >= 4)) AS p FROM ch),
em AS (SELECT id, doc, array_to_string(list_filter(regexp_split_to_array(p, '\s+'), lambda w: w NOT IN ({NAMES})), ' ') AS entity FROM ph
    UNION ALL SELECT id, doc, p FROM (SELECT id, doc, unnest(regexp_extract_all(text, '\b[A-Z]{{2,}}(?:-[A-Z0-9]+)?\b')) AS p FROM ch) WHERE p NOT IN ({NAMES})),
me AS (SELECT id, doc, entity, count(*) AS tf FROM em WHERE entity <> '' GROUP BY ALL), ei AS (SELECT entity, count(DISTINCT doc) AS df FROM me GROUP BY 1)"""


def entity_index(spark, sf_dir):
    return C.entity_index(C.mentions(chunks(spark, sf_dir)))


def cross_document_pairs(spark, sf_dir):
    return C.entity_pairs(chunks(spark, sf_dir), True, 0.15)


def same_document_pairs(spark, sf_dir):
    return C.entity_pairs(chunks(spark, sf_dir), False, 0.5, 1)


def pairs_sql(cross: bool, fraction: float, floor: int, least: int) -> str:
    where = "x.doc <> y.doc" if cross else "x.doc = y.doc AND abs(x.id - y.id) >= 5"
    return f"""WITH {MENTIONS}, dn AS (SELECT count(DISTINCT doc) AS n FROM ch), m AS (SELECT me.*, df FROM me JOIN ei USING (entity) WHERE tf >= {least} AND df <= (SELECT greatest({floor}, CAST(floor({fraction} * n) AS INT)) FROM dn)),
pr AS (SELECT x.id AS a, y.id AS b, x.entity, x.df, least(x.tf, y.tf) AS tf, round((ln((SELECT n FROM dn) / CAST(1 + x.df AS DOUBLE)) + 1) * least(x.tf, y.tf), 6) AS score FROM m x JOIN m y ON x.entity = y.entity AND x.id < y.id AND {where})
SELECT a, b, entity, df, tf, score FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY score DESC, entity) AS n FROM pr) WHERE n = 1"""


def stratified_sample(spark, sf_dir):
    return C.stratified(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 5)


def aggregation_questions(spark, sf_dir):
    return C.aggregation_questions(chunks(spark, sf_dir), 20)


def paraphrase_families(spark, sf_dir):
    """Turns as questions: the first turn of a conversation is the parent of the others."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.count("*").alias("rows"))
    items = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000).alias("parent"))
    return C.families(items).groupBy("root").agg(F.count("*").alias("members"))


def split_check(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    ident = F.col("conv_id") * 1000 + F.col("turn")
    items = c.select(ident.alias("id"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000).alias("parent"), F.when(F.pmod(ident, F.lit(7)) == 0, "holdout").otherwise("dev").alias("split"))
    return C.split_problems(items)


def names_sql(questions: str, hits: str, truth: str, source: str) -> str:
    """score_names in SQL: the metrics by cutoff, recall of documents and mrr of all hits, as rows."""
    return f"""pk AS (WITH {metrics_sql(questions, hits, truth)}),
dt2 AS (SELECT DISTINCT query_id, doc FROM {truth} t JOIN {source} s ON s.id = t.id), dn AS (SELECT query_id, count(*) AS n FROM dt2 GROUP BY 1),
df2 AS (SELECT h.query_id, s.doc, min(h.rank) AS rank FROM {hits} h JOIN {source} s ON s.id = h.id JOIN dt2 ON dt2.query_id = h.query_id AND dt2.doc = s.doc GROUP BY ALL),
dr AS (SELECT pk.query_id, k, CASE WHEN any_value(n) > 0 THEN round(count(df2.doc) / any_value(n), 6) END AS doc FROM pk LEFT JOIN dn USING (query_id) LEFT JOIN df2 ON df2.query_id = pk.query_id AND df2.rank <= k GROUP BY ALL),
fm AS (SELECT h.query_id, min(rank) AS rank FROM {hits} h JOIN {truth} t ON t.query_id = h.query_id AND t.id = h.id GROUP BY 1)
SELECT query_id, m || '@' || k AS metric, v AS value FROM (SELECT query_id, k, unnest(['recall', 'precision', 'ndcg', 'hitRate', 'docRecall', 'mrr']) AS m, unnest([recall, precision, ndcg, hit_rate, dr.doc, mrr]) AS v FROM pk JOIN dr USING (query_id, k))
UNION ALL SELECT q.query_id, 'mrr', CASE WHEN q.query_id IN (SELECT query_id FROM {truth}) THEN round(coalesce(1 / rank, 0), 6) END FROM {questions} q LEFT JOIN fm USING (query_id)"""


WITH = "WITH " + KEYWORD + ", " + TFIDF
TRUTH = "tt AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
CATALOG = {
    "dense_topk": (dense_topk, f"WITH {SIMILAR} SELECT query_id, id, similarity, rank FROM ({ranked('s', 'similarity DESC, id', 20)})"),
    "dense_topk_filtered": (dense_topk_filtered, f"WITH {SIMILAR}, f AS (SELECT * FROM s WHERE list_has_any(['l' || label, 'm' || label % 3], ['m' || query_id % 3])) SELECT query_id, id, label, similarity, rank FROM ({ranked('f', 'similarity DESC, id', 10)})"),
    "keyword_topk": (keyword_topk, f"WITH {KEYWORD} SELECT query_id, id, matched, tf, rank FROM kr"),
    "tfidf_topk": (tfidf_topk, f"{WITH} SELECT query_id, id, similarity, rank FROM tr"),
    "rrf_hybrid": (rrf_hybrid, f"{WITH}, {FUSED} SELECT query_id, id, r1, r2, score, rank FROM fr"),
    "hybrid_recall": (hybrid_recall, f"{WITH}, {FUSED}, {TRUTH}, {metrics_sql('(SELECT item_id AS query_id FROM benchmark)', 'fr', 'tt')}"),
    "multi_query_union": (multi_query_union, f"WITH {_PARTS}, mq AS (SELECT query_id.query_id AS query_id, id, max(score) AS score FROM fr GROUP BY 1, 2) {ranked('mq', 'score DESC, id', 8)}"),
    "retrieval_metrics": (retrieval_metrics, f"WITH {SIMILAR}, o AS (SELECT * FROM s WHERE id <> query_id), hh AS ({ranked('o', 'similarity DESC, id', 20)}), tt AS (SELECT query_id, id FROM s WHERE ql = label AND id <> query_id), {metrics_sql('q', 'hh', 'tt')}"),
    "score_names": (score_names, f"WITH {KEYWORD}, {TRUTH}, so AS (SELECT doc_id AS id, source AS doc FROM documents), {names_sql('(SELECT item_id AS query_id FROM benchmark)', 'kr', 'tt', 'so')}"),
    "document_frequency": (document_frequency, f"{WITH} SELECT term, df, round(idf, 9) AS idf FROM df"),
    "lexical_containment": (lexical_containment, f"{WITH}, {OVERLAP.format(k=3)} SELECT * FROM ov"),
    "tfidf_pairs": (tfidf_pairs, f"{WITH}, {NEAREST} SELECT * FROM ne"),
    "question_triage": (question_triage, f"{WITH}, {NEAREST}, {OVERLAP.format(k=1)} SELECT b.item_id AS query_id, CASE WHEN coalesce(similarity, 0) >= 0.9 THEN 'duplicate' WHEN coalesce(overlap, 0) >= 0.5 THEN 'lexical' END AS flag, coalesce(overlap, 0) AS overlap, coalesce(similarity, 0) AS similarity FROM benchmark b LEFT JOIN ne ON ne.query_id = b.item_id LEFT JOIN ov ON ov.query_id = b.item_id"),
    "near_duplicate_scan": (near_duplicate_scan, f"WITH {SIMILAR}, b AS (SELECT id, first(query_id ORDER BY similarity DESC, query_id) AS labelled_id, max(similarity) AS similarity, any_value(label) AS label FROM s WHERE id % 20 <> 0 GROUP BY id) SELECT b.id, labelled_id, b.similarity, b.label = q.ql AS same_doc FROM b JOIN q ON q.query_id = labelled_id WHERE b.similarity >= 0.85"),
    "entity_index": (entity_index, f"WITH {MENTIONS} SELECT * FROM ei"),
    "cross_document_pairs": (cross_document_pairs, pairs_sql(True, 0.15, 2, 2)),
    "same_document_pairs": (same_document_pairs, pairs_sql(False, 0.5, 1, 1)),
    "aggregation_questions": (aggregation_questions, None),
    "stratified_sample": (stratified_sample, "SELECT * FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rank FROM documents) WHERE rank <= 5"),
    "paraphrase_families": (paraphrase_families, "SELECT conv_id * 1000 AS root, count(DISTINCT turn) AS members FROM conversations GROUP BY 1"),
    "split_check": (split_check, "WITH i AS (SELECT DISTINCT conv_id * 1000 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 1000 END AS parent, CASE WHEN (conv_id * 1000 + turn) % 7 = 0 THEN 'holdout' ELSE 'dev' END AS split FROM conversations) SELECT c.id, CASE WHEN p.id IS NULL THEN 'orphan' ELSE 'family apart' END AS problem FROM i c LEFT JOIN i p ON p.id = c.parent WHERE c.parent IS NOT NULL AND (p.id IS NULL OR p.split <> c.split)"),
}
