"""Queries of cleaned lines, sections and packed chunks over the driver's documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import passages as P
from ..operators import rules as R
from ..operators import sections as S
from ..operators import usfm as U
from ..sources.tables import table

TARGET = 120


def lines(spark, sf_dir):
    """Lines of documents; every seventh stands for a heading in capitals, every fifth is broken at a hyphen."""
    d = S.lines_of(table(spark, sf_dir, "documents"), dealt=True)
    head, broken = F.col("pos") % 7 == 3, F.col("pos") % 5 == 1
    line = F.when(head, F.upper(F.substring("line", 1, 40))).when(broken, F.concat(F.regexp_replace("line", r"(?<![^a-z])[^a-z]++$", ""), F.lit("-"))).when(F.col("pos") % 5 == 2, F.lower("line")).when(F.col("pos") % 11 == 4, "").otherwise(F.col("line"))
    return d.withColumn("line", line)


def cleaned(spark, sf_dir):
    return S.clean_lines(lines(spark, sf_dir), drop_captions=True, join_broken=True)


def clean_text(spark, sf_dir):
    return cleaned(spark, sf_dir).select("doc", "pos", "line")


def text_sections(spark, sf_dir):
    return S.to_sections(cleaned(spark, sf_dir), "Preface")


def section_chunks(spark, sf_dir):
    return S.chunk_sections(text_sections(spark, sf_dir), F.concat(F.lit("Document "), F.col("doc").cast("string")), TARGET)


def numbered_sections(spark, sf_dir):
    """Every sixth line a numbered chapter in capitals; every fourth of their numbers is too far off to be one, so it is text."""
    d = S.lines_of(table(spark, sf_dir, "documents"))
    k = F.floor(F.col("pos") / 6)
    start = F.concat(F.when(k % 4 == 3, k + 90).otherwise(k + 1).cast("string"), F.lit(". THE LONG WAY,"))
    line = F.when(F.col("pos") % 6 == 0, start).when(F.col("pos") % 6 == 1, "HOME AND BACK").when(F.col("pos") % 6 == 2, "and so it goes").when(F.col("line") == "", "").otherwise(F.concat(F.lit("so "), "line"))
    rule = R.Rule("numberedChapter", section_start=r"^([0-9iIl]{1,4})\s?[.,:-]\s?(.{4,})$")
    return R.ruled_sections(d.withColumn("line", line), rule, "Preface")


def verses(spark, sf_dir):
    """Lines of documents as verses, ten a chapter; every fourth begins a paragraph, some have a heading."""
    d = S.lines_of(table(spark, sf_dir, "documents")).withColumnRenamed("doc", "book")
    return d.select(
        "book", F.concat(F.lit("Book "), F.col("book").cast("string")).alias("name"), "pos", (F.floor(F.col("pos") / 10) + 1).cast("long").alias("chapter"), (F.col("pos") % 10 + 1).cast("long").alias("verse"),
        F.col("line").alias("text"), (F.col("pos") % 4 == 0).alias("paragraph_start"), F.when(F.col("pos") % 17 == 16, F.concat(F.lit("Part "), F.col("pos").cast("string"))).alias("heading"),
    )


def verse_chunks(spark, sf_dir):
    return S.chunk_verses(verses(spark, sf_dir), TARGET)


def marked_books(spark, sf_dir):
    """Documents marked up as books: a line is a verse or goes on with one; chapters, headings, notes and word marks between."""
    d = S.line_lists(table(spark, sf_dir, "documents"))
    text = F.array_join(F.transform("lines", marked_line), "\n")
    return d.select("doc", F.concat(F.lit("\\id GEN Genesis\n\\mt1 Title\n"), text).alias("text"))


def marked_line(line, k):
    """Line k of a document, marked up."""
    before = F.concat(F.when(k % 10 == 0, F.concat(F.lit("\\c "), (F.floor(k / 10) + 1).cast("string"), F.lit("\n\\p\n"))).otherwise(""), F.when(k % 13 == 6, "\\s1 Of \\nd this\\nd* and that\n").otherwise(""), F.when(k % 10 == 0, F.when(F.col("doc") % 3 == 0, "\\d A title.\n").otherwise("")).otherwise(""))
    number = F.concat((k % 10 + 1).cast("string"), F.when(k % 6 == 5, F.concat(F.lit("-"), (k % 10 + 2).cast("string"))).otherwise(""))
    word = F.regexp_replace(line, r"^(\w+)", r"\\w $1|strong=\"H1\"\\w*")
    verse = F.when(k % 5 == 3, F.concat(F.lit("\\q1 "), line)).otherwise(F.concat(F.lit("\\v "), number, F.lit(" "), word, F.when(k % 4 == 1, "\\f + \\ft A note \\v here.\\f* after").otherwise("")))
    return F.concat(before, verse)


def marked_verses(spark, sf_dir):
    return U.verses(marked_books(spark, sf_dir))


def passage_prefixes(spark, sf_dir):
    """Documents as sections of their source; a tenth of them asked for by the beginning of a ref and a word."""
    d = table(spark, sf_dir, "documents")
    part = F.concat(F.lit("Part "), (F.col("doc_id") % 9).cast("string"))
    chunks = d.select("source", F.col("doc_id").alias("pos"), F.concat(part, F.lit(", Section "), (F.col("doc_id") % 70).cast("string")).alias("ref"), F.col("text").alias("content"))
    asked = F.when(F.col("doc_id") % 3 == 0, F.concat(F.upper(part), F.lit(", section "), (F.col("doc_id") % 7).cast("string"))).when(F.col("doc_id") % 3 == 1, "part 9").otherwise(part)
    passages = d.where("doc_id % 10 = 0").select(F.col("doc_id").alias("id"), "source", asked.alias("ref"), F.when(F.col("doc_id") % 20 == 0, "en").alias("match"))
    return P.prefix_resolution(passages, chunks)


def passage_spans(spark, sf_dir):
    """Verse chunks named by passages of two chapters, whole chapters or verses that do not exist."""
    chunks = verse_chunks(spark, sf_dir).select((F.col("book") * 1000 + F.col("chunk")).alias("pos"), "ref")
    book = F.concat(F.lit("Book "), F.col("doc_id").cast("string"))
    ref = F.when(F.col("doc_id") % 4 == 0, F.concat(book, F.lit(" 1:5-2:3"))).when(F.col("doc_id") % 4 == 1, F.concat(book, F.lit(" 2"))).when(F.col("doc_id") % 4 == 2, F.concat(book, F.lit(" 1:2-4"))).otherwise(F.concat(book, F.lit(" 40:1")))
    passages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), ref.alias("ref"))
    return P.resolution(passages, P.span_hits(passages, chunks))


def expected_ranks(spark, sf_dir):
    """The chunks of each document as its results in order; three passages expected of each: verses, a prefix, a chapter far off."""
    results = verse_chunks(spark, sf_dir).select(F.col("book").alias("id"), (F.col("chunk") + 1).alias("rank"), "ref")
    n = F.col("doc_id").cast("string")
    refs = F.array(F.concat(F.lit("Book "), n, F.lit(" 1:5-2:3")), F.concat(F.lit("book "), n, F.lit(" 2")), F.concat(F.lit("Book "), n, F.lit(" 40:1")))
    return P.expected_ranks(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(refs).alias("ref")), results)


def passage_texts(spark, sf_dir):
    """Lists of spans of each document's verses, every tenth of which is joined onto the next."""
    v = verses(spark, sf_dir).select(F.concat(F.lit("Book"), F.col("book").cast("string")).alias("book"), "chapter", "verse", F.when(F.col("verse") == 4, "").otherwise(F.col("text")).alias("text"))
    m = F.col("doc_id") % 4
    spans = F.when(m == 0, "1:2-4, 6, 2:1–3").when(m == 1, "2").when(m == 2, "1:8-2:4").otherwise("1:1, 40:1")
    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("Book"), F.col("doc_id").cast("string"), F.lit(" "), spans).alias("ref"))
    return P.passage_texts(asked, v)


VERSE_TABLES = f"""WITH RECURSIVE d AS (SELECT doc_id AS book, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
v AS MATERIALIZED (SELECT book, i AS pos, l[i + 1] AS text, CAST(ceil(length(l[i + 1]) / 4.0) AS BIGINT) AS t, i // 10 + 1 AS chapter, i % 10 + 1 AS verse, CASE WHEN i % 17 = 16 THEN 'Part ' || i END AS heading FROM (SELECT book, l, unnest(range(0, len(l))) AS i FROM d)),
g AS (SELECT book, pos, 0::BIGINT AS chunk, t AS total FROM v WHERE pos = 0 UNION ALL
    SELECT v.book, v.pos, CASE WHEN b THEN chunk + 1 ELSE chunk END, CASE WHEN b THEN v.t ELSE total + v.t END
    FROM g JOIN v ON v.book = g.book AND v.pos = g.pos + 1, LATERAL (SELECT total + v.t > {TARGET} OR (v.pos % 4 = 0 AND total >= {TARGET / 2}) OR v.heading IS NOT NULL AS b)),
c AS (SELECT book, chunk, arg_min(chapter, pos) AS c1, arg_min(verse, pos) AS v1, arg_max(chapter, pos) AS c2, arg_max(verse, pos) AS v2, min(heading) AS heading, string_agg(text, ' ' ORDER BY pos) AS body FROM g JOIN v USING (book, pos) GROUP BY ALL),
r AS (SELECT *, 'Book ' || book || ' ' || c1 || ':' || v1 || CASE WHEN c1 = c2 AND v1 = v2 THEN '' WHEN c1 = c2 THEN '-' || v2 ELSE '-' || c2 || ':' || v2 END AS ref FROM c),
o AS (SELECT *, ref || coalesce(' — ' || heading, '') || chr(10) || chr(10) || body AS content FROM r)"""
VERSES = f"""{VERSE_TABLES} SELECT book, chunk, ref, c1 AS chapter_start, v1 AS verse_start, CASE WHEN c1 = c2 THEN v2 END AS verse_end, content, CAST(ceil(length(content) / 4.0) AS BIGINT) AS tokens FROM o"""

REPORT = """hn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS n FROM h), hr AS (SELECT id, count(*) AS hits, string_agg(CASE WHEN n <= 3 THEN ref END, '; ' ORDER BY pos) AS first FROM hn GROUP BY id)
SELECT p.id, coalesce(hits, 0) AS hits, coalesce(first, '') AS first, hits IS NOT NULL AS found FROM p LEFT JOIN hr USING (id)"""
PREFIXES = f"""WITH c AS (SELECT source, doc_id AS pos, 'Part ' || doc_id % 9 || ', Section ' || doc_id % 70 AS ref, text FROM documents),
p AS (SELECT doc_id AS id, source, CASE doc_id % 3 WHEN 0 THEN 'PART ' || doc_id % 9 || ', section ' || doc_id % 7 WHEN 1 THEN 'part 9' ELSE 'Part ' || doc_id % 9 END AS ref, CASE WHEN doc_id % 20 = 0 THEN 'en' END AS match FROM documents WHERE doc_id % 10 = 0),
h AS (SELECT p.id, c.pos, c.ref FROM p JOIN c ON c.source = p.source AND starts_with(lower(c.ref), lower(p.ref)) AND (p.match IS NULL OR contains(lower(c.text), p.match))), {REPORT}"""
SPANS = f"""{VERSE_TABLES}, cc AS (SELECT book * 1000 + chunk AS pos, book, ref, c1 * 1000 + v1 AS a, c2 * 1000 + v2 AS z FROM r),
p AS (SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 1005 WHEN 1 THEN 2001 WHEN 2 THEN 1002 ELSE 40001 END AS a, CASE doc_id % 4 WHEN 0 THEN 2003 WHEN 1 THEN 2999 WHEN 2 THEN 1004 ELSE 40001 END AS z FROM documents),
h AS (SELECT p.id, cc.pos, cc.ref FROM p JOIN cc ON cc.book = p.id AND cc.a <= p.z AND cc.z >= p.a), {REPORT}"""

RANKS = f"""{VERSE_TABLES}, x AS (SELECT doc_id AS id, y.a, y.z, y.p || doc_id || y.s AS ref FROM documents, (VALUES ('Book ', ' 1:5-2:3', 1005, 2003), ('book ', ' 2', NULL, NULL), ('Book ', ' 40:1', 40001, 40001)) y(p, s, a, z))
SELECT x.id, x.ref, coalesce(min(r.chunk + 1), 0) AS rank FROM x LEFT JOIN r ON r.book = x.id AND (starts_with(lower(r.ref), lower(x.ref)) OR (r.c1 * 1000 + r.v1 <= x.z AND r.c2 * 1000 + r.v2 >= x.a)) GROUP BY ALL"""
TEXTS = """WITH d AS (SELECT doc_id AS id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
vs AS MATERIALIZED (SELECT id, i // 10 + 1 AS c, i % 10 + 1 AS v, CASE WHEN i % 10 = 3 THEN '' ELSE l[i + 1] END AS text FROM (SELECT id, l, unnest(range(0, len(l))) AS i FROM d)),
ch AS (SELECT id, c, max(v) AS n FROM vs GROUP BY ALL),
s AS (SELECT doc_id AS id, x.* FROM documents JOIN (VALUES (0, 1, 1, 2, 1, 4), (0, 2, 1, 6, 1, 6), (0, 3, 2, 1, 2, 3), (1, 1, 2, 1, 2, 999), (2, 1, 1, 8, 2, 4), (3, 1, 1, 1, 1, 1), (3, 2, 40, 1, 40, 1)) x(m, k, c1, v1, c2, v2) ON doc_id % 4 = m),
e AS (SELECT s.id, k, u.c, n, CASE WHEN u.c = c1 THEN v1 ELSE 1 END AS f, CASE WHEN u.c = c2 THEN least(v2, n) ELSE n END AS t FROM (SELECT *, unnest(range(c1, c2 + 1)) AS c FROM s) u JOIN s USING (id, k, c1, v1, c2, v2) LEFT JOIN ch ON ch.id = u.id AND ch.c = u.c),
w AS (SELECT e.id, e.k, e.c, e.n, e.f, coalesce(min(vs.v), e.n) AS t FROM e LEFT JOIN vs ON vs.id = e.id AND vs.c = e.c AND vs.v >= e.t AND vs.text <> '' GROUP BY e.id, e.k, e.c, e.n, e.f),
o AS (SELECT w.id, string_agg(text, ' ' ORDER BY k, w.c, v) AS text FROM w JOIN vs ON vs.id = w.id AND vs.c = w.c AND vs.v BETWEEN f AND t AND text <> '' WHERE w.id NOT IN (SELECT id FROM e WHERE n IS NULL OR f > n) GROUP BY ALL)
SELECT doc_id AS id, CASE WHEN o.text IS NOT NULL THEN 'Book' || doc_id || CASE doc_id % 4 WHEN 0 THEN ' 1፥2–4፣ 1፥6፣ 2፥1–3' WHEN 1 THEN ' 2' WHEN 2 THEN ' 1፥8–2፥4' ELSE ' 1፥1፣ 40፥1' END END AS ref, o.text FROM documents LEFT JOIN o ON o.id = doc_id"""

NUMBERED = r"""WITH d AS (SELECT doc_id AS doc, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc, i, i // 6 AS k, l[i + 1] AS x FROM (SELECT doc, l, unnest(range(0, len(l))) AS i FROM d)),
t AS (SELECT doc, i, k, i % 6 = 0 AND k % 4 <> 3 AS opens, k % 4 <> 3 AND i % 6 = 1 AS titles, CASE WHEN i % 6 = 0 THEN (k + 90) || '. THE LONG WAY,' WHEN i % 6 = 1 THEN 'HOME AND BACK' WHEN i % 6 = 2 THEN 'and so it goes' WHEN x = '' THEN '' ELSE 'so ' || x END AS line FROM r),
s AS (SELECT *, sum(opens::INT) OVER w AS section, sum((opens OR line = '')::INT) OVER w AS block, max(k) OVER (PARTITION BY doc) AS top FROM t WINDOW w AS (PARTITION BY doc ORDER BY i)),
p AS (SELECT doc, section, block, top, trim(regexp_replace(string_agg(line, ' ' ORDER BY i), '\s+', ' ', 'g')) AS text FROM s WHERE NOT opens AND NOT titles AND line <> '' GROUP BY ALL),
h AS (SELECT DISTINCT doc, section, k + 1 AS n, top FROM s WHERE opens),
z AS (SELECT DISTINCT doc, section, EXISTS (SELECT 1 FROM t WHERE t.doc = h.doc AND t.i = 6 * h.n - 5) AS y, CASE WHEN n % 4 = 3 AND top >= n + 1 THEN 'Chapters ' || n || '–' || (n + 1) ELSE 'Chapter ' || n END || ': The Long Way' || CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.doc = h.doc AND t.titles AND t.k = h.n - 1) THEN ' Home And Back' ELSE '' END AS heading FROM h)
SELECT doc, CAST(section AS BIGINT) AS section, heading, row_number() OVER (PARTITION BY doc, section ORDER BY block) AS para, text FROM p JOIN z USING (doc, section)"""

CATALOG = {
    "clean_text": (clean_text, None),
    "text_sections": (text_sections, None),
    "section_chunks": (section_chunks, None),
    "numbered_sections": (numbered_sections, NUMBERED),
    "verse_chunks": (verse_chunks, VERSES),
    "marked_verses": (marked_verses, None),
    "passage_prefixes": (passage_prefixes, PREFIXES),
    "passage_spans": (passage_spans, SPANS),
    "expected_ranks": (expected_ranks, RANKS),
    "passage_texts": (passage_texts, TEXTS),
}
