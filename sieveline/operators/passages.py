"""Which chunks a passage reference names: prefix joins as equi joins on generated prefixes, verse spans by chapter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import format_spans, parse_ref, parse_ref_list


def prefix_hits(passages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, pos, ref): chunks (source, pos, ref, content) of a passage's (id, source, ref, match) source whose ref begins with
    the passage's, whatever the case, and whose content holds match (any, if null).

    A chunk's ref is cut to each length that occurs among the passages of its source, at most as many as there are such
    lengths, and joined on equality, so no pair is compared that shares no prefix. Null sources and refs hit nothing."""
    p = passages.where(F.col("source").isNotNull() & F.col("ref").isNotNull()).select("id", "source", F.lower("ref").alias("prefix"), F.lower("match").alias("match"))
    sizes = p.groupBy("source").agg(F.collect_set(F.length("prefix")).alias("sizes"))
    low = F.lower("ref")
    c = chunks.where(F.col("ref").isNotNull()).join(sizes, "source")
    c = c.select("source", "pos", "ref", "content", F.explode(F.transform(F.filter("sizes", lambda n: n <= F.length(low)), lambda n: F.substring(low, F.lit(1), n))).alias("prefix"))
    hits = c.join(p, ["source", "prefix"]).where(F.col("match").isNull() | F.contains(F.lower("content"), F.col("match")))
    return hits.select("id", "pos", "ref")


def span_hits(passages: DataFrame, chunks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(id, pos, ref): chunks (pos, ref) whose verse span meets that of a passage (id, ref) in the same book.

    With `by`, columns of both, only those equal in them meet. Both are joined by book and chapter; a span has a row for each of its chapters, passages no further than the book's
    last one. Refs that are no references hit nothing, spans that end before they begin neither."""
    span = lambda d, *keep: d.withColumn("__s", parse_ref(F.col("ref"))).where("__s is not null").select(*keep, "ref", "__s.*")
    c = span(chunks, "pos", *by).where("c1 <= c2")
    last = c.groupBy(*by, "book").agg(F.max("c2").alias("last"))
    p = span(passages, "id", *by).join(last, [*by, "book"]).where(F.col("c1") <= F.least("c2", "last"))
    p = p.select("id", *by, "book", F.struct(F.col("c1").alias("c"), F.col("v1").alias("v")).alias("a"), F.struct(F.col("c2").alias("c"), F.col("v2").alias("v")).alias("z"), F.explode(F.sequence("c1", F.least("c2", "last"))).alias("chapter"))
    c = c.select("pos", "ref", *by, "book", F.struct(F.col("c1").alias("c"), F.col("v1").alias("v")).alias("ca"), F.struct(F.col("c2").alias("c"), F.col("v2").alias("v")).alias("cz"), F.explode(F.sequence("c1", "c2")).alias("chapter"))
    return c.join(p, [*by, "book", "chapter"]).where((F.col("ca") <= F.col("z")) & (F.col("cz") >= F.col("a"))).select("id", "pos", "ref").distinct()


def expected_ranks(expected: DataFrame, results: DataFrame) -> DataFrame:
    """(id, ref, rank) of every distinct expected (id, ref): the best rank of a result (id, rank, ref) of the same id that is
    that passage, meets its verses or begins with it whatever the case; 0 if none does, or the id or a ref is null.

    Both ways are equi joins within the id, by book and chapter and by generated prefixes; no result is compared with every ref."""
    e = expected.select("id", "ref").distinct()
    asked = e.where("id is not null and ref is not null").select(F.struct("id", "ref").alias("id"), F.col("id").alias("source"), "ref", F.lit(None).cast("string").alias("match"))
    got = results.where("id is not null and ref is not null").select(F.col("id").alias("source"), F.col("rank").alias("pos"), "ref", F.lit("").alias("content"))
    hits = prefix_hits(asked, got).unionByName(span_hits(asked, got, ("source",)))
    best = hits.groupBy("id").agg(F.min("pos").cast("long").alias("rank")).select("id.id", "id.ref", "rank")
    return e.join(best, ["id", "ref"], "left").select("id", "ref", F.coalesce("rank", F.lit(0).cast("long")).alias("rank"))


def passage_texts(passages: DataFrame, verses: DataFrame, refused: str | None = None, unaligned: DataFrame | None = None) -> DataFrame:
    """(id, ref, text) of passages (id distinct, ref a list of spans), ref as it is shown, text their verses (book, chapter, verse, text) in order.

    Both are null where the text is not whole: no list of spans, a chapter that is missing, a span that begins behind its
    chapter's end, no verse at all, a verse that matches `refused`, or one from `verse` of a chapter in unaligned (book, chapter, verse)
    on. A blank verse at a span's end stands for one joined onto the next, which comes too. A passage's text must fit a row."""
    v = verses.where("book is not null and chapter is not null and verse is not null").select("book", F.col("chapter").cast("int").alias("chapter"), F.col("verse").cast("int").alias("verse"), F.coalesce("text", F.lit("")).alias("text"))
    chapters = v.groupBy("book", "chapter").agg(F.max("verse").alias("size"))
    p = passages.select("id", parse_ref_list(F.col("ref")).alias("__p")).where("__p is not null").select("id", "__p.*")
    s = p.select("id", "book", F.posexplode("spans").alias("span", "s")).select("id", "book", "span", "s.*").where("c1 <= c2")
    last = chapters.groupBy("book").agg(F.max("chapter").alias("last"))
    wanted = s.groupBy("id").agg(F.sum((F.col("c2") - F.col("c1") + 1).cast("long")).alias("wanted"))
    s = s.join(last, "book").where(F.col("c1") <= F.col("last"))
    s = s.withColumn("chapter", F.explode(F.sequence("c1", F.least("c2", "last")))).join(chapters, ["book", "chapter"])
    begin = F.when(F.col("chapter") == F.col("c1"), F.col("v1")).otherwise(1)
    end = F.when(F.col("chapter") == F.col("c2"), F.least("v2", "size")).otherwise(F.col("size"))
    s = s.select("id", "book", "span", "chapter", "size", begin.alias("begin"), end.alias("end")).where("begin <= size")
    stop = F.min(F.when(F.col("text") != "", F.col("verse"))).over(W.partitionBy("book", "chapter").orderBy("verse").rowsBetween(0, W.unboundedFollowing))
    stops = v.select("book", "chapter", F.col("verse").alias("end"), stop.alias("stop"))
    s = s.join(stops, ["book", "chapter", "end"], "left").withColumn("end", F.when(F.col("stop").isNull() & (F.col("end") < F.col("size")), F.col("size")).otherwise(F.coalesce("stop", "end")))
    bad = F.lit(False)
    if unaligned is not None:
        s = s.join(unaligned.select("book", "chapter", F.col("verse").alias("__from")), ["book", "chapter"], "left")
        bad = F.coalesce(F.col("end") >= F.col("__from"), F.lit(False))
    found = s.groupBy("id").agg(F.count("*").alias("found"), F.max(bad).alias("bad"))
    t = s.select("id", "book", "span", "chapter", "begin", "end").join(v.where("text <> ''"), ["book", "chapter"]).where("verse between begin and end")
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("span", "chapter", "verse", "text"))), lambda x: x["text"]), " ")
    t = t.groupBy("id").agg(whole.alias("text"), F.max(F.col("text").rlike(refused) if refused else F.lit(False)).alias("refused"))
    ok = p.join(wanted, "id").join(found, "id").join(t, "id").where("wanted = found and not bad and not refused")
    ok = ok.select("id", format_spans(F.col("book"), F.col("spans")).alias("ref"), "text")
    return passages.select("id").join(ok, "id", "left")


def prefix_resolution(passages: DataFrame, chunks: DataFrame) -> DataFrame:
    """resolution of prefix_hits: passages of one source, prefix and match hit the same chunks, so they are looked up once.

    Passages without source or ref have no hits; ids of several rows count the hits of each."""
    keys = ["source", F.lower("ref").alias("ref"), F.lower("match").alias("match")]
    p = passages.select("id", F.struct(*keys).alias("key"))
    asked = p.where("key.source is not null and key.ref is not null").select("key").distinct().select(F.col("key").alias("id"), "key.*")
    hits = prefix_hits(asked, chunks)
    n = hits.groupBy("id").agg(F.count("*").alias("hits"))
    top = hits.withColumn("__n", F.row_number().over(W.partitionBy("id").orderBy("pos"))).where(F.col("__n") <= 3)  # limited before it is shuffled
    top = top.groupBy("id").agg(F.collect_list(F.struct("pos", "ref")).alias("top"))
    found = n.join(top, "id").select(F.col("id").alias("key"), "hits", "top")
    j = p.join(found, p["key"].eqNullSafe(found["key"]), "left").groupBy("id").agg(F.sum("hits").alias("hits"), F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, 3).alias("top"))
    return j.select("id", F.coalesce("hits", F.lit(0).cast("long")).alias("hits"), F.array_join(F.transform("top", lambda x: x["ref"]), "; ").alias("first"), F.col("hits").isNotNull().alias("found"))


def resolution(passages: DataFrame, hits: DataFrame) -> DataFrame:
    """(id, hits, first, found) of every passage: how many chunks it names and the refs of the first three; none is a row too."""
    top = F.slice(F.sort_array(F.collect_list(F.when(F.col("__n") <= 3, F.struct("pos", "ref")))), 1, 3)
    n = hits.withColumn("__n", F.row_number().over(W.partitionBy("id").orderBy("pos")))
    h = n.groupBy("id").agg(F.count("*").alias("hits"), F.array_join(F.transform(top, lambda x: x["ref"]), "; ").alias("first"))
    return passages.select("id").distinct().join(h, "id", "left").select("id", F.coalesce("hits", F.lit(0).cast("long")).alias("hits"), F.coalesce("first", F.lit("")).alias("first"), F.col("hits").isNotNull().alias("found"))
