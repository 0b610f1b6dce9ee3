"""Chunking, incremental plans and line rules of corpus ingestion."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, count_tokens, sanitize, segments


def pack(sizes: list[int], target: int, overlap: int) -> list[tuple[int, int]]:
    """Greedy runs (from, to) of segments up to the target, the next run starting `overlap` tokens back."""
    out, at = [], 0
    while at < len(sizes):
        end, total = at + 1, sizes[at]
        while end < len(sizes) and total + sizes[end] <= target:
            total += sizes[end]
            end += 1
        out.append((at, end))
        if end == len(sizes):
            break
        back, spare = end, overlap
        while back - 1 > at and sizes[back - 1] <= spare:
            back -= 1
            spare -= sizes[back]
        if overlap and back == end and end - at > 1:
            back = end - 1
        at = back
    return out


def chunk_pages(pages: DataFrame, target: int = 800, ratio: float = 0.15) -> DataFrame:
    """(doc_id, page, chunk, content, tokens) of pages (doc_id, page, page_text).

    Segmentation is column expressions; only the greedy runs, whose start depends on the run before, are a small
    Arrow function over segment sizes."""
    overlap = int(target * ratio + 0.5)

    @F.pandas_udf("array<struct<a:int,b:int>>")
    def runs(sizes: pd.Series) -> pd.Series:
        return sizes.map(lambda s: [{"a": a, "b": b} for a, b in pack(list(s), target, overlap)])

    p = pages.withColumn("s", segments(sanitize(F.col("page_text")), target)).where(F.size("s") > 0)
    p = p.withColumn("r", runs(F.transform("s", lambda x: count_tokens(x).cast("int"))))
    c = p.select("doc_id", "page", "s", F.posexplode("r").alias("chunk", "r")).withColumn("content", F.array_join(F.slice("s", F.col("r.a") + 1, F.col("r.b") - F.col("r.a")), "\n\n"))
    return c.select("doc_id", "page", "chunk", "content", count_tokens(F.col("content")).alias("tokens"))


def strip_repeated_lines(pages: DataFrame, least: int = 3, threshold: float = 0.7, short: int = 40) -> DataFrame:
    """pages (doc_id, page, page_text) without lines that stand on threshold of a document's pages, exactly or, if
    short, up to digits. Documents of fewer than `least` pages stay."""
    lines = pages.select("doc_id", "page", F.posexplode(F.split("page_text", r"\r?\n")).alias("no", "raw")).withColumn("line", collapse(F.col("raw")))
    lines = lines.withColumn("shape", F.when((F.col("line") != "") & (F.length("line") <= short), F.regexp_replace("line", "[0-9]+", "#")))
    n = pages.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    often = lambda c: lines.where(F.col(c).isNotNull() & (F.col(c) != "")).groupBy("doc_id", c).agg(F.count_distinct("page").alias("on")).join(n, "doc_id").where((F.col("pages") >= least) & (F.col("on") >= threshold * F.col("pages"))).select("doc_id", c)
    kept = lines.join(often("line"), ["doc_id", "line"], "left_anti").join(often("shape"), ["doc_id", "shape"], "left_anti")
    texts = kept.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "raw"))), lambda x: x["raw"]), "\n").alias("page_text"))
    return pages.select("doc_id", "page").join(texts, ["doc_id", "page"], "left").withColumn("page_text", F.coalesce("page_text", F.lit("")))


def same_set(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_distinct(a)) == F.sort_array(F.array_distinct(b))


def ingest_plan(expected: DataFrame, existing: DataFrame) -> DataFrame:
    """(key, action) by a full outer join of expected (key, digest, tags) with existing (key, digest, embedded, tags):
    done, retag, embed or stale."""
    e, x = expected.alias("e"), existing.alias("x")
    done = F.col("x.embedded") & (F.col("e.digest") == F.col("x.digest"))
    action = F.when(F.col("e.key").isNull(), "stale").when(F.coalesce(done, F.lit(False)), F.when(same_set(F.col("e.tags"), F.col("x.tags")), "done").otherwise("retag")).otherwise("embed")
    return e.join(x, F.col("e.key") == F.col("x.key"), "full").select(F.coalesce("e.key", "x.key").alias("key"), action.alias("action"))


def line_shapes(lines: DataFrame, least: int = 4, top: int = 30, most: int = 60) -> DataFrame:
    """(shape, n): the most frequent line shapes, digits as #."""
    s = lines.select(F.regexp_replace(F.trim("line"), "[0-9]", "#").alias("shape")).where((F.col("shape") != "") & (F.length("shape") <= most))
    return s.groupBy("shape").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "shape").limit(top)


def overlapping(spans: DataFrame, passages: DataFrame) -> DataFrame:
    """(span, passage) that overlap in one book: spans and passages (id, book, s, e), as an equi join with a range."""
    a, b = spans.alias("a"), passages.alias("b")
    on = (F.col("a.book") == F.col("b.book")) & (F.col("a.s") <= F.col("b.e")) & (F.col("a.e") >= F.col("b.s"))
    return a.join(b, on).select(F.col("a.id").alias("span"), F.col("b.id").alias("passage"))
