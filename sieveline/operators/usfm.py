"""Scripture with backslash markers to rows of verses, by running counts over marker segments.

A text is cut before every block marker; segments are rows (doc, pos, marker, rest). What a segment belongs to follows from
how many markers of a kind stand before it: verses are runs after a verse marker up to the next marker that ends one, text
before a verse is its preface. All windows are by document and the verse texts are grouped sums, so no parser holds a book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The format's block markers, those of paragraphs and poetry, and those whose text is no verse text.
BLOCKS = r"c|v|s\d?|ms\d?|mr|sr|r|d|sp|cl|mt\d?|mte\d?|toc\d|h|id|ide|rem|usfm|sts|periph|p|m|pi\d?|mi|nb|pc|pm|pmo|pmc|pmr|ph\d?|q\d?|qc|qr|qa|qm\d?|li\d?|b|ie|ip|is\d?|imt\d?"
PARAGRAPHS = r"^(p|m|pi\d?|mi|nb|pc|pm|pmo|pmc|pmr|ph\d?|q\d?|qc|qr|qm\d?|li\d?|b)$"
SKIPPED = r"^(ms\d?|mr|sr|r|sp|cl|mt\d?|mte\d?|toc\d|h|id|ide|rem|usfm|sts|periph|qa|ie|ip|is\d?|imt\d?)$"
#: Fixed value: note markers, whose text goes with them.
NOTES = ("f", "fe", "x")
#: Fixed value: books around the scripture itself.
PERIPHERAL = ["FRT", "BAK", "OTH", "INT", "CNC", "GLO", "TDX", "NDX", "TOC"]


def without_notes(text: Column, over_lines: bool = False) -> Column:
    for n in NOTES:
        text = F.regexp_replace(text, ("(?s)" if over_lines else "") + rf"\\{n}\s.*?\\{n}\*", "")
    return text


def clean_inline(text: Column) -> Column:
    """Text of a run of markup: notes go, words lose their attributes, character styles keep their content."""
    t = F.regexp_replace(without_notes(text), r"\\\+?w\s([^|\\]*?)(\|[^\\]*)?\\\+?w\*", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"\\\+?[a-z]+\d?\*", ""), r"\\\+?[a-z]+\d?(\s|$)", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def marked_segments(books: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, code, pos, marker, rest, kind) of marked-up texts; those without a book code (and null ones) go."""
    d = books.select(F.col(doc).alias("doc"), F.col(text).alias("__t")).repartition("doc")
    t = F.col("__t")
    code = F.nullif(F.regexp_extract(t, r"(?m)^\\id\s+([0-9A-Z]{3})", 1), F.lit(""))
    body = F.regexp_replace(without_notes(F.regexp_replace(t, r"\r\n?", "\n"), True), r"\n", " ")
    d = d.select("doc", code.alias("code"), F.posexplode(F.split(body, rf"(?=\\(?:{BLOCKS})(?=\s|$))")).alias("pos", "seg")).where(F.col("code").isNotNull())
    form = r"(?s)^\\([a-z]+\d?)(?:\s+(.*))?$"
    marker = F.when(F.col("seg").rlike(form), F.regexp_extract("seg", form, 1))
    rest = F.trim(F.regexp_extract("seg", form, 2))
    d = d.withColumn("marker", marker).withColumn("rest", rest)
    kind = (
        F.when(F.col("marker").isNull(), "text").when(F.col("marker") == "c", "chapter").when((F.col("marker") == "v") & F.col("rest").rlike(r"^\d+"), "verse").when(F.col("marker") == "v", "end")
        .when(F.col("marker") == "d", "title").when(F.col("marker").rlike(r"^s\d?$"), "heading").when(F.col("marker").rlike(PARAGRAPHS), "paragraph").when(F.col("marker").rlike(SKIPPED), "skipped").otherwise("text")
    )
    return d.withColumn("kind", kind)


def verses(books: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, code, pos, chapter, verse, text, paragraph_start, heading) of marked-up texts.

    A bridge of verses counts as its first. Titles of psalms and text before a verse go to the verse after them, if no
    chapter begins between. A verse without text goes, with its heading. paragraph_start: a chapter, heading or paragraph marker
    stands between it and the verse before, or there is none before. Numbers of more than nine digits are null."""
    upto = W.partitionBy("doc").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    count = lambda cond: F.sum(cond.cast("long")).over(upto)
    kind = F.col("kind")
    d = marked_segments(books, doc, text)  # dealt out by document before they are cut
    d = d.withColumn("c", count(kind == "chapter")).withColumn("v", count(kind == "verse")).withColumn("run", count(kind.isin("chapter", "verse", "end", "title", "heading")))
    inside = F.max(F.when(kind == "verse", F.col("run"))).over(upto)
    d = d.withColumn("open", F.coalesce(inside == F.col("run"), F.lit(False)))
    chapter = F.last(F.when(kind == "chapter", F.regexp_extract("rest", r"^(\d{1,9})(?:\s|$)", 1).try_cast("int")), ignorenulls=True).over(upto)
    d = d.withColumn("chapter", F.coalesce(chapter, F.lit(0)))
    rows = lambda when, *cols: F.sort_array(F.collect_list(F.when(when, F.struct("pos", *cols))))
    text_of = lambda found: F.array_join(F.transform(found, lambda s: s["x"]), " ")
    piece = F.when(kind == "verse", F.regexp_extract("rest", r"(?s)^\d+(?:-\d+)?\s*(.*)$", 1)).when(kind == "paragraph", F.col("rest")).when(kind == "text", F.col("seg"))
    first = kind == "verse"
    number = F.regexp_extract("rest", r"^(\d+)", 1).try_cast("int")
    # a row per verse, with what stands after it and before the next one; both come from one reading of the segments
    g = d.groupBy("doc", "v").agg(
        F.max(F.when(first, F.struct("code", "pos", "c", "chapter", number.alias("verse")))).alias("a"), rows(F.col("open") & piece.isNotNull(), piece.alias("x")).alias("body"),
        rows(~F.col("open") & kind.isin("title", "paragraph"), F.col("rest").alias("x"), F.col("c")).alias("lead"),
        F.max(kind.isin("chapter", "heading", "paragraph")).alias("fresh"), F.max(F.when(kind == "heading", F.struct("pos", "rest")))["rest"].alias("h"),
    )
    before = F.lag(F.struct("lead", "fresh", "h")).over(W.partitionBy("doc").orderBy("v"))
    j = g.select("doc", "v", "a.*", text_of(F.col("body")).alias("body"), before.alias("b")).where("v > 0")
    lead = text_of(F.filter("b.lead", lambda s: s["c"] == F.col("c")))
    j = j.withColumn("lead", F.coalesce(lead, F.lit("")))
    head = F.when(F.trim("lead") != "", F.concat(clean_inline(F.col("lead")), F.lit(" "))).otherwise("")
    out = j.withColumn("text", clean_inline(F.concat(head, "body"))).where("text <> ''")
    return out.select("doc", "code", "pos", "chapter", "verse", "text", (F.coalesce("b.fresh", F.lit(False)) | (F.col("v") == 1)).alias("paragraph_start"), F.nullif(clean_inline(F.col("b.h")), F.lit("")).alias("heading"))
