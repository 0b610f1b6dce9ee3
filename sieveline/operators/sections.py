"""Text of scans and verses to sections and chunks: cleaning by neighbouring lines, headings, packing along sorted rows.

Lines are rows (doc, pos, line). Rules that look at neighbours are windows by document over the lines still there; sections
are running sums of headings. Packing is a stream over sorted partitions that carries a few numbers from row to row,
so that neither a document nor a book has to fit one row or one group."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import collapse, composed, count_tokens, format_ref, sanitize, strip_controls

#: Forms of a word, a heading with a numeral, a sentence end, a paragraph's own number, a caption's end.
WORD = r"^[“\"‘'(\[]*([A-Za-z][a-z’'-]*|[A-Z][A-Z’'-]*)[.,;:!?”\"’')\]]*$"
NUMBERED_HEADING = r"(?i)^(BOOK|CHAPTER|PART|SECTION)\s+[IVXLC0-9]+\.?$"
SENTENCE_END = r"(?<=[.!?”\"])\s+(?=[A-Z“\"])"
PARAGRAPH_NUMBER = r"^([0-9]{1,3})\.\s"
CAPTION_END, TAIL_END = r"[.!?”\"'’;:,)\]]$", r"[.!?”\"’]$"


def letters(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z]", "")


def letter_share(text: Column) -> Column:
    """Share of Latin letters among the characters that are no white space; 0 without any."""
    chars = F.length(F.regexp_replace(text, r"\s", ""))
    return F.when(chars == 0, 0.0).otherwise(F.length(letters(text)) / chars)


def word_share(text: Column) -> Column:
    """Share of a line's tokens that look like words."""
    tokens = F.split(F.trim(text), r"\s+")
    return F.size(F.filter(tokens, lambda t: t.rlike(WORD))) / F.size(tokens)


def capitals(text: Column, share: float) -> Column:
    """Whether a text has four letters or more, at least `share` of them capitals."""
    all_ = F.length(letters(text))
    return (all_ >= 4) & (F.length(F.regexp_replace(text, "[^A-Z]", "")) / F.greatest(all_, F.lit(1)) >= share)


def is_heading(line: Column) -> Column:
    """A short line mostly in capitals without closing mark, or a division's name with its numeral."""
    n, up = F.length(letters(line)), F.length(F.regexp_replace(line, "[^A-Z]", ""))
    mostly = (n >= 4) & (up / F.greatest(n, F.lit(1)) > 0.85) & ~F.regexp_replace(line, r"\.$", "").rlike(r"[.,;:]$")
    return F.length(line).between(1, 70) & (line.rlike(NUMBERED_HEADING) | mostly)


def title_case(heading: Column) -> Column:
    """Words of a heading in capitals get one capital each; numerals and mixed-case headings stay."""
    word = lambda w: F.when(w.rlike(r"^[IVXLC]+\.?$"), w).otherwise(F.concat(F.substring(w, 1, 1), F.lower(F.substring(w, 2, 2**30))))
    return F.when(heading.rlike("[a-z]"), heading).otherwise(F.array_join(F.transform(F.split(heading, " "), word), " "))


def line_lists(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, lines) of sanitised texts; line ends of any kind count. Null text has no row."""
    d = docs.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), strip_controls(F.col(text)).alias("__t"))
    return d.select("doc", F.split(F.regexp_replace(composed(F.col("__t")), r"\r\n?", "\n"), "\n").alias("lines"))


def lines_of(docs: DataFrame, doc: str = "doc_id", text: str = "text", dealt: bool = False) -> DataFrame:
    """(doc, pos, line) of line_lists. If dealt, texts are dealt out by document before they are cut, for windows over its lines."""
    d = line_lists(docs, doc, text)
    return (d.repartition("doc") if dealt else d).select("doc", F.posexplode("lines").alias("pos", "line"))


def trimmed_matter(lines: DataFrame, start_at: str | None, end_at: str | None) -> DataFrame:
    """Without what comes before a document's first line matching start_at, or from its first later line matching end_at on."""
    if start_at:
        first = lines.where(F.trim("line").rlike(start_at)).groupBy("doc").agg(F.min("pos").alias("__from"))
        lines = lines.join(first, "doc", "left").where(F.col("__from").isNull() | (F.col("pos") >= F.col("__from"))).drop("__from")
    if end_at:
        begin = lines.groupBy("doc").agg(F.min("pos").alias("__begin"))
        j = lines.where(F.trim("line").rlike(end_at)).join(begin, "doc").where(F.col("pos") > F.col("__begin"))
        lines = lines.join(j.groupBy("doc").agg(F.min("pos").alias("__to")), "doc", "left").where(F.col("__to").isNull() | (F.col("pos") < F.col("__to"))).drop("__to")
    return lines


def along() -> WindowSpec:
    """The lines of a document in order."""
    return W.partitionBy("doc").orderBy("pos")


def upto() -> WindowSpec:
    """Those up to the line itself."""
    return along().rowsBetween(W.unboundedPreceding, 0)


def blocks(lines: DataFrame) -> DataFrame:
    """Lines with `block`, the number of the run of lines without a blank one that a line is in."""
    blank = F.col("line") == ""
    fresh = ~blank & F.coalesce(F.lag(blank).over(along()), F.lit(True))
    return lines.withColumn("__new", fresh.cast("long")).withColumn("block", F.sum("__new").over(upto())).drop("__new")


def kept_capitals(lines: DataFrame, after: str) -> DataFrame:
    """Blank out blocks wholly in capitals, but for one that opens with a match and up to two of its title after it."""
    b = blocks(lines)
    head = F.min_by("line", "pos").rlike(after)
    t = b.where("line <> ''").groupBy("doc", "block").agg(head.alias("head"), (F.count_if(~capitals(F.col("line"), 0.7)) == 0).alias("caps"))
    w = W.partitionBy("doc").orderBy("block")
    back = lambda k: F.coalesce(F.lag(F.col("head") & F.col("caps"), k).over(w), F.lit(False))
    mid = F.coalesce(F.lag(F.col("caps") & ~F.col("head"), 1).over(w), F.lit(False))
    drop = F.col("caps") & ~F.col("head") & ~back(1) & ~(mid & back(2))
    t = t.select("doc", "block", drop.alias("__drop"))
    return b.join(t, ["doc", "block"], "left").withColumn("line", F.when(F.col("__drop") & (F.col("line") != ""), "").otherwise(F.col("line"))).drop("block", "__drop")


def rejoined(lines: DataFrame) -> DataFrame:
    """Words hyphenated over a line end come together: the next line's first word goes up, whatever it leaves there.

    A line that is one word and goes up has no end left to be joined; so in a run of such lines every other one joins."""
    line = F.col("line")
    opens, hyphen = line.rlike("^[a-z]"), line.rlike("[a-z]-$")
    lines = lines.withColumn("__up", F.lead(F.when(opens, F.split(line, " ", 2)[0])).over(along())).withColumn("__can", hyphen & F.col("__up").isNotNull())
    # hangs: whether it joins depends on the line before, since it would be used up by that line
    hangs = F.col("__can") & opens & (F.instr(line, " ") == 0) & F.coalesce(F.lag("__can").over(along()), F.lit(False))
    lines = lines.withColumn("__n", F.row_number().over(along())).withColumn("__hangs", hangs)
    anchor = F.max(F.when(~F.col("__hangs"), F.struct("__n", "__can"))).over(upto())
    even = (F.col("__n") - anchor["__n"]) % 2 == 0
    lines = lines.withColumn("__joins", F.when(F.col("__hangs"), F.when(anchor["__can"], even).otherwise(~even)).otherwise(F.col("__can")))
    lines = lines.withColumn("__gives", F.coalesce(F.lag("__joins").over(along()), F.lit(False)))
    rest = F.when(F.col("__gives"), F.when(F.instr(line, " ") == 0, "").otherwise(F.regexp_replace(line, "^[^ ]* ", ""))).otherwise(line)
    out = F.when(F.col("__joins"), F.concat(F.regexp_replace(rest, "-$", ""), F.col("__up"))).otherwise(rest)
    return lines.withColumn("line", out).drop("__up", "__can", "__n", "__hangs", "__joins", "__gives")


def clean_lines(
    lines: DataFrame, start_at: str | None = None, end_at: str | None = None, drop_lines: list[str] | None = None, inline: list[str] | None = None, strip: str | None = None,
    drop_paragraphs: str | None = None, keep_caps_after: str | None = None, drop_captions: bool = False, join_broken: bool = False, drop_garbage: bool = False,
) -> DataFrame:
    """(doc, pos, line) cleaned: front and back matter, page numbers, furniture and scan debris go, blank lines stay.

    Defined results: null lines are blank; a paragraph whose first line matches drop_paragraphs goes whole; captions are
    single lines between blanks without a closing mark; join_broken takes out a blank line in the middle of a sentence."""
    lines = lines.withColumn("line", F.coalesce("line", F.lit("")))
    lines = trimmed_matter(lines, start_at, end_at)
    if drop_paragraphs:
        b = blocks(lines.withColumn("__raw", F.col("line")).withColumn("line", F.trim("line")))
        wrong = b.where("line <> ''").groupBy("doc", "block").agg(F.min_by("line", "pos").alias("__first")).where(F.col("__first").rlike(drop_paragraphs)).select("doc", "block", F.lit(True).alias("__wrong"))
        lines = b.join(wrong, ["doc", "block"], "left").where((F.col("line") == "") | F.col("__wrong").isNull()).withColumn("line", F.col("__raw")).drop("block", "__raw", "__wrong")
    line = F.col("line")
    for pattern in [strip] if strip else []:
        line = F.regexp_replace(line, pattern, "")
    for pattern in inline or []:
        line = F.regexp_replace(line, pattern, " ")
    lines = lines.withColumn("line", collapse(line))
    bad = F.col("line").rlike("^[0-9]+$") | ((F.length("line") < 40) & (letter_share(F.col("line")) < 0.6))
    for pattern in drop_lines or []:
        bad = bad | F.col("line").rlike(pattern)
    if drop_garbage:
        bad = bad | (word_share(F.col("line")) < 0.5)
    # behind a window the test reads the line as it is made; before it, every mention of the line would make it anew
    lines = lines.withColumn("__n", F.row_number().over(along())).where((F.col("__n") > 0) & ((F.col("line") == "") | ~bad)).drop("__n")
    if keep_caps_after:
        lines = kept_capitals(lines, keep_caps_after)
    if drop_captions:
        alone = (F.coalesce(F.lag("line").over(along()), F.lit("")) == "") & (F.coalesce(F.lead("line").over(along()), F.lit("")) == "") & F.col("line").rlike("[a-z]")
        size = F.length("line")
        caption = F.when(F.col("line").rlike("^[A-Z]"), (size < 100) & ~F.col("line").rlike(CAPTION_END)).otherwise((size < 60) & ~F.col("line").rlike(TAIL_END))
        lines = lines.withColumn("__caption", alone & caption).withColumn("line", F.when(F.col("__caption"), "").otherwise(F.col("line"))).drop("__caption")
    if join_broken:
        runs_on = F.lag("line").over(along()).rlike("[a-z,;-]$") & F.lead("line").over(along()).rlike("^[\"“]?[a-z]")
        lines = lines.withColumn("__broken", F.coalesce(runs_on, F.lit(False))).where((F.col("line") != "") | ~F.col("__broken")).drop("__broken")
    return rejoined(lines)


def to_sections(lines: DataFrame, default_heading: str) -> DataFrame:
    """(doc, section, heading, para, text): paragraphs of cleaned lines under the heading before them, by running sums.

    Section 0 is what comes before the first heading; a heading without a paragraph makes none."""
    lines = lines.withColumn("__head", is_heading(F.col("line")))
    ends = (F.col("line") == "") | F.col("__head")
    lines = lines.withColumn("section", F.sum(F.col("__head").cast("long")).over(upto())).withColumn("__para", F.sum(ends.cast("long")).over(upto()))
    # the last heading so far is the section's: no second reading of the lines to look it up
    lines = lines.withColumn("heading", F.last(F.when(F.col("__head"), F.col("line")), ignorenulls=True).over(upto()))
    text = collapse(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " "))
    paras = lines.where(~ends).groupBy("doc", "section", "__para").agg(F.first("heading").alias("heading"), text.alias("text"))
    para = F.row_number().over(W.partitionBy("doc", "section").orderBy("__para"))
    return paras.select("doc", "section", F.coalesce("heading", F.lit(default_heading)).alias("heading"), para.cast("long").alias("para"), "text")


def packed(rows: DataFrame, by: list[str], order: list[str], tokens: Column, target: int, may_break: Column | None = None, must_break: Column | None = None, min_fill: float = 0.5) -> DataFrame:
    """rows with `chunk`, counted from 0 in each group: a row that would pass the target opens a new chunk.

    So does one that may break where the chunk has min_fill of the target, and one that must. The rows of a group are read
    in order by one task as a stream; all it keeps is the group's key, the chunk's number and its tokens."""
    schema = T.StructType([*rows.schema.fields, T.StructField("chunk", T.LongType())])
    no, names = F.lit(False), rows.columns
    d = rows.withColumn("__by", F.to_json(F.struct(*by), {"ignoreNullFields": "false"})).withColumn("__t", tokens.cast("long"))
    d = d.withColumn("__may", F.coalesce(may_break, no) if may_break is not None else no).withColumn("__must", F.coalesce(must_break, no) if must_break is not None else no)
    d = d.repartition("__by").sortWithinPartitions("__by", *order)
    least = target * min_fill

    def run(batches):  # columns of the rows themselves pass as they are
        key, chunk, total, size = None, 0, 0, 0
        for b in batches:
            out = []
            for k, t, may, must in zip(*(b.column(c).to_pylist() for c in ("__by", "__t", "__may", "__must"))):
                if k != key:
                    key, chunk, total, size = k, 0, 0, 0
                elif size and (total + t > target or (may and total >= least) or must):
                    chunk, total, size = chunk + 1, 0, 0
                total, size = total + t, size + 1
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, pa.int64())], names=[*names, "chunk"])

    return d.mapInArrow(run, schema)


def joined(value: str, order: list[str], sep: str) -> Column:
    """Aggregate: values in order, joined."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("__v")))), lambda x: x["__v"]), sep)


def chunk_verses(verses: DataFrame, target: int = 600, min_fill: float = 0.5) -> DataFrame:
    """(book, chunk, ref, chapter_start, verse_start, verse_end, content, tokens) of verses (book, name, pos, chapter, verse,
    text, paragraph_start, heading): whole verses up to the target, a new chunk at a heading or, half full, at a paragraph."""
    d = packed(verses.where(F.col("text").isNotNull()), ["book"], ["pos"], count_tokens(F.col("text")), target, F.col("paragraph_start"), F.col("heading").isNotNull(), min_fill)
    at = F.struct("chapter", "verse")
    d = d.groupBy("book", "chunk").agg(
        F.min_by("name", "pos").alias("name"), F.min_by(at, "pos").alias("a"), F.max_by(at, "pos").alias("z"),
        F.min_by("heading", F.when(F.col("heading") != "", F.col("pos"))).alias("heading"), joined("text", ["pos"], " ").alias("body"),
    )
    ref = format_ref(F.col("name"), F.col("a.chapter"), F.col("a.verse"), F.col("z.chapter"), F.col("z.verse"))
    content = F.concat(ref, F.coalesce(F.concat(F.lit(" — "), "heading"), F.lit("")), F.lit("\n\n"), sanitize(F.col("body")))
    d = d.select("book", "chunk", ref.alias("ref"), F.col("a.chapter").alias("chapter_start"), F.col("a.verse").alias("verse_start"), F.when(F.col("a.chapter") == F.col("z.chapter"), F.col("z.verse")).alias("verse_end"), content.alias("content"))
    return d.withColumn("tokens", count_tokens(F.col("content")))


def chunk_sections(sections: DataFrame, prefix: Column, target: int = 600, numbers: bool = False) -> DataFrame:
    """(doc, section, chunk, ref, content, tokens) of to_sections' rows; a chunk never spans two sections.

    Paragraphs under 20 characters or three quarters of letters go; those above the target are cut at sentence ends. Chunks of
    a section are named "(part n)", or with `numbers` by the paragraphs' own numbers ("§2–4"), a name used again by its part."""
    p = sections.where((F.length("text") >= 20) & (letter_share(F.col("text")) >= 0.75))
    units = F.when(count_tokens(F.col("text")) <= target, F.array("text")).otherwise(F.split("text", SENTENCE_END))
    u = p.select("doc", "section", "heading", "para", F.posexplode(units).alias("unit", "text"))
    u = packed(u, ["doc", "section"], ["para", "unit"], count_tokens(F.col("text")), target)
    head = F.when(F.col("heading") == "", prefix).otherwise(F.concat(prefix, F.lit(", "), title_case(F.col("heading"))))
    own = F.when(F.lit(numbers), F.nullif(F.regexp_extract("text", PARAGRAPH_NUMBER, 1), F.lit("")).cast("long"))
    w = W.partitionBy("doc", "section")
    u = u.withColumn("__head", head).withColumn("__n", own).withColumn("__numbered", F.coalesce(F.max("__n").over(w).isNotNull(), F.lit(False)))
    u = u.withColumn("__no", F.greatest(F.lit(1), F.max("__n").over(w.orderBy("para", "unit").rowsBetween(W.unboundedPreceding, 0))))
    place = F.struct("para", "unit")
    c = u.groupBy("doc", "section", "chunk").agg(F.min_by("__head", place).alias("head"), F.first("__numbered").alias("numbered"), F.min_by("__no", place).alias("lo"), F.max_by("__no", place).alias("hi"), joined("text", ["para", "unit"], "\n\n").alias("body"))
    span = F.concat("head", F.lit(" §"), F.col("lo").cast("string"), F.when(F.col("hi") > F.col("lo"), F.concat(F.lit("–"), F.col("hi").cast("string"))).otherwise(""))
    part = F.when(F.col("chunk") > 0, F.concat("head", F.lit(" (part "), (F.col("chunk") + 1).cast("string"), F.lit(")"))).otherwise(F.col("head"))
    c = c.withColumn("ref", F.when(F.col("numbered"), span).otherwise(part))
    again = F.row_number().over(W.partitionBy("doc", "section", "ref").orderBy("chunk"))
    c = c.withColumn("__again", again).withColumn("ref", F.when(F.col("__again") > 1, F.concat("ref", F.lit(" (part "), F.col("__again").cast("string"), F.lit(")"))).otherwise(F.col("ref")))
    content = F.concat("ref", F.lit("\n\n"), "body")
    return c.select("doc", "section", "chunk", "ref", content.alias("content"), count_tokens(content).alias("tokens"))
