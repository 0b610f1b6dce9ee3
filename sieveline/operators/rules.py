"""Sections of scanned texts by rules: numbered chapters read from worn numerals, running heads, first words.

What a line may be (a numeral and its readings, a title in capitals, a running head) is said by column expressions. Whether a
numeral counts depends on the chapter before it, so the lines of a document pass in order through a stream over sorted partitions
that carries the last number, the running context and the open heading. Paragraphs and names are grouped after it."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import collapse
from .reports import ONES, TENS, from_roman
from .sections import capitals, joined, title_case

#: How far a chapter's number may run ahead of the one before it, by the rule's name; the first lone numeral may be 10.
AHEAD = {"loneNumeral": 5, "romanChapterStart": 3, "numberedChapter": 6}
FIRST_LONE = 10
NAMES = ("firstWords", "contextFirstWords", "contextCounter", "contextLine", "chapterNumeral", *AHEAD)


@dataclass(frozen=True)
class Rule:
    """How sections begin. Patterns are Java's; section_start's group 1 is a numeral, group 2 of numberedChapter the title.

    running_title (group 1) opens a section when it changes; running_context (group 1, mapped by context_label) names what follows."""

    name: str = "firstWords"
    section_start: str | None = None
    running_title: str | None = None
    running_context: str | None = None
    context_label: Callable[[Column], Column] | None = None
    title_group: int = 0
    label: str = "Chapter"
    title_ends_with_period: bool = False

    def __post_init__(self):
        if self.name not in NAMES:
            raise ValueError(f"no rule is named {self.name}")
        if self.running_title and self.section_start and self.name in ("firstWords", "contextFirstWords"):
            raise ValueError("sections are named by running titles or by first words, not by both")


def numeral(n: int) -> str:
    """Roman numeral with C as its largest sign."""
    return "C" * (n // 100) + TENS[n // 10 % 10] + ONES[n % 10]


def numeral_readings(raw: Column) -> Column:
    """Numbers a worn numeral may stand for, in order of preference: x, i and l are each a sign or a smudge, Y is V and T is I.

    A number may come more than once; none if nothing can be read."""
    t = F.translate(F.regexp_replace(raw, r"[\s.§]", ""), "YT", "VI")
    sign = {"x": "X", "i": "I", "l": "I"}

    def reading(smudges: int) -> Column:
        kept = [c for k, c in enumerate(sign) if not smudges >> k & 1]
        gone = [c for c in sign if c not in kept]
        return F.translate(t, "".join(kept + gone), "".join(sign[c] for c in kept))

    return F.filter(F.transform(F.array(*[reading(k) for k in range(8)]), from_roman), lambda n: n > 0)


def capitals_title(text: Column) -> Column:
    """A title in capitals with one capital for each word, without marks at its end."""
    words = F.split(F.regexp_replace(F.lower(text), r"[\s.,;:]+$", ""), r"(?<=[\s(\[“\"-])")
    first = lambda w: F.when(w.rlike("^[a-z]"), F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2**30))).otherwise(w)
    return F.array_join(F.transform(words, first), "")


def short_title(heading: Column, most: int = 90) -> Column:
    """A heading of at most `most` characters, cut at a word."""
    return F.when(F.length(heading) <= most, heading).otherwise(F.concat(F.regexp_replace(F.substring(heading, 1, most), r"[\s,.;:]+\S*$", ""), F.lit("…")))


def first_words(text: Column, n: int = 8) -> Column:
    words = F.array_join(F.slice(F.split(F.regexp_replace(text, "^[“\"'\\s]+", ""), r"\s+"), 1, n), " ")
    return F.concat(F.lit("“"), F.regexp_replace(words, "[,;:.]+$", ""), F.lit("…”"))


def line_facts(lines: DataFrame, rule: Rule) -> DataFrame:
    """Lines with what each may be: start, numbers, rest, title, more (a title's next line in capitals), context, head."""
    line, none = F.col("line"), F.lit(None).cast("string")
    start, numbers, rest, title, more = F.lit(False), F.lit(None).cast("array<int>"), none, none, none
    group = lambda k: F.regexp_extract(line, rule.section_start, k)
    if rule.section_start:
        start = line.rlike(rule.section_start)
        if rule.name == "chapterNumeral":
            numbers = numeral_readings(F.regexp_replace(line, r"^\S+\s+", ""))
        elif rule.name in ("loneNumeral", "romanChapterStart"):
            numbers = numeral_readings(group(1))
            rest = F.trim(F.substring(line, F.length(group(0)) + 1, F.lit(2**30)))
        elif rule.name == "numberedChapter":
            start = start & capitals(group(2), 0.7)
            numbers, title = F.array(F.regexp_replace(group(1), "[iIl]", "1").try_cast("int")), capitals_title(group(2))
        elif rule.name == "contextLine":
            raw = F.coalesce(F.nullif(group(rule.title_group), F.lit("")), line) if rule.title_group else line
            plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"\.--", " — "), r"\.$", ""), "([a-z])- ([a-z])", "$1$2")
            title = short_title(title_case(plain))
        if rule.name == "loneNumeral":
            more = F.when(capitals(line, 0.7), capitals_title(F.regexp_replace(line, r"^\d+\s+", "")))
        elif rule.name == "numberedChapter":
            more = F.when(capitals(line, 0.7) & (F.length(line) < 70), capitals_title(line))
    context = head = none
    if rule.running_context:
        said = F.regexp_extract(line, rule.running_context, 1)
        context = F.when(line.rlike(rule.running_context), rule.context_label(said) if rule.context_label else title_case(F.trim(said)))
    if rule.running_title:
        said = F.regexp_replace(F.regexp_extract(line, rule.running_title, 1), r"[\s.•·-]+$", "")
        head = F.when(line.rlike(rule.running_title), title_case(F.trim(said)))
    on = lambda c: F.when(start, c)
    return lines.select("doc", "pos", "line", start.alias("start"), on(numbers).alias("numbers"), on(rest).alias("rest"), on(title).alias("title"), more.alias("more"), context.alias("context"), head.alias("head"))


class _Walk:
    """What is known after the lines of a document so far."""

    def __init__(self, rule: Rule, heading: str):
        self.rule, self.default, self.heading = rule, heading, heading
        self.section = self.para = self.counter = 0
        self.context, self.titling, self.open = "", False, False

    def row(self, text=None, heading=None, closing=None):
        return (self.section, self.para, text, self.context, heading, closing)

    def blank(self):
        self.para, self.open = self.para + self.open, False

    def begin(self, heading, closing=None):
        self.section, self.para, self.open, self.heading = self.section + 1, 0, False, heading
        return self.row(None, heading, closing)

    def read(self, numbers) -> int:
        """The reading that goes on counting, else the first; a numeral that cannot be read goes on too."""
        following = self.counter + 1
        return following if following in numbers or not len(numbers) else int(numbers[0])

    def chapter(self, n: int, title):
        """Opens chapter n; the section before takes the numbers that were lost between."""
        name, old = self.rule.name, None
        if 0 < self.counter < n - 1:
            upto = str(n - 1) if name == "numberedChapter" else numeral(n - 1)
            form, by = (r"^(\S+) (\S+?):", rf"\g<1>s \g<2>–{upto}:") if name == "loneNumeral" else (r"^Chapter (\d+)" if name == "numberedChapter" else r"^Chapter (\S+)", rf"Chapters \g<1>–{upto}")
            old = re.sub(form, by, self.heading, count=1)
        self.counter, self.titling = n, name != "romanChapterStart"
        return self.begin({"loneNumeral": f"{self.rule.label} {numeral(n)}:", "romanChapterStart": f"Chapter {numeral(n)}", "numberedChapter": f"Chapter {n}: {title}"}[name], old)

    def lengthened(self, more: str):
        broken = re.search("[A-Za-z]-$", self.heading)
        self.heading = self.heading[:-1] + more[:1].lower() + more[1:] if broken else f"{self.heading} {more}"

    def shortened(self):
        self.titling = False
        if self.rule.name == "loneNumeral" and len(self.heading) > 90:
            self.heading = re.sub(r"[\s,.;:]+\S*$", "", self.heading[:90]) + "…"

    def line(self, line, start, numbers, rest, title, more, context, head):
        """Rows that a line which is not blank gives rise to."""
        name = self.rule.name
        if name in AHEAD and self.rule.section_start:
            if start:
                n = (int(numbers[0]) if numbers[0] is not None and numbers[0] == numbers[0] else 0) if name == "numberedChapter" else self.read(numbers)
                if self.counter < n <= self.counter + (FIRST_LONE if name == "loneNumeral" and not self.counter else AHEAD[name]):
                    yield self.chapter(n, title)
                    if name == "romanChapterStart":
                        self.open = True
                        yield self.row(rest)
                    return
            if self.titling:
                if more is not None and not self.open:
                    self.lengthened(more)
                    if self.rule.title_ends_with_period and re.search(r"\.\s*$", line):
                        self.shortened()
                    yield self.row(None, self.heading)
                    return
                self.shortened()
                yield self.row(None, self.heading)
        if context is not None:
            if context != self.context:
                self.context, self.counter = context, 0
            yield self.row()
        elif head is not None:
            if head != self.heading:
                yield self.begin(head)
        elif start and name not in AHEAD:
            if name == "chapterNumeral":
                self.counter = self.read(numbers)
                title = f"Chapter {numeral(self.counter)}"
            elif name == "contextCounter":
                self.counter += 1
                yield self.begin(f"{self.context or self.default}, entry {self.counter}")
                return
            elif name != "contextLine":
                yield self.begin((self.context if name == "contextFirstWords" else "") or self.default)
                return
            yield self.begin(f"{self.context}, {title}" if self.context else title)
        else:
            self.open = True
            yield self.row(line)


def ruled_sections(lines: DataFrame, rule: Rule, default_heading: str) -> DataFrame:
    """(doc, section, heading, para, text): paragraphs of cleaned lines (doc, pos, line) under the headings that a rule finds.

    Defined results: null lines are blank, section 0 is what comes before the first heading, sections without a paragraph make
    no row. A document's lines pass through one task as a stream; of a text only the open heading is kept there."""
    d = line_facts(lines.withColumn("line", F.coalesce("line", F.lit(""))), rule)
    facts = ["line", "start", "numbers", "rest", "title", "more", "context", "head"]
    d = d.withColumn("__key", F.coalesce(F.concat(F.lit("="), F.col("doc").cast("string")), F.lit("null"))).drop("doc")
    d = d.repartition("__key").sortWithinPartitions("__key", "pos")
    made = [("section", T.LongType()), ("para", T.LongType()), ("text", T.StringType()), ("context", T.StringType()), ("heading", T.StringType()), ("closing", T.StringType())]
    schema = T.StructType([T.StructField("__key", T.StringType()), T.StructField("pos", T.LongType()), *[T.StructField(n, t) for n, t in made]])

    def run(frames):
        key, walk = None, None
        for pdf in frames:
            out = []
            for k, pos, *said in zip(pdf["__key"], pdf["pos"], *[pdf[c] for c in facts]):
                if k != key:
                    key, walk = k, _Walk(rule, default_heading)
                if said[0] == "":
                    walk.blank()
                else:
                    out += [(k, pos, *r) for r in walk.line(*said)]
            yield pd.DataFrame(out, columns=schema.names)

    walked = d.mapInPandas(run, schema)
    updates = F.array(F.struct("section", F.col("heading").alias("h")), F.struct((F.col("section") - 1).alias("section"), F.col("closing").alias("h")))
    heads = walked.select("__key", "pos", F.explode(updates).alias("x")).select("__key", "pos", "x.*").where("h is not null")
    heads = heads.groupBy("__key", "section").agg(F.max_by("h", "pos").alias("heading"))
    paras = walked.groupBy("__key", "section", "para").agg(F.count("text").alias("n"), joined("text", ["pos"], " ").alias("text"), F.max_by("context", "pos").alias("context")).where("n > 0")
    out = paras.withColumn("text", collapse(F.col("text"))).join(heads, ["__key", "section"], "left").withColumn("heading", F.coalesce("heading", F.lit(default_heading)))
    w = W.partitionBy("__key", "section")
    if rule.name in ("firstWords", "contextFirstWords"):
        prose = (F.length("text") > 20) & F.col("text").rlike("^[“\"]?[A-Z]{2,}\\b") & (F.col("section") > 0)
        words = first_words(F.col("text"))
        if rule.name == "contextFirstWords":
            words = F.when(F.col("context") != "", F.concat("context", F.lit(" — "), words)).otherwise(words)
        out = out.withColumn("heading", F.coalesce(F.min_by(F.when(prose, words), F.when(prose, F.col("para"))).over(w), F.col("heading")))
    doc = F.when(F.col("__key") != "null", F.substring("__key", 2, 2**30)).cast(lines.schema["doc"].dataType).alias("doc")
    return out.select(doc, "section", "heading", F.row_number().over(w.orderBy("para")).cast("long").alias("para"), "text")
