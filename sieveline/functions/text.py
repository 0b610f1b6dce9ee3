"""Text functions as column expressions (and two small Arrow functions where Spark has no built-in)."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words without signal in a question.
STOPWORDS = """a about above after again all also am an and any are as at be because been before being below between both
but by can cannot could did do does doing done down during each few for from further had has have having he her here
hers him his how i if in into is it its itself just may me might more most must my no nor not of off on once only or
other ought our ours out over own same shall she should so some such than that the their theirs them then there these
they this those through to too under until up very was we were what when where which while who whom why will with would
you your yours according describe explain given list many much state used using within""".split()

# Capitalised words that name nothing.
ENTITY_STOPWORDS = """The This That These Those A An And But Or If When While For From With Without All Any Each Every No Not
In On At To By As It Its We You They He She There Here Page Section Table Figure Note Notes Appendix Chapter Part Article
Item Where What Which Who How Why Then Than Also Such Both Either Neither Per Via Are Is Was Were Be Been Has Have Had Will
Shall May Must Should However Therefore Thus Hence Moreover Furthermore Additionally Similarly Consequently Nevertheless
Nonetheless Specifically Notably Importantly Interestingly Finally First Firstly Second Secondly Third Thirdly Fourth Fifth
Lastly Next Overall Instead Meanwhile Although Though Since Because Given Unlike Whereas Indeed Recently Currently
Previously Following During After Before Above Below Now Once Further Rather Together Alternatively Conversely Accordingly
Subsequently Abstract Introduction Background Method Methods Methodology Approach Experiments Experiment Evaluation Results
Result Discussion Conclusion Conclusions References Acknowledgments Acknowledgements Related Work Limitations
Appendices""".split()

#: Forms of names. Word boundaries count ASCII letters only, which Java's \\b does not.
ENTITY_PHRASE = r"(?<![A-Za-z0-9_])[A-Z][a-zA-Z0-9'-]+(?:\s+[A-Z][a-zA-Z0-9'-]+)*"
ACRONYM = r"(?<![A-Za-z0-9_])[A-Z]{2,}(?:-[A-Z0-9]+)?(?![A-Za-z0-9_])"


def _strings(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def stem(term: Column) -> Column:
    """Light plural stemming; digits and short terms stay. Ends are compared instead of matched: most terms have no s there."""
    cut = lambda k: F.substr(term, F.lit(1), F.length(term) - k)
    return (
        F.when(~term.endswith("s") | (F.length(term) <= 3), term)
        .when(term.endswith("ies") & ~F.substring(term, -4, 1).isin("a", "e", "i", "o", "u"), F.concat(cut(3), F.lit("y")))
        .when(term.endswith("ss") | term.endswith("us") | term.endswith("is"), term)
        .otherwise(cut(1))
    )


def lower_words(text: Column) -> Column:
    """Array of the lower-cased alphanumeric runs of a text; its ends may be empty strings."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")


def tells(word: Column) -> Column:
    """Whether a word of lower_words is a term: two letters or more and no stopword."""
    return (F.length(word) >= 2) & ~word.isin(STOPWORDS)


def content_terms(text: Column) -> Column:
    """Array of a text's content terms, stemmed; repeats stay. Over tables, term_rows explodes first and is faster."""
    return F.transform(F.filter(lower_words(text), tells), stem)


def count_tokens(text: Column) -> Column:
    """Quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def paragraphs(text: Column) -> Column:
    """Parts between blank lines, white space collapsed, empty ones dropped."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), collapse), lambda p: p != "")


def sentences(text: Column) -> Column:
    """Parts that end in . ! or ? before white space."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def segments(text: Column, target: int) -> Column:
    """Paragraphs, those above the target cut into sentences."""
    return F.flatten(F.transform(paragraphs(text), lambda p: F.when(count_tokens(p) <= target, F.array(p)).otherwise(sentences(p))))


def strip_controls(text: Column) -> Column:
    """Text without C0 controls except tab, line feed and carriage return."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode composition, for which Spark has no built-in."""
    return text.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


@cache
def unsettled() -> str:
    """Pattern of a character that composition may change: it is not composed, is a combining mark or comes second in a pair.

    A text without any is composed already (Unicode's quick check). Letters below U+0300 are looked at no further."""
    second = {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
    held = set()
    for c in map(chr, range(0x300, sys.maxunicode + 1)):
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and parts[0][0] != "<":
            second.add(chr(int(parts[1], 16)))
        if unicodedata.combining(c) or (parts and not 0xD800 <= ord(c) < 0xE000 and not unicodedata.is_normalized("NFC", c)):
            held.add(c)
    runs: list[list[int]] = []
    for c in sorted(map(ord, held | second)):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return r"(?=[^\x00-\u02FF])[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in runs) + "]"


def composed(text: Column) -> Column:
    """Text in Unicode composition; only one that it may change goes through Python."""
    return F.coalesce(nfc(F.when(text.rlike(unsettled()), text)), text)


def sanitize(text: Column) -> Column:
    return strip_controls(composed(text))


def entity_mentions(text: Column) -> Column:
    """Array of entity mentions: capitalised phrases without stopwords, then acronyms; repeats stay."""
    stop = _strings(ENTITY_STOPWORDS)
    phrases = F.filter(F.regexp_extract_all(text, F.lit(ENTITY_PHRASE), F.lit(0)), lambda p: F.length(p) >= 4)
    named = F.transform(phrases, lambda p: F.array_join(F.filter(F.split(p, r"\s+"), lambda w: ~F.array_contains(stop, w)), " "))
    short = F.filter(F.regexp_extract_all(text, F.lit(ACRONYM), F.lit(0)), lambda p: ~F.array_contains(stop, p))
    return F.concat(F.filter(named, lambda p: p != ""), short)


def citations(answer: Column) -> Column:
    """Array of (marker, sentence) of every [n] in the answer; the sentence has its markers removed.

    A number beyond an int becomes the largest one, which no list of sources reaches."""
    per = F.transform(
        sentences(answer),
        lambda s: F.transform(
            F.regexp_extract_all(s, F.lit(r"\[([0-9]+)\]"), F.lit(1)),
            lambda m: F.struct(F.coalesce(m.try_cast("int"), F.lit(2**31 - 1)).alias("marker"), F.trim(F.regexp_replace(s, r"\s*\[[0-9]+\]", "")).alias("sentence")),
        ),
    )
    return F.flatten(per)


def html_to_plain(html: Column) -> Column:
    """Text of markup: scripts and tags out, common entities decoded, white space collapsed."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)<br\s*/?>|</p>|</div>|</li>", " "), r"<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return collapse(t)


def slug(title: Column, most: int = 60) -> Column:
    s = F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-")
    return F.regexp_replace(F.substr(F.regexp_replace(s, "^-+|-+$", ""), F.lit(1), F.lit(most)), "-+$", "")


#: Ethiopic homophone letters and the letters they fold to, eight to a row.
_FOLDS = [(0x1210, 0x1200), (0x1280, 0x1200), (0x1220, 0x1230), (0x12D0, 0x12A0), (0x1340, 0x1338)]


def fold_ethiopic(text: Column) -> Column:
    """Letters that sound alike become one."""
    pairs = [(chr(a + k), chr(b + k)) for a, b in _FOLDS for k in range(8)]
    return F.translate(text, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


def text_script(text: Column) -> Column:
    """am where Ethiopic letters are the majority, en where Latin ones are, null without letters."""
    am = F.length(F.regexp_replace(text, r"[^ሀ-፿]", ""))
    en = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    return F.when(am + en == 0, F.lit(None)).when(am > en, "am").otherwise("en")


def letter_ratio(text: Column) -> Column:
    return F.when(F.length(text) == 0, 0.0).otherwise(F.length(F.regexp_replace(text, "[^A-Za-z]", "")) / F.length(text))


#: Fixed value: the form of a reference; numbers of more than nine digits make none.
REF = r"^(.+?)\s+([0-9]{1,9})(?::([0-9]{1,9}))?(?:-([0-9]{1,9})(?::([0-9]{1,9}))?)?$"


def parse_ref(ref: Column) -> Column:
    """Struct (book, c1, v1, c2, v2) of "Book c:v-c:v"; a whole chapter ends at verse 999; null if it is no reference."""
    part = lambda k: F.nullif(F.regexp_extract(ref, REF, k), F.lit("")).cast("int")
    c1, verse, last, last_verse = part(2), part(3), part(4), part(5)
    whole = verse.isNull()
    fields = F.struct(
        F.regexp_extract(ref, REF, 1).alias("book"),
        c1.alias("c1"),
        F.when(whole, 1).otherwise(verse).alias("v1"),
        F.when(whole | last_verse.isNull(), c1).otherwise(last).alias("c2"),
        F.when(whole, 999).otherwise(F.coalesce(last_verse, last, verse)).alias("v2"),
    )
    return F.when(ref.rlike(REF), fields)


def format_ref(book: Column, c1: Column, v1: Column, c2: Column, v2: Column) -> Column:
    """Inverse of parse_ref for verse spans."""
    head = F.concat(book, F.lit(" "), c1.cast("string"), F.lit(":"), v1.cast("string"))
    return F.when((c1 == c2) & (v1 == v2), head).when(c1 == c2, F.concat(head, F.lit("-"), v2.cast("string"))).otherwise(
        F.concat(head, F.lit("-"), c2.cast("string"), F.lit(":"), v2.cast("string"))
    )


#: A list of spans behind its book, and the form of one span.
REF_LIST = r"^\s*(.+?)\s+([0-9][0-9:,\s–—-]*)$"
SPAN = r"^\s*([0-9]{1,9})(?::([0-9]{1,9})(?:-(?:([0-9]{1,9}):)?([0-9]{1,9}))?|-([0-9]{1,9}))?\s*$"


def parse_spans(rest: Column) -> Column:
    """Array of (c1, v1, c2, v2) of "15:18, 20, 16:2-17:3": a bare number is a verse of the chapter named last, or, before any
    is named, a whole chapter, which ends at verse 999 ("51-53" is chapter 51). Null if any part is no span."""
    parts = F.split(F.regexp_replace(rest, "[–—]", "-"), ",")
    number = lambda s, k: F.nullif(F.regexp_extract(s, SPAN, k), F.lit("")).cast("int")
    part = lambda s: F.struct(number(s, 1).alias("n"), number(s, 2).alias("verse"), number(s, 3).alias("last"), F.coalesce(number(s, 4), number(s, 5)).alias("end"))
    span = lambda c1, v1, c2, v2: F.struct(c1.alias("c1"), v1.alias("v1"), c2.alias("c2"), v2.alias("v2"))

    def add(state: Column, x: Column) -> Column:
        named = x["verse"].isNotNull()
        full = span(x["n"], x["verse"], F.coalesce(x["last"], x["n"]), F.coalesce(x["end"], x["verse"]))
        within = span(state["chapter"], x["n"], state["chapter"], F.coalesce(x["end"], x["n"]))
        got = F.when(named, full).when(state["chapter"] > 0, within).otherwise(span(x["n"], F.lit(1), x["n"], F.lit(999)))
        return F.struct(F.when(named, F.coalesce(x["last"], x["n"])).otherwise(state["chapter"]).alias("chapter"), F.concat(state["spans"], F.array(got)).alias("spans"))

    none = F.struct(F.lit(0).alias("chapter"), F.from_json(F.lit("[]"), "array<struct<c1:int,v1:int,c2:int,v2:int>>").alias("spans"))
    return F.when(F.forall(parts, lambda s: s.rlike(SPAN)), F.aggregate(F.transform(parts, part), none, add)["spans"])


def parse_ref_list(ref: Column) -> Column:
    """Struct (book, spans) of "Psalm 51:1-2, 10-12"; null if it is no such list."""
    spans = parse_spans(F.regexp_extract(ref, REF_LIST, 2))
    return F.when(ref.rlike(REF_LIST) & spans.isNotNull(), F.struct(F.regexp_extract(ref, REF_LIST, 1).alias("book"), spans.alias("spans")))


def format_spans(title: Column, spans: Column, mark: str = "፥", sep: str = "፣ ") -> Column:
    """A list of spans behind a title; whole chapters have no verses."""
    text = lambda c: c.cast("string")

    def part(s: Column) -> Column:
        head = F.concat(text(s["c1"]), F.lit(mark), text(s["v1"]))
        far = F.concat(head, F.lit("–"), text(s["c2"]), F.lit(mark), text(s["v2"]))
        return F.when(s["c1"] != s["c2"], far).when(s["v2"] >= 999, text(s["c1"])).when(s["v1"] == s["v2"], head).otherwise(F.concat(head, F.lit("–"), text(s["v2"])))

    return F.concat(title, F.lit(" "), F.array_join(F.transform(spans, part), sep))


def like_escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


def parse_json_loose(text: Column, schema: str) -> Column:
    """First that parses: the text, a fenced block, the outermost braces; null if none does."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    tries = [F.from_json(F.when(F.try_parse_json(t).isNotNull(), t), schema) for t in (text, fenced, braces)]
    return F.coalesce(*tries)
