import pytest
from pyspark.sql import functions as F

from sieveline.operators import rules as R
from sieveline.plans import scripture

from .compare import same
from .conftest import SF

LONG = "with words enough to stand as prose"


def sections(spark, rule, text, doc=1):
    lines = spark.createDataFrame([(doc, k, x or (None if k % 2 else "")) for k, x in enumerate(text.split("\n"))], "doc long, pos int, line string")
    out = {}
    for r in R.ruled_sections(lines, rule, "Start").orderBy("section", "para").collect():
        assert r["doc"] == doc
        out.setdefault((r["section"], r["heading"]), []).append(r["text"])
    return [(h, p) for (_, h), p in out.items()]


def test_query_equals_its_sql(spark):
    run, sql = scripture.CATALOG["numbered_sections"]
    same(run(spark, SF), sql, SF)


def test_worn_numerals(spark):
    cases = {"XXxiIll.": [33, 23, 32, 22, 31, 21], "XXYI": [26] * 8, "IT": [2] * 8, "§ IV .": [4] * 8, "": [], "MD": [], "IIII": [], "x": [10] * 4, "l": [1] * 4, "iv": [], None: []}
    rows = spark.createDataFrame([(k,) for k in cases], "r string").select("r", R.numeral_readings(F.col("r")).alias("n")).collect()
    assert {r["r"]: r["n"] for r in rows} == cases
    assert [R.numeral(n) for n in (4, 19, 40, 99, 400)] == ["IV", "XIX", "XL", "XCIX", "CCCC"]


def test_chapters_with_worn_numerals_go_on_counting(spark):
    rule = R.Rule("chapterNumeral", section_start="^CHAPTER [IVXLCYxil ]+\\.?$", running_context="^(BOOK [IVX]+)$")
    got = sections(spark, rule, "opening\nlines\n\nBOOK I\nCHAPTER I.\na\n\nb\nCHAPTER Il\nc\nCHAPTER VIx\nd\nCHAPTER xxx xxx\nnone\nBOOK II\nCHAPTER V\nBOOK II\nCHAPTER V\ne")
    assert got == [("Start", ["opening lines"]), ("Book I, Chapter I", ["a", "b"]), ("Book I, Chapter II", ["c"]), ("Book I, Chapter VI", ["d"]), ("Book I, Chapter VII", ["none"]), ("Book II, Chapter V", ["e"])]


def test_numbered_chapters_with_lost_and_broken_headings(spark):
    rule = R.Rule("numberedChapter", section_start="^([0-9iIl]{1,3})\\s?[.,:-]\\s?(.{4,})$")
    got = sections(spark, rule, "22. NOT YET\nl. THE COM-\nMANDER OF HIS ARMY\nand he went\n2. he said so\n3: THE SEA\n\nTHE LAND\nIN CAPITALS HERE\ntext\nNOT A TITLE\n9. THE END.\n3. BACK AGAIN\nlast")
    assert got == [("Start", ["22. NOT YET"]), ("Chapters 1–2: The Commander Of His Army", ["and he went 2. he said so"]), ("Chapters 3–8: The Sea The Land In Capitals Here", ["text NOT A TITLE"]), ("Chapter 9: The End 3. Back Again", ["last"])]


def test_verses_of_roman_chapters(spark):
    rule = R.Rule("romanChapterStart", section_start="^([IVXLl]+)\\.[1-9*]?\\s+(?=[A-Z])")
    got = sections(spark, rule, "I. And on the new moon\nhe came.\n\nThen\nIII. And so\nVIII. Far off\nl. Not one again")
    assert got == [("Chapters I–II", ["And on the new moon he came.", "Then"]), ("Chapter III", ["And so VIII. Far off l. Not one again"])]


def test_titles_after_lone_numerals(spark):
    rule = R.Rule("loneNumeral", section_start="^([IVXLCxil]{1,7})$", label="Treatise", title_ends_with_period=True)
    long = "THE WORDS OF THE FATHERS ABOUT PATIENCE AND MANY OTHER THINGS IN THE DESERT OF THE OUTER LAND, AND BEYOND"
    got = sections(spark, rule, f"XIX\nIV\n12 ON PRAYER\nAND FAST-\nINGS.\nCAPITALS IN TEXT\n\nmore\nVII\n{long}\ntext\nXX\nVI")
    cut = "Treatise VII: The Words Of The Fathers About Patience And Many Other Things In The Desert…"
    assert got[0] == ("Start", ["XIX"]) and got[1] == ("Treatises IV–VI: On Prayer And Fastings", ["CAPITALS IN TEXT", "more"]) and got[2][1] == ["text XX VI"]
    assert got[2][0] == cut


def test_sections_named_by_their_context(spark):
    start = "^In the name"
    text = "MONTH OF TUT\nIn the name of\nTHEY say " + LONG + " to all, and on\n\nAGAIN they " + LONG + "\nIn the name of\nshort\n\nMONTH OF BABA\n“NOW in Nitria " + LONG + "\nIn the name"
    rule = R.Rule("contextFirstWords", section_start=start, running_context="^MONTH OF ([A-Z]+)$")
    got = sections(spark, rule, text)
    assert got == [("Tut — “THEY say with words enough to stand as…”", [f"THEY say {LONG} to all, and on", f"AGAIN they {LONG}"]), ("Baba — “NOW in Nitria with words enough to stand…”", ["short", f"“NOW in Nitria {LONG}"])]
    counted = sections(spark, R.Rule("contextCounter", section_start=start, running_context="^MONTH OF ([A-Z]+)$", context_label=F.lower), text.replace("NOW in Nitria", "In the name"))
    assert [h for h, _ in counted] == ["tut, entry 1", "tut, entry 2"]
    plain = sections(spark, R.Rule(section_start=start), text.replace("MONTH OF TUT\n", ""))
    assert [h for h, _ in plain] == ["“THEY say with words enough to stand as…”", "“MONTH OF BABA “NOW in Nitria with words…”"]


def test_headings_from_lines_and_running_titles(spark):
    line = R.Rule("contextLine", section_start="^(Demonstration [IVX]+\\.--.+|\\[(The .*)\\])$", running_context="^(BOOK [A-Z]+)$")
    assert sections(spark, line, "Demonstration VII.--Of Peni- tents.\na\nBOOK ONE\nDemonstration VIII.--Of Life.\nb\n[The parable]\nc") == [("Demonstration VII — Of Penitents", ["a"]), ("Book One, Demonstration VIII — Of Life", ["b"]), ("Book One, [The parable]", ["c"])]
    group = R.Rule("contextLine", section_start="^\\[(The .*)\\]$", title_group=1)
    assert sections(spark, group, "[The parable.]\nc") == [("The parable", ["c"])]
    running = R.Rule(running_title="^([A-Z ]{5,}) [0-9]+$")
    assert sections(spark, running, "PALLADIUS OF ROME 84\na\nPALLADIUS OF ROME 85\nb\n\nMACARIUS 86\nc\nMACARIUS 87") == [("Palladius Of Rome", ["a b"]), ("Macarius", ["c"])]


def test_odd_rules_and_documents(spark):
    with pytest.raises(ValueError):
        R.Rule("other")
    with pytest.raises(ValueError):
        R.Rule("firstWords", section_start="a", running_title="b")
    lines = spark.createDataFrame([(None, 1, "a"), (None, 0, "CHAPTER I"), (2**60 + 1, 0, None), (2**60 + 1, 1, "b"), (3, 0, "")], "doc long, pos int, line string")
    rule = R.Rule("chapterNumeral", section_start="^CHAPTER [IVX]+$")
    got = {(r["doc"], r["heading"], r["text"]) for r in R.ruled_sections(lines, rule, "Start").collect()}
    assert got == {(None, "Chapter I", "a"), (2**60 + 1, "Start", "b")}
    assert R.ruled_sections(lines.limit(0), rule, "Start").count() == 0
    assert {r["text"] for r in R.ruled_sections(lines, R.Rule(), "Start").collect()} == {"CHAPTER I a", "b"}
