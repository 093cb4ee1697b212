"""Each layout rule of the parser on a few lines of its own."""

import pytest
from pyspark.sql import functions as F

from statuta.operators import parse

ENACTED = "Whereas:\nHAVE ADOPTED THIS DECISION:\n"


REFERENCE = "ELI: http://data.europa.eu/eli/dec/2040/55/oj"
DOCS = {
    "furniture": (f"Article 1\nMooring\nBoats are tied up.\n7.7.2040\n\nEN\n{REFERENCE}\n(9) Footnote about rope.\nArticle 2", "Article 2\nTides\nHigh water counts."),
    "two references": (f"Article 1\nMooring\nKept.\nEN\n{REFERENCE}\nlost\n{REFERENCE}",),
    "reference on top": (f"{REFERENCE}\nArticle 1\nMooring",),
    "regions": (
        "Harbour rules\nWhereas:\n(1)\nShips need room.\nArticle 1\nstays in the recital.\nHAVE ADOPTED THIS DIRECTIVE:\nArticle 1\nRoom\nGive way.\nANNEX I\nis not one yet.",
        "Done at Quay, 3 March 2040.\nA. Warden\nArticle 2\nANNEX I\nSignals\nOne flag.\nANNEX III\nANNEX II\nLamps",
    ),
    "over pages": ("Whereas:\n(1)\nOne.\n(2)", "\n\nTwo.\nHAVE ADOPTED THIS DECISION:"),
    "out of sequence": (ENACTED + "Article 2\nArticle 1\nA\nArticle 3\nArticle 2\nB",),
    "no regions": ("Article 8\nX\nArticle 10\nArticle 9\nY",),
    "whole lines": ("Article 4\nBerths\nsee Article 5\nArticle 5;\nANNEX I to this act\nAnnex II\n(1) and more",),
    "definitions": (ENACTED + "Article 1\nA\nArticle 2\nB\nArticle 3\nWords used\nIn this act:\n(1)\n‘pier’ means a jetty;\n(2) ‘buoy’ means a float;\n(4) no;\nSECTION 2\ndropped\nArticle 4\nC\n(1)\nPlain.",),
    "no definitions": (ENACTED + "Article 1\nA\nArticle 2\nB\nArticle 3\nAnchors\nHeavy ones.",),
    "chapter": (ENACTED + "Article 1\nA\nkept\nCHAPTER IV\nOn pilots\nlost too\nArticle 2\nB",),
    "kinds": ("Article 1\nBanned cargo\nArticle 2\nCargo that is prohibited\nSee Article 7(2) and Annex IX, then Article 7(2).\nArticle 3\nSteps of the assessment",),
    "empty": ("",), "null": (None,), "blank": (" \n\t",), "no header": ("no header at all",),
}
BEGINNINGS = {"Pilots know the bay.": True, "‘Bay’ is meant widely.": True, '"Bay" is quoted.': True, "pilots know it.": False, "7 pilots.": False}
TITLES = {"Duties of\nthe Warden\nText": "Duties of the Warden", "Duties\nand rights\nText": "Duties and rights", "Duties\nText\nand more": "Duties", "Rules for\nboats under\nSail\nText": "Rules for boats under Sail"}
DOCS |= {x: (f"Whereas:\n(1)\n\n{x}\nHAVE ADOPTED THIS DECISION:",) for x in BEGINNINGS} | {x: (f"Article 1\n{x}",) for x in TITLES}


@pytest.fixture(scope="module")
def units(spark):
    """Each document's units by label, in order; all documents are parsed at once."""
    rows = [(name, n, t) for name, pages in DOCS.items() for n, t in enumerate(pages, 1)]
    out = {name: {} for name in DOCS}
    for r in parse.units(spark.createDataFrame(rows, "source_file string, page_number int, text string")).orderBy("chunk_index").collect():
        out[r["parent_document"]][r["article_number"]] = r
    return out


def test_lines_from_the_furniture_before_the_reference_on_are_cut(units):
    got = units["furniture"]
    assert list(got) == ["Article 1", "Article 2"] and got["Article 1"]["text"] == "Article 1\nMooring\nBoats are tied up."


def test_the_first_reference_of_a_page_decides(units):
    assert units["two references"]["Article 1"]["text"].endswith("Kept.") and units["reference on top"] == {}


def test_regions_part_recitals_articles_and_annexes(units):
    got = units["regions"]
    assert list(got) == ["Preamble", "Recital 1", "Article 1", "Annex I", "Annex II"]
    assert got["Preamble"]["text"] == "Harbour rules\nWhereas:"
    assert "Article 1\nstays" in got["Recital 1"]["text"] and got["Article 1"]["text"].endswith("ANNEX I\nis not one yet.")
    assert got["Annex I"]["text"].endswith("One flag.\nANNEX III")


@pytest.mark.parametrize("line", BEGINNINGS)
def test_a_recital_begins_before_upper_case_or_a_quotation(units, line):
    assert ("Recital 1" in units[line]) is BEGINNINGS[line]


def test_the_line_behind_a_recital_number_may_stand_on_the_next_page(units):
    assert "Recital 2" in units["over pages"]


def test_numbers_out_of_sequence_are_text(units):
    got = units["out of sequence"]
    assert list(got) == ["Preamble", "Article 1", "Article 2"] and got["Article 1"]["text"] == "Article 1\nA\nArticle 3"
    # without regions the first number may be any
    assert list(units["no regions"]) == ["Article 8", "Article 9"]


def test_headers_are_whole_lines(units):
    got = units["whole lines"]
    assert list(got) == ["Article 4"] and got["Article 4"]["text"].count("\n") == 6


def test_definitions_stand_for_their_article(units):
    got = units["definitions"]
    assert list(got) == ["Preamble", "Article 1", "Article 2", "Article 3(1)", "Article 3(2)", "Article 4"]
    assert got["Article 3(2)"]["text"] == "Article 3\nWords used\n(2) ‘buoy’ means a float;\n(4) no;"
    assert {got[f"Article 3({n})"]["section_type"] for n in (1, 2)} == {"definition"} and got["Article 3(1)"]["title"] == "Words used"


def test_an_article_three_without_definitions_stays(units):
    assert units["no definitions"]["Article 3"]["title"] == "Anchors"


def test_behind_a_chapter_nothing_counts_until_an_article(units):
    got = units["chapter"]
    assert got["Article 1"]["text"].endswith("kept") and not any("pilots" in r["text"] or "lost" in r["text"] for r in got.values())


@pytest.mark.parametrize("lines", TITLES)
def test_titles_go_on_over_lines(units, lines):
    got = units[lines]["Article 1"]
    assert got["title"] == TITLES[lines] and got["text"] == f"Article 1\n{lines}"


def test_kinds_of_sections_and_references(units):
    got = units["kinds"]
    assert [r["section_type"] for r in got.values()] == ["general", "prohibition", "procedural"]
    assert got["Article 2"]["cross_references"] == ["Article 2", "Article 7", "Annex IX"]


@pytest.mark.parametrize("name", ["empty", "null", "blank", "no header"])
def test_nothing_to_find(units, name):
    assert units[name] == {}


def test_a_page_of_many_lines_keeps_its_order(spark):
    n = (1 << 20) + 5
    first = "Article 1\nLong\n" + "x\n" * n + "last of page one"
    rows = [("f", 1, first), ("f", 2, "first of page two")]
    x = parse.lines(spark.createDataFrame(rows, "source_file string, page_number int, text string"))
    assert x.select("pos").distinct().count() == x.count() == n + 4
    top = x.orderBy(F.desc("pos")).limit(2).collect()
    assert [r["line"] for r in top] == ["first of page two", "last of page one"]


def test_structure_and_gaps(spark):
    labels = ("Annex II", "Article 2", "Recital 3", "Article 3(4)", "Article 4", "Preamble", "Recital 1")
    u = spark.createDataFrame([("d", x) for x in labels], "parent_document string, article_number string")
    assert {(r["kind"], r["number"]) for r in parse.gaps(u).collect()} == {("annex", 1), ("article", 1), ("article", 3), ("recital", 2), ("definition", 1), ("definition", 2), ("definition", 3)}
    assert {r["kind"]: r["numbers"] for r in parse.structure(u).collect()} == {"annex": [2], "article": [2, 4], "recital": [1, 3], "definition": [4]}
    assert parse.duplicates(u.union(u)).where(F.col("n") == 2).count() == 7
