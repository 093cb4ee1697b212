"""References to provisions: extraction, parsing, comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from statuta.functions.text import strip

# What counts as a citation, a reference to another act, a decline, a misplaced framing.
CITATION = r"Article\s+\d+(?:\((?:\d+|[a-z]{1,4})\))*|Annex\s+[IVX]+(?:[,\s]+Section\s+[0-9A-Z]\b)?|Recital\s+\d+"
OTHER_ACT = r",?\s*(?:(?:of|in)\s+(?:that\s+|the\s+)?(?:Regulation|Directive|Decision|Treaty|Charter|Council)|(?:TFEU|TEU)\b)"
CROSS_REFERENCE = r"(?i)\b(?:Article\s+\d+(?:\(\d+\))?|Annex\s+[IVX]+|Recital\s+\d+)\b"
DECLINE = r"(?i)does not contain (sufficient|enough) information to answer"
DECLINE_WITHIN = 120
BAD_FRAMING = (
    r"based on (the )?(documents?|transcripts?|text|files?|materials?) you provided",
    r"(the )?(documents?|transcripts?|files?) (you|the user) (provided|shared|uploaded|sent)",
    r"according to (the )?(documents?|files?) you",
    r"from (the )?(documents?|files?) provided by you",
)
#: Words of a title that tell the kind of section, first match first.
SECTION_WORDS = (
    ("prohibition", r"prohibited|forbidden|shall not|must not|ban"),
    ("definition", r"means|definition|defined as|for the purposes of"),
    ("obligation", r"shall|must|required|obligation|comply"),
    ("procedural", r"procedure|process|step|assessment|conformity|notify|register"),
)
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100}
PARSE = r"(?i)^(Article|Annex|Recital)\s+(\d+|[IVXLC]+)(.*)$"
PATH = r"(?i)\((\d+|[a-z]{1,4})\)|Section\s+([\p{L}\p{N}_]+)"


def citations(c: Column) -> Column:
    """Distinct citations in order, without those that belong to another act; empty for null.

    The group is atomic: a citation that an act's name follows is dropped whole and never shortened to another.
    """
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"(?i)\b(?>{CITATION})(?!{OTHER_ACT})"), 0))


def cross_references(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(CROSS_REFERENCE), 0))


def parse(c: Column) -> Column:
    """STRUCT(kind, number, path) of a reference, null if it is none; white space around it doesn't count.

    Annexes have roman numbers in upper case, articles and recitals digits; path parts are in lower case.
    """
    c = strip(c)
    kind = F.lower(F.regexp_extract(c, PARSE, 1))
    number = F.upper(F.regexp_extract(c, PARSE, 2))
    rest = F.regexp_extract(c, PARSE, 3)
    parts = F.regexp_extract_all(rest, F.lit(PATH), 0)
    path = F.transform(parts, lambda p: F.lower(F.when(p.startswith("("), F.regexp_replace(p, r"[()]", "")).otherwise(F.regexp_replace(p, r"(?i)^section\s+", "section "))))
    ok = (kind != "") & ((kind == "annex") | number.rlike(r"^\d+$"))
    return F.when(ok, F.struct(kind.alias("kind"), number.alias("number"), path.alias("path")))


def overlaps(a: Column, b: Column) -> Column:
    """Whether two parsed references name the same place or one encloses the other; null if either is null."""
    n = F.least(F.size(a["path"]), F.size(b["path"]))
    same = (a["kind"] == b["kind"]) & (a["number"] == b["number"])
    return same & ((n == 0) | (F.slice(a["path"], F.lit(1), F.greatest(n, F.lit(1))) == F.slice(b["path"], F.lit(1), F.greatest(n, F.lit(1)))))


def refers_to(a: Column, b: Column) -> Column:
    """Overlap of two reference strings; equality where either can't be parsed."""
    p, q = parse(a), parse(b)
    return F.when(p.isNull() | q.isNull(), a == b).otherwise(overlaps(p, q))


def names_provision(text: Column, citation: Column) -> Column:
    """Whether a text names the citation's provision by kind and number."""
    p = parse(citation)
    pattern = F.concat(F.lit(r"(?i)\b"), p["kind"], F.lit(r"\s+"), p["number"], F.lit(r"(?![\dIVXLC])"))
    return F.coalesce(F.regexp_like(text, pattern), F.lit(False))


def declines(c: Column) -> Column:
    """Whether the answer says within its first characters that the context doesn't suffice."""
    return F.substring(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+", ""), 1, DECLINE_WITHIN).rlike(DECLINE)


def bad_framing(c: Column) -> Column:
    x = F.coalesce(c, F.lit(""))
    out = F.lit(False)
    for p in BAD_FRAMING:
        out = out | x.rlike(f"(?i){p}")
    return out


def section_kind(title: Column) -> Column:
    """prohibition, definition, obligation, procedural or general, by the words of a title."""
    t = F.coalesce(title, F.lit(""))
    out = F.lit("general")
    for kind, ws in reversed(SECTION_WORDS):
        out = F.when(t.rlike(rf"(?i)\b({ws})\b"), F.lit(kind)).otherwise(out)
    return out


def roman(c: Column) -> Column:
    """Value of a roman number: a smaller digit before a larger one is subtracted."""
    values = F.create_map(*[x for k, v in ROMAN.items() for x in (F.lit(k), F.lit(v))])
    digits = F.transform(F.filter(F.split(F.upper(c), ""), lambda x: x != ""), lambda x: F.try_element_at(values, x))
    padded = F.concat(digits, F.array(F.lit(0)))
    return F.aggregate(F.sequence(F.lit(1), F.size(digits)), F.lit(0), lambda s, i: s + F.when(F.get(padded, i - 1) < F.get(padded, i), -F.get(padded, i - 1)).otherwise(F.get(padded, i - 1)))


def citation_status(citation: Column, shown: Column, labels: Column, context: Column) -> Column:
    """retrieved, wrong_label, cross_reference or unsupported, the first that holds.

    shown are the provisions whose text the passages hold, labels what the passages are called.
    """
    return (
        F.when(F.exists(shown, lambda p: refers_to(citation, p)), "retrieved")
        .when(F.exists(F.filter(labels, lambda x: x.isNotNull() & (x != "")), lambda x: refers_to(citation, x)), "wrong_label")
        .when(names_provision(context, citation), "cross_reference")
        .otherwise("unsupported")
    )
