"""Normal forms of labels, splits, sources and free text that the data-preparation operators compare by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"[\s  -​ 　]"
#: Spellings of each split.
SPLITS = {"train": ("train", "training"), "dev": ("dev", "development", "val", "valid", "validation"), "test": ("test", "testing")}


def label(c: Column) -> Column:
    """Lower case, outer blanks cut, any run of blanks, "-" and "_" one "_"; null where nothing is left."""
    x = F.regexp_replace(F.lower(c), rf"^{BLANKS}+|{BLANKS}+$", "")
    x = F.regexp_replace(x, r"[\s  -​ 　_-]+", "_")
    return F.when((x != "") & (x != "_"), x)


def split_name(c: Column) -> Column:
    """train, dev or test; null for anything else."""
    x = label(c)
    out = F.lit(None).cast("string")
    for name, spellings in SPLITS.items():
        out = F.when(x.isin(*spellings), F.lit(name)).otherwise(out)
    return out


def provision(c: Column) -> Column:
    """`Article 12`, `Annex IV` or `Recital 7` from any spelling and depth; null if there is none."""
    x = F.regexp_replace(c, rf"{BLANKS}+", " ")
    pattern = r"(?i)^ ?(art|rec|ann)[a-z]*\.? ?([0-9]+|[ivxlc]+)(?![0-9a-z])"
    kind, number = F.lower(F.regexp_extract(x, pattern, 1)), F.regexp_extract(x, pattern, 2)
    # leading zeros are no part of a number
    number = F.upper(F.regexp_replace(number, r"^0+(?=[0-9])", ""))
    name = F.when(kind == "art", "Article").when(kind == "rec", "Recital").when(kind == "ann", "Annex")
    return F.when(name.isNotNull() & (number != ""), F.concat_ws(" ", name, number))


def act(c: Column) -> Column:
    """A document's name with blanks put in order; null where blank."""
    x = F.regexp_replace(F.regexp_replace(c, rf"{BLANKS}+", " "), "^ | $", "")
    return F.when(x != "", x)


def letters_digits(c: Column) -> Column:
    """Lower case with every character dropped that is neither a letter nor a digit."""
    drop = r"[^\p{L}\p{Nd}]+"
    return F.regexp_replace(F.lower(F.regexp_replace(c, drop, "")), drop, "")
