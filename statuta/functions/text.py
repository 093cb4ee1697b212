"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokenise(c: Column) -> Column:
    """Lower-case words split at white space, punctuation dropped; empty for null."""
    x = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_\s]", " ")
    return F.filter(F.split(x, r"\s+"), lambda w: w != "")


def words(c: Column) -> Column:
    """All runs of letters, digits and underscores in lower case; empty for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), 0)


def sentences(c: Column) -> Column:
    """The text split at white space that follows a full stop, exclamation or question mark."""
    return F.split(F.coalesce(c, F.lit("")), r"(?<=[.!?])\s+")


#: Beginnings of sentences that state no fact.
NOT_FACTUAL = ("Note", "Disclaimer", "⚠️", "This is informational")


def factual_sentences(c: Column) -> Column:
    """Number of sentences of more than 20 characters that state something."""

    def states(s: Column) -> Column:
        t = strip(s)
        ok = F.length(t) > 20
        for x in NOT_FACTUAL:
            ok = ok & ~t.startswith(x)
        return ok

    return F.size(F.filter(sentences(c), states))


def dedup_key(c: Column) -> Column:
    return F.substring(F.lower(strip(c)), 1, 80)


def chunk_id(c: Column) -> Column:
    """SHA-256 of the stripped text."""
    return F.sha2(strip(c), 256)


def truncated(c: Column, chars: int) -> Column:
    return F.substring(c, 1, chars)


def windows(ws: Column, size: int) -> Column:
    """All runs of `size` words as strings; none if there are fewer words."""
    n = F.size(ws)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(ws, i, F.lit(size)), " "))
    return F.when(n >= size, runs).otherwise(F.array().cast("array<string>"))


def window_hashes(ws: Column, size: int) -> Column:
    """As windows, each run as the first 16 bytes of its SHA-256, so that no copy of the text leaves its row."""
    n = F.size(ws)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.unhex(F.substring(F.sha2(F.array_join(F.slice(ws, i, F.lit(size)), " "), 256), 1, 32)))
    return F.when(n >= size, runs).otherwise(F.array().cast("array<binary>"))
