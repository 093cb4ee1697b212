"""Citations of answers held against the passages they were given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions.refs import bad_framing, citations, names_provision, overlaps, parse
from statuta.functions.text import factual_sentences


def accuracy(matched: Column, total: Column) -> Column:
    """Matched over all; 1.0 where nothing is cited."""
    return F.when(total == 0, 1.0).otherwise(matched / F.when(total == 0, F.lit(1)).otherwise(total))


def completeness(answer: Column) -> Column:
    """Citations per factual sentence, at most 1.0; 1.0 where no sentence is factual."""
    n = factual_sentences(answer)
    return F.when(n == 0, 1.0).otherwise(F.least(F.size(citations(answer)) / F.when(n == 0, F.lit(1)).otherwise(n), F.lit(1.0)))


def verify(answers: DataFrame, answer: str = "answer", labels: str = "labels", texts: str = "texts") -> DataFrame:
    """answers with matched, missing and cross_referenced citations, accuracy and bad_framing.

    labels and texts are arrays of the passages given. A citation is matched if a label overlaps it; else it is
    missing, and cross_referenced if a passage names the provision. A citation that can't be parsed is missing.
    """
    cs = citations(F.col(answer))
    refs = F.transform(F.filter(F.col(labels), lambda x: x.isNotNull()), parse)
    met = lambda c: F.coalesce(F.exists(refs, lambda r: overlaps(parse(c), r)), F.lit(False))
    named = lambda c: F.exists(F.col(texts), lambda t: names_provision(t, c))
    out = answers.withColumn("citations", cs)
    out = out.withColumn("matched", F.filter("citations", met)).withColumn("missing", F.filter("citations", lambda c: ~met(c)))
    out = out.withColumn("cross_referenced", F.filter("missing", named))
    return out.withColumn("accuracy", accuracy(F.size("matched"), F.size("citations"))).withColumn("bad_framing", bad_framing(F.col(answer)))


def mark(citation: Column, matched: Column, cross_referenced: Column) -> Column:
    """How a checked citation is shown."""
    return F.when(F.array_contains(matched, citation), "✓").when(F.array_contains(cross_referenced, citation), "↪").otherwise("✗")
