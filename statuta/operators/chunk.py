"""Chunks from structural units: one each, or windows of words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.functions.text import chunk_id, strip


def structural(units: DataFrame, run_id: str) -> DataFrame:
    """One chunk per unit that isn't blank, named by the hash of its stripped text."""
    text = strip(F.col("text"))
    u = units.withColumn("text", text).where(F.col("text") != "")
    return u.select("*", chunk_id(F.col("text")).alias("chunk_id"), chunk_id(F.col("text")).alias("chunk_hash"), F.lit(run_id).alias("ingestion_run_id"))


def fixed_size(units: DataFrame, size: int = 500, overlap: int = 50, doc: str = "parent_document", index: str = "chunk_index") -> DataFrame:
    """Windows of `size` words over the units of each document in order, each starting size - overlap after the last.

    A window has the attributes of the unit that holds its first word and a new index. The last windows may lie wholly
    inside the one before. A blank unit counts as one empty word. Only numbers of words are summed over a document;
    words meet by window, so no document is gathered in a task.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the window")
    step = size - overlap
    from pyspark.sql import Window as W

    ws = F.split(strip(F.coalesce(F.col("text"), F.lit(""))), r"(?U)\s+")
    u = units.withColumn("__w", ws).withColumn("__n", F.size("__w"))
    w = W.partitionBy(doc).orderBy(index).rowsBetween(W.unboundedPreceding, -1)
    at = u.select(F.col(doc).alias("__d"), F.col(index).alias("__i"), F.coalesce(F.sum("__n").over(w), F.lit(0)).cast("long").alias("__at"))
    u = u.join(at, F.col(doc).eqNullSafe(F.col("__d")) & F.col(index).eqNullSafe(F.col("__i"))).drop("__d", "__i")
    meta = [c for c in units.columns if c not in ("text", doc, index)]
    lo = F.greatest(F.ceil((F.col("__at") - size + 1) / step), F.lit(0)).cast("int")
    hi = F.floor((F.col("__at") + F.col("__n") - 1) / step).cast("int")
    p = u.select(doc, "__w", "__at", "__n", *meta, F.explode(F.sequence(lo, hi)).alias("__win"))
    start = F.col("__win").cast("long") * step
    a = F.greatest(start - F.col("__at"), F.lit(0)).cast("int")
    b = F.least(start + size - F.col("__at"), F.col("__n").cast("long")).cast("int")
    p = p.select(doc, "__win", "__at", F.slice("__w", a + 1, b - a).alias("__part"), F.struct(*[F.col(c) for c in meta]).alias("__meta") if meta else F.lit(None).alias("__meta"))
    g = p.groupBy(doc, "__win").agg(F.array_sort(F.collect_list(F.struct("__at", "__part"))).alias("__ps"), F.min_by("__meta", "__at").alias("__m"))
    text = F.array_join(F.flatten(F.transform("__ps", lambda x: x["__part"])), " ")
    out = g.select(doc, F.col("__win").alias(index), text.alias("text"), *[F.col(f"__m.{c}").alias(c) for c in meta])
    return out.withColumn("chunk_id", chunk_id(F.col("text")))
