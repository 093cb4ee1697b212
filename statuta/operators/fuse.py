"""Fusion of ranked lists, reranking and the penalty for explanatory text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rrf_score(rank: Column, constant: int = 60) -> Column:
    return F.lit(1.0) / (F.lit(constant) + rank + 1)


def rrf(first: DataFrame, second: DataFrame, k: int, qkey: str = "query_id", key: str = "chunk_id", constant: int = 60) -> DataFrame:
    """(query, record, score, rank) by reciprocal rank fusion of two lists (rank from 0).

    A record in both lists adds both parts. Ties go to the first list's order, then to the second's. One union and one
    aggregation, no join.
    """
    one = first.select(qkey, key, F.col("rank").alias("r1"), F.lit(None).cast("int").alias("r2"))
    two = second.select(qkey, key, F.lit(None).cast("int").alias("r1"), F.col("rank").alias("r2"))
    part = lambda r: F.coalesce(rrf_score(F.col(r), constant), F.lit(0.0))
    g = one.unionByName(two).groupBy(qkey, key).agg(F.round(F.sum(part("r1") + part("r2")), 9).alias("score"), F.min("r1").alias("r1"), F.min("r2").alias("r2"))
    rn = F.row_number().over(W.partitionBy(qkey).orderBy(F.col("score").desc(), F.col("r1").asc_nulls_last(), F.col("r2"), F.col(key)))
    return g.withColumn("rn", rn).where(F.col("rn") <= k).select(qkey, key, "score", (F.col("rn") - 1).alias("rank"))


def rerank(hits: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series] | Column, qkey: str = "query_id", query: str = "query", text: str = "text") -> DataFrame:
    """hits with the scorer's score in place of their own and ranks by it, ties in the former order.

    The scorer is a column expression or a function of two series, which gets Arrow batches inside the tasks.
    """
    if isinstance(scorer, Column):
        scored = hits.withColumn("score", scorer)
    else:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema.fields if f.name != "score") + ", score double"

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.drop(columns="score").assign(score=scorer(b[query], b[text]).astype("float64"))

        scored = hits.mapInPandas(run, schema)
    rn = F.row_number().over(W.partitionBy(qkey).orderBy(F.col("score").desc(), F.col("rank")))
    return scored.withColumn("rank", rn - 1)


def operative_first(hits: DataFrame, k: int, penalty: float = 3.0, qkey: str = "query_id", kind: str = "section_type", penalised: str = "recital") -> DataFrame:
    """The k best after the penalised kind lost `penalty` points; the stored score stays, ranks are new."""
    eff = F.col("score") - F.when(F.col(kind) == penalised, F.lit(penalty)).otherwise(F.lit(0.0))
    rn = F.row_number().over(W.partitionBy(qkey).orderBy(eff.desc(), F.col("rank")))
    return hits.withColumn("rn", rn).where(F.col("rn") <= k).withColumn("rank", F.col("rn") - 1).drop("rn")


def overlap_score(query: Column, text: Column) -> Column:
    """An offline stand-in for a cross-encoder: distinct words of the query that the text holds."""
    from statuta.functions.text import tokenise

    return F.size(F.array_intersect(tokenise(query), tokenise(text))).cast("double")
