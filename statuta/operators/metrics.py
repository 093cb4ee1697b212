"""Retrieval metrics, run summaries and their comparison."""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.runtime import shuffled


def recall(k: int, rank: str = "rank", hit: str = "hit") -> Column:
    """1.0 if one of the first k is a hit; an aggregate."""
    return F.coalesce(F.max(F.when((F.col(rank) < k) & F.col(hit), 1.0).otherwise(0.0)), F.lit(0.0))


def mrr(rank: str = "rank", hit: str = "hit") -> Column:
    return F.coalesce(F.lit(1.0) / (F.min(F.when(F.col(hit), F.col(rank))) + 1), F.lit(0.0))


def precision(k: int, rank: str = "rank", hit: str = "hit") -> Column:
    """Hits among the first k over the rows there, which may be fewer than k; 0 for none."""
    return F.coalesce(F.avg(F.when(F.col(rank) < k, F.col(hit).cast("double"))), F.lit(0.0))


def per_query(queries: DataFrame, hits: DataFrame, qkey: str = "query_id") -> DataFrame:
    """recall_at_1, 3, 5, mrr and precision_at_5 of each query; 0 for a query without hits."""
    m = hits.groupBy(qkey).agg(recall(1).alias("recall_at_1"), recall(3).alias("recall_at_3"), recall(5).alias("recall_at_5"), mrr().alias("mrr"), precision(5).alias("precision_at_5"))
    return queries.select(qkey).distinct().join(shuffled(m), qkey, "left").fillna(0.0)


METRICS = ("recall_at_1", "recall_at_3", "recall_at_5", "mrr", "precision_at_5")


def mean(c: Column, places: int = 3) -> Column:
    """Rounded mean, null for none."""
    return F.round(F.avg(c), places)


def summary(records: DataFrame, by: tuple[str, ...] = ("tag",)) -> DataFrame:
    """One row per run: the means of its questions.

    Retrieval is over the answerable questions, citation shares over all citations of answers that didn't decline,
    completeness over answered ones, framing and context over all. Completeness by a judge counts 0 where there is no
    judgement, the other judges are over the judged ones. One pass over the questions, each with its citations' counts.
    """
    ok, declined = ~F.col("is_unanswerable"), F.col("declined")
    when = lambda cond, c: F.when(cond, c)
    cites = F.sum(when(~declined, F.col("n_citations")))
    share = lambda c: F.round(F.sum(when(~declined, F.col(c))) / F.when(cites > 0, cites), 3)
    aggs = [
        F.count(F.lit(1)).alias("n_questions"),
        F.sum(ok.cast("int")).alias("n_answerable"),
        F.sum((~ok).cast("int")).alias("n_unanswerable"),
        *[mean(when(ok, F.col(m))).alias(m) for m in METRICS],
        mean(when(~ok, declined.cast("double"))).alias("unanswerable_declined"),
        mean(when(ok, declined.cast("double"))).alias("answerable_declined"),
        share("n_retrieved").alias("citations_grounded"),
        share("n_wrong_label").alias("citations_wrong_label"),
        share("n_cross_reference").alias("citations_cross_reference"),
        share("n_unsupported").alias("citations_unsupported"),
        F.coalesce(cites, F.lit(0)).alias("n_citations"),
        mean(when(ok & ~declined, F.col("citation_completeness"))).alias("citation_completeness"),
        mean(F.col("bad_framing").cast("double")).alias("bad_framing_rate"),
        mean(F.col("context_chars")).alias("avg_context_chars"),
        mean(F.col("cost_usd"), 5).alias("avg_cost_usd"),
        mean(F.col("latency_ms"), 0).alias("avg_latency_ms"),
    ]
    judges = [f.name for f in records.schema.fields if f.name.startswith("judge_")]
    for j in judges:
        value = F.coalesce(F.col(j), F.lit(0.0)) if j == "judge_completeness" else F.col(j)
        aggs.append(mean(when(ok, value)).alias(j[len("judge_"):]))
    return records.groupBy(*by).agg(*aggs)


#: The rows of a comparison and the metric each shows.
ROWS = (
    ("Recall@1", "recall_at_1"), ("Recall@3", "recall_at_3"), ("Recall@5", "recall_at_5"), ("MRR", "mrr"),
    ("Citations: cited text was retrieved", "citations_grounded"), ("Citations: label of a passage whose text is another provision", "citations_wrong_label"),
    ("Citations: cross-reference named in retrieved text", "citations_cross_reference"), ("Citations: unsupported", "citations_unsupported"),
    ("Unanswerable questions declined", "unanswerable_declined"), ("Answerable questions declined", "answerable_declined"),
    ("Completeness vs the Act (judge)", "completeness"), ("Faithfulness to retrieved text (judge)", "faithfulness"),
    ("Factual consistency (judge)", "factual_consistency"), ("Answer relevance (judge)", "answer_relevance"),
    ("Avg characters sent to the LLM", "avg_context_chars"), ("Avg cost per question (USD)", "avg_cost_usd"),
)


def long(summaries: DataFrame, tag: str = "tag") -> DataFrame:
    """(tag, metric, value) with a row for each metric of ROWS that the summary has or lacks."""
    have = set(summaries.columns)
    rows = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(n).alias("label"), F.lit(m).alias("metric"), (F.col(m).cast("double") if m in have else F.lit(None).cast("double")).alias("value")) for i, (n, m) in enumerate(ROWS)])
    return summaries.select(F.col(tag).alias("tag"), F.explode(rows).alias("x")).select("tag", "x.*")


@F.pandas_udf(T.StringType())
def format_value(metric: pd.Series, value: pd.Series) -> pd.Series:
    """not run, a price with 4 places, whole thousands over 100, else 2 places.

    The JVM rounds the shortest decimal, this rounds the double itself; the table it serves has a few rows.
    """

    def show(m: str, v: float | None) -> str:
        if v is None or pd.isna(v):
            return "not run"
        return f"${v:.4f}" if m == "avg_cost_usd" else f"{v:,.0f}" if v > 100 else f"{v:.2f}"

    return pd.Series([show(m, v) for m, v in zip(metric, value)], dtype="object")


def compare(summaries: DataFrame, tags: list[str]) -> DataFrame:
    """The comparison table: a row per metric in fixed order, a formatted column per tag in the order given."""
    x = long(summaries).withColumn("text", format_value(F.col("metric"), F.col("value")))
    return x.groupBy("at", "label").pivot("tag", tags).agg(F.first("text")).orderBy("at").select(F.col("label").alias("metric"), *[F.coalesce(F.col(f"`{t}`"), F.lit("not run")).alias(t) for t in tags])


def question_status(unanswerable: Column, declined: Column, recall_at_3: Column, all_grounded: Column) -> Column:
    return (
        F.when(unanswerable, F.when(declined, "✓").otherwise("✗"))
        .when(declined, "✗")
        .when((recall_at_3 == 1.0) & all_grounded, "✓")
        .otherwise("~")
    )
