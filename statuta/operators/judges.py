"""Judges of answers: their prompts, the reading of their replies, and their means."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions.payloads import covered_share, judgement, numbered_blocks

#: What each judge is asked, before the parts that it sees; every reply is one JSON object.
TASKS = {
    "answer_relevance": 'Does the answer deal with what was asked? Reply as {"score": 0 to 1, "reasoning": "..."}.',
    "faithfulness": 'Does every claim of the answer stand in the passages? Reply as {"score": 0 to 1, "reasoning": "..."}.',
    "factual_consistency": 'Is the answer free of contradictions to the passages? Reply as {"score": 0 to 1, "reasoning": "..."}.',
    "completeness": 'Which of the numbered facts does the answer state? Reply as {"covered": [true or false for each], "reasoning": "..."}.',
}
PARTS = {"answer_relevance": ("query", "answer"), "faithfulness": ("context", "answer"), "factual_consistency": ("context", "answer"), "completeness": ("query", "facts", "answer")}


def context(labels: Column, texts: Column) -> Column:
    """The passages as blocks numbered from 1, each under its label."""
    named = F.zip_with(labels, texts, lambda a, t: F.concat(F.when(a.isNotNull() & (a != ""), a).otherwise("(unlabelled)"), F.lit("\n"), t))
    return numbered_blocks(named)


def prompts(records: DataFrame, qkey: str = "query_id") -> DataFrame:
    """(query, judge, prompt, n_facts) of the judges that each record is put before.

    records has query, answer, labels and texts of the passages, and expected_answer_elements. Completeness is judged
    only where facts are expected; null parts count as empty.
    """
    none = F.array().cast("array<string>")
    facts = F.coalesce("expected_answer_elements", none)
    x = records.withColumns({
        "facts": F.array_join(F.transform(facts, lambda f, i: F.concat((i + 1).cast("string"), F.lit(". "), f)), "\n"),
        "context": context(F.coalesce("labels", none), F.coalesce("texts", none)), "n_facts": F.size(facts),
    })
    part = lambda p: F.concat(F.lit(f"\n\n[{p}]\n"), F.coalesce(F.col(p), F.lit("")))
    each = F.array(*[F.struct(F.lit(j).alias("judge"), F.concat(F.lit(TASKS[j]), *[part(p) for p in PARTS[j]]).alias("prompt")) for j in TASKS])
    x = x.select(qkey, "n_facts", F.explode(each).alias("x")).select(qkey, "x.judge", "x.prompt", "n_facts")
    return x.where((F.col("judge") != "completeness") | (F.col("n_facts") > 0))


def verdicts(replies: DataFrame, qkey: str = "query_id") -> DataFrame:
    """(query, judge, score, reasoning) of replies (query, judge, raw, n_facts).

    A reply that isn't JSON, nor holds an object, scores 0. Completeness is the share of facts among the first n_facts
    verdicts that are true, whatever score came along.
    """
    j = judgement(F.col("raw"))
    none = F.array().cast("array<boolean>")
    score = F.when(F.col("judge") == "completeness", covered_share(F.coalesce(j["covered"], none), F.col("n_facts"))).otherwise(F.coalesce(j["score"], F.lit(0.0)))
    return replies.select(qkey, "judge", score.alias("score"), F.coalesce(j["reasoning"], F.lit("")).alias("reasoning"))


def run_all(records: DataFrame, ask: Callable[[DataFrame], DataFrame], qkey: str = "query_id") -> DataFrame:
    """(query, judge_answer_relevance, judge_faithfulness, judge_factual_consistency, judge_completeness).

    `ask` gives each row of (query, judge, prompt, n_facts) its reply as `raw`; all judges are asked in one pass.
    """
    v = verdicts(ask(prompts(records, qkey)), qkey)
    return v.groupBy(qkey).agg(*[F.max(F.when(F.col("judge") == j, F.col("score"))).alias(f"judge_{j}") for j in TASKS])


def means(judged: DataFrame, answerable: Column, by: str = "tag") -> DataFrame:
    """One row per run: completeness over all answerable questions, 0 where there is no judgement; others over the judged."""
    over = {"completeness": F.coalesce("judge_completeness", F.lit(0.0))} | {j: F.col(f"judge_{j}") for j in TASKS if j != "completeness"}
    n = F.sum((answerable & F.col("judge_answer_relevance").isNotNull()).cast("int")).alias("n_judged")
    return judged.groupBy(by).agg(*[F.round(F.avg(F.when(answerable, c)), 3).alias(j) for j, c in over.items()], n)
