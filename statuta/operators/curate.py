"""From chunks to an evaluation set: candidates, their curation, selection, and new labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta.functions.payloads import numbered_blocks, objects
from statuta.operators import golden

#: Characters that a provision must have to be asked about, that a prompt shows of it, and of a passage.
LEAST, SHOWN, PASSAGE = 200, 2000, 600
CANDIDATE = "struct<query:string,query_type:string,difficulty:string,persona:string,expected_answer_elements:array<string>,acceptable_citation_targets:array<string>,is_unanswerable:boolean,source_article:string>"
GENERATE = "Write 3 to 5 questions that the provision below answers, of different type (factual, conceptual, procedural, cross_reference), difficulty (easy, medium, hard) and persona. Reply with a JSON array of objects only.\n\n"
RELEVANT = 'Which of the passages, numbered from 0, are needed to answer the question, and what must an answer state? Reply as {"relevant_indices": [...], "is_unanswerable": true or false, "expected_answer_elements": [...]}.\n\n'
ANSWER_KEY = 'List the 2 to 4 facts that an answer must state, each with its provision. Reply as {"elements": [...]}.\n\n'
Ask = Callable[[DataFrame], DataFrame]


def askable(chunks: DataFrame, only: list[str] | None = None, most: int | None = None, seed: int = 42) -> DataFrame:
    """The chunks of articles with more than LEAST characters; those labelled `only`, or a random `most` of them."""
    x = chunks.where(F.col("article_number").startswith("Article") & (F.length("text") > LEAST))
    if only:
        return x.where(F.col("article_number").isin(*only))
    return golden.uniform_sample(x, "chunk_id", most, seed) if most else x


def generation_prompts(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", "article_number", F.concat(F.lit(GENERATE), F.col("article_number"), F.lit("\n"), F.substring("text", 1, SHOWN)).alias("prompt"))


def generate(chunks: DataFrame, ask: Ask, existing: DataFrame | None = None) -> DataFrame:
    """Candidates (query_id, the fields of CANDIDATE, split, notes) from the replies to each chunk's prompt.

    `ask` adds the reply `raw` to each row of (chunk_id, article_number, prompt). Of a reply the array from its first to
    its last bracket is read; what can't be read gives no candidates. Names follow the order of the chunks' ids. With
    existing candidates, only those with a new query are added.
    """
    at = F.row_number().over(W.orderBy("chunk_id")) - 1  # as many rows as a model is asked about
    r = ask(generation_prompts(chunks)).select("article_number", "raw", at.alias("i"))
    found = objects(F.regexp_extract("raw", r"(?s)\[.*\]", 0), CANDIDATE)
    c = r.select("i", "article_number", F.posexplode(found).alias("j", "c")).where("c.query is not null")
    c = c.select(F.format_string("auto_%03d_%02d", "i", "j").alias("query_id"), "c.*", F.lit("dev").alias("split"), F.lit("").alias("notes"))
    return c if existing is None else existing.unionByName(golden.only_new(c, existing), allowMissingColumns=True)


def curation_prompts(candidates: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, prompt, chunk_ids, labels) of the candidates that have hits (query_id, chunk_id, article_number, text, rank)."""
    p = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "article_number", "text"))).alias("ps"))
    block = F.transform("ps", lambda x: F.concat(F.coalesce(x["article_number"], F.lit("(unlabelled)")), F.lit("\n"), F.substring(x["text"], 1, PASSAGE)))
    prompt = F.concat(F.lit(RELEVANT), numbered_blocks(block, 0), F.lit("\n\nQuestion: "), F.coalesce("query", F.lit("")))
    return candidates.select("query_id", "query").join(p, "query_id").select("query_id", prompt.alias("prompt"), F.transform("ps", lambda x: x["chunk_id"]).alias("chunk_ids"), F.transform("ps", lambda x: x["article_number"]).alias("labels"))


def judged_relevance(raw: Column) -> Column:
    """The curation judge's object from the first to the last brace of its reply; null for whatever can't be read."""
    return F.when(F.try_parse_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0)).isNotNull(), F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), "relevant_indices array<int>, is_unanswerable boolean, expected_answer_elements array<string>"))


def auto(candidates: DataFrame, hits: DataFrame, ask: Ask) -> DataFrame:
    """candidates with relevant_chunk_ids, is_unanswerable, expected_answer_elements and notes as a judge of the hits says.

    Without hits a candidate is unanswerable. Where the judge fails, the hits of the candidate's own provision count.
    Indices beyond the hits are ignored.
    """
    none = F.array().cast("array<string>")
    asked = ask(curation_prompts(candidates, hits)).select("query_id", "chunk_ids", "labels", judged_relevance(F.col("raw")).alias("j"), F.lit(True).alias("has"))
    x = candidates.drop("relevant_chunk_ids", "notes").join(asked, "query_id", "left")
    chosen = F.filter(F.transform(F.coalesce("j.relevant_indices", F.array().cast("array<int>")), lambda i: F.when(i >= 0, F.get("chunk_ids", i))), lambda c: c.isNotNull())
    own = F.transform(F.filter(F.arrays_zip("chunk_ids", "labels"), lambda z: z["labels"] == F.col("source_article")), lambda z: z["chunk_ids"])
    ids = F.when(F.col("has").isNull(), none).when(F.col("j").isNull(), own).otherwise(chosen)
    note = F.when(F.col("has").isNull(), "no retrieval results").when(F.col("j").isNull(), "judge failed — article-match fallback").when(F.size(ids) > 0, "llm-verified").otherwise("llm-verified: no relevant chunks found")
    kept = [c for c in candidates.columns if c not in ("relevant_chunk_ids", "notes", "is_unanswerable", "expected_answer_elements")]
    unanswerable = F.when(F.col("has").isNull(), True).when(F.col("j").isNull(), False).otherwise(F.coalesce("j.is_unanswerable", F.lit(False)))
    elements = F.when(F.col("j").isNotNull(), F.coalesce("j.expected_answer_elements", none)).otherwise(F.col("expected_answer_elements"))
    return x.select(*kept, ids.alias("relevant_chunk_ids"), unanswerable.alias("is_unanswerable"), elements.alias("expected_answer_elements"), note.alias("notes"))


def viable(candidates: DataFrame, ids: str = "relevant_chunk_ids") -> DataFrame:
    """Candidates that have relevant ids."""
    return candidates.where(F.size(ids) > 0)


def select_entries(candidates: DataFrame, target: int = 45, key: str = "query_id", points: str = "score", ids: str = "relevant_chunk_ids") -> DataFrame:
    """At most `target` viable candidates: priority provisions first, then each stratum's quota, one unanswerable at least.

    candidates has `points`, source_article, query_type, difficulty and is_unanswerable. The steps keep a few rows by
    the target's size; ties go to the smaller key.
    """
    v = viable(candidates, ids)
    order = F.array_position(F.array(*[F.lit(a) for a in golden.PRIORITY]), F.col("source_article"))
    picks = golden.priority_picks(v, key=key, points=points)
    place = F.row_number().over(W.orderBy(order, "level"))  # two a provision
    # a provision's picks are both taken, and no further provision once there are enough
    picks = picks.withColumn("__n", place).withColumn("__upto", F.max("__n").over(W.partitionBy("source_article")) - F.count(F.lit(1)).over(W.partitionBy("source_article")))
    picks = picks.where(F.col("__upto") < target).select(*candidates.columns)
    left = target - picks.count()
    rest = v.join(picks.select(key), key, "left_anti").select(*candidates.columns)
    chosen = picks.unionByName(golden.quota_select(rest, left, key=key, points=points, most=max(1, left)))
    return golden.trimmed(golden.with_unanswerable(chosen, v, points, key), target, points, key)


def coverage(selected: DataFrame, article: str = "source_article", ids: str = "relevant_chunk_ids") -> DataFrame:
    """One row: entries, unanswerable ones, those without ids, priority provisions covered and missing, mean number of ids."""
    has = F.array_sort(F.collect_set(F.when(F.col(article).isin(*golden.PRIORITY), F.col(article))))
    n = F.count(F.lit(1))
    x = selected.agg(
        n.alias("entries"), F.coalesce(F.sum(F.coalesce(F.col("is_unanswerable"), F.lit(False)).cast("int")), F.lit(0)).alias("unanswerable"),
        F.coalesce(F.sum((F.coalesce(F.size(ids), F.lit(0)) <= 0).cast("int")), F.lit(0)).alias("no_match"), has.alias("has"), F.round(F.avg(F.greatest(F.size(ids), F.lit(0))), 1).alias("mean_ids"),
    )
    missing = F.array_sort(F.array_except(F.array(*[F.lit(a) for a in golden.PRIORITY]), "has"))
    return x.select("entries", "unanswerable", "no_match", F.size("has").alias("covered"), missing.alias("missing"), "mean_ids")


def key_prompts(items: DataFrame, units: DataFrame) -> DataFrame:
    """(query_id, prompt) with the text of each item's gold provisions in their order; of a label given twice the last text."""
    text = units.where("article_number is not null").groupBy(F.col("article_number").alias("label")).agg(F.max("text").alias("text"))
    p = items.select("query_id", F.posexplode("gold_provisions").alias("i", "label")).join(text, "label")
    p = p.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("i", F.concat(F.lit("["), "label", F.lit("]\n"), "text").alias("b")))).alias("bs"))
    x = items.select("query_id", "query").join(p, "query_id", "left")
    return x.select("query_id", F.concat(F.lit(ANSWER_KEY + "Question: "), F.coalesce("query", F.lit("")), F.lit("\n\n"), F.coalesce(F.array_join(F.transform("bs", lambda b: b["b"]), "\n\n"), F.lit(""))).alias("prompt"))


def build(old: DataFrame, gold: DataFrame, previous: DataFrame, units: DataFrame, ask: Ask, unanswerable: DataFrame | None = None, note: str = "labels reviewed") -> DataFrame:
    """old with the gold lists of (query_id, gold_provisions); facts kept where the list is as before, else asked for.

    A gold label that no unit has is an error. Unreadable replies give no facts. The unanswerable questions (query_id,
    split, query) are added without gold.
    """
    lost = golden.missing_labels(gold, units)
    if missing := sorted(r["label"] for r in lost.limit(20).collect()):
        raise ValueError(f"gold provisions not in the corpus: {missing}")
    x = golden.relabel(old, gold, previous)
    reply = ask(key_prompts(x.where("expected_answer_elements is null"), units)).select("query_id", F.from_json(F.regexp_extract("raw", r"(?s)\{.*\}", 0), "elements array<string>")["elements"].alias("__e"))
    none = F.array().cast("array<string>")
    cols = ["query_id", "query", "query_type", "difficulty", "persona", "split"]
    out = x.join(reply, "query_id", "left").select(*cols, F.lit(False).alias("is_unanswerable"), "gold_provisions", F.coalesce("expected_answer_elements", "__e", none).alias("expected_answer_elements"), F.lit(note).alias("notes"))
    if unanswerable is None:
        return out
    add = unanswerable.select("query_id", "query", F.lit("out_of_corpus").alias("query_type"), F.lit("medium").alias("difficulty"), F.lit("general").alias("persona"), "split", F.lit(True).alias("is_unanswerable"), none.alias("gold_provisions"), none.alias("expected_answer_elements"), F.lit("answer absent from the corpus").alias("notes"))
    return out.unionByName(add)
