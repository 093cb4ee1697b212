"""Retrieval, answering, ingestion and evaluation as whole plans over batches of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta import adapters
from statuta.config import EngineConfig, run_id
from statuta.functions.payloads import prompts
from statuta.functions.refs import bad_framing, citation_status, citations, declines
from statuta.operators import bm25, chunk, dense, fuse, metrics, parse, provisions, store, verify
from statuta.runtime import cut
from statuta.sources.tables import log_queries

META = ("chunk_id", "text", "article_number", "section_type", "title", "parent_document")


def search(queries: DataFrame, chunks: DataFrame, cfg: EngineConfig = EngineConfig(), filters: dict | None = None, scorer=None, filter_lexical: bool = False, qkey: str = "query_id") -> DataFrame:
    """The top_k hits of each query with the chunks' attributes, rank from 0.

    queries has the key, `query` and, unless the strategy is lexical, `vector`; chunks has `embedding`. Filters hold for
    the dense side, for the lexical side only with filter_lexical. A scorer reranks a pool of candidates, and only then
    does explanatory text lose its penalty.
    """
    reranks = cfg.rerank and scorer is not None
    pool = cfg.pool if reranks else cfg.top_k
    wide = max(3 * pool, 20)
    meta = chunks.select(*META)
    q = queries.select(qkey, *[c for c in ("query", "vector") if c in queries.columns])
    lexical = lambda k: bm25.search(q, dense.filtered(chunks, filters) if filter_lexical else chunks, k, qkey, cfg=cfg)
    vectors = lambda k: dense.search(q, chunks, k, qkey, key="chunk_id", filters=filters)
    if cfg.strategy == "bm25":
        hits = lexical(pool)
    elif cfg.strategy == "dense":
        hits = vectors(pool)
    elif cfg.strategy == "hybrid":
        hits = fuse.rrf(vectors(wide), lexical(wide), pool, qkey, constant=cfg.rrf_constant)
    else:
        raise ValueError(f"unknown strategy {cfg.strategy}")
    # texts join the few hits only
    hits = hits.join(meta, "chunk_id").join(q.select(qkey, "query"), qkey)
    if reranks:
        hits = fuse.operative_first(fuse.rerank(hits, scorer, qkey), cfg.top_k, cfg.recital_penalty, qkey)
    return hits


def answer_queries(queries: DataFrame, chunks: DataFrame, answerer: Callable, system: str, cfg: EngineConfig = EngineConfig(), filters: dict | None = None, scorer=None, log_path: str | None = None, qkey: str = "query_id") -> DataFrame:
    """Answers with their citations checked; a query without hits is declined without asking the model.

    The answers are kept, so the log and whoever reads the result share one call of the model a query.
    """
    queries = cut(queries)  # their vectors may come from a model too
    hits = search(queries, chunks, cfg, filters, scorer, qkey=qkey)
    given = hits.groupBy(qkey).agg(F.collect_list("article_number").alias("labels"), F.collect_list("text").alias("texts"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"))
    said = adapters.answer(prompts(hits, qkey), answerer, system, qkey)
    out = queries.select(qkey, "query").join(given.join(said, qkey), qkey, "left")
    out = out.withColumn("answered", F.col("answer").isNotNull() & ~declines(F.col("answer")))
    out = verify.verify(out.fillna("", ["answer"]).withColumn("labels", F.coalesce("labels", F.array().cast("array<string>"))).withColumn("texts", F.coalesce("texts", F.array().cast("array<string>"))))
    out = cut(out)
    if log_path:
        log_queries(out.select(qkey, "query", "answered", "chunk_ids", "citations", "accuracy", "latency_ms"), log_path)
    return out


def passages(hits: DataFrame, gold: str = "gold_provisions", shown: int = EngineConfig().provisions_shown) -> DataFrame:
    """hits (with provisions and the question's gold) as a record shows them: rank from 1, the first provisions and their
    number, whether one is gold, characters."""
    return hits.select(
        *[c for c in ("query_id", "response_id") if c in hits.columns], (F.col("rank") + 1).alias("rank"), F.col("article_number").alias("label"), F.slice("provisions", 1, shown).alias("contains"),
        F.size("provisions").alias("contains_count"), provisions.contains_any(F.col("provisions"), F.col(gold)).alias("relevant"), F.length("text").alias("chars"),
    )


def response_view(answers: DataFrame, hits: DataFrame, experiment: str = "", corpus: str = EngineConfig().corpus, qkey: str = "query_id") -> DataFrame:
    """Answers as a service gives them out: rounded, with their passages in order; an answer without hits has none."""
    p = hits.groupBy(qkey).agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "article_number", "title", "score"))).alias("retrieved_chunks"))
    none = F.array().cast("array<struct<rank:int,chunk_id:string,article_number:string,title:string,score:double>>")
    return answers.join(p, qkey, "left").select(
        qkey, "query", "answered", "answer", "citations", F.when(F.col("answered"), F.col("accuracy")).alias("citation_accuracy"), F.coalesce("retrieved_chunks", none).alias("retrieved_chunks"),
        F.round("latency_ms", 1).alias("latency_ms"), F.round("cost_usd", 6).alias("cost_usd"), F.lit(experiment).alias("experiment_id"), F.lit(corpus).alias("corpus"),
    )


def shown_records(golden: DataFrame, run: DataFrame, annotations: DataFrame, qkey: str = "query_id") -> DataFrame:
    """A run's records with what the golden set expects and their annotation; `none` and '' where there is no such."""
    g = golden.select(qkey, "expected_answer_elements").dropDuplicates([qkey])
    x = run.join(g, qkey, "left").join(annotations.select(qkey, "failure_class", F.col("notes").alias("annotation")), qkey, "left")
    return x.withColumns({"expected_answer_elements": F.coalesce("expected_answer_elements", F.array().cast("array<string>")), "failure_class": F.coalesce("failure_class", F.lit("none")), "annotation": F.coalesce("annotation", F.lit(""))})


def ingest(pages: DataFrame, existing: DataFrame | None = None, fixed: bool = False, cfg: EngineConfig = EngineConfig(), run: str | None = None) -> DataFrame:
    """Chunks of the pages' units, put into an existing collection by content; ingesting again changes nothing."""
    units = parse.units(pages)
    name = run or run_id()
    new = chunk.fixed_size(units, cfg.chunk_words, cfg.chunk_overlap).withColumn("ingestion_run_id", F.lit(name)).withColumn("chunk_hash", F.col("chunk_id")) if fixed else chunk.structural(units, name)
    new = new.dropDuplicates(["chunk_id"])
    return new if existing is None else store.upsert(existing, new)


def evaluate(golden: DataFrame, hits: DataFrame, units: DataFrame, answers: DataFrame | None = None, cfg: EngineConfig = EngineConfig(), qkey: str = "query_id") -> DataFrame:
    """One record per question: retrieval metrics by the provisions that the hits' texts hold, and its answer's checks."""
    own = provisions.owners(units, cfg.shingle)
    passages = hits.select("chunk_id", "text").dropDuplicates(["chunk_id"])
    held = provisions.in_order(provisions.contained(passages, own, "chunk_id", size=cfg.shingle), "chunk_id")
    none = F.array().cast("array<string>")
    h = hits.join(held, "chunk_id", "left").withColumn("provisions", F.coalesce("provisions", none)).join(golden.select(qkey, "gold_provisions"), qkey)
    h = h.withColumn("hit", provisions.contains_any(F.col("provisions"), F.col("gold_provisions")))
    records = golden.select(qkey, "is_unanswerable").join(metrics.per_query(golden, h, qkey), qkey)
    if answers is None:
        return records
    ctx = h.groupBy(qkey).agg(F.array_distinct(F.flatten(F.collect_list("provisions"))).alias("shown"), F.collect_list("article_number").alias("labels"), F.concat_ws("\n", F.collect_list("text")).alias("context"))
    a = answers.select(qkey, "answer", "cost_usd", "latency_ms").join(ctx, qkey, "left")
    st = F.transform(citations(F.col("answer")), lambda c: citation_status(c, F.coalesce("shown", none), F.coalesce("labels", none), F.coalesce("context", F.lit(""))))
    a = a.withColumn("st", st)
    n = lambda s: F.size(F.filter("st", lambda x: x == s))
    return records.join(
        a.select(
            qkey, declines(F.col("answer")).alias("declined"), F.size("st").alias("n_citations"), n("retrieved").alias("n_retrieved"), n("wrong_label").alias("n_wrong_label"),
            n("cross_reference").alias("n_cross_reference"), n("unsupported").alias("n_unsupported"), verify.completeness(F.col("answer")).alias("citation_completeness"),
            bad_framing(F.col("answer")).alias("bad_framing"), F.length(F.coalesce("context", F.lit(""))).alias("context_chars"), "cost_usd", "latency_ms",
        ), qkey, "left",
    )
