"""The data-preparation queries, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.llm import copies, overlap, packing, pairs, sampling, scans, sentences, splits, terms, tokens
from statuta.runtime import cut, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    report = sampling.targets_report(sampling.pool(table(spark, d, "golden_dataset")), table(spark, d, "sample_targets"))
    return report.where("unmet").select("plan_name", "field_name", "category").distinct()


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample(sampling.pool(table(spark, d, "golden_dataset")), table(spark, d, "sample_targets"))


def p1_targets(spark: SparkSession, d: str) -> DataFrame:
    return sampling.targets_report(sampling.pool(table(spark, d, "golden_dataset")), table(spark, d, "sample_targets")).drop("key")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return sampling.seats_report(sampling.pool(table(spark, d, "golden_dataset")), table(spark, d, "sample_targets")).drop("key")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(table(spark, d, "llm_responses")).distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = splits.violations(splits.records(table(spark, d, "golden_dataset")))
    return found.select(F.col("act").alias("parent_document"), F.col("provision").alias("source_article")).distinct()


def p3_assign(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign(splits.records(table(spark, d, "golden_dataset")), table(spark, d, "split_targets"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.damage(table(spark, d, "raw_pages")).distinct()


def p4_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scans.paragraphs(table(spark, d, "raw_pages"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.top_term(terms.term_scores(table(spark, d, "chunks"))).select("chunk_id", "term")


def p5_scores(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_scores(table(spark, d, "chunks"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlap.overlaps(table(spark, d, "golden_dataset"))
    return pairs.select(F.least("item_eval", "item_train").alias("item_id_a"), F.greatest("item_eval", "item_train").alias("item_id_b"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.report(table(spark, d, "golden_dataset"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    g = copies.copies(*copies.collapse(table(spark, d, "golden_dataset"), "item_id", "query"))
    c = copies.copies(*copies.collapse(copies.payload_fields(table(spark, d, "candidate_records")), "record_id", "fields"))
    name = lambda df, t: df.select(F.lit(t).alias("table_name"), "keep_id", "copy_id")
    return name(g, "golden_dataset").unionByName(name(c, "candidate_records"))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    _, g = copies.collapse(table(spark, d, "golden_dataset"), "item_id", "query")
    _, c = copies.collapse(copies.payload_fields(table(spark, d, "candidate_records")), "record_id", "fields")
    name = lambda df, t: df.select(F.lit(t).alias("table_name"), "keep_id", "copies")
    return name(g, "golden_dataset").unionByName(name(c, "candidate_records"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def _packed(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    capacity = table(spark, d, "pack_capacities").where("container_kind = 'standard'").first()["capacity_tokens"]
    items = cut(packing.pieces(tokens.count_tokens(table(spark, d, "documents")), capacity))
    return packing.fill(items, capacity), capacity


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that lie in more than one container of the packing."""
    per = _packed(spark, d)[0].groupBy("doc_id").agg(F.min("container").alias("a"), F.max("container").alias("b"))
    return per.where("a <> b").select("doc_id")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)[0].select("container", "doc_id", "piece", "start", F.col("size").alias("tokens"), "part_bins", "part_bound")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.certificate(*_packed(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents")).distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    here = globals()
    return {k: here[k] for k in sorted(here) if k[0] == "p" and k[1:2].isdigit()}
