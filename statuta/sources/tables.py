"""Chunk tables, evaluation sets, runs, annotations and query logs on disk."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.operators.store import upsert

log = logging.getLogger(__name__)


def write_chunks(chunks: DataFrame, path: str, as_json: str | None = None) -> None:
    """The chunks as parquet, in place of what was there; also as JSON if asked."""
    chunks.write.mode("overwrite").parquet(path)
    if as_json:
        chunks.write.mode("overwrite").json(as_json)


def read_array(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records of files that hold a JSON array each, with the file they come from."""
    return spark.read.json(path, multiLine=True).withColumn("source", F.col("_metadata.file_name"))


def read_golden(spark: SparkSession, path: str, split: str | None = None, limit: int | None = None, order: str = "query_id") -> DataFrame:
    """An evaluation set, one split of it, its first rows by `order`."""
    df = read_array(spark, path).drop("source")
    df = df.where(F.col("split") == split) if split else df
    return df.orderBy(order).limit(limit) if limit is not None else df


def write_run(records: DataFrame, summary: DataFrame, path: str, tag: str, split: str) -> None:
    """A run's flat records and its summary, each as JSON lines under path/tag/split."""
    records.write.mode("overwrite").json(f"{path}/{tag}/{split}/records")
    summary.write.mode("overwrite").json(f"{path}/{tag}/{split}/summary")


def read_runs(spark: SparkSession, path: str, tags: list[str], split: str, part: str = "records") -> DataFrame:
    return spark.read.json([f"{path}/{t}/{split}/{part}" for t in tags])


def annotate(spark: SparkSession, path: str, version: int, new: DataFrame, key: str = "query_id") -> DataFrame:
    """Annotations with new rows in place of older ones of their key, written as the next version."""
    try:
        old = spark.read.json(f"{path}/v{version}", schema=new.schema)
        out = upsert(old, new, key)
    except Exception as e:  # the first version
        if "PATH_NOT_FOUND" not in str(e):
            raise
        out = new
    out.write.json(f"{path}/v{version + 1}")
    return spark.read.json(f"{path}/v{version + 1}", schema=new.schema)


def log_queries(rows: DataFrame, path: str) -> bool:
    """Appends answered queries as JSON lines; a failure is logged and reported, never raised."""
    try:
        rows.write.mode("append").json(path)
        return True
    except Exception:
        log.warning("the query log could not be written", exc_info=True)
        return False
