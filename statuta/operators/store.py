"""A collection of content-addressed records: latest versions, upserts, lookups, flat export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("chunk_id", "text", "article_number", "section_type", "title")]
    + [T.StructField("chunk_index", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("parent_document", "source_url", "publication_date", "ingestion_run_id", "chunk_hash")]
    + [T.StructField("cross_references", T.ArrayType(T.StringType()))]
)


def collection(spark: SparkSession, path: str, schema: T.StructType = CHUNK) -> DataFrame:
    """The collection kept at path, empty if there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # the reader's own error for a missing path
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def latest(df: DataFrame, key: str = "chunk_id", version: str = "ingested_at", tie: str = "ingestion_run_id") -> DataFrame:
    """One row per key, that of the latest version; ties go to the greater `tie`, then to the greater row.

    One pre-aggregated pass, so a key with many versions is no hot key. Null keys are dropped.
    """
    rest = [c for c in df.columns if c not in (key, version, tie)]
    top = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(version, tie, *rest)).alias("r"))
    return top.select(*[F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in df.columns])


def upsert(existing: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """existing with the rows of new put in place of those with the same key."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def lookup(df: DataFrame, key: str, value: str) -> DataFrame:
    """The row of a key, by a filter that reaches the scan; LookupError if there is none."""
    found = df.where(F.col(key) == value).limit(1)
    if not found.take(1):
        raise LookupError(f"no record {value}")
    return found


def flat(df: DataFrame) -> DataFrame:
    """Records as flat metadata: nulls are '', lists are joined by |."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.ArrayType):
            c = F.coalesce(F.array_join(c, "|"), F.lit(""))
        elif isinstance(f.dataType, T.StringType):
            c = F.coalesce(c, F.lit(""))
        out.append(c.alias(f.name))
    return df.select(*out)


def unflat(df: DataFrame, lists: tuple[str, ...] = ("cross_references",), nullable: tuple[str, ...] = ("article_number",)) -> DataFrame:
    for c in lists:
        df = df.withColumn(c, F.filter(F.split(c, r"\|"), lambda x: x != ""))
    for c in nullable:
        df = df.withColumn(c, F.when(F.col(c) != "", F.col(c)))
    return df
