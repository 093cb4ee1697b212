"""Session, table access, lineage cuts and skew-safe joins shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot from this share of all rows; so there are never more than 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 512
#: Rows of a window or group that one task may gather at most.
BLOCK_ROWS = 4096


def make_session(cpus: str | int = "*", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with the settings that the operators are written for."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("statuta")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir; only a session on one machine may make its own."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="statuta-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """As cut, as a table: for many rows of which later steps read some columns. Removed when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/statuta-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession, at_least: int = 2) -> int:
    """Partitions for work that is heavy per row and must not stay in the few partitions of a small file."""
    return max(at_least, 2 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df in enough partitions for CPU-heavy stages, by keys if given."""
    n = max(tasks(df.sparkSession), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys) if keys else df.repartition(n)


def widen(df: DataFrame) -> DataFrame:
    """df spread over the cores where its files give fewer partitions than those; unmoved otherwise."""
    return spread(df) if df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism else df


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join in which it must not be broadcast: sizes are estimated from compressed files, before rows explode."""
    return df.hint("merge")


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join of rows with one record per group, safe when one group holds a large share of the rows.

    groups has the group's number of rows in column `size`. Groups of HOT_SHARE of `total` rows or more are at most
    1 / HOT_SHARE in number, so they are broadcast and their rows stay where they are; the others meet in a shuffle.
    """
    limit = max(1.0, total * HOT_SHARE)
    hot = F.broadcast(groups.where(F.col(size) >= limit))
    cold = groups.where(F.col(size) < limit)
    hot_keys = hot.select(*keys)
    return rows.join(hot, keys).unionByName(rows.join(hot_keys, keys, "left_anti").join(cold, keys))


def numbered(df: DataFrame, part: list[str], order: Column, out: str, buckets: int | None = None) -> DataFrame:
    """1-based row_number within `part` by the DOUBLE in [0, 1) `order`, without gathering a group in one task.

    Rows are numbered inside narrow ranges of the order, so many that one holds about BLOCK_ROWS rows at most, and the
    counts of the earlier ranges are added. `order` must
    be spread evenly, as a hash is; its ties are broken by all columns of df, so repeated runs agree.
    """
    from pyspark.sql import Window as W

    buckets = buckets or max(1, -(-df.count() // BLOCK_ROWS))
    b = df.withColumn("__o", order).withColumn("__b", F.floor(F.col("__o") * buckets).cast("int"))
    counts = b.groupBy(*part, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn(
        "__before", F.coalesce(F.sum("__n").over(W.partitionBy(*part).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ).drop("__n")
    rank = F.row_number().over(W.partitionBy(*part, "__b").orderBy("__o", *[c for c in df.columns if c not in part]))
    ranked = b.withColumn("__r", rank)
    on = reduce(lambda x, y: x & y, [ranked[c].eqNullSafe(before[c]) for c in [*part, "__b"]])
    return ranked.join(before, on).select(*[ranked[c] for c in df.columns], (F.col("__r") + F.col("__before")).alias(out))
