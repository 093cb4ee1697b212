"""Continuous upsert of chunks, and the query log by windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from statuta.operators.store import upsert


def versions(spark: SparkSession, path: str) -> list[int]:
    """The finished versions of a collection, each a directory whose commit file Spark wrote last."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [s.getPath() for s in fs.listStatus(p)]
    return sorted(int(x.getName()[1:]) for x in names if x.getName()[:1] == "v" and x.getName()[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))


def current(spark: SparkSession, path: str) -> DataFrame | None:
    v = versions(spark, path)
    return spark.read.parquet(f"{path}/v{v[-1]}") if v else None


def upsert_stream(source: DataFrame, path: str, checkpoint: str, key: str = "chunk_id", order: str = "ingested_at") -> StreamingQuery:
    """Upserts each batch into the collection at path, as version batch + 1.

    A batch that runs again after a loss writes the same version over, so each row counts once. Of equal keys in a
    batch the latest by `order` stays.
    """

    def put(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        done = [v for v in versions(spark, path) if v <= n]
        old = spark.read.parquet(f"{path}/v{done[-1]}") if done else None
        (new if old is None else upsert(old, new, key)).write.mode("overwrite").parquet(f"{path}/v{n + 1}")

    return source.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log_windows(events: DataFrame, ts: str = "ts", kind: str = "event_type", value: str = "value", size: str = "1 hour", late: str | None = None) -> DataFrame:
    """(window_start, kind, n, total) of tumbling windows; with `late`, later rows than that are dropped from a stream."""
    x = events.withWatermark(ts, late) if late else events
    g = x.groupBy(F.window(ts, size).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("window_start"), kind, "n", "total")
