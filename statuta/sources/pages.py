"""Pages of source files, and the choice between two extractions of a file."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions.text import strip

SCHEMA = "source_file string, page_number int, text string"


def read_pdfs(spark: SparkSession, path: str, extract: Callable[[bytes], list[str | None]], pattern: str = "*.pdf") -> DataFrame:
    """(source_file, page_number, text) of the files under path, pages from 1, null texts as ''.

    `extract` turns a file's bytes into its pages' texts; it runs inside the tasks, so whatever library it needs is
    imported there. A file without pages is an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.element_at(F.split("path", "/"), -1).alias("f"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for f, content in zip(b["f"], b["content"]):
                texts = extract(content)
                if not texts:
                    raise ValueError(f"{f} has no pages")
                yield pd.DataFrame({"source_file": f, "page_number": range(1, len(texts) + 1), "text": [t or "" for t in texts]})

    return files.mapInPandas(run, SCHEMA)


def read_texts(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """Pages of plain text files, parted by form feeds."""
    t = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("source_file"), F.posexplode(F.split("value", "\f")).alias("p", "text"))
    return t.select("source_file", (F.col("p") + 1).alias("page_number"), "text")


def quality(pages: DataFrame, chars: int = 50) -> DataFrame:
    """Per file: pages, characters, pages with fewer than `chars` characters, share of the others."""
    n = F.length(strip(F.coalesce(F.col("text"), F.lit(""))))
    return pages.groupBy("source_file").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"), F.sum((n < chars).cast("int")).alias("short_pages"), F.avg((n >= chars).cast("double")).alias("filled_share"))


def choose(first: DataFrame, second: DataFrame, chars: int = 50, share: float = 0.8) -> DataFrame:
    """All pages of a file from the second extraction where too few of the first one's are filled, else from the first."""
    poor = quality(first, chars).where(F.col("filled_share") < share).select("source_file")
    return first.join(poor, "source_file", "left_anti").unionByName(second.join(poor, "source_file", "left_semi").withColumn("text", F.coalesce("text", F.lit(""))))
