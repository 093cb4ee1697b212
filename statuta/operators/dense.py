"""Exact nearest neighbours of a batch of query vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.operators.bm25 import row_top

#: Vectors of a block; a task holds one block of queries and one of records, and the distances between them.
BLOCK = 2048


def filtered(df: DataFrame, filters: dict | None) -> DataFrame:
    """Rows that equal all of filters, or are among a list's values; all rows for none or an empty dict."""
    for k, v in (filters or {}).items():
        df = df.where(F.col(k).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(k) == v)
    return df


def search(queries: DataFrame, vectors: DataFrame, k: int, qkey: str = "query_id", qvec: str = "vector", key: str = "vec_id", vec: str = "embedding", filters: dict | None = None, block: int = BLOCK) -> DataFrame:
    """(query, record, score, rank): the k nearest records of each query by squared Euclidean distance, rank from 0.

    Every query meets every record that passes the filters, block against block as a matrix product of doubles; each
    pair of blocks sends on k records a query. Distances are rounded to 6 places, ties go to the smaller key. Null
    vectors are left out, k over the number of records gives all of them.
    """
    r = filtered(vectors, filters).where(F.col(vec).isNotNull()).select(key, F.col(vec).alias("__v"))
    q = queries.where(F.col(qvec).isNotNull()).select(qkey, F.col(qvec).alias("__v"))
    nq, nr = (max(1, -(-x.count() // block)) for x in (q, r))
    side = lambda df, name, n, other, m: df.withColumn(name, F.pmod(F.xxhash64(df.columns[0]), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))
    a, b = side(q, "qb", nq, "rb", nr), side(r, "rb", nr, "qb", nq)
    kinds = {c: df.select(c).schema[c].dataType.simpleString() for df, c in ((q, qkey), (r, key))}

    def near(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({qkey: [], key: [], "score": []})
        y = y.sort_values(key)
        p, s = np.array(x["__v"].tolist(), dtype=np.float64), np.array(y["__v"].tolist(), dtype=np.float64)
        d = (p * p).sum(1)[:, None] + (s * s).sum(1)[None, :] - 2 * p @ s.T
        n = min(k, len(y))
        # whatever is as near as the n-th stays, so that rounding and ties are settled later
        limit = np.partition(d, n - 1, axis=1)[:, n - 1 : n] + 2e-6
        i, j = np.nonzero(d <= limit)
        exact = ((p[i] - s[j]) ** 2).sum(1)
        return pd.DataFrame({qkey: x[qkey].to_numpy()[i], key: y[key].to_numpy()[j], "score": exact})

    hits = a.groupBy("qb", "rb").cogroup(b.groupBy("qb", "rb")).applyInPandas(near, f"`{qkey}` {kinds[qkey]}, `{key}` {kinds[key]}, score double")
    return row_top(hits.withColumn("score", F.round("score", 6)), qkey, key, k, ascending=True)
