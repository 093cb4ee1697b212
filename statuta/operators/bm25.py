"""Okapi BM25 over a batch of queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta.config import EngineConfig
from statuta.functions.text import tokenise

#: Documents and queries that a task gets, and of those that it scores at once.
DOC_BLOCK, QUERY_BLOCK, BLOCK, SUB = 131_072, 40_960, 8192, 256
#: Terms that are scored by matrix products at most, and the share of the pairs of query and document that must have them.
MATRIX, SHARE = 320, 0.0005


def corpus_stats(docs: DataFrame, text: str) -> tuple[int, float]:
    """(number of documents, average number of tokens)."""
    n, avg = docs.agg(F.count(F.lit(1)), F.avg(F.size(tokenise(F.col(text))))).first()
    return n, avg or 0.0


def term_stats(docs: DataFrame, text: str, cfg: EngineConfig = EngineConfig(), n: int | None = None) -> DataFrame:
    """(term, df, idf): negative idf is replaced by epsilon times the mean of all, negatives included.

    Each document sends a term once, and counts are summed before the shuffle.
    """
    n = n if n is not None else docs.count()
    df = docs.select(F.explode(F.array_distinct(tokenise(F.col(text)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = df.withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).withColumn("one", F.lit(1))
    mean = raw.agg(F.avg("raw").alias("mean")).withColumn("one", F.lit(1))
    idf = F.when(F.col("raw") < 0, cfg.epsilon * F.col("mean")).otherwise(F.col("raw"))
    return raw.join(F.broadcast(mean), "one").select("term", "df", idf.alias("idf"))  # mean: one row


def _encoder(key: str, kind: str, vocabulary):
    """Replaces hashed words by the vocabulary's numbers: each once, in halves, with its count. Words outside it are left out."""

    def run(batches):
        known, number, _ = vocabulary.value
        for x in batches:
            w = x.column("ws")
            at = w.offsets.to_numpy().astype(np.int64)
            flat = w.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]
            row = np.repeat(np.arange(len(at) - 1), np.diff(at))
            i = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
            ok = known[i] == flat if len(known) else np.zeros(len(flat), bool)
            code, n = np.unique((row[ok] << 32) | number[i[ok]], return_counts=True)
            ends = np.r_[0, np.cumsum(np.bincount(code >> 32, minlength=len(at) - 1))]
            bin_ = lambda v: pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((ends * v.itemsize).astype(np.int32).tobytes()), pa.py_buffer(v.tobytes())])
            yield pa.RecordBatch.from_arrays([x.column(key), pa.array(np.diff(at), pa.int32()), bin_((code & 0xFFFF).astype(np.uint16)), bin_(((code >> 16) & 0xFFFF).astype(np.uint16)), bin_(n.astype(np.int32))], [key, "n", "lo", "hi", "tf"])

    return run, f"`{key}` {kind}, n int, lo binary, hi binary, tf binary"


def _decoded(x: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of encoded rows, in order of row and term."""
    all_ = lambda c, t: np.frombuffer(b"".join(x[c]), t)
    term = all_("hi", np.uint16).astype(np.int32) << 16
    term |= all_("lo", np.uint16)
    return np.repeat(np.arange(len(x), dtype=np.int32), [len(b) // 2 for b in x["lo"]]), term, all_("tf", np.int32)


def _ranges(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each start on, n of each."""
    return np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)


def _scorer(qkey: str, key: str, k: int, avgdl: float, cfg: EngineConfig, vocabulary):
    """The k best of a block of documents for a block of queries, 0 for no shared term, and all about as good as the k-th.

    Frequent terms are matrix products of single precision, the others are added posting by posting. What may be among
    the k best in spite of that precision is scored again in double precision.
    """

    def run(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(d):
            return pd.DataFrame({qkey: q[qkey][:0], key: d[key][:0], "score": np.zeros(0)})
        idf = vocabulary.value[2]
        asked_by, at = np.unique(q[qkey].to_numpy(), return_inverse=True)
        qi, qt, qf = _decoded(q)
        o = np.argsort(at[qi], kind="stable")
        qi, qt, qw, nq = at[qi][o], qt[o], (qf * idf[qt])[o], len(asked_by)
        often = np.bincount(qt, minlength=len(idf))
        d = d.sort_values(key)
        keys, length = d[key].to_numpy(), cfg.k1 * (1 - cfg.b + cfg.b * d["n"].to_numpy() / avgdl)
        di, dt, tf = _decoded(d)
        del q, d
        use = often[dt] > 0
        di, dt, tf = di[use], dt[use], tf[use]
        weight = lambda at: tf[at] * (cfg.k1 + 1) / (tf[at] + length[di[at]])  # noqa: E731  # of a few at a time, as memory is short
        pairs = often * np.bincount(dt, minlength=len(idf))
        heavy = np.argsort(-pairs)[:MATRIX]
        heavy = heavy[pairs[heavy] > SHARE * nq * len(keys)]
        column = np.full(len(idf), -1)
        column[heavy] = np.arange(len(heavy))
        kind = np.float64 if (qw < 0).any() else np.float32  # weights of one sign can't cancel to 0
        m, h = np.zeros((nq, len(heavy)), kind), column[qt] >= 0
        np.add.at(m, (qi[h], column[qt[h]]), qw[h].astype(kind))
        ri, rt, rw = qi[~h], qt[~h], qw[~h]
        # a sum of n numbers is off by n roundings of all of them at most
        margin = 2e-6 + (len(heavy) + 64) * np.finfo(kind).eps * (cfg.k1 + 1) * np.bincount(qi, np.abs(qw), nq)
        floor, zeros = np.full(nq, -np.inf), np.zeros(nq, int)
        found: list[tuple] = []
        for lo in range(0, len(keys), BLOCK):
            n, (i, j) = min(BLOCK, len(keys) - lo), np.searchsorted(di, (lo, lo + BLOCK))
            bi, bt, bv = di[i:j] - lo, dt[i:j], weight(slice(i, j))
            h = column[bt] >= 0
            w = np.zeros((len(heavy), n), kind)
            w[column[bt[h]], bi[h]] = bv[h]
            o = np.argsort(bt[~h], kind="stable")
            bi, bt, bv = bi[~h][o], bt[~h][o], bv[~h][o]
            start, end = np.searchsorted(bt, rt), np.searchsorted(bt, rt, "right")
            g = max(1, n // max(128, 4 * k))
            for a in range(0, nq, SUB):
                part = slice(a, min(a + SUB, nq))
                s = m[part] @ w
                x, y = np.searchsorted(ri, (a, a + SUB))
                times = end[x:y] - start[x:y]
                p = _ranges(start[x:y], times)
                np.add.at(s.reshape(-1), np.repeat((ri[x:y] - a) * n, times) + bi[p], (np.repeat(rw[x:y], times) * bv[p]).astype(kind))
                if (groups := n // g) >= k:
                    best = s[:, : groups * g].reshape(len(s), groups, g).max(axis=2)
                    floor[part] = np.maximum(floor[part], np.partition(best, groups - k, axis=1)[:, groups - k])
                limit = (floor[part] - 2 * margin[part]).astype(kind)[:, None]
                r, c = np.divmod(np.flatnonzero(s >= limit), n)
                some = s[r, c] != 0
                found.append((r[some] + a, c[some] + lo, s[r[some], c[some]]))
                for r in np.nonzero((limit[:, 0] <= 0) & (zeros[part] < k))[0]:
                    c = np.nonzero(s[r] == 0)[0][: k - zeros[a + r]]
                    zeros[a + r] += len(c)
                    found.append((np.full(len(c), a + r), c + lo, np.zeros(len(c))))
        r, c, s = (np.concatenate(x) for x in zip(*found))
        few = s >= floor[r] - 2 * margin[r]
        r, c = r[few], c[few]
        r, c = r[o := np.lexsort((c, r))], c[o]
        code = di * np.int64(len(idf))
        code += dt
        first = np.searchsorted(qi, np.arange(nq + 1))
        exact = np.zeros(len(r))
        for a in range(0, len(r), 100_000):
            x, y = r[a : a + 100_000], c[a : a + 100_000]
            times = first[x + 1] - first[x]
            p = _ranges(first[x], times)
            want = np.repeat(y, times) * np.int64(len(idf)) + qt[p]
            i = np.minimum(np.searchsorted(code, want), max(len(code) - 1, 0))
            hit = code[i] == want if len(code) else np.zeros(len(want), bool)
            exact[a : a + 100_000] = np.bincount(np.repeat(np.arange(len(x)), times)[hit], qw[p[hit]] * weight(i[hit]), len(x))
        r, c, s = r[o := np.lexsort((-exact, r))], c[o], exact[o]
        first = np.searchsorted(r, np.arange(nq))
        kth = np.minimum(first + k, np.searchsorted(r, np.arange(nq), "right")) - 1
        top = s >= s[kth][r] - 2e-6
        return pd.DataFrame({qkey: asked_by[r[top]], key: keys[c[top]], "score": s[top]})

    return run


def search(queries: DataFrame, docs: DataFrame, k: int, qkey: str = "query_id", qtext: str = "query", key: str = "chunk_id", text: str = "text", cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """(query, document, score, rank): the k best documents of each query, rank from 0.

    Scores are rounded to 6 places and ties go to the smaller key, the corpus' order. A term that a query repeats counts
    again. Documents that share no term score 0. A query without terms gets the first k documents. The vocabulary is
    broadcast as 64 bits for a term, its number and its idf; blocks of queries meet blocks of documents, so a frequent
    term is no hot key, and each pair of blocks sends on about k documents a query.
    """
    spark = docs.sparkSession
    n, avgdl = corpus_stats(docs, text)
    terms = term_stats(docs, text, cfg, n).select(F.xxhash64("term").alias("t"), "df", "idf").toArrow()
    known, df, idf = (terms.column(c).to_numpy() for c in ("t", "df", "idf"))
    o = np.argsort(known)
    frequent = np.lexsort((known, -df))  # numbers by frequency, so that most fit 16 bits
    number = np.empty(len(df), np.int64)
    number[frequent] = np.arange(len(df))
    vocabulary = spark.sparkContext.broadcast((known[o], number[o], idf[frequent]))
    cores, many = spark.sparkContext.defaultParallelism, queries.count()
    nq, nd = max(1, -(-many // QUERY_BLOCK), min(cores, -(-many // SUB))), max(1, -(-n // DOC_BLOCK))
    kinds = {c: x.schema[c].dataType.simpleString() for x, c in ((queries, qkey), (docs, key))}

    def encoded(x: DataFrame, c: str, t: str) -> DataFrame:
        return x.select(c, F.transform(tokenise(F.col(t)), lambda w: F.xxhash64(w)).alias("ws")).mapInArrow(*_encoder(c, kinds[c], vocabulary))

    long = lambda x: F.lit(x).cast("long")
    a = encoded(queries, qkey, qtext).withColumn("qb", F.pmod(F.xxhash64(qkey), long(nq))).withColumn("db", F.explode(F.sequence(long(0), long(nd - 1))))
    b = encoded(docs, key, text).withColumn("db", F.pmod(F.xxhash64(key), long(nd))).withColumn("qb", F.explode(F.sequence(long(0), long(nq - 1))))
    a, b = (x.repartition(16 * nq * nd, "qb", "db") for x in (a, b))  # so many that two pairs of blocks seldom share a task
    hits = a.groupBy("qb", "db").cogroup(b.groupBy("qb", "db")).applyInPandas(_scorer(qkey, key, k, avgdl, cfg, vocabulary), f"`{qkey}` {kinds[qkey]}, `{key}` {kinds[key]}, score double")
    return row_top(hits.withColumn("score", F.round("score", 6)), qkey, key, k)


def row_top(hits: DataFrame, qkey: str, key: str, k: int, score: str = "score", ascending: bool = False) -> DataFrame:
    """The k best of each query with `rank` from 0; ties go to the smaller key."""
    order = F.col(score).asc() if ascending else F.col(score).desc()
    rn = F.row_number().over(W.partitionBy(qkey).orderBy(order, F.col(key)))
    return hits.withColumn("rn", rn).where(F.col("rn") <= k).withColumn("rank", F.col("rn") - 1).drop("rn")
