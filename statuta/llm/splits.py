"""Problem 3: train, validation and test splits that keep related records together."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.components import components
from statuta.llm.labels import act, provision, split_name
from statuta.runtime import cut, join_groups, kept, numbered


def records(golden: DataFrame) -> DataFrame:
    """item_id, the source (act and whole provision), today's split and the keys that tie a record to others.

    A record is tied by its source and by its query_id. Without either it is alone. `spelled` is the source as written.
    """
    a, p = act(F.col("parent_document")), provision(F.col("source_article"))
    source = F.when(a.isNotNull() & p.isNotNull(), F.concat_ws("", F.lit("s"), a, p))
    return golden.select(
        "item_id", a.alias("act"), p.alias("provision"), split_name(F.col("split")).alias("today"),
        F.coalesce(source, F.concat_ws("", F.lit("q"), F.col("query_id")), F.concat_ws("", F.lit("i"), F.col("item_id").cast("string"))).alias("key"),
        F.when(source.isNotNull() & F.col("query_id").isNotNull(), F.concat_ws("", F.lit("q"), F.col("query_id"))).alias("also"),
        F.when(source.isNotNull(), F.concat(F.lit("w"), "parent_document", F.lit("\x1f"), "source_article")).alias("spelled"),
    )


def grouped(rec: DataFrame) -> DataFrame:
    """rec with the `root` of its group: the smallest key reachable over shared keys.

    Keys are counted before the join, so a source with a third of all records meets its root by broadcast.
    """
    sizes = rec.groupBy("key").agg(F.count(F.lit(1)).alias("key_rows"))
    # a query_id that ties nothing else gives no edge
    ties = rec.where("also is not null").groupBy("also").agg(F.min("key").alias("x"), F.max("key").alias("y"))
    bare = rec.where(F.col("key").startswith("q")).select(F.col("key").alias("also")).distinct()
    edges = ties.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    # more than two sources of one query_id: every one is tied to the smallest
    many = rec.where("also is not null").select("also", "key").distinct().join(ties.where("x <> y"), "also").select(F.col("x").alias("a"), F.col("key").alias("b"))
    edges = edges.unionByName(many).unionByName(ties.join(bare, "also").select(F.col("x").alias("a"), F.col("also").alias("b")))
    roots = components(edges).withColumnRenamed("node", "key")
    keys = sizes.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    total = rec.count()
    return join_groups(rec, keys, ["key"], "key_rows", total)


def violations(rec: DataFrame) -> DataFrame:
    """(act, provision, splits, rows) of the sources whose assigned records lie in more than one split today.

    A source is a component of the graph that ties each spelling to the provision that it names, so all spellings and
    depths of a provision are one. Records are counted by spelling and split first, so a source with a third of all
    records is a few rows.
    """
    spelled = cut(rec.where("today is not null and spelled is not null").groupBy("spelled", "key", "act", "provision", "today").agg(F.count(F.lit(1)).alias("n")))
    roots = components(spelled.select(F.col("spelled").alias("a"), F.col("key").alias("b"))).withColumnRenamed("node", "spelled")
    per = spelled.join(roots, "spelled", "left").groupBy(F.coalesce("root", "spelled").alias("root"))
    per = per.agg(F.min("act").alias("act"), F.min("provision").alias("provision"), F.array_sort(F.collect_set("today")).alias("splits"), F.sum("n").alias("rows"))
    return per.where(F.size("splits") > 1)


def placed(classes: pd.DataFrame, shares: list[tuple[str, float]]) -> pd.DataFrame:
    """(n, split, first, last): which of the groups of each size, by their rank, each split takes.

    classes has the sizes n and how many groups have each. Largest first, each group goes to the split that is furthest
    below its target; for m groups of one size that is reached at once: splits fill down to one level of what they lack.
    """
    whole = sum(s for _, s in shares) or 1.0
    total = float((classes["n"] * classes["groups"]).sum())
    lack = np.array([s / whole * total for _, s in shares])
    out = []
    for n, m in classes.sort_values("n", ascending=False)[["n", "groups"]].itertuples(index=False):
        low, high = lack.min() - n * (m + 1), lack.max()
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (low, mid) if np.maximum(np.ceil((lack - mid) / n), 0).sum() <= m else (mid, high)
        take = np.maximum(np.ceil((lack - high) / n), 0)
        for _ in range(int(m - take.sum())):  # as many as there are splits at the same level
            take[int((lack - take * n).argmax())] += 1
        first = 1
        for (name, _), k in zip(shares, take.astype(int)):
            if k:
                out.append((n, name, first, first + k - 1))
            first += k
        lack -= take * n
    return pd.DataFrame(out, columns=["n", "split", "first", "last"])


def assign(rec: DataFrame, targets: DataFrame) -> DataFrame:
    """item_id, group and its new `split`: whole groups, largest first, each to the split furthest below its target.

    One task places the groups by size, of which there are at most the root of twice the records (a million for 10 ** 12);
    which groups of a size go where is drawn by hash. Shares are scaled to sum to 1. Repeated items each get their row;
    an empty table gives no rows.
    """
    rec = kept(rec)
    g = kept(grouped(rec))
    sizes = kept(g.groupBy("root").agg(F.count(F.lit(1)).alias("n")))
    shares = [(r["split_name"], float(r["target_share"])) for r in targets.where("target_share > 0").orderBy("split_name").collect()]
    classes = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("groups"))
    ranges = classes.groupBy().applyInPandas(lambda d: placed(d, shares), "n long, split string, first long, last long")
    ranked = numbered(sizes, ["n"], F.pmod(F.xxhash64("root"), F.lit(1 << 52)) / F.lit(float(1 << 52)), "rank")
    by_root = ranked.join(F.broadcast(ranges), "n").where("rank between first and last").select("root", "split", F.col("n").alias("group_rows"))
    return join_groups(g.select("item_id", "root"), kept(by_root), ["root"], "group_rows", rec.count()).select("item_id", F.col("root").alias("group"), "split")
