"""Connected components by distributed union-find: forests inside partitions, merged level by level."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.runtime import cut, join_groups, tasks

#: Edges that a task holds at most. Forests are merged as long as their edges fit; what is left goes on by star contraction.
TASK_EDGES = 1_000_000
#: Partitions that become one at each level.
FAN_IN = 8


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A spanning forest of the partition's edges, as (node, smallest node of its tree)."""
    up: dict[str, str] = {}

    def find(x: str) -> str:
        r = x
        while up.setdefault(r, r) != r:
            r = up[r]
        while up[x] != r:
            up[x], x = r, up[x]
        return r

    for b in batches:
        for x, y in zip(b["a"], b["b"]):
            p, q = find(x), find(y)
            if p != q:
                up[max(p, q)] = min(p, q)
    nodes = [x for x in up if find(x) != x]
    yield pd.DataFrame({"a": nodes, "b": [find(x) for x in nodes]}, dtype="object")


def _stars(edges: DataFrame) -> DataFrame:
    """(a, b), b the smallest node of a's component, by alternating large-star and small-star steps."""
    before, size = None, edges.count()
    while True:
        for large in (True, False):
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("degree"))
            # the middle of a large star is a hot key
            j = join_groups(both, least, ["a"], "degree", 2 * size)
            if large:
                edges = j.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            else:
                edges = j.where("b <= a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
            edges = edges.where("a <> b").distinct()
        edges = cut(edges)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        size = now[0]
        if now == before:
            return edges
        before = now


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, root) of every node of edges (a STRING, b STRING) that is not its own root.

    Loops and repeated edges count once, edges with a null are dropped, no edges give no rows. The root is the
    smallest node of the component, so the result doesn't depend on the partitions. Edges are dealt by their first node,
    so that a component's middle is no hot key; a task never gets more than about task_edges of them.
    """
    e = cut(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct())
    n = e.count()
    parts = max(tasks(e.sparkSession) if n > task_edges // FAN_IN else 1, -(-n // task_edges))
    forest, whole = e, False
    while not whole:
        forest = cut(forest.repartition(parts, "a").mapInPandas(_forest, "a string, b string"))
        whole, n = parts == 1, forest.count()
        if parts > 1 and n > task_edges * max(1, parts // FAN_IN):
            break  # the next merge wouldn't fit
        parts = max(1, parts // FAN_IN)
    done = forest if whole else _stars(forest)
    return done.select(F.col("a").alias("node"), F.col("b").alias("root"))
