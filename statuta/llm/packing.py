"""Problem 9: containers of fixed capacity filled with items of varying length."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.runtime import cut

#: Containers that one partition fills at first, and rounds in which partitions with a gap exchange items, MEET of them
#: at a time on average.
PART_BINS = 512
ROUNDS = 3
MEET = 4


def pieces(sizes: DataFrame, capacity: int, key: str = "doc_id", size: str = "tokens") -> DataFrame:
    """(key, piece, start, size): an item as it is, or, if larger than the capacity, cut into full pieces and a rest."""
    n = F.greatest(F.ceil(F.col(size) / F.lit(capacity)).cast("int"), F.lit(1))
    p = sizes.select(key, F.col(size).alias("__n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    start = (F.col("piece").cast("long") * capacity).alias("start")
    return p.select(key, "piece", start, F.least(F.lit(capacity).cast("long"), F.col("__n") - F.col("piece").cast("long") * capacity).alias("size"))


def lower_bound(sizes: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """Containers that any packing needs, by dual-feasible functions; counts tells how often each size occurs.

    For a threshold t up to half the capacity: items over capacity - t count as full, items under t as nothing, others
    as they are; and by the rounding functions u_k, k = 1..20, for items by (k + 1) / capacity.
    """
    sizes = np.asarray(sizes, dtype=np.int64)
    counts = np.ones_like(sizes) if counts is None else np.asarray(counts, dtype=np.int64)
    counts, sizes = counts[sizes > 0], sizes[sizes > 0]
    if not len(sizes):
        return 0
    order = np.argsort(sizes, kind="stable")
    s, c = sizes[order], counts[order]
    total, number = np.concatenate([[0], np.cumsum(s * c)]), np.concatenate([[0], np.cumsum(c)])
    best = -(-int(total[-1]) // capacity)
    t = np.unique(np.concatenate([[0], s[s * 2 <= capacity], capacity - s[s * 2 > capacity]]))
    t = t[t * 2 <= capacity]
    low, high = np.searchsorted(s, t, "left"), np.searchsorted(s, capacity - t, "right")
    best = max(best, int((-(-(total[high] - total[low]) // capacity) + number[-1] - number[high]).max()))
    for k in range(1, 21):
        x = s * (k + 1)
        u = np.where(x % capacity == 0, s * k, (x // capacity) * capacity)
        best = max(best, -(-int((u * c).sum()) // (k * capacity)))
    return best


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """The container of each of the sizes, which come largest first, each into the fullest that still takes it."""
    room: list[tuple[int, int]] = []
    out, n = [], 0
    for s in sizes:
        i = bisect_left(room, (s, -1))
        if i < len(room):
            left, b = room.pop(i)
        else:
            left, b, n = capacity, n, n + 1
        out.append(b)
        insort(room, (left - s, b))
    return out


def _pack(capacity: int, key: str):
    """Items with their container in `bin`, packed anew by best-fit decreasing; as they were if that takes no fewer.

    Items that come from several partitions keep these if nothing is gained. A packing's own bound certifies it.
    """

    def pack(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["size", key, "piece"], ascending=[False, True, True])
        b = best_fit(d["size"].tolist(), capacity)
        if d["bins"].iloc[0] >= 0 and max(b) + 1 >= d[["part", "round", "bins"]].drop_duplicates()["bins"].sum():
            return d
        return d.assign(part=d["to"], round=d["now"], bin=np.array(b, dtype="int64"), bins=np.int64(max(b) + 1), bound=np.int64(lower_bound(d["size"].to_numpy(), capacity)))

    return pack


def fill(items: DataFrame, capacity: int, key: str = "doc_id", part_bins: int = PART_BINS, rounds: int = ROUNDS) -> DataFrame:
    """(key, piece, start, size, container, part_bins, part_bound) of every piece.

    Items are hashed into partitions of about part_bins containers, each packed by best-fit decreasing and certified by
    a lower bound. Partitions that used more than their bound meet, about MEET at a time and others each round, exchange
    all their items and are packed together; they part again as they were unless that saves containers. Items of size 0
    lie in any container; ties go to the smaller key, so a run repeats exactly.
    """
    kind = items.schema[key].dataType.simpleString()
    total = items.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = max(1, round(total / capacity / part_bins))
    cols = {key: kind, "piece": "int", "start": "long", "size": "long", "part": "long", "round": "int", "bin": "long", "bins": "long", "bound": "long"}
    schema = ", ".join(f"`{c}` {k}" for c, k in cols.items())

    def deal(df: DataFrame, to: Column, r: int) -> DataFrame:
        d = df.withColumns({"to": to.cast("long"), "now": F.lit(r)})
        return cut(d.groupBy("to").applyInPandas(lambda x: _pack(capacity, key)(x)[list(cols)], schema))

    first = items.select(key, "piece", "start", "size", *[F.lit(-1).cast(cols[c]).alias(c) for c in ("part", "round", "bin", "bins", "bound")])
    done = deal(first, F.pmod(F.xxhash64(key, "piece"), F.lit(parts)), 0)
    for r in range(1, rounds + 1):
        gaps = done.where("bins > bound")
        n = gaps.select("part", "round").distinct().count()
        if n < 2:
            break
        done = cut(done.where("bins <= bound").unionByName(deal(gaps, F.pmod(F.xxhash64(F.lit(r), "part", "round"), F.lit(max(1, n // MEET))), r)))
    container = F.concat_ws("-", F.col("round"), F.col("part"), F.col("bin"))
    return done.select(key, "piece", "start", "size", container.alias("container"), F.col("bins").alias("part_bins"), F.col("bound").alias("part_bound"))


def certificate(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, the bound that any packing of all pieces needs, pieces, tokens, and the share of space filled.

    Pieces are counted by size, of which there are no more than the capacity, so the bound for the whole set is exact
    however many pieces there are. No pieces give zeros, and a null share.
    """
    sizes = packed.groupBy("size").agg(F.count(F.lit(1)).alias("n"))  # at most capacity + 1 rows
    bound = sizes.groupBy().applyInPandas(lambda d: pd.DataFrame({"bound": [lower_bound(d["size"].to_numpy(), capacity, d["n"].to_numpy())], "pieces": [int(d["n"].sum())], "tokens": [int((d["size"] * d["n"]).sum())]}), "bound long, pieces long, tokens long")
    used = packed.where("size > 0").select("container").distinct().agg(F.count(F.lit(1)).alias("containers"))
    return used.crossJoin(bound).select("containers", "bound", "pieces", "tokens", (F.col("tokens") / F.nullif("containers", F.lit(0)) / capacity).alias("filled"))
