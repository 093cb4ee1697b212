"""Problem 1: a sample that matches target shares of several fields at once."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.labels import label
from statuta.runtime import kept, numbered

FIELDS = ("query_type", "difficulty", "persona")
#: Rounds of proportional fitting; the cells are few, so it costs nothing.
FIT_ROUNDS = 400


def pool(golden: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row per question: query_id, its smallest item_id and the normal form of each label.

    A question without query_id counts as one of its own. Deliveries of a question that disagree give the smallest
    label; null and blank labels are null and belong to no category. An empty table gives an empty pool.
    """
    q = F.coalesce(F.col("query_id"), F.concat(F.lit("item:"), F.col("item_id").cast("string")))
    return golden.groupBy(q.alias("query_id")).agg(F.min("item_id").alias("item_id"), *[F.min(label(F.col(f))).alias(f) for f in fields])


def draw_order(seed: int):
    """A uniform number in [0, 1) from the question's id."""
    return (F.xxhash64(F.lit(seed), F.col("query_id")).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))).cast("double")


def targets_report(questions: DataFrame, targets: DataFrame, fields: tuple[str, ...] = FIELDS, seed: int = 7) -> DataFrame:
    """Of each target the rows it asks for, those that a draw for it alone gets, and whether they are too few.

    Each category's questions get random ranks 1..n; the rank r has priority (r - 0.5) / required. A target draws by
    priority until it has greatest(target_share * sample_size, min_rows) rows or its category is exhausted, which makes
    it unmet. A category that the pool lacks draws nothing; `available` is the last rank of a category.
    """
    each = questions.select("query_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("key")) for f in fields])).alias("x"))
    each = each.select("query_id", "x.field_name", "x.key").where(F.col("key").isNotNull())
    ranked = kept(numbered(each, ["field_name", "key"], draw_order(seed), "rank"))
    last = ranked.groupBy("field_name", "key").agg(F.max("rank").alias("available"))
    # as many targets as the plans list, whatever the pool's size
    t = targets.withColumn("key", label(F.col("category")))
    t = t.withColumn("required", F.greatest(F.round(F.col("target_share") * F.col("sample_size"), 6), F.col("min_rows").cast("double")))
    want = F.broadcast(t.where("key is not null").select("plan_name", "field_name", "key", "required"))
    upto = (F.ceil("required") - 0.5) / F.col("required")
    drawn = ranked.join(want, ["field_name", "key"]).where((F.col("rank") - 0.5) / F.col("required") <= upto).groupBy("plan_name", "field_name", "key").agg(F.count(F.lit(1)).alias("drawn"))
    out = t.join(last, ["field_name", "key"], "left").join(drawn, ["plan_name", "field_name", "key"], "left").fillna(0, ["available", "drawn"])
    return out.select("plan_name", "field_name", "category", "key", "sample_size", "target_share", "min_rows", "required", "available", "drawn", (F.col("drawn") < F.col("required")).alias("unmet"))


def _fit(n: np.ndarray, codes: list[np.ndarray], want: list[np.ndarray]) -> np.ndarray:
    """Cell weights, at most n each, whose sums by each field come as near to want as the pool allows."""
    w = n.astype(float)
    for _ in range(FIT_ROUNDS):
        for c, m in zip(codes, want):
            s = np.bincount(c, w, len(m))
            w = np.minimum(n, w * np.divide(m, s, out=np.zeros_like(m), where=s > 0)[c])
    return w


def _improve(got: np.ndarray, n: np.ndarray, codes: list[np.ndarray], need: list[np.ndarray], left: int) -> np.ndarray:
    """Seats after `left` free ones were given to any cell and seats were exchanged as long as fewer are lacking to need."""
    got = got.copy()
    has = [c >= 0 for c in codes]
    lacks = lambda: [m - np.bincount(c[h], got[h], len(m)) for c, h, m in zip(codes, has, need)]
    whole = np.all(has, axis=0)
    while len(got) and (got < n).any():
        lack = [np.where(h, x[c], 0) for x, c, h in zip(lacks(), codes, has)]
        gain = sum(np.where(x > 0, 1.0, 0.0) for x in lack) + 0.1 * whole
        if left > 0:
            j = int(np.where(got < n, gain, -1).argmax())
            step = min([n[j] - got[j], left, *[x[j] for x in lack if x[j] > 0]])
            left -= step
        else:
            # a seat moves from cell i to cell j; a category that both have neither gains nor loses
            change = 0.1 * (whole[None, :].astype(float) - whole[:, None])
            for x, c, h in zip(lack, codes, has):
                change = change + np.where(c[:, None] == c[None, :], 0, (x > 0).astype(float)[None, :] - (h & (x >= 0))[:, None])
            change = np.where((got > 0)[:, None] & (got < n)[None, :], change, -1)
            i, j = np.unravel_index(int(change.argmax()), change.shape)
            if change[i, j] < 0.5:
                break
            apart = [(x, h) for x, c, h in zip(lack, codes, has) if c[i] != c[j]]
            step = min([n[j] - got[j], got[i], *[x[j] for x, _ in apart if x[j] > 0], *[-x[i] for x, h in apart if h[i] and x[i] < 0]])
            got[i] -= step
        got[j] += step
    return got


def seats(cells: pd.DataFrame, targets: pd.DataFrame, fields: tuple[str, ...] = FIELDS) -> pd.DataFrame:
    """Records that each cell of categories gives to one plan, by the divisor method with floors and capacities.

    A cell's r-th record has priority (r - 0.5) / target; records that a floor needs come first, then the smallest
    priorities of all cells. A cell takes part up to its number of records, so the seats of an exhausted one pass on.
    A label that is null or that the plan doesn't list is no category; its cells
    take no part in that, but then fill what is lacking in the fields they have.
    """
    size = int(targets["sample_size"].iloc[0])
    n = every = cells["n"].to_numpy(float)
    kinds = []
    codes, want, least = [], [], []
    for f in fields:
        t = targets[targets["field_name"] == f].drop_duplicates("key").set_index("key")
        names = list(t.index)
        code = cells[f].map({k: i for i, k in enumerate(names)}).fillna(-1).to_numpy(int)
        n = np.where(code < 0, 0, n)
        kinds.append(code)
        codes.append(np.maximum(code, 0))
        want.append(t["target_share"].to_numpy(float) * size)
        least.append(t["min_rows"].to_numpy(float))
    w = _fit(n, codes, [np.maximum(a, b) for a, b in zip(want, least)])
    w = np.where(n > 0, np.maximum(w, 1e-9), 0)
    floor = np.zeros(len(n))
    for c, m in zip(codes, least):
        for k, need in enumerate(m):
            here = np.flatnonzero((c == k) & (n > 0))
            short = need - floor[here].sum()
            while short > 0 and len(here) and (floor[here] < n[here]).any():
                p = np.where(floor[here] < n[here], (floor[here] + 0.5) / w[here], np.inf)
                floor[here[int(p.argmin())]] += 1
                short -= 1

    def upto(t: float) -> np.ndarray:
        return np.minimum(n, np.maximum(floor, np.floor(t * w + 0.5)))

    if n.sum() <= size:
        got = n
    else:
        low, high = 0.0, (n[w > 0].max() + 1) / w[w > 0].min()
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if upto(mid).sum() <= size else (low, mid)
        got = upto(low)
        left = int(size - got.sum())
        if left > 0:  # ties at the last priority, by the cells' order
            p = np.where(got < n, (got + 0.5) / np.where(w > 0, w, 1), np.inf)
            got[np.lexsort((np.arange(len(p)), p))[:left]] += 1
    got = _improve(got, every, kinds, [np.maximum(np.floor(np.round(a, 6)), b) for a, b in zip(want, least)], size - int(got.sum()))
    return cells.assign(seats=got.astype("int64"))


def _allotted(questions: DataFrame, targets: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(plan_name, labels, seats) of each plan and each combination of categories, null where there is none."""
    cells = questions.groupBy(*fields).agg(F.count(F.lit(1)).alias("n"))
    # cells are combinations of categories: their number follows the labels, never the rows
    plans = targets.withColumn("key", label(F.col("category"))).select("plan_name", "sample_size", "field_name", "key", "target_share", "min_rows")
    schema = "plan_name string, " + ", ".join(f"{f} string" for f in fields) + ", seats long"

    def allot(key: tuple, c: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(t):
            return pd.DataFrame({x.split()[0]: [] for x in schema.split(", ")})
        t = t.sort_values(["field_name", "key"])
        c = c.sort_values(list(fields))
        return seats(c, t, fields).assign(plan_name=t["plan_name"].iloc[0])[["plan_name", *fields, "seats"]]

    names = [r[0] for r in targets.select("plan_name").distinct().collect() if r[0] is not None]
    by_plan = cells.select(*fields, "n", F.explode(F.array(*[F.lit(x) for x in names]).cast("array<string>")).alias("plan"))
    return by_plan.groupBy("plan").cogroup(plans.groupBy("plan_name")).applyInPandas(allot, schema)


def seats_report(questions: DataFrame, targets: DataFrame, fields: tuple[str, ...] = FIELDS, seed: int = 7) -> DataFrame:
    """targets_report with the seats that each target has in the drawn sample, and whether they are too few."""
    given = _allotted(questions, targets, fields)
    each = given.select("plan_name", "seats", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("key")) for f in fields])).alias("x"))
    got = each.groupBy("plan_name", "x.field_name", "x.key").agg(F.sum("seats").alias("seats"))
    out = targets_report(questions, targets, fields, seed).join(F.broadcast(got), ["plan_name", "field_name", "key"], "left")
    # a share asks for a whole number of seats, the one below or above it; a floor for all of it
    short = F.coalesce("seats", F.lit(0)) < F.greatest(F.floor("required"), F.col("min_rows"))
    return out.withColumn("short", short).withColumn("seats", F.coalesce("seats", F.lit(0)))


def sample(questions: DataFrame, targets: DataFrame, fields: tuple[str, ...] = FIELDS, seed: int = 7) -> DataFrame:
    """The sampled questions of each plan: plan_name, query_id, item_id and the labels.

    Joint targets of the cells (combinations of categories) come from proportional fitting to the plan's shares, held
    below the pool's counts. No category is a value of its own, so questions lacking a label fill what the others leave.
    A plan larger than the pool gets all of it. The draw depends on ids and seed alone, so it repeats; ties can't occur
    but on ids.
    """
    ranked = numbered(questions, list(fields), draw_order(seed), "rank")
    given = F.broadcast(_allotted(questions, targets, fields)).alias("g")
    on = reduce(lambda a, b: a & b, [F.col(f"r.{f}").eqNullSafe(F.col(f"g.{f}")) for f in fields])
    return ranked.alias("r").join(given, on).where("rank <= seats").select("plan_name", "query_id", "item_id", *[f"r.{f}" for f in fields])
