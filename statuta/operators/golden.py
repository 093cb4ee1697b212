"""Building an evaluation set: candidates, their scores, picks by quota, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta.functions.text import dedup_key

#: Provisions that every set should cover, in this order, and the target shares.
PRIORITY = ("Article 5", "Article 6", "Article 9", "Article 10", "Article 13", "Article 14", "Article 17", "Article 50")
TYPE_SHARES = {"factual": 0.35, "procedural": 0.30, "conceptual": 0.20, "cross_reference": 0.15}
DIFFICULTY_SHARES = {"easy": 0.40, "medium": 0.40, "hard": 0.20}


def dedup(df: DataFrame, query: str = "query", order: str = "pos") -> DataFrame:
    """The first row of each normalised query (its first 80 characters), by `order`. Null queries are one."""
    first = df.groupBy(F.coalesce(dedup_key(F.col(query)), F.lit("")).alias("__k")).agg(F.min_by(F.struct(*df.columns), F.col(order)).alias("r"))
    return first.select("r.*")


def only_new(new: DataFrame, existing: DataFrame, query: str = "query") -> DataFrame:
    """Rows of new whose query isn't in existing; repeats inside new stay."""
    return new.join(existing.select(query).distinct(), query, "left_anti").select(*new.columns)


def score(ids: Column, elements: Column, notes: Column, query: Column) -> Column:
    """Points for a candidate's signs of quality."""
    n = F.greatest(F.size(F.coalesce(ids, F.array())), F.lit(0))
    e = F.greatest(F.size(F.coalesce(elements, F.array())), F.lit(0))
    note = F.coalesce(notes, F.lit(""))
    one = lambda cond, v: F.when(cond, F.lit(float(v))).otherwise(F.lit(0.0))
    return (
        one(n > 0, 3) + one(n > 1, 1) + F.least(e, F.lit(3)).cast("double") + one(note.contains("llm-verified"), 2)
        - one(note.contains("fallback") | note.contains("no retrieval"), 2) - one(F.length(F.coalesce(query, F.lit(""))) < 40, 1)
    )


def uniform(seed: int, *cols: str) -> Column:
    """A repeatable random order that any SHA-256 gives alike."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]), 256)


def stratified_split(df: DataFrame, strata: list[str], key: str, dev_ratio: float = 0.7, seed: int = 42) -> DataFrame:
    """df with `split`: of each stratum the first max(1, round(ratio * n)) in random order are dev, the others test.

    Rounding is half to even on the double. The place of a row in its stratum is counted within ranges of the random
    order, so a stratum with most of the rows isn't gathered.
    """
    h = uniform(seed, key)
    x = df.withColumn("__h", h).withColumn("__b", F.substring("__h", 1, 2))
    sizes = x.groupBy(*strata, "__b").agg(F.count(F.lit(1)).alias("__n"))
    w = W.partitionBy(*strata)
    sizes = sizes.select(*strata, "__b", F.coalesce(F.sum("__n").over(w.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__n").over(w).alias("__all"))
    on = F.lit(True)
    for c in [*strata, "__b"]:
        on = on & x[c].eqNullSafe(sizes[c])
    place = F.row_number().over(W.partitionBy(*[x[c] for c in strata], x["__b"]).orderBy(x["__h"], x[key])) + F.col("__before")
    dev = F.greatest(F.lit(1), F.bround(F.col("__all").cast("double") * F.lit(dev_ratio)).cast("long"))
    return x.join(F.broadcast(sizes), on).select(*[x[c] for c in df.columns], F.when(place <= dev, "dev").otherwise("test").alias("split"))


def priority_picks(df: DataFrame, article: str = "source_article", difficulty: str = "difficulty", points: str = "score", key: str = "item_id", articles: tuple[str, ...] = PRIORITY) -> DataFrame:
    """The best easy and the best harder candidate of each priority provision, ties to the smaller key."""
    level = F.when(F.col(difficulty) == "easy", "easy").when(F.col(difficulty).isin("medium", "hard"), "harder")
    x = df.withColumn("level", level).where(F.col(article).isin(*articles) & F.col("level").isNotNull())
    best = F.max(F.struct(F.col(points), (-F.col(key)).alias("k"), F.struct(*df.columns).alias("r")))
    return x.groupBy(article, "level").agg(best.alias("b")).select("b.r.*", "level")


def quotas(target: int) -> list[tuple[str, str, int]]:
    return [(t, d, max(1, round(target * a * b))) for t, a in TYPE_SHARES.items() for d, b in DIFFICULTY_SHARES.items()]


def quota_select(df: DataFrame, target: int, kind: str = "query_type", difficulty: str = "difficulty", points: str = "score", key: str = "item_id", most: int | None = None) -> DataFrame:
    """Up to each stratum's quota its best candidates, strata in order until the target, or else `most`, is reached.

    A stratum that the shares don't know has quota 1. Late strata may get nothing. Each task keeps at most a quota's
    rows of a stratum.
    """
    q = {(t, d): n for t, d, n in quotas(target)}
    table = F.create_map(*[x for (t, d), n in q.items() for x in (F.lit(f"{t}|{d}"), F.lit(n))])
    x = df.withColumn("quota", F.coalesce(F.try_element_at(table, F.concat_ws("|", kind, difficulty)), F.lit(1)))
    rn = F.row_number().over(W.partitionBy(kind, difficulty).orderBy(F.col(points).desc(), F.col(key)))
    x = x.withColumn("rn", rn).where(F.col("rn") <= max(q.values())).where(F.col("rn") <= F.col("quota"))
    # at most the quotas' sum of rows is left
    at = F.row_number().over(W.orderBy(kind, difficulty, "rn"))
    return x.withColumn("at", at).where(F.col("at") <= (target if most is None else most)).select(*df.columns)


def with_unanswerable(selected: DataFrame, viable: DataFrame, points: str = "score", key: str = "item_id", flag: str = "is_unanswerable") -> DataFrame:
    """selected, its lowest-scored row changed for the first unanswerable viable one if it holds none."""
    if not selected.where(F.col(flag)).limit(1).take(1):
        add = viable.where(F.col(flag)).orderBy(key).limit(1)
        low = selected.orderBy(points, F.col(key).desc()).limit(1)
        if add.take(1):
            return selected.join(low.select(key), key, "left_anti").select(*selected.columns).unionByName(add.select(*selected.columns))
    return selected


def trimmed(df: DataFrame, target: int, points: str = "score", key: str = "item_id") -> DataFrame:
    return df.orderBy(F.col(points).desc(), key).limit(target)


def sequential_ids(df: DataFrame, order: list[str], form: str = "q%03d", out: str = "query_id") -> DataFrame:
    """Running names over a selected set, which is small by its target."""
    return df.withColumn(out, F.format_string(form, F.row_number().over(W.orderBy(*order))))


def uniform_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(uniform(seed, key), key).limit(n)


def attach_chunks(candidates: DataFrame, chunks: DataFrame, article: str = "source_article", label: str = "article_number", chunk: str = "chunk_id", order: str = "chunk_index") -> DataFrame:
    """candidates with relevant_chunk_ids, the chunks of their provision in order; empty if there are none."""
    ids = chunks.where(F.col(label).isNotNull()).groupBy(F.col(label).alias(article)).agg(F.transform(F.array_sort(F.collect_set(F.struct(order, chunk))), lambda x: x[chunk]).alias("relevant_chunk_ids"))
    return candidates.join(ids, article, "left").withColumn("relevant_chunk_ids", F.coalesce("relevant_chunk_ids", F.array().cast("array<string>")))


def missing_labels(gold: DataFrame, units: DataFrame, provisions: str = "gold_provisions", label: str = "article_number") -> DataFrame:
    """Labels that the gold names and the corpus lacks."""
    return gold.select(F.explode(provisions).alias("label")).distinct().join(units.select(F.col(label).alias("label")).distinct(), "label", "left_anti")


def relabel(old: DataFrame, gold: DataFrame, previous: DataFrame, key: str = "query_id") -> DataFrame:
    """old with the new gold lists; answer elements of `previous` are kept where the gold list is unchanged."""
    p = previous.select(key, F.col("gold_provisions").alias("__g"), F.col("expected_answer_elements").alias("__e"))
    x = old.drop("gold_provisions", "expected_answer_elements").join(gold, key).join(p, key, "left")
    keep = (F.col("__g") == F.col("gold_provisions")) & (F.size("__e") > 0)
    return x.withColumn("expected_answer_elements", F.when(keep, F.col("__e"))).drop("__g", "__e")


def counters(df: DataFrame, fields: tuple[str, ...] = ("query_type", "difficulty", "split")) -> DataFrame:
    """(field, value, n) of several label columns in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))
    return df.select(each.alias("x")).groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("n"))
