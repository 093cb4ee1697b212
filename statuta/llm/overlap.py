"""Problem 6: records of evaluation splits that stand, exactly or almost, in the training split."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.llm.labels import letters_digits, split_name
from statuta.runtime import cut, join_groups, kept, spread

#: Words that may be changed, added or dropped, though no more than a third of a text's.
EDITS = 4
#: A name is a capitalised word in at most this share of the different texts, or in RARE_TEXTS of them.
RARE_SHARE = 1 / 20_000
RARE_TEXTS = 12
#: Words after which a roman numeral is the number of a provision.
ANNEX_WORDS = ("annex", "annexe", "anhang", "anexo", "allegato")
INVISIBLE = r"\p{Cf}"


def words_of(c: Column) -> Column:
    """Words (runs of letters, marks and digits) with their case; invisible format characters are dropped first."""
    return F.filter(F.split(F.regexp_replace(c, INVISIBLE, ""), r"[^\p{L}\p{M}\p{Nd}]+"), lambda w: w != "")


def texts(df: DataFrame, key: str, text: str, split: str) -> tuple[DataFrame, DataFrame]:
    """(members: cls, id, side; texts: cls, words, sides) of the rows in train or an evaluation split.

    A class is all rows that are equal but for formatting; its words are those of its longest list, first in order.
    Rows without letters and digits and rows in no split are left out.
    """
    side = F.when(split_name(F.col(split)) == "train", 1).when(split_name(F.col(split)).isNotNull(), 2)
    rows = df.select(F.col(key).alias("id"), side.alias("side"), letters_digits(F.col(text)).alias("norm"), words_of(F.col(text)).alias("w"))
    rows = kept(rows.where("side is not null and norm <> ''").select("id", "side", F.md5("norm").alias("cls"), "w"))
    best = F.max(F.struct(F.size("w"), F.col("w"))).alias("b")
    per = rows.groupBy("cls").agg(best, F.bit_or("side").alias("sides"))
    return rows.select("cls", "id", "side"), per.select("cls", F.col("b.w").alias("words"), "sides")


def names(all_texts: DataFrame) -> DataFrame:
    """Words that are names: rare over the different texts, and capitalised inside mixed-case texts.

    Columns: word (lower case). Words never seen inside a mixed-case text can't be told and aren't names.
    """
    low = F.transform("words", lambda w: F.lower(w))
    # an upper-case, title-case or lower-case copy says nothing about a word
    mixed = (F.size(F.filter("words", lambda w: w == F.lower(w))) * 2 >= F.size("words")) & F.exists("words", lambda w: w.rlike(r"^\p{Lu}"))
    inner = F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0)))
    caps = F.when(mixed, F.array_distinct(F.transform(F.filter(inner, lambda w: w.rlike(r"^\p{Lu}\p{Ll}+$")), lambda w: F.lower(w)))).otherwise(F.array().cast("array<string>"))
    per = all_texts.select(F.array_distinct(low).alias("low"), caps.alias("caps"), mixed.cast("int").alias("mixed")).select(F.explode("low").alias("word"), "caps", "mixed")
    per = per.withColumn("cap", F.array_contains("caps", F.col("word")).cast("int"))
    stats = per.groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.sum("cap").alias("cap"), F.sum("mixed").alias("mixed"))
    rare = F.col("df") <= max(RARE_TEXTS, math.ceil(all_texts.count() * RARE_SHARE))
    return stats.where(rare & (F.col("cap") > 0) & (F.col("cap") * 2 >= F.col("mixed")) & (F.length("word") >= 4)).select("word")


def _numbers(w: list[str]) -> str:
    got = [x for x in w if x[0].isdigit()]
    got += [y for x, y in zip(w, w[1:]) if x in ANNEX_WORDS and re.fullmatch("[ivxlc]+", y)]
    return " ".join(sorted(got))


#: A clause may move within texts of so many words, with EDITS besides. It parts a text at three places at most.
MOVE_WORDS, MOVE_PARTS = 3 * EDITS, 3


def parts_of(n: int) -> int:
    """Segments of a text of n words, of which what it allows leaves one whole."""
    return allowed(n) + 1 + (MOVE_PARTS if n >= MOVE_WORDS else 0)


def allowed(n: int) -> int:
    """Edits that a text of n words may have."""
    return min(EDITS, n // 3)


def cut_points(n: int, parts: int = EDITS + 1) -> list[tuple[int, int]]:
    """(start, length) of `parts` segments of n words, as even as can be; empty ones are left out."""
    edges = [n * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:]) if b > a]


def _keys(batches: Iterator[pd.DataFrame], evaluation: bool) -> Iterator[pd.DataFrame]:
    """Join keys: name and numbers with each segment (evaluation side) or each run of words that may match one."""
    for b in batches:
        out_c, out_k = [], []
        for cls, words, own in zip(b["cls"], b["words"], b["names"]):
            w = [x.lower() for x in words]
            mark = _numbers(w)
            if evaluation:
                runs = {" ".join(w[s : s + n]) for s, n in cut_points(len(w), parts_of(len(w)))}
            else:
                # a run may stand at any place, for a clause may have moved; only its length is tied to the text's
                lengths = {n for m in range(max(1, len(w) - EDITS), len(w) + EDITS + 1) for _, n in cut_points(m, parts_of(m))}
                runs = {" ".join(w[s : s + n]) for n in lengths for s in range(len(w) - n + 1)}
            for name in sorted(set(own)) or [""]:
                for r in runs:
                    out_c.append(cls)
                    out_k.append(f"{name}|{mark}|{r}")
        yield pd.DataFrame({"cls": out_c, "k": out_k}, dtype="object")


def banded(a: list[str], b: list[str], k: int) -> list[tuple[str, str]] | None:
    """The word edits that turn a into b if at most k are needed: pairs with '' for an added or dropped word."""
    n, m = len(a), len(b)
    if abs(n - m) > k:
        return None
    lo = 0
    while lo < min(n, m) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(n, m) - lo and a[n - 1 - hi] == b[m - 1 - hi]:
        hi += 1
    a, b = a[lo : n - hi], b[lo : m - hi]
    n, m = len(a), len(b)
    big = k + 1
    rows = [[j if j <= k else big for j in range(m + 1)]]
    for i in range(1, n + 1):
        p, r = rows[-1], [big] * (m + 1)
        if i <= k:
            r[0] = i
        for j in range(max(1, i - k), min(m, i + k) + 1):
            r[j] = p[j - 1] if a[i - 1] == b[j - 1] else 1 + min(p[j - 1], p[j], r[j - 1])
        if min(r) > k:
            return None
        rows.append(r)
    if rows[n][m] > k:
        return None
    i, j, out = n, m, []
    while i or j:
        d = rows[i][j]
        if i and j and a[i - 1] == b[j - 1] and rows[i - 1][j - 1] == d:
            i, j = i - 1, j - 1
        elif i and j and rows[i - 1][j - 1] + 1 == d:
            i, j = i - 1, j - 1
            out.append((a[i], b[j]))
        elif i and rows[i - 1][j] + 1 == d:
            i -= 1
            out.append((a[i], ""))
        else:
            j -= 1
            out.append(("", b[j]))
    return out


def moved(a: list[str], b: list[str], k: int) -> list[tuple[str, str]] | None:
    """As banded, after one clause of a has been moved to its beginning or end."""
    best = None
    if abs(len(a) - len(b)) > k:
        return None
    have = set(b)
    if sum(x not in have for x in a) > k:
        return None
    for cut_at in range(1, len(a)):
        # a clause moved across the rest turns the text around one point; both ends then meet their places
        e = banded(a[cut_at:] + a[:cut_at], b, k)
        if e is not None and (best is None or len(e) < len(best)):
            best = e
    return best


def inner_move(a: list[str], b: list[str], k: int) -> list[tuple[str, str]] | None:
    """As moved, for a clause that moved inside the text: what both begin and end with is set aside first."""
    n = min(len(a), len(b))
    lo = 0
    while lo < n and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < n - lo and a[len(a) - 1 - hi] == b[len(b) - 1 - hi]:
        hi += 1
    return moved(a[lo : len(a) - hi], b[lo : len(b) - hi], k)


def same_question(a: list[str], b: list[str], names_a: set[str], names_b: set[str], k: int | None = None) -> bool:
    """Equal up to k word edits, besides one moved clause in texts of MOVE_WORDS or more, with the same numbers, a name in common or none at all, and no name
    against another. k is what a allows if it isn't given."""
    if _numbers(a) != _numbers(b) or not (names_a & names_b or not names_a | names_b):
        return False
    k = allowed(len(a)) if k is None else k
    for way in (banded, inner_move, moved):
        if way is not banded and min(len(a), len(b)) < MOVE_WORDS:
            return False
        e = way(a, b, k)
        if e is not None:
            return not any((x in names_a or x in names_b) and (y in names_a or y in names_b) for x, y in e)
    return False


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        ok = [
            same_question([x.lower() for x in p], [x.lower() for x in q], set(m), set(n))
            for p, q, m, n in zip(b["words_a"], b["words_b"], b["names_a"], b["names_b"])
        ]
        yield b.loc[ok, ["cls_a", "cls_b"]]


def class_pairs(all_texts: DataFrame) -> DataFrame:
    """(cls_a, cls_b): a text of an evaluation split and one of train that ask the same question in other words.

    Each evaluation text is cut into more segments than its edits and the ends of a moved clause can break, so one is left
    whole and is found among the runs of words of the training text. Names and numbers must be equal, so they are
    part of the key; texts of either side whose names and numbers the other side lacks are dropped before runs are made.
    """
    low = F.transform("words", lambda w: F.lower(w))
    t = all_texts.where(F.size("words") > 0)
    word = t.select("cls", F.explode(F.array_distinct(low)).alias("word"))
    own = word.join(names(t), "word").groupBy("cls").agg(F.collect_set("word").alias("names"))
    t = t.join(own, "cls", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    digits = F.array_sort(F.filter(low, lambda w: w.rlike("^[0-9]")))
    anchors = F.explode(F.when(F.size("names") > 0, F.col("names")).otherwise(F.array(F.lit(""))))
    t = cut(t.withColumn("numbers", F.concat_ws(" ", digits)))
    a = t.select("cls", "sides", "numbers", anchors.alias("anchor"))
    both = a.groupBy("anchor", "numbers").agg(F.bit_or("sides").alias("s"), F.count(F.lit(1)).alias("n")).where("s = 3 and n > 1").select("anchor", "numbers")
    kept = t.join(a.join(both, ["anchor", "numbers"]).select("cls").distinct(), "cls", "left_semi")
    kept = cut(spread(kept.select("cls", "sides", "words", "names")))
    schema = "cls string, k string"
    ev = kept.where("sides >= 2").select("cls", "words", "names").mapInPandas(lambda it: _keys(it, True), schema)
    tr = kept.where("sides in (1, 3)").select("cls", "words", "names").mapInPandas(lambda it: _keys(it, False), schema)
    ev, tr = (x.select("cls", F.xxhash64("k").alias("k")) for x in (ev, tr))
    found = ev.withColumnRenamed("cls", "cls_a").join(tr.withColumnRenamed("cls", "cls_b"), "k").where("cls_a <> cls_b").select("cls_a", "cls_b").distinct()
    side = lambda x: kept.select(F.col("cls").alias(f"cls_{x}"), F.col("words").alias(f"words_{x}"), F.col("names").alias(f"names_{x}"))
    full = found.join(side("a"), "cls_a").join(side("b"), "cls_b")
    return spread(full).mapInPandas(_verify, "cls_a string, cls_b string")


def overlaps(df: DataFrame, key: str = "item_id", text: str = "query", split: str = "split") -> DataFrame:
    """(item_eval, item_train) of all row pairs across the splits that ask the same question.

    Null and wordless texts and unassigned rows give no pair; repeated rows give a pair each. Exact copies are paired
    by their class and never compared.
    """
    members, pairs = matches(df, key, text, split)
    e = members.where("side = 2").select(F.col("cls").alias("cls_a"), F.col("id").alias("item_eval"))
    t = members.where("side = 1").select(F.col("cls").alias("cls_b"), F.col("id").alias("item_train"))
    return pairs.join(e, "cls_a").join(t, "cls_b").select("item_eval", "item_train")


def matches(df: DataFrame, key: str, text: str, split: str) -> tuple[DataFrame, DataFrame]:
    """(members: cls, id, side; pairs of classes that ask the same question: cls_a of an evaluation split, cls_b of train)."""
    members, all_texts = texts(df, key, text, split)
    all_texts = cut(all_texts)
    same = all_texts.where("sides = 3").select(F.col("cls").alias("cls_a"), F.col("cls").alias("cls_b"))
    return members, cut(same.unionByName(class_pairs(all_texts)))


def report(df: DataFrame, key: str = "item_id", text: str = "query", split: str = "split") -> DataFrame:
    """Overlapping pairs and evaluation rows by evaluation split, act and provision (null where a row has no source).

    Pairs of rows are counted by the sizes of their classes and never made.
    """
    from statuta.llm.labels import act, provision

    members, pairs = matches(df, key, text, split)
    train = members.where("side = 1").groupBy(F.col("cls").alias("cls_b")).agg(F.count(F.lit(1)).alias("n"))
    per = pairs.join(train, "cls_b").groupBy(F.col("cls_a").alias("cls")).agg(F.sum("n").alias("n"))
    ev = members.where("side = 2")
    sizes = ev.groupBy("cls").agg(F.count(F.lit(1)).alias("members"))
    per = join_groups(ev, per.join(sizes, "cls"), ["cls"], "members", ev.count()).select(F.col("id").alias("item_eval"), "n")
    rows = df.select(F.col(key).alias("item_eval"), split_name(F.col(split)).alias("split"), act(F.col("parent_document")).alias("act"), provision(F.col("source_article")).alias("provision"))
    return per.join(rows, "item_eval").groupBy("split", "act", "provision").agg(F.sum("n").alias("pairs"), F.count(F.lit(1)).alias("rows"))
