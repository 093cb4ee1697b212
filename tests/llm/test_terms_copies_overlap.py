import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statuta.llm import copies, overlap, terms


def test_scores_against_brute_force(spark):
    rnd = random.Random(2)
    vocab = [f"w{i}" for i in range(60)]
    texts = {f"c{i}": " ".join(rnd.choices(vocab, k=rnd.randrange(20, 60))) for i in range(12)}
    texts["c0"] += " Größe größe Ωx"
    rows = [(k, v, "clash") for k, v in texts.items()] + [("c1", " " + texts["c1"], "again"), ("nul", None, None), ("emp", "", None)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, term string")
    got = {(r["chunk_id"], r["term"]): r["score"] for r in terms.term_scores(df, max_share=0.7).collect()}
    docs = [re.findall(r"[^\W_]+", (t or "").lower()) for _, t, _ in rows]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    f, d = Counter(w for x in docs for w in x), Counter(w for x in docs for w in set(x))
    want = {}
    for (k, t, _), ws in zip(rows, docs):
        for w, tf in Counter(ws).items():
            if d[w] <= 0.7 * n:
                m, tfn = f[w] / n, tf * math.log2(1 + avg / len(ws))
                want[k, w] = (math.log2(1 + m) - tfn * math.log2(m / (1 + m))) / (tfn + 1)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_top_term_needs_words(spark):
    df = spark.createDataFrame([("a", "zeta zeta zeta " + " ".join(f"x{i}" for i in range(40))), ("b", "short text")] + [(f"d{i}", " ".join(f"x{j}" for j in range(i, i + 40))) for i in range(30)], "chunk_id string, text string")
    top = {r["chunk_id"]: r["term"] for r in terms.top_term(terms.term_scores(df)).collect()}
    assert top["a"] == "zeta" and "b" not in top


def test_no_chunks(spark):
    assert terms.top_term(terms.term_scores(spark.createDataFrame([], "chunk_id string, text string"))).count() == 0


def test_copies_of_texts(spark):
    rows = [(5, "What is it?"), (3, "what  IS-it"), (9, "What is is?"), (1, "?!"), (2, None), (4, " "), (8, "“What” is it"), (7, "Größe"), (6, "GRÖSSE")]
    r, g = copies.collapse(spark.createDataFrame(rows, "item_id long, query string"), "item_id", "query")
    assert {(x["keep_id"], x["copy_id"]) for x in copies.copies(r, g).collect()} == {(3, 5), (3, 8)}
    assert {x["keep_id"]: x["copies"] for x in g.collect()} == {3: 3, 9: 1, 7: 1, 6: 1}


def test_copies_of_objects_whatever_their_layout(spark):
    rows = [
        (1, '{"query": "A b?", "query_type": "FACTUAL", "difficulty": "easy", "persona": "x", "source_article": "Article 1"}'),
        (2, '{"Source_Article":"article 1","persona":"X","difficulty":" easy ","query":"a B","Query_type":"factual"}'),
        (3, '{"query": "A b?", "query_type": "factual", "difficulty": "hard", "persona": "x", "source_article": "Article 1"}'),
        (4, "no json"), (5, None), (6, "{}"), (7, "{}"),
    ]
    p = copies.payload_fields(spark.createDataFrame(rows, "record_id long, payload string"))
    r, g = copies.collapse(p, "record_id", "fields")
    assert {(x["keep_id"], x["copy_id"]) for x in copies.copies(r, g).collect()} == {(1, 2)}


def test_nested_records(spark):
    kind = "id long, v struct<a: array<string>, m: map<string,string>>"
    rows = [(1, (["x", "Y"], {"k": "1", "l": "2"})), (2, (["X", "y"], {"L": "2", "K": "1"})), (3, (["y", "x"], {"k": "1", "l": "2"}))]
    df = spark.createDataFrame(rows, kind)
    r, g = copies.collapse(df, "id", "v")
    assert {(x["keep_id"], x["copy_id"]) for x in copies.copies(r, g).collect()} == {(1, 2)}
    r, g = copies.collapse(df, "id", "v", ordered=False)
    assert {x["copy_id"] for x in copies.copies(r, g).collect()} == {2, 3}


def test_hot_value_is_joined_once_each(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit("Hot!")).otherwise(F.concat(F.lit("t"), (F.col("id") % 900).cast("string"))).alias("v"))
    r, g = copies.collapse(df, "id", "v")
    c = copies.copies(r, g)
    assert c.count() == 3000 - g.count() == c.distinct().count()


def full(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        r = [i]
        for j, y in enumerate(b, 1):
            r.append(min(p[j] + 1, r[-1] + 1, p[j - 1] + (x != y)))
        p = r
    return p[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=9), st.lists(st.sampled_from("abcd"), max_size=9))
def test_banded_against_full(a, b):
    e, d = overlap.banded(a, b, 4), full(a, b)
    assert (e is None) == (d > 4)
    if e is not None:
        assert len(e) == d


def family(rnd):
    words = "the board must renew the audit plan at regular intervals when an office raises a claim in the field of water supply".split()
    out = []
    for name in ("Zorvath", "Belmoth", "Zorvatt"):
        for number in ("7", "8"):
            base = f"Under Article {number}, " + " ".join(words) + f" for the {name} tool?"
            out.append(base)
            for _ in range(3):
                w = base.split()
                for _ in range(rnd.randrange(0, 6)):
                    i = rnd.randrange(len(w))
                    if w[i].strip("?,") in (name, number, "Article", "Under"):
                        continue
                    w[i] = rnd.choice(["quite", "report", w[i] + "x"])
                out.append(" ".join(w))
            out.append(" ".join(words).capitalize() + f" for the {name} tool under Article {number}?")
    return out


def test_overlaps_against_all_pairs(spark):
    rnd = random.Random(7)
    texts = family(rnd)
    rows = [(i, t.upper() if i % 11 == 5 else t, rnd.choice(["train", "Dev ", "testing", None])) for i, t in enumerate(texts * 2)] + [(900, None, "train"), (901, "??", "dev"), (902, "??", "train"), (903, "", "test")]
    df = spark.createDataFrame(rows, "item_id long, query string, split string")
    got = {(r["item_eval"], r["item_train"]) for r in overlap.overlaps(df).collect()}
    _, t = overlap.texts(df, "item_id", "query", "split")
    known = {r["word"] for r in overlap.names(t).collect()}
    assert {"zorvath", "zorvatt", "belmoth"} <= known
    toks = lambda s: re.findall(r"[^\W_]+", s.lower())
    want = set()
    for i, a, s in rows:
        for j, b, u in rows:
            if a and b and (s or "").strip().lower() in ("dev", "testing", "test") and u == "train":
                x, y = toks(a), toks(b)
                if x and y and ("".join(x) == "".join(y) or overlap.same_question(x, y, known & set(x), known & set(y))):
                    want.add((i, j))
    assert got == want


def test_look_alikes_are_told_apart():
    a = "can the board renew the plan of the zorvath tool within 30 days".split()
    assert overlap.same_question(a, [("may" if x == "can" else x) for x in a], {"zorvath"}, {"zorvath"})
    assert not overlap.same_question(a, [("31" if x == "30" else x) for x in a], {"zorvath"}, {"zorvath"})
    assert not overlap.same_question(a, [("zorvatt" if x == "zorvath" else x) for x in a], {"zorvath"}, {"zorvatt"})


def test_no_rows(spark):
    assert overlap.overlaps(spark.createDataFrame([], "item_id long, query string, split string")).count() == 0


def test_one_rule_for_names_and_numbers_in_join_and_check(spark):
    a = "must the holder of Ravolux keep all of the event logs for ten years after the last sale".split()
    for b, same in ((a, True), ([x for x in a if x != "Ravolux"], False), (["Zemitor" if x == "Ravolux" else x for x in a], False), ([*a, "now"], True)):
        low = [x.lower() for x in b]
        names = {x.lower() for x in b if x[0].isupper()}
        assert overlap.same_question([x.lower() for x in a], low, {"ravolux"}, names) is same


def test_short_texts_against_brute_force(spark):
    rnd = random.Random(4)
    vocab = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(5)]
    rows = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(3, 11))), "train" if i % 2 else "dev") for i in range(500)]
    for i in range(500, 700):  # near copies of others
        w = rows[rnd.randrange(500)][1].split()
        for _ in range(rnd.randrange(0, 3)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        rows.append((i, " ".join(w), "train" if i % 3 else "test"))
    got = {tuple(r) for r in overlap.overlaps(spark.createDataFrame(rows, "item_id long, query string, split string")).collect()}
    want = {(i, j) for i, p, x in rows if x != "train" for j, q, y in rows if y == "train" and overlap.same_question(p.split(), q.split(), set(), set())}
    assert got == want and len(want) > 50
