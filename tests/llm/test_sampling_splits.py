import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statuta.llm import components, sampling, splits

G = "item_id long, query_id string, query_type string, difficulty string, persona string, extra string"


def golden(spark, rows):
    return spark.createDataFrame(rows, G)


def targets(spark, size, shares, least=1):
    return spark.createDataFrame([("p", size, f, c, s, least) for f, cs in shares.items() for c, s in cs.items()], "plan_name string, sample_size long, field_name string, category string, target_share double, min_rows long")


SHARES = {"query_type": {"a": 0.5, "b": 0.5}, "difficulty": {"easy": 0.8, "hard": 0.2}, "persona": {"x": 1.0}}


def test_pool_counts_each_question_once_and_normalises_labels(spark):
    g = golden(spark, [(1, "q1", " A ", "Easy", "x", None), (2, "q1", "a", "EASY", "x", "e"), (3, "q2", "b", None, "", "e"), (4, None, "cross-Reference", "hard", "x", None)])
    got = {r["query_id"]: r for r in sampling.pool(g).collect()}
    assert len(got) == 3 and got["q1"]["query_type"] == "a" and got["q1"]["item_id"] == 1
    assert got["q2"]["difficulty"] is None and got["q2"]["persona"] is None
    assert got["item:4"]["query_type"] == "cross_reference"


def test_report_of_unmet_targets(spark):
    g = golden(spark, [(i, f"q{i}", "a" if i % 10 else "b", "easy", "x", None) for i in range(100)])
    r = {(x["field_name"], x["category"]): x for x in sampling.targets_report(sampling.pool(g), targets(spark, 40, SHARES, 2)).collect()}
    assert r["query_type", "b"]["available"] == 10 and r["query_type", "b"]["unmet"]
    assert not r["query_type", "a"]["unmet"]
    assert r["difficulty", "hard"]["available"] == 0 and r["difficulty", "hard"]["unmet"]


def test_empty_pool(spark):
    p = sampling.pool(golden(spark, []))
    assert sampling.targets_report(p, targets(spark, 10, SHARES)).where("unmet").count() == 5
    assert sampling.sample(p, targets(spark, 10, SHARES)).count() == 0


def test_sample_meets_shares_and_repeats(spark):
    random.seed(1)
    g = golden(spark, [(i, f"q{i}", random.choice("aaab"), random.choice(["easy", "hard"]), "x", None) for i in range(1200)])
    t = targets(spark, 200, SHARES)
    s = sampling.sample(sampling.pool(g), t).toPandas()
    assert len(s) == 200 and s["query_id"].is_unique
    assert abs((s["query_type"] == "a").mean() - 0.5) < 0.02 and abs((s["difficulty"] == "easy").mean() - 0.8) < 0.02
    assert set(s["query_id"]) == set(sampling.sample(sampling.pool(g.repartition(7)), t).toPandas()["query_id"])


def test_seats_are_the_smallest_priorities():
    cells = pd.DataFrame({"query_type": list("abc"), "n": [50, 3, 50]})
    t = pd.DataFrame({"field_name": "query_type", "key": list("abc"), "sample_size": 30, "target_share": [0.5, 0.3, 0.2], "min_rows": [1, 1, 1]})
    s = sampling.seats(cells, t, ("query_type",))["seats"].tolist()
    # b gives all it has; its other seats pass to a and c in proportion
    assert s[1] == 3 and sum(s) == 30 and abs(s[0] / s[2] - 2.5) < 0.4


def test_floor_comes_first():
    cells = pd.DataFrame({"query_type": list("ab"), "n": [1000, 9]})
    t = pd.DataFrame({"field_name": "query_type", "key": list("ab"), "sample_size": 50, "target_share": [0.99, 0.01], "min_rows": [1, 7]})
    assert sampling.seats(cells, t, ("query_type",))["seats"].tolist() == [43, 7]


def brute_roots(edges):
    up = {}
    for a, b in edges:
        for x in (a, b):
            up.setdefault(x, {x})
        if up[a] is not up[b]:
            s = up[a] | up[b]
            for x in s:
                up[x] = s
    return {x: min(s) for x, s in up.items()}


@pytest.mark.parametrize("limit", [10**6, 5])
def test_components_against_brute_force(spark, limit):
    rnd = random.Random(3)
    edges = [(f"n{rnd.randrange(60):02d}", f"n{rnd.randrange(60):02d}") for _ in range(45)] + [("c%03d" % i, "c%03d" % (i + 1)) for i in range(20)]
    df = spark.createDataFrame([*edges, *edges[:5], (None, "n01")], "a string, b string")
    got = {r["node"]: r["root"] for r in components.components(df, task_edges=limit).collect()}
    assert got == {k: v for k, v in brute_roots(edges).items() if k != v}


def test_components_of_nothing(spark):
    assert components.components(spark.createDataFrame([], "a string, b string")).count() == 0


R = "item_id long, query_id string, parent_document string, source_article string, split string"


def test_sources_are_read_in_any_spelling(spark):
    rows = [(i, None, "Act  1", s, "train") for i, s in enumerate(["Article 6", "  Article\xa06 ", "ARTICLE 6", "Art. 6", "Article 6(5)(b)", "article  6", "Article 60", "Annex III, Section C", "Rec. 7", "Preamble", "", None])]
    got = [r["provision"] for r in splits.records(spark.createDataFrame(rows, R)).orderBy("item_id").collect()]
    assert got == ["Article 6"] * 6 + ["Article 60", "Annex III", "Recital 7", None, None, None]


def test_violations(spark):
    rows = [(1, "a", "A", "Article 1", "train"), (2, "b", "A", "Art. 1(2)", "VAL"), (3, "c", "A", "Article 2", "Train "), (4, "d", "A", "Article 2", None), (5, "e", None, None, "test"), (6, "e", None, None, "train"), (7, "f", "B", "Article 1", "test")]
    got = splits.violations(splits.records(spark.createDataFrame(rows, R))).collect()
    assert [(r["act"], r["provision"], r["splits"]) for r in got] == [("A", "Article 1", ["dev", "train"])]


def test_groups_stay_whole_and_shares_are_met(spark):
    rnd = random.Random(5)
    rows = [(i, f"q{i // 2}", "A" if i % 3 else "B", f"Article {1 if rnd.random() < 0.3 else rnd.randrange(2, 200)}", None) for i in range(2000)] + [(5000 + i, None, None, None, None) for i in range(50)]
    t = spark.createDataFrame([("train", 0.7), ("dev", 0.15), ("test", 0.15)], "split_name string, target_share double")
    a = splits.assign(splits.records(spark.createDataFrame(rows, R)), t).toPandas()
    assert len(a) == 2050 and a["item_id"].is_unique
    assert a.groupby("group")["split"].nunique().max() == 1


def test_groups_of_one_size_are_placed_as_one_by_one():
    rnd = random.Random(8)
    classes = pd.DataFrame({"n": [40, 7, 3, 1], "groups": [3, 11, 50, 200]})
    shares = [("dev", 0.15), ("test", 0.15), ("train", 0.7)]
    got = splits.placed(classes.sample(frac=1, random_state=rnd.randrange(99)), shares)
    total = float((classes["n"] * classes["groups"]).sum())
    lack = {k: v * total for k, v in shares}
    want = {}
    for n, m in classes.itertuples(index=False):
        for _ in range(m):
            k = max(lack, key=lack.get)
            lack[k] -= n
            want[k, n] = want.get((k, n), 0) + 1
    have = {(r.split, r.n): r.last - r.first + 1 for r in got.itertuples()}
    assert all(abs(have.get(k, 0) - v) <= 1 for k, v in want.items())
    for n, m in classes.itertuples(index=False):
        assert sorted(x for r in got[got["n"] == n].itertuples() for x in range(r.first, r.last + 1)) == list(range(1, m + 1))


def test_sources_rest_on_the_components(spark, monkeypatch):
    rows = [(1, "a", "A", "Article 1", "train"), (2, "b", "A", "Art. 1(2)", "dev")]
    rec = splits.records(spark.createDataFrame(rows, R))
    assert splits.violations(rec).count() == 1
    none = spark.createDataFrame([], "node string, root string")
    monkeypatch.setattr(splits, "components", lambda e: none)
    assert splits.violations(rec).count() == 0


def test_assignment_of_nothing(spark):
    t = spark.createDataFrame([("train", 1.0)], "split_name string, target_share double")
    assert splits.assign(splits.records(spark.createDataFrame([], R)), t).count() == 0
