"""Questions that lack a label of some field fill the fields they have."""

import numpy as np

from statuta.llm import sampling
from test_sampling_splits import golden, targets


def test_questions_lacking_a_label_meet_what_the_others_cannot(spark):
    rows = [(i, f"q{i}", "ab"[i % 2], "hard" if i % 3 == 0 else "easy", "x", None) for i in range(300)] + [(300 + i, f"r{i}", "ab"[i % 2], None if i < 4 else "easy", "y", None) for i in range(20)]
    rows += [(400 + i, f"s{i}", "ab"[i % 2], "easy", "unlisted", None) for i in range(50)]
    t = targets(spark, 100, {"query_type": {"a": 0.5, "b": 0.5}, "difficulty": {"easy": 0.8, "hard": 0.1}, "persona": {"x": 0.8, "y": 0.2}})
    p = sampling.pool(golden(spark, rows))
    got = sampling.sample(p, t).toPandas()
    assert len(got) == 100 and got["query_id"].is_unique
    # 16 of y have all labels, the pool has 20
    assert (got["persona"] == "y").sum() == 20 and (got["persona"] == "x").sum() == 80
    r = {(x["field_name"], x["category"]): x for x in sampling.seats_report(p, t).collect()}
    assert r["persona", "y"]["seats"] == 20 and not r["persona", "y"]["short"] and not r["persona", "y"]["unmet"]
    for f in ("query_type", "difficulty", "persona"):
        n = np.unique(got[f].dropna(), return_counts=True)
        assert {c: k for c, k in zip(*n) if (f, c) in r} == {c: x["seats"] for (g, c), x in r.items() if g == f}


def test_report_lists_what_the_sample_lacks(spark):
    # each category has enough questions, but no two of them go together
    rows = [(i, f"q{i}", "a", "easy", "x", None) for i in range(100)] + [(100 + i, f"r{i}", "b", "hard", "x", None) for i in range(100)]
    t = targets(spark, 100, {"query_type": {"a": 0.9, "b": 0.1}, "difficulty": {"easy": 0.1, "hard": 0.9}, "persona": {"x": 1.0}})
    r = sampling.seats_report(sampling.pool(golden(spark, rows)), t).collect()
    assert not any(x["unmet"] for x in r) and any(x["short"] for x in r)
