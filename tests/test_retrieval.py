import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from statuta.config import EngineConfig
from statuta.operators import bm25, chunk, dense, fuse, golden, metrics, provisions, store

DOCS = [("a", "the cat sat on the mat"), ("b", "the dog sat"), ("c", "a bird flew over the cat and the dog"), ("d", ""), ("e", "zebra zebra")]


def okapi(docs, query, k1=1.5, b=0.75, eps=0.25):
    toks = {k: re.findall(r"\w+", t) for k, t in docs}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = Counter(w for t in toks.values() for w in set(t))
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else eps * mean for w, v in raw.items()}
    s = {k: sum(idf.get(q, 0) * t.count(q) * (k1 + 1) / (t.count(q) + k1 * (1 - b + b * len(t) / avg)) for q in query.split()) for k, t in toks.items()}
    return sorted(((round(v, 6), k) for k, v in s.items()), key=lambda x: (-x[0], x[1]))


@pytest.mark.parametrize("query", ["cat", "the cat the", "zebra bird", "unknown", ""])
def test_bm25_with_ties_repeats_and_fill(spark, query):
    q = spark.createDataFrame([("q", query)], "query_id string, query string")
    d = spark.createDataFrame(DOCS, "chunk_id string, text string")
    got = [(r["score"], r["chunk_id"]) for r in bm25.search(q, d, 4).orderBy("rank").collect()]
    assert got == okapi(DOCS, query)[:4]


def test_dense_against_numpy(spark):
    rnd = np.random.default_rng(1)
    v = rnd.normal(size=(60, 8)).round(2)
    df = spark.createDataFrame([(i, x.tolist(), int(i % 3)) for i, x in enumerate(v)] + [(99, None, 0)], "vec_id long, embedding array<double>, label int")
    q = df.where("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    for flt in (None, {}, {"label": 1}, {"label": [0, 2]}):
        got = {(r["query_id"], r["rank"]): r["vec_id"] for r in dense.search(q, df, 5, filters=flt, block=16).collect()}
        for i in range(0, 60, 7):
            ok = [j for j in range(60) if not flt or (j % 3 in flt["label"] if isinstance(flt["label"], list) else j % 3 == flt["label"])]
            best = sorted(ok, key=lambda j: (round(float(((v[i] - v[j]) ** 2).sum()), 6), j))[:5]
            assert [got[i, r] for r in range(5)] == best


def test_fusion_ties_and_missing_sides(spark):
    s = "query_id string, chunk_id string, rank int"
    one = spark.createDataFrame([("q", "a", 0), ("q", "b", 1)], s)
    two = spark.createDataFrame([("q", "c", 0), ("q", "b", 1)], s)
    got = [r["chunk_id"] for r in fuse.rrf(one, two, 10).orderBy("rank").collect()]
    assert got == ["b", "a", "c"]
    assert [r["chunk_id"] for r in fuse.rrf(one.limit(0), two, 1).collect()] == ["c"]


def test_penalty_keeps_the_score(spark):
    h = spark.createDataFrame([("q", "r1", 9.0, 0, "recital"), ("q", "r2", 5.0, 1, "recital"), ("q", "a", 3.0, 2, "general")], "query_id string, chunk_id string, score double, rank int, section_type string")
    got = [(r["score"], r["rank"]) for r in fuse.operative_first(h, 2, 3.0).orderBy("rank").collect()]
    assert got == [(9.0, 0), (3.0, 1)]
    scored = fuse.rerank(h.withColumn("query", F.lit("x")).withColumn("text", F.col("chunk_id")), lambda q, t: t.str.len()).orderBy("rank").collect()
    assert [r["chunk_id"] for r in scored] == ["r1", "r2", "a"]


def test_metrics(spark):
    q = spark.createDataFrame([("a",), ("b",), ("c",)], "query_id string")
    h = spark.createDataFrame([("a", 0, False), ("a", 1, True), ("b", 0, False)], "query_id string, rank int, hit boolean")
    got = {r["query_id"]: r for r in metrics.per_query(q, h).collect()}
    assert (got["a"]["recall_at_1"], got["a"]["recall_at_3"], got["a"]["mrr"], got["a"]["precision_at_5"]) == (0.0, 1.0, 0.5, 0.5)
    assert got["c"]["mrr"] == 0.0 and got["b"]["precision_at_5"] == 0.0


def test_comparison_table(spark):
    s = spark.createDataFrame([("x", 0.5, 1234.0), ("y", None, 0.01)], "tag string, mrr double, avg_context_chars double")
    t = {r["metric"]: r for r in metrics.compare(s, ["y", "x"]).collect()}
    assert t["MRR"]["x"] == "0.50" and t["MRR"]["y"] == "not run" and t["Avg characters sent to the LLM"]["x"] == "1,234"
    assert list(t["MRR"].asDict())[1:] == ["y", "x"]


def test_fixed_windows(spark):
    ws = " ".join(f"w{i}" for i in range(200))
    u = spark.createDataFrame([("d", 0, ws[: ws.index("w120")], "one"), ("d", 1, ws[ws.index("w120") :], "two"), ("e", 0, "", "z")], "parent_document string, chunk_index int, text string, title string")
    got = [r for r in chunk.fixed_size(u, 100, 50).where("parent_document = 'd'").orderBy("chunk_index").collect()]
    assert [r["text"].split()[0] for r in got] == ["w0", "w50", "w100", "w150"]
    assert [r["title"] for r in got] == ["one", "one", "one", "two"] and [len(r["text"].split()) for r in got] == [100, 100, 100, 50]
    with pytest.raises(ValueError):
        chunk.fixed_size(u, 50, 50)


def test_store(spark, tmp_path):
    empty = store.collection(spark, str(tmp_path / "none"))
    assert empty.count() == 0
    d = spark.createDataFrame([("k", "old", 1, "r1"), ("k", "new", 2, "r2"), (None, "x", 3, "r"), ("l", "y", None, "r")], "chunk_id string, text string, ingested_at int, ingestion_run_id string")
    assert {r["chunk_id"]: r["text"] for r in store.latest(d).collect()} == {"k": "new", "l": "y"}
    up = store.upsert(store.latest(d), d.where("text = 'old'"))
    assert {r["chunk_id"]: r["text"] for r in up.collect()} == {"k": "old", "l": "y"}
    with pytest.raises(LookupError):
        store.lookup(d, "chunk_id", "nope")
    f = store.flat(spark.createDataFrame([(None, ["a", "b"])], "article_number string, cross_references array<string>"))
    assert tuple(f.first()) == ("", "a|b") and store.unflat(f).first()["cross_references"] == ["a", "b"]


def test_owned_windows(spark):
    ws = [f"w{i}" for i in range(30)]
    u = spark.createDataFrame([("Article 1", " ".join(ws[:15])), ("Article 2", " ".join(ws[10:30])), ("Article 9", "too short"), (None, " ".join(ws))], "article_number string, text string")
    own = provisions.owners(u, 12)
    p = spark.createDataFrame([("p", "x " + " ".join(ws[:13]) + " and " + " ".join(ws[15:28])), ("q", "nothing here")], "chunk_id string, text string")
    got = provisions.in_order(provisions.contained(p, own, "chunk_id"), "chunk_id").collect()
    assert [(r["chunk_id"], r["provisions"]) for r in got] == [("p", ["Article 1", "Article 2"])]


@pytest.mark.parametrize("n, dev", [(1, 1), (5, 4), (15, 10), (45, 31)])
def test_split_rounds_half_to_even(spark, n, dev):
    df = spark.range(n).select(F.col("id").alias("item_id"), F.lit("t").alias("k"))
    s = golden.stratified_split(df, ["k"], "item_id")
    assert s.where("split = 'dev'").count() == dev and s.count() == n


def test_golden_steps(spark):
    c = spark.createDataFrame([(1, " What? ", 2), (2, "what?", 1), (3, "Why?", 3)], "pos int, query string, x int")
    assert {r["pos"] for r in golden.dedup(c).collect()} == {1, 3}
    assert golden.only_new(c, c.where("pos = 3")).count() == 2
    assert sum(n for _, _, n in golden.quotas(45)) >= 40


def test_config(monkeypatch):
    monkeypatch.setenv("RAG_RERANK_CANDIDATES", "0")
    assert EngineConfig.from_env().rerank_candidates == 0 and EngineConfig().pool == 20


def test_held_is_contained_by_its_own_owners(spark):
    ws = [f"w{i}" for i in range(40)]
    # a label given twice, a definition whose heading counts for nothing, runs of two labels, no label, too short, null
    texts = [("Article 1", ws[:15]), ("Article 1", ws[3:16]), ("Article 3(4)", ws[15:32]), ("Annex I", ws[14:29]), (None, ws), ("Article 9", ws[:11]), ("Article 2", ws[28:40] + ws[:14]), ("Article 5", None)]
    u = spark.createDataFrame([(f"c{i}", t, " ".join(w) if w else None) for i, (t, w) in enumerate(texts)], "chunk_id string, article_number string, text string")
    got, want = provisions.held(u, "chunk_id"), provisions.contained(u, provisions.owners(u), "chunk_id")
    assert got.dtypes == want.dtypes and want.count() > 4
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
