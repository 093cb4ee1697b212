"""Judges, candidates, curation and selection with clients that need no model."""

import json

import pytest
from pyspark.sql import functions as F

from statuta import adapters
from statuta.config import EngineConfig
from statuta.functions import payloads
from statuta.operators import curate, golden, judges, metrics, verify
from statuta.plans import search


def says(reply):
    """An `ask` that gives every prompt the same reply, or what a function of the prompt gives."""
    if isinstance(reply, str):
        return lambda p: p.withColumn("raw", F.lit(reply))
    return lambda p: p.withColumn("raw", reply(F.col("prompt")))


def test_judges(spark):
    r = spark.createDataFrame([("a", "Q?", "Yes.", ["Article 1", None], ["t", "u"], ["f1", "f2", "f3"]), ("b", "Q?", "No.", None, None, None)], "query_id string, query string, answer string, labels array<string>, texts array<string>, expected_answer_elements array<string>")
    p = {(x["query_id"], x["judge"]): x["prompt"] for x in judges.prompts(r).collect()}
    assert len(p) == 7 and ("b", "completeness") not in p
    assert "[1] Article 1\nt\n\n[2] (unlabelled)\nu" in p["a", "faithfulness"] and "1. f1\n2. f2\n3. f3" in p["a", "completeness"]
    got = {x["query_id"]: x for x in judges.run_all(r, says('so {"score": 0.5, "covered": [true, false, true, true]}')).collect()}
    assert got["a"]["judge_faithfulness"] == 0.5 and abs(got["a"]["judge_completeness"] - 2 / 3) < 1e-9 and got["b"]["judge_completeness"] is None
    assert judges.run_all(r, says("no JSON")).where("judge_answer_relevance <> 0").count() == 0
    m = spark.createDataFrame([("r", 0.5, 0.5, 0.5, 1.0), ("r", None, None, None, None)], "tag string, judge_answer_relevance double, judge_faithfulness double, judge_factual_consistency double, judge_completeness double")
    x = judges.means(m, F.lit(True)).first()
    assert (x["completeness"], x["faithfulness"], x["n_judged"]) == (0.5, 0.5, 1)


def test_candidates_are_generated_and_added_once(spark):
    c = spark.createDataFrame([("c1", "Article 1", "x" * 300), ("c2", "Recital 1", "x" * 300), ("c3", "Article 2", "short"), ("c4", None, "x" * 300)], "chunk_id string, article_number string, text string")
    a = curate.askable(c)
    assert [r["chunk_id"] for r in a.collect()] == ["c1"] and curate.askable(c, only=["Article 9"]).count() == 0
    reply = "Sure: " + json.dumps([{"query": "Who?", "difficulty": "easy"}, {"query": "When?"}])
    got = curate.generate(a, says(reply)).orderBy("query_id").collect()
    assert [(r["query_id"], r["query"], r["split"]) for r in got] == [("auto_000_00", "Who?", "dev"), ("auto_000_01", "When?", "dev")]
    old = spark.createDataFrame([("q1", "Who?")], "query_id string, query string")
    assert {r["query_id"] for r in curate.generate(a, says(reply), old).collect()} == {"q1", "auto_000_01"}
    assert curate.generate(a, says("nothing")).count() == 0


def test_curation_by_a_judge_with_its_fallbacks(spark):
    c = spark.createDataFrame([(q, q, "Article 2") for q in ("good", "none", "broken", "alone")], "query_id string, query string, source_article string").withColumn("expected_answer_elements", F.array(F.lit("old")))
    h = spark.createDataFrame([(q, f"{q}{i}", f"Article {i}", "text", i) for q in ("good", "none", "broken") for i in (1, 2)], "query_id string, chunk_id string, article_number string, text string, rank int")
    reply = lambda p: F.when(p.contains("Question: good"), '{"relevant_indices": [1, 9, 0], "expected_answer_elements": ["new"]}').when(p.contains("Question: none"), '{"relevant_indices": [], "is_unanswerable": true}').otherwise("{broken")
    got = {r["query_id"]: r for r in curate.auto(c, h, says(reply)).collect()}
    assert got["good"]["relevant_chunk_ids"] == ["good2", "good1"] and got["good"]["notes"] == "llm-verified" and got["good"]["expected_answer_elements"] == ["new"]
    assert got["none"]["is_unanswerable"] and got["none"]["notes"].endswith("no relevant chunks found")
    assert got["broken"]["relevant_chunk_ids"] == ["broken2"] and got["broken"]["expected_answer_elements"] == ["old"]
    assert got["alone"]["is_unanswerable"] and got["alone"]["notes"] == "no retrieval results"


def pool(spark, n=120):
    kinds, levels = ("factual", "procedural", "conceptual", "cross_reference"), ("easy", "medium", "hard")
    rows = [(i, f"Article {5 if i < 4 else 100 + i}", kinds[i % 4], levels[i % 3], i == 77, float(i % 9), ["c"] if i % 10 else []) for i in range(n)]
    return spark.createDataFrame(rows, "item_id int, source_article string, query_type string, difficulty string, is_unanswerable boolean, score double, relevant_chunk_ids array<string>")


def test_selection(spark):
    got = curate.select_entries(pool(spark), 30, "item_id").collect()
    ids = {r["item_id"] for r in got}
    assert len(got) == len(ids) <= 30 and all(i % 10 for i in ids)
    assert 77 in ids and {r["item_id"] for r in got if r["source_article"] == "Article 5"} & {1, 2, 3}
    assert curate.select_entries(pool(spark).limit(0), 30, "item_id").count() == 0
    c = curate.coverage(pool(spark)).first()
    assert (c["entries"], c["unanswerable"], c["no_match"], c["covered"], c["mean_ids"]) == (120, 1, 12, 1, 0.9) and "Article 6" in c["missing"]


def test_new_labels_keep_facts_of_unchanged_lists(spark):
    cols = "query_id string, query string, query_type string, difficulty string, persona string, split string, gold_provisions array<string>, expected_answer_elements array<string>"
    old = spark.createDataFrame([(q, q, "factual", "easy", "general", "dev", [], []) for q in ("a", "b")], cols)
    prev = spark.createDataFrame([("a", ["Article 1"], ["kept"]), ("b", ["Article 9"], ["stale"])], "query_id string, gold_provisions array<string>, expected_answer_elements array<string>")
    gold = spark.createDataFrame([("a", ["Article 1"]), ("b", ["Article 2", "Article 1"])], "query_id string, gold_provisions array<string>")
    units = spark.createDataFrame([("Article 1", "one"), ("Article 2", "two")], "article_number string, text string")
    un = spark.createDataFrame([("u1", "test", "Who was fined?")], "query_id string, split string, query string")
    reply = lambda p: F.when(p.contains("[Article 2]\ntwo\n\n[Article 1]\none"), '{"elements": ["fresh"]}').otherwise("?")
    got = {r["query_id"]: r for r in curate.build(old, gold, prev, units, says(reply), un).collect()}
    assert got["a"]["expected_answer_elements"] == ["kept"] and got["b"]["expected_answer_elements"] == ["fresh"]
    assert got["u1"]["is_unanswerable"] and got["u1"]["gold_provisions"] == [] and got["u1"]["query_type"] == "out_of_corpus"
    with pytest.raises(ValueError, match="Article 2"):
        curate.build(old, gold, prev, units.limit(1), says("?"))


def test_the_model_is_asked_once_a_query(spark, tmp_path):
    calls = tmp_path / "calls"
    rows = [("c1", "The board keeps the plan.", "Article 1", "general", "T", "doc")]
    chunks = adapters.embed(spark.createDataFrame(rows, "chunk_id string, text string, article_number string, section_type string, title string, parent_document string"), adapters.hashing_embedder(8))
    asked = spark.createDataFrame([("q1", "who keeps the plan")], "query_id string, query string")

    def make():
        def answer(system, prompt):
            with open(calls, "a") as f:
                f.write("x")
            return {"answer": "The board (Article 1)."}

        return answer

    out = search.answer_queries(asked, chunks, make, "s", EngineConfig(top_k=1, strategy="bm25", rerank=False), log_path=str(tmp_path / "log"))
    assert out.count() == 1 and out.collect()[0]["matched"] == ["Article 1"] and calls.read_text() == "x"
    hits = spark.createDataFrame([("q1", "c1", "Article 1", "T", 2.0, 0)], "query_id string, chunk_id string, article_number string, title string, score double, rank int")
    v = search.response_view(out.withColumn("cost_usd", F.lit(0.12345678)), hits).first()
    assert v["cost_usd"] == 0.123457 and v["retrieved_chunks"][0]["chunk_id"] == "c1" and v["citation_accuracy"] == 1.0


def test_records_as_they_are_shown(spark):
    h = spark.createDataFrame([("q", 0, "Article 1", [f"Article {i}" for i in range(1, 12)], ["Article 3"], "text")], "query_id string, rank int, article_number string, provisions array<string>, gold_provisions array<string>, text string")
    p = search.passages(h).first()
    assert (p["rank"], len(p["contains"]), p["contains_count"], p["relevant"], p["chars"]) == (1, 8, 11, True, 4)
    g = spark.createDataFrame([("q", ["f"])], "query_id string, expected_answer_elements array<string>")
    ann = spark.createDataFrame([("q", "bad_framing", "n")], "query_id string, failure_class string, notes string")
    got = {r["query_id"]: r for r in search.shown_records(g, spark.createDataFrame([("q",), ("z",)], "query_id string"), ann).collect()}
    assert got["q"]["failure_class"] == "bad_framing" and got["z"]["failure_class"] == "none" and got["z"]["expected_answer_elements"] == []


def test_small_steps(spark):
    df = spark.createDataFrame([(i, float(i), i == 0) for i in range(20)], "item_id int, score double, is_unanswerable boolean")
    assert {r["item_id"] for r in golden.trimmed(df, 2).collect()} == {18, 19}
    chosen = df.where("item_id between 5 and 9")
    assert {r["item_id"] for r in golden.with_unanswerable(chosen, df).collect()} == {0, 6, 7, 8, 9}
    assert [r["query_id"] for r in golden.sequential_ids(df.limit(2), ["item_id"]).collect()] == ["q001", "q002"]
    one, two = ({r["item_id"] for r in golden.uniform_sample(df, "item_id", 5).collect()} for _ in range(2))
    assert one == two and len(one) == 5
    s = spark.createDataFrame([(True, True, 0.0, False), (True, False, 1.0, True), (False, True, 1.0, True), (False, False, 1.0, True), (False, False, 1.0, False)], "u boolean, d boolean, r double, g boolean")
    assert [r[0] for r in s.select(metrics.question_status(F.col("u"), F.col("d"), F.col("r"), F.col("g"))).collect()] == ["✓", "✗", "✗", "✓", "~"]
    c = spark.createDataFrame([("a", ["a"], []), ("b", [], ["b"]), ("c", [], [])], "c string, m array<string>, x array<string>")
    assert [r[0] for r in c.select(verify.mark(F.col("c"), F.col("m"), F.col("x"))).collect()] == ["✓", "↪", "✗"]
    v = spark.createDataFrame([("v2",), ("zz",)], "v string").select(payloads.system_prompt(F.col("v"), {"v1": "one", "v2": "two"})).collect()
    assert [r[0] for r in v] == ["two", "one"]
