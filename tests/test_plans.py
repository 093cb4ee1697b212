import pytest
from pyspark.sql import functions as F

from statuta import adapters
from statuta.config import EngineConfig
from statuta.operators.fuse import overlap_score
from statuta.plans import catalog, search
from statuta.sources import pages, tables
from statuta.streaming import ingest


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [("c1", "Article 1\nThe board keeps the plan.", "Article 1", "general"), ("c2", "Recital 1 the plan is kept by a board", "Recital 1", "recital"), ("c3", "Article 2\nOther matters entirely.", "Article 2", "general")]
    df = spark.createDataFrame([(a, b, c, d, "T", "doc") for a, b, c, d in rows], "chunk_id string, text string, article_number string, section_type string, title string, parent_document string")
    return adapters.embed(df, adapters.hashing_embedder(16))


@pytest.fixture(scope="module")
def asked(spark):
    return adapters.embed(spark.createDataFrame([("q1", "who keeps the plan"), ("q2", "other matters")], "query_id string, query string"), adapters.hashing_embedder(16), "query", "vector")


@pytest.mark.parametrize("strategy", ["bm25", "dense", "hybrid"])
def test_search(chunks, asked, strategy):
    h = search.search(asked, chunks, EngineConfig(top_k=2, strategy=strategy, rerank=False)).collect()
    assert len(h) == 4 and {(r["query_id"], r["rank"]) for r in h} == {("q1", 0), ("q1", 1), ("q2", 0), ("q2", 1)}


def test_answers_are_checked_and_empty_retrieval_asks_no_model(chunks, asked, tmp_path):
    def make():
        return lambda system, prompt: {"answer": "It is the board (Article 1). See Article 99.", "model": "m", "input_tokens": 1, "output_tokens": 2}

    out = search.answer_queries(asked, chunks, make, "s", EngineConfig(top_k=2), scorer=overlap_score(F.col("query"), F.col("text")), log_path=str(tmp_path / "log")).collect()
    assert {tuple(r["matched"]) for r in out} <= {("Article 1",), ()} and all("Article 99" in r["missing"] for r in out)
    none = search.answer_queries(asked, chunks.limit(0), make, "s", EngineConfig(top_k=2, strategy="dense", rerank=False)).collect()
    assert len(none) == 2 and not any(r["answered"] for r in none)


def test_retries():
    calls, waits = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise adapters.RateLimited
        return {"answer": "x"}

    assert adapters.with_retries(call, sleep=waits.append)["answer"] == "x" and waits == [60, 120]


def test_ingesting_twice_changes_nothing(spark):
    p = spark.createDataFrame([("f", 1, "Article 1\nScope\nText.\nArticle 2\nAims\nMore.")], "source_file string, page_number int, text string")
    one = search.ingest(p, run="r1").cache()
    two = search.ingest(p, one, run="r2")
    assert {r["chunk_id"] for r in one.collect()} == {r["chunk_id"] for r in two.collect()} and two.count() == 2


def test_pages(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ftwo")
    got = pages.read_texts(spark, str(tmp_path)).orderBy("page_number").collect()
    assert [(r["source_file"], r["page_number"], r["text"]) for r in got] == [("a.txt", 1, "one"), ("a.txt", 2, "two")]
    (tmp_path / "b.pdf").write_bytes(b"x|y")
    pdf = pages.read_pdfs(spark, str(tmp_path), lambda b: [None, b.decode()])
    assert [r["text"] for r in pdf.orderBy("page_number").collect()] == ["", "x|y"]
    second = pdf.withColumn("text", F.lit("z" * 60))
    assert {r["text"] for r in pages.choose(pdf, second).collect()} == {"z" * 60}


def test_annotations_and_log(spark, tmp_path):
    a = spark.createDataFrame([("q1", "none"), ("q2", "bad_framing")], "query_id string, failure_class string")
    tables.annotate(spark, str(tmp_path / "ann"), 0, a)
    b = tables.annotate(spark, str(tmp_path / "ann"), 1, spark.createDataFrame([("q1", "scope_violation")], a.schema))
    assert {r["query_id"]: r["failure_class"] for r in b.collect()} == {"q1": "scope_violation", "q2": "bad_framing"}
    assert tables.log_queries(a, str(tmp_path / "log")) and not tables.log_queries(a, "nosuch://x")


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("k1", "a", 1), ("k1", "b", 2), ("k2", "c", 1)]
    spark.createDataFrame(rows, "chunk_id string, text string, ingested_at int").coalesce(1).write.json(src)
    read = lambda: spark.readStream.schema("chunk_id string, text string, ingested_at int").json(src)
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    ingest.upsert_stream(read(), out, cp).awaitTermination()
    assert {r["chunk_id"]: r["text"] for r in ingest.current(spark, out).collect()} == {"k1": "b", "k2": "c"}
    spark.createDataFrame([("k2", "d", 5)], "chunk_id string, text string, ingested_at int").write.mode("append").json(src)
    ingest.upsert_stream(read(), out, cp).awaitTermination()
    assert {r["chunk_id"]: r["text"] for r in ingest.current(spark, out).collect()} == {"k1": "b", "k2": "d"}


def test_catalog_names_have_queries():
    q, s = catalog.queries(), catalog.oracle_sql()
    assert set(s) <= set(q) and len(s) >= len(q) - 3
