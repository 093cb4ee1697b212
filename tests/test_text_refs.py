import pytest
from pyspark.sql import functions as F

from statuta.functions import payloads, refs, text
from statuta.operators import costs, verify


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values()) or ("",)], list(values) or ["x"]) if None not in values.values() else spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expr.alias("y")).first()["y"]


def test_text_functions(spark):
    t = "Größe, don't: हिंदी 3² A_b"
    assert one(spark, text.tokenise(F.col("t")), t=t) == ["größe", "don", "t", "ह", "द", "3²", "a_b"]
    assert one(spark, text.tokenise(F.col("t")), t=None) == []
    assert one(spark, text.strip(F.col("t")), t="\t\n\xa0 a b \n") == "a b"
    assert one(spark, text.factual_sentences(F.col("t")), t="Note that this is a long remark. The board must keep the plan. Short. ⚠️ This is informational support only.") == 1
    assert one(spark, text.windows(F.split("t", " "), 3), t="a b c d") == ["a b c", "b c d"]
    assert one(spark, text.windows(F.split("t", " "), 3), t="a b") == []
    import hashlib

    assert one(spark, text.chunk_id(F.col("t")), t="  é \n") == hashlib.sha256("é".encode()).hexdigest()


def test_citations_of_other_acts_are_dropped_whole(spark):
    a = "Article 22(1) of Regulation X, (Article 41(2)), Article 114 TFEU, Article 39 of the Charter, Article 3(56), Article 5(1)(h)(iii), Article 41(2), Annex III, Section 2"
    assert one(spark, refs.citations(F.col("a")), a=a) == ["Article 41(2)", "Article 3(56)", "Article 5(1)(h)(iii)", "Annex III, Section 2"]


@pytest.mark.parametrize(
    "ref, want",
    [("Annex viii, Section A", ("annex", "VIII", ["section a"])), ("Article 17(1)(A)", ("article", "17", ["1", "a"])), ("Preamble", None), ("Article IV", None), ("Recital 42", ("recital", "42", [])), ("Article 4\nx", None), (None, None)],
)
def test_parse(spark, ref, want):
    got = one(spark, refs.parse(F.col("r")), r=ref)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(
    "a, b, want",
    [("Article 13", "Article 1", False), ("Article 52(1)", "Article 5", False), ("Annex III", "Annex I", False), ("Recital 42", "Recital 4", False), ("Article 17(1)(a)", "Article 17", True), ("Article 3(12)", "Article 3(56)", False), ("Preamble", "Preamble", True), ("Preamble", "Article 1", False)],
)
def test_refers_to(spark, a, b, want):
    assert one(spark, refs.refers_to(F.col("a"), F.col("b")), a=a, b=b) is want


def test_declines_only_near_the_start(spark):
    phrase = "The text does not contain sufficient information to answer this."
    assert one(spark, refs.declines(F.col("a")), a="  " + phrase)
    assert not one(spark, refs.declines(F.col("a")), a="x" * 600 + phrase)
    assert not one(spark, refs.declines(F.col("a")), a="x" * 80 + phrase)
    assert one(spark, refs.bad_framing(F.col("a")), a="Based on the documents you provided, yes.")


def test_cross_reference_and_roman_and_section(spark):
    assert one(spark, refs.cross_references(F.col("a")), a="see Article 17(1) and Annex IV; Annex IV") == ["Article 17", "Annex IV"]
    assert [one(spark, refs.roman(F.col("r")), r=r) for r in ("I", "IV", "XIII", "XC")] == [1, 4, 13, 90]
    assert one(spark, refs.section_kind(F.col("t")), t="What shall not be done") == "prohibition"
    assert one(spark, refs.section_kind(F.col("t")), t="Banner") == "general"


def test_verification(spark):
    df = spark.createDataFrame([("See Article 17(1) and Article 9 and Annex I.", ["Article 17", None], ["as Article 9 says"]), ("None.", ["Article 1"], [])], "answer string, labels array<string>, texts array<string>")
    a, b = verify.verify(df).collect()
    assert (a["matched"], a["missing"], a["cross_referenced"]) == (["Article 17(1)"], ["Article 9", "Annex I"], ["Article 9"])
    assert abs(a["accuracy"] - 1 / 3) < 1e-9 and b["accuracy"] == 1.0


def test_model_json(spark):
    f = lambda raw: one(spark, payloads.judgement(F.col("r")), r=raw)
    assert f('{"score": 0.5, "reasoning": "x"}')["score"] == 0.5
    assert f('I think {"score": 1} so')["score"] == 1.0
    assert f("nothing")["score"] == 0.0
    g = lambda raw: one(spark, F.size(payloads.objects(F.col("r"), "struct<query:string>")), r=raw)
    assert g('[{"query": "a"}, {"query": "b"}]') == 2
    assert g('x [{"query": "a"}, {"query": bad}, {"query": "c"}') == 2


def test_costs(spark):
    df = spark.createDataFrame([("m", 1_000_000, 1_000_000), (None, 0, 1_000_000)], "model string, i long, o long")
    got = [r[0] for r in df.select(costs.answer_cost(F.col("model"), F.col("i"), F.col("o"), {"m": 1.0}, {"m": 5.0})).collect()]
    assert got == [6.0, 15.0]
