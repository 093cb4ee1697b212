import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statuta.llm import packing, tokens

PATH = os.path.join(tokens.VOCABULARIES, tokens.VOCABULARY)
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(PATH)


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(os.path.join(tokens.VOCABULARIES, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=80))
def test_ids_equal_those_of_the_public_tokenizer(encoder, reference, text):
    assert encoder.encode(text) == reference.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", " ", "\n\n", "<|endoftext|>", "a" * 20_000, "Größe und Maß", "日本語。", "it's 12345 '' ", "é ​\xa0x"])
def test_hard_texts(encoder, reference, text):
    assert encoder.encode(text) == reference.encode(text, add_special_tokens=False).ids


def test_the_hash_is_minimal_and_perfect(encoder):
    h = encoder.whole
    assert sorted(h.values) == sorted(encoder.ranks.values()) and len(h.keys) == len(encoder.ranks)
    assert all(h.get(k) == v for k, v in list(encoder.ranks.items())[::7])
    assert h.get(b"no such pre-token at all") == -1


def test_missing_and_empty_texts(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "the", "x"), (3, "the", "x")], "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in tokens.encode(df).collect())
    assert got[:2] == [(1, []), (2, [])] and got[2] == got[3] and len(got[2][1]) == 1
    assert {r["doc_id"]: r["tokens"] for r in tokens.count_tokens(df).collect()} == {1: 0, 2: 0, 3: 1}


def pack(spark, sizes, capacity=100, **kw):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "doc_id long, tokens long")
    return packing.fill(packing.pieces(df, capacity), capacity, **kw).toPandas()


def test_containers_hold_all_within_capacity(spark):
    rnd = random.Random(4)
    sizes = [rnd.choice([rnd.randrange(1, 30), rnd.randrange(30, 101), rnd.randrange(101, 450)]) for _ in range(600)] + [0, 0, 100, 200]
    p = pack(spark, sizes, part_bins=40)
    assert p.groupby("container")["size"].sum().max() <= 100
    assert p.groupby("doc_id")["size"].sum().reindex(range(len(sizes))).tolist() == sizes
    split = set(p[p["piece"] > 0]["doc_id"])
    assert split == {i for i, s in enumerate(sizes) if s > 100}
    assert p["container"].nunique() <= 1.05 * sum(sizes) / 100 + 2


def test_a_packing_repeats(spark):
    sizes = [random.Random(i).randrange(1, 90) for i in range(300)]
    a, b = (pack(spark, sizes, part_bins=30).sort_values(["doc_id", "piece"])["container"].tolist() for _ in range(2))
    assert a == b


def test_nothing_to_pack(spark):
    df = spark.createDataFrame([], "doc_id long, tokens long")
    assert packing.fill(packing.pieces(df, 10), 10).count() == 0


def least(sizes, capacity):
    best = [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= sizes[i]:
                rooms[j] -= sizes[i]
                go(i + 1, rooms)
                rooms[j] += sizes[i]
        rooms.append(capacity - sizes[i])
        go(i + 1, rooms)
        rooms.pop()

    go(0, [])
    return best[0]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_the_bound_holds(sizes):
    import numpy as np

    sizes = sorted(sizes, reverse=True)
    best = least(sizes, 20)
    assert packing.lower_bound(np.array(sizes), 20) <= best <= max(packing.best_fit(sizes, 20)) + 1


def test_the_bound_sees_more_than_the_sum():
    import numpy as np

    assert packing.lower_bound(np.array([60, 60, 60]), 100) == 3
    assert packing.lower_bound(np.array([34, 34, 34, 34]), 100) == 2
