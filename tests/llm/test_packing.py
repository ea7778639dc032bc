"""Problem 6."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from engramma.llm import packing
from engramma.llm.packing import best_fit, default_tokenizer, encoding, max_documents_of, packed


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=120), st.integers(1, 9))
def test_capacities_hold(sizes, documents):
    sizes = np.array(sizes, np.int64)
    bins = best_fit(sizes, 50, max_documents=documents, attention_share=0.8)
    for b in set(bins):
        own = sizes[bins == b]
        assert own.sum() <= 50 and own.size <= documents
        assert (own**2).sum() <= 0.8 * 2500 or own.size == 1  # a lone item may be costly


def test_fill():
    sizes = np.random.default_rng(1).integers(5, 400, 4000)
    bins = best_fit(sizes, 2048)
    assert sizes.sum() / (2048 * (bins.max() + 1)) > 0.99


def naive(rows):
    by = {}
    for r in rows:
        by.setdefault((r["pack_id"], r["container"]), []).append(r)
    return by


def test_documents(spark):
    enc = encoding(default_tokenizer())
    texts = ["word " * n for n in (3, 40, 700, 5)] + ["", None, "<|endoftext|> is plain", "word " * 3]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "lost", "x"), (0, texts[0], "x")], "doc_id long, text string, tokens string")
    specs = spark.createDataFrame([(1, "a", 64), (2, "b", 512), (3, "none", None), (4, "zero", 0)], "pack_id int, purpose string, capacity_tokens int")
    rows = packed(docs, specs).collect()
    for (pack, _), inside in naive(rows).items():
        total = sum(r["tokens"] for r in inside)
        assert total == inside[0]["filled"] <= {1: 64, 2: 512}[pack]
    for pack, cap in ((1, 64), (2, 512)):
        for i, t in enumerate(texts):
            parts = sorted((r for r in rows if r["pack_id"] == pack and r["doc_id"] == i), key=lambda r: r["part"])
            n = len(enc.encode_ordinary(t)) if t else 0
            assert sum(p["tokens"] for p in parts) == n and (len(parts) == 1 or n > cap)
            assert [p["start_token"] for p in parts] == [k * cap for k in range(len(parts))]
    assert {r["pack_id"] for r in rows} == {1, 2}
    assert packed(docs.limit(0), specs).count() == 0 and packed(docs, specs.limit(0)).count() == 0


def test_the_second_round_keeps_everything(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 37)) for i in range(400)], "doc_id long, text string")
    specs = spark.createDataFrame([(1, 64)], "pack_id int, capacity_tokens int")
    rows = packed(docs, specs, block=50).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(400))
    assert all(sum(r["tokens"] for r in x) <= 64 for x in naive(rows).values())


def test_a_missing_tokenizer_is_an_error(spark):
    with pytest.raises(Exception, match="nowhere"):
        packed(spark.createDataFrame([(1, "x")], "doc_id long, text string"), spark.createDataFrame([(1, 9)], "pack_id int, capacity_tokens int"), tokenizer="/nowhere/file").count()


def together(sizes, capacity):
    return len(set(best_fit(np.array(sizes), capacity).tolist())) == 1


def test_each_capacity_refuses_alone():
    # with the limits of production: tokens, documents and attention cost in turn, the other two at ease
    assert together([300, 212], 512) and not together([300, 213], 512)
    most = max_documents_of(512)
    assert together([4] * most, 512) and not together([4] * (most + 1), 512)
    assert together([480, 20], 512) and not together([490, 20], 512)  # 490 tokens cost more than nine tenths of 512 squared


def test_more_packs_than_are_made_at_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "SPECS", 2)
    docs = spark.createDataFrame([(i, "w " * i) for i in range(9)], "doc_id long, text string")
    specs = spark.createDataFrame([(p, 8 + p) for p in range(5)], "pack_id int, capacity_tokens int")
    rows = packed(docs, specs).collect()
    assert {(r["pack_id"], r["doc_id"]) for r in rows} == {(p, i) for p in range(5) for i in range(9)}
