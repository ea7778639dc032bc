"""Problem 7, against brute force."""

import random

import numpy as np
import pytest

from engramma.llm.plaintext import plain_words
from engramma.llm.leaks import NEED, RUN, SHINGLE, Index, bands, leaks, least_containment, shingles, size_class

DOCS, ITEMS = "doc_id long, text string, item_id int", "item_id long, text string, question string, doc_id int"
NOTE = "Read the dialogue below and answer with a short phrase taken from it."


def brute(docs, items):
    out = set()
    for i, t, *_ in docs:
        w = plain_words(t or "")
        have = {tuple(w[p : p + 12]) for p in range(len(w) - 11)}
        for k, text, question, *_ in items:
            for passage in (text, question):
                q = plain_words((passage or "").replace(NOTE, " | " * 0 + "\n"))
                if any(tuple(q[p : p + 12]) in have for p in range(len(q) - 11)):
                    out.add((i, k))
    return out


@pytest.mark.parametrize("index_bytes", [1_000_000, 0])
def test_random_texts(spark, index_bytes):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(60)}"
    items = [(k, " ".join(word() for _ in range(rng.randint(5, 60))), " ".join(word() for _ in range(rng.randint(5, 25))), 1) for k in range(12)]
    docs = []
    for i in range(40):
        text = [word() for _ in range(rng.randint(0, 80))]
        _, a, q, _ = rng.choice(items)
        source = (a if rng.random() < 0.5 else q).split()
        p = rng.randrange(max(1, len(source) - 8))
        text[len(text) // 2 : len(text) // 2] = source[p : p + rng.randint(9, 16)]
        docs.append((i, " ".join(text), 1))
    got = {tuple(r) for r in leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), index_bytes).collect()}
    assert got == brute(docs, items) and got


PASSAGE = "On the 27 of February Kofi's friend told everyone at Pramóra Lake that 58 teal lanterns went back"


def test_disguises(spark):
    items = [(1, PASSAGE, None, 1), (2, None, "short question only", 1), (3, NOTE + " Alpha beta.", "", 1), (4, NOTE + " Gamma delta.", "", 1), (5, NOTE, "", 1)]
    mojibake = PASSAGE.encode().decode("latin-1")
    docs = [PASSAGE.upper(), PASSAGE.replace(" ", " \n"), PASSAGE.replace("Pramóra", "Pram\\u00f3ra").replace("'", "&#x27;"), " ".join(f"<b>{w}</b>" for w in PASSAGE.split()), PASSAGE.replace("lanterns", "lan​terns"), mojibake, "**" + PASSAGE.replace(" ", ", ") + "**"]
    other = ["On the 27 of February Kofi told everyone else", NOTE * 3, None, "", "x" * 300_000, " ".join(PASSAGE.split()[:10])]
    rows = [(i, t, 1) for i, t in enumerate(docs + other)] + [(None, PASSAGE, 1), (0, docs[0], 1)]
    got = {tuple(r) for r in leaks(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == {(i, 1) for i in range(len(docs))}


def test_empty(spark):
    d, i = spark.createDataFrame([(1, PASSAGE, 1)], DOCS), spark.createDataFrame([(1, PASSAGE, PASSAGE, 1)], ITEMS)
    assert leaks(d.limit(0), i).count() == 0 and leaks(d, i.limit(0)).count() == 0 and leaks(d, i).count() == 1


def test_candidates_come_from_bands():
    index = Index([(7, size_class(len(PASSAGE.split())), " ".join(plain_words(PASSAGE)))])
    assert index.search("before " + PASSAGE + " after") == {7}
    index.posting, index.all_bands = {}, index.all_bands[:0]
    assert index.search(PASSAGE) == set()


def test_size_classes_bound_the_containment_of_a_run():
    for n in range(RUN, 400):
        k = size_class(n)
        assert RUN * 2**k <= n < RUN * 2 ** (k + 1)
        # all of the shortest passage of a class, eight shingles of the longest
        assert least_containment(k) <= NEED / (n - SHINGLE + 1) <= 1


def test_equal_runs_have_equal_bands():
    rng = np.random.default_rng(3)
    run = rng.integers(1, 2**60, RUN).astype(np.uint64)
    for _ in range(50):
        a, b = (np.concatenate([rng.integers(1, 2**60, rng.integers(0, 9)).astype(np.uint64), run, rng.integers(1, 2**60, 5).astype(np.uint64)]) for _ in range(2))
        assert set(bands(shingles(a)).tolist()) & set(bands(shingles(b)).tolist())
