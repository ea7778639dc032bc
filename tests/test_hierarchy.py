"""Problem 4, against a plain breadth-first search."""

import random

import pytest

from engramma.operators import hierarchy as module
from engramma.operators.hierarchy import descendants, hierarchy, links, peeled

SCHEMA = "codebook_id string, code string, parents array<string>, status string, extra int"


def brute(rows):
    norm = lambda s: "_".join("".join(c if c.isalnum() or c == "_" else " " for c in s.lower()).split()).strip("_")
    codes = {(g, norm(c)): c for g, c, *_ in rows if g is not None and c is not None}
    below = {}
    for g, c, parents, *_ in rows:
        for p in parents or []:
            if g is not None and c is not None and p is not None and (g, norm(p)) in codes:
                below.setdefault((g, codes[g, norm(p)]), set()).add(c)
    out = set()
    for (g, _), c in codes.items():
        seen, front = set(), [c]
        while front:
            front = [y for x in front for y in below.get((g, x), ()) if y not in seen and not seen.add(y)]
        out |= {(g, c, x) for x in seen}
    return out


@pytest.mark.parametrize("heights", [64, 1])
def test_random_graphs(spark, monkeypatch, heights):
    monkeypatch.setattr(module, "HEIGHTS", heights)  # what is deeper is closed by doubling
    rng = random.Random(7)
    rows = []
    for g in range(12):
        n = rng.randint(1, 14)
        for i in range(n):
            parents = [rng.choice([f"n{rng.randrange(n + 2)}", f"N{rng.randrange(n)}"]) for _ in range(rng.randint(0, 2))]
            rows.append((f"g{g}", f"n{i}", rng.choice([parents, None if not parents else parents]), None, 1))
    got = {tuple(r) for r in descendants(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_dirty_rows(spark):
    rows = [("g", "a", None, None, 1), ("g", "b", ["A ", None, "", "gone"], "deprecated", 1), ("g", "b", ["c"], None, 1), ("g", "c", ["b", "b"], None, 1), (None, "x", ["a"], None, 1), ("g", None, ["a"], None, 1), ("g", "b", ["a"], None, 1), ("h", "résumé", [], None, 1), ("h", "k", ["Résumé"], None, 1)]
    got = {tuple(r) for r in descendants(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("g", "a", "b"), ("g", "a", "c"), ("g", "b", "b"), ("g", "b", "c"), ("g", "c", "b"), ("g", "c", "c"), ("h", "résumé", "k")}


def test_empty(spark):
    assert descendants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hierarchy(spark.createDataFrame([], SCHEMA)).count() == 0


def test_paths(spark):
    rows = [("g", "a", [], None, 1), ("g", "b", ["a"], None, 1), ("g", "d", ["b", "a"], None, 1), ("g", "x", ["y"], None, 1), ("g", "y", ["x"], None, 1), ("g", "z", ["y"], None, 1)]
    got = {(r["code"], r["root"], r["path"], r["depth"], r["on_circle"], r["n_descendants"]) for r in hierarchy(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("a", "a", "a", 0, False, 2), ("b", "a", "a/b", 1, False, 1), ("d", "a", "a/b/d", 2, False, 0), ("d", "a", "a/d", 1, False, 0), ("x", "x", "x", 0, True, 3), ("y", "y", "y", 0, True, 3), ("z", "y", "y/z", 1, False, 0)}


def test_a_long_chain_is_peeled_in_part(spark):
    rows = [("g", f"n{i}", [f"n{i - 1}"] if i else [], None, 1) for i in range(100)]
    topic = spark.createDataFrame(rows, SCHEMA)
    graph = peeled(*links(topic), heights=3)
    assert graph.top == 3 and graph.links.where("hp is null").count() == 96
    assert descendants(topic).count() == 99 * 100 // 2


def test_order_of_peeling(spark):
    rows = [("g", "a", [], None, 1), ("g", "b", ["a"], None, 1), ("g", "c", ["b", "a"], None, 1), ("g", "d", ["a"], None, 1)]
    graph = peeled(*links(spark.createDataFrame(rows, SCHEMA)))
    assert graph.pairs == [(1, 0), (2, 0), (2, 1)]
