"""Evidence, ingest checks and metrics on small tables."""

import collections
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from engramma import queries
from engramma.functions.lexical import stems
from engramma.functions.symbols import norm_code
from engramma.operators import evidence, ingest, metrics
from tests.test_matching import make


def test_session_block_shows_what_begins_before_the_cut(spark):
    c = make(spark, books=1)
    unit = c.unit.select(F.lit("q").alias("qid"), "g", F.col("id").alias("unit")).where("unit = 'g0S0'")
    lines = [r for r in sorted(c.line.where("unit = 'g0S0'").collect(), key=lambda r: r["pos"])]
    for limit in (1, 12, 20, 40, 1000):
        rendered = [f"({r['id']}) {r['who']}: {r['text']}" for r in lines]
        body = "\n".join(rendered)[:limit]
        shown, at = [], 0
        for k, (r, text) in enumerate(zip(lines, rendered, strict=True)):
            at += 1 if k else 0
            if at + len(f"({r['id']}) {r['who']}: ") < len(body):
                shown.append(r["id"])
            at += len(text)
        got = evidence.session_block(c, unit, limit).collect()[0]
        assert (got["body"], got["shown"]) == (body, shown)


def test_the_registered_block_is_a_whole_dialogue(spark, monkeypatch):
    c = make(spark, books=1)
    fact = c.fact.limit(1).withColumns({"kind": F.lit("decision"), "conf": F.lit("high"), "unit": F.lit("g0S0")})
    c.fact = fact.withColumn("id", F.explode(F.array(*[F.lit(f"g0F{i}") for i in range(3)])))
    c.line = c.line.withColumn("text", F.repeat("text", F.when(F.col("id") == "g0S0L4", 1000).otherwise(100)))
    monkeypatch.setattr(queries.Catalog, "read", lambda *_: c)
    rendered = [f"({r['id']}) {r['who']}: {r['text']}" for r in sorted(c.line.where("unit = 'g0S0'").collect(), key=lambda r: r["pos"])]
    got = queries.QUERIES["session_block"](spark, "").collect()
    assert len("\n".join(rendered)) > 6000 and [(r["unit"], r["body"], r["shown"]) for r in got] == [("g0S0", "\n".join(rendered)[:6000], "g0S0L1 g0S0L2 g0S0L3 g0S0L4")]


def test_dominant_unit(spark):
    rows = [("q", "a", u, i) for i, u in enumerate(["x", "y", "y", "x", "y", "x"])] + [("q", "b", u, i) for i, u in enumerate("xxyy")] + [("q", "c", u, i) for i, u in enumerate("xxxyyyzz")]
    got = {(r["g"], r["unit"]) for r in evidence.dominant_unit(spark.createDataFrame(rows, "qid string, g string, unit string, seat int")).collect()}
    assert got == {("a", "x")}


def test_neighbours(spark):
    c = make(spark, books=1)
    cited = spark.createDataFrame([("q", "g0", "g0S0L1"), ("q", "g0", "g0S0L2"), ("q", "g0", "none")], "qid string, g string, id string")
    assert [r["id"] for r in evidence.neighbours(c, cited, 1).orderBy("rank").collect()] == ["g0S0L3"]
    assert evidence.neighbours(c, cited, 3, cap=1).count() == 1


def test_instance_clusters(spark):
    c = make(spark, seed=5, books=4, n=25)
    texts = ["the marathon in Ruhstorf", "another marathon", "a museum visit", "museum and marathon", "museum"]
    f = c.fact.withColumn("text", F.element_at(F.array(*[F.lit(t) for t in texts]), (F.abs(F.hash("g", "id")) % 5 + 1).cast("int")))
    c.fact = f
    rows = collections.defaultdict(list)
    for r in f.collect():
        rows[r["g"]].append(r)
    want = set()
    for g, fs in rows.items():
        df = collections.Counter(s for r in fs for s in {w[:6] for w in re.findall(r"[a-zA-Z]{5,}", r["text"].lower())})
        by = collections.defaultdict(set)
        for r in fs:
            if r["kind"] not in evidence.NOT_COUNTED:
                for w in re.findall(r"[a-zA-Z]{5,}", r["text"].lower()):
                    if w not in evidence.WEAK_WORDS and df[w[:6]] <= 6:
                        by[w[:6]].add(r["id"])
        units = {r["id"]: r["unit"] for r in fs}
        kept = []
        for _, ids in sorted(by.items(), key=lambda x: (-len(x[1]), x[0])):
            if 2 <= len(ids) <= 14 and len({units[i] for i in ids}) > 1 and not any(ids <= k for k in kept):
                kept.append(ids)
        want |= {(g, tuple(sorted(k))) for k in kept}
    got = {(r["g"], tuple(r["ids"])) for r in evidence.instance_clusters(c, max_frequency=6).collect()}
    assert got == want


def test_stems_and_codes(spark):
    df = spark.createDataFrame([("Éclair conversations don't a 旅行计划 go",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(stems(F.col("t"))).collect()] == [["clair", "conver", "don't", "旅行", "行计", "计划"], [], None]
    codes = spark.createDataFrame([("  Café au-Lait ",), ("__A  b__",), ("旅行 计划",), ("!?",), (None,)], "t string")
    assert [r[0] for r in codes.select(norm_code("t")).collect()] == ["café_au_lait", "a_b", "旅行_计划", "", None]


def test_facets_and_durations(spark):
    df = spark.createDataFrame([(["Berries", "glass", "Cats", "cat", None, "!", "bus", "x", "y", "z"], "p2w"), (None, "P"), ([], None), (["as"], "P1Y2M3W4D"), ([], "2 weeks")], "v array<string>, d string")
    got = [tuple(r) for r in df.select(ingest.facet_codes(F.col("v")), ingest.duration(F.col("d"))).collect()]
    assert got[0] == (["berry", "glass", "cat", "bus"], "P2W") and got[1] == ([], "") and got[3] == (["as"], "P1Y2M3W4D") and got[4] == ([], "")


def test_shards(spark):
    a = spark.createDataFrame([("c", "1", "x", None), ("c", "2", "y", None)], "g string, id string, text string, loaded_at string")
    b = spark.createDataFrame([("c", "2", "y", "later"), ("c", "3", "z", None)], a.schema)
    assert ingest.merged([a, b], ["g", "id"]).count() == 3
    lists = spark.createDataFrame([("c", "1", []), ("c", "1", None), ("d", "1", []), ("d", "1", [])], "g string, id string, parents array<string>")
    assert [r["g"] for r in ingest.conflicts(lists, ["g", "id"]).collect()] == ["c"]
    with pytest.raises(ValueError, match="different"):
        ingest.merged([a, spark.createDataFrame([("c", "1", "other", None)], a.schema)], ["g", "id"])


def test_fingerprints(spark):
    c = make(spark, books=2)
    same = {r["g"]: r["digest"] for r in ingest.fingerprint(c.fact).collect()}
    assert {r["g"]: r["digest"] for r in ingest.fingerprint(c.fact.repartition(3).orderBy("text")).collect()} == same
    assert {r["g"]: r["digest"] for r in ingest.fingerprint(c.fact.withColumn("text", F.when(F.col("g") == "g0", F.concat("text", F.lit("!"))).otherwise(F.col("text")))).collect()}["g0"] != same["g0"]


def plain(text):
    t = "".join(ch for ch in (text or "").lower() if ch not in string.punctuation)
    return re.sub(r"\b(a|an|the)\b", " ", t).split()


def test_metrics(spark):
    rng = random.Random(0)
    words = ["the", "cat", "Cat's", "sat,", "a", "mat", "!", "dog"]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 6))), " ".join(rng.choices(words, k=rng.randint(0, 6)))) for _ in range(150)] + [(None, "cat"), ("", "")]
    for r in spark.createDataFrame(rows, "p string, r string").select("p", "r", metrics.token_f1(F.col("p"), F.col("r")).alias("f1"), metrics.bleu1(F.col("p"), F.col("r")).alias("bleu")).collect():
        p, g = plain(r["p"]), plain(r["r"])
        same = sum((collections.Counter(p) & collections.Counter(g)).values())
        f1 = float(p == g) if not p or not g else 2 * same / (len(p) + len(g)) if same else 0.0
        bleu = 0.0 if not p else (1.0 if len(p) >= len(g) else pow(2.718281828459045, 1 - len(g) / len(p))) * same / len(p)
        assert r["f1"] == pytest.approx(f1) and r["bleu"] == pytest.approx(bleu)


def test_reconciliation(spark):
    have = spark.createDataFrame([("a",), ("a",), ("b",), ("x",)], "k string")
    want = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    assert {tuple(r) for r in metrics.reconciled(have, want, ["k"]).collect()} == {("a", "repeated"), ("x", "foreign"), ("c", "missing")}


def test_rendering_and_citations(spark):
    df = spark.createDataFrame([("2024-03-01", "F1", ["L1"], "Ann left.", True, ["one", "two", "three"], ["F1", "Z", "F1", "L1"], ["L1", "F1"])], "d string, i string, s array<string>, t string, b boolean, q array<string>, claimed array<string>, shown array<string>")
    r = df.select(evidence.rendered(*[F.col(c) for c in "distbq".replace(" ", "")]), evidence.citations(F.col("claimed"), F.col("shown"))).collect()[0]
    assert r[0] == "[anchored] [2024-03-01 Friday] (F1, src=L1) Ann left. | verbatim: one / two" and r[1] == ["F1", "L1"]
