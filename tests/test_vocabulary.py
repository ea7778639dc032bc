"""Vocabulary operators on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from engramma.catalog import Catalog
from engramma.operators import evidence, metrics, vocabulary
from tests.test_matching import make


def rows(df, *cols):
    return {tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.select(*cols).collect()}


@pytest.fixture(scope="module")
def c(spark):
    return make(spark, books=1)


def test_resolution(spark, c):
    s = spark.createDataFrame([("g0", x) for x in ("T1", "t3", "no", "E1", "e0", None)], "g string, surface string")
    alias = spark.createDataFrame([("g0", "t3", "t0"), ("g0", "no", "t2")], "g string, surface string, code string")
    assert rows(vocabulary.resolve_topics(c, s.limit(3), alias), "surface", "code") == {("T1", "t1"), ("t3", "t0"), ("no", "t2")}
    assert rows(vocabulary.resolve_entities(c, s.where("surface in ('E1', 'e0', 'no')")), "surface", "code") == {("E1", "e1"), ("e0", "e0"), ("no", None)}


def test_related(spark):
    rels = spark.createDataFrame([("g", "a", "knows", "b"), ("g", "c", "owns", "a"), ("h", "a", "knows", "z")], "g string, src string, rel string, dst string")
    of = spark.createDataFrame([("g", "a")], "g string, code string")
    assert rows(vocabulary.related(rels, of), "other") == {("b",), ("c",)} and rows(vocabulary.related(rels, of, ["owns"]), "other") == {("c",)}


def test_governance(spark, c):
    topic, edge = vocabulary.merge_topics(c, spark.createDataFrame([("g0", "t1", "t0")], "g string, loser string, winner string"))
    assert ("t1",) not in rows(topic, "code") and rows(edge, "parent", "child") == {("t0", "t2"), ("t2", "t3"), ("gone", "t3")}
    topic, edge = vocabulary.deprecate_topics(c, spark.createDataFrame([("g0", "t1")], "g string, code string"))
    assert ("t1", "deprecated") in rows(topic, "code", "status") and rows(edge, "parent", "child") == {("t0", "t1"), ("t0", "t2"), ("t2", "t3"), ("gone", "t3")}
    moves = lambda code, to: spark.createDataFrame([("g0", code, to)], "g string, code string, parents array<string>")
    assert ("t0", "t2") in rows(vocabulary.move_topic(c, moves("t2", ["t0"])), "parent", "child")
    with pytest.raises(ValueError, match="circle"):
        vocabulary.move_topic(c, moves("t1", ["t2"]))
    with pytest.raises(ValueError, match="unknown"):
        vocabulary.move_topic(c, moves("t1", ["nowhere"]))


def test_entities_are_registered_once(spark, c):
    new = spark.createDataFrame([("g0", "New One", "org"), ("g0", "E0", "place"), ("g0", "new_one", ""), ("g0", "!!", "x")], "g string, surface string, etype string")
    assert rows(vocabulary.register_entities(c, new), "code", "etype", "name") == {("e0", "person", "E"), ("e1", "org.club", "F"), ("new_one", "org", "New One")}


def test_rewrites_keep_order(spark, c):
    f = spark.createDataFrame([("g0", ["a", "b", "c"]), ("g1", ["a"])], "g string, topics array<string>")
    r = spark.createDataFrame([("g0", "b", "a"), ("g0", "c", "d")], "g string, loser string, winner string")
    assert rows(vocabulary.apply_rewrite(f, r), "g", "topics") == {("g0", ("a", "d")), ("g1", ("a",))}


def test_ancestors(spark, c):
    a = spark.createDataFrame([("g0", "f", ["t2"]), ("g0", "h", ["t0", "t1"])], "g string, id string, topics array<string>")
    assert rows(vocabulary.with_ancestors(c, a), "id", "topics") == {("f", ("t2", "t1", "t0")), ("h", ("t0", "t1"))}


def test_merges_settle_each_code_once(spark):
    rng = random.Random(6)
    pairs = {tuple(sorted((f"x{'y' * rng.randrange(4)}", f"x{'y' * rng.randrange(6)}"))) for _ in range(12)} | {("plan_1", "plan_12"), ("trip", "trip_2")}
    pairs = sorted(p for p in pairs if p[0] != p[1])
    got = rows(vocabulary.settled_merges(spark.createDataFrame([("g", *p) for p in pairs], "g string, a string, b string")), "loser", "winner")
    used, want = set(), set()
    for a, b in pairs:
        if not {a, b} & used and (a.startswith(b) or b.startswith(a)) and not (any(x.isdigit() for x in a) and any(x.isdigit() for x in b)):
            used |= {a, b}
            want.add((b, a) if (len(a), a) < (len(b), b) else (a, b))
    assert got == want


def test_merge_candidates_against_all_pairs(spark, c):
    rng = random.Random(9)
    codes = sorted({"".join(rng.choice("abé_") for _ in range(rng.randint(1, 5))) for _ in range(60)} | {"a1", "a12"})
    c2 = make(spark, books=1)
    c2.entity = spark.createDataFrame([("g", x, "", "") for x in codes], "g string, code string, etype string, name string")
    want = set()
    for i, a in enumerate(codes):
        for b in codes[i + 1 :]:
            if any(ch.isdigit() for ch in a + b) or min(len(a), len(b)) < 2:
                continue
            if ((a in b or b in a) and min(len(a), len(b)) >= 3) or (len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1):
                want.add((a, b))
    assert rows(vocabulary.entity_merge_candidates(c2), "a", "b") == want


def test_merge_candidates_broadcast_no_keys(spark, small, monkeypatch):
    c = Catalog.read(spark, small)
    want = set()
    known = {}
    for r in c.entity.select("g", "code").collect():
        known.setdefault(r["g"], []).append(r["code"])
    for g, every in known.items():
        codes = sorted(x for x in every if len(x) > 1 and not any("0" <= ch <= "9" for ch in x))
        for i, a in enumerate(codes):
            want |= {(g, a, b) for b in codes[i + 1 :] if ((a in b or b in a) and min(len(a), len(b)) > 2) or (len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1)}
    # all codebooks compared, some, none; triples sent to every worker or not
    for most, triples in ((1000, 0), (25, 10**6), (25, 0), (1, 10**6), (0, 0)):
        monkeypatch.setattr(vocabulary, "PAIRS_MAX", most, raising=False)
        monkeypatch.setattr(vocabulary, "TRIPLES_MAX", triples, raising=False)
        got = vocabulary.entity_merge_candidates(c)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "LeftAnti" not in x and "LeftSemi" not in x]
        assert sorted(tuple(r) for r in got.select("g", "a", "b").collect()) == sorted(want)


def test_premises(spark, c):
    q = spark.createDataFrame([("1", "g0", "What did Zanzibar say to Monday and Piano in May?"), ("2", "g0", "Who?"), ("3", "g0", "Zanzibar went. Then Zanzibar's aunt?")], "qid string, g string, question string")
    known = spark.createDataFrame([("g0", "piano")], "g string, stem string")
    assert rows(evidence.premise_risks(c, known, q), "qid", "subject") == {("1", "Zanzibar"), ("3", "Zanzibar")}


def test_small_evidence_pieces(spark, c):
    counts = spark.createDataFrame([("q", "g0", [("F1", "2024-01-01", "one"), ("F2", "", "two")])], "qid string, g string, members array<struct<id:string,date:string,text:string>>")
    assert rows(evidence.enumeration_basis(counts), "line") == {("1. [2024-01-01] (F1) one",), ("2. [] (F2) two",)}
    picked = spark.createDataFrame([("q", "g0", "b", "2024-01-02", "late"), ("q", "g0", "a", "2023-12-31", "early"), ("q", "g0", "c", "2024", "vague")], "qid string, g string, id string, date string, text string")
    assert rows(evidence.memories(picked), "text") == {("December 31, 2023: early\n2024: vague\nJanuary 02, 2024: late",)}
    calls = spark.createDataFrame([("q", "plan", 5, False), ("q", "plan", 6, False), ("q", "cached", 3, True)], "qid string, channel string, tokens long, subset boolean")
    assert rows(evidence.token_ledger(calls), "channel", "calls", "tokens") == {("plan", 2, 11), ("cached", 1, 3), (None, 2, 11)}
    said = c.line.where("who <> ''").orderBy("id").limit(2).select(F.lit("q").alias("qid"), "g", "id", F.lit(1.0).alias("score"))
    assert evidence.attribution(c, said).count() == 1


def test_sampling_is_stable(spark):
    q = spark.createDataFrame([(f"q{i:02d}" + ("_abs" if i % 7 == 0 else ""), f"t{i % 3}") for i in range(40)], "question_id string, question_type string")
    a, b = rows(metrics.stratified(q, 12), "question_id"), rows(metrics.stratified(q.orderBy(F.desc("question_id")), 12), "question_id")
    assert a == b and len(a) == 12 and any(x[0].endswith("_abs") for x in a)
    df = spark.createDataFrame([(["s1F3", "s1L2", "s2:4", "s2"],)], "ids array<string>")
    assert df.select(metrics.pack_units(F.col("ids"))).first()[0] == ["s1", "s2"]
    assert spark.createDataFrame([(3, "a; b"), (1, "a; b")], "k int, v string").select(metrics.gold_answer(F.col("k"), F.col("v"))).collect() == [("a",), ("a; b",)]


def test_writing_the_vocabulary(spark):
    c = small_catalog(spark)
    told = spark.createDataFrame([("g", "u", 1, "New A", "root"), ("g", "u", 2, "new_a", "root"), ("g", "u", 3, "b", "nowhere"), ("g", "u", 4, "new b", "Root"), ("g", "u", 5, "root", "x"), ("g", "u", 6, "new_c", "root"), ("g", "u", 7, "", "root")], "g string, unit string, seq int, code string, parent string")
    got = {r["seq"]: (r["code"], r["outcome"]) for r in vocabulary.admission(c, told, k=2).collect()}
    assert got == {1: ("new_a", "admitted"), 2: ("new_a", "touched"), 3: ("b", "rejected"), 4: ("new_b", "admitted"), 5: ("root", "touched"), 6: ("new_c", "folded"), 7: ("", "rejected")}
    roots = vocabulary.define_roots(c, spark.createDataFrame([("g", "Second Root"), ("g", "root")], "g string, code string"))
    assert {r["code"] for r in roots.collect()} == {"root", "second_root"}
    alias = spark.createDataFrame([("g", "The Boss", "ann"), ("g", "boss", "ann"), ("g", "boss", "bob"), ("g", "bob", "ann"), ("g", "x", "gone")], "g string, surface string, code string")
    assert {(r["surface"], r["code"]) for r in vocabulary.aliased(c, alias, c.entity).collect()} == {("the_boss", "ann")}
    entity, moved = vocabulary.merge_entities(c, spark.createDataFrame([("g", "bob", "ann")], "g string, loser string, winner string"))
    assert {r["code"] for r in entity.collect()} == {"ann"} and {(r["surface"], r["code"]) for r in moved.collect()} == {("bob", "ann"), ("bobby", "ann")}
    rels = spark.createDataFrame([("g", "Ann", "knows", "bobby"), ("g", "ann", "is", "ann"), ("g", "ann", "knows", "gone")], "g string, src string, rel string, dst string")
    assert {tuple(r) for r in vocabulary.relate(c, rels).collect()} == {("g", "ann", "knows", "bob")}


def small_catalog(spark):
    topic = spark.createDataFrame([("g", "root", None, "canonical", "")], "codebook_id string, code string, parents array<string>, status string, born string")
    entity = spark.createDataFrame([("g", "ann", "person", "Ann", None), ("g", "bob", "person", "Bob", ["bobby"])], "codebook_id string, code string, etype string, name string, aliases array<string>")
    one = lambda schema: spark.createDataFrame([], schema)
    fact = one("codebook_id string, id string, unit string, unit_date string, t string, kind string, who string, conf string, topics array<string>, entities array<string>, src array<string>, obj array<string>, place array<string>, event array<string>, dur string, text string")
    line = one("codebook_id string, id string, unit string, unit_date string, pos int, who string, text string")
    unit = one("codebook_id string, id string, date string, t string, title string, dur_min int, n_lines int")
    return Catalog.of(fact, line, unit, topic, entity, spark.createDataFrame([("g", "ann")], "codebook_id string, speakers string"))
