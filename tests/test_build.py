"""What a language model is asked, with scripted answers."""

import json
import os

import pytest
from pyspark.sql import functions as F

from engramma.build import Cached, aligned_instances, best_plan, consolidated_entities, consolidated_topics
from engramma.catalog import Catalog
from engramma.memory import ProviderFault, Scripted
from engramma.operators.evidence import summary
from tests.test_matching import make

EMPTY = {"queries": [{"where": {"units": ["nowhere"]}}]}
FULL = {"queries": [{"where": {"kind": ["plan", "event", "risk"]}}]}


def test_the_best_plan_is_chosen_by_its_rows(spark):
    c = make(spark, books=1)
    p = Scripted([json.dumps(EMPTY), "nonsense", json.dumps(FULL)])
    assert best_plan(c, "q", p).to_dict() == {**FULL, "intent": "factual", "queries": [{"select": "facts", "where": FULL["queries"][0]["where"], "pipe": []}]}
    p = Scripted([json.dumps(EMPTY), json.dumps(FULL)])
    assert best_plan(c, "q", p, candidates=1).queries[0].where.kind and "found nothing" in p.prompts[1]
    assert best_plan(c, "q", Scripted(["{}", "no"]), candidates=2) is None


def test_answers_are_kept(tmp_path):
    p = Scripted(["one", "two", "three"])
    c = Cached(p, str(tmp_path), "m")
    assert c.complete("x") == c.complete("x") == "one" and c.complete("y") == "two" and len(p.prompts) == 2
    for f in tmp_path.iterdir():
        f.write_text("broken")
    assert c.complete("x") == "three" and not [f for f in os.listdir(tmp_path) if f.endswith(".part")]
    with pytest.raises(ProviderFault):
        c.complete("z")


def test_merges_by_rule_and_by_vote(spark):
    c = make(spark, books=1)
    c.topic = spark.createDataFrame([("g0", x, "candidate", "") for x in ("trip", "trip_two", "walk", "hike")] + [("g0", "root", "canonical", "")], "g string, code string, status string, born string")
    c.edge = spark.createDataFrame([("g0", "root", x) for x in ("trip", "trip_two", "walk", "hike")], "g string, parent string, child string")
    c.fact = c.fact.withColumn("topics", F.array(F.lit("walk"), F.lit("hike")))
    c.fact = c.fact.withColumn("unit", F.concat("unit", (F.hash("id") % 2).cast("string")))
    merged = lambda p: {(r["loser"], r["winner"]) for r in consolidated_topics(spark, c, "g0", p).collect()}
    assert merged(None) == {("trip_two", "trip")}
    assert merged(Scripted(['{"same": [0]}', '{"same": "?"}', '{"same": [0, 7, "x"]}'])) == {("trip_two", "trip"), ("walk", "hike")}
    assert merged(Scripted(['{"same": [0]}', "broken"])) == {("trip_two", "trip")}
    pairs = spark.createDataFrame([("g0", "ann", "anna"), ("g0", "anna", "annas")], "g string, a string, b string")
    assert [tuple(r) for r in consolidated_entities(spark, pairs, "g0", Scripted(['{"same": [0, 1]}'] * 3)).collect()] == [("g0", "ann", "anna")]


def test_instances(spark):
    c = make(spark, books=1, n=2)
    c.fact = spark.createDataFrame([("g0", f"F{i}", f"u{i}", "event", "the marathon again", f"2024-0{i}-01") for i in range(1, 4)], "g string, id string, unit string, kind string, text string, eff string")
    reply = {"instances": [{"label": "Marathon", "kind": "event", "mentions": ["F3", "F1", "zz"]}, {"label": "within", "mentions": ["F1"]}, {"label": " ", "mentions": ["F1", "F2"]}, 5]}
    rows = [tuple(r) for r in aligned_instances(spark, c, "g0", Scripted([json.dumps(reply)])).collect()]
    assert rows == [("g0", "i1", "Marathon", "event", "2024-01-01", ["F1", "F3"])]
    assert aligned_instances(spark, c, "none", Scripted([])).count() == 0


def test_saved_catalogs(spark, tmp_path):
    c = make(spark, books=2)
    c.save(str(tmp_path / "c"))
    back = Catalog.open(spark, str(tmp_path / "c"))
    assert sorted(map(tuple, summary(back).collect())) == sorted(map(tuple, summary(c).collect()))
