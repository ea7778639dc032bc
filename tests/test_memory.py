"""The application's view, with a scripted provider."""

import json
import shutil

import pytest

from engramma.memory import ConfigurationFault, Memory, ProviderFault, Scripted, StorageFault, salvaged

EXTRACTED = {"facts": [{"content": "Ann bought a kettle.", "kind": "event", "who": "Ann", "t": "2024-02-30", "conf": "sure", "topics": ["nothing"], "entities": ["The Kettle"], "src": ["sNewL1", "sNewL9"], "facets": {"object": ["Kettles", "Glasses"], "event": ["purchase", "magic"], "duration": "p2w"}}, {"content": "no source", "src": []}, {"content": " ", "src": ["sNewL1"]}, "junk"]}


@pytest.fixture
def store(small, tmp_path):
    shutil.copytree(small, tmp_path / "m")
    (tmp_path / "m").chmod(0o755)  # the copy of a read-only folder is read-only too
    for p in (tmp_path / "m").iterdir():  # tables are folders where they are appended to
        if p.is_file() and p.name in ("line.parquet", "fact.parquet", "unit.parquet"):
            p.chmod(0o644)
            p.rename(p.with_suffix(".tmp"))
            p.mkdir()
            p.with_suffix(".tmp").rename(p / "part-0.parquet")
    return str(tmp_path / "m")


def test_remembering(spark, store):
    provider = Scripted([json.dumps(EXTRACTED)])
    m = Memory.load(spark, store, "cb-commons", provider)
    before = m.summary()
    facts = m.remember([{"role": "Ann", "content": "I bought a blue kettle at the xylotheque."}, ("bob", "Fine.")], session_id="sNew", day="2024-03-01", title="t")
    assert [(f["id"], f["kind"], f["t"], f["conf"], f["obj"], f["event"], f["dur"], f["src"], f["topics"], f["entities"]) for f in facts] == [("sNewF1", "event", "", "med", ["kettle", "glasse"], ["purchase"], "P2W", ["sNewL1"], [], ["the_kettle"])]
    after = m.summary()
    assert (after["n_facts"], after["n_lines"], after["n_units"]) == (before["n_facts"] + 1, before["n_lines"] + 2, before["n_units"] + 1)
    with pytest.raises(StorageFault, match="sNew"):
        m.remember([("a", "b")], session_id="sNew")
    provider.answers = ["{}", '{"answer": "A kettle.", "citations": ["sNewF1", "sNewL1", "elsewhere", "sNewF1"]}']
    a = m.answer("Who bought a kettle?", limit=3)
    assert a.text == "A kettle." and a.citations == ("sNewF1", "sNewL1") and a.evidence[0]["id"] == "sNewF1"


def test_recall_and_plans(spark, small):
    m = Memory.load(spark, small, "cb-commons")
    known = m.catalog.fact.orderBy("id").first()
    rows = m.recall(known["text"], limit=5)
    assert known["id"] in [r["id"] for r in rows]
    assert 0 < len(rows) <= 5 and all({"id", "text", "sources"} <= r.keys() for r in rows)
    got = m.execute({"queries": [{"where": {"kind": ["plan"]}}]}, budget=4, unit_cap=1)
    assert len(got) <= 4 and len({r["unit"] for r in got}) == len(got)


def test_plans_resolve_against_the_whole_vocabulary(spark, small):
    m = Memory.load(spark, small, "cb-commons", Scripted([]))
    topics = [("cb-commons", f"topic_{i:03}", "canonical", "") for i in range(320)]
    m.catalog.topic = spark.createDataFrame(topics, "g string, code string, status string, born string")
    m.catalog.entity = spark.createDataFrame([("cb-commons", "the_kettle", "product", "Kettle")], "g string, code string, etype string, name string")
    m.catalog.alias = spark.createDataFrame([("cb-commons", "boiler", "the_kettle")], "g string, surface string, code string")

    def grep(**where):
        m.provider.answers = [json.dumps({"queries": [{"where": where, "pipe": [{"op": "head", "n": 1}]}]})]
        return m.plan("Which kettle came first?").queries[0].where.grep

    assert grep(topics=["topic_001"]) == grep(topics=["topic_319"]) == grep(topics=["Topic 319", "gone"]) == ""
    assert grep(entities=["the_kettle"]) == grep(entities=["Boiler"]) == ""
    assert grep(topics=["the_kettle"]) == grep(entities=["topic_319"]) == grep() == "came|first|kettle|which"


def test_faults(spark, small):
    m = Memory.load(spark, small, "cb-commons", Scripted(["not json"]))
    with pytest.raises(ConfigurationFault):
        m.recall(" ")
    for bad in ("text", [], [("a", "")], [{"role": "a"}], [("a", "b\x07")]):
        with pytest.raises(ConfigurationFault):
            m.session(bad)
    for sid, day in (("bad id", "2024-01-01"), ("ok", "2024-02-30")):
        with pytest.raises(ConfigurationFault):
            m.session([("a", "b")], sid, day)
    with pytest.raises(ProviderFault):
        m.remember([("a", "b")], session_id="x")
    with pytest.raises(StorageFault):
        Memory.load(spark, "/nowhere", "c")
    with pytest.raises(ConfigurationFault):
        Memory.load(spark, "", "c")


def test_salvage():
    assert salvaged('so: {"a": {"b": "}"}} end') == {"a": {"b": "}"}} and salvaged('{bad} {"c": 1}') == {"c": 1}
    with pytest.raises(ProviderFault):
        salvaged("{")
