"""Codebook XML, JSON lines, and the stream of lines."""

import json
import os

import pytest

from engramma.operators import evidence
from engramma.sources import codebook_xml, jsonl
from engramma.streaming.ingest import activity, ingest_lines, line_stream

DOC = """<?xml version="1.0" encoding="utf-8"?>
<codebook id="demo" speakers="ann bob">
  <vocab>
    <topic code="travel" status="canonical" parents="" born=""/>
    <topic code="trip" status="candidate" parents="travel gone" born="s1"><alias>outing</alias><alias>tour</alias><use unit="s1" bucket="2026-01"/></topic>
    <entity code="kyoto" type="place" name="Kyoto" unknown="x"><alias>Kioto</alias><rel type="in" to="japan"/></entity>
  </vocab>
  <timeline>
    <session id="s1" date="2026-01-10" t="2026-01-10T09:00" title="One" dur="5m">
      <fact id="s1F1" t="2026-04" kind="plan" who="ann" conf="high" topics="trip" entities="kyoto" src="s1L1 s1L9" obj="a b">Ann plans a trip &amp; more.</fact>
      <line id="s1L1" who="ann">I will visit.</line>
      <line id="s1L2" who="bob">Fine.</line>
    </session>
    <conv id="s2" date="2026-13-01" title="Two"><line id="s2L1" who="bob">Only line</line></conv>
  </timeline>
  <instances><instance id="i1" label="trip" kind="event" t="" mentions="s1F1 nope"/></instances>
</codebook>
"""


@pytest.fixture
def doc(tmp_path):
    path = tmp_path / "demo.xml"
    path.write_text(DOC)
    return str(path)


def rows(df, *cols):
    return {tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.select(*cols).collect()}


def test_reading(spark, doc):
    t = codebook_xml.read(spark, doc)
    assert rows(t["fact"], "codebook_id", "id", "unit", "unit_date", "t", "topics", "src", "obj", "place", "text") == {("demo", "s1F1", "s1", "2026-01-10", "2026-04", ("trip",), ("s1L1", "s1L9"), ("a", "b"), (), "Ann plans a trip & more.")}
    assert rows(t["line"], "id", "unit", "pos", "who", "text") == {("s1L1", "s1", 1, "ann", "I will visit."), ("s1L2", "s1", 2, "bob", "Fine."), ("s2L1", "s2", 1, "bob", "Only line")}
    assert rows(t["unit"], "id", "date", "dur_min", "n_lines") == {("s1", "2026-01-10", 5, 2), ("s2", "2026-13-01", None, 1)}
    assert rows(t["topic"], "code", "parents", "born") == {("travel", (), ""), ("trip", ("travel", "gone"), "s1")}
    assert rows(t["topic_alias"], "surface", "code") == {("outing", "trip"), ("tour", "trip")} and rows(t["topic_usage"], "code", "unit", "bucket") == {("trip", "s1", "2026-01")}
    assert rows(t["entity"], "code", "etype", "aliases") == {("kyoto", "place", ("Kioto",))} and rows(t["entity_rel"], "src", "rel", "dst") == {("kyoto", "in", "japan")}
    assert rows(t["instance"], "id", "mentions") == {("i1", ("s1F1", "nope"))}
    assert rows(codebook_xml.problems(t), "problem", "id", "other") == {("bad session date", "s2", "2026-13-01"), ("dangling source", "s1F1", "s1L9"), ("dangling mention", "i1", "nope")}


def test_sessions_round_trip(spark, doc, tmp_path):
    c = codebook_xml.catalog(codebook_xml.read(spark, doc))
    out = str(tmp_path / "shards")
    codebook_xml.write_sessions(c, out)
    back = codebook_xml.read_sessions(spark, out).collect()
    assert {(r["g"], r["_id"], r["_date"]) for r in back} == {("demo", "s1", "2026-01-10"), ("demo", "s2", "2026-13-01")}
    s1 = next(r for r in back if r["_id"] == "s1")
    assert [(x["_id"], x["_VALUE"]) for x in s1["line"]] == [("s1L1", "I will visit."), ("s1L2", "Fine.")]
    assert [(x["_id"], x["_topics"], x["_src"], x["_VALUE"]) for x in s1["fact"]] == [("s1F1", "trip", "s1L1 s1L9", "Ann plans a trip & more.")]
    with pytest.raises(Exception, match="exists"):
        codebook_xml.write_sessions(c, out)


def test_hydration_leaves_dangling_sources_out(spark, doc):
    h = evidence.hydrated(codebook_xml.catalog(codebook_xml.read(spark, doc))).collect()[0]
    assert h["n_sources"] == 2 and [s["id"] for s in h["sources"]] == ["s1L1"]


def test_json_lines_survive_a_cut_line(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text('{"id": 1, "ok": true}\n\n{"id": 2, "ok": fal')
    good, bad = jsonl.read(spark, str(path), "id long, ok boolean")
    assert [tuple(r) for r in good.collect()] == [(1, True)] and [r["value"] for r in bad.collect()] == ['{"id": 2, "ok": fal']
    work = spark.createDataFrame([(1,), (2,)], "id long")
    assert [r["id"] for r in jsonl.todo(work, good, ["id"]).collect()] == [2]
    jsonl.append(spark.createDataFrame([(3, True)], "id long, ok boolean"), str(tmp_path / "out"))
    assert jsonl.read(spark, str(tmp_path / "out"), "id long, ok boolean")[0].count() == 1


def test_the_stream_takes_each_line_once(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "lines")
    source.mkdir()

    def deliver(name, *items):
        (source / name).write_text("\n".join(json.dumps({"codebook_id": "c", "id": i, "unit": "u", "pos": 1, "text": i, "loaded_at": t}) for i, t in items))

    def run():
        ingest_lines(spark, str(source), target, str(tmp_path / "state")).awaitTermination(120)
        return sorted(r["id"] for r in spark.read.parquet(target).collect())

    deliver("1.json", ("a", "2024-01-01T00:00:00Z"), ("b", "2024-01-01T00:00:00Z"), ("a", "2024-01-02T00:00:00Z"))
    assert run() == ["a", "b"]
    deliver("2.json", ("b", "2024-03-01T00:00:00Z"), ("c", "2023-01-01T00:00:00Z"), ("d", "2024-03-01T00:00:00Z"))
    assert run() == ["a", "b", "d"] or run() == ["a", "b", "c", "d"]
    assert run() == sorted(r["id"] for r in spark.read.parquet(target).collect())
    assert activity(line_stream(spark, str(source))).isStreaming and os.path.isdir(target)


def test_the_stream_takes_late_lines(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "lines")
    source.mkdir()

    def run(name, *items):
        (source / name).write_text("\n".join(json.dumps({"codebook_id": "c", "id": i, "unit": "u", "pos": 1, "text": i, "loaded_at": t}) for i, t in items))
        ingest_lines(spark, str(source), target, str(tmp_path / "state")).awaitTermination(120)
        return sorted(r["id"] for r in spark.read.parquet(target).collect())

    assert run("1.json", ("a", "2024-01-01T00:00:00Z")) == ["a"]
    assert run("2.json", ("b", "2024-03-01T00:00:00Z"), ("c", "2023-01-01T00:00:00Z")) == ["a", "b", "c"]
    # the watermark of the second run stands above these, which are a year and more behind it
    assert run("3.json", ("d", "2021-01-01T00:00:00Z"), ("c", "2023-02-01T00:00:00Z"), ("e", None)) == ["a", "b", "c", "d", "e"]
