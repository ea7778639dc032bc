"""Codebooks as XML: one document a codebook, or many shards of sessions; read into the canonical tables and written back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramma.catalog import Catalog

_FACT = "struct<_id:string,_t:string,_kind:string,_who:string,_conf:string,_topics:string,_entities:string,_src:string,_obj:string,_place:string,_event:string,_dur:string,_VALUE:string>"
_LINE = "struct<_id:string,_who:string,_t:string,_VALUE:string>"
_SESSION = f"struct<_id:string,_date:string,_t:string,_title:string,_dur:string,fact:array<{_FACT}>,line:array<{_LINE}>>"
_TEXT = "struct<_VALUE:string>"
_TOPIC = "struct<_code:string,_status:string,_parents:string,_born:string,alias:array<string>,use:array<struct<_unit:string,_bucket:string,_VALUE:string>>,_VALUE:string>"
_ENTITY = "struct<_code:string,_type:string,_name:string,alias:array<string>,rel:array<struct<_type:string,_to:string,_VALUE:string>>,_VALUE:string>"
#: The schema is given: inference would turn dates into dates and single children into no arrays.
SCHEMA = f"_id string, _speakers string, vocab struct<topic:array<{_TOPIC}>,entity:array<{_ENTITY}>>, timeline struct<session:array<{_SESSION}>,conv:array<{_SESSION}>>, instances struct<instance:array<struct<_id:string,_label:string,_kind:string,_t:string,_mentions:string,_VALUE:string>>>"


def _codes(c: str) -> F.Column:
    return F.filter(F.split(F.trim(F.coalesce(F.col(c), F.lit(""))), r"\s+"), lambda x: x != "")


def read(spark: SparkSession, paths: str | list[str]) -> dict[str, DataFrame]:
    """The tables of codebook documents: codebook, unit, line, fact, topic, entity, topic_alias, topic_usage, entity_rel and
    instance. A document that is no codebook gives no rows; attributes that are not known are left out."""
    root = spark.read.format("xml").option("rowTag", "codebook").schema(SCHEMA).load(paths).withColumn("codebook_id", F.coalesce("_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.xml)?$", 1)))
    g = F.col("codebook_id")
    both = F.concat(F.coalesce("timeline.session", F.array().cast(f"array<{_SESSION}>")), F.coalesce("timeline.conv", F.array().cast(f"array<{_SESSION}>")))
    s = root.select(g, F.explode(both).alias("s")).select("codebook_id", "s.*")
    head = [F.col("codebook_id"), F.col("_id").alias("unit"), F.col("_date").alias("unit_date")]
    minutes = F.regexp_extract(F.coalesce("_dur", F.lit("")), r"(\d+)", 1).try_cast("int")
    unit = s.select("codebook_id", F.col("_id").alias("id"), F.col("_date").alias("date"), F.col("_t").alias("t"), F.col("_title").alias("title"), minutes.alias("dur_min"), F.size(F.coalesce("line", F.array().cast(f"array<{_LINE}>"))).alias("n_lines"))
    line = s.select(*head, F.posexplode("line").alias("p", "l")).select("codebook_id", F.col("l._id").alias("id"), "unit", "unit_date", (F.col("p") + 1).alias("pos"), F.col("l._who").alias("who"), F.trim("l._VALUE").alias("text"))
    f = s.select(*head, F.explode("fact").alias("f")).select("codebook_id", "unit", "unit_date", "f.*")
    fact = f.select(
        "codebook_id", F.col("_id").alias("id"), "unit", "unit_date", F.col("_t").alias("t"), F.col("_kind").alias("kind"), F.col("_who").alias("who"), F.col("_conf").alias("conf"),
        *[_codes(f"_{c}").alias(c) for c in ("topics", "entities", "src", "obj", "place", "event")], F.col("_dur").alias("dur"), F.trim("_VALUE").alias("text"),
    )
    t = root.select(g, F.explode("vocab.topic").alias("t")).select("codebook_id", "t.*")
    e = root.select(g, F.explode("vocab.entity").alias("e")).select("codebook_id", "e.*")
    return {
        "codebook": root.select(g, F.col("_speakers").alias("speakers"), F.lit(None).cast("string").alias("home_tz")),
        "unit": unit, "line": line, "fact": fact,
        "topic": t.select("codebook_id", F.col("_code").alias("code"), _codes("_parents").alias("parents"), F.col("_status").alias("status"), F.col("_born").alias("born")),
        "topic_alias": t.select(F.col("codebook_id").alias("g"), F.explode("alias").alias("surface"), F.col("_code").alias("code")),
        "topic_usage": t.select(F.col("codebook_id").alias("g"), F.explode("use").alias("u"), F.col("_code").alias("code")).select("g", "code", F.col("u._unit").alias("unit"), F.col("u._bucket").alias("bucket")),
        "entity": e.select("codebook_id", F.col("_code").alias("code"), F.col("_type").alias("etype"), F.col("_name").alias("name"), F.col("alias").alias("aliases")),
        "entity_rel": e.select(F.col("codebook_id").alias("g"), F.col("_code").alias("src"), F.explode("rel").alias("r")).select("g", "src", F.col("r._type").alias("rel"), F.col("r._to").alias("dst")),
        "instance": root.select(F.col("codebook_id").alias("g"), F.explode("instances.instance").alias("i")).select("g", F.col("i._id").alias("id"), F.col("i._label").alias("label"), F.col("i._kind").alias("kind"), F.col("i._t").alias("t"), F.split("i._mentions", r"\s+").alias("mentions")),
    }


def catalog(tables: dict[str, DataFrame]) -> Catalog:
    return Catalog.of(*(tables[n] for n in ("fact", "line", "unit", "topic", "entity", "codebook")))


def problems(tables: dict[str, DataFrame], strict: bool = False) -> DataFrame:
    """(g, problem, id, other): what makes codebooks unloadable: blank ids, bad dates, dangling sources and mentions,
    different records under one id; if strict, undeclared codes and event times that are none, too."""
    from engramma.catalog import fact_time
    from engramma.operators.ingest import conflicts

    c = catalog(tables)
    out = c.unit.where(~F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$") | F.try_to_date("date", "yyyy-MM-dd").isNull()).select("g", F.lit("bad session date").alias("problem"), "id", F.col("date").alias("other"))
    for df in (c.fact, c.line, c.unit):
        out = out.unionByName(df.where("trim(coalesce(id, '')) = ''").select("g", F.lit("blank id").alias("problem"), F.coalesce("id", F.lit("")).alias("id"), F.lit("").alias("other")))
    src = c.fact.select("g", "id", F.explode("src").alias("other")).join(c.line.select("g", F.col("id").alias("other")), ["g", "other"], "left_anti")
    out = out.unionByName(src.select("g", F.lit("dangling source").alias("problem"), "id", "other"))
    told = tables["instance"].select("g", "id", F.explode("mentions").alias("other")).where("other <> ''").join(c.fact.select("g", F.col("id").alias("other")), ["g", "other"], "left_anti")
    out = out.unionByName(told.select("g", F.lit("dangling mention").alias("problem"), "id", "other"))
    for name in ("unit", "line", "fact"):
        out = out.unionByName(conflicts(tables[name], ["codebook_id", "id"], ()).select(F.col("codebook_id").alias("g"), F.lit(f"different {name} records").alias("problem"), "id", F.col("versions").cast("string").alias("other")))
    if strict:
        from engramma.operators.ingest import undeclared

        out = out.unionByName(undeclared(c).select("g", F.concat(F.lit("undeclared "), "axis").alias("problem"), F.col("code").alias("id"), F.lit("").alias("other")))
        raw = tables["fact"].where("coalesce(t, '') <> ''")
        out = out.unionByName(raw.where(fact_time(F.col("t")) == "").select(F.col("codebook_id").alias("g"), F.lit("bad event time").alias("problem"), "id", F.col("t").alias("other")))
    return out


def write_sessions(c: Catalog, path: str) -> None:
    """Sessions as XML, a row a session, in files by codebook (``g=...``): shards that :func:`read_sessions` reads back.

    Control characters that XML cannot hold are taken out. Rows of one session are gathered, never those of a codebook.
    """
    clean = lambda col: F.regexp_replace(col, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")
    codes = lambda n: F.array_join(n, " ").alias(f"_{n}")
    fact = F.struct(F.col("id").alias("_id"), F.col("t").alias("_t"), F.col("kind").alias("_kind"), F.col("who").alias("_who"), F.col("conf").alias("_conf"), *[codes(n) for n in ("topics", "entities", "src", "obj", "place", "event")], F.col("dur").alias("_dur"), clean(F.col("text")).alias("_VALUE"))
    facts = c.fact.groupBy("g", F.col("unit").alias("id")).agg(F.sort_array(F.collect_list(fact)).alias("fact"))
    lines = c.line.groupBy("g", F.col("unit").alias("id")).agg(F.array_sort(F.collect_list(F.struct("pos", F.struct(F.col("id").alias("_id"), F.col("who").alias("_who"), clean(F.col("text")).alias("_VALUE")).alias("l")))).alias("ls"))
    rows = c.unit.join(facts, ["g", "id"], "left").join(lines, ["g", "id"], "left")
    out = rows.select("g", F.col("id").alias("_id"), F.col("date").alias("_date"), F.col("t").alias("_t"), clean(F.col("title")).alias("_title"), F.concat(F.col("dur_min").cast("string"), F.lit("m")).alias("_dur"), "fact", F.transform("ls", lambda x: x["l"]).alias("line"))
    out.write.format("xml").option("rowTag", "session").option("rootTag", "timeline").partitionBy("g").mode("errorifexists").save(path)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """(g, _id, _date, ..., fact, line): sessions written by :func:`write_sessions`."""
    flat = _SESSION.removeprefix("struct<").removesuffix(">")
    schema = spark.createDataFrame([], f"s struct<{flat}>").select("s.*").schema.add("g", "string")
    return spark.read.format("xml").option("rowTag", "session").schema(schema).load(path)
