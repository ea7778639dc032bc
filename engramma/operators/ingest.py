"""Normalising and checking what comes in: extracted facts, repeated and conflicting records, dangling references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramma.catalog import Catalog
from engramma.functions.symbols import norm_code

FACET_MOST, TOPICS_MOST, ENTITIES_MOST = 4, 3, 5


def facet_codes(values: Column) -> Column:
    """Codes of facet labels in the singular, each once, four at most; blanks are dropped, an absent list is empty."""
    codes = F.transform(F.coalesce(values, F.array().cast("array<string>")), norm_code)
    ies = lambda c: F.concat(F.substring(c, F.lit(1), F.length(c) - 3), F.lit("y"))
    single = lambda c: F.when(F.endswith(c, F.lit("ies")) & (F.length(c) > 3), ies(c)).when(F.endswith(c, F.lit("s")) & ~F.endswith(c, F.lit("ss")) & (F.length(c) > 3), F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)
    return F.slice(F.array_distinct(F.filter(F.transform(codes, single), lambda c: c.isNotNull() & (c != ""))), 1, FACET_MOST)


def duration(value: Column) -> Column:
    """An ISO duration of years, months, weeks and days in capitals, else the empty string."""
    up = F.upper(F.trim(value))
    return F.when(up.rlike(r"^P(?=\d)(\d+Y)?(\d+M)?(\d+W)?(\d+D)?$"), up).otherwise("")


def normalised_facts(raw: DataFrame, c: Catalog, kinds: list[str], events: list[str]) -> DataFrame:
    """Extracted facts (g, unit, content, kind, who, t, conf, topics, entities, src, object, place, event, duration) as records.

    Unknown kinds become other, unknown confidences med; topics and entities are resolved, unknown topics dropped; sources
    that are no lines of the unit are dropped, and facts without text or source with them.
    """
    from engramma.catalog import fact_time

    rows = raw.withColumn("rid", F.monotonically_increasing_id())
    own = c.line.select("g", "unit", F.col("id").alias("s"))
    src = rows.select("rid", "g", "unit", F.posexplode(F.coalesce("src", F.array().cast("array<string>"))).alias("i", "s")).join(own, ["g", "unit", "s"]).groupBy("rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("src"))
    live = c.topic.where("status <> 'deprecated'").select("g", F.col("code").alias("x"))
    topics = rows.select("rid", "g", F.posexplode(F.coalesce("topics", F.array().cast("array<string>"))).alias("i", "x")).withColumn("x", norm_code("x")).join(live, ["g", "x"], "left_semi").groupBy("rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda t: t["x"]).alias("topics"))
    out = rows.drop("src", "topics").join(src, "rid").join(topics, "rid", "left").where("content is not null and trim(content) <> ''")
    none = F.array().cast("array<string>")
    return out.select(
        "g", "unit", F.trim("content").alias("text"), F.when(norm_code("kind").isin(kinds), norm_code("kind")).otherwise("other").alias("kind"), F.lower(F.coalesce("who", F.lit(""))).alias("who"),
        fact_time(F.coalesce("t", F.lit(""))).alias("t"), F.when(F.col("conf").isin("low", "med", "high"), F.col("conf")).otherwise("med").alias("conf"), F.slice(F.array_distinct(F.coalesce("topics", none)), 1, TOPICS_MOST).alias("topics"),
        F.slice(F.array_distinct(F.filter(F.transform(F.coalesce("entities", none), norm_code), lambda e: e.isNotNull() & (e != ""))), 1, ENTITIES_MOST).alias("entities"), F.array_distinct("src").alias("src"),
        facet_codes(F.col("object")).alias("obj"), facet_codes(F.col("place")).alias("place"), F.filter(facet_codes(F.col("event")), lambda e: e.isin(events)).alias("event"), duration(F.coalesce("duration", F.lit(""))).alias("dur"),
    )


def conflicts(records: DataFrame, keys: list[str], ignore: tuple[str, ...] = ("loaded_at",)) -> DataFrame:
    """(keys, versions): keys under which records differ in anything but the ignored columns. Equal records are no conflict."""
    rest = [c for c in records.columns if c not in keys and c not in ignore]
    # as text: a hash of columns would take an absent list for an empty one
    whole = F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in keys + rest])))
    return records.groupBy(*keys).agg(F.countDistinct(whole).alias("versions")).where("versions > 1")


def merged(shards: list[DataFrame], keys: list[str], ignore: tuple[str, ...] = ("loaded_at",)) -> DataFrame:
    """The idempotent union of shards of one record type: equal records count once.

    Raises ValueError where one key has different records.
    """
    union = reduce(DataFrame.unionByName, shards)
    bad = conflicts(union, keys, ignore).limit(3).collect()
    if bad:
        raise ValueError(f"different records under one key: {[tuple(r)[:-1] for r in bad]}")
    return union.dropDuplicates(keys)


def dangling_sources(c: Catalog) -> DataFrame:
    """(g, id, line): sources of facts that are no lines of their codebook."""
    return c.fact.select("g", "id", F.explode("src").alias("line")).distinct().join(c.line.select("g", F.col("id").alias("line")), ["g", "line"], "left_anti").select("g", "id", "line")


def undeclared(c: Catalog) -> DataFrame:
    """(g, axis, code, n_facts): topic and entity codes of facts that the vocabulary does not have."""
    t = c.posting("topics").join(c.topic.select("g", "code"), ["g", "code"], "left_anti").withColumn("axis", F.lit("topics"))
    e = c.posting("entities").join(c.entity.select("g", "code"), ["g", "code"], "left_anti").withColumn("axis", F.lit("entities"))
    return t.unionByName(e).groupBy("g", "axis", "code").agg(F.count("*").alias("n_facts"))


def fingerprint(df: DataFrame, by: str = "g") -> DataFrame:
    """(g, n, digest): a digest of all rows of a codebook that does not depend on their order.

    Row digests are added up in 60-bit parts, so no list of a codebook is ever gathered.
    """
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])), 256)
    parts = [F.conv(F.substring(row, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)") for i in range(3)]
    sums = df.withColumns({f"_p{i}": p for i, p in enumerate(parts)}).groupBy(by).agg(F.count("*").alias("n"), *[F.sum(f"_p{i}").cast("string").alias(f"_p{i}") for i in range(3)])
    return sums.select(by, "n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), "_p0", "_p1", "_p2"), 256).alias("digest"))
