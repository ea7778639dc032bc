"""Problem 2 as an operator over tables: every dated value of the memory tables in one unambiguous form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramma.functions.moments import moment_parts, with_moment


def normalise_moments(values: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """Normalise rows of (field, rec_id, item_key, source_id, value).

    ``zones`` has (source_id, home_tz): the default zone of a source; unknown sources and null zones count as UTC.
    Result: distinct (field, rec_id, item_key, norm_value). Values that denote no date or time, nulls and blanks among
    them, give no row; an empty table gives an empty result; ``source_id`` may be null.
    """
    # explode drops the nulls; a filter would be pushed below and have the long expression made twice
    parsed = values.select("field", "rec_id", "item_key", "source_id", F.explode(F.array_compact(F.array(moment_parts("value")))).alias("parts"))
    # one exchange by record serves the removal of repeats, too; it also keeps the cascade and the rest apart, each small enough to compile
    parsed = parsed.repartition("rec_id")
    if zones is None:
        parsed = parsed.withColumn("home_tz", F.lit(None).cast("string"))
    else:
        homes = zones.groupBy("source_id").agg(F.min("home_tz").alias("home_tz"))
        parsed = parsed.join(homes, "source_id", "left")
    out = with_moment(parsed, "parts", "home_tz", "norm_value")
    return out.select("field", "rec_id", "item_key", F.explode(F.array_compact(F.array("norm_value"))).alias("norm_value")).distinct()


def memory_moments(fact: DataFrame, locomo: DataFrame, longmem: DataFrame) -> DataFrame:
    """The dated values of the three memory tables as (field, rec_id, item_key, source_id, value)."""
    none = F.lit("")
    facts = fact.select(F.lit("fact.t").alias("field"), F.col("id").alias("rec_id"), none.alias("item_key"), F.col("codebook_id").alias("source_id"), F.col("t").alias("value"))
    talk = locomo.select("sample_id", F.from_json("record", "conversation map<string,string>").alias("r")).select("sample_id", F.explode("r.conversation").alias("key", "value"))
    sessions = talk.where(F.col("key").rlike(r"^session_\d+_date_time$")).select(
        F.lit("locomo10.session_date_time").alias("field"), F.col("sample_id").alias("rec_id"), F.regexp_replace("key", "_date_time$", "").alias("item_key"), F.col("sample_id").alias("source_id"), "value"
    )
    stacks = longmem.select(F.lit("longmemeval_s_cleaned.haystack_dates").alias("field"), F.col("question_id").alias("rec_id"), F.posexplode("haystack_dates").alias("item_key", "value"))
    stacks = stacks.select("field", "rec_id", F.col("item_key").cast("string").alias("item_key"), F.col("rec_id").alias("source_id"), "value")
    asked = longmem.select(
        F.lit("longmemeval_s_cleaned.question_date").alias("field"), F.col("question_id").alias("rec_id"), none.alias("item_key"), F.col("question_id").alias("source_id"), F.col("question_date").alias("value")
    )
    return facts.unionByName(sessions).unionByName(stacks).unionByName(asked)
