"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramma.llm.leaks import leaks
from engramma.llm.names import link_names
from engramma.llm.packing import packed
from engramma.llm.pii import find_pii, gazetteers, redacted
from engramma.llm.residue import excluded, residue
from engramma.operators.nested import dialogue_turns, haystack_turns
from engramma.session import table

Query = Callable[[SparkSession, str], DataFrame]


def utterances(spark: SparkSession, d: str, unnamed: bool = False) -> DataFrame:
    """(tbl, rec_id, turn_key, text) of the three tables of utterances; dialogue turns without dia_id are left out, or, with
    ``unnamed``, come under ``<session>:<position>``."""
    line = table(spark, d, "line").select(F.lit("line").alias("tbl"), F.col("id").alias("rec_id"), F.lit("").alias("turn_key"), "text")
    turns = dialogue_turns(table(spark, d, "locomo10"))
    key = F.when(F.col("dia_id") != "", F.col("dia_id")).otherwise(F.concat_ws(":", "session", "pos")) if unnamed else F.col("dia_id")
    talk = turns.select(F.lit("locomo10").alias("tbl"), "rec_id", key.alias("turn_key"), "text").where("turn_key is not null")
    stack = haystack_turns(table(spark, d, "longmemeval_s_cleaned")).select(
        F.lit("longmemeval_s_cleaned").alias("tbl"), "rec_id", F.concat_ws(":", "session_pos", "turn_pos").alias("turn_key"), F.col("content").alias("text")
    )
    return line.unionByName(talk).unionByName(stack)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    known = gazetteers(table(spark, d, "codebook"), table(spark, d, "entity"))
    return find_pii(spark, utterances(spark, d), known).select("tbl", "rec_id", "turn_key", "pii_type").distinct()


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    known = gazetteers(table(spark, d, "codebook"), table(spark, d, "entity"))
    texts = utterances(spark, d, unnamed=True)
    return redacted(texts, find_pii(spark, texts, known))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return link_names(spark, table(spark, d, "codebook"), table(spark, d, "entity"), table(spark, d, "fact"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packed(table(spark, d, "documents"), table(spark, d, "pack_spec"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return excluded(table(spark, d, "documents"))


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return residue(table(spark, d, "documents"))


QUERIES: dict[str, Query] = {"p1_found": p1_found, "p1_redacted": p1_redacted, "p5_found": p5_found, "p6_containers": p6_containers, "p7_found": p7_found, "p8_found": p8_found, "p8_scores": p8_scores}
ORACLES: dict[str, str] = {}
