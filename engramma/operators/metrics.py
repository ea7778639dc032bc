"""Scores of answers against references, reconciliation, and the vocabulary leak check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def answer_tokens(text: Column) -> Column:
    """Lower-case words without punctuation and articles; null counts as empty."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[!-/:-@\[-`{-~]", "")
    words = F.split(F.regexp_replace(plain, r"\b(a|an|the)\b", " "), r"\s+")
    return F.filter(words, lambda w: w != "")


def _overlap(p: Column, r: Column) -> Column:
    """Common tokens, counted with repeats."""
    count = lambda a, w: F.size(F.filter(a, lambda x: x == w))
    return F.aggregate(F.array_distinct(p), F.lit(0), lambda n, w: n + F.least(count(p, w), count(r, w)))


def token_f1(prediction: Column, reference: Column) -> Column:
    p, r = answer_tokens(prediction), answer_tokens(reference)
    both = _overlap(p, r)
    return F.when((F.size(p) == 0) | (F.size(r) == 0), F.when(F.size(p) == F.size(r), 1.0).otherwise(0.0)).when(both == 0, 0.0).otherwise(2.0 * both / (F.size(p) + F.size(r)))


def bleu1(prediction: Column, reference: Column) -> Column:
    p, r = answer_tokens(prediction), answer_tokens(reference)
    brevity = F.when(F.size(p) >= F.size(r), 1.0).otherwise(F.exp(1 - F.size(r) / F.greatest(F.lit(1), F.size(p))))
    return F.when(F.size(p) == 0, 0.0).otherwise(brevity * _overlap(p, r) / F.size(p))


def evidence_recall(gold: Column, shown: Column) -> Column:
    """The share of gold evidence that was shown; null without gold evidence."""
    g = F.array_distinct(gold)
    return F.when(F.size(g) > 0, F.size(F.array_intersect(g, shown)) / F.size(g))


def gold_answer(category: Column, answer: Column) -> Column:
    """Answers of category 3 end at the first semicolon."""
    return F.when(category == 3, F.trim(F.substring_index(answer, ";", 1))).otherwise(answer)


def summary(rows: DataFrame, by: str, **metrics: Column) -> DataFrame:
    """Means of metrics in each group and overall (group null), with the number of rows; null values do not count."""
    return rows.rollup(by).agg(F.count("*").alias("n"), *[F.avg(m).alias(name) for name, m in metrics.items()])


def reconciled(rows: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, problem): rows that are missing, foreign or repeated against what is expected."""
    have = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    both = have.join(expected.select(*keys).distinct().withColumn("_want", F.lit(True)), keys, "full_outer")
    problem = F.when(F.col("_n").isNull(), "missing").when(F.col("_want").isNull(), "foreign").when(F.col("_n") > 1, "repeated")
    return both.select(*keys, problem.alias("problem")).where("problem is not null")


def telling_terms(texts: DataFrame, group: str, share: float = 0.3, least: int = 5) -> DataFrame:
    """(term, n_docs, n): terms of four letters or more in at most ``share`` of the groups, at least ``least`` times in all."""
    words = texts.select(F.col(group).alias("_g"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z]{4,})"), 1)).alias("term"))
    groups = texts.select(group).distinct().count()
    each = words.groupBy("term", "_g").agg(F.count("*").alias("k")).groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("k").alias("n"))
    return each.where((F.col("n_docs") <= share * groups) & (F.col("n") >= least))


def stratified(questions: DataFrame, count: int, id_col: str = "question_id", type_col: str = "question_type", absent_share: float = 0.1) -> DataFrame:
    """``count`` questions, the same at every call: first a slice of unanswerable ones (ids that end in ``_abs``), then an
    equal quota of each type, then whatever is left, always in the order of ids. A sampling operator: it takes few by intent.
    """
    q = questions.select(id_col, type_col).distinct().withColumn("_absent", F.endswith(id_col, F.lit("_abs")))
    types = max(1, q.select(type_col).distinct().count())
    quota = max(1, count // types)
    nth = F.row_number().over(W.partitionBy(type_col, "_absent").orderBy(id_col))
    all_absent = F.row_number().over(W.partitionBy("_absent").orderBy(id_col))
    tier = F.when(F.col("_absent") & (F.col("_all") <= max(1, int(count * absent_share))), 0).when(~F.col("_absent") & (F.col("_nth") <= quota), 1).otherwise(2)
    ranked = q.withColumn("_nth", nth).withColumn("_all", all_absent).withColumn("_tier", tier)
    return ranked.orderBy("_tier", id_col).limit(count).select(id_col, type_col)


def pack_units(ids: Column) -> Column:
    """The sessions that row ids belong to, each once: an id without its fact or line number, or without its turn."""
    return F.array_distinct(F.transform(ids, lambda i: F.regexp_replace(F.regexp_replace(i, r"[FL]\d+$", ""), r":\d+$", "")))
