"""Stems and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that a stem keeps.
STEM = 6


def stems(text: Column) -> Column:
    """The stems of a text in order, with repeats: ASCII words of three letters or more, lower case, cut to six letters;
    then every pair of neighbours in runs of CJK characters. Null gives null."""
    words = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z][a-z']{2,})"), 1), lambda w: F.substring(w, 1, STEM))
    runs = F.regexp_extract_all(text, F.lit("([一-鿿]{2,})"), 1)
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.concat(words, pairs)


def documents(fact: DataFrame, line: DataFrame) -> DataFrame:
    """(g, type, id, toks): facts and lines as documents of stems."""
    one = lambda df, kind: df.select("g", F.lit(kind).alias("type"), "id", stems(F.col("text")).alias("toks"))
    return one(fact, "fact").unionByName(one(line, "line"))


def frequencies(docs: DataFrame) -> DataFrame:
    """(g, stem, df, idf, n_docs): in how many documents of a codebook a stem occurs, and ln(1 + (N + 1) / (df + 1))."""
    n = docs.groupBy("g").agg(F.count("*").alias("n_docs"))
    df = docs.select("g", F.explode(F.array_distinct("toks")).alias("stem")).groupBy("g", "stem").agg(F.count("*").alias("df"))
    return df.join(n, "g").select("g", "stem", "df", F.log(1 + (F.col("n_docs") + 1) / (F.col("df") + 1)).alias("idf"), "n_docs")


def average_length(docs: DataFrame) -> DataFrame:
    """(g, n_docs, avg_tokens)."""
    return docs.groupBy("g").agg(F.count("*").alias("n_docs"), F.avg(F.size("toks")).alias("avg_tokens"))


def specificity(docs: DataFrame, idf: DataFrame) -> DataFrame:
    """(g, type, id, specificity): the sum of the three greatest idf of a document's distinct stems."""
    each = docs.select("g", "type", "id", F.explode(F.array_distinct("toks")).alias("stem")).join(idf.select("g", "stem", "idf"), ["g", "stem"])
    top = F.slice(F.sort_array(F.collect_list("idf"), asc=False), 1, 3)
    return each.groupBy("g", "type", "id").agg(F.aggregate(top, F.lit(0.0), lambda a, x: a + x).alias("specificity"))
