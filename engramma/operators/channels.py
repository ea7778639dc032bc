"""Retrieval channels, their fusion, and the choice of evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engramma.catalog import Catalog
from engramma.functions.lexical import STEM, average_length, frequencies

RRF = 60
#: Scores that agree to so many places are ties, whatever order they were summed in.
TIE = 9
PRECISE_SCORE, PRECISE_ROWS, BOUND_ROWS = 4.5, 8, 40


def question_stems(questions: DataFrame, least: int = 3) -> DataFrame:
    """(qid, g, stem): the distinct stems of the words of a question (qid, g, question) with at least ``least`` letters."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("question"), F.lit(rf"([a-z][a-z']{{{least - 1},}})"), 1))
    return questions.select("qid", "g", F.explode(F.transform(words, lambda w: F.substring(w, 1, STEM))).alias("stem")).distinct()


def lexical(docs: DataFrame, asked: DataFrame, cap: int = 24, rare: DataFrame | None = None, rare_most: int = 10) -> DataFrame:
    """(qid, g, type, id, score, rank): documents by the idf of the asked stems that they have, damped by length.

    Postings are joined, no text is scanned. ``rare`` may add stems (qid, g, stem) that at most ``rare_most`` documents have.
    """
    idf = frequencies(docs)
    wanted = asked.select("qid", "g", "stem").distinct()
    if rare is not None:
        few = rare.join(idf.select("g", "stem", "df"), ["g", "stem"]).where(F.col("df") <= rare_most).select("qid", "g", "stem")
        wanted = wanted.unionByName(few).distinct()
    post = docs.select("g", "type", "id", F.size("toks").alias("n"), F.explode(F.array_distinct("toks")).alias("stem"))
    hits = post.join(wanted.join(idf, ["g", "stem"]).select("qid", "g", "stem", "idf"), ["g", "stem"])
    # a sum in the order of the stems does not depend on how rows arrive
    total = F.aggregate(F.array_sort(F.collect_list(F.struct("stem", "idf"))), F.lit(0.0), lambda a, x: a + x["idf"])
    sums = hits.groupBy("qid", "g", "type", "id").agg(total.alias("s"), F.max("n").alias("n")).join(average_length(docs), "g")
    scored = sums.withColumn("score", F.col("s") / (0.75 + 0.25 * F.col("n") / F.when(F.col("avg_tokens") > 0, F.col("avg_tokens")).otherwise(1.0)))
    order = W.partitionBy("qid", "g").orderBy(F.round("score", TIE).desc(), "type", "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap).select("qid", "g", "type", "id", "score", "rank")


def lexical_plain(c: Catalog, docs: DataFrame, keywords: DataFrame, cap: int = 24) -> DataFrame:
    """The same by plain containment of keywords (qid, g, keyword); each weighs the idf of the keyword as a stem, unstemmed."""
    idf = frequencies(docs)
    n = docs.groupBy("g").agg(F.count("*").alias("n_docs"))
    k = keywords.join(idf.select("g", F.col("stem").alias("keyword"), "idf"), ["g", "keyword"], "left").join(n, "g").select("qid", "g", "keyword", F.coalesce("idf", F.log(1 + (F.col("n_docs") + 1) / F.lit(1.0))).alias("idf"))
    asked = k.groupBy("qid", "g").agg(F.sort_array(F.collect_list(F.struct("keyword", "idf"))).alias("ks"))
    texts = c.fact.select("g", F.lit("fact").alias("type"), "id", F.lower("text").alias("text")).unionByName(c.line.select("g", F.lit("line").alias("type"), "id", F.lower("text").alias("text")))
    total = F.aggregate(F.filter("ks", lambda x: F.contains("text", F.lower(x["keyword"]))), F.lit(0.0), lambda a, x: a + x["idf"])
    scored = texts.join(asked, "g").withColumn("score", total).where("score > 0")
    order = W.partitionBy("qid", "g").orderBy(F.round("score", TIE).desc(), "type", "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap).select("qid", "g", "type", "id", "score", "rank")


def date_window(c: Catalog, anchors: DataFrame, specificity: DataFrame, cap: int = 12) -> DataFrame:
    """(qid, g, id, score, rank): facts of the day or month of an anchor (qid, g, day, month): dated ones, then those told then."""
    j = c.fact.select("g", "id", "t", "unit_date").join(anchors.select("qid", "g", "day", "month"), "g")
    day = F.col("day") != ""
    dated = F.when(day, F.substring("t", 1, 10) == F.col("day")).otherwise((F.col("t") != "") & (F.substring("t", 1, 7) == F.col("month")))
    told = F.when(day, F.col("unit_date") == F.col("day")).otherwise(F.startswith("unit_date", F.col("month")))
    hit = j.where((day | (F.col("month") != "")) & (dated | told)).withColumn("late", F.when(dated, 0).otherwise(1))
    hit = hit.join(specificity.where("type = 'fact'").select("g", "id", "specificity"), ["g", "id"], "left").fillna(0.0, ["specificity"])
    ranked = hit.withColumn("rank", F.row_number().over(W.partitionBy("qid", "g").orderBy("late", F.round("specificity", TIE).desc(), "id"))).where(F.col("rank") <= cap)
    return ranked.select("qid", "g", "id", (3.0 - 0.1 * (F.col("rank") - 1)).alias("score"), "rank")


def fused(channels: list[DataFrame]) -> DataFrame:
    """(qid, g, type, id, rrf, rank): reciprocal-rank fusion of ranked channels (qid, g, type, id, rank from 1).

    Ties go to the row that was seen first: by channel, then by rank in it.
    """
    union = None
    for i, ch in enumerate(channels):
        one = ch.select("qid", "g", "type", "id", F.lit(i).alias("channel"), "rank")
        union = one if union is None else union.unionByName(one)
    # at most one row a channel; in channel order the sum is always the same
    share = F.transform(F.array_sort(F.collect_list(F.struct("channel", "rank"))), lambda x: F.lit(1.0) / (RRF - 1 + x["rank"]))
    sums = union.groupBy("qid", "g", "type", "id").agg(F.aggregate(share, F.lit(0.0), lambda a, x: a + x).alias("rrf"), F.min(F.struct("channel", "rank")).alias("seen"))
    return sums.withColumn("rank", F.row_number().over(W.partitionBy("qid", "g").orderBy(F.round("rrf", 12).desc(), "seen"))).drop("seen")


def chosen(plan_rows: DataFrame, fused_rows: DataFrame, budget: int, unit_cap: int, relief: bool = False) -> DataFrame:
    """(qid, g, type, id, unit, seat): the rows of the evidence, under a budget of rows.

    ``plan_rows`` (qid, g, type, id, unit, score, bound, rank): bound rows, then the few best of high score, are seeds;
    ``fused_rows`` (qid, g, type, id, unit, rank) follow while their units have seats. Where something is bound, a third of
    the budget at most goes to them. With ``relief`` free seats are filled whatever the unit.
    """
    plan = plan_rows.where("type <> 'count'")
    precise = plan.where(~F.col("bound") & (F.col("score") >= PRECISE_SCORE)).withColumn("_n", F.row_number().over(W.partitionBy("qid", "g").orderBy(F.col("score").desc(), "rank"))).where(F.col("_n") <= PRECISE_ROWS).select("qid", "g", "type", "id", "unit", F.lit(1).alias("part"), F.col("_n").alias("rank"))
    bound = plan.where("bound").select("qid", "g", "type", "id", "unit", F.lit(0).alias("part"), "rank")
    seeds = bound.unionByName(precise).withColumn("seat", F.row_number().over(W.partitionBy("qid", "g").orderBy("part", "rank"))).where(F.col("seat") <= budget)
    taken = seeds.groupBy("qid", "g").agg(F.count("*").alias("n_seeds"), F.max(F.when(F.col("part") == 0, 1).otherwise(0)).alias("any_bound"))
    used = seeds.groupBy("qid", "g", "unit").agg(F.count("*").alias("used"))
    rest = fused_rows.select("qid", "g", "type", "id", "unit", "rank").join(seeds.select("qid", "g", "type", "id"), ["qid", "g", "type", "id"], "left_anti")
    rest = rest.join(taken, ["qid", "g"], "left").join(used, ["qid", "g", "unit"], "left").fillna(0, ["n_seeds", "any_bound", "used"])
    nth = F.col("used") + F.row_number().over(W.partitionBy("qid", "g", "unit").orderBy("rank"))
    rest = rest.withColumn("free", nth <= unit_cap)
    place = F.row_number().over(W.partitionBy("qid", "g", "free").orderBy("rank"))
    most = F.when(F.col("any_bound") == 1, F.greatest(F.lit(2), F.lit(budget // 3))).otherwise(budget)
    rest = rest.withColumn("main", F.col("free") & (place <= F.least(most, budget - F.col("n_seeds"))))
    follow = rest if relief else rest.where("main")
    seat = F.col("n_seeds") + F.row_number().over(W.partitionBy("qid", "g").orderBy(~F.col("main"), "rank"))
    follow = follow.withColumn("seat", seat).where(F.col("seat") <= budget)
    cols = ["qid", "g", "type", "id", "unit", "seat"]
    return seeds.select(*cols).unionByName(follow.select(*cols))


CHOICE = "qid string, g string, type string, id string, unit string, seat int, cost int"


def chosen_by_tokens(plan_rows: DataFrame, fused_rows: DataFrame, cap: int, unit_cap: int, row_cap: int = 0) -> DataFrame:
    """(qid, g, type, id, unit, seat, cost): the same under a cap of tokens; both inputs have ``cost``.

    Bound rows are free of the cap. A precise row that does not fit is skipped; at the first fused row that does not fit the
    rest, though it would fit an empty pack, the choice ends. The order matters, so it is one fold over the rows of a
    request: bound rows and precise rows are few, and of the fused ones only those come that may still fit.
    """
    plan = plan_rows.where("type <> 'count'")
    precise = plan.where(~F.col("bound") & (F.col("score") >= PRECISE_SCORE)).withColumn("rank", F.row_number().over(W.partitionBy("qid", "g").orderBy(F.col("score").desc(), "rank"))).where(F.col("rank") <= PRECISE_ROWS)
    bound = plan.where("bound").withColumn("rank", F.row_number().over(W.partitionBy("qid", "g").orderBy("rank"))).where(F.col("rank") <= BOUND_ROWS)
    part = lambda df, n: df.select("qid", "g", "type", "id", "unit", "cost", F.lit(n).alias("part"), "rank")
    # of a unit only the first rows can be admitted, whatever was admitted before
    nth = F.row_number().over(W.partitionBy("qid", "g", "unit").orderBy("rank"))
    follow = fused_rows.where(F.col("cost") <= cap).withColumn("_nth", nth).where(F.col("_nth") <= unit_cap + PRECISE_ROWS + BOUND_ROWS)
    rows = part(bound, 0).unionByName(part(precise, 1)).unionByName(part(follow, 2))
    listed = rows.groupBy("qid", "g").agg(F.array_sort(F.collect_list(F.struct("part", "rank", "type", "id", "unit", "cost"))).alias("rows"))
    state = "struct<total:int,stop:boolean,rows:array<struct<type:string,id:string,unit:string,cost:int>>>"
    start = F.struct(F.lit(0).alias("total"), F.lit(False).alias("stop"), F.array().cast("array<struct<type:string,id:string,unit:string,cost:int>>").alias("rows")).cast(state)

    def admit(s, r):
        known = F.exists(s["rows"], lambda x: (x["type"] == r["type"]) & (x["id"] == r["id"]))
        held = F.size(F.filter(s["rows"], lambda x: x["unit"] == r["unit"]))
        full = F.lit(row_cap > 0) & (F.size(s["rows"]) >= row_cap)
        over = s["total"] + r["cost"] > cap
        ends = ~s["stop"] & (r["part"] == 2) & ~known & (held < unit_cap) & (full | over)
        takes = F.when(r["part"] == 0, F.lit(True)).when(r["part"] == 1, ~known & ~over & ~full).otherwise(~s["stop"] & ~known & (held < unit_cap) & ~full & ~over)
        one = F.array(F.struct(r["type"].alias("type"), r["id"].alias("id"), r["unit"].alias("unit"), r["cost"].alias("cost")))
        return F.struct(F.when(takes, s["total"] + r["cost"]).otherwise(s["total"]).alias("total"), (s["stop"] | ends).alias("stop"), F.when(takes, F.concat(s["rows"], one)).otherwise(s["rows"]).alias("rows")).cast(state)

    done = listed.select("qid", "g", F.posexplode(F.aggregate("rows", start, admit)["rows"]).alias("p", "r"))
    return done.select("qid", "g", "r.type", "r.id", "r.unit", (F.col("p") + 1).alias("seat"), "r.cost")


def row_cost(text, quotes=None):
    """Tokens of a row as it is listed, estimated by its characters: a quarter of them, and eight more."""
    whole = text if quotes is None else F.concat(text, F.when(F.size(quotes) > 0, F.concat(F.lit(" | verbatim: "), F.array_join(F.transform(F.slice(quotes, 1, 2), lambda q: F.substring(q, 1, 120)), " / "))).otherwise(""))
    return (F.floor(F.length(whole) / 4) + 8).cast("int")


def recency(c: Catalog, seen: DataFrame, asked: DataFrame, limit: int = 8, speakers: list[str] | None = None) -> DataFrame:
    """(qid, g, id, rank): the newest facts that requests (qid, g) have not seen (qid, g, id), by session date."""
    f = c.fact if speakers is None else c.fact.where(F.col("who").isin(speakers))
    j = f.select("g", "id", "unit_date").join(asked.select("qid", "g").distinct(), "g").join(seen.select("qid", "g", "id"), ["qid", "g", "id"], "left_anti")
    return j.withColumn("rank", F.row_number().over(W.partitionBy("qid", "g").orderBy(F.col("unit_date").desc(), "id"))).where(F.col("rank") <= limit).select("qid", "g", "id", "rank")

