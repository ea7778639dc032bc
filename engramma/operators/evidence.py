"""What is shown beside the chosen rows: sources, neighbours, whole sessions, standing traits, recurring instances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engramma.catalog import Catalog
from engramma.functions.lexical import STEM

#: Kinds that name no countable instance.
NOT_COUNTED = ("preference", "opinion", "emotion", "knowledge")
# Words that tell no two mentions apart.
WEAK_WORDS = (
    "about after again all also always another around because been before being between could every first found gave getting goes going gotten great have having just know known last like little looking made make many "
    "month more most much need never next only other over really right said same should since some something still such sure take than that their them then there these they thing think this those through time today took "
    "very want week were what when where which while will with would year your"
).split()


def hydrated(c: Catalog, facts: DataFrame | None = None) -> DataFrame:
    """(g, id, unit, date, kind, who, conf, text, n_sources, sources): facts with the lines that they come from, in order.

    Dangling sources are left out of ``sources`` and counted in ``n_sources``.
    """
    f = c.fact if facts is None else facts
    each = f.select("g", "id", F.posexplode(F.array_distinct("src")).alias("i", "line")).join(c.line.select("g", F.col("id").alias("line"), "who", "text"), ["g", "line"])
    said = each.groupBy("g", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "line", "who", "text"))), lambda x: F.struct(x["line"].alias("id"), x["who"].alias("who"), x["text"].alias("text"))).alias("sources"))
    out = f.join(said, ["g", "id"], "left")
    return out.select("g", "id", "unit", F.col("eff").alias("date"), "kind", "who", "conf", "text", F.size(F.array_distinct("src")).alias("n_sources"), F.coalesce("sources", F.array().cast("array<struct<id:string,who:string,text:string>>")).alias("sources"))


def positions(c: Catalog) -> DataFrame:
    """Lines with ``at``, their place in their unit, from 0 and without gaps."""
    return c.line.withColumn("at", F.row_number().over(W.partitionBy("g", "unit").orderBy("pos", "id")) - 1)


def neighbours(c: Catalog, cited: DataFrame, radius: int = 1, cap: int | None = 20) -> DataFrame:
    """(qid, g, unit, id, at, unit_date, who, text, rank): lines within ``radius`` of a cited one (qid, g, id) in its unit.

    Cited lines themselves are left out; the first ``cap`` of a request stay, by date, unit and place.
    """
    p = positions(c)
    here = cited.select("qid", "g", "id").distinct().join(p.select("g", "id", "unit", "at"), ["g", "id"])
    around = here.select("qid", "g", "unit", F.explode(F.sequence(F.col("at") - radius, F.col("at") + radius)).alias("at")).distinct()
    near = around.join(p, ["g", "unit", "at"]).join(cited.select("qid", "g", "id").distinct(), ["qid", "g", "id"], "left_anti")
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("qid", "g").orderBy("unit_date", "unit", "at")))
    ranked = ranked if cap is None else ranked.where(F.col("rank") <= cap)
    return ranked.select("qid", "g", "unit", "id", "at", "unit_date", "who", "text", "rank")


def dominant_unit(rows: DataFrame) -> DataFrame:
    """(qid, g, unit, n): the unit with at least three and half of a request's fact rows (qid, g, unit, seat); of equals the
    first seated."""
    n = rows.where("unit <> ''").groupBy("qid", "g", "unit").agg(F.count("*").alias("n"), F.min("seat").alias("first"))
    w = W.partitionBy("qid", "g")
    n = n.withColumn("all", F.sum("n").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.col("n").desc(), "first", "unit")))
    return n.where("r = 1 and n >= 3 and 2 * n >= all").select("qid", "g", "unit", "n")


def session_block(c: Catalog, units: DataFrame, limit: int = 6000) -> DataFrame:
    """(qid, g, unit, body, shown): whole dialogues of units (qid, g, unit), cut at ``limit`` characters, and the lines whose
    text begins before the cut."""
    label = F.concat(F.lit("("), "id", F.lit(") "), "who", F.lit(": "))
    j = positions(c).join(units.select("qid", "g", "unit"), ["g", "unit"]).withColumn("row", F.concat(label, "text"))
    w = W.partitionBy("qid", "g", "unit").orderBy("at")
    j = j.withColumn("start", F.sum(F.length("row") + 1).over(w.rowsBetween(W.unboundedPreceding, 0)) - F.length("row") - 1)
    ends = F.max(F.col("start") + F.length("row")).over(W.partitionBy("qid", "g", "unit"))
    j = j.withColumn("shown", F.col("start") + F.length(label) < F.least(F.lit(limit), ends))
    # no row that begins behind the cut is gathered
    kept = j.where(F.col("start") < limit).groupBy("qid", "g", "unit").agg(F.array_sort(F.collect_list(F.struct("at", "row", "id", "shown"))).alias("rows"))
    body = F.substring(F.array_join(F.transform("rows", lambda r: r["row"]), "\n"), 1, limit)
    return kept.select("qid", "g", "unit", body.alias("body"), F.transform(F.filter("rows", lambda r: r["shown"]), lambda r: r["id"]).alias("shown"))


def profile(c: Catalog, rows: int = 15, kinds: tuple[str, ...] = ("preference", "identity")) -> DataFrame:
    """(g, topic, id, unit_date, text, rank): the latest standing fact of each first topic, the latest topics first."""
    topic = F.when(F.size("topics") > 0, F.element_at("topics", 1)).otherwise("misc")
    f = c.fact.where(F.col("kind").isin(*kinds)).withColumn("topic", topic)
    latest = f.withColumn("n", F.row_number().over(W.partitionBy("g", "topic").orderBy(F.col("unit_date").desc(), "id"))).where("n = 1")
    ranked = latest.withColumn("rank", F.row_number().over(W.partitionBy("g").orderBy(F.col("unit_date").desc(), "id")))
    return ranked.where(F.col("rank") <= rows).select("g", "topic", "id", "unit_date", F.substring("text", 1, 150).alias("text"), "rank")


def instance_clusters(c: Catalog, max_frequency: int = 12, max_size: int = 14) -> DataFrame:
    """(g, key, ids): facts of several units that share a stem which few facts have; clusters within an earlier one are left
    out, where larger ones, and of equals the one with the least key, come first.

    A cluster has at most ``max_size`` facts by definition, so the pairs of clusters that share a fact are few.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z]{5,})"), 1))
    each = c.fact.select("g", "id", "unit", "kind", F.explode(words).alias("word"))
    stem = F.substring("word", 1, STEM)
    common = each.select("g", "id", stem.alias("key")).distinct().groupBy("g", "key").agg(F.count("*").alias("df")).where(F.col("df") <= max_frequency)
    keyed = each.where(~F.col("kind").isin(*NOT_COUNTED) & ~F.col("word").isin(WEAK_WORDS)).select("g", "id", "unit", stem.alias("key")).distinct().join(common.select("g", "key"), ["g", "key"], "left_semi")
    groups = keyed.groupBy("g", "key").agg(F.sort_array(F.collect_set("id")).alias("ids"), F.countDistinct("unit").alias("units")).where((F.size("ids") >= 2) & (F.size("ids") <= max_size) & (F.col("units") >= 2))
    # of equal sets the least key stays; then a set within a larger one goes
    groups = groups.groupBy("g", "ids").agg(F.min("key").alias("key"))
    first = groups.select("g", "key", "ids", F.explode("ids").alias("id"))
    inside = first.alias("a").join(first.alias("b"), (F.col("a.g") == F.col("b.g")) & (F.col("a.id") == F.col("b.id")) & (F.size("a.ids") < F.size("b.ids")))
    inside = inside.where(F.size(F.array_except("a.ids", "b.ids")) == 0).select("a.g", "a.key").distinct()
    return groups.join(inside, ["g", "key"], "left_anti").select("g", "key", "ids")


def rendered(date: Column, ident: Column, src: Column, text: Column, bound: Column, quotes: Column, most: int = 2, limit: int = 120) -> Column:
    """A row as a reader sees it: ``[date weekday] (id, src=...) text | verbatim: quote / quote``."""
    day = F.date_format(F.try_to_date(date, "yyyy-MM-dd"), "EEEE")
    said = F.transform(F.slice(quotes, 1, most), lambda q: F.substring(q, 1, limit))
    head = F.concat(F.when(bound, "[anchored] ").otherwise(""), F.lit("["), date, F.lit(" "), F.coalesce(day, F.lit("")), F.lit("] ("), ident, F.lit(", src="), F.array_join(src, " "), F.lit(") "))
    return F.concat(head, text, F.when(F.size(said) > 0, F.concat(F.lit(" | verbatim: "), F.array_join(said, " / "))).otherwise(""))


#: Most characters of a speaker's label.
LABEL = 24


def speaker_label(who: Column) -> Column:
    """A speaker as a label: on one line, without brackets, quotes, bars, slashes and control characters, of bounded length."""
    bare = F.regexp_replace(F.coalesce(who, F.lit("")), r"[\[\]()|:\"'<>\\/\x00-\x1f\x7f]", " ")
    return F.substring(F.trim(F.regexp_replace(bare, r"(?U)\s+", " ")), 1, LABEL)


def spoken(who: Column, text: Column) -> Column:
    """A line with the label of its speaker before it; without one, the text as it is."""
    label = speaker_label(who)
    return F.when(label != "", F.concat(label, F.lit(": "), text)).otherwise(text)


def citations(claimed: Column, shown: Column) -> Column:
    """The claimed ids that were shown, each once, in the order claimed."""
    return F.array_intersect(claimed, shown)


def summary(c: Catalog) -> DataFrame:
    """One row a codebook: counts of its records and its first and last session."""
    count = lambda df, name: df.groupBy("g").agg(F.count("*").alias(name))
    out = c.unit.groupBy("g").agg(F.count("*").alias("n_units"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    for df, name in ((c.fact, "n_facts"), (c.line, "n_lines"), (c.topic, "n_topics"), (c.entity, "n_entities")):
        out = out.join(count(df, name), "g", "full_outer")
    return out.select("g", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("n_units", "n_facts", "n_lines", "n_topics", "n_entities")], F.coalesce("first_date", F.lit("")).alias("first_date"), F.coalesce("last_date", F.lit("")).alias("last_date"))


def premise_risks(c: Catalog, docs_df: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, g, subject): capitalised or possessive subjects of questions of which no document of the codebook knows a stem.

    ``docs_df`` has (g, stem); months, weekdays and the first word of a question are no subjects.
    """
    names = F.regexp_extract_all("question", F.lit(r"(?<!^)(?<![.?!]\s)\b([A-Z][a-z]{2,})(?:'s)?\b"), 1)
    time_words = "January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
    asked = questions.select("qid", "g", F.explode(F.array_distinct(F.array_except(names, F.array(*[F.lit(w) for w in time_words])))).alias("subject"))
    known = docs_df.select("g", "stem").distinct()
    return asked.withColumn("stem", F.substring(F.lower("subject"), 1, STEM)).join(known, ["g", "stem"], "left_anti").select("qid", "g", "subject")


def attribution(c: Catalog, lines: DataFrame) -> DataFrame:
    """(qid, g, who, id): who said it: the speaker of the best line row (qid, g, id, score)."""
    best = lines.groupBy("qid", "g").agg(F.min_by("id", F.struct(-F.col("score"), "id")).alias("id"))
    return best.join(c.line.select("g", "id", "who"), ["g", "id"]).where("who <> ''").select("qid", "g", "who", "id")


def enumeration_basis(counts: DataFrame, limit: int = 160) -> DataFrame:
    """(qid, g, no, line): the numbered members of counts (qid, g, members)."""
    each = counts.select("qid", "g", F.posexplode("members").alias("p", "m"))
    return each.select("qid", "g", (F.col("p") + 1).alias("no"), F.format_string("%d. [%s] (%s) %s", F.col("p") + 1, "m.date", "m.id", F.substring("m.text", 1, limit)).alias("line"))


def instances_for(c: Catalog, instances: DataFrame, keywords: DataFrame, idf: DataFrame, cap: int = 12) -> DataFrame:
    """(qid, g, id, label, dates, score, rank): instances (g, id, label, mentions) by the idf of keywords (qid, g, keyword)
    that stand in their label or mentions, with their distinct dates."""
    told = instances.select("g", "id", "label", F.explode_outer("mentions").alias("m")).join(c.fact.select("g", F.col("id").alias("m"), "text", "eff"), ["g", "m"], "left")
    whole = told.groupBy("g", "id", "label").agg(F.concat_ws(" ", F.lower("label"), F.lower(F.array_join(F.sort_array(F.collect_set("text")), " "))).alias("text"), F.sort_array(F.collect_set(F.when(F.col("eff") != "", F.col("eff")))).alias("dates"))
    weights = keywords.withColumn("stem", F.substring("keyword", 1, STEM)).join(idf.select("g", "stem", "idf"), ["g", "stem"], "left").fillna(0.0, ["idf"]).groupBy("qid", "g").agg(F.sort_array(F.collect_list(F.struct("keyword", "idf"))).alias("ks"))
    score = F.aggregate(F.filter("ks", lambda k: F.contains("text", k["keyword"])), F.lit(0.0), lambda a, k: a + k["idf"])
    hits = whole.join(weights, "g").withColumn("score", score).where("score > 0")
    return hits.withColumn("rank", F.row_number().over(W.partitionBy("qid", "g").orderBy(F.col("score").desc(), "id"))).where(F.col("rank") <= cap).select("qid", "g", "id", "label", "dates", "score", "rank")


def memories(rows: DataFrame) -> DataFrame:
    """(qid, g, text): chosen rows (qid, g, id, date, text) as a chronicle, a line each: ``Month dd, YYYY: text``.

    A pack has a bounded number of rows, so one text a request is small.
    """
    day = F.coalesce(F.date_format(F.try_to_date("date", "yyyy-MM-dd"), "MMMM dd, yyyy"), F.col("date"))
    listed = F.array_sort(F.collect_list(F.struct("date", "id", F.concat(day, F.lit(": "), "text").alias("line"))))
    return rows.groupBy("qid", "g").agg(F.array_join(F.transform(listed, lambda r: r["line"]), "\n").alias("text"))


def token_ledger(calls: DataFrame) -> DataFrame:
    """(qid, channel, calls, tokens): tokens by question and channel, and in all (channel null); channels that are a part of
    another one (``subset``) do not count into the whole."""
    whole = calls.where(~F.coalesce("subset", F.lit(False))).groupBy("qid").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens")).withColumn("channel", F.lit(None).cast("string"))
    each = calls.groupBy("qid", "channel").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))
    return each.unionByName(whole)
