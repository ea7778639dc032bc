"""Scores, order, pipes, pools and packs of matched rows, for all requests at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engramma.catalog import Catalog
from engramma.functions.dates import conf_rank
from engramma.functions.lexical import STEM
from engramma.operators.matching import STEP

#: What the parts of a score weigh.
EXACT, DEEP, SHALLOW, ENTITY, FACET, KIND, WHO, CONF = 3.0, 2.0, 0.8, 2.0, 1.5, 1.0, 0.5, 0.2
COMPLEX_PATTERN, PATTERN_MOST, PATTERN_WEIGHT = 2.5, 6.0, 0.9
#: What a rank costs in the pool.
DECAY = 1e-4
#: Scores that agree to so many places are ties.
TIE = 9


def pattern_weights(patterns: DataFrame, idf: DataFrame) -> DataFrame:
    """(g, pattern, simple, terms): the alternatives of a simple pattern with their idf, from (g, pattern).

    A term is looked up by its first letters as written; one that no document has weighs as an unseen stem.
    """
    simple = ~F.regexp_replace("pattern", r"\\\|", "").rlike(r"[()\[\]?*+{\\]")
    terms = F.filter(F.transform(F.split("pattern", r"\|"), lambda t: F.trim(t)), lambda t: t != "")
    p = patterns.select("g", "pattern").distinct().withColumn("simple", simple)
    each = p.where("simple").select("g", "pattern", F.explode(terms).alias("term")).withColumn("stem", F.substring(F.lower("term"), 1, STEM))
    unseen = idf.groupBy("g").agg(F.max("n_docs").alias("n_docs"))
    known = each.join(idf.select("g", "stem", "idf"), ["g", "stem"], "left").join(unseen, "g", "left")
    known = known.withColumn("idf", F.coalesce("idf", F.log(1 + (F.coalesce("n_docs", F.lit(0)) + 1) / F.lit(1.0))))
    weights = known.groupBy("g", "pattern").agg(F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("terms"))
    return p.join(weights, ["g", "pattern"], "left")


def scored(c: Catalog, m: DataFrame, idf: DataFrame | None = None, typed: bool = True) -> DataFrame:
    """Matched facts with their ``score`` under the relaxed request: filters given up at the taken step do not count."""
    kept = lambda name: F.col("taken") < STEP[name]
    forced = lambda code: (F.col("taken") >= STEP["topics"]) | ~F.array_contains("q_exact", code)
    topic = F.aggregate(
        F.coalesce("q_closures", F.array().cast("array<struct<code:string,codes:array<string>,deep:array<string>>>")),
        F.lit(0.0),
        lambda a, t: a
        + F.when(F.array_contains("topics", t["code"]), EXACT).when(forced(t["code"]) & F.arrays_overlap("topics", t["deep"]), DEEP).when(forced(t["code"]) & F.arrays_overlap("topics", t["codes"]), SHALLOW).otherwise(0.0),
    )
    entity = F.when(kept("entities"), ENTITY * F.size(F.array_intersect("entities", "q_entities"))).otherwise(0.0)
    facets = F.lit(0.0)
    for axis in ("obj", "place", "event"):
        facets = facets + F.when(kept(axis) & F.arrays_overlap(axis, f"q_{axis}"), FACET).otherwise(0.0)
    kind = F.when(kept("kind") & F.expr("array_contains(q_kind, kind)"), KIND).otherwise(0.0)
    who = F.when(kept("who") & (F.size("q_who") > 0) & (F.expr("array_contains(q_who, who)") | F.col("who").isin("both", "multi")), WHO).otherwise(0.0)
    total = topic + entity + facets + kind + who + CONF * conf_rank(F.col("conf"))
    if idf is not None:
        asked = m.select("g", F.col("q_grep").alias("pattern")).where("pattern <> ''").unionByName(m.select("g", F.explode("q_grep_all").alias("pattern"))).distinct()
        weights = pattern_weights(asked, idf)
        by_g = weights.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("pattern", F.struct("simple", F.coalesce("terms", F.array().cast("array<struct<term:string,idf:double>>")).alias("terms"))))).alias("weights"))
        m = m.join(by_g, "g", "left")
        patterns = F.when(kept("grep"), F.concat(F.when(F.col("q_grep") != "", F.array("q_grep")).otherwise(F.array().cast("array<string>")), "q_grep_all")).otherwise(F.array().cast("array<string>"))
        m = m.withColumn("_patterns", patterns).withColumn("_grep", F.expr(_GREP))
        total = total + F.col("_grep")
    if typed:
        etype = c.entity.select("g", F.col("code").alias("e"), F.lower("etype").alias("etype"))
        posted = c.posting("entities").groupBy("g", F.col("code").alias("e")).agg(F.count("*").alias("posted"))
        rare = F.least(F.lit(3.5), F.lit(6.0) / (1 + F.log2(1 + F.coalesce("posted", F.lit(0)))))
        rows = c.fact.select("g", "id", F.explode("entities").alias("e")).distinct().join(etype, ["g", "e"]).join(posted, ["g", "e"], "left")
        best = rows.groupBy("g", "id").agg(F.collect_list(F.struct("etype", rare.alias("rare"))).alias("typed"))
        m = m.join(best, ["g", "id"], "left")
        hits = F.filter("typed", lambda t: F.contains(t["etype"], F.lower("q_entity_kind")))
        total = total + F.when(F.col("q_entity_kind") != "", F.coalesce(F.array_max(F.transform(hits, lambda t: t["rare"])), F.lit(0.0))).otherwise(0.0)
    return m.withColumn("score", total).drop("weights", "_patterns", "_grep", "typed")


_GREP = f"""aggregate(_patterns, 0D, (a, p) -> a + CASE
  WHEN NOT rlike(text, concat('(?iU)', p)) THEN 0D
  WHEN NOT element_at(weights, p).simple THEN {COMPLEX_PATTERN}D
  ELSE (CASE WHEN aggregate(filter(element_at(weights, p).terms, t -> contains(lower(text), lower(t.term))), 0D, (b, t) -> b + t.idf) > 0D
        THEN least({PATTERN_MOST}D, {PATTERN_WEIGHT}D * aggregate(filter(element_at(weights, p).terms, t -> contains(lower(text), lower(t.term))), 0D, (b, t) -> b + t.idf))
        ELSE {COMPLEX_PATTERN}D END) END)"""


def content_key() -> Column:
    """What orders facts of equal score and date by content, before their generated ids do."""
    flat = F.regexp_replace(F.trim(F.lower("text")), r"\s+", " ")
    return F.struct(flat, "kind", "who", *[F.sort_array(x) for x in ("topics", "entities", "obj", "place", "event")], "dur", "t", "unit", F.sort_array("src"))


def ranked(s: DataFrame, specificity: DataFrame | None = None) -> DataFrame:
    """Scored facts with ``rank`` from 1: by score, date and id; with ``specificity`` (g, id, specificity), which a head or
    tail needs, ties of score and date go by specificity and content first."""
    order = [F.round("score", TIE).desc(), F.col("eff")]
    if specificity is not None:
        s = s.join(specificity.select("g", "id", "specificity"), ["g", "id"], "left").fillna(0.0, ["specificity"])
        order += [F.round("specificity", TIE).desc(), content_key()]
    return s.withColumn("rank", F.row_number().over(W.partitionBy("qid", "g").orderBy(*order, "id")))


def sort_step(r: DataFrame, key: str = "t", desc: bool = False, unit: DataFrame | None = None) -> DataFrame:
    """Ranked rows in a new order; equal keys keep theirs, in either direction. ``dur`` needs the unit table."""
    if key == "dur":
        r = r.join(unit.select("g", F.col("id").alias("unit"), F.col("dur_min").alias("_key")), ["g", "unit"], "left").fillna(0, ["_key"])
    else:
        r = r.withColumn("_key", F.col("eff"))
    by = F.col("_key").desc() if desc else F.col("_key")
    return r.withColumn("rank", F.row_number().over(W.partitionBy("qid", "g").orderBy(by, "rank"))).drop("_key")


def head(r: DataFrame, n: int) -> DataFrame:
    return r.where(F.col("rank") <= n)


def tail(r: DataFrame, n: int) -> DataFrame:
    """The last ``n`` of each request, ranked anew."""
    back = F.count("*").over(W.partitionBy("qid", "g")) - F.col("rank")
    r = r.withColumn("_back", back).where(F.col("_back") < n).drop("_back")
    return r.withColumn("rank", F.row_number().over(W.partitionBy("qid", "g").orderBy("rank")))


def counted(r: DataFrame, members: int = 40) -> DataFrame:
    """(qid, g, n, members): how many rows a request has, and its first ones. The rows flow on beside it."""
    first = r.where(F.col("rank") <= members).groupBy("qid", "g").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "eff", "text"))), lambda x: F.struct(x["id"].alias("id"), x["eff"].alias("date"), x["text"].alias("text"))).alias("members"))
    return r.groupBy("qid", "g").agg(F.count("*").alias("n")).join(first, ["qid", "g"])


def pooled(rows: DataFrame) -> DataFrame:
    """(qid, g, key, type, id, unit, date, score): rows of all queries of a request, each once with its best decayed score.

    ``rows`` has (qid, g, type F, L or U, id, unit, date, score, rank); lines and units come with score 1 and rank 1. Less
    than nothing counts as nothing.
    """
    worth = F.greatest(F.lit(0.0), F.col("score") - F.when(F.col("type") == "F", (F.col("rank") - 1) * DECAY).otherwise(0.0))
    return rows.withColumn("score", worth).groupBy("qid", "g", F.concat_ws("::", "type", "id").alias("key"), "type", "id", "unit", "date").agg(F.max("score").alias("score"))


def _capped(order: DataFrame, seq: list, unit_cap: int, budget: int, relief: bool) -> DataFrame:
    per_unit = W.partitionBy("qid", "g", "unit").orderBy(*seq)
    o = order.withColumn("_nth", F.row_number().over(per_unit)).withColumn("_refused", (F.col("type") != "U") & (F.col("_nth") > unit_cap))
    if not relief:
        o = o.where(~F.col("_refused"))
    seat = F.row_number().over(W.partitionBy("qid", "g").orderBy(*(["_refused"] if relief else []), *seq))
    return o.withColumn("seat", seat).where(F.col("seat") <= budget).drop("_nth", "_refused")


def packed(pool: DataFrame, budget: int = 12, unit_cap: int = 4) -> DataFrame:
    """The best rows of a pool, at most ``unit_cap`` of a unit (units themselves are free of it), ``budget`` in all."""
    return _capped(pool, [F.round("score", TIE).desc(), F.col("key")], unit_cap, budget, False)


def packed_with_quota(pool: DataFrame, first: DataFrame, budget: int = 12, unit_cap: int = 4) -> DataFrame:
    """The same, but each query's two best rows (qid, g, key, sub, rank) are seated first, and where the cap leaves seats
    free, the refused rows take them in order."""
    early = first.where("rank <= 2").groupBy("qid", "g", "key").agg(F.min(F.struct("sub", "rank")).alias("early"))
    p = pool.join(early, ["qid", "g", "key"], "left")
    seq = [F.col("early").isNull(), F.col("early.sub"), F.col("early.rank"), F.round("score", TIE).desc(), F.col("key")]
    return _capped(p, seq, unit_cap, budget, True).drop("early")


def packed_with_coverage(pool: DataFrame, branch: DataFrame, budget: int = 12, unit_cap: int = 4) -> DataFrame:
    """Branches of the taxonomy take turns: the best row of each branch, then the second of each, and so on; then relief.

    ``branch`` has (g, id, branch) of facts; other rows share one branch.
    """
    p = pool.join(branch.select("g", "id", F.lit("F").alias("type"), "branch"), ["g", "id", "type"], "left").fillna("", ["branch"])
    turn = F.row_number().over(W.partitionBy("qid", "g", "branch").orderBy(F.round("score", TIE).desc(), "key"))
    p = p.withColumn("turn", turn)
    return _capped(p, [F.col("turn"), F.col("branch"), F.round("score", TIE).desc(), F.col("key")], unit_cap, budget, True)


def branches(c: Catalog) -> DataFrame:
    """(g, code, branch): the ancestor of a topic just below a root, along the least declared parent; a root is its own.

    Where the walk comes back to where it was, it stays.
    """
    from engramma.session import cut

    known = c.topic.select("g", "code")
    real = c.edge.join(known.withColumnRenamed("code", "parent"), ["g", "parent"]).select("g", F.col("child").alias("code"), "parent")
    roots = known.join(c.edge.select("g", F.col("child").alias("code")).distinct(), ["g", "code"], "left_anti")
    under_root = real.join(roots.withColumnRenamed("code", "parent"), ["g", "parent"]).select("g", "code").distinct().withColumn("stop", F.lit(True))
    least = real.groupBy("g", "code").agg(F.min("parent").alias("parent")).join(under_root, ["g", "code"], "left")
    step = cut(known.join(least, ["g", "code"], "left").select("g", "code", F.when(F.col("stop") | F.col("parent").isNull(), F.col("code")).otherwise(F.col("parent")).alias("next")))
    now = step.select("g", "code", F.col("next").alias("branch"), F.array("code").alias("seen"))
    while True:
        onward = step.select("g", F.col("code").alias("branch"), F.col("next").alias("further"))
        now = cut(now.join(onward, ["g", "branch"]).select("g", "code", F.when(F.array_contains("seen", F.col("further")) & (F.col("further") != F.col("branch")), F.col("branch")).otherwise(F.col("further")).alias("branch"), (F.col("further") != F.col("branch")) & ~F.array_contains("seen", F.col("further")).alias("moved"), F.concat("seen", F.array("branch")).alias("seen")).toDF("g", "code", "branch", "moved", "seen"))
        if now.where("moved").isEmpty():
            return now.select("g", "code", "branch")


def units_selected(c: Catalog, req: DataFrame) -> DataFrame:
    """Units of requests (qid, g, lo, hi, units, grep, branches): by date, or with a pattern by relevance.

    A unit counts ten for each alternative that its title has and one for each of its facts with the pattern, eight at most;
    units without either are left out. ``branches`` has the alternatives. Adds ``rank`` and ``relevance``.
    """
    from engramma.functions.dates import in_window

    u = c.unit.join(req.select("qid", "g", "lo", "hi", "units", "grep", "branches"), "g").where(in_window(F.col("date"), F.col("lo"), F.col("hi")) & ((F.size("units") == 0) | F.expr("array_contains(units, id)")))
    hits = c.fact.join(req.select("qid", "g", "grep").where("grep <> ''"), "g").where(F.expr("rlike(text, concat('(?iU)', grep))")).groupBy("qid", "g", F.col("unit").alias("id")).agg(F.count("*").alias("hits"))
    u = u.join(hits, ["qid", "g", "id"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    titled = F.expr("size(filter(branches, b -> rlike(title, concat('(?iU)', b))))")
    u = u.withColumn("relevance", F.when(F.col("grep") == "", 0).otherwise(10 * titled + F.least("hits", F.lit(8)))).where("grep = '' or relevance > 0")
    return u.withColumn("rank", F.row_number().over(W.partitionBy("qid", "g").orderBy(F.col("relevance").desc(), "date", "id")))


def lines_selected(c: Catalog, req: DataFrame) -> DataFrame:
    """Lines of requests (qid, g, lo, hi, units, who, grep); speakers must be the asked ones. A request whose pattern is
    unreadable has none."""
    from engramma.functions.dates import in_window

    if "unreadable" in req.columns:
        req = req.where("not unreadable")
    j = c.line.join(req.select("qid", "g", "lo", "hi", "units", F.col("who").alias("q_who"), "grep"), "g")
    ok = ((F.size("units") == 0) | F.expr("array_contains(units, unit)")) & ((F.size("q_who") == 0) | F.expr("array_contains(q_who, who)"))
    when = ((F.col("lo") == "") & (F.col("hi") == "")) | in_window(F.col("unit_date"), F.col("lo"), F.col("hi"))
    return j.where(ok & when & ((F.col("grep") == "") | F.expr("rlike(text, concat('(?iU)', grep))"))).drop("lo", "hi", "units", "q_who", "grep")
