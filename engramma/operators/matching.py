"""Facts that fit requests: filters, dead values, relaxation and specialisation, for all codebooks in one job.

A request is a row (qid, g, ...) for a codebook; many questions over many codebooks are one table of requests. Nothing is
collected: what the sequential rule decides step by step (drop dead values, relax filters one after another while nothing
fits, shrink the topic closure while too much does) is decided here by one pass with window functions, because every
step's result contains the one before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engramma.catalog import Catalog
from engramma.functions.dates import conf_rank, in_window
from engramma.functions.patterns import usable
from engramma.operators.vocabulary import closure
from engramma.session import cut

#: Filters in the order in which they are given up.
RELAX = ["grep", "event", "obj", "kind", "place", "who", "entities", "time", "topics"]
STEP = {name: i + 1 for i, name in enumerate(RELAX)}
AXES = ("topics", "entities", "obj", "place", "event", "kind")
LISTS = ("topics", "entities", "obj", "place", "event", "kind", "who", "units", "grep_all")
TEXTS = {"lo": "", "hi": "", "grep": "", "entity_kind": "", "conf_min": "low"}
NEVER = 99


def requests(df: DataFrame) -> DataFrame:
    """A request table with all columns: (qid, g) and, where absent or null, empty filters; ``closure`` is true by default.

    ``exact`` are the topics that are asked for without what is below them: those listed, or all if ``closure`` is false. A
    pattern that is none counts as absent, so that one request cannot fail the others, and ``unreadable`` tells of it.
    """
    have = set(df.columns)
    none = F.array().cast("array<string>")
    cols = [F.col("qid"), F.col("g")]
    cols += [(F.coalesce(F.array_distinct(F.col(c)), none) if c in have else none).alias(c) for c in LISTS]
    cols += [(F.coalesce(F.col(c), F.lit(d)) if c in have else F.lit(d)).alias(c) for c, d in TEXTS.items()]
    closure = F.coalesce(F.col("closure"), F.lit(True)) if "closure" in have else F.lit(True)
    exact = F.coalesce(F.col("exact"), none) if "exact" in have else none
    cols += [closure.alias("closure"), exact.alias("exact")]
    out = df.select(*cols).withColumn("exact", F.when(F.col("closure"), F.col("exact")).otherwise(F.col("topics"))).drop("closure")
    if "grep" in have:
        out = out.withColumn("_p", usable(F.col("grep"))).withColumn("unreadable", F.col("_p").isNull()).withColumn("grep", F.coalesce("_p", F.lit(""))).drop("_p")
    else:
        out = out.withColumn("unreadable", F.lit(False))
    if "grep_all" in have:
        each = out.select("qid", "g", F.explode("grep_all").alias("p")).distinct().select("qid", "g", usable(F.col("p")).alias("p")).where("p is not null")
        out = out.drop("grep_all").join(each.groupBy("qid", "g").agg(F.sort_array(F.collect_set("p")).alias("grep_all")), ["qid", "g"], "left").withColumn("grep_all", F.coalesce("grep_all", none))
    return out


def has_content() -> Column:
    """Whether a request asks for more than a speaker and a time."""
    lists = ("topics", "entities", "obj", "place", "event", "kind", "units", "grep_all")
    out = (F.col("grep") != "") | (F.col("entity_kind") != "")
    for c in lists:
        out = out | (F.size(c) > 0)
    return out


def prune(c: Catalog, req: DataFrame, axes: tuple[str, ...] = AXES) -> DataFrame:
    """Requests without dead values: codes that no fact of the codebook has.

    Adds ``had_content`` (before) and ``pruned``; a request whose content is all dead is left out. ``axes`` may name the
    ones in use, to spare the lookups of the others.
    """
    out = req.withColumn("had_content", has_content()).withColumn("pruned", F.lit(False))
    for axis in axes:
        asked = req.select("qid", "g", F.explode(axis).alias("code")).distinct()
        if axis == "topics":
            posted = c.posting("topics").select("g", "code").distinct()
            below = closure(c, asked.select("g", F.col("code").alias("root")), width=60)
            found = below.join(posted, ["g", "code"], "left_semi").select("g", F.col("root").alias("code")).distinct()
        elif axis == "entities":
            targets = c.entity_targets().withColumnRenamed("entity", "asked")
            own = asked.select("g", F.col("code").alias("asked"), F.lit("entities").alias("axis"), "code")
            posted = c.posting("entities").select("g", F.lit("entities").alias("axis"), "code").unionByName(c.posting("obj").select("g", F.lit("obj").alias("axis"), "code")).distinct()
            found = targets.unionByName(own).join(posted, ["g", "axis", "code"], "left_semi").select("g", F.col("asked").alias("code")).distinct()
        else:
            found = c.posting(axis).select("g", "code").distinct()
        live = asked.join(found, ["g", "code"], "left_semi").groupBy("qid", "g").agg(F.sort_array(F.collect_set("code")).alias("live"))
        out = out.join(live, ["qid", "g"], "left").withColumn("live", F.coalesce("live", F.array().cast("array<string>")))
        out = out.withColumn("pruned", F.col("pruned") | (F.size("live") < F.size(axis))).withColumn(axis, F.col("live")).drop("live")
    return out.where(~(F.col("had_content") & F.col("pruned")) | has_content())


def expanded(c: Catalog, req: DataFrame, axes: tuple[str, ...] = AXES) -> DataFrame:
    """Requests with what their values stand for: ``closures`` array<struct<code, codes, deep>>, ``depths`` map of code to
    depth, ``strict_depths`` the same without what is below exact topics, ``reach_entities`` and ``reach_obj``."""
    out = req
    if "topics" in axes:
        asked = req.select("qid", "g", "exact", F.explode("topics").alias("root")).select("qid", "g", "root", F.array_contains("exact", F.col("root")).alias("alone"))
        below = closure(c, asked.select("g", "root"))
        parents = c.edge.join(c.topic.select("g", F.col("code").alias("child")), ["g", "child"]).select("g", F.col("child").alias("code")).distinct().withColumn("deep", F.lit(True))
        codes = below.join(parents, ["g", "code"], "left").groupBy("g", "root").agg(F.collect_list(F.struct("code", "depth", F.coalesce("deep", F.lit(False)).alias("deep"))).alias("members"))
        each = asked.join(codes, ["g", "root"], "left").withColumn("members", F.coalesce("members", F.array(F.struct(F.col("root").alias("code"), F.lit(0).alias("depth"), F.lit(False).alias("deep")))))
        packed = F.collect_list(F.struct(F.col("root").alias("code"), F.col("members.code").alias("codes"), F.transform(F.filter("members", lambda m: m["deep"]), lambda m: m["code"]).alias("deep")))
        whole = each.groupBy("qid", "g").agg(packed.alias("closures"))
        least = each.select("qid", "g", F.explode("members").alias("m")).groupBy("qid", "g", "m.code").agg(F.min("m.depth").alias("depth")).groupBy("qid", "g").agg(F.map_from_entries(F.collect_list(F.struct("code", "depth"))).alias("depths"))
        reach = F.when(~F.col("alone") | (F.col("m.depth") == 0), F.col("m.depth"))
        strict = each.select("qid", "g", "alone", F.explode("members").alias("m")).groupBy("qid", "g", "m.code").agg(F.min(reach).alias("depth")).where("depth is not null").groupBy("qid", "g").agg(F.map_from_entries(F.collect_list(F.struct("code", "depth"))).alias("strict_depths"))
        out = out.join(whole, ["qid", "g"], "left").join(least, ["qid", "g"], "left").join(strict, ["qid", "g"], "left")
    else:
        out = out.withColumn("closures", F.lit(None).cast("array<struct<code:string,codes:array<string>,deep:array<string>>>")).withColumn("depths", F.lit(None).cast("map<string,int>")).withColumn("strict_depths", F.lit(None).cast("map<string,int>"))
    if "entities" in axes:
        asked = req.select("qid", "g", F.explode("entities").alias("entity"))
        reach = asked.join(c.entity_targets(), ["g", "entity"]).unionByName(asked.select("g", "entity", "qid", F.lit("entities").alias("axis"), F.col("entity").alias("code")))
        sets = reach.groupBy("qid", "g").agg(F.collect_set(F.when(F.col("axis") == "entities", F.col("code"))).alias("reach_entities"), F.collect_set(F.when(F.col("axis") == "obj", F.col("code"))).alias("reach_obj"))
        out = out.join(sets, ["qid", "g"], "left")
    else:
        out = out.withColumn("reach_entities", F.lit(None).cast("array<string>")).withColumn("reach_obj", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<string>")
    return out.withColumn("reach_entities", F.coalesce("reach_entities", none)).withColumn("reach_obj", F.coalesce("reach_obj", none))


def _with_facts(c: Catalog, req: DataFrame) -> DataFrame:
    named = [F.col(x).alias(f"q_{x}") for x in req.columns if x not in ("qid", "g")]
    return c.fact.join(req.select("qid", "g", *named), "g")


def first_steps(c: Catalog, req: DataFrame, legal_kinds: list[str] | None = None) -> DataFrame:
    """Every fact with every expanded request of its codebook that it fits at some step of relaxation.

    Adds ``tdepth`` (least depth at which a topic fits), ``step`` (the step at which the fact fits first, 0: unrelaxed) and
    ``most`` (the last step that the request may take).
    """
    j = _with_facts(c, req)
    empty = lambda q: F.size(q) == 0
    overlap = lambda axis: empty(f"q_{axis}") | F.arrays_overlap(axis, f"q_{axis}")
    matches = F.expr("rlike(text, concat('(?iU)', q_grep))")
    every = F.expr("forall(q_grep_all, p -> rlike(text, concat('(?iU)', p)))")
    kinds = F.expr("array_contains(q_kind, kind)")
    if legal_kinds:
        kinds = kinds | ~F.col("kind").isin(legal_kinds)
    ok = {
        "grep": ((F.col("q_grep") == "") | matches) & (empty("q_grep_all") | every),
        "event": overlap("event"),
        "obj": overlap("obj"),
        "kind": empty("q_kind") | kinds,
        "place": overlap("place"),
        "who": empty("q_who") | F.expr("array_contains(q_who, who)") | F.col("who").isin("both", "multi"),
        "entities": empty("q_entities") | F.arrays_overlap("entities", "q_reach_entities") | F.arrays_overlap("obj", "q_reach_obj"),
        "time": ((F.col("q_lo") == "") & (F.col("q_hi") == "")) | in_window(F.col("eff"), F.col("q_lo"), F.col("q_hi")),
    }
    deep = lambda m: F.array_min(F.filter(F.transform("topics", lambda t: F.element_at(m, t)), lambda d: d.isNotNull()))
    j = j.withColumn("_strict", F.when(empty("q_topics"), 0).otherwise(deep("q_strict_depths")))
    j = j.withColumn("tdepth", F.coalesce("_strict", deep("q_depths")))
    topics = F.when(F.col("tdepth").isNull(), NEVER).when(F.col("_strict").isNotNull(), 0).otherwise(STEP["topics"])
    step = F.greatest(topics, *[F.when(ok[n], 0).otherwise(STEP[n]) for n in RELAX[:-1]])
    j = j.where(empty("q_units") | F.expr("array_contains(q_units, unit)")).where(conf_rank(F.col("conf")) >= F.when(F.col("q_conf_min") == "low", 0).when(F.col("q_conf_min") == "high", 2).when(F.col("q_conf_min") == "med", 1).otherwise(0))
    return j.withColumn("step", step).withColumn("most", _most()).where(F.col("step") <= F.col("most")).drop("_strict")


def _most() -> Column:
    """The last step that a request may take.

    Topics, units and the entity type are never given up, so with one of them all steps are open. Else a request with
    content stops before its last content goes, and one of speaker and time only before it is open to all.
    """
    kept = (F.size("q_topics") > 0) | (F.size("q_units") > 0) | (F.col("q_entity_kind") != "")
    content = {"grep": (F.col("q_grep") != "") | (F.size("q_grep_all") > 0)} | {n: F.size(f"q_{n}") > 0 for n in ("event", "obj", "kind", "place", "entities")}
    last = F.greatest(F.lit(0), *[F.when(there, STEP[n]).otherwise(0) for n, there in content.items()])
    other = F.greatest(F.lit(0), F.when(F.size("q_who") > 0, STEP["who"]).otherwise(0), F.when((F.col("q_lo") != "") | (F.col("q_hi") != ""), STEP["time"]).otherwise(0))
    return F.when(kept, STEP["topics"]).when(last > 0, last - 1).when(other > 0, other - 1).otherwise(0)


def typed_only(c: Catalog, j: DataFrame) -> DataFrame:
    """Drop facts of which no entity has the asked type; ``place`` also takes facts with a place facet."""
    typed = c.entity.where("etype <> ''").select("g", F.col("code").alias("e"), F.lower("etype").alias("etype"))
    pairs = c.fact.select("g", "id", F.explode("entities").alias("e")).join(typed, ["g", "e"]).groupBy("g", "id").agg(F.collect_set("etype").alias("etypes"))
    wanted = F.lower("q_entity_kind")
    has = F.expr("exists(etypes, t -> contains(t, lower(q_entity_kind)))")
    ok = (F.col("q_entity_kind") == "") | F.coalesce(has, F.lit(False)) | ((wanted == "place") & (F.size("place") > 0))
    return j.join(pairs, ["g", "id"], "left").where(ok).drop("etypes")


def matched(c: Catalog, req: DataFrame, axes: tuple[str, ...] = AXES, legal_kinds: list[str] | None = None, typed: bool = True) -> DataFrame:
    """The facts of each request after relaxation: those that fit at the least step at which any fact of the codebook does."""
    # a few rows a codebook, made by many joins: made once
    j = first_steps(c, cut(expanded(c, cut(prune(c, requests(req), axes)), axes)), legal_kinds)
    if typed:
        j = typed_only(c, j)
    least = F.min("step").over(W.partitionBy("qid", "g"))
    return j.withColumn("taken", least).where("step = taken").drop("step")


def specialised(m: DataFrame, budget: int = 12, guard: bool = False) -> DataFrame:
    """Matched facts with the topic closure shrunk while more than six budgets of them are left.

    With ``guard`` a step that leaves fewer than the budget is not taken. Adds ``depth``, the closure depth in force.
    """
    w = W.partitionBy("qid", "g")
    n = [F.count_if(F.col("tdepth") <= d).over(w) for d in range(4)]
    m = m.withColumns({f"n{d}": x for d, x in enumerate(n)})
    depth: Column = F.lit(0)
    # from depth d on: stay if not too many, or if the next step is guarded; else go one down
    for d in (1, 2, 3):
        stay = F.col(f"n{d}") <= 6 * budget
        if guard:
            stay = stay | (F.col(f"n{d - 1}") < budget)
        depth = F.when(stay, d).otherwise(depth)
    m = m.withColumn("depth", F.when(F.size("q_topics") == 0, 3).otherwise(depth))
    return m.where(F.col("tdepth") <= F.col("depth")).drop("n0", "n1", "n2", "n3")
