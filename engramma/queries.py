"""The registered queries of the core: each takes (spark, directory of tables) and runs over whole tables.

Requests are made from the data, one a codebook, so that every query works on all codebooks at once. The SQL of the same
queries, for another engine, is in :mod:`engramma.oracles`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engramma.catalog import Catalog
from engramma.functions.lexical import average_length, documents, frequencies, specificity
from engramma.operators import channels, evidence, ingest, matching, metrics, ranking, vocabulary
from engramma.operators.hierarchy import descendants, hierarchy
from engramma.operators.moments import memory_moments, normalise_moments
from engramma.operators.nested import dialogue_turns, flat_links, haystack_turns
from engramma.oracles import ORACLES as ORACLES
from engramma.session import cut, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
FLAGSHIP = "pack_unit_cap"

# Parameters of the requests, the same in the SQL.
EVENTS = ["the_cabin_trip", "chess_openings", "volunteering"]
OBJECTS = ["the_camper_van", "two_concert_tickets", "the_office_plants"]
PATTERN, PATTERNS = "piano|ferry|kettle", ["paid|booked", "with"]
LO, HI = "2022-03", "2023-06"
LEGAL = ["event", "decision", "plan", "state", "purchase"]
# The reference's limits of a block and of a choice by tokens (the larger of its two profiles).
WHOLESALE, TOKENS = 6000, 1700


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    zones = table(spark, d, "codebook").selectExpr("codebook_id as source_id", "home_tz")
    return normalise_moments(memory_moments(table(spark, d, "fact"), table(spark, d, "locomo10"), table(spark, d, "longmemeval_s_cleaned")), zones)


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return flat_links(table(spark, d, "locomo10"), table(spark, d, "longmemeval_s_cleaned"))


@query
def p3_turns(spark: SparkSession, d: str) -> DataFrame:
    """The turns of both nested tables as one flat table."""
    talk = dialogue_turns(table(spark, d, "locomo10")).select("rec_id", F.col("session").alias("parent_key"), F.col("pos").cast("long").alias("pos"), "who", "text")
    stack = haystack_turns(table(spark, d, "longmemeval_s_cleaned")).select("rec_id", F.col("session_pos").cast("string").alias("parent_key"), F.col("turn_pos").cast("long").alias("pos"), F.col("role").alias("who"), F.col("content").alias("text"))
    return talk.unionByName(stack).distinct()


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return descendants(table(spark, d, "topic"))


@query
def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(table(spark, d, "topic"))


# --- vocabulary ----------------------------------------------------------------------------------------------------
@query
def norm_codes(spark: SparkSession, d: str) -> DataFrame:
    """Parents as written and in normal form."""
    from engramma.functions.symbols import norm_code

    return table(spark, d, "topic").select(F.explode("parents").alias("raw")).where("raw is not null").distinct().select("raw", norm_code("raw").alias("code"))


@query
def topic_children(spark: SparkSession, d: str) -> DataFrame:
    return Catalog.read(spark, d).edge


@query
def topic_closure(spark: SparkSession, d: str) -> DataFrame:
    c = Catalog.read(spark, d)
    return vocabulary.closure(c, c.topic.select("g", F.col("code").alias("root"))).withColumn("depth", F.col("depth").cast("long"))


@query
def topic_closure_narrow(spark: SparkSession, d: str) -> DataFrame:
    """Without candidates, at most five codes."""
    c = Catalog.read(spark, d)
    return vocabulary.closure(c, c.topic.select("g", F.col("code").alias("root")), depth=2, width=5, candidates=False).withColumn("depth", F.col("depth").cast("long"))


@query
def object_bridge(spark: SparkSession, d: str) -> DataFrame:
    return Catalog.read(spark, d).object_bridge()


@query
def resolve_entities(spark: SparkSession, d: str) -> DataFrame:
    """What the labels of facts resolve to."""
    c = Catalog.read(spark, d)
    return vocabulary.resolve_entities(c, c.fact.select("g", F.explode("entities").alias("surface")))


@query
def taxonomy_check(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.taxonomy_problems(Catalog.read(spark, d))


@query
def taxonomy_tree(spark: SparkSession, d: str) -> DataFrame:
    t = vocabulary.taxonomy_tree(Catalog.read(spark, d))
    return t.withColumns({"line_no": F.col("line_no").cast("long"), "depth": F.col("depth").cast("long")})


@query
def promotion_pass(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.promotion_pass(Catalog.read(spark, d))


@query
def consolidation_pressure(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.consolidation_pressure(Catalog.read(spark, d))


@query
def consolidation_candidates(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.consolidation_candidates(Catalog.read(spark, d))


@query
def entity_merge_candidates(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.entity_merge_candidates(Catalog.read(spark, d))


@query
def merge_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """Facts after merging each deprecated topic into its least parent."""
    c = Catalog.read(spark, d)
    gone = c.topic.where("status = 'deprecated'").select("g", F.col("code").alias("child")).join(c.edge, ["g", "child"])
    rewrite = gone.groupBy("g", F.col("child").alias("loser")).agg(F.min("parent").alias("winner"))
    return vocabulary.apply_rewrite(c.fact, rewrite).select("g", "id", F.array_join("topics", " ").alias("topics"))


@query
def deprecate_topics(spark: SparkSession, d: str) -> DataFrame:
    c = Catalog.read(spark, d)
    return vocabulary.deprecate_topics(c, c.topic.where("status = 'deprecated'"))[1]


@query
def merged_topic_links(spark: SparkSession, d: str) -> DataFrame:
    """The links after each candidate is merged into the least of its declared parents."""
    c = Catalog.read(spark, d)
    declared = c.edge.join(c.topic.select("g", F.col("code").alias("parent")), ["g", "parent"]).groupBy("g", F.col("child").alias("loser")).agg(F.min("parent").alias("winner"))
    return vocabulary.merge_topics(c, declared.join(c.topic.where("status = 'candidate'").select("g", F.col("code").alias("loser")), ["g", "loser"]))[1]


@query
def admission(spark: SparkSession, d: str) -> DataFrame:
    """What would become of a unit's topics if they were proposed anew, with the least parent of each: in the order of their
    codes read backwards, so that it is not theirs. Known codes are touched, those spelled anew compete for the places."""
    c = Catalog.read(spark, d)
    parent = c.edge.groupBy("g", F.col("child").alias("code")).agg(F.min("parent").alias("parent"))
    born = c.topic.where("born <> ''").select("g", F.col("born").alias("unit"), "code").join(parent, ["g", "code"], "left")
    told = born.select("g", "unit", F.reverse("code").alias("seq"), F.explode(F.array("code", F.concat("code", F.lit(" anew")))).alias("code"), F.coalesce("parent", F.lit("")).alias("parent"))
    told = told.withColumn("seq", F.concat_ws(" ", "seq", "code"))
    return vocabulary.admission(c, told, k=2)


# --- matching ------------------------------------------------------------------------------------------------------
def _roots(c: Catalog) -> DataFrame:
    """(g, topic): the least live topic of each codebook that has children."""
    return c.edge.select("g", F.col("parent").alias("code")).distinct().join(c.topic.where("status <> 'deprecated'").select("g", "code"), ["g", "code"]).groupBy("g").agg(F.min("code").alias("topic"))


def _first(c: Catalog) -> DataFrame:
    """(g, who): the least speaker of each codebook."""
    return c.speaker.groupBy("g").agg(F.min("who").alias("w"))


def _each(c: Catalog, **columns: F.Column) -> DataFrame:
    base = c.fact.select("g").distinct().join(_roots(c), "g", "left").join(_first(c), "g", "left").withColumn("qid", F.lit("q"))
    return base.select("qid", "g", *[col.alias(n) for n, col in columns.items()])


def _list(values: list[str]) -> F.Column:
    return F.array(*[F.lit(v) for v in values])


def _one(col: str) -> F.Column:
    return F.when(F.col(col).isNotNull(), F.array(col)).otherwise(F.array().cast("array<string>"))


def _matched(spark: SparkSession, d: str, axes: tuple[str, ...], typed: bool = False, legal: list[str] | None = None, **columns: F.Column) -> DataFrame:
    c = Catalog.read(spark, d)
    return matching.matched(c, _each(c, **columns), axes, legal, typed).select("g", "id", F.col("taken").cast("long").alias("taken"))


@query
def match_topic(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d, ("topics",), topics=_one("topic"))


@query
def match_topic_exact(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d, ("topics",), topics=_one("topic"), closure=F.lit(False))


@query
def match_topics_mixed(spark: SparkSession, d: str) -> DataFrame:
    """The least topic with children by itself, the greatest one with what is below it."""
    c = Catalog.read(spark, d)
    tops = c.edge.select("g", F.col("parent").alias("code")).distinct().join(c.topic.where("status <> 'deprecated'").select("g", "code"), ["g", "code"]).groupBy("g").agg(F.min("code").alias("a"), F.max("code").alias("b")).where("a <> b")
    req = tops.select(F.lit("q").alias("qid"), "g", F.array("a", "b").alias("topics"), F.array("a").alias("exact"))
    return matching.matched(c, req, ("topics",), typed=False).select("g", "id", F.col("taken").cast("long").alias("taken"))


@query
def match_unreadable_pattern(spark: SparkSession, d: str) -> DataFrame:
    """A pattern that is none is ignored where facts are asked for."""
    return _matched(spark, d, ("kind",), kind=_list(["plan", "decision"]), grep=F.lit("(piano"))


@query
def match_facets(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d, ("obj",), obj=_list(OBJECTS))


@query
def match_entity_bridge(spark: SparkSession, d: str) -> DataFrame:
    c = Catalog.read(spark, d)
    least = c.entity.where("etype = 'person'").groupBy("g").agg(F.min("code").alias("e"))
    req = least.select(F.lit("q").alias("qid"), "g", F.array("e").alias("entities"))
    return matching.matched(c, req, ("entities",), typed=False).select("g", "id", F.col("taken").cast("long").alias("taken"))


@query
def match_kind_legal(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d, ("kind",), legal=LEGAL, kind=_list(["plan", "decision"]))


@query
def match_who(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d, (), who=_one("w"))


@query
def match_time_partial(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d, (), lo=F.lit(LO), hi=F.lit(HI))


@query
def match_grep(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d, (), grep=F.lit(PATTERN))


@query
def match_grep_all(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d, (), grep_all=_list(PATTERNS))


@query
def match_entity_kind(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d, (), typed=True, entity_kind=F.lit("org"))


@query
def match_conf(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d, ("kind",), kind=_list(["plan"]), conf_min=F.lit("high"))


def _relaxed(c: Catalog) -> DataFrame:
    return _each(c, event=_list(EVENTS), obj=_list(OBJECTS), kind=_list(["plan", "decision"]), who=_one("w"), lo=F.lit(LO), hi=F.lit(HI), grep=F.lit(PATTERN))


@query
def dead_value_prune(spark: SparkSession, d: str) -> DataFrame:
    """What is left of a request's values in each codebook."""
    c = Catalog.read(spark, d)
    p = matching.prune(c, matching.requests(_each(c, event=_list(EVENTS), obj=_list(OBJECTS), topics=_one("topic"))), ("event", "obj", "topics"))
    return p.select("g", "pruned", *[F.array_join(F.sort_array(x), " ").alias(x) for x in ("event", "obj", "topics")])


@query
def relax_ladder(spark: SparkSession, d: str) -> DataFrame:
    c = Catalog.read(spark, d)
    return matching.matched(c, _relaxed(c), ("event", "obj", "kind"), typed=False).select("g", "id", F.col("taken").cast("long").alias("taken"))


@query
def specialise(spark: SparkSession, d: str) -> DataFrame:
    """The closure shrinks where a codebook has more than six budgets of matches."""
    c = Catalog.read(spark, d)
    m = matching.specialised(matching.matched(c, _each(c, topics=_one("topic")), ("topics",), typed=False), budget=1)
    return m.select("g", "id", F.col("tdepth").cast("long").alias("tdepth"), F.col("depth").cast("long").alias("depth"))


def _scored(spark: SparkSession, d: str) -> tuple[Catalog, DataFrame]:
    c = Catalog.read(spark, d)
    req = _each(c, topics=_one("topic"), event=_list(EVENTS), kind=_list(["plan", "decision"]), who=_one("w"))
    return c, ranking.scored(c, matching.matched(c, req, ("topics", "event", "kind"), typed=False), typed=False)


@query
def score_facts(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)[1].select("g", "id", F.col("taken").cast("long").alias("taken"), F.round("score", 6).alias("score"))


@query
def score_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Facts with an organisation, rarer ones higher."""
    c = Catalog.read(spark, d)
    m = matching.matched(c, _each(c, entity_kind=F.lit("org")), (), typed=True)
    return ranking.scored(c, m).select("g", "id", F.round("score", 6).alias("score"))


def _grepped(spark: SparkSession, d: str) -> tuple[Catalog, DataFrame]:
    c = Catalog.read(spark, d)
    m = matching.matched(c, _each(c, grep=F.lit(PATTERN)), (), typed=False)
    return c, ranking.scored(c, m, idf=frequencies(documents(c.fact, c.line)), typed=False)


@query
def grep_idf_score(spark: SparkSession, d: str) -> DataFrame:
    return _grepped(spark, d)[1].select("g", "id", F.round("score", 6).alias("score"))


@query
def sort_time_head(spark: SparkSession, d: str) -> DataFrame:
    """The three latest of the ranked facts; a head needs the order by content."""
    c, s = _grepped(spark, d)
    docs = documents(c.fact, c.line)
    r = ranking.ranked(s, specificity(docs, frequencies(docs)).where("type = 'fact'"))
    return ranking.head(ranking.sort_step(r, "t", desc=True), 3).select("g", "id", F.col("rank").cast("long").alias("rank"))


@query
def sort_dur_tail(spark: SparkSession, d: str) -> DataFrame:
    """Of the ranked facts, the two from the longest sessions."""
    c, s = _scored(spark, d)
    return ranking.tail(ranking.sort_step(ranking.ranked(s), "dur", unit=c.unit), 2).select("g", "id", F.col("rank").cast("long").alias("rank"))


@query
def count_facts(spark: SparkSession, d: str) -> DataFrame:
    _, s = _scored(spark, d)
    n = ranking.counted(ranking.ranked(s))
    return n.select("g", "n", F.array_join(F.transform("members", lambda m: m["id"]), " ").alias("members"))


def _unit_requests(c: Catalog) -> DataFrame:
    r = matching.requests(_each(c, grep=F.lit("garden|piano"), lo=F.lit("2021"), hi=F.lit("")))
    return r.withColumn("branches", _list(["garden", "piano"]))


@query
def select_units_grep(spark: SparkSession, d: str) -> DataFrame:
    c = Catalog.read(spark, d)
    return ranking.units_selected(c, _unit_requests(c)).select("g", "id", F.col("relevance").cast("long").alias("relevance"), F.col("rank").cast("long").alias("rank"))


@query
def count_units(spark: SparkSession, d: str) -> DataFrame:
    c = Catalog.read(spark, d)
    return ranking.units_selected(c, _unit_requests(c)).groupBy("g").agg(F.count("*").alias("n"))


@query
def select_lines(spark: SparkSession, d: str) -> DataFrame:
    c = Catalog.read(spark, d)
    return ranking.lines_selected(c, matching.requests(_each(c, who=_one("w"), lo=F.lit(LO), hi=F.lit(HI), grep=F.lit(PATTERN)))).select("g", "id", "unit")


def _pool(spark: SparkSession, d: str) -> tuple[Catalog, DataFrame, DataFrame]:
    """Two queries on facts and one on lines, pooled; and the ranked facts of the queries."""
    c, a = _scored(spark, d)
    _, b = _grepped(spark, d)
    rows = lambda r, sub: r.select("qid", "g", F.lit("F").alias("type"), "id", "unit", F.col("eff").alias("date"), "score", "rank", F.lit(sub).alias("sub"))
    facts = rows(ranking.ranked(a), 0).unionByName(rows(ranking.ranked(b), 1))
    said = ranking.lines_selected(c, matching.requests(_each(c, who=_one("w"), grep=F.lit(PATTERN))))
    lines = said.select("qid", "g", F.lit("L").alias("type"), "id", "unit", F.col("unit_date").alias("date"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"), F.lit(2).alias("sub"))
    facts = cut(facts)
    return c, cut(ranking.pooled(facts.unionByName(lines))), facts


@query
def pool_subqueries(spark: SparkSession, d: str) -> DataFrame:
    return _pool(spark, d)[1].select("g", "key", "unit", "date", F.round("score", 6).alias("score"))


def _seated(p: DataFrame) -> DataFrame:
    return p.select("g", "key", "unit", "date", F.round("score", 6).alias("score"), F.col("seat").cast("long").alias("seat"))


@query
def pack_unit_cap(spark: SparkSession, d: str) -> DataFrame:
    return _seated(ranking.packed(_pool(spark, d)[1], budget=12, unit_cap=2))


@query
def pack_quota(spark: SparkSession, d: str) -> DataFrame:
    _, pool, facts = _pool(spark, d)
    return _seated(ranking.packed_with_quota(pool, facts.withColumn("key", F.concat_ws("::", "type", "id")), budget=12, unit_cap=2))


@query
def pack_coverage(spark: SparkSession, d: str) -> DataFrame:
    c, pool, _ = _pool(spark, d)
    first = c.fact.where("size(topics) > 0").select("g", "id", F.element_at("topics", 1).alias("code"))
    branch = first.join(ranking.branches(c), ["g", "code"], "left").select("g", "id", F.coalesce("branch", "code").alias("branch"))
    return _seated(ranking.packed_with_coverage(pool, branch, budget=12, unit_cap=2))


@query
def staged_plan(spark: SparkSession, d: str) -> DataFrame:
    """Two stages: the best facts of a pattern, then the lines of their units from their earliest date on."""
    c, s = _grepped(spark, d)
    first = ranking.head(ranking.ranked(s), 2)
    bound = first.groupBy("qid", "g").agg(F.collect_set("unit").alias("units"), F.min("eff").alias("lo"))
    return ranking.lines_selected(c, matching.requests(bound)).select("g", "id", "unit")


# --- channels ------------------------------------------------------------------------------------------------------
def _questions(c: Catalog) -> DataFrame:
    """(qid, g, question): of each codebook the least line that asks something."""
    return c.line.where("text like '%?%'").groupBy("g").agg(F.min("text").alias("question")).withColumn("qid", F.lit("q"))


@query
def stem_idf(spark: SparkSession, d: str) -> DataFrame:
    c = Catalog.read(spark, d)
    return frequencies(documents(c.fact, c.line)).select("g", "stem", "df", F.round("idf", 6).alias("idf"))


@query
def document_length(spark: SparkSession, d: str) -> DataFrame:
    c = Catalog.read(spark, d)
    return average_length(documents(c.fact, c.line)).select("g", "n_docs", F.round("avg_tokens", 6).alias("avg_tokens"))


@query
def fact_specificity(spark: SparkSession, d: str) -> DataFrame:
    c = Catalog.read(spark, d)
    docs = documents(c.fact, c.line)
    return specificity(docs, frequencies(docs)).where("type = 'fact'").select("g", "id", F.round("specificity", 6).alias("specificity"))


@query
def lexical_postings(spark: SparkSession, d: str) -> DataFrame:
    c = Catalog.read(spark, d)
    hits = channels.lexical(documents(c.fact, c.line), channels.question_stems(_questions(c), 4))
    return hits.select("g", "type", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query
def lexical_plain(spark: SparkSession, d: str) -> DataFrame:
    c = Catalog.read(spark, d)
    words = _questions(c).select("qid", "g", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("question"), F.lit("([a-z]{4,})"), 1))).alias("keyword"))
    return channels.lexical_plain(c, documents(c.fact, c.line), words).select("g", "type", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _dated(c: Catalog) -> DataFrame:
    docs = documents(c.fact, c.line)
    anchors = c.unit.groupBy("g").agg(F.substring(F.min("date"), 1, 7).alias("month")).select(F.lit("q").alias("qid"), "g", F.lit("").alias("day"), "month")
    return channels.date_window(c, anchors, specificity(docs, frequencies(docs)))


@query
def date_window(spark: SparkSession, d: str) -> DataFrame:
    return _dated(Catalog.read(spark, d)).select("g", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _fused(spark: SparkSession, d: str) -> tuple[Catalog, DataFrame, DataFrame]:
    c, s = _scored(spark, d)
    plan = ranking.head(ranking.ranked(s), 40).select("qid", "g", F.lit("fact").alias("type"), "id", "unit", "score", "rank")
    words = channels.lexical(documents(c.fact, c.line), channels.question_stems(_questions(c), 4))
    dated = _dated(c).select("qid", "g", F.lit("fact").alias("type"), "id", "rank")
    plan = cut(plan)
    return c, cut(channels.fused([plan, words, dated])), plan


@query
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d)[1].select("g", "type", "id", F.round("rrf", 9).alias("rrf"), F.col("rank").cast("long").alias("rank"))


def _with_units(c: Catalog, rows: DataFrame) -> DataFrame:
    units = c.fact.select("g", F.lit("fact").alias("type"), "id", "unit", "text").unionByName(c.line.select("g", F.lit("line").alias("type"), "id", "unit", "text"))
    return rows.join(units, ["g", "type", "id"]).withColumn("cost", channels.row_cost(F.col("text"))).drop("text")


@query
def select_rows(spark: SparkSession, d: str) -> DataFrame:
    c, fused, plan = _fused(spark, d)
    rows = channels.chosen(plan.withColumn("bound", F.lit(False)), _with_units(c, fused), budget=10, unit_cap=2)
    return rows.select("g", "type", "id", F.col("seat").cast("long").alias("seat"))


@query
def select_rows_by_tokens(spark: SparkSession, d: str) -> DataFrame:
    c, fused, plan = _fused(spark, d)
    rows = channels.chosen_by_tokens(_with_units(c, plan.drop("unit")).withColumn("bound", F.lit(False)), _with_units(c, fused), cap=TOKENS, unit_cap=2)
    return rows.select("g", "type", "id", F.col("seat").cast("long").alias("seat"), F.col("cost").cast("long").alias("cost"))


@query
def recency_context(spark: SparkSession, d: str) -> DataFrame:
    c = Catalog.read(spark, d)
    seen = c.fact.where("kind = 'plan'").select(F.lit("q").alias("qid"), "g", "id")
    return channels.recency(c, seen, _each(c)).select("g", "id", F.col("rank").cast("long").alias("rank"))


# --- evidence ------------------------------------------------------------------------------------------------------
@query
def hydrate(spark: SparkSession, d: str) -> DataFrame:
    h = evidence.hydrated(Catalog.read(spark, d))
    return h.select("g", "id", "date", F.col("n_sources").cast("long").alias("n_sources"), F.array_join(F.transform("sources", lambda s: F.concat(s["id"], F.lit("="), s["text"])), "|").alias("sources"))


@query
def neighbour_context(spark: SparkSession, d: str) -> DataFrame:
    """Lines beside the sources of decisions."""
    c = Catalog.read(spark, d)
    cited = c.fact.where("kind = 'decision'").select(F.lit("q").alias("qid"), "g", F.explode("src").alias("id"))
    return evidence.neighbours(c, cited, radius=1, cap=None).select("g", "unit", "id", F.col("at").cast("long").alias("at"))


@query
def session_block(spark: SparkSession, d: str) -> DataFrame:
    """The session that most of a codebook's high-confidence decisions come from, as a dialogue of the reference's 6000 characters."""
    c = Catalog.read(spark, d)
    rows = c.fact.where("kind = 'decision' and conf = 'high'").withColumn("qid", F.lit("q")).withColumn("seat", F.row_number().over(W.partitionBy("g").orderBy("id")))
    b = evidence.session_block(c, evidence.dominant_unit(rows), limit=WHOLESALE)
    return b.select("g", "unit", "body", F.array_join("shown", " ").alias("shown"))


@query
def session_dialogues(spark: SparkSession, d: str) -> DataFrame:
    """Every session as a dialogue of the reference's 6000 characters."""
    c = Catalog.read(spark, d)
    units = c.unit.select(F.lit("q").alias("qid"), "g", F.col("id").alias("unit")).distinct()
    b = evidence.session_block(c, units, limit=WHOLESALE)
    return b.select("g", "unit", "body", F.array_join("shown", " ").alias("shown"))


@query
def spoken_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines with the label of their speaker."""
    return Catalog.read(spark, d).line.select("g", "id", evidence.spoken(F.col("who"), F.col("text")).alias("row"))


@query
def sessions_of_facts(spark: SparkSession, d: str) -> DataFrame:
    """The session that each fact's id names."""
    return Catalog.read(spark, d).fact.select("g", "id", F.array_join(metrics.pack_units(F.array("id")), " ").alias("sessions"))


@query
def stratified_questions(spark: SparkSession, d: str) -> DataFrame:
    """Twenty questions of all types, the same at every call."""
    return metrics.stratified(table(spark, d, "longmemeval_s_cleaned"), 20)


@query
def profile_block(spark: SparkSession, d: str) -> DataFrame:
    p = evidence.profile(Catalog.read(spark, d))
    return p.select("g", "topic", "id", "unit_date", "text", F.col("rank").cast("long").alias("rank"))


@query
def instance_clusters(spark: SparkSession, d: str) -> DataFrame:
    return evidence.instance_clusters(Catalog.read(spark, d)).select("g", "key", F.array_join("ids", " ").alias("ids"))


@query
def rendered_rows(spark: SparkSession, d: str) -> DataFrame:
    h = evidence.hydrated(Catalog.read(spark, d))
    row = evidence.rendered(F.col("date"), F.col("id"), F.array("unit"), F.col("text"), F.col("conf") == "high", F.transform("sources", lambda s: s["text"]))
    return h.select("g", "id", row.alias("row"))


@query
def codebook_summary(spark: SparkSession, d: str) -> DataFrame:
    return evidence.summary(Catalog.read(spark, d))


# --- ingest --------------------------------------------------------------------------------------------------------
@query
def dangling_sources(spark: SparkSession, d: str) -> DataFrame:
    return ingest.dangling_sources(Catalog.read(spark, d))


@query
def undeclared_codes(spark: SparkSession, d: str) -> DataFrame:
    return ingest.undeclared(Catalog.read(spark, d))


@query
def record_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Topic codes whose rows differ; of other tables a key never carries other content."""
    return ingest.conflicts(table(spark, d, "topic"), ["codebook_id", "code"])


@query
def facet_codes(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "fact").select("codebook_id", "id", "obj", "dur").distinct()
    return f.select("codebook_id", "id", F.array_join(ingest.facet_codes(F.col("obj")), " ").alias("obj"), ingest.duration(F.coalesce("dur", F.lit(""))).alias("dur"))


@query
def fact_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return ingest.fingerprint(Catalog.read(spark, d).fact)


# --- evaluation ----------------------------------------------------------------------------------------------------
@query
def answer_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Facts as answers, their first source lines as references; means by kind and overall."""
    c = Catalog.read(spark, d)
    f = c.fact.where("size(src) > 0").select("g", "kind", F.col("text").alias("answer"), F.element_at("src", 1).alias("line"))
    rows = f.join(c.line.select("g", F.col("id").alias("line"), F.col("text").alias("gold")), ["g", "line"])
    s = metrics.summary(rows, "kind", f1=metrics.token_f1(F.col("answer"), F.col("gold")), bleu1=metrics.bleu1(F.col("answer"), F.col("gold")))
    return s.select(F.coalesce("kind", F.lit("(all)")).alias("kind"), "n", F.round("f1", 6).alias("f1"), F.round("bleu1", 6).alias("bleu1"))


@query
def evidence_recall(spark: SparkSession, d: str) -> DataFrame:
    """How much of the evidence of long-memory questions stands among their haystack sessions."""
    t = table(spark, d, "longmemeval_s_cleaned").select("question_id", "question_type", "answer_session_ids", "haystack_session_ids").distinct()
    s = metrics.summary(t, "question_type", recall=metrics.evidence_recall(F.col("answer_session_ids"), F.col("haystack_session_ids")))
    return s.select(F.coalesce("question_type", F.lit("(all)")).alias("question_type"), "n", F.round("recall", 6).alias("recall"))


@query
def reconcile_lines(spark: SparkSession, d: str) -> DataFrame:
    """Delivered lines against the sources that facts expect."""
    c = Catalog.read(spark, d)
    have = table(spark, d, "line").select(F.col("codebook_id").alias("g"), "id")
    want = c.fact.select("g", F.explode("src").alias("id")).distinct()
    return metrics.reconciled(have, want, ["g", "id"])


@query
def telling_terms(spark: SparkSession, d: str) -> DataFrame:
    return metrics.telling_terms(Catalog.read(spark, d).fact, "g", share=0.3, least=5)
