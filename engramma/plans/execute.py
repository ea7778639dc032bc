"""Running a plan over a catalog: the same plan for every codebook that it has, in one set of jobs."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramma.catalog import Catalog
from engramma.functions.lexical import documents, frequencies, specificity
from engramma.functions.patterns import respelled
from engramma.functions.symbols import norm_code
from engramma.operators import matching, ranking
from engramma.operators.vocabulary import resolve_entities, resolve_topics
from engramma.plans.plan import Plan, Query, Where, branches
from engramma.session import cut

EVIDENCE = "qid", "g", "type", "id", "unit", "date", "score", "seat", "bound"


@dataclass
class Result:
    """``rows``: the evidence (qid, g, type, id, unit, date, score, seat, bound); ``counts``: aggregates (qid, g, of, n)."""

    rows: DataFrame
    counts: DataFrame | None = None
    trace: list[dict] = field(default_factory=list)


def _requests(c: Catalog, w: Where, base: DataFrame) -> DataFrame:
    """A request a codebook; topics and entities are resolved in it, speakers named as entities ask for what they said."""
    req = base.select("qid", "g", *[c_ for c_ in ("units", "lo", "hi") if c_ in base.columns])
    none = F.array().cast("array<string>")
    lit = lambda values: F.array(*[F.lit(v) for v in values]) if values else none
    if w.topics:
        wanted = F.array(*[F.struct(F.lit(t).alias("surface"), F.lit(k).alias("deep")) for t, k in w.topics])
        asked = base.select("g").distinct().withColumn("t", F.explode(wanted)).select("g", "t.*")
        found = resolve_topics(c, asked).where("code is not null").join(asked, ["g", "surface"]).groupBy("g", "code").agg(F.max("deep").alias("deep"))
        found = found.groupBy("g").agg(F.sort_array(F.collect_set("code")).alias("topics"), F.sort_array(F.collect_set(F.when(~F.col("deep"), F.col("code")))).alias("exact"))
        req = req.join(found, "g", "left")
    who = lit([x.lower() for x in w.who])
    if w.entities:
        asked = base.select("g").distinct().withColumn("surface", F.explode(lit(list(w.entities))))
        spoken = c.speaker.select("g", F.col("who").alias("s"))
        named = resolve_entities(c, asked).withColumn("s", F.lower(F.coalesce("code", norm_code("surface")))).join(spoken.withColumn("speaks", F.lit(True)), ["g", "s"], "left")
        found = named.groupBy("g").agg(F.sort_array(F.collect_set(F.when(F.col("speaks").isNull(), F.col("code")))).alias("entities"), F.sort_array(F.collect_set(F.when(F.col("speaks"), F.col("s")))).alias("extra"))
        req = req.join(found, "g", "left")
        who = F.concat(who, F.coalesce("extra", none))
    req = req.withColumn("who", who)
    for n in ("obj", "place", "event", "kind"):
        req = req.withColumn(n, F.filter(F.transform(lit(list(getattr(w, n))), norm_code), lambda x: x != ""))
    if "units" not in req.columns:
        req = req.withColumn("units", lit(list(w.units)))
    for n, v in (("lo", w.time[0]), ("hi", w.time[1])):
        if n not in req.columns:
            req = req.withColumn(n, F.lit(v))
    req = req.withColumn("grep", F.lit(w.grep)).withColumn("grep_all", lit(list(w.grep_all))).withColumn("entity_kind", F.lit(w.entity_kind)).withColumn("conf_min", F.lit(w.conf_min))
    return req


def _facts(c: Catalog, q: Query, base: DataFrame, budget: int, legal: list[str] | None, pack_v2: bool, stats: dict) -> tuple[DataFrame, list[DataFrame]]:
    w = q.where
    axes = tuple(a for a in matching.AXES if getattr(w, a))
    m = matching.matched(c, _requests(c, w, base), axes, legal, bool(w.entity_kind))
    if w.topics:
        m = matching.specialised(m, budget, pack_v2)
    docs = stats.setdefault("docs", None)
    if docs is None and (w.grep or w.grep_all or any(p[0] in ("head", "tail") for p in q.pipe)):
        stats["docs"] = documents(c.fact, c.line)
        stats["idf"] = cut(frequencies(stats["docs"]))
    s = ranking.scored(c, m, stats.get("idf") if w.grep or w.grep_all else None, bool(w.entity_kind))
    spec = specificity(stats["docs"], stats["idf"]).where("type = 'fact'") if any(p[0] in ("head", "tail") for p in q.pipe) else None
    r = cut(ranking.ranked(s, spec))
    counts = []
    for step in q.pipe:
        if step[0] == "sort":
            r = ranking.sort_step(r, step[1], step[2], c.unit)
        elif step[0] == "head":
            r = ranking.head(r, step[1])
        elif step[0] == "tail":
            r = ranking.tail(r, step[1])
        else:
            counts.append(r.groupBy("qid", "g").agg(F.count("*").alias("n")).withColumn("of", F.lit("facts")))
    return r, counts


def _units(c: Catalog, q: Query, base: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    parts = [p for p in map(respelled, branches(q.where.grep)) if p] if q.where.grep else []
    none = F.array().cast("array<string>")
    req = _requests(c, q.where, base).withColumn("branches", F.array(*[F.lit(p) for p in parts]) if parts else none)
    r = ranking.units_selected(c, matching.requests(req).join(req.select("qid", "g", "branches"), ["qid", "g"])).withColumnsRenamed({"date": "eff"}).withColumn("unit", F.col("id"))
    counts = []
    for step in q.pipe:
        if step[0] == "sort":
            r = r.withColumn("_k", F.col("dur_min") if step[1] == "dur" else F.col("eff"))
            r = r.withColumn("rank", F.row_number().over(ranking.W.partitionBy("qid", "g").orderBy(F.col("_k").desc() if step[2] else F.col("_k"), "rank"))).drop("_k")
        elif step[0] == "head":
            r = ranking.head(r, step[1])
        elif step[0] == "tail":
            r = ranking.tail(r, step[1])
        else:
            counts.append(r.groupBy("qid", "g").agg(F.count("*").alias("n")).withColumn("of", F.lit("units")))
    return r, counts


def _parallel(c: Catalog, queries: tuple[Query, ...], base: DataFrame, budget: int, unit_cap: int, legal: list[str] | None, pack_v2: bool, coverage: bool) -> Result:
    rows, firsts, counts, stats = None, None, [], {}
    for i, q in enumerate(queries):
        if q.select == "facts":
            r, n = _facts(c, q, base, budget, legal, pack_v2, stats)
            one = r.select("qid", "g", F.lit("F").alias("type"), "id", "unit", F.col("eff").alias("date"), "score", "rank")
            first = one.where("rank <= 2").select("qid", "g", F.concat(F.lit("F::"), "id").alias("key"), F.lit(i).alias("sub"), "rank")
            firsts = first if firsts is None else firsts.unionByName(first)
        elif q.select == "units":
            r, n = _units(c, q, base)
            one = r.select("qid", "g", F.lit("U").alias("type"), "id", "unit", F.col("eff").alias("date"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))
        else:
            r, n = ranking.lines_selected(c, matching.requests(_requests(c, q.where, base))), []
            one = r.select("qid", "g", F.lit("L").alias("type"), "id", "unit", F.col("unit_date").alias("date"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))
        counts += n
        rows = one if rows is None else rows.unionByName(one)
    pool = cut(ranking.pooled(rows))
    if pack_v2 and coverage:
        first_topic = c.fact.where("size(topics) > 0").select("g", "id", F.element_at("topics", 1).alias("code"))
        branch = first_topic.join(ranking.branches(c), ["g", "code"], "left").select("g", "id", F.coalesce("branch", "code").alias("branch"))
        packed = ranking.packed_with_coverage(pool, branch, budget, unit_cap)
    elif pack_v2 and firsts is not None:
        packed = ranking.packed_with_quota(pool, firsts, budget, unit_cap)
    else:
        packed = ranking.packed(pool, budget, unit_cap)
    total = None
    for n in counts:
        total = n if total is None else total.unionByName(n)
    out = packed.select("qid", "g", "type", "id", "unit", "date", "score", "seat").withColumn("bound", F.lit(False))
    return Result(cut(out), total)


def execute(c: Catalog, plan: Plan, budget: int = 12, unit_cap: int = 4, legal_kinds: list[str] | None = None, pack_v2: bool = False, coverage: bool = False, qid: str = "q") -> Result:
    """The evidence of a plan in every codebook of a catalog.

    Stages run one after another; what a stage refers to is joined in from the rows of the earlier one, a codebook at a
    time, and a codebook whose reference has nothing has no rows of that stage. Rows of stages that refer to others come
    first and are marked ``bound``; rows of one record count once; all stages together have ``budget`` rows.
    """
    everywhere = c.fact.select("g").union(c.line.select("g")).union(c.unit.select("g")).distinct().withColumn("qid", F.lit(qid))
    if not plan.staged:
        return _parallel(c, plan.queries, everywhere, budget, unit_cap, legal_kinds, pack_v2, coverage)
    done: dict[str, DataFrame] = {}
    out, counts, trace = None, None, []
    for i, stage in enumerate(plan.queries):
        base, where, bound = everywhere, stage.where, False
        for ref in stage.where.units:
            if ref.startswith("$"):
                name, what = ref[1:].split(".")
                base, where, bound = base.join(_bound_units(done[name], what == "units"), "g"), replace(where, units=()), True
        for k, end in enumerate(("lo", "hi")):
            ref = stage.where.time[k]
            if ref.startswith("$"):
                top = done[ref[1:].split(".")[0]].where("first").select("g", F.col("date").alias(end)).where(f"{end} <> ''")
                base, bound = base.join(top, "g"), True
                where = replace(where, time=tuple("" if j == k else t for j, t in enumerate(where.time)))
        for k, end in enumerate(("lo", "hi")):
            if end in base.columns and where.time[1 - k] and {"lo": "hi", "hi": "lo"}[end] not in base.columns:
                base = base.withColumn({"lo": "hi", "hi": "lo"}[end], F.lit(where.time[1 - k]))
        got = _parallel(c, (replace(stage, where=where),), base, max(budget, 12), unit_cap + 2, legal_kinds, pack_v2, coverage)
        order = ranking.W.partitionBy("g").orderBy("date", "id")
        done[stage.name] = cut(got.rows.withColumn("first", F.row_number().over(order) == 1))
        rows = got.rows.withColumn("bound", F.lit(bound)).withColumn("stage", F.lit(i))
        out = rows if out is None else out.unionByName(rows)
        if got.counts is not None:
            n = got.counts.withColumn("stage", F.lit(i))
            counts = n if counts is None else counts.unionByName(n)
        trace.append({"stage": stage.name, "bound": bound})
    once = out.withColumn("_n", F.row_number().over(ranking.W.partitionBy("qid", "g", "type", "id").orderBy(F.col("bound").desc(), "stage"))).where("_n = 1")
    place = F.row_number().over(ranking.W.partitionBy("qid", "g").orderBy(F.col("bound").desc(), "stage", "date", "id"))
    rows = once.withColumn("seat", place).where(F.col("seat") <= budget).select(*EVIDENCE)
    return Result(rows, None if counts is None else counts.drop("stage"), trace)


def _bound_units(rows: DataFrame, every: bool) -> DataFrame:
    r = rows if every else rows.where("first")
    return r.groupBy("g").agg(F.sort_array(F.collect_set("unit")).alias("units"))
