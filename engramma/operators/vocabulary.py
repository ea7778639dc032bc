"""Taxonomy and vocabulary operators over all codebooks at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engramma.catalog import Catalog
from engramma.session import cut, stored

#: Codes of a codebook up to which merge candidates are sought among all its pairs.
PAIRS_MAX = 1000
#: Triples of characters in large codebooks, a row each, up to which they are sent to every worker; beyond, a shuffle join.
TRIPLES_MAX = 200_000
_TRIPLES = 1 << 24


def closure(c: Catalog, seeds: DataFrame, depth: int = 3, width: int = 40, candidates: bool = True) -> DataFrame:
    """(g, root, code, depth): each seed (g, root) with its descendants, at most ``width`` codes, the root among them.

    Breadth first, a level in code order; where a level does not fit, it is cut and the search ends. Deprecated topics
    never count, candidates only if asked. Undeclared seeds have no closure. The search is bounded by ``depth``, so links
    in circles do no harm.
    """
    live = c.topic.where((F.col("status") != "deprecated") & (F.lit(candidates) | (F.col("status") != "candidate"))).select("g", F.col("code").alias("child"))
    edges = c.edge.join(live, ["g", "child"])
    front = seeds.select("g", "root").distinct().join(c.topic.select("g", F.col("code").alias("root")), ["g", "root"]).select("g", "root", F.col("root").alias("code"), F.lit(0).alias("depth"))
    levels = [front]
    for d in range(1, depth + 1):
        step = levels[-1].select("g", "root", F.col("code").alias("parent")).join(edges, ["g", "parent"]).select("g", "root", F.col("child").alias("code")).distinct()
        levels.append(step.withColumn("depth", F.lit(d)))
    first = reduce(DataFrame.unionByName, levels).groupBy("g", "root", "code").agg(F.min("depth").alias("depth"))
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("g", "root").orderBy("depth", "code")))
    return ranked.where(F.col("rank") <= max(1, width)).drop("rank")


def resolve_topics(c: Catalog, surfaces: DataFrame, topic_alias: DataFrame | None = None) -> DataFrame:
    """(g, surface, code): a live code in normal form, else what an alias (g, surface, code) says, else null."""
    from engramma.functions.symbols import norm_code

    s = surfaces.select("g", "surface").distinct().withColumn("key", norm_code("surface"))
    live = c.topic.where("status <> 'deprecated'").select("g", F.col("code").alias("key"), F.lit(True).alias("live"))
    out = s.join(live, ["g", "key"], "left")
    if topic_alias is None:
        return out.select("g", "surface", F.when(F.col("live"), F.col("key")).alias("code"))
    told = topic_alias.groupBy("g", F.col("surface").alias("key")).agg(F.min("code").alias("told"))
    return out.join(told, ["g", "key"], "left").select("g", "surface", F.when(F.col("live"), F.col("key")).otherwise(F.col("told")).alias("code"))


def resolve_entities(c: Catalog, surfaces: DataFrame) -> DataFrame:
    """(g, surface, code): a code in normal form, else what an alias says, else null; the least code of a shared alias."""
    from engramma.functions.symbols import norm_code

    s = surfaces.select("g", "surface").distinct().withColumn("key", norm_code("surface"))
    known = c.entity.select("g", F.col("code").alias("key"), F.lit(True).alias("known"))
    told = c.alias.groupBy("g", F.col("surface").alias("key")).agg(F.min("code").alias("told"))
    return s.join(known, ["g", "key"], "left").join(told, ["g", "key"], "left").select("g", "surface", F.when(F.col("known"), F.col("key")).otherwise(F.col("told")).alias("code"))


def related(rels: DataFrame, of: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(g, code, other): the neighbours of (g, code) over relations (g, src, rel, dst) in either direction."""
    r = rels if types is None else rels.where(F.col("rel").isin(types))
    both = r.select("g", F.col("src").alias("code"), F.col("dst").alias("other")).unionByName(r.select("g", F.col("dst").alias("code"), F.col("src").alias("other")))
    return of.select("g", "code").distinct().join(both, ["g", "code"]).distinct()


def usage(c: Catalog) -> DataFrame:
    """(g, code, unit, bucket): the units that use a topic, with their month."""
    return c.fact.select("g", F.explode("topics").alias("code"), "unit", F.substring("unit_date", 1, 7).alias("bucket")).distinct()


def promotion_pass(c: Catalog, units: int = 3, buckets: int = 2) -> DataFrame:
    """(g, code, n_units, n_buckets): candidates used by enough units in enough months; they become canonical."""
    used = usage(c).groupBy("g", "code").agg(F.countDistinct("unit").alias("n_units"), F.countDistinct("bucket").alias("n_buckets"))
    return c.topic.where("status = 'candidate'").select("g", "code").join(used, ["g", "code"]).where((F.col("n_units") >= units) & (F.col("n_buckets") >= buckets))


def consolidation_pressure(c: Catalog, pool_max: int = 60) -> DataFrame:
    """(g, n_candidates, pressed)."""
    return c.topic.groupBy("g").agg(F.count_if(F.col("status") == "candidate").alias("n_candidates")).withColumn("pressed", F.col("n_candidates") > pool_max)


def consolidation_candidates(c: Catalog, min_shared: int = 2) -> DataFrame:
    """(g, a, b), a < b: candidates with a common parent that share units, or of which one begins or ends with the other."""
    cand = c.topic.where("status = 'candidate'").select("g", F.col("code").alias("child"))
    under = c.edge.join(cand, ["g", "child"])
    a, b = under.toDF("g", "a", "parent"), under.toDF("g", "b", "parent")
    pairs = a.join(b, ["g", "parent"]).where("a < b").select("g", "a", "b").distinct()
    used = usage(c).select("g", "code", "unit").distinct()
    shared = pairs.join(used.toDF("g", "a", "unit"), ["g", "a"]).join(used.toDF("g", "b", "unit"), ["g", "b", "unit"]).groupBy("g", "a", "b").agg(F.count("*").alias("shared"))
    affix = F.startswith("a", F.col("b")) | F.startswith("b", F.col("a")) | F.endswith("a", F.col("b")) | F.endswith("b", F.col("a"))
    return pairs.join(shared, ["g", "a", "b"], "left").where((F.coalesce("shared", F.lit(0)) >= min_shared) | affix).select("g", "a", "b")


def entity_merge_candidates(c: Catalog, min_len: int = 2) -> DataFrame:
    """(g, a, b), a < b: codes without digits of which one contains the other (three characters at least), or that differ
    in one character.

    The pairs of a codebook of at most ``PAIRS_MAX`` codes are all compared, so that its codes are shuffled once; larger
    ones go through keys. Keys are many rows a code, which the planner takes to be as small as the codes they are made
    from; joins of them are never left to it.
    """
    codes = stored(c.entity.where(~F.col("code").rlike(r"\d") & (F.length("code") >= min_len)).select("g", "code", F.length("code").alias("size")), "merge_codes")
    large = stored(codes.groupBy("g").count().where(F.col("count") > PAIRS_MAX).select("g"), "merge_large")
    if large.isEmpty():
        return _compared(codes)
    return _compared(codes.join(large, "g", "left_anti")).unionByName(_keyed(codes.join(large, "g", "left_semi")))


def _compared(codes: DataFrame) -> DataFrame:
    """(g, a, b): the merge candidates among codes (g, code, size), of all pairs of a codebook."""
    a, b = codes.toDF("g", "a", "size_a"), codes.toDF("g", "b", "size_b")
    held = lambda short, long: (F.col(f"size_{short}") >= 3) & F.contains(F.col(long), F.col(short))
    # of strings of one length those at edit distance 1 differ in one place
    like = F.when(F.col("size_a") < F.col("size_b"), held("a", "b")).when(F.col("size_a") > F.col("size_b"), held("b", "a")).otherwise(F.levenshtein("a", "b", 1) == 1)
    return a.join(b.hint("merge"), "g").where((F.col("a") < F.col("b")) & like).select("g", "a", "b").distinct()


def _keyed(codes: DataFrame) -> DataFrame:
    """What :func:`_compared` finds, without all pairs: codes that differ in one place have two thirds in common, and a code
    that contains another has its rarest three characters."""
    return _near(codes).unionByName(_held(codes)).distinct()


def _near(codes: DataFrame) -> DataFrame:
    """(g, a, b): codes that differ in one character. Those that are equal without a third of them are compared; where
    these are more than ``PAIRS_MAX``, they are equal without one place of that third."""
    thirds = codes.select("g", "code", "size", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("third"))
    before, upto = ((F.floor(F.col("size") * (F.col("third") + k) / 3)).cast("int") for k in (0, 1))
    without = lambda lo, hi: (F.substring("code", F.lit(1), lo), F.substring("code", hi + 1, F.col("size")))
    keyed = thirds.where(before < upto).withColumn("key", F.xxhash64("g", "size", "third", *without(before, upto)))
    crowd = stored(keyed.groupBy("key").count().where(F.col("count") > PAIRS_MAX).select("key"), "merge_crowd")
    crowded = not crowd.isEmpty()
    calm = keyed.join(crowd, "key", "left_anti") if crowded else keyed
    a, b = (calm.select("g", "key", F.col("code").alias(x), F.col("size").alias(f"size_{x}")) for x in "ab")
    near = a.join(b.hint("merge"), ["g", "key"]).where((F.col("a") < F.col("b")) & (F.col("size_a") == F.col("size_b")) & (F.levenshtein("a", "b", 1) == 1)).select("g", "a", "b")
    if not crowded:
        return near
    masks = F.transform(F.sequence(before + 1, upto), lambda i: F.concat_ws("\u0000", i.cast("string"), *without(i - 1, i)))
    masked = keyed.join(crowd, "key", "left_semi").select("g", "code", F.explode(masks).alias("rest"))
    equal = masked.toDF("g", "a", "rest").join(masked.toDF("g", "b", "rest").hint("merge"), ["g", "rest"]).where("a < b and length(a) = length(b)").select("g", "a", "b")
    return near.unionByName(equal)


def _held(codes: DataFrame) -> DataFrame:
    """(g, a, b): codes of which one contains the other; the shorter has three characters at least.

    Triples are numbers of 24 bits, which a few may share. A code is looked for by its rarest one, and among the triples
    of all codes only by those that some code is looked for by.
    """
    triples = F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("size") - 2), lambda i: F.xxhash64(F.substring("code", i, F.lit(3))).bitwiseAND(F.lit(_TRIPLES - 1))))
    grams = codes.where("size >= 3").select("g", "code", F.explode(triples).alias("gram"))
    rarity = stored(grams.groupBy("g", "gram").agg(F.count("*").alias("n")), "merge_rarity")
    how = "broadcast" if rarity.count() <= TRIPLES_MAX else "merge"
    rarest = stored(grams.join(rarity.hint(how), ["g", "gram"]).groupBy("g", "code").agg((F.min(F.col("n") * _TRIPLES + F.col("gram")) % _TRIPLES).alias("gram")), "merge_rarest")
    sought = stored(rarest.select("g", "gram").distinct(), "merge_sought")
    long = grams.join(sought.hint(how), ["g", "gram"], "left_semi").select("g", "gram", F.col("code").alias("long"))
    found = rarest.withColumnRenamed("code", "short").join(long.hint("merge"), ["g", "gram"]).where("octet_length(short) < octet_length(long) and contains(long, short)")
    return found.select("g", F.least("short", "long").alias("a"), F.greatest("short", "long").alias("b"))


def taxonomy_problems(c: Catalog) -> DataFrame:
    """(g, problem, code, other): missing parents, candidates without parent, and topics on a circle."""
    from engramma.operators.hierarchy import closure as reached

    known = c.topic.select("g", F.col("code").alias("parent"))
    missing = c.edge.join(known, ["g", "parent"], "left_anti").select("g", F.lit("missing parent").alias("problem"), F.col("child").alias("code"), F.col("parent").alias("other"))
    childless = c.edge.select("g", F.col("child").alias("code")).distinct()
    orphan = c.topic.where("status = 'candidate'").join(childless, ["g", "code"], "left_anti").select("g", F.lit("orphan candidate").alias("problem"), "code", F.lit("").alias("other"))
    done = reached(c.edge.join(known, ["g", "parent"]).select("g", "parent", "child"))
    circle = done.where("ancestor = node").select("g", F.lit("on a circle").alias("problem"), F.col("node").alias("code"), F.lit("").alias("other"))
    return missing.unionByName(orphan).unionByName(circle)


def taxonomy_tree(c: Catalog, max_lines: int = 200, candidates: bool = True) -> DataFrame:
    """(g, line_no, depth, code, mark): the taxonomy in pre-order, children in code order, under each of their parents.

    Deprecated topics and what is below them are left out, candidates are marked ``?``. A path that meets itself ends.
    """
    live = c.topic.where((F.col("status") != "deprecated") & (F.lit(candidates) | (F.col("status") != "candidate"))).select("g", "code", "status")
    edges = cut(c.edge.join(live.select("g", F.col("code").alias("child")), ["g", "child"]))
    tops = live.join(c.edge.select("g", F.col("child").alias("code")).distinct(), ["g", "code"], "left_anti")
    now = cut(tops.select("g", "code", F.array("code").alias("path")))
    levels = [now]
    while not now.isEmpty():
        step = now.withColumnRenamed("code", "parent").join(edges, ["g", "parent"]).where(~F.array_contains("path", F.col("child")))
        now = cut(step.select("g", F.col("child").alias("code"), F.concat("path", F.array("child")).alias("path")))
        levels.append(now)
    every = reduce(DataFrame.unionByName, levels).join(live, ["g", "code"])
    numbered = every.withColumn("line_no", F.row_number().over(W.partitionBy("g").orderBy("path")))
    return numbered.where(F.col("line_no") <= max_lines).select("g", "line_no", (F.size("path") - 1).alias("depth"), "code", F.when(F.col("status") == "candidate", "?").otherwise("").alias("mark"))


def admission(c: Catalog, proposals: DataFrame, k: int = 5, topic_alias: DataFrame | None = None) -> DataFrame:
    """(g, unit, seq, code, parent, outcome): what becomes of proposals (g, unit, seq, code, parent) in their order.

    ``touched``: the code is known, or an earlier proposal took it; ``rejected``: it is blank, or its parent is unknown;
    ``admitted``: one of the first ``k`` new topics of its unit; ``folded``: beyond these, its parent is touched instead.
    Codes and parents are in normal form, or what an alias says. A parent must be declared before the proposals.
    """
    from engramma.functions.symbols import norm_code

    p = proposals.select("g", "unit", "seq", norm_code("code").alias("code"), norm_code("parent").alias("parent"))
    names = p.select("g", F.col("code").alias("surface")).union(p.select("g", F.col("parent").alias("surface"))).where("surface <> ''").distinct()
    known = resolve_topics(c, names, topic_alias).where("code is not null").select("g", "surface", F.col("code").alias("real"))
    p = p.join(known.withColumnRenamed("surface", "code").withColumnRenamed("real", "own"), ["g", "code"], "left")
    p = p.join(known.withColumnRenamed("surface", "parent").withColumnRenamed("real", "above"), ["g", "parent"], "left")
    fresh = (F.col("code") != "") & F.col("own").isNull() & F.col("above").isNotNull()
    # of the proposals of one new code the first in its unit that is admitted makes it, the later ones touch it
    first = F.row_number().over(W.partitionBy("g", "unit", "code", fresh).orderBy("seq")) == 1
    p = p.withColumn("new", fresh & first)
    rank = F.sum(F.col("new").cast("int")).over(W.partitionBy("g", "unit").orderBy("seq"))
    p = p.withColumn("admitted", F.col("new") & (rank <= k))
    made = F.max("admitted").over(W.partitionBy("g", "unit", "code"))
    outcome = F.when(F.col("own").isNotNull(), "touched").when(~fresh, "rejected").when(F.col("admitted"), "admitted").when(made & ~F.col("new"), "touched").otherwise("folded")
    return p.select("g", "unit", "seq", F.coalesce("own", "code").alias("code"), F.coalesce("above", "parent").alias("parent"), outcome.alias("outcome"))


def define_roots(c: Catalog, codes: DataFrame) -> DataFrame:
    """The topic table with roots (g, code) declared: canonical topics without a parent; known codes stay as they are."""
    from engramma.functions.symbols import norm_code

    new = codes.select("g", norm_code("code").alias("code")).where("code <> ''").distinct().join(c.topic.select("g", "code"), ["g", "code"], "left_anti")
    return c.topic.unionByName(new.select("g", "code", F.lit("canonical").alias("status"), F.lit("").alias("born")))


def aliased(c: Catalog, told: DataFrame, known: DataFrame) -> DataFrame:
    """The aliases (g, surface, code) that (g, surface, code) adds: in normal form, of codes in ``known`` (g, code) only; a
    surface that is itself a code, or is told of two codes, is left out."""
    from engramma.functions.symbols import norm_code

    t = told.select("g", norm_code("surface").alias("surface"), norm_code("code").alias("code")).where("surface <> '' and surface <> code").distinct()
    t = t.join(known.select("g", "code").distinct(), ["g", "code"], "left_semi").join(known.select("g", F.col("code").alias("surface")).distinct(), ["g", "surface"], "left_anti")
    return t.groupBy("g", "surface").agg(F.min("code").alias("code"), F.countDistinct("code").alias("n")).where("n = 1").drop("n")


def merge_entities(c: Catalog, rewrite: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity, alias) after merging (g, loser, winner): a loser's code and aliases become aliases of its winner."""
    r = rewrite.select("g", "loser", "winner").where("loser <> winner").distinct()
    entity = c.entity.join(r.select("g", F.col("loser").alias("code")), ["g", "code"], "left_anti")
    moved = c.alias.join(r.withColumnRenamed("loser", "code"), ["g", "code"], "left").select("g", "surface", F.coalesce("winner", "code").alias("code"))
    return entity, moved.unionByName(r.select("g", F.col("loser").alias("surface"), F.col("winner").alias("code"))).where("surface <> code").distinct()


def relate(c: Catalog, told: DataFrame) -> DataFrame:
    """(g, src, rel, dst), distinct: relations between known entities; their ends are resolved, loops are left out."""
    ends = lambda col: resolve_entities(c, told.select("g", F.col(col).alias("surface"))).where("code is not null").select("g", F.col("surface").alias(col), F.col("code").alias(f"{col}_code"))
    both = told.select("g", "src", "rel", "dst").join(ends("src"), ["g", "src"]).join(ends("dst"), ["g", "dst"])
    return both.where("src_code <> dst_code and rel <> ''").select("g", F.col("src_code").alias("src"), "rel", F.col("dst_code").alias("dst")).distinct()


def merge_topics(c: Catalog, rewrite: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(topic, edge) after merging: ``rewrite`` has (g, loser, winner); children of a loser hang below its winner."""
    r = rewrite.select("g", "loser", "winner").distinct()
    topic = c.topic.join(r.select("g", F.col("loser").alias("code")), ["g", "code"], "left_anti")
    as_parent, as_child = r.toDF("g", "parent", "to_parent"), r.toDF("g", "child", "to_child")
    edge = c.edge.join(as_child, ["g", "child"], "left").where("to_child is null").drop("to_child").join(as_parent, ["g", "parent"], "left")
    edge = edge.select("g", F.coalesce("to_parent", "parent").alias("parent"), "child").where("parent <> child").distinct()
    return topic, edge


def deprecate_topics(c: Catalog, codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(topic, edge) after deprecating (g, code): children inherit their grandparents; own parents are kept."""
    gone = codes.select("g", "code").distinct()
    topic = c.topic.join(gone.withColumn("gone", F.lit(True)), ["g", "code"], "left").select("g", "code", F.when(F.col("gone"), "deprecated").otherwise(F.col("status")).alias("status"), "born")
    below = c.edge.join(gone.select("g", F.col("code").alias("parent")), ["g", "parent"], "left_semi")
    kept = c.edge.join(gone.select("g", F.col("code").alias("parent")), ["g", "parent"], "left_anti")
    above = c.edge.select("g", F.col("child").alias("mid"), F.col("parent").alias("top"))
    lifted = below.select("g", F.col("parent").alias("mid"), "child").join(above, ["g", "mid"]).select("g", F.col("top").alias("parent"), "child")
    return topic, kept.unionByName(lifted).distinct()


def apply_rewrite(fact: DataFrame, rewrite: DataFrame, axis: str = "topics") -> DataFrame:
    """Facts with the codes of one axis rewritten by (g, loser, winner); codes that become equal are kept once, in order."""
    maps = rewrite.groupBy("g").agg(F.map_from_entries(F.collect_set(F.struct("loser", "winner"))).alias("m"))
    new = F.array_distinct(F.transform(axis, lambda x: F.coalesce(F.element_at("m", x), x)))
    return fact.join(maps, "g", "left").withColumn(axis, F.when(F.col("m").isNull(), F.col(axis)).otherwise(new)).drop("m")


def register_entities(c: Catalog, surfaces: DataFrame) -> DataFrame:
    """The entity table with (g, surface, etype) registered: unknown ones are added, an empty type is filled, never changed."""
    from engramma.functions.symbols import norm_code

    named = resolve_entities(c, surfaces).join(surfaces, ["g", "surface"]).select("g", F.coalesce("code", norm_code("surface")).alias("code"), F.coalesce("etype", F.lit("")).alias("new"), "surface").where("code <> ''")
    new = named.groupBy("g", "code").agg(F.max("new").alias("new"), F.min(F.trim("surface")).alias("surface"))
    return c.entity.join(new, ["g", "code"], "full_outer").select("g", "code", F.coalesce(F.nullif("etype", F.lit("")), "new", F.lit("")).alias("etype"), F.coalesce("name", "surface").alias("name"))


def move_topic(c: Catalog, moves: DataFrame) -> DataFrame:
    """The links after (g, code, parents) got new parents. Raises ValueError where a parent is unknown or a circle would close."""
    from engramma.operators.hierarchy import closure as reached

    new = moves.select("g", F.col("code").alias("child"), F.explode("parents").alias("parent")).distinct()
    unknown = new.join(c.topic.select("g", F.col("code").alias("parent")), ["g", "parent"], "left_anti").limit(3).collect()
    if unknown:
        raise ValueError(f"unknown parents: {[r['parent'] for r in unknown]}")
    edges = c.edge.join(moves.select("g", F.col("code").alias("child")), ["g", "child"], "left_anti").select("g", "parent", "child").unionByName(new.select("g", "parent", "child"))
    moved = reached(edges).where("ancestor = node").join(moves.select("g", F.col("code").alias("node")), ["g", "node"], "left_semi").limit(3).collect()
    if moved:
        raise ValueError(f"a circle would close at {[r['node'] for r in moved]}")
    return edges


def with_ancestors(c: Catalog, assigned: DataFrame, depth: int = 16) -> DataFrame:
    """(g, id, topics): topics (g, id, topics) with their ancestors along the least parent, after them, each once."""
    up = c.edge.join(c.topic.select("g", F.col("code").alias("parent")), ["g", "parent"]).groupBy("g", F.col("child").alias("code")).agg(F.min("parent").alias("up"))
    now = assigned.select("g", "id", F.posexplode(F.array_distinct("topics")).alias("p", "code")).withColumn("d", F.lit(0))
    levels = [now]
    for d in range(1, depth + 1):
        now = cut(now.join(up, ["g", "code"]).select("g", "id", "p", F.col("up").alias("code"), F.lit(d).alias("d")))
        if now.isEmpty():
            break
        levels.append(now)
    every = reduce(DataFrame.unionByName, levels)
    return every.groupBy("g", "id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("d", "p", "code"))), lambda x: x["code"])).alias("topics"))


def settled_merges(pairs: DataFrame) -> DataFrame:
    """(g, loser, winner): of candidate pairs (g, a, b) those that need no vote: one code begins or ends with the other and not
    both have digits; the shorter wins, and a code takes part in one merge only, in the order of codes.

    Where pairs meet, the least pair is taken and its neighbours wait, round by round.
    """
    short = (F.length("a") < F.length("b")) | ((F.length("a") == F.length("b")) & (F.col("a") < F.col("b")))
    affix = F.startswith("a", F.col("b")) | F.startswith("b", F.col("a")) | F.endswith("a", F.col("b")) | F.endswith("b", F.col("a"))
    open_pairs = cut(pairs.where(affix & ~(F.col("a").rlike(r"\d") & F.col("b").rlike(r"\d"))).select("g", "a", "b").distinct())
    taken = []
    while not open_pairs.isEmpty():
        ends = open_pairs.select("g", F.explode(F.array("a", "b")).alias("code"), F.struct("a", "b").alias("pair")).groupBy("g", "code").agg(F.min("pair").alias("least"))
        at = lambda s: ends.select("g", F.col("code").alias(s), F.col("least").alias(f"l{s}"))
        now = cut(open_pairs.join(at("a"), ["g", "a"]).join(at("b"), ["g", "b"]).where((F.col("la") == F.struct("a", "b")) & (F.col("lb") == F.struct("a", "b"))).select("g", "a", "b"))
        taken.append(now)
        used = now.select("g", F.explode(F.array("a", "b")).alias("code")).distinct()
        open_pairs = cut(open_pairs.join(used.withColumnRenamed("code", "a"), ["g", "a"], "left_anti").join(used.withColumnRenamed("code", "b"), ["g", "b"], "left_anti").select("g", "a", "b"))
    every = reduce(DataFrame.unionByName, taken) if taken else open_pairs
    return every.select("g", F.when(short, F.col("b")).otherwise(F.col("a")).alias("loser"), F.when(short, F.col("a")).otherwise(F.col("b")).alias("winner"))
