"""Problem 4: parent-child links become full hierarchies, by peeling leaves.

Bottom up, each round peels the links to nodes that have no open child; the round is the node's height. Then, height by
height, descendant lists, as rows, go to the parents: a list is made once, when all lists below it are whole, and read once
for each height that has parents of its nodes; its length is the size of the subtree. In reverse peel order, from the
highest nodes down, paths and depths go to the children. What peeling leaves has a circle below it or is very deep: there
the closure is made by doubling, in as many rounds as the logarithm of the depth. Nodes are numbers meanwhile, so that
little is shuffled, and lists are rows and never one array, so that a hierarchy that holds most of the table is spread over
all tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from engramma.functions.symbols import norm_code
from engramma.session import stored

#: Peeling stops after so many heights; what is deeper is closed by doubling.
HEIGHTS = 8


def links(topic: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(names, links) of a topic table: (n, g, node) numbers its nodes, (p, c) are its links, distinct.

    Rows of one code add up whatever their status. Parents are matched in normal form; null, blank and undeclared ones
    are left out. Rows with a null group or code are left out, too.
    """
    rows = topic.select(F.col("codebook_id").alias("g"), F.col("code").alias("node"), "parents").where("g is not null and node is not null")
    names = stored(rows.select("g", "node").distinct().select(F.monotonically_increasing_id().alias("n"), "g", "node", norm_code("node").alias("key")), "nodes")
    wanted = rows.select("g", "node", F.explode("parents").alias("p")).select("g", "node", norm_code("p").alias("key")).where("key <> ''").distinct()
    ends = wanted.join(names.select(F.col("n").alias("p"), "g", "key"), ["g", "key"]).join(names.select(F.col("n").alias("c"), "g", "node"), ["g", "node"])
    return names.drop("key"), stored(ends.select("p", "c").distinct(), "links")


@dataclass
class Graph:
    """Numbered nodes and links in peel order."""

    names: DataFrame  # n, g, node
    links: DataFrame  # p, c, hp, hc: heights of both ends, null where not peeled
    pairs: list[tuple[int, int]]  # the (hp, hc) that occur

    @property
    def top(self) -> int:
        return max((hp for hp, _ in self.pairs), default=0)


def numbered(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(names, links): (n, g, node), and the edges as (p, c)."""
    names = stored(nodes.select(F.monotonically_increasing_id().alias("n"), "g", "node"), "nodes")
    p, c = names.select(F.col("n").alias("p"), "g", F.col("node").alias("parent")), names.select(F.col("n").alias("c"), "g", F.col("node").alias("child"))
    return names, stored(edges.join(p, ["g", "parent"]).join(c, ["g", "child"]).select("p", "c"), "links")


def peeled(names: DataFrame, pairs: DataFrame, heights: int | None = 0) -> Graph:
    """Peel distinct links (p, c), leaves first, for ``heights`` rounds (0: HEIGHTS, None: as far as it goes)."""
    heights = HEIGHTS if heights == 0 else heights
    rounds: list[DataFrame] = []
    rest = pairs
    while heights is None or len(rounds) < heights:
        inner = rest.select(F.col("p").alias("c")).distinct().withColumn("inner", F.lit(True))
        seen = Observation()
        state = stored(rest.join(inner, "c", "left").select("p", "c", F.col("inner").isNull().alias("ripe")).observe(seen, F.count_if("ripe").alias("ripe"), F.count("*").alias("all")), "peel")
        ripe, every = seen.get["ripe"], seen.get["all"]
        rest = state.where("not ripe").select("p", "c")
        if ripe:
            rounds.append(state.where("ripe").select("p", "c", F.lit(len(rounds)).alias("hc")))
        if ripe in (0, every):
            break
    marked = reduce(DataFrame.unionByName, [*rounds, rest.withColumn("hc", F.lit(None).cast("int"))])
    # a parent is one higher than its highest child, if all its links were peeled
    high = marked.groupBy("p").agg(F.when(F.count("*") == F.count("hc"), F.max("hc") + 1).alias("hp"))
    whole = stored(marked.join(high, "p").select("p", "c", "hp", "hc"), "heights")
    found = whole.where("hp is not null").select("hp", "hc").distinct().limit(10**6).collect() if heights else [(h + 1, k) for h in range(len(rounds)) for k in range(h + 1)]
    return Graph(names, whole, sorted((r[0], r[1]) for r in found))


def closure_of(graph: Graph) -> DataFrame:
    """(a, d), distinct: every node with every one reached from it by one or more links."""
    lists: dict[int, DataFrame] = {}
    own = lambda h: graph.links.where(F.col("hp") == h).select(F.col("p").alias("a"), F.col("c").alias("d"))

    def handed(to: DataFrame, below: list[DataFrame]) -> DataFrame:
        """Links (a, d) and what the lists of their lower ends hold."""
        if not below:
            return to
        known = reduce(DataFrame.unionByName, below).select(F.col("a").alias("d"), F.col("d").alias("deep"))
        return to.unionByName(to.join(known, "d").select("a", F.col("deep").alias("d")))

    for h in range(1, graph.top + 1):
        lists[h] = stored(handed(own(h), [lists[k] for hp, k in graph.pairs if hp == h and k]).distinct(), "descendants")
    parts = list(lists.values())
    rest = graph.links.where("hp is null")
    if not rest.isEmpty():
        parts.append(_deep(rest, parts, handed))
    return reduce(DataFrame.unionByName, parts) if parts else graph.links.select(F.col("p").alias("a"), F.col("c").alias("d"))


def _deep(rest: DataFrame, lists: list[DataFrame], handed) -> DataFrame:
    """The closure of nodes that were not peeled: reach among themselves by doubling, then what is peeled below them."""
    open_ends = rest.select("p").distinct()
    among = rest.join(open_ends.withColumnRenamed("p", "c"), "c", "left_semi").select(F.col("p").alias("a"), F.col("c").alias("d"))
    reach, size = _counted(among.distinct())
    while size:
        onward = reach.select(F.col("a").alias("d"), F.col("d").alias("next"))
        reach, grown = _counted(reach.unionByName(reach.join(onward, "d").select("a", F.col("next").alias("d"))).distinct())
        if grown == size:
            break
        size = grown
    below = stored(handed(rest.join(open_ends.withColumnRenamed("p", "c"), "c", "left_anti").select(F.col("p").alias("a"), F.col("c").alias("d")), lists).distinct(), "below")
    far = reach.join(below.select(F.col("a").alias("d"), F.col("d").alias("deep")), "d").select("a", F.col("deep").alias("d"))
    return reach.unionByName(below.unionByName(far).distinct())


def _counted(pairs: DataFrame) -> tuple[DataFrame, int]:
    seen = Observation()
    out = stored(pairs.observe(seen, F.count("*").alias("n")), "reach")
    return out, seen.get["n"]


def closure(edges: DataFrame) -> DataFrame:
    """(g, ancestor, node), distinct, of distinct edges (g, parent, child): every node that is reached by one or more links."""
    nodes = edges.select("g", F.col("parent").alias("node")).union(edges.select("g", F.col("child").alias("node"))).distinct()
    names, pairs = numbered(nodes, edges)
    return _named(names, closure_of(peeled(names, pairs)))


def _named(names: DataFrame, pairs: DataFrame) -> DataFrame:
    a, d = names.select(F.col("n").alias("a"), "g", F.col("node").alias("ancestor")), names.select(F.col("n").alias("d"), "node")
    return pairs.join(a, "a").join(d, "d").select("g", "ancestor", "node")


def descendants(topic: DataFrame) -> DataFrame:
    """(codebook_id, ancestor, code): each code with each code reached from it by one or more parent links.

    A code on a circle is its own ancestor. An empty table gives an empty result; repeated rows change nothing; extra
    columns are ignored.
    """
    names, pairs = links(topic)
    return _named(names, closure_of(peeled(names, pairs))).select(F.col("g").alias("codebook_id"), "ancestor", F.col("node").alias("code"))


def hierarchy(topic: DataFrame) -> DataFrame:
    """(codebook_id, code, root, path, depth, on_circle, n_descendants): a row for each path from a root to a node.

    A path is the ``/``-joined codes from its root; depth counts its links. A node on a circle starts a path of its own
    (it is that path's root and is marked on_circle), since a path through a circle has no end; paths do not enter it. A
    node with several parents has a row for each way to it, so there are as many rows as the links have ways.
    """
    names, pairs = links(topic)
    graph = peeled(names, pairs)
    below = stored(closure_of(graph), "closure")
    circle = stored(below.where("a = d").select(F.col("a").alias("n")), "circles")
    sizes = below.groupBy(F.col("a").alias("n")).agg(F.count("*").alias("n_descendants"))
    if not graph.links.where("hp is null").isEmpty():
        # without the links into circles everything can be peeled
        graph = peeled(names, pairs.join(circle.withColumnRenamed("n", "c"), "c", "left_anti"), None)
    ends = graph.links.select(F.col("c").alias("n")).distinct()
    named = names.select("n", "node")
    row = "n", "root", "path", "depth"
    tops = names.join(ends, "n", "left_anti").select("n", F.col("node").alias("root"), F.col("node").alias("path"), F.lit(0).alias("depth"))
    height = graph.links.select(F.col("p").alias("n"), F.col("hp").alias("h")).distinct()
    # the paths of roots by their height, then of each lower height from those above
    start = stored(tops.join(height, "n", "left").select(*row, F.coalesce("h", F.lit(0)).alias("h")), "roots")
    made: dict[int, DataFrame] = {}
    for h in range(graph.top, -1, -1):
        above = [made[hp].withColumn("hp", F.lit(hp)) for hp, hc in graph.pairs if hc == h and hp in made]
        here = start.where(F.col("h") == h).select(*row)
        if above:
            come = graph.links.where(F.col("hc") == h).select(F.col("p").alias("n"), F.col("c")).join(reduce(DataFrame.unionByName, above).drop("hp"), "n")
            come = come.select(F.col("c").alias("n"), "root", "path", "depth").join(named, "n")
            here = here.unionByName(come.select("n", "root", F.concat_ws("/", "path", "node").alias("path"), (F.col("depth") + 1).alias("depth")))
        made[h] = stored(here, "paths")
    out = reduce(DataFrame.unionByName, made.values()).join(names, "n").join(circle.withColumn("on_circle", F.lit(True)), "n", "left").join(sizes, "n", "left")
    return out.select(
        F.col("g").alias("codebook_id"), F.col("node").alias("code"), "root", "path", "depth",
        F.coalesce("on_circle", F.lit(False)).alias("on_circle"), F.coalesce("n_descendants", F.lit(0)).alias("n_descendants"),
    )
