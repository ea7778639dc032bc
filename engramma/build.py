"""Building a memory with a language model: plans among candidates, votes on merges, alignment of instances.

What can be decided by rule is a DataFrame operator; here are the few questions to a model, asked on the driver about bounded
lists, with answers kept in a folder by content.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramma.catalog import Catalog
from engramma.memory import Provider, ProviderFault, asked
from engramma.operators.evidence import instance_clusters
from engramma.operators.vocabulary import consolidation_candidates, settled_merges
from engramma.plans.execute import execute
from engramma.plans.plan import Plan, PlanError
from engramma.plans.questions import plan_worth

#: Pairs and clusters that a model is asked about in one call.
BATCH = 60


class Cached:
    """A provider whose answers are kept in a folder, by a digest of model and prompt. A broken entry counts as none."""

    def __init__(self, provider: Provider, folder: str, model: str = "") -> None:
        self.provider, self.folder, self.model = provider, folder, model
        os.makedirs(folder, exist_ok=True)

    def complete(self, prompt: str) -> str:
        key = hashlib.sha256(json.dumps([self.model, prompt]).encode()).hexdigest()
        path = os.path.join(self.folder, f"{key}.json")
        try:
            with open(path, encoding="utf-8") as f:
                kept = json.load(f)
            if kept["prompt"] == prompt:
                return kept["answer"]
        except (OSError, ValueError, KeyError, TypeError):
            pass
        answer = self.provider.complete(prompt)
        fd, part = tempfile.mkstemp(dir=self.folder, suffix=".part")
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            json.dump({"prompt": prompt, "answer": answer}, f, ensure_ascii=False)
        os.replace(part, path)
        return answer


def best_plan(c: Catalog, prompt: str, provider: Provider, candidates: int = 3, legal_kinds: list[str] | None = None, worth: Callable[[Plan], float] | None = None) -> Plan | None:
    """Of the plans that a provider writes, the one whose rows are worth most; of equals the first. None if none holds.

    If the best one finds nothing, the provider is asked once more and told so.
    """

    def found(plan: Plan) -> tuple[float, bool]:
        if worth is not None:
            return worth(plan), True
        r = execute(c, plan, 12, 4, legal_kinds)
        scores = [x["score"] for x in r.rows.orderBy("date", "id").select("score").collect()]
        counts = 0 if r.counts is None else r.counts.count()
        return plan_worth(plan, scores, counts), bool(scores or counts)

    def written(text: str, n: int) -> list[Plan]:
        plans = []
        for _ in range(n):
            try:
                plan = Plan.from_dict(asked(provider, text))
            except (PlanError, ProviderFault):
                continue
            if plan not in plans:
                plans.append(plan)
        return plans

    judged = [(plan, *found(plan)) for plan in written(prompt, candidates)]
    if not judged:
        return None
    best = max(judged, key=lambda x: x[1])
    if not best[2]:
        again = [(plan, *found(plan)) for plan in written(f"{prompt}\nThis plan found nothing: {json.dumps(best[0].to_dict())}\nWrite another one.", 1)]
        best = max([best, *again], key=lambda x: x[1])
    return best[0]


def _batches(items: list, n: int = BATCH) -> Iterable[list]:
    return (items[i : i + n] for i in range(0, len(items), n))


def _votes(provider: Provider, what: str, pairs: list[tuple[str, str]], voters: int = 3, needed: int = 2) -> list[tuple[str, str]]:
    """The pairs that enough of several answers call the same."""
    kept = []
    for batch in _batches(pairs):
        listed = "\n".join(f"{i}: {a} | {b}" for i, (a, b) in enumerate(batch))
        n = dict.fromkeys(range(len(batch)), 0)
        for v in range(voters):
            try:
                same = asked(provider, f'Which of these pairs of {what} mean the same? Answer {{"same": [numbers]}}. Vote {v + 1}.\n{listed}').get("same")
            except ProviderFault:
                continue
            for i in set(same) if isinstance(same, list) else ():
                if isinstance(i, int) and i in n:
                    n[i] += 1
        kept += [batch[i] for i, k in n.items() if k >= needed]
    return kept


def consolidated_topics(spark: SparkSession, c: Catalog, codebook: str, provider: Provider | None = None) -> DataFrame:
    """(g, loser, winner): what to merge among a codebook's candidate topics: by rule, then by votes, each code once.

    Only the candidate pairs of one codebook come to the driver, and only those left to vote on.
    """
    pairs = consolidation_candidates(c).where(F.col("g") == codebook)
    ruled = settled_merges(pairs)
    if provider is None:
        return ruled
    used = ruled.select("g", F.explode(F.array("loser", "winner")).alias("code")).distinct()
    open_pairs = pairs.join(used.withColumnRenamed("code", "a"), ["g", "a"], "left_anti").join(used.withColumnRenamed("code", "b"), ["g", "b"], "left_anti")
    taken: set[str] = set()
    chosen = []
    for a, b in _votes(provider, "topics", [(r["a"], r["b"]) for r in open_pairs.orderBy("a", "b").select("a", "b").collect()]):
        if not {a, b} & taken:
            taken |= {a, b}
            short, long = sorted((a, b), key=lambda x: (len(x), x))
            chosen.append((codebook, long, short))
    return ruled.unionByName(spark.createDataFrame(chosen, "g string, loser string, winner string"))


def consolidated_entities(spark: SparkSession, pairs: DataFrame, codebook: str, provider: Provider) -> DataFrame:
    """(g, loser, winner): of candidate pairs (g, a, b) of entity codes those that votes call the same; the longer code wins."""
    mine = [(r["a"], r["b"]) for r in pairs.where(F.col("g") == codebook).orderBy("a", "b").select("a", "b").collect()]
    taken: set[str] = set()
    chosen = []
    for a, b in _votes(provider, "names", mine):
        if not {a, b} & taken:
            taken |= {a, b}
            short, long = sorted((a, b), key=lambda x: (len(x), x))
            chosen.append((codebook, short, long))
    return spark.createDataFrame(chosen, "g string, loser string, winner string")


def aligned_instances(spark: SparkSession, c: Catalog, codebook: str, provider: Provider) -> DataFrame:
    """(g, id, label, kind, t, mentions): things that several facts of a codebook mention, as a provider groups candidate
    clusters; dated by their earliest mention, numbered in order, without groups that lie within another."""
    clusters = [r["ids"] for r in instance_clusters(c).where(F.col("g") == codebook).orderBy(F.size("ids").desc(), "key").select("ids").collect()]
    known = {r["id"]: r for r in c.fact.where((F.col("g") == codebook) & F.col("id").isin([i for ids in clusters for i in ids])).select("id", "text", "eff").collect()} if clusters else {}
    groups: list[tuple[str, str, tuple[str, ...]]] = []
    for batch in _batches(clusters, 12):
        listed = "\n".join(f"{n}: " + "; ".join(f"({i}) {known[i]['text'][:160]}" for i in ids) for n, ids in enumerate(batch))
        try:
            reply = asked(provider, f'Which facts of a cluster mention one and the same thing? Answer {{"instances": [{{"label": "...", "kind": "...", "mentions": ["ids"]}}]}}.\n{listed}').get("instances")
        except ProviderFault:
            continue
        allowed = [set(ids) for ids in batch]
        for g in reply if isinstance(reply, list) else ():
            ids = tuple(sorted({i for i in g.get("mentions", []) if isinstance(i, str) and i in known})) if isinstance(g, dict) and isinstance(g.get("mentions"), list) else ()
            if len(ids) > 1 and isinstance(g.get("label"), str) and g["label"].strip() and any(set(ids) <= a for a in allowed):
                groups.append((g["label"].strip(), str(g.get("kind") or "other"), ids))
    kept: list[tuple[str, str, tuple[str, ...]]] = []
    for g in sorted(groups, key=lambda g: (-len(g[2]), g[2])):
        if not any(set(g[2]) <= set(k[2]) for k in kept):
            kept.append(g)
    first = lambda ids: min((known[i]["eff"] for i in ids if known[i]["eff"]), default="")
    rows = [(codebook, f"i{n}", label, kind, first(ids), list(ids)) for n, (label, kind, ids) in enumerate(sorted(kept, key=lambda g: (first(g[2]), g[2])), 1)]
    return spark.createDataFrame(rows, "g string, id string, label string, kind string, t string, mentions array<string>")
