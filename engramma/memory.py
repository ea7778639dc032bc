"""The application's view of one memory: load, remember, recall, answer.

A memory is a folder of Parquet tables (or codebook XML to read from). Language-model calls stay behind one protocol,
``Provider``; without a provider everything but extraction, plan writing and answering works.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramma.catalog import Catalog
from engramma.functions.lexical import documents, frequencies, specificity
from engramma.operators import channels, evidence, ingest, vocabulary
from engramma.plans import questions
from engramma.plans.execute import execute
from engramma.plans.plan import Plan, PlanError
from engramma.session import cut, table

KINDS = ["fact", "event", "plan", "preference", "decision", "state", "other"]
EVENTS = ["birth", "wedding", "travel", "move", "competition", "meeting", "purchase", "illness", "graduation", "job_change", "party", "performance", "class", "repair", "visit"]
TABLES = ("codebook", "unit", "line", "fact", "topic", "entity")


class MemoryFault(Exception):
    """The root of this module's errors."""


class ConfigurationFault(MemoryFault):
    """A call that cannot be meant."""


class StorageFault(MemoryFault):
    """A memory that cannot be read or would be broken by writing."""


class ProviderFault(MemoryFault):
    """A language model that failed."""


class Provider(Protocol):
    def complete(self, prompt: str) -> str: ...


@dataclass
class Scripted:
    """A provider that gives prepared answers in turn, for tests."""

    answers: list[str]
    prompts: list[str] = field(default_factory=list)

    def complete(self, prompt: str) -> str:
        self.prompts.append(prompt)
        if not self.answers:
            raise ProviderFault("no answer is left")
        return self.answers.pop(0)


@dataclass(frozen=True)
class Answer:
    question: str
    text: str
    evidence: tuple[dict, ...]
    citations: tuple[str, ...]


def salvaged(text: str) -> dict:
    """The first balanced JSON object of a completion."""
    start = text.find("{")
    while start >= 0:
        depth, quoted, skip = 0, False, False
        for i, c in enumerate(text[start:], start):
            if skip:
                skip = False
            elif quoted:
                skip, quoted = c == "\\", c != '"'
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    try:
                        return json.loads(text[start : i + 1])
                    except ValueError:
                        break
        start = text.find("{", start + 1)
    raise ProviderFault("the completion holds no JSON object")


def asked(provider: Provider | None, prompt: str) -> dict:
    if provider is None:
        raise ConfigurationFault("this needs a provider")
    try:
        return salvaged(provider.complete(prompt))
    except MemoryFault:
        raise
    except Exception as e:
        raise ProviderFault(str(e)) from e


class Memory:
    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame], root: str | None, codebook: str, provider: Provider | None = None) -> None:
        self.spark, self.root, self.codebook, self.provider = spark, root, codebook, provider
        mine = lambda df: df.where(F.col("codebook_id") == codebook)
        self.catalog = Catalog.of(*(mine(tables[n]) for n in ("fact", "line", "unit", "topic", "entity", "codebook")))

    @classmethod
    def load(cls, spark: SparkSession, source: str, codebook: str, provider: Provider | None = None) -> Memory:
        """From a folder of tables, or from codebook XML, which is checked first."""
        if not source or not codebook:
            raise ConfigurationFault("a source and a codebook are needed")
        try:
            if source.endswith(".xml") or "*" in source:
                from engramma.sources import codebook_xml

                tables = codebook_xml.read(spark, source)
                bad = codebook_xml.problems(tables).where(F.col("g") == codebook).limit(3).collect()
                if bad:
                    raise StorageFault(f"{codebook}: {[(r['problem'], r['id'], r['other']) for r in bad]}")
                return cls(spark, tables, None, codebook, provider)
            return cls(spark, {n: table(spark, source, n) for n in TABLES}, source, codebook, provider)
        except MemoryFault:
            raise
        except Exception as e:
            raise StorageFault(f"{source}: {str(e)[:300]}") from e

    # --- ingest ----------------------------------------------------------------------------------------------------
    def session(self, messages: Sequence, session_id: str | None = None, day: str | date | None = None, title: str = "") -> dict:
        """Messages, checked, as a session with ids ``<session>L<n>``."""
        if isinstance(messages, (str, bytes)) or not messages:
            raise ConfigurationFault("messages must be a sequence and not empty")
        said = []
        for m in messages:
            who, text = (m.get("role"), m.get("content")) if isinstance(m, Mapping) else m if isinstance(m, tuple) and len(m) == 2 else (None, None)
            who, text = str(who or "").strip(), str(text or "").strip()
            if not who or not text or re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", who + text):
                raise ConfigurationFault("every message needs a role and a content without control characters")
            said.append((who, text))
        sid = str(session_id or f"session-{uuid.uuid4().hex}").strip()
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", sid):
            raise ConfigurationFault(f"no session id: {sid!r}")
        when = str(day or date.today().isoformat())[:10]
        try:
            date.fromisoformat(when)
        except ValueError as e:
            raise ConfigurationFault(f"no date: {when!r}") from e
        return {"id": sid, "date": when, "title": title, "lines": [(f"{sid}L{i}", who, text) for i, (who, text) in enumerate(said, 1)]}

    def remember(self, messages: Sequence, session_id: str | None = None, day: str | date | None = None, title: str = "") -> list[dict]:
        """Extract the facts of a session, append it all to the tables and return the facts.

        A session that the memory has is refused. Tables are appended lines first and the session last, so that one that was
        cut off is not there and can be remembered again; what is delivered twice counts once.
        """
        if self.root is None:
            raise StorageFault("this memory was read from XML and cannot be appended to")
        s = self.session(messages, session_id, day, title)
        if not self.catalog.unit.where(F.col("id") == s["id"]).isEmpty():
            raise StorageFault(f"there is a session {s['id']}")
        roots = [r["code"] for r in self.catalog.topic.where("status <> 'deprecated'").select("code").distinct().orderBy("code").limit(200).collect()]
        reply = asked(self.provider, _EXTRACT.format(topics=" ".join(roots), kinds=" ".join(KINDS), lines="\n".join(f"({i}) {w}: {t}" for i, w, t in s["lines"])))
        raw = reply.get("facts")
        if not isinstance(raw, list):
            raise ProviderFault("the extraction has no list of facts")
        g, spark = self.codebook, self.spark
        line = spark.createDataFrame([(g, i, s["id"], s["date"], n, w.lower(), t) for n, (i, w, t) in enumerate(s["lines"], 1)], "codebook_id string, id string, unit string, unit_date string, pos int, who string, text string")
        rows = [_raw_fact(g, s["id"], f) for f in raw if isinstance(f, dict)]
        schema = "g string, unit string, content string, kind string, who string, t string, conf string, topics array<string>, entities array<string>, src array<string>, object array<string>, place array<string>, event array<string>, duration string, n int"
        c = Catalog(self.catalog.fact, line.withColumnRenamed("codebook_id", "g"), *(getattr(self.catalog, n) for n in ("unit", "topic", "edge", "entity", "alias", "speaker")))
        made = ingest.normalised_facts(spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], schema).drop("n"), c, KINDS, EVENTS)
        order = F.row_number().over(evidence.W.partitionBy("g", "unit").orderBy(F.array_join("src", " "), "text"))
        fact = cut(made.select(F.col("g").alias("codebook_id"), F.concat("unit", F.lit("F"), order.cast("string")).alias("id"), "unit", F.lit(s["date"]).alias("unit_date"), "t", "kind", "who", "conf", "topics", "entities", "src", "obj", "place", "event", "dur", "text"))
        unit = spark.createDataFrame([(g, s["id"], s["date"], "", s["title"], 0, len(s["lines"]))], "codebook_id string, id string, date string, t string, title string, dur_min int, n_lines int")
        for name, df in (("line", line), ("fact", fact), ("unit", unit)):
            like = table(spark, self.root, name)
            df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema.fields]).write.mode("append").parquet(os.path.join(self.root, f"{name}.parquet"))
        self.__init__(spark, {n: table(spark, self.root, n) for n in TABLES}, self.root, self.codebook, self.provider)
        return [r.asDict() for r in fact.orderBy("id").collect()]

    # --- retrieval -------------------------------------------------------------------------------------------------
    def execute(self, plan: Plan | Mapping, budget: int = 12, unit_cap: int = 4) -> list[dict]:
        p = plan if isinstance(plan, Plan) else Plan.from_dict(plan)
        return [r.asDict() for r in execute(self.catalog, p, budget, unit_cap).rows.orderBy("date", "id").collect()]

    def plan(self, question: str) -> Plan | None:
        """The plan that the provider writes for a question, fitted to it; None if it writes none that holds."""
        if self.provider is None:
            return None
        speakers = [r["who"] for r in self.catalog.speaker.collect()]
        codes = [r["code"] for r in self.catalog.topic.select("code").distinct().orderBy("code").limit(200).collect()]
        try:
            written = Plan.from_dict(asked(self.provider, _PLAN.format(question=question, topics=" ".join(codes), kinds=" ".join(KINDS), speakers=" ".join(speakers))))
        except PlanError:
            return None
        return questions.fitted(written, question, questions.anchors(question, speakers), self._resolvable(written))

    def _resolvable(self, plan: Plan) -> set[str]:
        """What of a plan's own topics and entities, as it writes them, the memory knows: held against its whole tables."""
        c = self.catalog
        named = [(self.codebook, "topics", t) for q in plan.queries for t, _ in q.where.topics] + [(self.codebook, "entities", e) for q in plan.queries for e in q.where.entities]
        if not named:
            return set()
        names = self.spark.createDataFrame(named, "g string, axis string, surface string")
        topics = vocabulary.resolve_topics(c, names.where("axis = 'topics'"))
        entities = vocabulary.resolve_entities(c, names.where("axis = 'entities'"))
        return {r["surface"] for r in topics.select("surface", "code").union(entities.select("surface", "code")).where("code is not null").collect()}

    def recall(self, query: str, limit: int = 10) -> list[dict]:
        """The facts that fit a query best: plan, words and dates, fused."""
        return self._recalled(query, limit)[0]

    def _recalled(self, query: str, limit: int) -> tuple[list[dict], Plan | None, list[dict]]:
        """(rows, plan, counts): the recalled facts, and the plan with the aggregates that it asked for."""
        if not query or not query.strip() or limit < 1:
            raise ConfigurationFault("a query and a limit of one at least are needed")
        c = self.catalog
        base = self.spark.createDataFrame([("q", self.codebook, query)], "qid string, g string, question string")
        docs = documents(c.fact, c.line)
        ranked = [channels.lexical(docs, channels.question_stems(base), 2 * limit)]
        a = questions.anchors(query)
        if a.day or a.month:
            anchors = self.spark.createDataFrame([("q", self.codebook, a.day, a.month)], "qid string, g string, day string, month string")
            ranked.append(channels.date_window(c, anchors, specificity(docs, frequencies(docs))).select("qid", "g", F.lit("fact").alias("type"), "id", "rank"))
        plan, counts = self.plan(query), []
        if plan is not None:
            ran = execute(c, plan, 2 * limit, 6)
            counts = [] if ran.counts is None else [r.asDict() for r in ran.counts.collect()]
            rows = ran.rows.where("type = 'F'")
            ranked.insert(0, rows.select("qid", "g", F.lit("fact").alias("type"), "id", F.col("seat").alias("rank")))
        best = channels.fused(ranked).where("type = 'fact'").orderBy("rank").limit(limit)
        full = best.select("g", "id", "rank").join(evidence.hydrated(c), ["g", "id"]).orderBy("rank")
        return [r.asDict(recursive=True) for r in full.collect()], plan, counts

    def absent_subjects(self, question: str) -> list[str]:
        """The subjects of a question of which no record of the memory knows."""
        asked_ = self.spark.createDataFrame([("q", self.codebook, question)], "qid string, g string, question string")
        docs = documents(self.catalog.fact, self.catalog.line).select("g", channels.F.explode("toks").alias("stem"))
        return sorted(r["subject"] for r in evidence.premise_risks(self.catalog, docs, asked_).collect())

    def answer(self, question: str, limit: int = 10, rules: Iterable[str] = (), may_refuse: bool = True) -> Answer:
        """An answer from recalled facts, with citations of what was shown only.

        A question for a number of sessions is answered by the plan's own count, which no limit has cut. ``rules`` of
        :func:`questions.finished` may turn an answer into a refusal, which cites nothing.
        """
        rows, plan, counts = self._recalled(question, limit)
        if plan is not None and counts and questions.counts_units(question, plan.intent, counts[0]["of"]):
            return Answer(question, str(counts[0]["n"]), tuple(rows), tuple(r["id"] for r in rows[:5]))
        shown = {x for r in rows for x in (r["id"], *(s["id"] for s in r["sources"]))}
        text = "\n".join(f"[{r['date']}] ({r['id']}) {r['text']}" + "".join(f" | {s['id']}: {s['text'][:120]}" for s in r["sources"][:2]) for r in sorted(rows, key=lambda r: (r["date"], r["id"])))
        reply = asked(self.provider, _ANSWER.format(question=question, evidence=text))
        said = reply.get("answer")
        said = said if isinstance(said, str) and said.strip() else questions.NO_ANSWER
        claimed = reply.get("citations") if isinstance(reply.get("citations"), list) else []
        rules = tuple(rules)
        said, fired = questions.finished(said, question, rules, self.absent_subjects(question) if "premise" in rules else (), may_refuse)
        return Answer(question, said, tuple(rows), () if fired else tuple(dict.fromkeys(x for x in map(str, claimed) if x in shown)))

    def summary(self) -> dict:
        rows = evidence.summary(self.catalog).collect()
        return rows[0].asDict() if rows else {}

    def weights(self) -> DataFrame:
        """The stems of the memory with their weights."""
        return frequencies(documents(self.catalog.fact, self.catalog.line))


def _raw_fact(g: str, unit: str, f: dict) -> tuple:
    text = lambda k: f[k] if isinstance(f.get(k), str) else None
    facets = f.get("facets") if isinstance(f.get("facets"), dict) else {}
    items = lambda d, k: [str(x) for x in ([d[k]] if isinstance(d.get(k), str) else d.get(k) if isinstance(d.get(k), list) else []) if isinstance(x, (str, int))]
    dur = facets.get("duration")
    return (g, unit, text("content"), text("kind"), text("who"), text("t"), text("conf"), items(f, "topics"), items(f, "entities"), items(f, "src"), items(facets, "object"), items(facets, "place"), items(facets, "event"), dur if isinstance(dur, str) else None)


_EXTRACT = """Extract the facts of this conversation as JSON: {{"facts": [{{"content": "...", "kind": "...", "who": "...", "t": "YYYY-MM-DD or null", "conf": "high", "topics": [], "entities": [], "src": ["line ids"], "facets": {{"object": [], "place": [], "event": [], "duration": null}}}}]}}
Kinds: {kinds}
Topics: {topics}
{lines}"""
_PLAN = """Write a retrieval plan as JSON for the question: {{"queries": [{{"select": "facts", "where": {{"topics": [], "entities": [], "kind": [], "who": [], "time": ["", ""], "grep": ""}}, "pipe": []}}], "intent": "factual"}}
Kinds: {kinds}
Topics: {topics}
Speakers: {speakers}
Question: {question}"""
_ANSWER = """Answer from the evidence only, as JSON: {{"answer": "...", "citations": ["ids"]}}
{evidence}
Question: {question}"""
