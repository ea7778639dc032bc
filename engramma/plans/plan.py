"""The plan: what a question asks of a memory, checked and resolved on the driver before any table is read.

A plan is a few symbolic queries side by side (``queries``) or stages that build on one another (``stages``). Each selects
facts, lines or units, filters with ``where`` and shapes with ``pipe``.
"""

from __future__ import annotations

import copy
import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

INTENTS = ("factual", "speculative", "aggregate", "enumeration", "attribution")
TARGETS = ("facts", "lines", "units")
LIST_FIELDS = ("entities", "obj", "place", "event", "kind", "who", "units", "grep_all")
#: What may filter each target.
ALLOWED = {
    "facts": {"topics", "entities", "obj", "place", "event", "kind", "who", "time", "units", "unit", "grep", "grep_all", "entity_kind", "conf_min"},
    "lines": {"units", "unit", "who", "time", "grep"},
    "units": {"units", "unit", "time", "grep"},
}
#: How many values of a field count.
MOST = {"topics": 4, "entities": 4, "obj": 3, "place": 3, "event": 3, "kind": 4, "who": 3, "units": 8, "grep_all": 3}
MAX_QUERIES, MAX_STAGES, MAX_PIPE = 3, 4, 4
_PARTIAL_DATE = re.compile(r"\d{4}(-(0[1-9]|1[0-2])(-(0[1-9]|[12]\d|3[01]))?)?")
_REFERENCE = re.compile(r"\$([A-Za-z_]\w*)\.(unit|units|date|t)")


class PlanError(ValueError):
    """A plan that breaks a rule; the message names the place."""


@dataclass(frozen=True)
class Where:
    topics: tuple[tuple[str, bool], ...] = ()
    entities: tuple[str, ...] = ()
    obj: tuple[str, ...] = ()
    place: tuple[str, ...] = ()
    event: tuple[str, ...] = ()
    kind: tuple[str, ...] = ()
    who: tuple[str, ...] = ()
    units: tuple[str, ...] = ()
    time: tuple[str, str] = ("", "")
    grep: str = ""
    grep_all: tuple[str, ...] = ()
    entity_kind: str = ""
    conf_min: str = "low"


@dataclass(frozen=True)
class Query:
    select: str = "facts"
    where: Where = field(default_factory=Where)
    pipe: tuple[tuple, ...] = ()
    name: str = ""


@dataclass(frozen=True)
class Plan:
    queries: tuple[Query, ...]
    staged: bool = False
    intent: str = "factual"

    @classmethod
    def from_json(cls, text: str) -> Plan:
        try:
            return cls.from_dict(json.loads(text))
        except ValueError as e:
            raise e if isinstance(e, PlanError) else PlanError(f"not JSON: {e}") from e

    @classmethod
    def from_dict(cls, plan: Mapping[str, Any]) -> Plan:
        """Check a plan strictly; the mapping is copied and never changed."""
        if not isinstance(plan, Mapping):
            raise PlanError("a plan must be an object")
        plan = copy.deepcopy(dict(plan))
        if unknown := set(plan) - {"queries", "stages", "intent"}:
            raise PlanError(f"unknown plan fields: {sorted(unknown)}")
        if ("queries" in plan) == ("stages" in plan):
            raise PlanError("a plan has either queries or stages")
        staged = "stages" in plan
        entries = plan["stages" if staged else "queries"]
        if not isinstance(entries, list) or not 1 <= len(entries) <= (MAX_STAGES if staged else MAX_QUERIES):
            raise PlanError(f"a plan has 1 to {MAX_STAGES if staged else MAX_QUERIES} {'stages' if staged else 'queries'}")
        intent = plan.get("intent", "factual")
        if intent not in INTENTS:
            raise PlanError(f"unknown intent: {intent!r}")
        names: list[str] = []
        queries = []
        for i, entry in enumerate(entries):
            queries.append(_query(entry, f"{'stages' if staged else 'queries'}[{i}]", names if staged else None))
            if staged:
                names.append(queries[-1].name)
        return cls(tuple(queries), staged, intent)

    def to_dict(self) -> dict[str, Any]:
        return {"stages" if self.staged else "queries": [_as_dict(q, self.staged) for q in self.queries], "intent": self.intent}


def _as_dict(q: Query, staged: bool) -> dict[str, Any]:
    w = q.where
    where: dict[str, Any] = {n: list(getattr(w, n)) for n in LIST_FIELDS if getattr(w, n)}
    if w.topics:
        where["topics"] = [{"code": c, "closure": k} for c, k in w.topics]
    if w.time != ("", ""):
        where["time"] = list(w.time)
    where |= {n: getattr(w, n) for n in ("grep", "entity_kind") if getattr(w, n)}
    if w.conf_min != "low":
        where["conf_min"] = w.conf_min
    pipe = [{"op": p[0]} | ({"key": p[1], "desc": p[2]} if p[0] == "sort" else {"n": p[1]} if len(p) > 1 else {}) for p in q.pipe]
    return ({"name": q.name} if staged else {}) | {"select": q.select, "where": where, "pipe": pipe}


def _strings(value: Any, at: str) -> tuple[str, ...]:
    values = [value] if isinstance(value, str) else value
    if not isinstance(values, list) or not all(isinstance(v, str) and v for v in values):
        raise PlanError(f"{at}: a list of strings is needed")
    return tuple(values)


def _pattern(value: Any, at: str) -> str:
    if not isinstance(value, str):
        raise PlanError(f"{at}: a pattern is needed")
    try:
        re.compile(value)
    except re.error as e:
        raise PlanError(f"{at}: bad pattern: {e}") from e
    return value


def _query(entry: Any, at: str, earlier: list[str] | None) -> Query:
    if not isinstance(entry, Mapping):
        raise PlanError(f"{at}: an object is needed")
    if unknown := set(entry) - ({"select", "where", "pipe"} | ({"name"} if earlier is not None else set())):
        raise PlanError(f"{at}: unknown fields {sorted(unknown)}")
    target = entry.get("select", "facts")
    if target not in TARGETS:
        raise PlanError(f"{at}: cannot select {target!r}")
    name = ""
    if earlier is not None:
        name = entry.get("name", "")
        if not isinstance(name, str) or not name.isidentifier() or name in earlier:
            raise PlanError(f"{at}: a stage needs a name of its own")
    where = entry.get("where", {})
    if not isinstance(where, Mapping):
        raise PlanError(f"{at}.where: an object is needed")
    if bad := set(where) - ALLOWED[target]:
        raise PlanError(f"{at}.where: {target} cannot be filtered by {sorted(bad)}")
    pipe = entry.get("pipe", [])
    if not isinstance(pipe, list) or len(pipe) > MAX_PIPE or (target == "lines" and pipe):
        raise PlanError(f"{at}.pipe: at most {MAX_PIPE} steps, none for lines")
    return Query(target, _where(where, f"{at}.where", earlier), tuple(_step(p, f"{at}.pipe[{i}]") for i, p in enumerate(pipe)), name)


def _where(where: Mapping[str, Any], at: str, earlier: list[str] | None) -> Where:
    got: dict[str, Any] = {}
    for n in LIST_FIELDS:
        if where.get(n):
            got[n] = _strings(where[n], f"{at}.{n}")[: MOST[n]]
    if where.get("unit"):
        got["units"] = _strings(where["unit"], f"{at}.unit")
    if where.get("topics"):
        topics = []
        if not isinstance(where["topics"], list):
            raise PlanError(f"{at}.topics: a list is needed")
        for t in where["topics"]:
            if isinstance(t, str) and t:
                topics.append((t, True))
            elif isinstance(t, Mapping) and isinstance(t.get("code"), str) and t["code"] and set(t) <= {"code", "closure"} and isinstance(t.get("closure", True), bool):
                topics.append((t["code"], t.get("closure", True)))
            else:
                raise PlanError(f"{at}.topics: codes, or objects with code and closure, are needed")
        got["topics"] = tuple(topics[: MOST["topics"]])
    if "time" in where:
        time = [where["time"]] if isinstance(where["time"], str) else where["time"]
        if not isinstance(time, list) or not 1 <= len(time) <= 2 or not all(isinstance(t, str) for t in time):
            raise PlanError(f"{at}.time: one or two partial dates are needed")
        time = (time + [""])[:2]
        for t in time:
            if t and not _PARTIAL_DATE.fullmatch(t) and not (earlier is not None and _REFERENCE.fullmatch(t)):
                raise PlanError(f"{at}.time: {t!r} is no partial date")
        got["time"] = tuple(time)
    if where.get("grep"):
        got["grep"] = _pattern(where["grep"], f"{at}.grep")
    for i, g in enumerate(got.get("grep_all", ())):
        _pattern(g, f"{at}.grep_all[{i}]")
    for v in (*got.get("units", ()), *got.get("time", ())):
        if v.startswith("$"):
            m = _REFERENCE.fullmatch(v)
            if earlier is None or not m or m.group(1) not in earlier:
                raise PlanError(f"{at}: {v!r} names no earlier stage")
    if where.get("entity_kind"):
        if not isinstance(where["entity_kind"], str):
            raise PlanError(f"{at}.entity_kind: a string is needed")
        got["entity_kind"] = where["entity_kind"]
    if "conf_min" in where:
        if where["conf_min"] not in ("low", "med", "high"):
            raise PlanError(f"{at}.conf_min: low, med or high is needed")
        got["conf_min"] = where["conf_min"]
    return Where(**got)


def _step(step: Any, at: str) -> tuple:
    if not isinstance(step, Mapping):
        raise PlanError(f"{at}: an object is needed")
    op = step.get("op")
    if op == "sort" and set(step) <= {"op", "key", "desc"} and step.get("key", "t") in ("t", "date", "when", "dur") and isinstance(step.get("desc", False), bool):
        return ("sort", step.get("key", "t"), step.get("desc", False))
    if op in ("head", "tail") and set(step) <= {"op", "n"} and isinstance(step.get("n", 5), int) and not isinstance(step.get("n"), bool) and step.get("n", 5) >= 1:
        return (op, step.get("n", 5))
    if op == "count" and set(step) == {"op"}:
        return ("count",)
    raise PlanError(f"{at}: no such step")


def branches(pattern: str) -> list[str]:
    """The alternatives of a pattern at its top level; the whole pattern where one of them is no pattern by itself."""
    parts, depth, in_class, part, i = [], 0, False, "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            part += pattern[i : i + 2]
            i += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
            if pattern[i + 1 : i + 2] == "]":
                part += c
                i += 1
                c = "]"
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            parts.append(part)
            part = ""
            i += 1
            continue
        part += c
        i += 1
    parts = [p.strip() for p in [*parts, part] if p.strip()]
    try:
        for p in parts:
            re.compile(p)
    except re.error:
        return [pattern]
    return parts or [pattern]


def is_simple(pattern: str) -> bool:
    """Whether a pattern is only plain alternatives, so that each has a weight of its own."""
    return not re.search(r"[()\[\]?*+{\\]", pattern.replace("\\|", ""))

