"""Problem 3: nested records become flat linked tables, by vectorised structural indexing.

A record's bytes are indexed without parsing: quote, bracket and delimiter bitmaps, the string mask as the parity of
quotes, nesting depth as a prefix sum, and from these the span, container and position of every member at any depth.
Only the spans that a table needs are decoded.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CLASS = np.zeros(256, np.uint8)
for _c in b"{[":
    _CLASS[_c] = 1
for _c in b"}]":
    _CLASS[_c] = 2
for _c in b",":
    _CLASS[_c] = 3
for _c in b":":
    _CLASS[_c] = 4
_SPACE = np.isin(np.arange(256), list(b" \t\r\n"))


class Index:
    """The members of all containers of one JSON text, as arrays; ``ok`` is False where brackets or quotes don't match.

    For member i: ``parent[i]`` is the member that is its container (-1: the outermost value), ``pos[i]`` its position
    there, ``key[i]`` the span of its quoted name (-1, -1 in an array) and ``span[i]`` the span of its value.
    """

    def __init__(self, text: bytes) -> None:
        self.text = text
        b = np.frombuffer(text, np.uint8)
        at = np.arange(b.size)
        slash = b == 92
        run_start = np.maximum.accumulate(np.where(slash, -1, at)) if b.size else at
        before = np.concatenate([[0], (at - run_start)[:-1]]) if b.size else at
        quote = (b == 34) & (before % 2 == 0)
        inside = np.cumsum(quote) % 2 == 1
        kind = np.where(inside | quote, 0, _CLASS[b])
        opens, closes = kind == 1, kind == 2
        depth = np.cumsum(opens.astype(np.int32)) - np.cumsum(closes.astype(np.int32))
        self.ok = bool(b.size and not inside[-1] and depth[-1] == 0 and depth.min() >= 0 and opens.any())
        self.parent = self.pos = np.empty(0, np.int64)
        self.key = self.span = np.empty((0, 2), np.int64)
        if not self.ok:
            return
        s = np.flatnonzero(kind)
        level = depth[s] + closes[s]
        order = np.argsort(level, kind="stable")
        t, k, level = s[order], kind[s][order], level[order]
        starts = (k == 1) | (k == 3)
        nxt = np.concatenate([k[1:], [0]])
        nxt2 = np.concatenate([k[2:], [0, 0]])
        named = starts & (nxt == 4)
        end_at = np.minimum(np.arange(t.size) + 1 + named, t.size - 1)
        self.ok = bool(np.all(np.isin(np.where(named, nxt2, nxt)[starts], (2, 3))))
        opener = np.maximum.accumulate(np.where(k == 1, np.arange(t.size), -1))
        closer = np.flatnonzero(k == 2)
        self.ok &= bool(np.all((b[t[closer]].astype(int) - b[t[opener[closer]]]) == 2))
        if not self.ok:
            return
        solid = ~_SPACE[b]
        forward = np.minimum.accumulate(np.where(solid, at, b.size)[::-1])[::-1]
        backward = np.maximum.accumulate(np.where(solid, at, -1))
        m = np.flatnonzero(starts)
        value = forward[t[np.minimum(m + named[m], t.size - 1)] + 1]
        stop = backward[t[end_at[m]] - 1] + 1
        keep = value < stop  # an empty container has no member
        m, value, stop = m[keep], value[keep], stop[keep]
        head = opener[m]
        first = np.concatenate([[True], head[1:] != head[:-1]]) if m.size else np.empty(0, bool)
        run = np.arange(m.size)
        self.pos = run - np.maximum.accumulate(np.where(first, run, 0)) if m.size else run
        key0 = np.where(named[m], forward[t[m] + 1], -1)
        key1 = np.where(named[m], backward[t[np.minimum(m + 1, t.size - 1)] - 1] + 1, -1)
        self.key = np.stack([key0, key1], 1)
        self.span = np.stack([value, stop], 1)
        by_value = np.argsort(value, kind="stable")
        found = np.searchsorted(value[by_value], t[head])
        hit = (found < m.size) & (value[by_value][np.minimum(found, m.size - 1)] == t[head]) if m.size else np.empty(0, bool)
        self.parent = np.where(hit, by_value[np.minimum(found, m.size - 1)], -1) if m.size else found
        by_parent = np.argsort(self.parent, kind="stable")
        self._order, self._sorted = by_parent, self.parent[by_parent]

    def children(self, member: int) -> np.ndarray:
        """The members of a container in order; -1: of the outermost value."""
        lo, hi = np.searchsorted(self._sorted, [member, member + 1])
        return self._order[lo:hi]

    def raw(self, member: int) -> bytes:
        return self.text[self.span[member, 0] : self.span[member, 1]]

    def name(self, member: int) -> str | None:
        lo, hi = self.key[member]
        return json.loads(self.text[lo:hi]) if lo >= 0 else None

    def value(self, member: int) -> object:
        try:
            return json.loads(self.raw(member))
        except ValueError:
            return None

    def child(self, member: int, name: str) -> int | None:
        """The last member called ``name``, as a parser would take it."""
        plain = name.encode()
        for c in self.children(member)[::-1]:
            lo, hi = self.key[c]
            key = self.text[lo + 1 : hi - 1]
            if lo >= 0 and (key == plain or b"\\" in key and self.name(c) == name):
                return int(c)
        return None


_SESSION = re.compile(r"session_\d+")
_CITED = re.compile(r"([A-Za-z]+)\s*(\d+)\s*:\s*(\d+)")


def _citation(text: str) -> list[tuple[str, str, str]]:
    return [(a.upper(), n.lstrip("0") or "0", m.lstrip("0") or "0") for a, n, m in _CITED.findall(text)]


def _strings(value: object) -> Iterator[str]:
    if isinstance(value, str):
        yield value
    elif isinstance(value, list):
        for x in value:
            yield from _strings(x)


def dialogue_rows(text: str | None) -> dict[str, list[tuple]]:
    """The linked rows of one dialogue record: ``turn`` (session key, position, dia_id, who, text) and ``evidence``
    (question position, dia_id). A null, blank or broken record has none."""
    out: dict[str, list[tuple]] = {"turn": [], "evidence": [], "session": [], "question": []}
    ix = Index((text or "").encode("utf-8", "surrogatepass"))
    if not ix.ok:
        return out
    known: dict[tuple[str, str, str], list[str]] = {}
    if (talk := ix.child(-1, "conversation")) is not None:
        for member in ix.children(talk):
            name = ix.name(member)
            if not name or not _SESSION.fullmatch(name):
                continue
            turns: int | None = int(member)
            if ix.raw(member)[:1] == b"{":
                turns = ix.child(member, "turns")
            if turns is None or ix.raw(turns)[:1] != b"[":
                continue
            out["session"].append((name,))
            for turn in ix.children(turns):
                if ix.raw(turn)[:1] != b"{":
                    continue
                part = {ix.name(c): int(c) for c in ix.children(turn)}
                dia, who, said = (ix.value(part[x]) if x in part else None for x in ("dia_id", "speaker", "text"))
                dia = dia if isinstance(dia, str) and dia.strip() else None
                out["turn"].append((name, int(ix.pos[turn]), dia, who if isinstance(who, str) else None, said if isinstance(said, str) else None))
                if dia:
                    for key in _citation(dia):
                        known.setdefault(key, []).append(dia)
    if (qa := ix.child(-1, "qa")) is not None and ix.raw(qa)[:1] == b"[":
        for q in ix.children(qa):
            out["question"].append((int(ix.pos[q]),))
            cited = ix.child(q, "evidence") if ix.raw(q)[:1] == b"{" else None
            if cited is None:
                continue
            keys = [k for s in _strings(ix.value(cited)) for k in _citation(s)]
            out["evidence"] += [(int(ix.pos[q]), dia) for k in dict.fromkeys(keys) for dia in dict.fromkeys(known.get(k, []))]
    return out


def spread(records: DataFrame, key: str) -> DataFrame:
    """Records over all cores by their key, since one scan task may hold many that are long to index."""
    spark = records.sparkSession
    return records.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), key)


def _links(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["link_kind", "rec_id", "parent_key", "child_key"])


LINKS = "link_kind string, rec_id string, parent_key string, child_key string"
TURNS = "rec_id string, session string, pos int, dia_id string, who string, text string"


def dialogue_turns(dialogue: DataFrame, id_col: str = "sample_id", json_col: str = "record") -> DataFrame:
    """The turns of dialogue records, flat: (rec_id, session, pos, dia_id, who, text); null for what a turn lacks."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *t) for i, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t in dialogue_rows(r)["turn"]]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["rec_id", "session", "pos", "dia_id", "who", "text"])

    return spread(dialogue.select(F.col(id_col).cast("string"), json_col), id_col).mapInArrow(flat, TURNS)


def dialogue_links(dialogue: DataFrame, id_col: str = "sample_id", json_col: str = "record") -> DataFrame:
    """(link_kind, rec_id, parent_key, child_key) of dialogue records: kinds ``turn`` and ``evidence``."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = dialogue_rows(record)
                rows += [("turn", i, session, dia) for session, _, dia, _, _ in found["turn"] if dia]
                rows += [("evidence", i, str(q), dia) for q, dia in found["evidence"]]
            yield _links(rows)

    return spread(dialogue.select(F.col(id_col).cast("string"), json_col), id_col).mapInArrow(flat, LINKS)


def broken_records(dialogue: DataFrame, id_col: str = "sample_id", json_col: str = "record") -> DataFrame:
    """(rec_id): the records that the index refuses, since brackets, quotes or delimiters do not match; null ones too."""

    def refused(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bad = [i for i, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if not Index((r or "").encode("utf-8", "surrogatepass")).ok]
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.string())], names=["rec_id"])

    return spread(dialogue.select(F.col(id_col).cast("string"), json_col), id_col).mapInArrow(refused, "rec_id string").distinct()


#: Characters that Unicode calls white space.
_WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SOLID = re.compile(rb"[0-9A-Za-z]")
HAYSTACK = "haystack_session_ids", "answer_session_ids", "haystack_sessions"


def haystack_rows(text: str) -> list[tuple[str, str, str]]:
    """(link_kind, parent_key, child_key) of one haystack record in JSON."""
    ix = Index(text.encode("utf-8", "surrogatepass"))
    out: list[tuple[str, str, str]] = []
    if not ix.ok:
        return out
    ids, answers, sessions = (ix.child(-1, n) for n in HAYSTACK)
    strings = lambda m: [(int(ix.pos[c]), ix.value(int(c))) for c in ix.children(m)] if m is not None else []
    wanted = {v for _, v in strings(answers)}
    for p, v in strings(ids):
        if v is not None:
            out.append(("haystack_session", str(p), v))
            if v in wanted:
                out.append(("answer_session", str(p), v))
    if sessions is not None:
        # the members three levels below the sessions: of a turn of a session
        up = lambda m: np.where(m >= 0, ix.parent[m], -2)
        turn = up(np.arange(ix.parent.size))
        session = up(turn)
        for m in np.flatnonzero(up(session) == sessions):
            lo, hi = ix.key[m]
            if hi - lo == 9 and ix.text[lo:hi] == b'"content"':
                raw = ix.raw(m)
                if raw != b"null" and (b"\\" not in raw and _SOLID.search(raw) or json.loads(raw).strip(_WHITE)):
                    out.append(("haystack_turn", str(ix.pos[session[m]]), str(ix.pos[turn[m]])))
    return out


def haystack_links(stack: DataFrame) -> DataFrame:
    """(link_kind, rec_id, parent_key, child_key) of haystack rows: ``haystack_session``, ``answer_session`` and
    ``haystack_turn``. A row is indexed as one JSON record, like a dialogue."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _links([(kind, i, parent, child) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for kind, parent, child in haystack_rows(text)])

    record = F.to_json(F.struct(*HAYSTACK), {"ignoreNullFields": "false"})
    return spread(stack.select(F.col("question_id").alias("rec_id"), *HAYSTACK), "rec_id").select("rec_id", record.alias("record")).mapInArrow(flat, LINKS)


def haystack_turns(stack: DataFrame) -> DataFrame:
    """(rec_id, session_pos, turn_pos, role, content) of haystack rows; null sessions have no turns."""
    s = stack.select(F.col("question_id").alias("rec_id"), F.posexplode("haystack_sessions").alias("session_pos", "turns"))
    return s.select("rec_id", "session_pos", F.posexplode("turns").alias("turn_pos", "t")).select("rec_id", "session_pos", "turn_pos", "t.role", "t.content")


def flat_links(dialogue: DataFrame, stack: DataFrame) -> DataFrame:
    """All parent-child links of both nested tables, distinct, so repeated records change nothing."""
    return dialogue_links(dialogue).unionByName(haystack_links(stack)).distinct()
