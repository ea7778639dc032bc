"""Problem 3: the structural index against a JSON parser, and the linked tables."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from engramma.operators.nested import Index, broken_records, dialogue_links, dialogue_rows, dialogue_turns, haystack_links, haystack_turns

VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=12), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=6), x, max_size=4), max_leaves=25)


def rebuilt(ix: Index, member: int, raw: bytes):
    if raw[:1] == b"{":
        return {ix.name(c): rebuilt(ix, int(c), ix.raw(int(c))) for c in ix.children(member)}
    if raw[:1] == b"[":
        return [rebuilt(ix, int(c), ix.raw(int(c))) for c in ix.children(member)]
    return json.loads(raw)


@settings(max_examples=300, deadline=None)
@given(st.lists(VALUES, max_size=4) | st.dictionaries(st.text(max_size=6), VALUES, max_size=4), st.sampled_from([None, 1, "\t"]), st.booleans())
def test_index_is_a_parser(value, indent, ascii_only):
    text = json.dumps(value, indent=indent, ensure_ascii=ascii_only).encode("utf-8", "surrogatepass")
    ix = Index(text)
    assert ix.ok
    assert rebuilt(ix, -1, text.strip()) == json.loads(text)


def test_broken_records():
    for text in ["", "  ", "{", '{"a": [1, 2}', '{"a": "x}', "]", '"only a string"', None]:
        assert dialogue_rows(text) == {"turn": [], "evidence": [], "session": [], "question": []}


RECORD = {
    "qa": [{"evidence": ["D1:2", "d01:02 "]}, {"evidence": "D1:1; (D2:1), D9:9"}, {"evidence": None}, {}, 5],
    "conversation": {
        "session_1_date_time": "x", "session_1": [{"dia_id": "D1:1", "speaker": "A", "text": 'a "quoted" \\ }'}, {"dia_id": "D1:2", "text": None}, {"text": "no id"}],
        "session_2": {"place": "p", "turns": [{"dia_id": "D2:1", "text": "[ {"}]}, "session_3": None, "session_4": [],
    },
}


def test_links(spark):
    df = spark.createDataFrame([("s", json.dumps(RECORD), 1), ("s", json.dumps(RECORD, indent=2), 1), ("n", None, 1), ("b", "{", 1)], "sample_id string, record string, link_kind int")
    got = {tuple(r) for r in dialogue_links(df).distinct().collect()}
    assert got == {("turn", "s", "session_1", "D1:1"), ("turn", "s", "session_1", "D1:2"), ("turn", "s", "session_2", "D2:1"), ("evidence", "s", "0", "D1:2"), ("evidence", "s", "1", "D1:1"), ("evidence", "s", "1", "D2:1")}
    assert dialogue_turns(df.where("sample_id = 's'").limit(1)).count() == 4
    assert dialogue_links(df.limit(0)).count() == 0
    assert {r["rec_id"] for r in broken_records(df).collect()} == {"n", "b"}


def test_the_last_of_equal_names_counts():
    ix = Index(b'{"a": 1, "\\u0061": 2, "b": 3}')
    assert ix.value(ix.child(-1, "a")) == 2 and ix.value(ix.child(-1, "b")) == 3 and ix.child(-1, "c") is None


def test_haystacks(spark):
    schema = "question_id string, answer_session_ids array<string>, haystack_session_ids array<string>, haystack_sessions array<array<struct<role string, content string, has_answer boolean>>>"
    turn = lambda c: (None, c, None)
    df = spark.createDataFrame([("q", ["b", "zz"], ["a", "b", "b", None], [[turn("x"), turn(" \n"), turn(None), turn("\u3000\u2028"), turn("ß"), turn('"content": "q" }]')], None, [], [turn("y")]]), ("e", None, None, None)], schema)
    got = {tuple(r) for r in haystack_links(df).collect()}
    assert got == {
        ("haystack_session", "q", "0", "a"), ("haystack_session", "q", "1", "b"), ("haystack_session", "q", "2", "b"), ("answer_session", "q", "1", "b"), ("answer_session", "q", "2", "b"),
        ("haystack_turn", "q", "0", "0"), ("haystack_turn", "q", "0", "4"), ("haystack_turn", "q", "0", "5"), ("haystack_turn", "q", "3", "0"),
    }
    assert haystack_turns(df).count() == 7
    assert haystack_links(df.limit(0)).count() == 0
