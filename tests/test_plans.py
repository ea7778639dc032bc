"""Plans: what is accepted, what is refused, what a question adds."""

import pytest

from engramma.plans.plan import Plan, PlanError, branches, is_simple
from engramma.functions.patterns import respelled
from engramma.plans.questions import Anchors, anchors, counts_units, finished, fitted

GOOD = {"queries": [{"select": "facts", "where": {"topics": ["a", {"code": "b", "closure": False}], "time": ["2023-05"], "grep": "x|y", "conf_min": "med"}, "pipe": [{"op": "sort", "key": "t", "desc": True}, {"op": "head", "n": 2}, {"op": "count"}]}], "intent": "aggregate"}
BAD = [
    {}, [], {"queries": []}, {"queries": [{}], "stages": [{"name": "a"}]}, {"queries": [{}] * 4}, {"stages": [{"name": f"s{i}"} for i in range(5)]}, {"queries": [{}], "more": 1}, {"queries": [{}], "intent": "x"},
    {"queries": [{"select": "rows"}]}, {"queries": [{"where": []}]}, {"queries": [{"where": {"colour": ["red"]}}]}, {"queries": [{"select": "lines", "where": {"topics": ["a"]}}]}, {"queries": [{"select": "lines", "pipe": [{"op": "count"}]}]},
    {"queries": [{"select": "units", "where": {"who": ["a"]}}]}, {"queries": [{"where": {"grep": "("}}]}, {"queries": [{"where": {"grep_all": ["["]}}]}, {"queries": [{"where": {"time": ["2023-13"]}}]}, {"queries": [{"where": {"time": ["a", "b", "c"]}}]},
    {"queries": [{"where": {"topics": [{"code": "a", "closure": "yes"}]}}]}, {"queries": [{"where": {"topics": [3]}}]}, {"queries": [{"where": {"kind": [1]}}]}, {"queries": [{"where": {"conf_min": "top"}}]}, {"queries": [{"pipe": [{"op": "head", "n": 0}]}]},
    {"queries": [{"pipe": [{"op": "head", "n": True}]}]}, {"queries": [{"pipe": [{"op": "sort", "key": "size"}]}]}, {"queries": [{"pipe": [{"op": "top"}]}]}, {"queries": [{"pipe": [{"op": "count"}] * 5}]}, {"queries": [{"name": "a"}]}, {"stages": [{"name": "a b"}]},
    {"stages": [{"name": "a"}, {"name": "a"}]}, {"stages": [{"name": "a", "where": {"units": "$b.units"}}]}, {"stages": [{"name": "a", "where": {"units": "$a.units"}}]}, {"queries": [{"where": {"units": ["$a.units"]}}]}, {"stages": [{"name": "a"}, {"name": "b", "where": {"units": "$a.id"}}]},
]


def test_good_plans_keep_their_meaning():
    p = Plan.from_dict(GOOD)
    assert p.queries[0].where.topics == (("a", True), ("b", False)) and p.queries[0].where.time == ("2023-05", "")
    assert Plan.from_dict(p.to_dict()) == p
    staged = {"stages": [{"name": "one", "where": {"grep": "x"}}, {"name": "two", "select": "lines", "where": {"units": "$one.units", "time": ["$one.date", ""]}}]}
    assert Plan.from_dict(staged).queries[1].where.units == ("$one.units",)


@pytest.mark.parametrize("plan", BAD)
def test_bad_plans_are_refused(plan):
    with pytest.raises(PlanError):
        Plan.from_dict(plan)


def test_a_plan_is_a_copy():
    d = {"queries": [{"where": {"kind": ["a"]}}]}
    p = Plan.from_dict(d)
    d["queries"][0]["where"]["kind"].append("b")
    assert p.queries[0].where.kind == ("a",)


@pytest.mark.parametrize(("pattern", "parts"), [("a|b", ["a", "b"]), ("(a|b)|c", ["(a|b)", "c"]), ("[a|b]", ["[a|b]"]), (r"a\|b|c", [r"a\|b", "c"]), ("a", ["a"]), ("a||b", ["a", "b"])])
def test_branches(pattern, parts):
    assert branches(pattern) == parts


def test_simple_patterns():
    assert is_simple("a|b c") and is_simple(r"a\|b") and not is_simple("a.*b") and not is_simple("a?")


@pytest.mark.parametrize(
    ("question", "want"),
    [("What happened on 2023-05-07?", Anchors("2023-05-07")), ("2023年5月7日做了什么", Anchors("2023-05-07")), ("On 7th May 2023, who came?", Anchors("2023-05-07")), ("On May 7, 2023 what did Zoe say?", Anchors("2023-05-07", "", ("zoe",))), ("What in May 2023?", Anchors("", "2023-05")), ("Nothing", Anchors())],
)
def test_anchors(question, want):
    assert anchors(question, ["zoe", "user", "al"]) == want


def test_fitting():
    p = Plan.from_dict({"queries": [{"where": {"grep": "first|kettle"}, "pipe": [{"op": "count"}]}], "intent": "enumeration"})
    q = fitted(p, "What did Zoe do on 2023-05-07?", Anchors("2023-05-07", "", ("zoe",))).queries[0]
    assert q.where.who == ("zoe",) and q.where.grep == "kettle" and q.where.time == ("2023-05-07", "2023-05-07") and q.pipe == ()
    assert fitted(p, "What since then?", Anchors("2023-05-07")).queries[0].where.time == ("", "")


def test_refusals():
    assert finished("Ana went to Rome.", "Where did Ana go?", ["premise"], ["Ana"])[1] == "premise"
    assert finished("Ana went to Rome.", "Can you recommend a place for Ana?", ["premise"], ["Ana"])[1] == ""
    assert finished("There is no record of it. She surely went to Rome with her sister in May.", "Where?", ["hedge"])[1] == "hedge"
    with pytest.raises(ValueError):
        finished("a", "b", ["nonsense"])
    assert finished("No information about Ana is stated anywhere in the records, she went to Rome in May.", "Where?", ["hedge"])[1] == ""
    assert finished("Ana went to Rome.", "Where did Ana go?", ["premise"], ["Ana"], may_refuse=False) == ("Ana went to Rome.", "")


def test_counts_of_sessions_answer():
    assert counts_units("How many sessions?", "factual", "units") and counts_units("When?", "aggregate", "units")
    assert not counts_units("How often did we meet, how many times?", "aggregate", "units") and not counts_units("How many?", "aggregate", "facts")


@pytest.mark.parametrize(
    ("pattern", "want"),
    [("a|b", "a|b"), ("(?P<n>a)(?P=n)", "(?<n>a)\\k<n>"), ("[", None), ("a(", None), ("[[a]", "[\\[a]"), ("[]a]", "[\\]a]"), ("a{b", "a\\{b"), ("a{2,3}", "a{2,3}"), ("a\\Z", "a\\z"), ("[a&&b]", "[a\\&\\&b]")],
)
def test_patterns_for_the_jvm(pattern, want):
    assert respelled(pattern) == want
