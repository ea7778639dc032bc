"""Problem 1."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from engramma.llm import queries as llm_queries
from engramma.llm.pii import Finder, find_pii, gazetteers, redact, redacted, reliabilities
from engramma.session import table
from tests.llm.heldout_pii import HELD_OUT

GIVEN, FAMILY = frozenset({"robert", "zoe", "amelie", "oskar"}), frozenset({"kottistrom", "vespehl", "drospissen"})
KNOWN = GIVEN, FAMILY, frozenset()

CASES = [
    ("write to a.b+memo@mail.example now", {"email"}),
    ("mail: yusuf dot k at mail dot altmoor dot example", {"email"}),
    ("cc <x_y[at]post.test> please", {"email"}),
    ("my handle there is @gosrelle_34", set()),
    ("ping me @ Ellnays Station around 10", set()),
    ("Call me on +1 212 555 0149 after six.", {"phone"}),
    ("Tel.: 030 23125 318", {"phone"}),
    ("06.39.98.87.02", {"phone"}),
    ("the clinic rang from five five five, oh one nine two", {"phone"}),
    ("Order 2158-8296-44 arrived early", set()),
    ("ticket 5772003338 was closed", set()),
    ("The book code is 978-0-00-514725-0.", set()),
    ("My SSN is 666-98-1590.", {"national_id"}),
    ("NI number QQ 62 62 80 C", {"national_id"}),
    ("Mi DNI es 00664749-X", {"national_id"}),
    ("Steuer-ID 00 501 387 343, bitte notieren", {"national_id"}),
    ("serial number K77372461 on the kettle", set()),
    ("Deliver it to Flat 11, 126 Upper Sorrow Lane, Pont-Ferrin", {"street_address"}),
    ("Ich wohne jetzt in der Am Torfkanal 14a.", {"street_address"}),
    ("J'habite au 23 rue des Tisserands-Bleus, 00808 Velderby.", {"street_address"}),
    ("Vivo en Avda. de los Telares, nº 41.", {"street_address"}),
    ("We walked down Ferrin Lane twice.", set()),
    ("It was Robert Vespehl who lent me the drill.", {"person_name"}),
    ("Ask for Dr. Drospissen at the desk.", {"person_name"}),
    ("my full name is Köttiström, Zoë", {"person_name"}),
    ("amélie vespehl will sign the form.", {"person_name"}),
    ("It was Robert who reserved the cabin, not Zoë.", set()),
    ("We agreed on 58 euros for the swimming badge.", set()),
]


@pytest.fixture(scope="module")
def texts(spark):
    # repeated so that the models see how the patterns go together
    rows = [("line", f"{i}-{k}", "", t, 1) for k in range(5) for i, (t, _) in enumerate(CASES)] + [("line", "null", "", None, 1), ("line", "empty", "", "", 1), ("line", "long", "", "word " * 40_000, 1)]
    return spark.createDataFrame(rows, "tbl string, rec_id string, turn_key string, text string, pii_type int")


def test_cases(spark, texts):
    got: dict[str, set] = {}
    for r in find_pii(spark, texts, KNOWN).collect():
        got.setdefault(r["rec_id"], set()).add(r["pii_type"])
    assert {t: got.get(f"{i}-0", set()) for i, (t, _) in enumerate(CASES)} == dict(CASES)
    assert not got.keys() & {"null", "empty", "long"}


def test_redaction_keeps_the_rest(spark, texts):
    out = {r["rec_id"]: r["text"] for r in redacted(texts, find_pii(spark, texts, KNOWN)).collect()}
    assert out["0-0"] == "write to [EMAIL] now"
    assert out["27-0"] == CASES[27][0] and out["null"] is None and out["empty"] == ""


def test_overlaps():
    assert redact("abcdef", [(1, 3, "x"), (2, 5, "y"), (1, 2, "z")]) == "a[X]def"


def test_empty_table(spark, texts):
    assert find_pii(spark, texts.limit(0), KNOWN).count() == 0


def test_reliabilities_are_recovered():
    rng = np.random.default_rng(0)
    truth = rng.random(6000) < 0.4
    votes = np.stack([np.where(rng.random(6000) < a, np.where(truth, 1, -1), np.where(truth, -1, 1)) * (rng.random(6000) < 0.8) for a in (0.95, 0.85, 0.8, 0.6)], 1).astype(int)
    patterns, inverse, count = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    theta, prior, p = reliabilities(patterns, count.astype(float))
    right = lambda j: theta[1, j, 2] / (theta[1, j, 2] + theta[1, j, 0])
    assert abs(prior[1] - 0.4) < 0.05 and abs(right(0) - 0.95) < 0.05 and right(0) > right(1) > right(3)
    assert ((p[inverse.ravel()] > 0.5) == truth).mean() > 0.9


def test_texts_of_any_kind_do_no_harm():
    finder = Finder(GIVEN, FAMILY)
    for t in ["@", "@@ @", "1" * 5000, "a@b" * 999, "\x00​", "Dr.", ", Robert", "Robert", "ROBERT VESPEHL" * 50, "+" * 300, "(" * 300 + "5"]:
        for kind, s, e, votes, _ in finder.spans(t):
            assert 0 <= s < e <= len(t) and len(votes) == 6 and kind


def test_turns_without_dia_id_are_redacted(spark, monkeypatch):
    turns = spark.createDataFrame([("s", "session_2", 0, "D2:1", "hi"), ("s", "session_2", 1, None, "write to ann.lee@post.example please")], "rec_id string, session string, pos int, dia_id string, text string")
    lines = spark.createDataFrame([("l1", "hello")], "id string, text string")
    stack = spark.createDataFrame([("q", 0, 0, "hello")], "rec_id string, session_pos int, turn_pos int, content string")
    names = spark.createDataFrame([("c", "ann")], "codebook_id string, speakers string")
    entities = spark.createDataFrame([("c", "ann_lee", "person", "Ann Lee", None)], "codebook_id string, code string, etype string, name string, aliases array<string>")
    monkeypatch.setattr(llm_queries, "table", lambda _, __, n: {"line": lines, "codebook": names, "entity": entities}.get(n))
    monkeypatch.setattr(llm_queries, "dialogue_turns", lambda _: turns)
    monkeypatch.setattr(llm_queries, "haystack_turns", lambda _: stack)
    got = {r["turn_key"]: r["text"] for r in llm_queries.p1_redacted(spark, "").where("tbl = 'locomo10'").collect()}
    assert got.keys() == {"D2:1", "session_2:1"} and "@" not in got["session_2:1"] and got["session_2:1"].startswith("write to ")
    assert {r["turn_key"] for r in llm_queries.utterances(spark, "").where("tbl = 'locomo10'").collect()} == {"D2:1"}


PARTS = st.sampled_from(
    "Robert robert Zoe Jean-Luc O'Brien Kottistrom vespehl Kowalski Fischer A. J Dr. Frau señora Am Torfkanal 14a rue de la Gare 12 St Street straße Hauptstr. 7 Calle Mayor c/ avda. "
    "jo@mail.example.org jo.smith @ [at] (AT) at AT dot DOT . , \t \n five oh double one two three +1 212 555 0149 ０３ 00 49 30 QQ 62 80 C 666-98-1590 x_y the Lane way by call ext. 978-0-00".split(" ")
)


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, max_size=14), st.sampled_from([" ", "", ", "]))
def test_what_is_not_searched_holds_nothing(parts, between):
    finder = Finder(GIVEN | {"jean-luc"}, FAMILY | {"o'brien"})
    text = between.join(parts)
    assert finder.spans(text) == finder.all_spans(text)


def test_addresses_after_the_word_at():
    finder = Finder(GIVEN, FAMILY)
    for text, want in [
        ("You can reach me at jo@mail.example.org today", "jo@mail.example.org"),
        ("email me at jo.smith@mail.example.org", "jo.smith@mail.example.org"),
        ("found at jo[At]mail.example.org", "jo[At]mail.example.org"),
        ("reach me at\tjo dot smith\tat\tmail Dot example", "jo dot smith\tat\tmail Dot example"),
        ("jo @ mail . example", "jo @ mail . example"),
    ]:
        assert [text[a:b] for kind, a, b, _, _ in finder.spans(text) if kind == "email"] == [want]


def test_a_street_ends_before_the_next_sentence():
    text = "Le livreur sonne au 1 bis, rue des Tisserands-Bleus J'ai un chien"
    assert [text[a:b] for kind, a, b, _, _ in Finder(GIVEN, FAMILY).spans(text) if kind == "street_address"] == ["1 bis, rue des Tisserands-Bleus"]


def test_utterances_apart_from_the_tables(spark, small):
    """Recall and precision on text that no template made, judged by models of a corpus that it is part of."""
    known = gazetteers(table(spark, small, "codebook"), table(spark, small, "entity"))
    own = spark.createDataFrame([("held", str(i), "", t) for i, (t, _) in enumerate(HELD_OUT)], "tbl string, rec_id string, turn_key string, text string")
    found = find_pii(spark, llm_queries.utterances(spark, small).unionByName(own), (known[0] | {"robert", "zoe", "benjamin", "amelie", "oskar", "ingrid", "henrik", "charles"}, *known[1:]))
    got = {(int(r["rec_id"]), r["pii_type"]) for r in found.where("tbl = 'held'").collect()}
    true = {(i, kind) for i, (_, kind) in enumerate(HELD_OUT) if kind}
    assert len(got & true) >= 0.9 * len(true) and len(got & true) >= 0.9 * len(got)
