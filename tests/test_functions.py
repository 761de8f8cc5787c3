"""Literal parsers, histories and strings on the edge cases of the fixtures."""

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnloom.functions import history as H
from turnloom.functions import literals as L
from turnloom.functions import strings
from turnloom.operators import similarity


def test_canonical_equality():
    assert L.canonical({"x": 1}) == L.canonical({"x": 1.0}) == L.canonical({"x": True})
    assert L.canonical({"b": " v ", "a": [2, 1]}) == '{"a":[2,1],"b":"v"}'
    assert L.canonical({"x": "1"}) != L.canonical({"x": 1})


@pytest.mark.parametrize(
    ("text", "parser"),
    [
        ("<tool_call>{'plan': 'a', 'arguments': {'x': None}}</tool_call>", "tags"),
        ("{'plan': 'a', 'arguments': {'x': None}}", "literal"),
        ('Sure!\n```json\n{"plan": "a", "arguments": {"x": null}}\n```', "literal"),
        ("a(x=None)", "call"),
        ("a: {x: null}", "keyed"),
        ("plan: a\nx: null", "yaml"),
        ('so {"plan": "a", "arguments": {"x": null', "closed"),
    ],
)
def test_generation_strategies(text, parser):
    call, used = L.parse_generation(text)
    assert json.loads(call)["plan"] == "a" and json.loads(call)["arguments"] == {"x": None}, used
    assert used == parser or parser == "literal"


def test_generation_failures():
    assert L.parse_generation(None) == (None, "none") and L.parse_generation("no call here") == (None, "none")
    assert L.embedded("a {'x': 1} b [1, {'y': 2}] {broken: } c") == ['{"x":1}', "1", '{"y":2}']
    assert L.decode_answer(json.dumps(json.dumps({"a": 1}))) == {"a": 1} and L.decode_answer("") is None
    assert [L.answer_plan(x) for x in (None, " ", "{", "[1]", "{}", "{'plan': ' '}", "{'plan': 3}")] == ["MISSING_ANSWER", "EMPTY_ANSWER", "INVALID_ANSWER", "NON_DICT_ANSWER", "MISSING_PLAN", "EMPTY_PLAN", "3"]
    assert L.quote_bare_keys("{a: 'x, b: 1', c : [d: 2]}") == """{"a": 'x, b: 1', "c" : ["d": 2]}"""
    assert L.history_items("['turn 3: a', '', 'b']") == [(3, "turn 3: a"), (2, "b")] and L.history_items("hello") == [(1, "hello")] and L.history_items(None) == []
    assert L.assign_list(["a", 1, "x", "attachments", "f"], ["b", "a", "attachments"]) == {"a": 1, "attachments": ["f"], "b": "x"} and L.assign_list([], ["a"]) is None
    assert L.without_required([{"parameters": {"required": ["a"], "properties": {"required": 1}}}]) == [{"parameters": {"properties": {"required": 1}}}]
    assert L.model_output("x", "call")[0] == "no_json_object_found" and L.model_output('{"arguments": {}}', "call")[0] == "missing_name"
    assert L.normalise_plan("Act", ["action_act", "b"]) == "action_act" and L.normalise_plan("zzz", ["b"]) == "zzz"
    assert L.assign(["2", "b=3", "'x, y'"], ["a", "b", "c"]) == {"b": 3, "a": 2, "c": "x, y"}


@given(st.text(max_size=60))
def test_parsers_never_raise(text):
    L.parse_generation(text), L.embedded(text), L.jsonish(text), L.parse_calls(text), L.history_items(text), L.answer_plan(text), L.quote_bare_keys(text), L.first_object(text)


@given(st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text("ab'\" {}", max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("abc", min_size=1, max_size=3), x, max_size=3), max_leaves=6))
def test_literals_round_trip(value):
    if isinstance(value, (dict, list)) and value:
        assert L.canonical(L.jsonish(repr(value))) == L.canonical(value)


def test_history(spark):
    rows = [(1, ["turn 1: a -> b", "turn 2: c -> d", "turn 3: e -> f"]), (2, []), (3, ["x"])]
    df = spark.createDataFrame(rows, "id long, h array<string>")
    got = {r.id: r for r in df.select("id", H.last_k(F.col("h"), 0).alias("k0"), H.last_k(F.col("h"), 2).alias("k2"), H.last_k(F.col("h"), 5).alias("k5"), H.append(F.col("h"), F.lit("q"), F.lit("r")).alias("more"), H.splice(F.col("h"), F.reverse("h"), 1).alias("s")).collect()}
    assert got[1].k0 == [] and got[1].k2 == rows[0][1][1:] and got[1].k5 == rows[0][1] and got[2].k2 == []
    assert got[1].more[-1] == "turn 4: q -> r" and got[2].more == ["turn 1: q -> r"]
    assert got[1].s == ["turn 1: a -> b", "turn 2: c -> d", "turn 1: a -> b"]


def test_strings(spark):
    row = spark.range(1).select(
        strings.cut_at_markers(F.lit("abc STOP d END"), ["END", "STOP"]).alias("cut"), strings.cut_at_markers(F.lit(" abc "), []).alias("same"),
        strings.clock_12h(F.lit(0)).alias("midnight"), strings.clock_12h(F.lit(780)).alias("one"), strings.shift_minutes(F.lit(10), -30).alias("back"),
        strings.suffix_kind(F.lit("http://x/y.PDF")).alias("pdf"), strings.suffix_kind(F.lit("http://x/y")).alias("none"), strings.entities(F.lit("a@b.co, a@b.co c@d.org"), strings.EMAIL).alias("mails"),
    ).first()
    assert tuple(row) == ("abc", " abc ", "12:00 AM", "1:00 PM", 1420, "pdf", "generic", ["a@b.co", "c@d.org"])


@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert similarity.lcs_length(a, b) == table[-1][-1]


def test_timers(spark):
    said = {
        "turn 1: q -> You have: 5 minutes - the Tea, eggs at 7 minutes": [(5, "Tea"), (7, "eggs")],
        "turn 2: 3 min left? -> Two timers: 5 mins left on your pasta and 12 minutes remaining for the roast": [(5, "pasta"), (12, "roast")],
        "turn 3: q -> Timers: [rice \u2014 9 min remaining]; 1) Rice - 9 minutes. the soup with 4 minutes to go": [(9, "rice"), (4, "soup")],
        "turn 4: q -> none of them, 5 minutes": [], "": [], None: [],
    }
    df = spark.createDataFrame([(k, v) for k, v in enumerate(said)], "k int, turn string")
    got = {r.k: [tuple(x) for x in r.t] for r in df.select("k", strings.timer_items(F.col("turn")).alias("t")).collect()}
    assert got == dict(enumerate(said.values()))


@pytest.mark.parametrize(
    ("text", "mode", "strict", "want"),
    [
        ('{"rewritten_query": "", "query": "q"}', "rewrite", False, ("ok", '{"rewritten_query":"q"}')),
        ('{"rewritten_query": 5, "query": "q"}', "rewrite", False, ("missing_rewritten_query", None)),
        ('{"query": "q"}', "rewrite", True, ("missing_confirmed_arguments", None)),
        ('{"query": "q", "confirmed_arguments": 0}', "rewrite", False, ("confirmed_arguments_not_object", None)),
        ('{"name": "", "plan": "p"}', "call", False, ("ok", '{"arguments":{},"name":"p"}')),
        ('{"name": "n", "arguments": null}', "call", False, ("arguments_not_object", None)),
        (None, "call", False, ("no_json_object_found", None)),
    ],
)
def test_output_contracts(text, mode, strict, want):
    assert L.model_output(text, mode, strict) == want
