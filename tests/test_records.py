"""Compliance, serialisers and hardening on odd rows."""

import json

from pyspark.sql import functions as F

from turnloom.operators import hardening, sampling, schema

CATALOG = [("a", ["x", "y"]), ("b", []), ("c", None)]


def test_compliance(spark):
    calls = [
        '{"plan": "a", "arguments": {"x": 1}}', '{"plan": " a ", "arguments": {"z": {"x": 1}, "x": null, "w": 2}}', '{"plan": "zz", "arguments": {"x": 1}}', '{"plan": "a", "arguments": [1]}', '{"plan": "b", "arguments": {}}',
        '{"plan": "c", "arguments": {"x": 1}}', '{"plan": "None", "arguments": {}}', '{"arguments": {}}', "[1]", None,
    ]
    rows = spark.createDataFrame([(k, c, [["a", "b"], ["c"], None][k % 3]) for k, c in enumerate(calls)], "k long, call string, candidates array<string>")
    catalog = spark.createDataFrame(CATALOG, "plan string, arg_keys array<string>")
    read = lambda df: {r.k: (r.parse_ok, r.predicted_plan, r.arguments_is_object, r.plan_allowed, r.invalid_keys, r.compliant) for r in df.collect()}
    got = read(schema.compliance(rows, "call", catalog))
    assert got == {
        0: (True, "a", True, True, [], True), 1: (True, "a", True, True, ["z", "w"], False), 2: (True, "zz", True, False, ["x"], False), 3: (True, "a", False, True, [], False), 4: (True, "b", True, True, [], True),
        5: (True, "c", True, True, ["x"], False), 6: (True, "None", True, False, [], False), 7: (True, "", True, False, [], False), 8: (False, "", False, False, [], False), 9: (False, "", False, False, [], False),
    }
    assert read(schema.compliance(rows, "call", catalog, allow_none=True))[6][-1] and read(schema.compliance(rows, "call", catalog, allow_none=True))[7][-1]
    valid = {r.k: r.schema_valid for r in schema.compliance(rows, "call", catalog, allow_none=True, candidates="candidates").collect()}
    assert [k for k, v in valid.items() if v] == [0] and None not in valid.values()


def test_serialisers(spark):
    call = '{"plan": "p", "arguments": {"n": 1.50, "s": "a \\"b\\"", "o": {"l": [1, null]}, "z": null}}'
    df = spark.createDataFrame([(call,), ('{"plan": "p"}',), (None,)], "c string")
    code, text = zip(*((r.code, r.json) for r in df.select(schema.as_code(F.col("c")).alias("code"), schema.as_json(F.col("c")).alias("json")).collect()))
    assert code == ('p(n=1.5, s="a \\"b\\"", o={"l":[1,null]}, z=null)', "p()", None)
    assert json.loads(text[0]) == {"name": "p", "arguments": json.loads(call)["arguments"]} and json.loads(text[1]) == {"name": "p", "arguments": {}}
    spec = F.create_map(F.lit("s"), F.create_map(F.lit("type"), F.lit("t"), F.lit("description"), F.lit("d")), F.lit("q"), F.create_map(F.lit("type"), F.lit("t")))
    assert [r[0] for r in df.select(schema.pruned_spec(spec, F.col("c"))).collect()] == [{"s": {"description": "d"}}, {}, {}]
    rows = spark.createDataFrame([(1, ["c", "a", "none"]), (2, []), (3, None), (4, ["b", "a"])], "k long, candidates array<string>")
    docs = {r.k: r.docs for r in schema.tool_docs(rows, "k", "candidates", spark.createDataFrame(CATALOG[:2], "plan string, arg_keys array<string>")).collect()}
    assert docs == {1: "a(x=?, y=?)", 4: "b()\na(x=?, y=?)"}


def test_hardening_odd_rows(spark):
    rows = [
        (0, "set_timer", "q", "r", [], None, "x"), (1, "set_timer", "q", "r", None, "[1]", "x"), (2, "edit_alarm", "q", "r", ["t"], '{"hour": "late", "k": {"deep": [1, {"a": null}]}}', "x"), (3, "other", "q", "r", ["t"], "no json", "x"), (4, None, None, None, None, None, None),
        (5, "set_timer", "q", "r", ["turn 1: a -> Timers: 5 minutes - tea, eggs at 7 minutes", "turn 2: b -> c"], '{"duration": 1, "to": {"x": "ü"}}', "x"), (7, "set_tone", "q", "r", ["turn 1: a -> b", "turn 2: c -> d"], '{"uri": "u://1"}', "x"),
    ]
    df = spark.createDataFrame(rows, "k long, plan string, query string, rewrited_query string, history array<string>, arguments string, extra string")
    got = {r.k: r for r in hardening.harden_rows(df, "plan", "k").collect()}
    assert len(got) == len(rows) and got[3].asDict() == df.filter("k = 3").first().asDict() | {"template": None} and got[4].template is None and got[4].arguments is None
    assert got[0].template == got[1].template == "timer_none" and json.loads(got[0].arguments) == {"duration": "10 minutes"} and got[0].history == []
    assert got[2].template == "alarm_label" and json.loads(got[2].arguments) == {"k": {"deep": [1, {"a": None}]}, "hour": 7, "minute": 55, "label": " again"}
    assert got[5].template == "timer_after" and json.loads(got[5].arguments) == {"to": {"x": "ü"}, "duration": "10 minutes", "silent": True} and got[5].query.endswith("Eggs")
    assert got[7].template == "tone_heard" and got[7].history == ["turn 1: What tones are there? -> File 107 is u://1", "turn 2: c -> d"]
    report = {r.template: (r.rows, r.query, r.history, r.arguments) for r in hardening.mutation_report(df, hardening.harden_rows(df, "plan", "k"), "k").collect()}
    assert report[None] == (2, 0, 0, 0) and report["timer_none"] == (2, 2, 0, 2) and report["tone_heard"] == (1, 1, 1, 0)
    assert hardening.harden_rows(df.limit(0), "plan", "k").count() == 0


def test_two_streams(spark):
    rows = [(k, "p", k % 4 == 0, {0: True, 1: False, 2: None}[k % 3]) for k in range(60)] + [(100, "q", None, None)]
    df = spark.createDataFrame(rows, "k long, plan string, nr boolean, same boolean")
    out = sampling.two_streams(df, "plan", "k", F.col("nr"), F.col("same"), 0.5, {"NR": 3, "nonNR": 50}, 1).collect()
    assert {r.k for r in out} == {k for k, _, nr, same in rows if nr or not same}
    parts = [(r.stream, r.part) for r in out if r.plan == "p"]
    assert [parts.count(x) for x in (("NR", "train"), ("NR", "test"), ("NR", None), ("nonNR", "train"), ("nonNR", "test"))] == [3, 3, 9, 15, 15]
