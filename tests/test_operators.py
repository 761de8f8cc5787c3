"""Relational operators on inline fixtures with ties, nulls, duplicates and empties; sources, sinks and streams."""

import pytest
from pyspark.sql import functions as F

from turnloom.functions import strings
from turnloom.operators import generation, joins, metrics, ranking, sampling, similarity
from turnloom.sources import readers, sinks
from turnloom.streaming import events as streams


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_bag_join(spark):
    build = frame(spark, [("k", 1), ("k", 2), ("k", 3)], "q string, a long")
    probe = frame(spark, [("k", i) for i in range(4)] + [("z", 9)], "q string, p long")
    got = {(r.p, r.a, r.u_key) for r in joins.bag_join(probe, build, ["q"], ["p"], ["a"]).collect()}
    assert got == {(0, 3, "3"), (1, 2, "2"), (2, 1, "1")}


def test_keep_first_exempt(spark):
    rows = [("x", "A-1", 0), ("x", "B-1", 1), ("x", "C-1_NR", 2), (None, "D-1", 3), (None, "E-1", 4)]
    df = frame(spark, rows, "r string, id string, _pos long")
    assert {r.id for r in ranking.keep_first_exempt(df, ["r"], ["_pos"], F.col("id").endswith("_NR")).collect()} == {"A-1", "C-1_NR", "D-1", "E-1"}
    assert [r.id for r in ranking.keep_last(df.filter("r is not null"), ["r"], ["_pos"]).collect()] == ["C-1_NR"]


def test_macros(spark):
    df = frame(spark, [("A", True), ("B", False), ("B", False), ("B", False), (None, True), ("A", None)], "plan string, ok boolean")
    assert metrics.plan_macro(df.filter("ok is not null"), F.col("ok")).first().plan_macro == 0.5
    assert metrics.plan_macro(df, F.col("ok")).first().plan_macro == 0.25
    assert df.filter("plan is not null and ok is not null").agg(metrics.share(F.col("ok")).alias("m")).first().m == 0.25
    assert metrics.plan_macro(df.limit(0), F.col("ok")).first().plan_macro is None


def test_weighted_macro_uses_present_buckets(spark):
    macros = frame(spark, [(3, "nonNR", 0.4)], "turn long, bucket string, plan_macro double")
    weights = frame(spark, [(3, "complex_1", 7), (3, "nonNR", 3)], "turn long, bucket string, w int")
    assert metrics.weighted_turn_macro(macros, weights).first().weighted == pytest.approx(0.4)


def test_stratified_split_caps(spark):
    rows = [(f"p{n}", n * 1000 + i) for n in (1, 2, 7, 200) for i in range(n)]
    out = sampling.stratified_split(frame(spark, rows, "plan string, id long"), "plan", "id", 0.7, 50, 1)
    counts = {(r.plan, r.part): r["count"] for r in out.groupBy("plan", "part").count().collect()}
    assert [(counts.get((f"p{n}", "train"), 0), counts.get((f"p{n}", "test"), 0)) for n in (1, 2, 7, 200)] == [(0, 1), (1, 1), (4, 3), (50, 50)]


def test_apportion(spark):
    counts = frame(spark, [("A", 10), ("B", 5), ("C", 1)], "plan string, n long")
    assert {r.plan: r.alloc for r in sampling.apportion(counts, "plan", 10, 4).collect()} == {"A": 5, "B": 4, "C": 1}
    assert {r.plan: r.alloc for r in sampling.apportion(counts, "plan", 99, 4).collect()} == {"A": 10, "B": 5, "C": 1}
    with pytest.raises(ValueError):
        sampling.apportion(counts, "plan", 3, 4)


def test_trend_offenders(spark):
    df = frame(spark, [("m", 0.9, 0.9, 0.8, 0.8, 5), ("o", 0.5, 0.6, 0.5, 0.4, 5), ("s", 0.1, 0.2, 0.3, 0.4, 1)], "p string, a double, b double, c double, d double, n long")
    got = {r.p: (round(r.delta, 9), r.offender) for r in metrics.trend_offenders(df, ["a", "b", "c", "d"], ["n"], 2).collect()}
    assert got == {"m": (-0.1, False), "o": (-0.1, True)}


def test_slot_metrics(spark):
    df = frame(spark, [(["a=1", "b=2"], ["a=1", "c=3"]), ([], []), (["a=1"], [])], "g array<string>, p array<string>")
    got = [tuple(r) for r in df.select(*metrics.slot_metrics(F.col("g"), F.col("p"))).collect()]
    assert got == [(1, 0.5, 0.5, 0.5), (0, 1.0, 1.0, 1.0), (0, 0.0, 0.0, 0.0)]


def test_bootstrap_is_seeded_and_brackets_the_macro(spark):
    counts = frame(spark, [("A", 100, 80), ("B", 50, 25)], "plan string, n long, hits long")
    a, b = (metrics.bootstrap_ci(counts).first() for _ in range(2))
    assert a == b and a.low < 0.65 < a.high and abs(a.mean - 0.65) < 0.01


def test_greedy_dedup(spark):
    rows = [("t", 0, "set an alarm for nine today"), ("t", 1, "set an alarm for nine"), ("t", 2, "play some music"), ("u", 3, "set an alarm for nine"), ("t", 4, None)]
    df = frame(spark, rows, "tool string, _pos long, text string")
    assert sorted(r._pos for r in similarity.greedy_dedup(df, "tool", ["_pos"], "text", 0.7).collect()) == [0, 2, 3, 4]


def test_generation_ladder_and_errors(spark):
    def backend(prompt, temperature):
        if prompt == "boom":
            raise RuntimeError("down")
        return "ok" if temperature >= 0.2 else "bad"

    df = frame(spark, [(0, "x"), (1, "boom"), (2, None)], "_pos long, prompt string")
    got = {r._pos: (r.output, r.attempts, r.valid, r.error) for r in generation.generate(df, "prompt", backend, lambda x: x == "ok", 2).collect()}
    assert got == {0: ("ok", 2, True, None), 1: (None, 3, False, "RuntimeError: down"), 2: ("ok", 2, True, None)}


def test_distractors_hold_the_gold(spark):
    out = sampling.distractors(frame(spark, [("a", 1), ("b", 2)], "gold string, id long"), "gold", "id", list("abcdefg"), 4, 1).collect()
    assert all(len(set(r.candidates)) == 5 and r.gold in r.candidates for r in out)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": 2, "y": "é"}\n')
    assert readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "x long, y string").count() == 2
    (tmp_path / "t.tsv").write_text('﻿q\tanswer\n"multi\nline"\t{\'plan\': \'a\'}\n', encoding="utf-8")
    t = readers.read_tsv(spark, str(tmp_path / "t.tsv"), ["q", "answer"])
    assert t.first() == ("multi\nline", "{'plan': 'a'}")
    (tmp_path / "c.jsonl").write_text('{"plan": "p", "arguments": {"b": {"type": "int"}, "a": {}}, "next_turn_plans": [{"plan": "q"}]}\n{"plan": "p", "arguments": {"z": {}}}\nnoise\n')
    assert [tuple(r) for r in readers.catalog_keys(readers.read_catalog(spark, str(tmp_path / "c.jsonl"))).collect()] == [("p", ["z"])]
    (tmp_path / "m.json").write_text('{"p": ["a", "b"], "q": []}')
    assert {r.plan: r.arg_keys for r in readers.read_json_map(spark, str(tmp_path / "m.json")).collect()} == {"p": ["a", "b"], "q": []}
    (tmp_path / "d.txt").write_text('noise {"source_id": "s", "turn_index": 1, "user": " a  b ", "assistant": "c"}\n{"source_id": "s", "user": "", "assistant": "c"}\nx\n')
    assert [tuple(r) for r in readers.read_dirty_pairs(spark, str(tmp_path / "d.txt")).collect()] == [("s", 1, "a b", "c")]
    (tmp_path / "x.tsv").write_text("\tnonNR\tcomplex_1\n\tf1\tf2\np\t0.5\t\nq\t1\t0.25\n")
    assert {tuple(r) for r in readers.read_matrix(spark, str(tmp_path / "x.tsv")).collect()} == {("p", "nonNR", "f1", 0.5), ("q", "nonNR", "f1", 1.0), ("q", "complex_1", "f2", 0.25)}
    (tmp_path / "def.txt").write_text("it2_nonNR p 3\nit2_nonNR p 9\nit3_nonNR q\nbad\n")
    assert [tuple(r) for r in readers.read_deficits(spark, str(tmp_path / "def.txt"), turn=2).collect()] == [("it2_nonNR", "p", 3)]
    assert readers.file_group(["it10.tsv", "it2.tsv", "it2_NR_.tsv"], exclude="_NR_", extra=["z"]) == ["it2.tsv", "it10.tsv", "z"]
    assert readers.parse_test_keys("b, a,b", ["a", "b"]) == ["b", "a"]
    with pytest.raises(ValueError):
        readers.parse_test_keys("c", ["a"])
    with pytest.raises(ValueError):
        readers.require_columns(t, ["missing"])
    assert any(p.endswith("it2.tsv") for p in readers.file_group([f"{tmp_path}/it2.tsv"]))
    assert [p.rsplit("/", 1)[1] for p in readers.list_files(spark, str(tmp_path), "*.tsv")] == ["t.tsv", "x.tsv"]
    df = frame(spark, [("A", 1, True), ("B", 2, False), ("A", 3, None)], "p string, n long, keep boolean")
    sinks.write_partitioned(df, str(tmp_path / "parts"), ["p"])
    assert spark.read.parquet(str(tmp_path / "parts")).filter("p = 'A'").count() == 2
    sinks.write_tsv(df, str(tmp_path / "out"), ["n", "p"])
    assert readers.read_tsv(spark, str(tmp_path / "out")).columns == ["n", "p"]
    sinks.write_split(df.filter("keep is not null"), "keep", str(tmp_path / "kept"), str(tmp_path / "rest"))
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 1 == spark.read.parquet(str(tmp_path / "rest")).count()
    assert sinks.markdown(df.select("n").orderBy("n")).splitlines()[2] == "| 1 |" and "tabular" in sinks.latex(df.select("n"))


def test_fresh_keys(spark):
    old = frame(spark, [("A-100",), ("B-7",)], "id string")
    new = frame(spark, [("A-100", 0), ("A-100", 1), ("C-1", 2), ("B-7", 3)], "id string, _pos long")
    got = [r.id for r in sinks.fresh_keys(new, old, "id", ["_pos"]).orderBy("_pos").collect()]
    assert got[:2] == ["A-101", "A-102"] and got[2] == "C-1" and got[3] == "B-100" and len(set(got)) == 4


def test_streams(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    q = streams.windowed_counts(stream, "1 day", late="40 days").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    batch = streams.windowed_counts(spark.read.parquet(f"{sf}/events.parquet"), "1 day")
    assert spark.table("w").agg(F.sum("n")).first()[0] == batch.agg(F.sum("n")).first()[0]
    for _ in range(2):
        q = stream.writeStream.foreachBatch(streams.append_new(str(tmp_path / "o"), "event_id")).option("checkpointLocation", str(tmp_path / f"c{_}")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == spark.read.parquet(f"{sf}/events.parquet").count()
    q = streams.quota_stream(stream, "event_type", 5).writeStream.outputMode("append").format("memory").queryName("k").start()
    q.processAllAvailable()
    q.stop()
    assert {r["count"] for r in spark.table("k").groupBy("event_type").count().collect()} == {5}


def greedy(texts, bound):
    """Which texts the plain filter keeps: those that are at most ``bound`` like each one kept before."""
    kept, flags = [], []
    for text in texts:
        tokens = (text or "").lower().split()
        flags.append(all(similarity.rouge_l(other, tokens) <= bound for other in kept))
        kept += [tokens] if flags[-1] else []
    return flags


def test_greedy_dedup_is_the_greedy_filter(spark):
    import random

    rng = random.Random(3)
    rows = []
    for g in "ab":
        base = [[rng.choice("v w x y z uu vv ww xx yy".split()) + str(rng.randrange(3)) for _ in range(rng.randrange(1, 25))] for _ in range(12)]
        for i in range(150):
            text = list(rng.choice(base))
            for _ in range(rng.randrange(0, 6)):
                text[rng.randrange(len(text))] = f"n{rng.randrange(40)}"
            rows.append((g, i, rng.choice([" ".join(text), " ".join(text).upper(), "", None]) if i % 9 == 0 else " ".join(text)))
    rng.shuffle(rows)
    want = set()
    for g in "ab":
        own = sorted((r for r in rows if r[0] == g), key=lambda r: r[:2])
        want |= {r[:2] for r, kept in zip(own, greedy([r[2] for r in own], 0.7)) if kept}
    df = frame(spark, rows, "g string, i long, text string")
    got = similarity.greedy_dedup(df, "g", ["i"], "text", 0.7).collect()
    assert {(r.g, r.i) for r in got} == want and len(got) == len(want) < 300
    assert similarity.greedy_dedup(df.limit(0), "g", ["i"], "text", 0.7).count() == 0


def test_verdicts(spark):
    said = ["N/A", '"N/A"', "{}", '{"a": {"status": "Pass"}}', '{"a": {}, "b": {"status": "?"}}', '{"a": {"status": "Fail"}, "b": {}}', '{"a": null}', '{"a": 1}', "[]", "text", None, "null", '{"a": {']
    df = frame(spark, list(enumerate(said)), "k long, response string")
    assert [r.k for r in joins.drop_failed(df, df, "k", strings.bad_verdict(F.col("response"))).orderBy("k").collect()] == [0, 1, 2, 3, 4]


def test_file_names(spark):
    df = frame(spark, [("it10_complex_2.tsv",), ("it2_complex_10.tsv",), ("it2_complex_9.tsv",), ("it2_nonNR.tsv",), ("x.tsv",), ("turn3.tsv",), (None,)], "f string")
    got = {r.f: tuple(r)[1:] for r in df.select("f", *(strings.file_turn(F.col("f"), x) for x in ("search", "anchored", "turn", "prefixed"))).collect()}
    assert got["it10_complex_2.tsv"] == (10, 10, None, None) and got["turn3.tsv"] == (None, None, 3, None) and got["it2_nonNR.tsv"] == (2, 2, None, 2)
    assert got[None] == (None,) * 4 == got["x.tsv"]
    order = {x: [r.f for r in df.dropna().orderBy(*strings.file_order(F.col("f"), x)).collect()] for x in ("rising", "falling", "plain_first")}
    assert order["rising"][:3] == ["it2_complex_9.tsv", "it2_complex_10.tsv", "it2_nonNR.tsv"] and order["falling"][0] == "it2_complex_10.tsv"
    assert order["plain_first"] == ["it2_nonNR.tsv", "it10_complex_2.tsv", "it2_complex_9.tsv", "it2_complex_10.tsv", "turn3.tsv", "x.tsv"]


def test_round_robin_reuse(spark):
    df = frame(spark, [("a", 1), ("a", 2), ("b", 3), (None, 4)], "q string, k long")
    rows = ranking.round_robin_reuse(df, "q", "k", 10, 5).collect()
    assert [r.turn for r in rows] == [1, 1, 1, 2, 2, 2, 3, 3, 3, 4] and [r.q for r in rows[:3]] == [None, "a", "b"]
    taken = [r.k for r in rows if r.q == "a"]
    assert sorted(taken[:2]) == [1, 2] and len(taken) == 3
    assert ranking.round_robin_reuse(df.limit(0), "q", "k", 10, 5).count() == 0


def test_line_windows(spark):
    df = spark.range(10).toDF("k")
    assert [r["values"] for r in ranking.line_windows(df, F.col("k"), ["k"], 4, "k").orderBy("window").collect()] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]
    assert ranking.line_windows(df.limit(0), F.col("k"), ["k"], 4, "k").count() == 0


def test_masked_labels(spark):
    df = frame(spark, [("a b c d", "a b"), ("a", "a b c"), ("", ""), (None, None)], "p string, q string")
    ids = df.select(strings.masked_labels(strings.word_ids(F.col("p")), strings.word_ids(F.col("q")), 3).alias("x")).select("x.*").collect()
    assert [r.labels[:2] for r in ids] == [[-100, -100], [-100], [], []] and ids[0].labels[2] == ids[0].input_ids[2] and len(ids[0].input_ids) == 3


def test_file_splits(spark, tmp_path):
    for name in ("train", "test"):
        (tmp_path / f"{name}.tsv").write_text(f"a\n{name}\n")
    splits = readers.read_tsv_splits(spark, [str(tmp_path / "train.tsv"), str(tmp_path / "test.tsv")])
    assert {k: v.first()[0] for k, v in splits.items()} == {"train": "train", "test": "test"}
    with pytest.raises(ValueError):
        readers.read_tsv_splits(spark, ["x/train.tsv", "y/train.csv"])


def test_epochs_are_written_over(spark, tmp_path):
    write = streams.write_epochs(str(tmp_path / "o"))
    for epoch, rows in ((0, 5), (1, 3), (0, 2)):
        write(spark.range(rows), epoch)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 5


def test_rows_without_a_result_are_passed_over(spark):
    df = frame(spark, [(1, "a"), (2, None), (3, "c")], "k long, v string")
    out = generation.map_rows(df, {"w": F.upper("v")}, remove=["v"])
    assert out.columns == ["k", "w"] and sorted(tuple(r) for r in out.collect()) == [(1, "A"), (3, "C")]
    assert generation.map_rows(df, {"w": F.upper("v")}, limit=1).count() == 1


def test_slices_number_a_group_as_one_window_does(spark):
    rows = [("hot" if i % 3 else ("cold" if i % 2 else None), i % 1500) for i in range(3000)] + [("one", None)]
    df = frame(spark, rows, "g string, k long")
    order = [ranking.hash_order(4, "k"), F.col("k")]
    want = ranking.ranked(df, ["g"], order, "n")
    got = ranking.hash_ranked(df, ["g"], "k", 4, "n", "size")
    assert sorted(map(repr, got.select("g", "k", "n").collect())) == sorted(map(repr, want.collect()))
    sizes = {r.g: r["count"] for r in df.groupBy("g").count().collect()}
    assert all(r.size == sizes[r.g] for r in got.select("g", "size").distinct().collect())
    assert ranking.hash_ranked(df.limit(0), ["g"], "k", 4, "n").count() == 0


def test_retrievers(spark):
    df = frame(spark, [(1, ["a"]), (2, ["a", "b", "c"]), (3, [])], "k long, gold array<string>")
    got = {r.k: r.tools for r in sampling.gold_and_others(df, "gold", "k", list("abcde"), 2, 1).collect()}
    assert got[2] == ["a", "b", "c"] and got[1][0] == "a" and len(set(got[1])) == 2 and len(set(got[3])) == 2
    asked = frame(spark, [("b",), ("none",), (None,)], "q string")
    tools = generation.model_retrieve(asked, "q", {"a": "first\nrest", "b": ""}, 1, lambda prompt, _: '["b", "z", null]' if prompt.endswith("Request: b") else "no list")
    assert {r.q: r.tools for r in tools.collect()} == {"b": ["b"], "none": [], None: []}


def test_ranges_number_a_group_as_one_window_does(spark):
    import random

    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, rng.randrange(9), rng.randrange(10**12)]), i) for i in range(900)]
    df = frame(spark, rows, "g string, x long, i long")
    want = sorted(map(str, ranking.ranked(df, ["g"], ["x", "i"], "n").collect()))
    out = ranking.numbered(df, ["g"], ["x", "i"], "n", "of")
    assert sorted(map(str, out.drop("of").collect())) == want
    sizes = {g: sum(r[0] == g for r in rows) for g in ("a", "b", None)}
    assert all(r.of == sizes[r.g] for r in out.collect()) and ranking.numbered(df.limit(0), ["g"], ["x"], "n").count() == 0
    spent = ranking.budgeted(frame(spark, [(p, i, rng.randrange(9)) for p in "pq" for i in range(200)], "p string, f long, a long"), "p", "f", "a", 50).collect()
    for p in "pq":
        before = 0
        for r in sorted((r for r in spent if r.p == p), key=lambda r: r.f):
            assert r.quota == (0 if before > 50 else r.a)
            before += r.a
