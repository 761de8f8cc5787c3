"""Streams with state that stop and start again."""

import random

from turnloom import registry
from turnloom.operators import similarity
from turnloom.streaming import events as streams


def test_stream_keeps_what_the_table_keeps(spark, sf):
    queries = registry.load()
    key = lambda name: sorted(tuple(r) for r in queries[name].run(spark, sf).select("role", "conv_id", "turn").collect())
    assert key("str4_stream_dedup") == key("ud2_rouge_dedup")


def test_state_outlives_a_restart(spark, tmp_path):
    """Near copies within a batch, across batches and of texts that were dropped; empty and null texts stay."""
    rng = random.Random(5)
    base = [[f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 18))] for _ in range(6)]
    rows = []
    for i in range(90):
        text = list(rng.choice(base))
        for _ in range(rng.randrange(0, 5)):
            text[rng.randrange(len(text))] = f"n{rng.randrange(25)}"
        rows.append(("ab"[i % 2], i, {0: None, 1: " "}.get(i % 30, " ".join(text))))
    df = spark.createDataFrame(rows, "g string, i long, text string")
    parts = [df.filter(f"i >= {a} and i < {b}") for a, b in ((0, 20), (20, 21), (21, 90))]
    with streams.rocks_state(spark):
        out = streams.run_arrivals(parts, lambda s: streams.greedy_stream(s, "g", ["i"], "text", 0.6), *(str(tmp_path / x) for x in ("in", "out", "state")))
    got = sorted((r.g, r.i) for r in out.collect())
    want = sorted((r.g, r.i) for r in similarity.greedy_dedup(df, "g", ["i"], "text", 0.6).collect())
    assert got == want and 10 < len(got) < 80
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


class Held:
    """State of one group without Spark, with a count of what is read of the kept texts."""

    def __init__(self):
        self.value, self.by_key, self.rows, self.reads = None, {}, [], 0

    def exists(self):
        return self.value is not None

    def get(self):
        return iter(self.rows) if self.value is None else self.value

    def update(self, value):
        self.value = value

    def getValue(self, key):
        self.reads += 1
        return self.by_key[key]

    def updateValue(self, key, value):
        self.by_key[key] = value

    def appendList(self, rows):
        self.rows += rows


def test_few_kept_texts_are_read(tmp_path):
    """Texts of a second batch share common long words with all of the first; only near copies read one."""
    import pandas as pd

    rng = random.Random(43)
    common = [f"averylongcommonword{i}" for i in range(40)]
    texts = [[rng.choice(common) if rng.random() < 0.5 else f"r{rng.randrange(400)}" for _ in range(60)] for _ in range(400)]
    texts += [[x if i % 12 else "new" for i, x in enumerate(t)] for t in texts[:20]]
    df = pd.DataFrame({"i": range(len(texts)), "text": [" ".join(t) for t in texts]})
    flow = streams.GreedyTexts("text", ["i"], 0.7)
    flow.counts, flow.kept, flow.marks = Held(), Held(), Held()
    out = [x for part in (df[:200], df[200:]) for x in flow.handleInputRows(None, iter([part]), None)]
    kept = []
    for i, t in enumerate(texts):
        if all(similarity.rouge_l(texts[j], t) <= 0.7 for j in kept):
            kept.append(i)
    assert list(pd.concat(out)["i"]) == kept and len(kept) <= 400
    assert 20 <= flow.kept.reads < 60
