"""Text vectors, exact neighbours in blocks and inverted lists against plain forms."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from turnloom.operators import retrieval

TURNS = "conv_id long, turn long, text string"


def grams(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])


def brute_selection(rows, k, recency):
    df = Counter(g for r in rows for g in grams(r[2]))
    vector = {}
    for conv, turn, text in rows:
        v = {g: (1 + math.log(n)) * (1 + math.log((1 + len(rows)) / (1 + df[g]))) for g, n in grams(text).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vector[conv, turn] = {g: x / norm for g, x in v.items()}
    out = set()
    for conv in {r[0] for r in rows}:
        last = max(r[1] for r in rows if r[0] == conv)
        q = vector[conv, last]
        scores = [(-round(sum(x * q.get(g, 0) for g, x in vector[conv, t].items()) + recency * (1 if last == 1 else t / (last - 1)), 9), t) for t in range(last)]
        chosen = sorted(scores)[:k]
        out |= {(conv, t, round(-s, 6), rank, sorted(x for _, x in chosen).index(t) + 1) for rank, (s, t) in enumerate(chosen, 1)}
    return out


ROWS = [
    (1, 0, "Set an alarm for tea"), (1, 1, "Which tea?"), (1, 2, None), (1, 3, ""), (1, 4, "Green TEA, an alarm at five"), (2, 0, "alone"),
    (3, 0, "a b c"), (3, 1, "a b c"), (4, 0, "x " * 9000 + "y"), (4, 1, "nothing like it"), (4, 2, "y x"), (5, 0, None), (5, 1, None),
]


@pytest.mark.parametrize(("k", "recency"), [(2, 0.0), (1, 0.5), (9, 0.1)])
def test_selection_is_that_of_the_plain_form(spark, k, recency):
    got = retrieval.select_history(spark.createDataFrame(ROWS, TURNS), k, recency).collect()
    assert {(r.conv_id, r.turn, round(r.score, 6), r.by_score, r.place) for r in got} == brute_selection(ROWS, k, recency)


def test_histories(spark):
    turns = spark.createDataFrame(ROWS, TURNS)
    chosen = retrieval.select_history(turns, 2)
    own = {r.conv_id: r.history for r in retrieval.formatted_history(chosen, turns, "original").collect()}
    score = {r.conv_id: r.history for r in retrieval.formatted_history(chosen, turns, "score", renumber=True).collect()}
    assert own[1] == ["turn 1: Set an alarm for tea", "turn 2: Which tea?"] and 2 not in own
    assert score[4] == ["turn 1: " + "x " * 9000 + "y", "turn 2: nothing like it"] and own[3] == ["turn 1: a b c"]
    with pytest.raises(ValueError):
        retrieval.formatted_history(chosen, turns, "newest")
    assert retrieval.select_history(turns.limit(0), 2).count() == 0


def brute_nearest(x, ids, queries, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = set()
    for q in queries:
        s = np.round(u @ u[ids.index(q)], 9)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out |= {(q, ids[i], round(float(s[i]), 9), r) for r, i in enumerate(order, 1)}
    return out


def test_blocks_and_lists_find_the_nearest(spark):
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(80, 6)), 3, axis=0).astype(np.float32).astype(np.float64)  # each vector thrice: ties
    x[1::3] += rng.normal(size=(80, 6)).astype(np.float32) * 0.01
    x = x.astype(np.float32).astype(np.float64)
    ids = [int(i) for i in rng.permutation(240)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)] + [(None, [1.0] * 6), (999, None)], "k long, v array<double>")
    asked = df.filter("k % 5 = 0 and v is not null")
    want = brute_nearest(x, ids, [i for i in ids if i % 5 == 0], 4)
    read = lambda found: {(r.query, r["item"], round(r.score, 9), r["rank"]) for r in found.collect()}
    for blocks in ((4096, 32_768), (7, 31)):
        assert read(retrieval.top_k(asked, df, "k", "k", "v", 4, *blocks)) == want
    index = retrieval.build_index(df, "k", "v", 4)
    assert index.recall >= 0.95 and index.items.count() == 240 and len(index.centroids) == 7
    every = retrieval.search(index, asked, "k", "v", 4, probes=len(index.centroids), query_block=9, item_block=11)
    assert read(every) == want
    found = {x[:2] for x in read(retrieval.search(index, asked, "k", "v", 4))}
    assert len(found & {x[:2] for x in want}) >= 0.9 * len(want)


def test_an_index_of_nothing(spark):
    none = spark.createDataFrame([], "k long, v array<float>")
    index = retrieval.build_index(none, "k", "v")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "k long, v array<float>")
    assert retrieval.search(index, asked, "k", "v", 3).count() == 0 and retrieval.top_k(asked, none, "k", "k", "v", 3).count() == 0
    one = retrieval.build_index(asked, "k", "v")
    assert retrieval.search(one, spark.createDataFrame([(2, [1.0, 1.0])], "k long, v array<float>"), "k", "v", 3).count() == 1


def test_recall_over_the_whole_table(spark, sf):
    """Recall at 10 of all ids divisible by 20 against all rows."""
    from turnloom import registry

    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    exact = retrieval.top_k(rows.filter("vec_id % 20 = 0"), rows, "vec_id", "vec_id", "embedding", 10)
    found = registry.load()["ud8_inverted_lists"].run(spark, sf)
    both = exact.join(found.select("query", "item"), ["query", "item"]).count()
    assert both >= 0.9 * exact.count() > 0
