"""The edit-distance join against all pairs, and rewrites on odd texts."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from turnloom.operators import matching


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("k", [1, 2, 3])
def test_edit_join_finds_all_pairs(spark, k):
    rng = random.Random(k)
    words = {"", "a", "é", "ab", "\U0001f600", "x" * 2000, "x" * 1999, "x" * 1996}
    words |= {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 14))) for _ in range(160)}
    words |= {"common" + "".join(rng.choice("abcdef") for _ in range(6)) for _ in range(40)}
    df = spark.createDataFrame([(w,) for w in [*words, *words, None]], "w string")
    got = [tuple(r) for r in matching.edit_join(df, "w", k).collect()]
    short = [w for w in words if len(w) < 100]
    want = {(a, b, distance(a, b)) for a, b in itertools.permutations(short, 2) if (len(a), a) < (len(b), b) and abs(len(a) - len(b)) <= k and distance(a, b) <= k}
    want |= {("x" * m, "x" * n, n - m) for m, n in ((1999, 2000), (1996, 1999)) if n - m <= k}
    assert len(got) == len(set(got)) and set(got) == want
    assert matching.edit_join(df.limit(0), "w", k).count() == 0


def test_rewrites(spark):
    rows = [
        ("call 010-1234-5678 now", "Please ring 010-1234-5678 at once", False, True), ("call 010-1234-5678", "call 010-1234-5679", True, False),
        ("mail a@b.co or see https://x.org/a", "see https://x.org/a, or write to a@b.co, soon", False, False), ("go to 12 Elm Street for Anna", "drive over to 12 Oak Street for Anna", False, True),
        ("meet Anna in Bonn", "in Bonn, meet with Anna and Anna", False, True), ("meet Anna", "say hello to Berta", False, False), (None, "abc", True, True), (None, None, True, True),
    ]
    df = spark.createDataFrame(list(rows), "a string, b string, close boolean, same boolean").withColumn("m", matching.rewrite_match(F.col("a"), F.col("b")))
    for r in df.collect():
        assert (r.m.close, r.m.same_entities) == (r.close, r.same) and r.m.correct == (r.close or r.same), r


def test_greedy_candidates_are_near_pairs_only(spark):
    """300 unlike texts with common words and 30 near copies: all near pairs are candidates, and hardly another."""
    import random

    from turnloom.operators import similarity

    rng = random.Random(41)
    common = [f"c{i}" for i in range(40)]
    rows = [[rng.choice(common) if rng.random() < 0.5 else f"r{rng.randrange(400)}" for _ in range(60)] for _ in range(300)]
    rows += [[x if i % 12 else "new" for i, x in enumerate(t)] for t in rows[:30]]
    df = spark.createDataFrame([(i, 1, t) for i, t in enumerate(rows)], "__id long, __g long, t array<string>")
    texts = df.select("__id", "__g", similarity.word_hashes(df["t"]).alias("__words"))
    got = {tuple(r) for r in similarity.candidate_pairs(texts, 0.7).collect()}
    want = {(i, j) for j in range(len(rows)) for i in range(j) if similarity.rouge_l(rows[i], rows[j]) > 0.7}
    assert len(want) >= 30 and want <= got and len(got) < 3 * len(want)
