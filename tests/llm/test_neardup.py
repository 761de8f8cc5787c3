"""Near copies of documents against brute force over all pairs."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from turnloom.llm import neardup


def grams(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def slow_kept(rows, least=0.8):
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {rows[i][0] for i in range(len(rows)) if find(i) == i}


def planted(rng, n_groups=60):
    """Texts with copies of which evenly spread words are changed, about 0.7 to 0.95 similar."""
    rows = [(0, None), (1, " \n"), (2, "two words"), (3, "Two  WORDS"), (4, "two other")]
    for _ in range(n_groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(40, 300))]
        rows.append((len(rows), " ".join(base)))
        for share in (0.006, 0.012, 0.018, 0.024, 0.035):
            own = list(base)
            for at in rng.sample(range(len(own)), max(1, round(share * len(own)))):
                own[at] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    return rows


def test_near_copies_as_all_pairs_give_them(spark):
    rows = planted(random.Random(3))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = slow_kept(rows)
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == want
    assert 65 < len(want) < len(rows) - 100


def test_near_copy_edges(spark):
    assert neardup.drop_near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "other words of no id at all"), (7, "a b c d e f g")]
    assert sorted((r.doc_id or 0) for r in neardup.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [0, 1]


def test_fingerprints_propose_pairs(spark):
    """Where no two texts share a band, near copies whose fingerprints link are still found, and none that the bands don't link too."""
    docs = neardup.with_row_key(spark.createDataFrame(planted(random.Random(5), 12), "doc_id long, text string"))
    marked = neardup.signatures(docs, 5)
    alone = marked.withColumn("bands", F.transform("bands", lambda b: F.xxhash64(b, "k")))
    found, every = ({r.node: r.root for r in neardup.text_classes(docs, neardup.materialize(x, "copy-bands"), 5, 0.8).collect()} for x in (alone, marked))
    assert 0 < len(found) < len(every)
    assert all(every.get(k, k) == every.get(r, r) for k, r in found.items())
