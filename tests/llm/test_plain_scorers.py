"""op3 and op6 against scorers written out plainly over the same model, on whole tables; rows that share a batch don't meet."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest

from turnloom.llm import mixing, quality, toxicity
from turnloom.llm.common import utf8_buffer

ODD = [(-1, None), (-2, ""), (-3, " \n\t "), (-4, "one"), (-5, "Üñí \U0001f600 |x| " * 70), (-6, "word " * 30_000), (-6, "word " * 30_000), (None, "no id")]
GROUPS = ["\x20\t", "\n\r", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",", "!?;:", "|", "#$%&*@^~<>{}[]\\/_+=`", "\"'()-"]


@pytest.fixture(scope="module")
def tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return docs.unionByName(spark.createDataFrame(ODD, "doc_id long, text string")).cache(), spark.read.parquet(f"{sf}/labels.parquet")


def byte_class(b):
    for k, group in enumerate(GROUPS):
        if b < 128 and chr(b) in group:
            return k
    return 11 if b >= 0xC0 else 12 if b >= 0x80 else 13


def plain_features(text):
    raw = (text or "").encode() + b" "
    words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    kinds = [byte_class(b) for b in raw]
    groups = [words[k : k + 64] for k in range(0, len(words), 64)] or [[]]
    begins = [0, *(g[0][0] for g in groups[1:])]
    for group, a, b in zip(groups, begins, [*begins[1:], len(raw)]):
        size = b - a
        single, pairs = [0] * 14, [0] * 196
        for at in range(a, b):
            single[kinds[at]] += 1
            if at + 1 < len(raw):
                pairs[kinds[at] * 14 + kinds[at + 1]] += 1
        n, lengths = max(1, len(group)), [e - s for s, e, _ in group]
        repeated = sum(group[k][2] == group[k - 1][2] for k in range(1, len(group)))
        extra = [len(group) / 64, sum(lengths) / n / 10, math.log1p(max(lengths, default=0)) / 5, len({w for _, _, w in group}) / n, repeated / n, math.log1p(size) / 10]
        yield [math.sqrt(x / size) for x in single + pairs] + extra


def plain_score(text, net):
    """One passage and one unit after the other."""
    codes, gates = [], []
    p = {k: np.asarray(v, np.float64) for k, v in net.p.items()}
    for x in plain_features(text):
        y = [(v - m) / s for v, m, s in zip(x, net.mean, net.scale)]
        h = [math.tanh(sum(v * w for v, w in zip(y, p["A"][:, k])) + p["a"][k]) for k in range(len(p["a"]))]
        v = [math.tanh(sum(a * b for a, b in zip(h, p["V"][:, k]))) for k in range(len(p["w"]))]
        u = [1 / (1 + math.exp(-sum(a * b for a, b in zip(h, p["U"][:, k])))) for k in range(len(p["w"]))]
        codes.append(h)
        gates.append(sum(a * b * c for a, b, c in zip(v, u, p["w"])))
    most = max(gates)
    weights = [math.exp(g - most) for g in gates]
    z = [sum(w * h[k] for w, h in zip(weights, codes)) / sum(weights) for k in range(len(p["c"]))]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(z, p["c"])) + float(p["d"])))), len(codes)


def test_quality_of_all_documents(spark, tables):
    docs, labels = tables
    model = quality.train(docs, labels)
    rows = docs.filter("length(coalesce(text, '')) < 6000 or doc_id < 0").collect()
    got = quality.score_documents(docs, model).collect()
    assert len(got) == docs.count() and len(rows) > 150
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append((r.score, r.passages))
    for r in rows:
        if r.text is not None and len(r.text) > 100_000:
            assert len(by_id[r.doc_id]) == 2 and by_id[r.doc_id][0] == by_id[r.doc_id][1] and by_id[r.doc_id][0][1] == 469
            continue
        want, passages = plain_score(r.text, model)
        assert any(abs(score - want) < 2e-4 and n == passages for score, n in by_id[r.doc_id]), r


def test_features_are_those_of_the_text_alone():
    texts = ["hello world, one", "Upper", "", "9 digits", None, "x" * 400_000, "end."]
    alone = [np.array(list(plain_features(t)), np.float32) for t in texts]
    for order in (range(7), reversed(range(7)), [3], [5, 2]):
        chosen = list(order)
        at = 0
        for i, j, passages, x in quality.passage_features(*utf8_buffer(pa.array([texts[k] for k in chosen]))):
            first = np.concatenate([[0], np.cumsum(passages)])
            for k in range(i, j):
                assert np.allclose(x[first[k - i] : first[k - i + 1]], alone[chosen[k]], atol=1e-6)
                at += 1
        assert at == len(chosen)


def test_training_is_bounded_by_passages(spark):
    docs = spark.createDataFrame([(k, "word " * (64 * 10)) for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    few = quality.train(docs, labels, passages=25)  # two documents of ten passages
    every = quality.train(docs, labels)
    assert few.p["A"].shape == every.p["A"].shape and not np.allclose(few.p["A"], every.p["A"])
    assert quality.train(docs, labels, passages=9).mean.sum() == 0  # none fits


def plain_severity(text, model):
    score = 0.0
    for word in sorted(set(re.findall(r"\w+", (text or "").lower()))):
        score += model.weights.get(word, 0.0) + sum(model.weights.get(word[:n] + "*", 0.0) for n in (4, 5, 6, 7) if len(word) > n)
    reach = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
    chances = [1 - reach[0], reach[0] - reach[1], reach[1]]
    return sum(reach), chances.index(max(chances)), reach[0]


def test_severity_of_all_documents(spark, tables):
    docs, labels = tables
    model = toxicity.train(docs, labels)
    got = toxicity.with_severity(docs, model).collect()
    assert len(got) == docs.count() and any(r["__severity"].grade for r in got)
    for r in got:
        expected, grade, chance = plain_severity(r.text, model)
        s = r["__severity"]
        assert abs(s.expected - expected) < 1e-6 and abs(s.chance - chance) < 1e-6 and s.grade == grade


def test_names_that_operators_use(spark, tables):
    """Columns named like those that op3, op4 and op6 make themselves are neither read nor lost."""
    docs, labels = tables
    names = {"k": "k", "q": "q", "step": "s", "size": "z", "level": "l", "w": "w", "u": "u", "p": "p", "taken": "t", "score": "c", "passages": "x", "source": "a", "y": "y", "features": "f", "own": "o"}
    rows = spark.createDataFrame([(k, f"some text of number {k}", *names.values()) for k in range(30)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    plain = rows.select("doc_id", "text", "source")
    same = lambda f: sorted(map(str, f(rows).collect())) == sorted(map(str, f(plain).collect()))
    model = quality.train(docs, labels)
    assert same(mixing.mix) and same(lambda d: quality.score_documents(d, model)) and same(lambda d: toxicity.severities(d, labels))
    marks = spark.createDataFrame([(k, k % 2, "z") for k in range(30)], "doc_id long, quality int, text string")
    assert np.allclose(quality.train(rows, marks).p["A"], quality.train(plain, marks.drop("text")).p["A"])
