"""Toxicity by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.llm.common import labelled_sample

#: Labelled documents that train the model, at most.
SAMPLE = 5000
#: Lengths of word beginnings that are features, least documents and evidence of a feature.
STEMS, LEAST_DOCS, LEAST_Z = (4, 5, 6, 7), 3, 4.0
STEPS, RATE, RIDGE = 600, 0.1, 2e-4
#: Distinct words whose weights a worker remembers.
MEMO = 200_000


def distinct_words(text: str | None) -> set[str]:
    return set(re.findall(r"\w+", (text or "").lower()))


def features(word: str) -> list[str]:
    """The word and its beginnings, for endings that the sample doesn't have."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


@dataclass
class Ordinal:
    """P(grade >= k) = sigmoid(x.w - thresholds[k - 1]): one weight per feature for all thresholds."""

    weights: dict[str, float]
    thresholds: list[float]

    def word_weight(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word))

    def reaches(self, score: float) -> list[float]:
        return [1.0 / (1.0 + math.exp(min(700.0, max(-700.0, t - score)))) for t in self.thresholds]


def evidence(bags: list[set[str]], positive: np.ndarray) -> dict[str, float]:
    """Signed roots of the likelihood ratio statistic of the features of positive documents, if enough documents have them."""
    n1, n0 = int(positive.sum()), int((~positive).sum())
    if not n1 or not n0:
        return {}
    with1, with0 = Counter(), Counter()
    for bag, y in zip(bags, positive.tolist()):
        if y:
            with1.update({f for w in bag for f in features(w)})
    for bag, y in zip(bags, positive.tolist()):
        if not y:
            with0.update({f for w in bag for f in features(w)} & with1.keys())

    def entropy(k: int, n: int) -> float:
        return (k * math.log(k / n) if k else 0.0) + ((n - k) * math.log((n - k) / n) if k < n else 0.0)

    out = {}
    for f in with1:
        a, b = with1[f], with0[f]
        if a + b >= LEAST_DOCS:
            ratio = 2 * (entropy(a, n1) + entropy(b, n0) - entropy(a + b, n1 + n0))
            out[f] = math.copysign(math.sqrt(max(0.0, ratio)), a * n0 - b * n1)
    return out


def severity_grades(bags: list[set[str]], toxic: np.ndarray, z: dict[str, float]) -> np.ndarray:
    """0: not toxic; toxic documents get 1, or 2 with more marked words than their median.

    The labels tell two grades only; marked words are those with strong evidence,
    of their own or of a beginning. So the second threshold is learnt from words
    that are features themselves: it orders documents by how many of them they
    have, and says nothing that the labels don't.
    """
    marked = np.array([sum(any(z.get(f, 0.0) >= LEAST_Z for f in features(w)) for w in bag) for bag in bags])
    middle = np.median(marked[toxic]) if toxic.any() else 0.0
    return toxic.astype(np.int64) + (toxic & (marked > middle))


def fit(bags: list[set[str]], grades: np.ndarray, z: dict[str, float]) -> Ordinal:
    """Maximum likelihood with a ridge, by full-batch Adam; the thresholds stay in order as sums of exponentials.

    All features of enough evidence are fitted. A step takes time by their
    occurrences in the sample, not by their number.
    """
    top = int(grades.max(initial=0))
    if not top:
        return Ordinal({}, [20.0, 21.0])
    chosen = sorted((f for f, v in z.items() if abs(v) >= LEAST_Z), key=lambda f: (-abs(z[f]), f))
    place = {f: i for i, f in enumerate(chosen)}
    rows, columns = [], []
    for i, bag in enumerate(bags):
        for word in sorted(bag):
            own = [place[f] for f in features(word) if f in place]
            rows += [i] * len(own)
            columns += own
    row, column = np.array(rows, np.int64), np.array(columns, np.int64)
    n, d = len(bags), len(chosen)
    p = np.zeros(d + top)
    p[d] = 2.0
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, STEPS + 1):
        w, raw = p[:d], p[d:]
        gaps = np.concatenate([[raw[0]], np.exp(raw[1:])])
        thresholds = np.cumsum(gaps)
        score = np.bincount(row, weights=w[column], minlength=n) if len(row) else np.zeros(n)
        # P(y <= k) at the threshold above (1 beyond the last) and below (0 before the first)
        upto = 1 / (1 + np.exp(-np.clip(np.concatenate([[-np.inf], thresholds, [np.inf]])[None, :] - score[:, None], -40, 40)))
        hi, lo = upto[np.arange(n), grades + 1], upto[np.arange(n), grades]
        chance = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / chance, lo * (1 - lo) / chance
        dscore = (dhi - dlo) / n
        dthresholds = np.zeros(top)
        np.add.at(dthresholds, grades[grades < top], -dhi[grades < top] / n)
        np.add.at(dthresholds, grades[grades > 0] - 1, dlo[grades > 0] / n)
        dgaps = np.cumsum(dthresholds[::-1])[::-1]
        gradient = np.concatenate([np.bincount(column, weights=dscore[row], minlength=d) + RIDGE * w if len(row) else RIDGE * w, [dgaps[0]], dgaps[1:] * gaps[1:]])
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        p = p - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    thresholds = np.cumsum(np.concatenate([[p[d]], np.exp(p[d + 1 :])]))
    return Ordinal({f: float(x) for f, x in zip(chosen, p[:d])}, thresholds.tolist())


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE) -> Ordinal:
    """Fit on at most ``most`` labelled documents, in one task of an executor; the driver gets the model only.

    A label with grades above 1 is used as it is; of a 0/1 label the grades are
    derived (``severity_grades``). Without any positive label nothing is toxic.
    """

    def cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [" ".join(sorted(distinct_words(x.as_py()))) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.string()), batch.column(2)], ["doc_id", "words", "y"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        bags = [set(words.split(" ")) - {""} for _, words, _ in rows]
        y = np.array([max(0, grade) for _, _, grade in rows], np.int64)
        del rows
        z = evidence(bags, y > 0)
        model = fit(bags, y if y.max(initial=0) > 1 else severity_grades(bags, y > 0, z), z)
        found = [*model.weights.items(), *((None, x) for x in model.thresholds)]
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["feature", "value"])

    sample = labelled_sample(docs, labels, label, most).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "y")
    words = sample.mapInArrow(cut_words, "doc_id long, words string, y int").repartition(1)
    found = words.mapInArrow(learn, "feature string, value double").collect()
    if not found:  # an optimiser that knows that there are no rows starts no task
        return fit([], np.zeros(0, np.int64), {})
    return Ordinal({r["feature"]: r["value"] for r in found if r["feature"] is not None}, sorted(r["value"] for r in found if r["feature"] is None))


def with_severity(docs: DataFrame, model: Ordinal) -> DataFrame:
    """All columns and rows of ``docs``, and a struct column ``__severity``.

    Its fields: expected (the expected grade, sum of the chances to reach each),
    grade (the likeliest), chance (of any grade above 0). Null and empty texts
    have no features and get what the thresholds alone say; repeated rows get
    equal scores, an empty table none. Of equally likely grades the lower one is
    given. A very long text takes memory for itself and its distinct words. A
    column ``__severity`` of the input is refused.
    """
    if "__severity" in docs.columns:
        raise ValueError("the documents have a column __severity already")
    position = docs.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    kind = pa.struct([("expected", pa.float64()), ("grade", pa.int32()), ("chance", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ordinal(*sent.value)
        memo: dict[str, float] = {}
        for batch in batches:
            values = []
            for text in batch.column(position):
                total = 0.0
                for word in distinct_words(text.as_py()):
                    weight = memo.get(word)
                    if weight is None:
                        if len(memo) >= MEMO:
                            memo.clear()
                        weight = memo[word] = model.word_weight(word)
                    if weight:
                        total += weight
                reach = model.reaches(round(total, 9))
                chances = [a - b for a, b in zip([1.0, *reach], [*reach, 0.0])]
                values.append({"expected": sum(reach), "grade": chances.index(max(chances)), "chance": reach[0]})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, kind)], [*batch.schema.names, "__severity"])

    struct = T.StructType([T.StructField("expected", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("chance", T.DoubleType())])
    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField("__severity", struct)]))


def severities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, severity (expected grade), grade, score (chance of any), toxic (score of 0.5 or more); rows and texts as in ``with_severity``."""
    scored = with_severity(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels))
    return scored.select("doc_id", F.col("__severity.expected").alias("severity"), "__severity.grade", F.col("__severity.chance").alias("score"), (F.col("__severity.chance") >= 0.5).cast("int").alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't toxic, with their columns as they are."""
    return with_severity(docs, train(docs, labels)).filter("__severity.chance < 0.5").select(*docs.columns)
