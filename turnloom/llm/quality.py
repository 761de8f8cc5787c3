"""Quality by attention-based multiple-instance learning: documents are bags of passages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnloom.llm.common import cut, held_out, labelled_sample, spans_of_rows, utf8_buffer
from turnloom.llm.decontam import separated, word_hashes
from turnloom.llm.suffix import Hasher

#: Labelled documents that train the model, at most, and passages that all of them have together, at most.
SAMPLE, MOST_PASSAGES = 4000, 400_000
#: Words per passage, bytes in memory at a time, sizes of the passage code and of the attention.
PASSAGE, CHUNK, CODE, ATTENTION = 64, 1 << 18, 32, 16
EPOCHS, BATCH, RATE, DECAY = 24, 64, 3e-3, 1e-4
THRESHOLD = 0.3
WORD = r"[^\x20\x09-\x0D]+"


def _classes() -> np.ndarray:
    """Byte classes: blank, line end, lower, upper, digit, full stop, comma, marks, pipe, symbols, quotes, lead, trail, control."""
    out = np.full(256, 13, np.int64)
    groups = [b" \t", b"\n\r", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".", b",", b"!?;:", b"|", b"#$%&*@^~<>{}[]\\/_+=`", b"\"'()-", bytes(range(0xC0, 256)), bytes(range(0x80, 0xC0))]
    for k, group in enumerate(groups):
        out[list(group)] = k
    return out


N_CLASSES = 14
N_FEATURES = N_CLASSES + N_CLASSES**2 + 6


def passage_features(buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, passages per row, features) of a batch of texts, some rows at a time.

    A passage is PASSAGE words in a row; a text without words has one. Features
    are roots of the shares of byte classes and of pairs of them, and lengths and
    repeats of words.
    """
    classes = _classes()
    hasher = Hasher(CHUNK * 2)
    for i, j in spans_of_rows(offsets, CHUNK):
        part, ends = separated(buf, offsets, i, j)
        if len(part) >= len(hasher.power):
            hasher = Hasher(len(part) + 1)
        starts, stops, words = word_hashes(part, hasher)
        row = np.searchsorted(ends, starts, side="right")
        first = np.searchsorted(row, np.arange(j - i + 1))
        counts = np.diff(first)
        passages = np.maximum(1, -(-counts // PASSAGE))
        base = np.concatenate([[0], np.cumsum(passages)])
        total = int(base[-1])
        nth = np.arange(len(words)) - first[row]
        own = base[row] + nth // PASSAGE
        begin = np.empty(total, np.int64)
        opens = nth % PASSAGE == 0
        begin[own[opens]] = starts[opens]
        begin[base[:-1]] = np.concatenate([[0], ends + 1])[: j - i]
        size = np.diff(np.append(begin, len(part)))
        at = np.repeat(np.arange(total), size) * N_CLASSES + classes[part]
        single = np.bincount(at, minlength=total * N_CLASSES).reshape(total, N_CLASSES)
        # what follows a row's last blank belongs to another text
        inner = np.ones(len(part), bool)
        inner[ends] = False
        pairs = np.bincount((at[:-1] * N_CLASSES + at[1:] % N_CLASSES)[inner[:-1]], minlength=total * N_CLASSES**2).reshape(total, -1)
        n = np.bincount(own, minlength=total)
        length = (stops - starts).astype(np.float64)
        order = np.lexsort((words, own))
        fresh = np.ones(len(words), bool)
        fresh[order[1:]] = (words[order[1:]] != words[order[:-1]]) | (own[order[1:]] != own[order[:-1]])
        same = np.zeros(len(words), bool)
        same[1:] = (words[1:] == words[:-1]) & (own[1:] == own[:-1])
        longest = np.zeros(total)
        np.maximum.at(longest, own, length)
        some = np.maximum(n, 1)
        extra = [n / PASSAGE, np.bincount(own, length, total) / some / 10, np.log1p(longest) / 5, np.bincount(own, fresh, total) / some, np.bincount(own, same, total) / some, np.log1p(size) / 10]
        yield i, j, passages, np.concatenate([np.sqrt(single / size[:, None]), np.sqrt(pairs / size[:, None]), np.stack(extra, 1)], axis=1).astype(np.float32)


@dataclass
class Attention:
    """Passage code h = tanh(xA + a); gated attention over h; a logistic score of the weighted code."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.p["A"] + self.p["a"])

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        """``first``: where each bag begins in x; no bag is empty."""
        h = self.codes(x)
        v, u = np.tanh(h @ self.p["V"]), 1 / (1 + np.exp(-np.clip(h @ self.p["U"], -30, 30)))
        e = (v * u) @ self.p["w"]
        sizes = np.diff(np.append(first, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), sizes))
        attention = e / np.repeat(np.add.reduceat(e, first), sizes)
        z = np.add.reduceat(attention[:, None] * h, first, axis=0)
        score = 1 / (1 + np.exp(-np.clip(z @ self.p["c"] + self.p["d"], -30, 30)))
        return {"h": h, "v": v, "u": u, "attention": attention, "z": z, "score": score, "sizes": sizes}

    def gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        f, p = self.forward(x, first), self.p
        h, v, u, attention, sizes = (f[k] for k in ("h", "v", "u", "attention", "sizes"))
        dlogit = (f["score"] - y) / len(y)
        dz = np.repeat(dlogit[:, None] * p["c"], sizes, axis=0)
        dattention = (dz * h).sum(1)
        de = attention * (dattention - np.repeat(np.add.reduceat(attention * dattention, first), sizes))
        gate = de[:, None] * p["w"]
        dv, du = gate * u * (1 - v**2), gate * v * u * (1 - u)
        dh = attention[:, None] * dz + dv @ p["V"].T + du @ p["U"].T
        dpre = dh * (1 - h**2)
        scaled = (x - self.mean) / self.scale
        return {"A": scaled.T @ dpre, "a": dpre.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ de, "c": f["z"].T @ dlogit, "d": dlogit.sum()}


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, seed: int = 7) -> Attention:
    """Cross-entropy of the document labels by Adam over batches of bags, from a fixed seed."""
    rng = np.random.default_rng(seed)
    shapes = {"A": (x.shape[1], CODE), "a": (CODE,), "V": (CODE, ATTENTION), "U": (CODE, ATTENTION), "w": (ATTENTION,), "c": (CODE,), "d": ()}
    p = {k: (rng.standard_normal(s) / np.sqrt(max(1, s[0] if s else 1))).astype(np.float32) if k in "AVUwc" else np.zeros(s, np.float32) for k, s in shapes.items()}
    share = float(np.clip(y.mean() if len(y) else 0.5, 0.02, 0.98))
    p["d"] = np.float32(np.log(share / (1 - share)))
    net = Attention(x.mean(0) if len(x) else np.zeros(x.shape[1]), (x.std(0) if len(x) else np.zeros(x.shape[1])) + 0.02, p)
    m, v = ({k: np.zeros(s) for k, s in shapes.items()} for _ in range(2))
    sizes, step = np.diff(np.append(first, len(x))), 0
    for _ in range(EPOCHS if len(y) else 0):
        order = rng.permutation(len(y))
        for k in range(0, len(y), BATCH):
            bags = order[k : k + BATCH]
            rows = np.concatenate([np.arange(first[b], first[b] + sizes[b]) for b in bags])
            begin = np.concatenate([[0], np.cumsum(sizes[bags])[:-1]])
            step += 1
            for name, g in net.gradient(x[rows], begin, y[bags]).items():
                g = g + DECAY * p[name]
                m[name], v[name] = 0.9 * m[name] + 0.1 * g, 0.999 * v[name] + 0.001 * g**2
                p[name] = (p[name] - RATE * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE, passages: int = MOST_PASSAGES) -> Attention:
    """Fit on at most ``most`` labelled documents that aren't held out, each with all its passages.

    They are taken in the order of a hash of their ids for as long as they have
    ``passages`` passages together, so that the bound holds whatever their lengths
    are (one document that has more by itself is left out). One task of an executor learns, with N_FEATURES
    floats a passage in memory, twice while they are put together: some 700 MB by
    the default; the driver gets the model only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, passages, x in passage_features(*utf8_buffer(batch.column(1))):
                at = 0
                for n in passages.tolist():
                    out.append(x[at : at + n].tobytes())
                    at += n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), batch.column(2)], ["doc_id", "x", "y"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        bags = [np.frombuffer(r[1], np.float32).reshape(-1, N_FEATURES) for r in rows]
        y = np.array([float(r[2] > 0) for r in rows], np.float32)
        sizes = np.array([len(b) for b in bags], np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(bags) else np.zeros(0, np.int64)
        x = np.concatenate(bags) if bags else np.zeros((0, N_FEATURES), np.float32)
        del rows, bags
        net = fit(x, first, y)
        found = {"mean": net.mean, "scale": net.scale} | net.p
        arrays = [np.asarray(v, np.float64) for v in found.values()]
        columns = [pa.array(list(found)), pa.array([list(v.shape) for v in arrays], pa.list_(pa.int32())), pa.array([v.ravel().tolist() for v in arrays], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, ["name", "shape", "value"])

    sample = cut(labelled_sample(docs, labels, label, most).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "y"))
    own = F.greatest(F.ceil(F.regexp_count("text", F.lit(WORD)) / PASSAGE), F.lit(1))
    upto = F.sum("own").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    sized = sample.select("doc_id", own.alias("own"))
    fitting = sized.withColumn("upto", upto).filter(F.col("upto") <= passages).select("doc_id")
    features = sample.join(F.broadcast(fitting), "doc_id").mapInArrow(run, "doc_id long, x binary, y int").repartition(1)
    found = features.mapInArrow(learn, "name string, shape array<int>, value array<double>").collect()
    if not found:  # an optimiser that knows that there are no rows starts no task
        return fit(np.zeros((0, N_FEATURES), np.float32), np.zeros(0, np.int64), np.zeros(0, np.float32))
    p = {r["name"]: np.array(r["value"], np.float32).reshape(r["shape"]) for r in found}
    return Attention(p.pop("mean"), p.pop("scale"), p)


def score_documents(docs: DataFrame, model: Attention) -> DataFrame:
    """doc_id, score, passages, top_passage (the one with most attention) for every document.

    Scores depend on the text alone, so repeated rows get equal ones; null texts
    read as empty, and a text without words is a bag of one empty passage. An empty table gives no rows,
    other columns aren't read whatever their names, and a very long text takes memory for its own passages
    (some 900 bytes for 64 words) while it is scored.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.mean, model.scale, model.p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Attention(*sent.value)
        for batch in batches:
            scores, sizes, tops = [], [], []
            for _, _, passages, x in passage_features(*utf8_buffer(batch.column(1))):
                first = np.concatenate([[0], np.cumsum(passages)[:-1]])
                f = net.forward(x, first)
                scores += f["score"].astype(np.float64).tolist()
                sizes += passages.tolist()
                tops += [int(np.argmax(f["attention"][a : a + n])) for a, n in zip(first, passages)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(sizes, pa.int64()), pa.array(tops, pa.int64())], ["doc_id", "score", "passages", "top_passage"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, passages long, top_passage long")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_documents(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "passages", "top_passage")
