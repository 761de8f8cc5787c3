"""Structured Streaming: incremental sinks, resumption by ids, windows with watermarks, stateful quotas."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from turnloom.operators.similarity import BAG_SLOTS, WORD_SLOTS, bag, most_shared, prefix_size, rare_first, rouge_l

WORD_SEED = 42


def watermarked(events: DataFrame, late: str) -> DataFrame:
    """A watermark on a stream's ``ts``; tables need none."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def windowed_counts(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Tumbling or sliding counts and sums per event type; works on streams and on tables."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return watermarked(events, late).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v")).select("w.start", "w.end", "event_type", "n", "v")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    return watermarked(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "user_id", "n")


def quota_stream(events: DataFrame, key: str, quota: int) -> DataFrame:
    """The first ``quota`` rows of each key over the whole stream, as they come."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        for pdf in frames:
            take = pdf.head(max(0, quota - used))
            used += len(take)
            if len(take):
                yield take
        state.update((used,))

    return events.groupBy(key).applyInPandasWithState(run, events.schema, "used long", "append", GroupStateTimeout.NoTimeout)


def append_new(path: str, key: str):
    """A foreachBatch sink that writes only rows whose key isn't in the output yet, so reruns add nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        try:
            done = spark.read.schema(batch.schema).parquet(path)
            fresh = fresh.join(done.select(key), key, "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.write.mode("append").parquet(path)

    return write


def write_epochs(path: str):
    """A foreachBatch sink with a folder per batch: a batch that died half-way is written over by its rerun, and nothing else is read."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Take all there is of a stream into ``path`` and read it back; a further run with the same checkpoint adds only what is new."""
    spark = stream.sparkSession
    query = stream.writeStream.foreachBatch(write_epochs(path)).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path).select(*stream.columns)


def unseen(events: DataFrame, key: str, late: str | None = None) -> DataFrame:
    """The first row of each key. Keys are held in the stream's state, with ``late`` only as long as the watermark may lag behind."""
    return watermarked(events, late).dropDuplicatesWithinWatermark([key]) if late else events.dropDuplicates([key])


def remaining(targets: DataFrame, written: DataFrame, key: str, wanted: int) -> DataFrame:
    """Keys that have fewer than ``wanted`` results, and how many are missing."""
    counts = written.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    missing = F.lit(wanted) - F.coalesce("n", F.lit(0))
    return targets.join(counts, key, "left").filter(missing > 0).select(*targets.columns, missing.cast("long").alias("missing"))


def run_arrivals(parts: Sequence[DataFrame], flow: Callable[[DataFrame], DataFrame], source: str, path: str, checkpoint: str) -> DataFrame:
    """Let tables arrive one after another in a folder; after each one the stream over it starts anew from its checkpoint and takes what is there.

    What a run holds, its watermark and state, comes back from the checkpoint alone.
    """
    out = None
    for part in parts:
        part.write.mode("append").parquet(source)
        stream = part.sparkSession.readStream.schema(part.schema).parquet(source)
        out = run_to_end(flow(stream), path, checkpoint)
    return out


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """State on local disk with change logs in the checkpoint, in place of the heap, for streams that start within."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class GreedyTexts(StatefulProcessor):
    """Keeps a text unless one that was kept before in its group is more similar than the bound, by ROUGE-L.

    State: the words' counts in the first batch, which order words for good;
    kept texts by number; and of each its length, the prefix in that order and
    its bag of words. The last are read once a batch into an index. Texts meet
    as in ``similarity.candidate_pairs``: by a shared word of their prefixes, at
    a place that leaves enough others after it, and with bags that share enough
    words. Only these are scored, and of kept texts only these are read.
    """

    #: Bits of a number in the index that hold the place in the prefix.
    PLACE = 24

    def __init__(self, text: str, order: Sequence[str], bound: float):
        self.text, self.order, self.bound = text, list(order), bound

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "slots binary")
        self.kept = handle.getMapState("kept", "id long", "tokens array<string>")
        self.marks = handle.getListState("marks", "n long, prefix binary, bag binary")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        held = TextIndex(self.bound, self.PLACE)
        for n, prefix, slots in self.marks.get():
            held.add(n, np.frombuffer(prefix, np.int64), np.frombuffer(slots, np.uint8))
        first = held.size
        tokens = [(text or "").lower().split() for text in arrived[self.text]]
        words = [np.fromiter((xxhash.xxh64_intdigest(x, WORD_SEED) for x in own), np.uint64, len(own)).view(np.int64) for own in tokens]
        if self.counts.exists():
            counts = np.frombuffer(self.counts.get()[0], np.int64)
        else:
            counts = sum((np.bincount(w % WORD_SLOTS, minlength=WORD_SLOTS) for w in _joined(words)), np.zeros(WORD_SLOTS, np.int64))
            self.counts.update((counts.tobytes(),))
        seen: set[bytes] = set()
        texts: dict[int, list[str]] = {}
        flags, fresh = [], []
        for own, w in zip(tokens, words):
            # the same words as an earlier text of the batch: whatever kept that one out keeps this out as well
            same = xxhash.xxh128_digest(w.tobytes(), WORD_SEED)
            if not own or same in seen:
                flags.append(not own)
                continue
            seen.add(same)
            prefix = rare_first(w, counts)[: prefix_size(len(w), self.bound)]
            slots = bag(w)
            keep = True
            for number in held.near(len(w), prefix, slots):
                if number not in texts:
                    texts[number] = list(self.kept.getValue((number,))[0])
                if rouge_l(texts[number], own) > self.bound:
                    keep = False
                    break
            flags.append(keep)
            if keep:
                texts[held.size] = own
                held.add(len(w), prefix, slots)
                fresh.append((len(w), prefix.tobytes(), slots.tobytes()))
        for number in range(first, held.size):
            self.kept.updateValue((number,), (texts[number],))
        if fresh:
            self.marks.appendList(fresh)
        yield arrived[flags]


def _joined(words: list[np.ndarray], most: int = 1 << 20) -> Iterator[np.ndarray]:
    """The words of many texts in a few arrays."""
    part, size = [], 0
    for w in words:
        part.append(w)
        size += len(w)
        if size >= most:
            yield np.concatenate(part)
            part, size = [], 0
    if part:
        yield np.concatenate(part)


class TextIndex:
    """Texts by number: which have a word in their prefix, and their lengths and bags."""

    def __init__(self, bound: float, place: int):
        self.bound, self.place, self.size = bound, place, 0
        self.holders: dict[int, array] = {}
        self.lengths, self.bags = np.zeros(1024, np.int64), np.zeros((1024, BAG_SLOTS), np.uint8)

    def add(self, n: int, prefix: np.ndarray, slots: np.ndarray) -> None:
        if self.size == len(self.lengths):
            self.lengths, self.bags = np.concatenate([self.lengths, np.zeros_like(self.lengths)]), np.concatenate([self.bags, np.zeros_like(self.bags)])
        self.lengths[self.size], self.bags[self.size] = n, slots
        last = (1 << self.place) - 1
        for at, code in enumerate(prefix.tolist()):
            self.holders.setdefault(code, array("q")).append(self.size << self.place | min(at, last))
        self.size += 1

    def near(self, n: int, prefix: np.ndarray, slots: np.ndarray) -> list[int]:
        """Numbers of texts that may score above the bound."""
        places = [(at, self.holders[code]) for at, code in enumerate(prefix.tolist()) if code in self.holders]
        held = np.concatenate([np.array(x) for _, x in places]) if places else np.zeros(0, np.int64)
        at = np.repeat(np.array([at for at, _ in places], np.int64), [len(x) for _, x in places])
        number = held >> self.place
        m = self.lengths[number]
        shared = np.floor((n + m) * (self.bound / 2) - 1e-9)
        reach = (at < n - shared) & ((held & ((1 << self.place) - 1)) < m - shared) & (2 * np.minimum(n, m) > self.bound * (n + m))
        near = np.unique(number[reach])
        return near[2 * most_shared(self.bags[near], slots) > self.bound * (n + self.lengths[near])].tolist()


def greedy_stream(texts: DataFrame, group: str, order: Sequence[str], text: str, bound: float) -> DataFrame:
    """The rows of a stream that the greedy filter keeps, with its record in the stream's state.

    Rows of a group that come in one batch are taken by ``order``, batches as they
    come; so the rows are those of ``similarity.greedy_dedup`` where that is the
    order of arrival. A batch's rows of one group are in one task, so triggers
    should bound the batch. Needs ``rocks_state``.
    """
    return texts.groupBy(group).transformWithStateInPandas(GreedyTexts(text, order, bound), texts.schema, "Append", "None")
