"""Benchmark decontamination by SimHash over item-sized windows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.llm.common import spans_of_rows, utf8_buffer
from turnloom.llm.suffix import Hasher, _mix

#: Words per shingle, least weighted Jaccard similarity, radius of candidate fingerprints.
SHINGLE, LEAST, RADIUS = 5, 0.8, 18
#: Blocks of a fingerprint; one of them differs in at most RADIUS // BLOCKS bits.
BLOCKS, BLOCK_BITS = 4, 16
#: Pairs of windows and items that are compared at a time.
PAIRS = 1 << 20
#: Bytes of text in memory at a time, bytes of items that are broadcast at a time.
CHUNK, SLICE = 1 << 20, 16 << 20
FILTER_BITS = 22
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(buf: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words (runs without ASCII blanks) of lower-cased bytes."""
    inside = np.concatenate([[False], ~_BLANK[buf], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = hasher.prefix(_LOWER[buf])
    return starts, ends, _mix((sums[ends] - sums[starts]) * hasher.inverse[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    count = max(0, len(words) - n + 1)
    out = np.zeros(count, np.uint64)
    for j in range(n):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + words[j : j + count]
    return _mix(out)


def window_prints(shingles: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every window of ``size`` shingles; a shingle votes once per occurrence."""
    count = len(shingles) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(shingles.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
    sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0)])
    votes = sums[size : size + count] - sums[:count]
    return np.packbits(votes * 2 > size, axis=1).copy().view(">u8").ravel().astype(np.uint64)


def separated(buf: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows i to j with a blank after each, so that no word spans two; the ends of all but the last."""
    lo = offsets[i]
    out = np.full(int(offsets[j] - lo) + (j - i), 32, np.uint8)
    at = np.arange(int(offsets[j] - lo)) + np.repeat(np.arange(j - i), np.diff(offsets[i : j + 1]))
    out[at] = buf[lo : offsets[j]]
    return out, offsets[i + 1 : j + 1] - lo + np.arange(j - i)


@dataclass
class Group:
    """Items of one number of words: their numbers and fingerprints, whole and as a row of blocks each."""

    items: np.ndarray
    prints: np.ndarray
    blocks: np.ndarray


@dataclass
class Items:
    """A slice of the benchmark: words per item, shingle bags, fingerprints by number of words."""

    ids: list
    words: np.ndarray
    bags: list[Counter]
    prints: np.ndarray
    groups: dict[int, Group]
    shingles: dict[int, np.ndarray]
    #: For each of the shingles the numbers of words of the items that have it.
    sizes: dict[int, list[set[int]]]

    @property
    def most_words(self) -> int:
        return int(self.words.max(initial=0))


def blocks_of(codes: np.ndarray) -> np.ndarray:
    """One row of values per block."""
    return np.stack([(codes >> np.uint64(BLOCK_BITS * k)).astype(np.uint16) for k in range(BLOCKS)])


def index_items(rows: list[tuple]) -> Items:
    """Items without words can't occur and are left out; null texts read as empty."""
    hasher = Hasher(max([len((x or "").encode()) for _, x in rows], default=0) + 1)
    ids, sizes, bags, prints, known = [], [], [], [], {}
    for item, text in rows:
        _, _, words = word_hashes(np.frombuffer((text or "").encode(), np.uint8), hasher)
        if not len(words):
            continue
        n = min(SHINGLE, len(words))
        shingles = shingle_hashes(words, n)
        ids.append(item)
        sizes.append(len(words))
        bags.append(Counter(shingles.tolist()))
        prints.append(int(window_prints(shingles, len(shingles))[0]))
        known.setdefault(n, []).append(shingles)
    words, codes = np.array(sizes, np.int64), np.array(prints, np.uint64)
    groups = {size: Group(own := np.flatnonzero(words == size), codes[own], blocks_of(codes[own])) for size in set(sizes)}
    owners: dict[int, dict[int, set[int]]] = {}
    for bag, size in zip(bags, sizes):
        for shingle in bag:
            owners.setdefault(min(SHINGLE, size), {}).setdefault(shingle, set()).add(size)
    shingles = {n: np.unique(np.concatenate(x)) for n, x in known.items()}
    return Items(ids, words, bags, codes, groups, shingles, {n: [owners[n][x] for x in own.tolist()] for n, own in shingles.items()})


def block_matches(codes: np.ndarray, group: Group) -> tuple[np.ndarray, np.ndarray]:
    """(window, place in the group) of all pairs with a block that differs in RADIUS // BLOCKS bits at most."""
    near = np.zeros((len(codes), len(group.prints)), bool)
    for own, other in zip(blocks_of(codes), group.blocks):
        near |= np.bitwise_count(own[:, None] ^ other[None, :]) <= RADIUS // BLOCKS
    return np.nonzero(near)


def candidates(codes: np.ndarray, group: Group) -> Iterator[tuple[int, int, int]]:
    """(window, item, distance) of all fingerprints within RADIUS: by pigeonhole one of their blocks matches."""
    step = max(1, PAIRS // max(1, len(group.prints)))
    for a in range(0, len(codes), step):
        part = codes[a : a + step]
        window, place = block_matches(part, group)
        distance = np.bitwise_count(part[window] ^ group.prints[place])
        close = distance <= RADIUS
        yield from zip((window[close] + a).tolist(), group.items[place[close]].tolist(), distance[close].tolist())


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: shared occurrences over all occurrences."""
    common = (a & b).total()
    return common / (a.total() + b.total() - common)


def document_matches(words: np.ndarray, hits: dict[int, tuple[np.ndarray, np.ndarray]], items: Items) -> dict[int, tuple]:
    """item number to (similarity, start word, words, distance) of its best window in one run of words.

    ``hits[n]`` are the places of n-word shingles that some item has too, and
    which ones they are. Windows without a shingle of any item of their size
    can't be similar to one; all others are fingerprinted.
    """
    best: dict[int, tuple] = {}
    places: dict[int, list[int]] = {}
    for n, (at, which) in hits.items():
        for p, k in zip(at.tolist(), which.tolist()):
            for size in items.sizes[n][k]:
                places.setdefault(size, []).append(p)
    for size, own in sorted(places.items()):
        n = min(SHINGLE, size)
        at = np.array(own, np.int64)
        if len(words) < size:
            continue
        span = size - n + 1
        lo, hi = np.maximum(at - span + 1, 0), np.minimum(at, len(words) - size)
        lo, hi = lo[lo <= hi], hi[lo <= hi]
        cuts = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1] + 1])) if len(lo) else []
        for i, j in zip(cuts, [*cuts[1:], len(lo)]):
            a, b = int(lo[i]), int(hi[j - 1])
            for c in range(a, b + 1, 4096):
                part = shingle_hashes(words[c : min(b, c + 4095) + size], n)
                bag, of = Counter(), -1
                for k, item, distance in candidates(window_prints(part, span), items.groups[size]):
                    if k != of:
                        bag, of = Counter(part[k : k + span].tolist()), k
                    s = similarity(bag, items.bags[item])
                    if s >= LEAST and (item not in best or s > best[item][0]):
                        best[item] = (s, c + k, size, distance)
    return best


def pieces(buf: np.ndarray, most: int, overlap: int) -> Iterator[tuple[int, int, int]]:
    """Cut one long text at blanks: (start, end, words before), pieces sharing ``overlap`` words."""
    a, before = 0, 0
    while True:
        b = len(buf)
        if b - a > most:
            blank = np.flatnonzero(_BLANK[buf[a + most :]])
            b = a + most + int(blank[0]) if len(blank) else b
        yield a, b, before
        if b == len(buf):
            return
        inside = np.concatenate([[False], ~_BLANK[buf[a:b]]])
        starts = np.flatnonzero(inside[1:] & ~inside[:-1])
        keep = min(overlap, len(starts) - 1)
        before += len(starts) - keep
        a = a + int(starts[-keep]) if keep else b


def scan_batch(buf: np.ndarray, offsets: np.ndarray, items: Items) -> dict[int, dict[int, tuple]]:
    """Matches by row of a batch of texts."""
    found: dict[int, dict[int, tuple]] = {}
    filters = {}
    for n, known in items.shingles.items():
        filters[n] = np.zeros(1 << FILTER_BITS, bool)
        filters[n][known & np.uint64((1 << FILTER_BITS) - 1)] = True
    hasher = Hasher(CHUNK + (1 << 16))

    def scan(part: np.ndarray, ends: np.ndarray, first: int, before: int) -> None:
        nonlocal hasher
        if len(part) >= len(hasher.power):
            hasher = Hasher(len(part) + 1)
        starts, _, words = word_hashes(part, hasher)
        row = np.searchsorted(ends, starts, side="right")
        hits: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n, known in items.shingles.items():
            shingles = shingle_hashes(words, n)
            at = np.flatnonzero(filters[n][shingles & np.uint64((1 << FILTER_BITS) - 1)])
            which = np.minimum(np.searchsorted(known, shingles[at]), len(known) - 1)
            real = (known[which] == shingles[at]) & (row[at] == row[at + n - 1])
            hits[n] = at[real], which[real]
        for r in np.unique(np.concatenate([row[at] for at, _ in hits.values()])).tolist() if hits else []:
            lo, hi = int(np.searchsorted(row, r)), int(np.searchsorted(row, r, side="right"))
            own = {}
            for n, (at, which) in hits.items():
                a, b = np.searchsorted(at, [lo, hi])
                own[n] = at[a:b] - lo, which[a:b]
            into = found.setdefault(first + r, {})
            for item, (s, p, size, distance) in document_matches(words[lo:hi], own, items).items():
                if item not in into or s > into[item][0]:
                    into[item] = (s, p + before, size, distance)

    if not items.ids:
        return found
    for i, j in spans_of_rows(offsets, CHUNK):
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= CHUNK:
            scan(*separated(buf, offsets, i, j), i, 0)
        else:
            for a, b, before in pieces(buf[lo:hi], CHUNK, items.most_words + SHINGLE):
                scan(buf[lo + a : lo + b], np.zeros(0, np.int64), i, before)
    return {r: x for r, x in found.items() if x}


MATCH = T.ArrayType(T.StructType([T.StructField(n, k) for n, k in (("item", T.StringType()), ("start_word", T.LongType()), ("n_words", T.LongType()), ("distance", T.IntegerType()), ("similarity", T.DoubleType()))]))
_MATCH = pa.list_(pa.struct([("item", pa.string()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("distance", pa.int32()), ("similarity", pa.float64())]))


def item_slices(benchmark: DataFrame, id_col: str = "item_id") -> Iterator[list[tuple]]:
    """The benchmark in slices of at most SLICE bytes (or one item), each small enough to send to every task."""
    slim = benchmark.select(F.col(id_col).cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = slim.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-total // (SLICE // 2)))
    for k in range(n):
        yield [tuple(r) for r in slim.filter(F.pmod(F.xxhash64("text", "id"), F.lit(n)) == k).sort("id", "text").collect()]


def with_matches(docs: DataFrame, benchmark: DataFrame, column: str = "__matches") -> DataFrame:
    """All columns and rows of ``docs``, and the matches with benchmark items in an array column.

    Texts and items are lower-cased (A-Z) and cut at ASCII blanks. A window of
    an item's number of words matches the item if the weighted Jaccard
    similarity of their five-word shingles (all words of shorter items) is 0.8
    or more; of an item's windows the most similar and then first one is given.
    Candidates are all items of the window's number of words whose SimHash is
    within RADIUS bits of the window's, found exactly through blocks; only windows that share no shingle with any
    item, which can't match, aren't fingerprinted.

    Documents are scanned where they lie, without a shuffle, as often as the
    benchmark has slices of SLICE bytes. Null and empty texts have no matches;
    repeated rows and ids give repeated results; empty tables are fine. A very
    long text is read in pieces that share a window.
    """
    if column in docs.columns:
        raise ValueError(f"the documents have a column {column} already")
    position = docs.columns.index("text")
    for rows in item_slices(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(rows)
        more = column in docs.columns

        def run(batches: Iterator[pa.RecordBatch], sent=sent, more=more) -> Iterator[pa.RecordBatch]:
            items = index_items(sent.value)
            for batch in batches:
                buf, offsets = utf8_buffer(batch.column(position))
                found = scan_batch(buf, offsets, items)
                before = batch.column(batch.num_columns - 1).to_pylist() if more else [[]] * batch.num_rows
                values = [
                    [*old, *({"item": items.ids[k], "start_word": p, "n_words": n, "distance": d, "similarity": s} for k, (s, p, n, d) in sorted(found.get(r, {}).items()))]
                    for r, old in enumerate(before)
                ]
                own = batch.columns[: batch.num_columns - more]
                yield pa.RecordBatch.from_arrays([*own, pa.array(values, _MATCH)], [*batch.schema.names[: len(own)], column])

        schema = T.StructType([*(f for f in docs.schema if f.name != column), T.StructField(column, MATCH)])
        docs = docs.mapInArrow(run, schema)
    return docs


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per matching document and item: doc_id, item_id, start_word, n_words, distance, similarity."""
    found = with_matches(docs.select("doc_id", "text"), benchmark)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode("__matches").alias("m")).select(
        "doc_id", F.col("m.item").cast(benchmark.schema["item_id"].dataType).alias("item_id"), "m.start_word", "m.n_words", "m.distance", "m.similarity",
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any match, with their columns as they are."""
    return with_matches(docs, benchmark).filter(F.size("__matches") == 0).select(*docs.columns)
