"""SimHash near-dedup with BK-trees in shards that share bits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import DOC_KEY, TIE_KEY, cut, with_row_key
from turnloom.llm.components import connected_components

BITS, SEED, RADIUS = 64, 42, 3
#: (blocks, blocks that a shard holds equal): more of them as fingerprints grow in number.
SCHEMES = ((4, 1), (5, 2), (6, 3), (7, 4), (8, 5))
#: Random fingerprints per shard up to which a scheme is used.
SHARD = 64


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of a whole text: majority bits of its shingles' XXH64, 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist())]
    h = np.array(hashes, dtype=np.uint64)
    votes = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)]
        votes += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The key columns and fp (the fingerprint as a signed long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *own, texts = batch.columns
            found = np.fromiter((fingerprint(x.as_py(), shingle) for x in texts), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*own, pa.array(found.view(np.int64))], [*keys, "fp"])

    slim = docs.select(*keys, "text")
    return slim.mapInArrow(run, ", ".join(f"`{k}` {slim.schema[k].dataType.simpleString()}" for k in keys) + ", fp long")


class BKTree:
    """Nodes under integer distances to their parent; emptied branches are passed over.

    ``take`` returns the nodes within a radius and removes them, so that a dense
    cluster costs about one visit per member and not one per pair.
    """

    def __init__(self, values: list[int]):
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in values]
        self.parent = [-1] * len(values)
        self.alive = [0] * len(values)
        self.gone = [False] * len(values)
        for i in range(len(values)):
            self._add(i)

    def _add(self, i: int) -> None:
        value, at = self.values[i], 0
        while i:
            self.alive[at] += 1
            d = (value ^ self.values[at]).bit_count()
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = i
                self.parent[i] = at
                break
            at = below
        self.alive[i] += 1

    def take(self, value: int, radius: int) -> list[int]:
        found, stack = [], [0] if self.alive and self.alive[0] else []
        while stack:
            at = stack.pop()
            d = (value ^ self.values[at]).bit_count()
            if d <= radius and not self.gone[at]:
                found.append(at)
            branches = self.children[at]
            if len(branches) > 2 * radius + 1:
                near = (branches[x] for x in range(d - radius, d + radius + 1) if x in branches)
            else:
                near = (below for x, below in branches.items() if d - radius <= x <= d + radius)
            stack += [below for below in near if self.alive[below]]
        for i in found:
            self.gone[i] = True
            while i >= 0:
                self.alive[i] -= 1
                i = self.parent[i]
        return found


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within one shard: no link between groups is lost."""
    if len(values) == 2:
        return [(values[0], values[1])] if (values[0] ^ values[1]).bit_count() <= radius else []
    tree, links = BKTree(values), []
    for i in range(len(values)):
        if tree.gone[i]:
            continue
        queue = tree.take(values[i], 0)
        while queue and tree.alive[0]:
            at = queue.pop()
            found = tree.take(values[at], radius)
            links += [(values[at], values[x]) for x in found]
            queue += found
    return links


def scheme_for(n: int, radius: int) -> tuple[int, int]:
    """The least sharding that keeps random fingerprints at few per shard; all are exact.

    Up to ``radius`` differing bits touch at most as many blocks, so of b blocks at
    least b - radius are equal, and one shard for each choice of that many
    blocks holds both fingerprints.
    """
    for extra in range(1, 6):
        blocks = radius + extra
        if n / 2 ** (BITS * extra / blocks) <= SHARD:
            return blocks, extra
    return radius + 5, 5


def shard_rows(nodes: DataFrame, radius: int, n: int) -> DataFrame:
    """Each fingerprint once per choice of equal blocks: (shard, fp)."""
    blocks, equal = scheme_for(n, radius)
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    keys = []
    for k, chosen in enumerate(combinations(range(blocks), equal)):
        mask = sum(((1 << edges[b + 1]) - 1) ^ ((1 << edges[b]) - 1) for b in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(signed).cast("long"))))
    return nodes.select(F.explode(F.array(*keys)).alias("shard"), "fp")


def shard_forests(shards: DataFrame, radius: int) -> DataFrame:
    """Links (u, v) of each shard by a BK-tree over its fingerprints.

    Shards lie in sorted partitions; one shard at a time is in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 0), np.int64)
        for batch in _with_end(batches):
            if batch is not None:
                held = np.concatenate([held, np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])], axis=1)
            if not held.shape[1]:
                continue
            starts = np.flatnonzero(np.concatenate([[True], held[0, 1:] != held[0, :-1]]))
            last = held.shape[1] if batch is None else starts[-1]
            bounds = np.append(starts[starts < last], last)
            links = []
            fps = held[1].view(np.uint64)
            for a, b in zip(bounds[:-1], bounds[1:]):
                if b - a > 1:
                    links += shard_links(fps[a:b].tolist(), radius)
            held = held[:, last:].copy()
            pairs = np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    n = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shards.repartition(n, "shard").sortWithinPartitions("shard", "fp").mapInArrow(run, "u long, v long")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def fingerprint_components(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Map each of the distinct fingerprints that has a link to its component's root."""
    nodes = cut(nodes)
    n = nodes.count()
    links = shard_forests(shard_rows(nodes, radius, n), radius).distinct()
    return connected_components(links)


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id: groups of fingerprints linked at ``radius`` bits.

    Exact copies share a fingerprint and collapse by a map-side combined
    aggregate, so links are looked for between distinct fingerprints only. Each
    is sent to every shard that could hold a partner (equal blocks, see
    ``scheme_for``), where a BK-tree over the shard's fingerprints is searched
    along the edges within the radius. Trees stay where their shard is:
    broadcasting them would ship the whole corpus's fingerprints.

    Null, empty and blank texts have fingerprint zero and are linked like any
    other; rows with equal ids are linked by their own texts; a component of
    rows without ids has a null component_id. An empty table gives no rows, other
    columns aren't read, and a very long text takes memory for its own words
    while it is hashed; what goes on is one fingerprint for each row.
    """
    marked = cut(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shingle))
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = fingerprint_components(nodes.select("fp"), radius)
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = placed.join(ids, "root").select("fp", "component_id")
    return marked.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Dropped rows up to which their keys are broadcast; beyond, documents are joined by key.
FEW_DROPPED = 1_000_000


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """One document of each group of linked fingerprints, the first by id, with its columns as they are."""
    keyed = with_row_key(docs)
    marked = cut(fingerprints(keyed, shingle, (DOC_KEY, TIE_KEY)))
    roots = fingerprint_components(marked.select("fp").distinct(), radius)
    placed = marked.join(roots, marked["fp"] == roots["node"], "left").select(DOC_KEY, TIE_KEY, F.coalesce("root", "fp").alias("root"))
    firsts = placed.groupBy("root").agg(F.min(F.struct(DOC_KEY, TIE_KEY)).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    dropped = cut(placed.join(firsts, "root").filter(F.struct(DOC_KEY, TIE_KEY) != F.col("first")).select(DOC_KEY, TIE_KEY))
    if dropped.count() <= FEW_DROPPED:
        dropped = F.broadcast(dropped)
    return keyed.join(dropped, [DOC_KEY, TIE_KEY], "left_anti").select(*docs.columns)
