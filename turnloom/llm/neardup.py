"""Near copies of documents: SimHash links by BK-trees and MinHash bands propose pairs, exact Jaccard similarity of word shingles decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import DOC_KEY, TIE_KEY, cut, materialize, small_batches, spans_of_rows, utf8_buffer, with_row_key
from turnloom.llm.components import connected_components, cross_pairs, open_members
from turnloom.llm.decontam import separated, shingle_hashes, word_hashes
from turnloom.llm.simhash import RADIUS, shard_forests, shard_rows
from turnloom.llm.suffix import Hasher

SHINGLE, LEAST = 5, 0.8
#: Bands and values per band: a pair at a similarity of 0.8 meets in none with a chance of 3e-6.
BANDS, ROWS = 32, 5
#: Hubs that the members of a bucket are verified against before all pairs of it are.
ROUNDS = 2
#: Bytes of text in memory at a time, seed of the keys.
CHUNK, SEED = 1 << 18, 42
_FACTORS = np.random.default_rng(SEED).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_rows(buf: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(key, shingle hashes) per text. The key is the hash of all words; a text with fewer than n words is one shingle, one without words has none."""
    hasher = Hasher(CHUNK * 2)
    for i, j in spans_of_rows(offsets, CHUNK):
        part, ends = separated(buf, offsets, i, j)
        if len(part) >= len(hasher.power):
            hasher = Hasher(len(part) + 1)
        starts, _, words = word_hashes(part, hasher)
        first = np.searchsorted(np.searchsorted(ends, starts, side="right"), np.arange(j - i + 1))
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            key = xxhash.xxh64_intdigest(words[a:b].tobytes(), SEED)
            yield key, shingle_hashes(words[a:b], n) if b - a >= n else np.full(int(b > a), key, np.uint64)


def fingerprint(hashes: np.ndarray) -> np.uint64:
    """SimHash of shingle hashes, repeats included: the bits that over half of them have."""
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        votes += np.unpackbits(hashes[i : i + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 64 // 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > len(hashes)).view(">u8")[0].astype(np.uint64)


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """Row key, k (hash of the words), fingerprint and band keys of every text; no bands for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, prints, bands = [], [], np.zeros((batch.num_rows, BANDS), np.uint64)
            has = np.zeros(batch.num_rows, bool)
            held, at = [], 0

            def sign(held: list[np.ndarray], at: int) -> None:
                own = np.flatnonzero([len(x) > 0 for x in held]) + at
                if len(own):
                    sizes = np.array([len(x) for x in held if len(x)])
                    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                    h = np.concatenate(held)
                    has[own] = True
                    for band in range(BANDS):
                        fold = np.full(len(own), band + 1, np.uint64)
                        for f in _FACTORS[band * ROWS : (band + 1) * ROWS]:
                            fold = (fold ^ np.minimum.reduceat(h * f, begin)) * np.uint64(0xC2B2AE3D27D4EB4F)
                            fold ^= fold >> np.uint64(32)
                        bands[own, band] = fold

            for key, hashes in shingle_rows(*utf8_buffer(batch.column(2)), n):
                keys.append(key)
                prints.append(fingerprint(hashes))
                held.append(hashes)
                if len(hashes) > 8192 or len(held) >= 64:
                    sign(held, at)
                    held, at = [], len(keys)
            sign(held, at)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(has * BANDS)]).astype(np.int32), pa.array(bands[has].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(np.array(prints, np.uint64).view(np.int64)), lists], [DOC_KEY, TIE_KEY, "k", "fp", "bands"])

    return docs.select(DOC_KEY, F.col(TIE_KEY).cast("int").alias(TIE_KEY), "text").mapInArrow(run, f"{DOC_KEY} long, {TIE_KEY} int, k long, fp long, bands array<long>")


def fingerprint_pairs(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (u, v), u < v, of keys whose fingerprints link at ``radius`` bits or are equal, of nodes (k, fp).

    The links are a spanning forest of each shard's BK-tree (op7); the least
    key of a fingerprint stands for it there, and its other keys meet that one.
    """
    least = cut(nodes.groupBy("fp").agg(F.min("k").alias("k")))
    links = shard_forests(shard_rows(least.select("fp"), radius, least.count()), radius).distinct()
    across = links.join(least.toDF("u", "a"), "u").join(least.toDF("v", "b"), "v").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    within = nodes.join(least.toDF("fp", "a"), "fp").filter("a <> k").select(F.col("a").alias("u"), F.col("k").alias("v"))
    return across.unionByName(within).distinct()


def similar_pairs(pairs: DataFrame, texts: DataFrame, n: int, least: float) -> DataFrame:
    """Those of the pairs (u, v) whose sets of shingles have Jaccard similarity ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (shingle_rows(*utf8_buffer(batch.column(c)), n) for c in (2, 3))
            keep = []
            for (_, a), (_, b) in zip(left, right):
                a, b = np.unique(a), np.unique(b)
                common = len(np.intersect1d(a, b, assume_unique=True)) if least * max(len(a), len(b)) <= min(len(a), len(b)) else 0
                keep.append(common > 0 and common >= least * (len(a) + len(b) - common))
            kept = pa.array(np.array(keep, bool))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], ["u", "v"])

    both = pairs.join(texts.select(F.col("k").alias("u"), F.col("text").alias("tu")), "u").join(texts.select(F.col("k").alias("v"), F.col("text").alias("tv")), "v")
    return both.select("u", "v", "tu", "tv").mapInArrow(run, "u long, v long")


def text_classes(docs: DataFrame, marked: DataFrame, n: int, least: float) -> DataFrame:
    """Map each key that has a similar other key to its component's root.

    Keys whose fingerprints link (``fingerprint_pairs``) and keys of one band bucket
    are candidates: the first are only the closest copies, the second hold those
    that a SimHash of 64 bits tells apart. Each key is verified against those
    it is linked to by fingerprint and the least key it meets in a bucket, then against a hub in each bucket that holds other components,
    ROUNDS times; then every pair of different components that is left in a
    bucket is verified.
    """
    nodes = marked.filter("bands is not null and size(bands) > 0").groupBy("k").agg(F.min(F.struct(DOC_KEY, TIE_KEY)).alias("p"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    linked = cut(fingerprint_pairs(nodes.select("k", "fp")))
    members = nodes.select("k", "p", F.posexplode("bands").alias("b", "band")).select("k", "p", F.xxhash64("b", "band").alias("bucket"))
    hubs = members.groupBy("bucket").agg(F.min("k").alias("hub"), F.max("k").alias("top")).filter("hub < top").select("bucket", "hub")
    full = materialize(members.join(hubs, "bucket").select("bucket", "hub", "k", "p"), "copy-buckets")
    alike = nodes.join(linked.select(F.explode(F.array("u", "v")).alias("k")).distinct(), "k", "left_semi")
    places = full.select("k", "p").unionByName(alike.select("k", "p")).distinct().select("k", "p.*")
    texts = materialize(docs.select(DOC_KEY, TIE_KEY, "text").join(places, [DOC_KEY, TIE_KEY]).select("k", "text"), "copy-texts")
    full = full.select("bucket", "hub", "k")
    met = full.groupBy("k").agg(F.min("hub").alias("hub")).filter("k <> hub").select(F.col("hub").alias("u"), F.col("k").alias("v"))
    tried = cut(linked.unionByName(met).distinct())
    links = cut(similar_pairs(tried, texts, n, least))
    for r in range(ROUNDS):
        placed = open_members(full, links)
        chosen = placed.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("k", F.lit(r)).alias("h"), "k", "root")).alias("hub"))
        pairs = placed.join(chosen, "bucket").filter(F.col("root") != F.col("hub.root")).select(F.least("k", "hub.k").alias("u"), F.greatest("k", "hub.k").alias("v")).distinct()
        pairs = cut(pairs.join(tried, ["u", "v"], "left_anti"))
        links = cut(links.unionByName(similar_pairs(pairs, texts, n, least)))
        tried = tried.unionByName(pairs)
    rest = cut(cross_pairs(open_members(full, links)).join(tried, ["u", "v"], "left_anti"))
    return connected_components(links.unionByName(similar_pairs(rest, texts, n, least)))


def drop_near_copies(docs: DataFrame, n: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """One document of each group linked by similarity, the first by id, with its columns as they are.

    Texts of the same words are copies, so are all texts without words, null
    ones among them. Wholly repeated rows are copies of each other; rows that share
    an id are told apart by their texts. Columns named ``__d`` or ``__t`` would be
    taken for the row keys and have to be renamed; all others stay as they are.
    An empty table gives no rows; a very long text takes memory for its own
    shingles.
    """
    keyed = with_row_key(docs)
    with small_batches(docs.sparkSession):
        marked = materialize(signatures(keyed, n), "copy-bands")
        roots = text_classes(keyed, marked, n, least)
    placed = marked.join(roots, marked["k"] == roots["node"], "left").select(DOC_KEY, TIE_KEY, F.coalesce("root", "k").alias("root"))
    firsts = placed.groupBy("root").agg(F.min(F.struct(DOC_KEY, TIE_KEY)).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    dropped = cut(placed.join(firsts, "root").filter(F.struct(DOC_KEY, TIE_KEY) != F.col("first")).select(DOC_KEY, TIE_KEY))
    return keyed.join(dropped, [DOC_KEY, TIE_KEY], "left_anti").select(*docs.columns)
