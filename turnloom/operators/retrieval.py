"""Retrieval: cosine of sparse text vectors over a history, exact nearest vectors in blocks, and an inverted-list index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnloom.shared import scratch, stored

#: What a word of a text vector is: letters, digits and all that isn't ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


# Sparse text vectors


def runs_of(words: Column, n: int) -> Column:
    """All runs of n neighbours in an array of words, joined by blanks."""
    starts = F.transform(words, lambda w, i: F.when(i + n <= F.size(words), F.array_join(F.slice(words, i + 1, n), " ")))
    return F.filter(starts, lambda run: run.isNotNull())


def gram_counts(rows: DataFrame, text: str, longest: int) -> DataFrame:
    """Replaces the text by ``gram`` and ``tf``: a row for each different word in lower case and run of up to ``longest`` words.

    Grams are told by a 64-bit hash and counted within their row, in its sorted
    hashes, so nothing is shuffled.
    """
    kept = [c for c in rows.columns if c != text]
    # each step's array stands in a column of its own, or every element would make it anew
    words = rows.select(*kept, F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)).alias("__w"))
    every = F.concat("__w", *(runs_of(F.col("__w"), n) for n in range(2, longest + 1)))
    hashes = words.select(*kept, F.array_sort(F.transform(every, lambda g: F.xxhash64(g))).alias("__h"))
    h, s = F.col("__h"), F.col("__s")
    starts = F.filter(F.transform(h, lambda x, i: F.when((i == 0) | (x != F.get(h, i - 1)), i)), lambda i: i.isNotNull())
    counted = F.transform(s, lambda at, k: F.struct(F.get(h, at).alias("gram"), (F.coalesce(F.get(s, k + 1), F.size(h)) - at).alias("tf")))
    return hashes.select(*kept, "__h", starts.alias("__s")).select(*kept, F.explode(counted).alias("__g")).select(*kept, "__g.gram", "__g.tf")


def text_vectors(rows: DataFrame, keys: list[str], text: str, longest: int = 2) -> DataFrame:
    """keys, gram, weight: a sparse vector for each row.

    A weight is ``(1 + ln tf) * (1 + ln((1 + N) / (1 + df)))`` with N rows. Document
    frequencies come from one aggregate, which is combined before it is
    shuffled; the join with them is Spark's to split where a gram is in many
    rows. Rows without words have no vector.
    """
    grams = gram_counts(rows.select(*keys, text), text, longest)
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    weight = (1 + F.log(F.col("tf"))) * (1 + F.log((1 + F.col("total")) / (1 + F.col("df"))))
    return grams.join(often, "gram").crossJoin(F.broadcast(total)).select(*keys, "gram", weight.alias("weight"))


def select_history(turns: DataFrame, k: int, recency: float = 0.0, longest: int = 2) -> DataFrame:
    """conv_id, turn, score, by_score, place: for each conversation the k turns before its last one that suit that one best.

    ``turns`` has conv_id, turn (places from 0, each once) and text. The last
    turn is the query. The score is the cosine of the two text vectors plus
    ``recency`` times the turn's place among those before the query, from 0 to 1
    (1 if there is one only). ``by_score`` ranks from 1, the earlier turn first of
    equal ones; ``place`` is the chosen turn's place, from 1, in the
    conversation's own order. A turn without words has a cosine of 0.

    Vectors meet by conversation and gram, so a conversation with a third of all
    turns is spread over its grams, and its ranking is cut to k in each task.
    Weights are shuffled three times: to their document frequencies, to the
    query's weights, and to their turn.
    """
    ends = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    ready = turns.select("conv_id", "turn", "text").join(ends, "conv_id").withColumn("asks", F.col("turn") == F.col("last"))
    weighed = stored(text_vectors(ready, ["conv_id", "turn", "asks"], "text", longest), "text-vectors")
    asked = weighed.filter("asks").select("conv_id", "gram", F.col("weight").alias("want"))
    sums = weighed.filter("not asks").join(asked, ["conv_id", "gram"], "left").groupBy("conv_id", "turn").agg(F.sum(F.col("weight") * F.col("weight")).alias("own"), F.sum(F.col("weight") * F.col("want")).alias("dot"))
    wants = asked.groupBy("conv_id").agg(F.sum(F.col("want") * F.col("want")).alias("all"))
    earlier = ready.filter("not asks").select("conv_id", "turn", "last").join(sums, ["conv_id", "turn"], "left").join(wants, "conv_id", "left")
    cosine = F.coalesce(F.col("dot") / F.sqrt("own") / F.sqrt("all"), F.lit(0.0))
    late = F.when(F.col("last") == 1, 1.0).otherwise(F.col("turn") / (F.col("last") - 1))
    scored = earlier.select("conv_id", "turn", F.round(cosine + recency * late, 9).alias("score"))
    best = scored.withColumn("by_score", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "turn")).cast("long")).filter(F.col("by_score") <= k)
    return best.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long"))


def formatted_history(chosen: DataFrame, turns: DataFrame, order: str = "original", renumber: bool = False) -> DataFrame:
    """conv_id, history: the chosen turns' texts in the conversation's order or by score, with their labels or new ones."""
    if order not in ("original", "score"):
        raise ValueError(f"unknown order of a history: {order}")
    place = "place" if order == "original" else "by_score"
    label = F.col("at") if renumber else F.col("turn") + 1
    said = F.concat(F.lit("turn "), label.cast("string"), F.lit(": "), F.coalesce("text", F.lit("")))
    rows = chosen.select("conv_id", "turn", F.col(place).alias("at")).join(turns.select("conv_id", "turn", "text"), ["conv_id", "turn"])
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", said.alias("said")))), lambda x: x["said"]).alias("history"))


# Nearest vectors

#: Rows of queries and of items in a block of their comparison.
QUERY_BLOCK, ITEM_BLOCK = 4096, 32_768


def unit_rows(vectors: pd.Series) -> np.ndarray:
    """Vectors as rows of length one; a zero vector stays zero."""
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def best_of_blocks(queries: pd.DataFrame, items: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k items of a block that are nearest to each query; rows with the query's own id are none."""
    if queries.empty or items.empty:
        return pd.DataFrame({"query": [], "item": [], "score": []}).astype({"query": "int64", "item": "int64"})
    asked, own = queries["id"].to_numpy(), items["id"].to_numpy()
    scores = np.round(unit_rows(queries["v"]) @ unit_rows(items["v"]).T, 9)
    scores[asked[:, None] == own[None, :]] = -np.inf
    least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(asked), -np.inf)
    q, i = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
    order = np.lexsort((own[i], -scores[q, i], q))
    q, i = q[order], i[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    q, i = q[rank < k], i[rank < k]
    return pd.DataFrame({"query": asked[q], "item": own[i], "score": scores[q, i]})


def dealt(rows: DataFrame, cell: list[str], own: str, others: str, counts: DataFrame) -> DataFrame:
    """Rows of each cell in blocks of their own, each sent to all blocks of the other side."""
    blocks = rows.join(F.broadcast(counts), cell) if cell else rows.crossJoin(F.broadcast(counts))
    return blocks.withColumn(own, F.pmod(F.xxhash64("id"), F.col(f"n_{own}")).cast("int")).withColumn(others, F.explode(F.sequence(F.lit(0), F.col(f"n_{others}") - 1)))


def compare_blocks(queries: DataFrame, items: DataFrame, cell: list[str], k: int, query_block: int, item_block: int) -> DataFrame:
    """query, item, score, rank: the k nearest of the items in a query's cells, by cosine.

    Blocks of queries meet blocks of items, each pair of blocks in one task, and
    only k rows of each go on. Both sides have id, v and the cell's columns; there
    is one row of counts for each cell.
    """
    blocks = lambda rows, name, most: rows.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(f"n_{name}"))
    sizes = blocks(queries, "qb", query_block)
    counts = sizes.join(blocks(items, "ib", item_block), cell) if cell else sizes.crossJoin(blocks(items, "ib", item_block))
    key = [*cell, "qb", "ib"]
    q, i = dealt(queries, cell, "qb", "ib", counts).select(*key, "id", "v"), dealt(items, cell, "ib", "qb", counts).select(*key, "id", "v")
    met = q.groupBy(*key).cogroup(i.groupBy(*key)).applyInPandas(lambda a, b: best_of_blocks(a, b, k), "query long, item long, score double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "item")).cast("long")
    return met.withColumn("rank", place).filter(F.col("rank") <= k)


def named(rows: DataFrame, key: str, vector: str) -> DataFrame:
    return rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v")).filter("id is not null and v is not null")


def top_k(queries: DataFrame, items: DataFrame, query_id: str, item_id: str, vector: str, k: int, query_block: int = QUERY_BLOCK, item_block: int = ITEM_BLOCK) -> DataFrame:
    """query, item, score, rank: exact cosine neighbours, all blocks of queries against all blocks of items in one pass.

    Ties go to the smaller id, rows with a query's id aren't its neighbours, rows
    without id or vector are passed over. Work is queries times items; where both
    grow, ``build_index`` is the way.
    """
    return compare_blocks(named(queries, query_id, vector), named(items, item_id, vector), [], k, query_block, item_block)


# Inverted lists


@dataclass(frozen=True)
class Index:
    """Vectors in a table with a folder for each list, and the centroid of each list."""

    items: DataFrame
    centroids: np.ndarray | None
    probes: int
    recall: float


#: Rows at most that centroids are fitted to, and queries at most that the number of probes is set by.
FIT_ROWS, TRIED = 16_384, 256
#: Rows of the sample for each centroid, at least, and the most centroids.
PER_LIST, MOST_LISTS = 32, 512
ROUNDS = 12


def fit_centroids(x: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of unit rows by spherical k-means, from rows spread over the given order; an empty list keeps its centroid."""
    centroids = x[np.linspace(0, len(x) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        nearest = np.argmax(x @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centroids)
    return centroids


def with_lists(rows: DataFrame, centroids: np.ndarray | None, probes: int) -> DataFrame:
    """id, v, list, at: each row with the ``probes`` lists whose centroids are nearest to it, the nearest at 1."""
    if centroids is None:
        return rows.select("id", "v", F.lit(0).alias("list"), F.lit(1).alias("at"))
    sent = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                near = unit_rows(pdf["v"]) @ sent.value.T
                nearest = np.argsort(-near, axis=1, kind="stable")[:, :probes]
                places = np.tile(np.arange(1, nearest.shape[1] + 1, dtype=np.int32), len(pdf))
                yield pdf.loc[pdf.index.repeat(nearest.shape[1])].assign(list=nearest.ravel().astype(np.int32), at=places)

    return rows.mapInPandas(run, "id long, v array<float>, list int, at int")


def build_index(items: DataFrame, item_id: str, vector: str, k: int = 10, recall: float = 0.95, fit_rows: int = FIT_ROWS) -> Index:
    """An index for searches of k neighbours that finds ``recall`` of them on a sample.

    Centroids are fitted to at most ``fit_rows`` rows, those with the least hashes
    of their ids, in one task; every row is indexed. The driver holds the
    centroids. The number of lists that a search probes is the least that
    finds enough of the exact neighbours of 256 sampled rows; all lists are an exact
    search. Lists are written with a folder each, so that a search reads what it
    probes.
    """
    rows = named(items, item_id, vector)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(fit_rows)

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [pdf for pdf in frames if len(pdf)]
        if parts:
            x = unit_rows(pd.concat(parts).sort_values("id")["v"])
            lists = max(1, min(MOST_LISTS, len(x) // PER_LIST))
            yield pd.DataFrame({"c": list(fit_centroids(x[np.random.default_rng(7).permutation(len(x))], lists))})

    centroids = np.array([r.c for r in sample.coalesce(1).mapInPandas(fit, "c array<double>").collect()])
    if not len(centroids):
        return Index(with_lists(rows, None, 1).drop("at"), None, 1, 1.0)
    path = scratch(items.sparkSession, "inverted-lists")
    salt = F.pmod(F.xxhash64("id"), F.lit(8))
    with_lists(rows, centroids, 1).drop("at").repartition("list", salt).write.partitionBy("list").parquet(path)
    indexed = items.sparkSession.read.schema("id long, v array<float>, list int").parquet(path)
    tried = stored(sample.limit(TRIED), "tried")
    exact = stored(top_k(tried, rows, "id", "id", "v", k).select("query", "item"), "exact")
    ranks = with_lists(tried, centroids, len(centroids)).select(F.col("id").alias("query"), "list", "at")
    # at which probe each true neighbour would be met
    met = exact.join(indexed.select(F.col("id").alias("item"), "list"), "item").join(ranks, ["query", "list"]).groupBy("at").count().orderBy("at").collect()
    total, found, probes = sum(r["count"] for r in met), 0, len(centroids)
    for r in met:
        found += r["count"]
        if found >= recall * total:
            probes = r["at"]
            break
    return Index(indexed, centroids, int(probes), found / total if total else 1.0)


def search(index: Index, queries: DataFrame, query_id: str, vector: str, k: int, probes: int | None = None, query_block: int = QUERY_BLOCK, item_block: int = ITEM_BLOCK) -> DataFrame:
    """query, item, score, rank: the k nearest items in the lists that each query probes.

    Queries and lists meet block by block, so neither a list with a third of all
    items nor one that a third of all queries probe is one task.
    """
    asked = with_lists(named(queries, query_id, vector), index.centroids, probes or index.probes).drop("at")
    return compare_blocks(asked, index.items, ["list"], k, query_block, item_block)
