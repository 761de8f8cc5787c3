"""Greedy near-duplicate filtering by ROUGE-L, and scores of calls."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.shared import cut, stored


def lcs_length(a: Sequence[str], b: Sequence[str]) -> int:
    """Longest common subsequence with one bit vector for all of ``a`` (Hyyrö, 2004)."""
    places: dict[str, int] = defaultdict(int)
    for i, x in enumerate(a):
        places[x] |= 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        shared = row & places.get(y, 0)
        row = ((row + shared) | (row - shared)) & full
    return len(a) - row.bit_count()


def rouge_l(a: Sequence[str], b: Sequence[str]) -> float:
    """F-measure of the longest common subsequence of two token lists."""
    common = lcs_length(a, b) if a and b else 0
    return 2 * common / (len(a) + len(b)) if common else 0.0


#: Slots by hash in which occurrences of words are counted, and slots of a text's bag of words.
WORD_SLOTS, BAG_SLOTS = 1 << 16, 128
_ODD = np.array([0x9E3779B97F4A7C15, 0xD1342543DE82EF95], np.uint64)


def word_hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda x: F.xxhash64(x))


def rare_first(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Codes of a text's words with their numbers of earlier occurrences, so that bags are sets, in a fixed order: rare words first by ``counts``."""
    own = np.sort(words)
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    nth = np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own))))
    codes = (own.view(np.uint64) ^ (nth.astype(np.uint64) * _ODD[0])) * _ODD[1]
    codes ^= codes >> np.uint64(29)
    return codes[np.lexsort((codes, counts[own % WORD_SLOTS] // (nth + 1)))].view(np.int64)


def prefix_size(n: int, bound: float) -> int:
    """How many of the first of n words hold the first one shared with any text of a score above the bound."""
    fewest = int(n * bound / (2 - bound)) + 1
    return max(1, n - int((n + fewest) * bound / 2 - 1e-9))


def bag(words: np.ndarray) -> np.ndarray:
    """How many words of a text fall in each slot, 255 for more."""
    return np.minimum(np.bincount((words >> 20) % BAG_SLOTS, minlength=BAG_SLOTS), 255).astype(np.uint8)


def most_shared(bags: np.ndarray, own: np.ndarray) -> np.ndarray:
    """As many words as rows of bags can share at most; a full slot tells nothing."""
    return np.where((np.minimum(bags, own) == 255).any(axis=1), 1 << 40, np.minimum(bags, own).sum(axis=1, dtype=np.int64))


def word_counts(words: DataFrame) -> np.ndarray:
    """Occurrences of words in each slot, over all texts of ``__words``; one number for each of WORD_SLOTS goes to the driver."""
    slots = words.select(F.explode("__words").alias("w")).groupBy(F.pmod("w", F.lit(WORD_SLOTS)).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    out = np.zeros(WORD_SLOTS, np.int64)
    for slot, n in slots.collect():
        out[slot] = n
    return out


def candidate_pairs(texts: DataFrame, bound: float) -> DataFrame:
    """(u, v), u < v, of all texts (__id, __g, __words) of a group that may have a ROUGE-L score above ``bound``.

    A score above the bound needs more than bound / 2 of both lengths in shared
    words. In any fixed order the first word that two texts share has so many
    others after it in both (prefix and positional filtering; Chaudhuri et al.,
    2006, Xiao et al., 2008). Rare words come first in that order, so few texts
    meet at one. Of those that meet, bags of words by hash tell most apart.
    """
    counts = word_counts(texts)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def prefixes(words: pd.Series) -> pd.Series:
        return pd.Series([rare_first(np.asarray(w, np.int64), counts)[: prefix_size(len(w), bound)] for w in words])

    @F.pandas_udf(T.BinaryType())
    def bags(words: pd.Series) -> pd.Series:
        return pd.Series([bag(np.asarray(w, np.int64)).tobytes() for w in words])

    @F.pandas_udf(T.LongType())
    def most(a: pd.Series, b: pd.Series) -> pd.Series:
        left, right = (np.frombuffer(b"".join(x), np.uint8).reshape(-1, BAG_SLOTS) for x in (a, b))
        return pd.Series(most_shared(left, right))

    slim = texts.select("__g", "__id", F.size("__words").alias("n"), F.posexplode(prefixes("__words")).alias("pos", "tok"))
    a, b = slim.toDF("__g", "u", "nu", "pu", "tok"), slim.toDF("__g", "v", "nv", "pv", "tok")
    shared = F.floor((F.col("nu") + F.col("nv")) * F.lit(bound / 2) - 1e-9)
    reach = (F.col("pu") < F.col("nu") - shared) & (F.col("pv") < F.col("nv") - shared)
    met = a.join(b, ["__g", "tok"]).filter((F.col("u") < F.col("v")) & (2 * F.least("nu", "nv") > F.lit(bound) * (F.col("nu") + F.col("nv"))) & reach)
    held = texts.select("__id", F.size("__words").alias("n"), bags("__words").alias("bag"))
    both = met.select("u", "v").distinct().join(held.toDF("u", "nu", "bu"), "u").join(held.toDF("v", "nv", "bv"), "v")
    return both.filter(2 * most("bu", "bv") > F.lit(bound) * (F.col("nu") + F.col("nv"))).select("u", "v")


def _same(keys: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys))


def greedy_dedup(df: DataFrame, group: str, order: Sequence[str], text: str, bound: float) -> DataFrame:
    """Rows that pass the greedy filter, whose record starts anew for each group.

    A row goes if a row that was kept before it in its group is more similar
    than ``bound`` by ROUGE-L. Rows with the same tokens as an earlier one (by two
    64-bit hashes of all) go at once (whatever kept that one out keeps them out as
    well); their texts go no further. Of the others, candidate pairs come from
    shared rare tokens and are scored; then each row is decided once all its
    earlier neighbours are, in rounds over the pairs alone. No group has to fit a
    task. Texts without tokens are like nothing and stay; null texts read as
    empty. ``order`` has to tell rows of a group apart, as does the group with it
    over the table.
    """
    keys = [group, *order]
    toks = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != "")
    rows = df.select(*keys, toks.alias("__toks"))
    hashed = rows.filter(F.size("__toks") > 0).select(*keys, F.xxhash64("__toks").alias("__h1"), F.xxhash64(F.lit(1), "__toks").alias("__h2"))
    least = hashed.groupBy(F.col(group).alias("__g"), "__h1", "__h2").agg(F.min(F.struct(*order)).alias("__p"))
    firsts = stored(least.select(F.monotonically_increasing_id().alias("__id"), F.col("__g").alias(group), "__p.*"), "dedup-firsts")
    found = df.select(*keys, F.col(text).alias("__text")).alias("l").join(firsts.alias("r"), _same(keys))
    texts = stored(found.select("r.__id", F.xxhash64(f"l.{group}").alias("__g"), F.struct(*(f"l.{k}" for k in order)).alias("__p"), "__text"), "dedup-texts")
    own = F.filter(F.split(F.lower("__text"), r"\s+"), lambda x: x != "")
    pairs = candidate_pairs(texts.select("__id", "__g", word_hashes(own).alias("__words")), bound)
    placed = texts.select("__id", "__p", own.alias("t"))
    both = pairs.join(placed.toDF("u", "pu", "a"), "u").join(placed.toDF("v", "pv", "b"), "v").filter(token_score("a", "b") > bound)
    first = F.col("pu") < F.col("pv")
    edges = cut(both.select(F.when(first, F.col("u")).otherwise(F.col("v")).alias("u"), F.when(first, F.col("v")).otherwise(F.col("u")).alias("v")))
    lost = None
    while not edges.isEmpty():
        # who has no earlier neighbour left stays; who has one that stays goes
        stay = edges.select(F.col("u").alias("x")).distinct().join(edges.select(F.col("v").alias("x")).distinct(), "x", "left_anti")
        go = cut(edges.join(stay, edges["u"] == stay["x"], "left_semi").select(F.col("v").alias("x")).distinct())
        lost = go if lost is None else cut(lost.unionByName(go))
        decided = stay.unionByName(go)
        edges = cut(edges.join(go, edges["v"] == go["x"], "left_anti").join(decided, F.col("u") == F.col("x"), "left_anti"))
    kept = firsts if lost is None else firsts.join(lost, firsts["__id"] == lost["x"], "left_anti")
    chosen = kept.select(*keys).unionByName(rows.filter(F.size("__toks") == 0).select(*keys))
    return df.alias("l").join(chosen.alias("r"), _same(keys), "left_semi")


def call_scores(df: DataFrame, counts: str, same_name: Column, parse_ok: Column) -> DataFrame:
    """api_correct, arg_exact_match, precision, recall and F1 of arguments, final_exact, from counts (gold, pred, matched)."""
    gold, pred, matched = (F.col(f"{counts}.{x}") for x in ("gold", "pred", "matched"))
    none = (gold == 0) & (pred == 0)
    precision = F.when(none, 1.0).otherwise(F.when(pred > 0, matched / pred).otherwise(0.0))
    recall = F.when(none, 1.0).otherwise(F.when(gold > 0, matched / gold).otherwise(0.0))
    f1 = F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)))
    exact = (gold == pred) & (matched == gold)
    api = parse_ok & same_name
    return df.withColumns({"api_correct": api, "arg_exact_match": exact, "arg_precision": precision, "arg_recall": recall, "arg_f1": f1, "final_exact": api & exact})


@F.pandas_udf(T.DoubleType())
def token_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([rouge_l(list(x), list(y)) for x, y in zip(a, b)], dtype=float)
