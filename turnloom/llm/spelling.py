"""Spelling variants: a self-join of the vocabulary in tries with active-node sets (Wang, Feng and Li, 2010)."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import cut, materialize

#: Fewest code points and occurrences of a word.
LEAST_CHARS, LEAST_COUNT = 7, 2
#: One in so many runs of a document loses a code point; 0: none does.
SLIPS = 31
#: How many times as frequent as a word its form is.
RATIO = 10
#: Words that one trie holds; buckets of more are parted, down to buckets that differ in one place.
MOST_WORDS = 4096
#: Different words that a task gathers before it hands their counts on.
GATHERED = 200_000
LETTERS = "a-zÀ-ÿ"


def slipped(run: str, start: int, slips: int) -> str:
    """The run, or the run without one code point, by the checksum of id (``start``) and run."""
    h = zlib.crc32(run.encode(), start)
    if slips and h % slips == 0:
        at = h % len(run)
        return run[:at] + run[at + 1 :]
    return run


def vocabulary(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, slips: int = SLIPS) -> DataFrame:
    """word, n: runs of letters of all whole texts, A-Z in lower case, that are long and frequent enough.

    Runs are counted in each document, then in each task, before words are
    shuffled. A null text has none; a null id has no digits.
    """
    runs = re.compile(f"[{LETTERS}]{{{max(1, least_chars)},}}")

    def hand_on(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                lower = (text.as_py() or "").encode().lower().decode()
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for found, n in Counter(runs.findall(lower)).items():
                    word = slipped(found, start, slips)
                    if len(word) >= least_chars:
                        counts[word] += n
                if len(counts) > GATHERED:
                    yield hand_on(counts)
                    counts = Counter()
        yield hand_on(counts)

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def near_pairs(words: list[str]) -> Iterator[tuple[int, int]]:
    """Places (a, b) of different words one edit apart, in a trie walked once.

    A node's active nodes are those whose strings are one edit from its own. A
    child's are its parent, its siblings, its own children, and what the
    parent's active nodes reach by the child's letter. Two words at one node's
    end and an active node's end are a pair; it is told at the later word.
    """
    children: list[dict[str, int]] = [{}]
    ends: list[int] = [-1]
    for k, word in enumerate(words):
        node = 0
        for letter in word:
            below = children[node].get(letter)
            if below is None:
                below = children[node][letter] = len(children)
                children.append({})
                ends.append(-1)
            node = below
        ends[node] = k
    stack = [(0, set(children[0].values()))]
    while stack:
        node, active = stack.pop()
        if ends[node] >= 0:
            for other in active:
                if 0 <= ends[other] < ends[node]:
                    yield ends[other], ends[node]
        for letter, child in children[node].items():
            reached = {children[m][letter] for m in active if letter in children[m]}
            reached.update(children[node].values(), children[child].values(), (node,))
            reached.discard(child)
            stack.append((child, reached))


def parted(rows: DataFrame) -> DataFrame:
    """Each row of a bucket in the two buckets that its open part's halves make.

    A bucket holds words of ``size`` or ``size - 1`` code points with the same
    first ``i`` and last ``j``. Two of them one edit apart share the first half of
    what is between, or the last. Who shares the first is left to that bucket:
    ``below`` tells how long a common beginning the other one passes over.
    """
    between = F.col("size") - F.col("i") - F.col("j")
    head, tail = F.floor((between + 1) / 2).cast("int"), F.floor(between / 2).cast("int")
    first = F.struct((F.col("i") + head).alias("i"), F.col("j").alias("j"), F.col("below").alias("below"))
    last = F.struct(F.col("i").alias("i"), (F.col("j") + tail).alias("j"), (F.col("i") + head).alias("below"))
    kept = [c for c in rows.columns if c not in ("i", "j", "below")]
    return rows.select(*kept, F.explode(F.array(first, last)).alias("x")).select(*kept, "x.i", "x.j", "x.below")


def bucket_key() -> Column:
    """Equal for words of a bucket; tries compare the parts themselves."""
    return F.xxhash64("size", "i", "j", F.expr("left(word, i)"), F.expr("right(word, j)"))


def near_words(words: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """word, near, near_n: for each word all others at an edit distance of one, from word, n.

    Buckets of words by their first or last half become tries, each in one task.
    Buckets of more than ``most`` words are parted anew, by halves of what is
    between, until they are small; words that are open at one place are at most
    one for each letter. Any bound gives the same pairs, each once.
    """
    size = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("size"), F.lit(0).alias("i"), F.lit(0).alias("j")).withColumn("below", F.col("size") + 1)
    key = ["size", "i", "j", "below", "key"]
    found = None
    while rows is not None:
        rows = parted(rows).withColumn("key", bucket_key())
        full = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("of")).filter((F.col("of") > most) & (F.col("size") - F.col("i") - F.col("j") > 1)).select("key")
        full = cut(full.distinct())
        more = None
        if not full.isEmpty():
            more = cut(rows.join(full, "key", "left_semi").drop("key"))
            rows = rows.join(full, "key", "left_anti")
        buckets = rows.groupBy(*key).agg(F.collect_list(F.struct("word", "n")).alias("words")).filter(F.size("words") > 1)
        pairs = buckets.select("size", "i", "j", "below", "words").mapInArrow(pairs_of_buckets, "word string, near string, near_n long")
        found = pairs if found is None else found.unionByName(pairs)
        rows = more
    return found


def pairs_of_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple[str, str, int]] = []
        for size, i, j, below, words in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4)):
            same = defaultdict(list)
            for x in words.as_py():
                w = x["word"]
                same[w[:i], w[len(w) - j :]].append((w, x["n"]))
            for bucket in same.values():
                bucket.sort()
                for a, b in near_pairs([w[i : len(w) - j] for w, _ in bucket]):
                    (u, nu), (v, nv) = bucket[a], bucket[b]
                    if max(len(u), len(v)) == size and u[:below] != v[:below]:
                        out += [(u, v, nv), (v, u, nu)]
        columns = list(zip(*out)) if out else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], ["word", "near", "near_n"])


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where a word's forms end, from word, form (both never null).

    Links double in length each round. A form is ten times as frequent as its
    word, so no chain of 63-bit counts is longer than 19 links, or five rounds.
    """
    state = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = state.select(F.col("word").alias("at"), F.col("root").alias("next"))
        if state.join(ahead, F.col("root") == F.col("at"), "left_semi").isEmpty():
            return state
        state = cut(state.join(ahead, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root")))


def group_variants(words: DataFrame, ratio: int = RATIO, most: int = MOST_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n; a row for each word).

    A word's form is the most frequent word one edit away (of several the
    smallest in code-point order) if it is ``ratio`` times as frequent; root is the
    end of the chain of forms. Words without near ones have n_near 0 and are
    their own root. An empty vocabulary gives no rows; a null word is passed over.
    A very long word goes to four buckets of its halves and is walked letter by
    letter only where another word shares a half.
    """
    words = materialize(words.filter("word is not null").select("word", F.col("n").cast("long").alias("n")), "vocabulary")
    best = near_words(words, most).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("top"))
    often = -F.col("top.less")
    formed = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(often >= ratio * F.col("n"), F.col("top.near")).alias("form"), F.when(often >= ratio * F.col("n"), often).alias("form_n"),
    )
    formed = materialize(formed, "forms")
    ends = roots(formed.filter("form is not null"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """``group_variants`` of the words of all whole texts.

    Null texts have no words, repeated rows count as often as they stand, an
    empty table gives no rows, and columns but doc_id and text aren't read.
    """
    return group_variants(vocabulary(docs))
