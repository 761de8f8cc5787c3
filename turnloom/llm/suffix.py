"""Exact substring dedup with longest-previous-factor arrays over content-defined shards.

A byte goes if a window of WINDOW bytes that covers it also starts earlier in the
corpus. Equal windows have to meet in one shard for a suffix order to show that,
without shuffling a row per byte:

1. Every window belongs to its *anchor*, the run of GRAM bytes within it with the
   least hash (the leftmost of equal ones). That depends on the window's bytes
   alone, so equal windows have equal anchors at equal offsets. Consecutive
   windows with the same anchor form a *cell*: about one row per 33 bytes.
2. Cells meet by anchor. Of identical cells all but the first go as a whole;
   these strings are taken out of the suffix order, as they add nothing to it.
3. Different cells with one anchor are where repeated passages begin and end.
   Their bytes (at most 164 each) form the shards' texts, those of an anchor
   with very many cells split by the bytes around it: a suffix array, its
   LCP array, and from previous and next smaller positions in suffix order the
   longest previous factor of every window. Those of WINDOW bytes or more go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import DOC_KEY, TIE_KEY, materialize, spans_of_rows, utf8_buffer, with_row_key

WINDOW, GRAM = 100, 36
#: Bytes hashed at a time; positions within take the low bits of a key.
CHUNK, POS_BITS = 1 << 18, 20
#: Text of one suffix array, and cells of an anchor beyond which they are split by the bytes around it.
SHARD_TEXT, LARGE = 1 << 20, 4096
_BASE = 0x9E3779B97F4A7C15
_ADD, _MUL = 0x632BE59BD9B4E019, 0xD6E8FEB86659FD93


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(_MUL)
    h ^= h >> np.uint64(29)
    h *= np.uint64(_BASE)
    h ^= h >> np.uint64(32)
    return h


class Hasher:
    """Polynomial hashes of any substrings of a buffer, from prefix sums modulo 2**64."""

    def __init__(self, most: int):
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(most, _BASE, np.uint64)]))
        self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(most, pow(_BASE, -1, 2**64), np.uint64)]))

    def prefix(self, buf: np.ndarray) -> np.ndarray:
        out = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(_ADD)) * self.power[: len(buf)], out=out[1:])
        return out


def buffer_cells(buf: np.ndarray, valid: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, ...]:
    """Cells of one buffer: first and last window start, anchor offset, anchor and content hashes.

    ``valid[p]`` says that the window at p lies within one document.
    """
    n = len(buf) - WINDOW + 1
    if n <= 0 or not valid.any():
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    sums = hasher.prefix(buf)
    grams = _mix((sums[GRAM:] - sums[:-GRAM]) * hasher.inverse[: len(buf) - GRAM + 1])
    low = np.uint64((1 << POS_BITS) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width, reach = WINDOW - GRAM + 1, 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    anchor = (least & low).astype(np.int64)
    change = np.empty(n, bool)
    change[0] = True
    change[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], n) - 1
    keep = valid[starts]
    s, e = starts[keep], ends[keep]
    a = anchor[s]
    content = _mix((sums[e + WINDOW] - sums[s]) * hasher.inverse[s] + _mix(((e - s) * 128 + (a - s)).astype(np.uint64)))
    return s, e, a - s, grams[a].view(np.int64), content.view(np.int64)


def packed(start: np.ndarray, n: np.ndarray | int, off: np.ndarray | int) -> np.ndarray:
    """A cell's place in one long; the lowest bit is left for a mark of spans."""
    return (start << 16) | (n << 8) | (off << 1)


def row_cells(buf: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, ...]:
    """Cells of rows: row, place (start in the row, windows, anchor offset, see ``packed``), anchor, content."""
    parts = []
    for i, j in spans_of_rows(offsets, CHUNK):
        lo, hi = int(offsets[i]), int(offsets[j])
        step = hi - lo if j > i + 1 else CHUNK
        for a in range(lo, max(hi - WINDOW + 1, lo + 1), max(1, step - WINDOW + 1)):
            b = min(a + step, hi)
            n = b - a - WINDOW + 1
            if n <= 0:
                continue
            rows = np.arange(i, j)
            row = np.repeat(rows, np.diff(np.clip(offsets[i : j + 1], a, b)))
            s, e, off, key, content = buffer_cells(buf[a:b], row[:n] == row[WINDOW - 1 :], hasher)
            own = row[s]
            parts.append((own.astype(np.int32), packed(s + a - offsets[own], e - s + 1, off), key, content))
    if not parts:
        return np.zeros(0, np.int32), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*parts))


def runs(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of intervals that are ordered by owner and start and have rising ends."""
    if not len(start):
        return owner, start, end
    fresh = np.concatenate([[True], (owner[1:] != owner[:-1]) | (start[1:] > end[:-1])])
    first = np.flatnonzero(fresh)
    return owner[first], start[first], end[np.append(first[1:], len(start)) - 1]


def batch_cells(batch: pa.RecordBatch, hasher: Hasher) -> pa.RecordBatch:
    """Cells and known spans of a batch of (__d, __t, text); what it holds on the way is freed at its end."""
    d, t = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    order = np.lexsort((t, d))
    sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy()[order]
    parts = []
    for i, j in list(spans_of_rows(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), CHUNK)) or [(0, 0)]:
        row, place, key, content = row_cells(*utf8_buffer(batch.column(2).take(pa.array(order[i:j]))), hasher)
        parts.append((row + np.int32(i), place, key, content))
    row, place, key, content = (np.concatenate(x) for x in zip(*parts))
    del parts
    both = key ^ _mix(content.view(np.uint64)).view(np.int64)
    by = np.argsort(both, kind="stable")
    same = (both[by[1:]] == both[by[:-1]]) & (content[by[1:]] == content[by[:-1]])
    again = np.zeros(len(both), bool)
    again[by[1:][same]] = True
    del both, by, same
    start = place[again] >> 16
    r, a, b = runs(row[again], start, start + ((place[again] >> 8) & 0xFF) + WINDOW - 1)
    first = ~again
    spread = _mix((d[order][r] * 31 + a).astype(np.uint64)).view(np.int64)
    rows = order[np.concatenate([row[first], r])]
    columns = (np.concatenate([key[first], spread]), np.concatenate([content[first], b - a]), d[rows], t[rows].astype(np.int32), np.concatenate([place[first], packed(a, 0, 0) | 1]))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "content", DOC_KEY, TIE_KEY, "meta"])


def cell_rows(docs: DataFrame) -> DataFrame:
    """Cells (kind 0) to meet by anchor, and spans (kind 1) already known to repeat.

    Within a batch, identical cells are reduced to the first: a passage that is
    everywhere is shuffled once per batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(CHUNK + WINDOW)
        yield from map(lambda batch: batch_cells(batch, hasher), batches)

    return docs.select(DOC_KEY, TIE_KEY, "text").mapInArrow(run, f"key long, content long, {DOC_KEY} long, {TIE_KEY} int, meta long")


RESOLVED = f"kind int, key long, {DOC_KEY} long, {TIE_KEY} int, start long, len long, off int"


class Resolver:
    """Takes cells (key, content, d, t, meta) sorted by these, batch by batch, and tells what each is.

    A span, and a cell whose content came before at its anchor, is a repeat
    (kind 1). A first cell counts (kind 0) if its anchor has several contents. Of the anchor
    at hand only the first cell is held, and only until a second content comes: what
    an anchor's cells take doesn't grow with their number.
    """

    def __init__(self):
        self.key = self.content = self.pending = None
        self.several = False

    def take(self, columns: list[np.ndarray]) -> pa.RecordBatch:
        key, content, _, _, meta = columns
        span = (meta & 1) == 1
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        new = fresh.copy()
        new[1:] |= content[1:] != content[:-1]
        fresh[0] = key[0] != self.key
        new[0] = fresh[0] or content[0] != self.content
        first = (new | span) & ~span
        anchor = np.cumsum(fresh)  # 0: that of the batch before
        firsts = np.bincount(anchor, weights=first)
        firsts[0] += 2 if self.several else self.pending is not None
        several = firsts > 1
        gone = ~first
        out = [x[gone | several[anchor]] for x in (gone.astype(np.int32), *columns)]
        if self.pending is not None and several[0]:
            out = [np.append(x, np.array([v], x.dtype)) for x, v in zip(out, (0, *self.pending))]
        last = int(anchor[-1])
        if last or several[0]:
            own = np.flatnonzero(first & (anchor == last)) if not several[last] else []
            self.pending = [x[own[0]] for x in columns] if len(own) else None
        elif self.pending is None:
            own = np.flatnonzero(first)
            self.pending = [x[own[0]] for x in columns] if len(own) else None
        self.key, self.content, self.several = key[-1], content[-1], bool(several[last])
        kind, key, content, d, t, meta = out
        n = (meta >> 8) & 0xFF
        length = np.where((meta & 1) == 1, content, n + WINDOW - 1)
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (kind, key, d, t, meta >> 16, length, ((meta >> 1) & 0x7F).astype(np.int32))],
            ["kind", "key", DOC_KEY, TIE_KEY, "start", "len", "off"],
        )


def resolve_cells(cells: DataFrame) -> DataFrame:
    """Repeated spans (kind 1), and first cells of anchors with several contents (kind 0), from sorted partitions (``Resolver``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resolver = Resolver()
        for batch in batches:
            if batch.num_rows:
                yield resolver.take([x.to_numpy(zero_copy_only=False) for x in batch.columns])

    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(n, "key").sortWithinPartitions("key", "content", DOC_KEY, TIE_KEY, "meta").mapInArrow(run, RESOLVED)


def suffix_ranks(text: np.ndarray) -> dict[int, np.ndarray]:
    """Ranks of all positions by their next 8, 16, 32 and 64 bytes (prefix doubling); the end sorts first."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.zeros(n, np.uint64)
    for i in range(8):
        words = (words << np.uint64(8)) | padded[i : i + n].astype(np.uint64)
    ranks = {8: np.unique(words, return_inverse=True)[1].astype(np.int64) + 1}
    depth = 8
    while depth < 64:
        rank = ranks[depth]
        pair = rank << np.int64(32)
        pair[:-depth] |= rank[depth:]
        ranks[depth * 2] = np.unique(pair, return_inverse=True)[1].astype(np.int64) + 1
        depth *= 2
    return ranks


def window_order(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the windows that start at ``at`` (rising), and its LCP array, both up to WINDOW bytes."""
    ranks = suffix_ranks(text)
    high, low = ranks[64][at], ranks[64][at + WINDOW - 64]
    order = np.lexsort((at, low, high))
    a, b = at[order[:-1]], at[order[1:]]
    lcp = np.zeros(len(a), np.int64)
    padded = {d: np.append(r, np.zeros(2 * 64, np.int64)) for d, r in ranks.items()}
    for depth in (64, 32, 16, 8):
        lcp += depth * (padded[depth][a + lcp] == padded[depth][b + lcp])
    whole = (high[order[:-1]] == high[order[1:]]) & (low[order[:-1]] == low[order[1:]])
    lcp = np.where(whole, WINDOW, np.minimum(lcp, WINDOW - 1))
    return order, lcp


def longest_previous_factor(order: list[int], lcp: list[int]) -> list[int]:
    """For each position the longest common prefix with any earlier one.

    ``order`` is the suffix order of positions 0..n-1 and ``lcp[i]`` the common
    prefix of ``order[i]`` and ``order[i + 1]``. The earlier suffixes that share
    most are the nearest smaller positions before and after in suffix order; a
    stack of rising positions meets both, with the least LCP on the way (after
    Crochemore and Ilie).
    """
    lpf = [0] * len(order)
    stack: list[tuple[int, int]] = []
    for at, shared in zip([*order, -1], [0, *lcp, 0]):
        while stack and stack[-1][0] > at:
            top, before = stack.pop()
            lpf[top] = max(before, shared)
            shared = min(before, shared)
        stack.append((at, shared))
    return lpf


def shard_repeats(contexts: list[bytes]) -> list[np.ndarray]:
    """For each context (in corpus order) which of its windows occur earlier."""
    text = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    ends = np.cumsum(sizes)
    counts = sizes - WINDOW + 1
    at = np.arange(counts.sum()) + np.repeat(ends - sizes - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    order, lcp = window_order(text, at)
    lpf = np.array(longest_previous_factor(order.tolist(), lcp.tolist()))
    return np.split(lpf >= WINDOW, np.cumsum(counts)[:-1])


def shard_spans(contexts: DataFrame) -> DataFrame:
    """Repeated spans among cells that share an anchor: (__d, __t, start, len)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def done(part: list[tuple]) -> pa.RecordBatch:
            found = []
            if len(part) > 1:
                for (_, d, t, start, _), again in zip(part, shard_repeats([x[4] for x in part])):
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], again.view(np.int8), [0]])))
                    found += [(d, t, start + int(a), int(b - a) + WINDOW - 1) for a, b in zip(edges[::2], edges[1::2])]
            columns = list(zip(*found)) if found else [[]] * 4
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [DOC_KEY, TIE_KEY, "start", "len"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= SHARD_TEXT and rows[-1][0] != row[0]:
                    yield done(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
        if rows:
            yield done(rows)

    n = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = contexts.select("key", DOC_KEY, TIE_KEY, "start", "context").repartition(n, "key").sortWithinPartitions("key", DOC_KEY, TIE_KEY, "start")
    return dealt.mapInArrow(run, f"{DOC_KEY} long, {TIE_KEY} int, start long, len long")


def offset_ranges(level: int) -> list[tuple[int, int]]:
    """The places an anchor can have in a window (lo to hi), halved ``level`` times."""
    ranges = [(0, WINDOW - GRAM)]
    for _ in range(level):
        halves = [[(lo, (lo + hi) // 2), ((lo + hi) // 2 + 1, hi)] if lo < hi else [(lo, hi)] for lo, hi in ranges]
        ranges = [r for pair in halves for r in pair]
    return ranges


def split_cells(cells: DataFrame, level: int) -> DataFrame:
    """Cells cut to the ranges of one level, each under a key of the bytes that all windows of its range hold.

    A window with its anchor at offset o holds the bytes from o before the anchor
    to WINDOW - o after its start. So those of a range lo to hi share the bytes
    from lo before to WINDOW - hi after, and equal windows, whose offsets are
    equal, stay together. In a range of one offset that is the whole window.
    """
    ranges = F.array(*(F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for lo, hi in offset_ranges(level)))
    last = F.col("off") - (F.length("context") - WINDOW)
    met = F.filter(ranges, lambda r: (r["lo"] <= F.col("off")) & (r["hi"] >= last))
    each = cells.withColumn("last", last).withColumn("r", F.explode(met))
    each = each.withColumn("top", F.least("off", "r.hi")).withColumn("bottom", F.greatest("last", "r.lo"))
    shared = F.substring("context", F.col("off") - F.col("r.lo") + 1, WINDOW - F.col("r.hi") + F.col("r.lo"))
    skipped = F.col("off") - F.col("top")
    return each.select(
        F.xxhash64("key", "r.lo", shared).alias("key"), DOC_KEY, TIE_KEY, (F.col("start") + skipped).alias("start"),
        F.substring("context", skipped + 1, F.col("top") - F.col("bottom") + WINDOW).alias("context"), F.col("top").alias("off"),
    )


def large_spans(cells: DataFrame) -> DataFrame:
    """The same for anchors with very many contents, which no shard could hold.

    Cells are split by the bytes around their anchor, level by level, and of
    parts with equal bytes the first goes on. Keys with at most LARGE parts go to
    a shard's suffix array; the others are split again, in the end to windows.
    """
    spans, place, own = [], F.struct(DOC_KEY, TIE_KEY, "start"), ["key", "off", "context"]
    level = 0
    while not cells.isEmpty():
        level += 1
        parts = materialize(split_cells(cells, level), "suffix-parts")
        firsts = parts.groupBy(*own).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        marked = parts.join(firsts, own, "left").withColumn("again", F.coalesce(place != F.col("first"), F.lit(False))).drop("first")
        marked = materialize(marked, "suffix-marked")
        spans.append(marked.filter("again").select(DOC_KEY, TIE_KEY, "start", F.length("context").cast("long").alias("len")))
        rest = marked.filter("not again")
        whole = all(lo == hi for lo, hi in offset_ranges(level))
        large = rest.groupBy("key").count().filter(F.lit(not whole) & (F.col("count") > LARGE)).select("key")
        spans.append(shard_spans(rest.join(large, "key", "left_anti")))
        cells = materialize(rest.join(large, "key", "left_semi").select(*cells.columns), "suffix-large")
    out = shard_spans(cells)
    for part in spans:
        out = out.unionByName(part)
    return out


def repeated_spans(docs: DataFrame) -> DataFrame:
    """All spans of bytes that occur earlier, of keyed documents: (__d, __t, start, len), overlapping."""
    resolved = materialize(resolve_cells(cell_rows(docs)), "suffix-cells")
    spans = resolved.filter("kind = 1").select(DOC_KEY, TIE_KEY, "start", "len")
    cells = resolved.filter("kind = 0")
    large = cells.groupBy("key").count().filter(F.col("count") > LARGE).select("key", F.lit(True).alias("large"))
    by_doc = (
        cells.join(large, "key", "left")
        .groupBy(DOC_KEY, TIE_KEY)
        .agg(F.collect_list(F.struct("key", "start", "len", "off", F.coalesce("large", F.lit(False)).alias("large"))).alias("cells"))
    )
    raw = docs.select(DOC_KEY, TIE_KEY, "text").join(by_doc, [DOC_KEY, TIE_KEY]).select(DOC_KEY, TIE_KEY, F.encode("text", "UTF-8").alias("b"), "cells")
    taken = raw.select(DOC_KEY, TIE_KEY, F.explode(F.expr("transform(cells, c -> struct(c.key as key, c.start as start, c.off as off, c.large as large, substring(b, cast(c.start as int) + 1, cast(c.len as int)) as context))")).alias("c")).select(DOC_KEY, TIE_KEY, "c.*")
    contexts = materialize(taken, "suffix-contexts")
    return spans.unionByName(shard_spans(contexts.filter("not large"))).unionByName(large_spans(contexts.filter("large").drop("large")))


def cut_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, kept (the remaining bytes), spans (maximal removed runs) for every document.

    Places are ordered by doc_id (null first), rows with one id by their text,
    and within a document by byte; of repeated windows the first stays. Null
    texts read as empty; texts under WINDOW bytes lose nothing. An empty table
    gives no rows, other columns don't matter. A very long text is cut to cells
    piece by piece; its spans are two lists of one row.
    """
    keyed = with_row_key(docs.select("doc_id", "text"))
    spans = repeated_spans(keyed).groupBy(DOC_KEY, TIE_KEY).agg(F.collect_list("start").alias("starts"), F.collect_list("len").alias("lens"))
    joined = keyed.join(spans, [DOC_KEY, TIE_KEY], "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "starts", "lens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            sizes, kept, found = [], [], []
            for text, starts, lens in zip(*(batch.column(i) for i in (1, 2, 3))):
                raw = (text.as_py() or "").encode()
                own = []
                if starts.is_valid:
                    for a, n in sorted(zip(starts.as_py(), lens.as_py())):
                        if own and a <= own[-1][1]:
                            own[-1][1] = max(own[-1][1], a + n)
                        else:
                            own.append([a, a + n])
                sizes.append(len(raw))
                found.append([{"start": a, "end": b} for a, b in own])
                edges = [0, *(x for span in own for x in span), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(found, kinds)], ["doc_id", "n_bytes", "kept", "spans"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, kept binary, spans array<struct<start:long,end:long>>")


def repeat_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of ``cut_repeats``, which states what null, empty, repeated and very long texts give."""
    out = cut_repeats(docs)
    return out.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
