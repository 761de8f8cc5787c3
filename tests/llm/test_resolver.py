"""op8's resolver of cells: any cut into batches tells the same, and it holds one cell of an anchor however many there are."""

import random

import numpy as np


from turnloom.llm import suffix

NAMES = ["kind", "key", suffix.DOC_KEY, suffix.TIE_KEY, "start", "len", "off"]


def plain(rows):
    """From whole anchors: repeats, and firsts where an anchor has more than one."""
    out, seen = [], {}
    for key, content, d, t, meta in rows:
        if not meta & 1:
            seen.setdefault(key, set()).add(content)
    before = set()
    for key, content, d, t, meta in rows:
        span = meta & 1
        again = span or (key, content) in before
        if not span:
            before.add((key, content))
        if again or len(seen[key]) > 1:
            out.append((int(bool(again)), key, d, t, meta >> 16, content if span else ((meta >> 8) & 0xFF) + suffix.WINDOW - 1, (meta >> 1) & 0x7F))
    return sorted(out)


def told(rows, sizes):
    resolver, at, out = suffix.Resolver(), 0, []
    for n in sizes:
        part = rows[at : at + n]
        at += n
        if part:
            kinds = (np.int64, np.int64, np.int64, np.int32, np.int64)
            batch = resolver.take([np.array(c, k) for c, k in zip(zip(*part), kinds)])
            assert batch.schema.names == NAMES
            out += list(zip(*(c.to_pylist() for c in batch.columns)))
    return sorted(out)


def test_batches_of_any_size_tell_the_same():
    rng = random.Random(8)
    for trial in range(60):
        rows = []
        for key in range(rng.randrange(1, 9)):
            for _ in range(rng.randrange(1, 12)):
                rows.append((key * 10, rng.randrange(rng.choice([1, 2, 6])), rng.randrange(5), 0, suffix.packed(rng.randrange(900), rng.randrange(1, 60), rng.randrange(60))))
        rows += [(rng.randrange(10**6) * 10 + 1, rng.randrange(100, 400), rng.randrange(5), 0, suffix.packed(rng.randrange(900), 0, 0) | 1) for _ in range(rng.randrange(4))]
        rows.sort()
        want = plain(rows)
        for most in (1, 2, 5, 1000):
            sizes = []
            while sum(sizes) < len(rows):
                sizes.append(rng.randrange(1, most + 1))
            assert told(rows, sizes) == want, trial


def test_an_anchor_with_very_many_cells_holds_one():
    resolver, kept = suffix.Resolver(), 0
    for k in range(200):
        content = np.arange(k * 500, (k + 1) * 500, dtype=np.int64)
        columns = [np.full(500, 7, np.int64), content, content % 9, np.zeros(500, np.int32), np.full(500, suffix.packed(3, 5, 1), np.int64)]
        kept += resolver.take(columns).num_rows
        assert resolver.pending is None and resolver.several
    assert kept == 100_000


def test_small_arrow_batches_give_the_same_rows(spark):
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    texts = [passage[: rng.randrange(100, 400)] + "".join(rng.choice("xyz ") for _ in range(rng.randrange(200))) for _ in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    read = lambda: sorted(map(tuple, suffix.repeat_digests(docs).collect()))
    want, before = read(), spark.conf.get(name)
    try:
        spark.conf.set(name, "3")
        assert read() == want and sum(r[2] for r in want) > 0
    finally:
        spark.conf.set(name, before)


def test_rows_of_one_id_are_numbered_in_slices(spark):
    """A table without ids: all rows are told apart, in the order of their texts' hashes, and no task numbers more than a few."""
    from pyspark.sql import functions as F

    from turnloom.llm.common import DOC_KEY, NULL_ID, TIE_KEY, with_row_key

    rows = [(None, f"text {k % 900}", "x") for k in range(1000)] + [(5, None, "y"), (5, None, "y"), (6, "alone", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own string")
    keyed = with_row_key(docs)
    got = keyed.collect()
    assert keyed.columns == [*docs.columns, DOC_KEY, TIE_KEY] and dict(keyed.dtypes)[TIE_KEY] == "int"
    none = sorted((r for r in got if r.doc_id is None), key=lambda r: r[TIE_KEY])
    assert [r[TIE_KEY] for r in none] == list(range(1000)) and {r[DOC_KEY] for r in none} == {NULL_ID}
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    assert [hashes[r.text] for r in none] == sorted(hashes[r.text] for r in none)
    assert sorted(r[TIE_KEY] for r in got if r.doc_id == 5) == [0, 1] and [r[TIE_KEY] for r in got if r.doc_id == 6] == [0]
    slices = docs.filter("doc_id is null").groupBy(F.shiftright(F.xxhash64("text"), 54)).count().agg(F.max("count")).first()[0]
    assert slices < 20
    assert with_row_key(docs.limit(0)).count() == 0
