"""Spelling variants, shards and fill-in-middle against brute force, and on nulls, empties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from turnloom.llm import fim, sharding, spelling
from turnloom.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, source string"
ROWS = [
    (1, None, "a"), (2, "", "b"), (None, "No id, but Words like counter and countre; counter", None), (None, "No id, but Words like counter and countre; counter", None),
    (3, "x" * 30_000 + " " + "x" * 29_999 + " y", "a"), (4, "x" * 30_000 + " " + "x" * 29_999 + "\n", "a"), (5, "ÀÉÎÕÜàé ÷÷×÷÷×÷ \U0001f600 Grüße aus Straßen straßen STRASSEN", "c"),
    (6, "text with <P> in it", "c"), (7, "text with <S and > and <M", "c"), (7, "same id, other text", "c"), (8, "< P><", "c"), (9, "a", None), (-10, "Don't stop\r\n\tnow \x00 end", "d"),
]


def table(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def clashing(spark):
    """Columns named like those that the operators use."""
    names = "doc_id long, text string, size string, n string, h string, slot string, slice string, form string, word string, near string, output string, key string, i string, j string"
    return spark.createDataFrame([(k, f"several words of number {k % 3} and several others", *["z"] * 12) for k in range(9)], names)


# op11


def slip(doc, run):
    h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
    return run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[at:] == b[at + 1 :] if len(a) < len(b) else a[at + 1 :] == b[at + 1 :]


def brute_variants(counts, ratio=10):
    form, near = {}, {}
    for w, n in counts.items():
        near[w] = [v for v in counts if one_edit(w, v)]
        if near[w]:
            top = min(near[w], key=lambda v: (-counts[v], v))
            form[w] = top if counts[top] >= ratio * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form.get(root):
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), counts[form[w]] if form.get(w) else None))
    return out


def brute_words(rows):
    counts = Counter()
    for doc, text in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        counts.update(w for w in (slip(doc, r) for r in re.findall("[a-zÀ-ÿ]+", lower)) if len(w) >= 7)
    return {w: n for w, n in counts.items() if n >= 2}


def rows_of(df, *names):
    got = [tuple(r[n] for n in names) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


VARIANT = ("word", "form", "root", "n", "n_near", "form_n")


def test_variants_of_whole_texts(spark, sf):
    got = rows_of(QUERIES["op11_spelling_variants"](spark, sf), *VARIANT)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_variants(brute_words(docs))
    assert got == want and any(x[1] for x in want) and len(want) > 100


def test_variants_of_odd_rows(spark):
    got = rows_of(spelling.spelling_variants(table(spark, ROWS)), *VARIANT)
    assert got == brute_variants(brute_words([r[:2] for r in ROWS]))
    assert spelling.spelling_variants(table(spark, [])).count() == 0


def test_variants_do_not_depend_on_how_buckets_are_parted(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("ab") for _ in range(rng.randrange(7, 12))): rng.choice([2, 3, 25, 400, 9000]) for _ in range(500)}
    words |= {"prefix" + "".join(rng.choice("abc") for _ in range(5)): rng.choice([2, 30]) for _ in range(300)}
    words |= {"z" * k: 10**k for k in range(7, 15)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = brute_variants(words)
    for most in (4096, 40, 1):
        assert rows_of(spelling.group_variants(df, most=most), *VARIANT) == want
    assert max(len(x[2]) - len(x[0]) for x in want if x[0].startswith("zzz")) == 7  # the root is seven forms away


def test_variants_null_words_and_clashes(spark, clashing):
    df = spark.createDataFrame([(None, 5), ("abcdefg", 2), ("abcdefh", 20)], "word string, n long")
    assert rows_of(spelling.group_variants(df), *VARIANT) == {("abcdefg", "abcdefh", "abcdefh", 2, 1, 20), ("abcdefh", None, "abcdefh", 20, 1, None)}
    long = spark.createDataFrame([("x" * 30_000, 2), ("x" * 29_999, 30), ("y" * 9000 + "z", 2)], "word string, n long")
    assert {(len(x[0]), x[4], len(x[2])) for x in rows_of(spelling.group_variants(long), *VARIANT)} == {(30_000, 1, 29_999), (29_999, 1, 29_999), (9001, 0, 9001)}
    assert {r.word for r in spelling.spelling_variants(clashing).collect()} >= {"several"}


# op12


def plain_jump(key, buckets):
    b, j = -1, 0
    while j < buckets:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jumps_equal_the_plain_walk():
    keys = np.random.default_rng(1).integers(0, 2**64, 3000, dtype=np.uint64)
    at = {n: sharding.jump(keys, n) for n in (1, 2, 7, 40, 41, 1000)}
    assert all(at[n].tolist() == [plain_jump(int(k), n) for k in keys] for n in at)
    assert set(at[41][at[41] != at[40]]) == {40}
    assert len(sharding.jump(keys[:0], 5)) == 0


def check_shards(rows, got):
    key = lambda doc: int(hashlib.md5(("" if doc is None else str(doc)).encode()).hexdigest()[:16], 16)
    want = Counter()
    for doc, text in rows:
        raw = (text or "").encode()
        want[doc, len(raw) + 16, zlib.crc32(raw), "key", plain_jump(key(doc), 40), plain_jump(key(doc), 41)] += 1
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    assert all(r.grown_shard in (r.shard, 40) for r in got)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_whole_tables(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    first, second = (QUERIES["op12_jump_shards"](spark, sf).collect() for _ in range(2))
    check_shards(docs, first)
    assert sorted(first, key=str) == sorted(second, key=str)


def test_shards_of_odd_rows(spark, clashing):
    rows = [r[:2] for r in ROWS] + [(1, "copy")] * 50 + [(None, f"t{k}") for k in range(80)]
    check_shards(rows, sharding.assign(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    check_shards([(r.doc_id, r.text) for r in clashing.collect()], sharding.assign(clashing).collect())
    assert sharding.assign(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        sharding.assign(clashing, 0)


def test_many_keys_are_even_and_few_move(spark):
    docs = spark.range(40_000).select("id").withColumnRenamed("id", "doc_id").selectExpr("doc_id", "cast(doc_id as string) as text")
    got = sharding.assign(docs).groupBy("shard").count().collect()
    assert len(got) == 40 and all(850 < r["count"] < 1150 for r in got)
    moved = sharding.assign(docs).filter("shard <> grown_shard").count()
    assert 0.7 * 40_000 / 41 < moved < 1.3 * 40_000 / 41


def test_written_shards(spark, tmp_path):
    docs = table(spark, ROWS)
    sharding.write_shards(docs, str(tmp_path / "out"), 5, 2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, back.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    want = {(r.doc_id, r.shard) for r in sharding.assign(docs, 5).collect()}
    assert {(r.doc_id, r.shard) for r in back.collect()} == want
    with pytest.raises(ValueError):
        sharding.write_shards(docs.withColumnRenamed("source", "shard"), str(tmp_path / "no"))


# op13


def plain_middle(doc, text):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    x = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(x[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if text == "" or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return doc, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def check_middles(rows, df):
    got = df.select("*", fim.restored(df["output"], df["form"]).alias("back")).collect()
    want = Counter(plain_middle(*r) for r in rows)
    assert Counter(tuple(r)[:-1] for r in got) == want
    assert Counter((r.doc_id, r.back) for r in got) == Counter((d, t or "") for d, t in rows)
    return {r.form for r in got}


def test_middles_of_whole_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert check_middles(rows, fim.fill_in_middle(docs)) == {"plain", "psm", "spm"}


def test_middles_of_odd_rows(spark, clashing):
    rows = [(d + 100 * k if d is not None else None, t) for k in range(30) for d, t, _ in ROWS]
    check_middles(rows, fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string")))
    check_middles([(r.doc_id, r.text) for r in clashing.collect()], fim.fill_in_middle(clashing))
    assert fim.fill_in_middle(table(spark, [])).count() == 0


def test_middles_twin(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(ORACLES["op13_fill_in_middle"])
    got = QUERIES["op13_fill_in_middle"](spark, sf).select(*want.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
