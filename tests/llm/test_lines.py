"""Recall of fuzzy line dedup against brute force."""

import random

from tests.llm.test_operators import slow_lines
from turnloom.llm import components, lines
from turnloom.llm.components import cross_pairs


def removed(spark, rows):
    return sum(r.n_removed for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_blocks_make_all_pairs_across_roots(spark, monkeypatch):
    monkeypatch.setattr("turnloom.llm.components.BLOCK", 7)
    rows = [(b, k, k % 5) for b in (1, 2) for k in range(b * 3, 60)]
    got = {tuple(r) for r in cross_pairs(spark.createDataFrame(rows, "bucket long, k long, root long")).collect()}
    assert got == {(u, v) for u in range(3, 60) for v in range(u + 1, 60) if u % 5 != v % 5}


def test_pairs_of_buckets_with_many_components_are_found(spark):
    rng = random.Random(17)
    letters = "abcdefghijklmnopqrstuvwxyz "
    passage = "".join(rng.choice(letters) for _ in range(130))
    rows = []
    for i in range(250):
        line = passage + "".join(rng.choice(letters) for _ in range(119)) + "z"
        rows += [(2 * i, line), (2 * i + 1, line + "".join(rng.choice(letters) for _ in range(57)) + "z")]
    want = slow_lines(rows)
    assert len(want) == 250
    assert removed(spark, rows) >= 0.99 * len(want)


def test_short_lines_with_one_changed_character_are_copies(spark):
    rng = random.Random(23)
    rows = []
    for i in range(120):
        line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.randrange(52, 97))) + "z"
        at = rng.randrange(5, 45)
        rows += [(2 * i, line), (2 * i + 1, line[:at] + "#" + line[at + 1 :])]
    assert removed(spark, rows) >= 119


def test_buckets_of_two_unlike_lines_are_left_out(spark):
    """Two lines meet in band 0; whether they stay is told by their sketches. Three lines of a bucket stay whatever these are."""
    bands = len(lines.band_values())
    rows = [(1, 0, 7), (2, (1 << 20) - 1, 7), (3, 0, 8), (4, (1 << 21) - 1, 8), (5, 0, 9), (6, -1, 9), (7, 5, 9), (8, 0, 10)]
    marked = spark.createDataFrame([(k, x, b, *(1000 * k + j for j in range(1, bands))) for k, x, b in rows], ", ".join(["k long", "x long", *(f"b{j} long" for j in range(bands))]))
    full, _ = lines.line_buckets(marked)
    assert sorted(map(tuple, full.collect())) == [(7, 1), (7, 2), (9, 5), (9, 6), (9, 7)]


def test_sketches_of_similar_lines_are_near(spark):
    rng = random.Random(29)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300)) + "z"
    rows = [(0, text), (1, text[:100] + "#" + text[101:]), (2, "".join(rng.sample(text, len(text))) + "z")]
    x = [r.x for r in lines.line_bands(lines.with_row_key(spark.createDataFrame(rows, "doc_id long, text string"))).orderBy(lines.DOC_KEY).collect()]
    far = [((x[0] ^ y) % 2**64).bit_count() for y in x[1:]]
    assert far[0] <= lines.FAR < far[1]


def test_bucket_rows_are_shuffled_once(spark, monkeypatch):
    """Counts and rows of buckets are read from one shuffle, also where no join broadcasts."""
    made = []
    monkeypatch.setattr(lines, "materialize", lambda df, name: made.append(df) or df)
    bands = len(lines.band_values())
    marked = spark.createDataFrame([(k, 0, *(100 * b + k % 40 for b in range(bands))) for k in range(80)], ", ".join(["k long", "x long", *(f"b{j} long" for j in range(bands))]))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines.line_buckets(marked)
        assert made[0].count() == 80 * lines.BANDS_AT_ONCE
        made[0].collect()
        plan = made[0]._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") == 1, plan


def test_small_rounds_of_components_make_no_shuffle(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(components, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df.checkpoint())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = spark.range(60).selectExpr("id + 1 as u", "id as v")
        assert {tuple(r) for r in components.connected_components(edges).collect()} == {(k, 0) for k in range(1, 61)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) > 1 and not any("Exchange hashpartitioning" in p for p in plans[1:]), plans[1]


def test_pairs_that_share_several_buckets_and_blocks_are_linked(spark, monkeypatch):
    """Two similar lines of any two blocks are linked, once, and unlike ones or those of far sketches are not."""
    monkeypatch.setattr(lines, "BLOCK_LINES", 3)
    rng = random.Random(31)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(120)) + "z" for _ in range(10)]
    texts = [t for text in texts for t in (text, text[:60] + "#" + text[61:])]
    members = spark.createDataFrame([(b, k, k, 2, 0 if k < 18 else -(k % 2), len(t)) for b in (1, 2) for k, t in enumerate(texts)], "bucket long, k long, root long, w long, x long, chars int")
    got = lines.cross_links(members, spark.createDataFrame(list(enumerate(texts)), "k long, line string")).collect()
    assert sorted(map(tuple, got)) == [(k, k + 1) for k in range(0, 18, 2)]
