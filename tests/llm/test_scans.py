"""Cost and recall of the scans of op5 and op10."""

import random
import time

import numpy as np

from turnloom.llm import decontam, licenses


def test_many_tags_take_linear_time():
    automaton = licenses.build_automaton()
    for between in ("\n", " "):
        text = f"SPDX-License-Identifier: (MIT or GPL-2.0) and Apache-2.0{between}" * 18_000
        began = time.perf_counter()
        found = licenses.scan(text, automaton)
        assert len(text) > 10**6 and time.perf_counter() - began < 5
        tags = [s for s in found["spans"] if s[2] == "tag"]
        assert len(tags) == 3 * 18_000 and {s[3] for s in tags} == {"apache", "gpl", "mit"} and found["permissive"]


def test_a_tag_needs_its_hyphens_and_an_expression():
    automaton = licenses.build_automaton()
    kinds = lambda text: [s for s in licenses.scan(text, automaton)["spans"] if s[2] == "tag"]
    assert kinds("spdx license identifier: mit") == [] and kinds("SPDX-License-Identifier:") == [] and kinds("SPDX-License-Identifier") == []
    assert kinds("é SPDX-License-Identifier MIT\nor GPL-2.0") == [(1, 3, "tag", "mit")]


def items(rng, n):
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(4000)]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(15, 160)))) for i in range(n)]


def test_blocks_meet_few_items_and_lose_none():
    rng = random.Random(5)
    index = decontam.index_items(items(rng, 2000))
    codes = np.random.default_rng(5).integers(0, 2**63, 400, dtype=np.uint64)
    met = 0
    for size, group in index.groups.items():
        window, place = decontam.block_matches(codes, group)
        near = np.bitwise_count(codes[:, None] ^ group.prints[None, :]) <= decontam.RADIUS
        assert set(zip(*(x.tolist() for x in np.nonzero(near)))) <= set(zip(window.tolist(), place.tolist()))
        met = max(met, np.bincount(window, minlength=len(codes)).max(initial=0))
        # flip RADIUS bits of each item: all are found again
        flipped = group.prints.copy()
        for bit in rng.sample(range(64), decontam.RADIUS):
            flipped ^= np.uint64(1) << np.uint64(bit)
        found = set((w, i) for w, i, _ in decontam.candidates(flipped, group))
        assert all((k, int(item)) in found for k, item in enumerate(group.items))
    assert met < 0.05 * 2000


def test_recall_of_windows_near_the_bound():
    """Windows at a weighted Jaccard similarity of 0.8 to 0.86 are found in 99 of 100 cases."""
    rng = random.Random(11)
    rows = [r for r in items(rng, 300) if len(r[1].split()) > 60]
    index = decontam.index_items(rows)
    near = found = 0
    for k, (item, text) in enumerate(rows):
        words = text.split()
        for _ in range(1 + len(words) // 80):
            at = rng.choice([rng.randrange(2), len(words) - 1, rng.randrange(len(words))])
            words[at] = "changed"
        buf = np.frombuffer((" ".join(words)).encode(), np.uint8)
        _, _, h = decontam.word_hashes(buf, decontam.Hasher(len(buf) + 1))
        bag = decontam.Counter(decontam.shingle_hashes(h, decontam.SHINGLE).tolist())
        if 0.8 <= decontam.similarity(bag, index.bags[k]) <= 0.9:
            near += 1
            got = decontam.scan_batch(buf, np.array([0, len(buf)], np.int64), index)
            found += k in got.get(0, {})
    assert near > 50 and found >= 0.99 * near


def test_text_ids_of_items(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([("a-1", "two three four five six")], "item_id string, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()] == [(1, "a-1")]


def test_a_clashing_severity_is_refused(spark):
    import pytest

    from turnloom.llm import toxicity

    docs = spark.createDataFrame([(1, "text", "x")], "doc_id long, text string, __severity string")
    with pytest.raises(ValueError):
        toxicity.with_severity(docs, toxicity.Ordinal({}, [1.0, 2.0]))
