"""Each operator against brute force, and on nulls, empties, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from turnloom.llm import chat, decontam, licenses, lines, mixing, ogg, quality, simhash, suffix, toxicity
from turnloom.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use themselves.
CLASH = "doc_id long, text string, source string, k string, size string, fp string, component_id string, kept string, pos string, n string, score string"


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def edge_rows():
    long = " ".join(f"long{i % 977}" for i in range(30_000))
    return [
        (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \t\n ", None, "b", 3), (4, "one", "en", "a", 3), (5, long, "en", "a", len(long)),
        (6, "same text here " * 20, "en", "b", 1), (6, "same text here " * 20, "en", "b", 1), (6, "another text for the same id " * 9, "en", "b", None),
        (None, "no id at all " * 15, "en", "a", 1), (None, "no id at all " * 15, "en", "a", 1), (7, "Üñí \U0001f600 ÀÉ mixed " * 12, "fr", "c", 5), (-3, "negative id, one line\nand one line\n" * 8, "de", "c", 2),
    ]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(edge_rows(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def clashing(spark):
    return spark.createDataFrame([(i, f"some words of text number {i % 3} and more of it " * 6, "s", *["x"] * 8) for i in range(6)], CLASH)


# components


def test_components_chain_and_ties(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (200, 100), (None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41) if i in got) and set(range(2, 41)) <= got.keys()
    assert got[101] == got[200] == 100
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# op1


def slow_crc(data: bytes) -> int:
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if crc & 0x80000000 else (crc << 1) & 0xFFFFFFFF
    return crc


def test_page_crc_and_round_trip():
    rng = random.Random(1)
    for n in (0, 1, 191, 192, 254, 255, 256, 3072, 3073, 70_000, 200_001):
        data = rng.randbytes(n)
        assert ogg.page_crc(data[:500]) == slow_crc(data[:500])
        media = ogg.mux(ogg.padded(data))
        report = ogg.demux(media)
        assert ogg.unmux(report)[0] == ogg.padded(data) and not report.bad_crc and not report.lost_pages
        assert len(report.streams) == 2 and all(s.ended for s in report.streams.values())
        for s in report.streams.values():
            packets = ogg.timed_packets(s)
            assert all(a.end == b.start for a, b in zip(packets, packets[1:]))
    assert ogg.demux(ogg.mux(rng.randbytes(200_000))).continued > 0


def test_damaged_pages_are_told():
    media = bytearray(ogg.mux(random.Random(2).randbytes(150_000)))
    media[len(media) // 2] ^= 1
    report = ogg.demux(bytes(media))
    assert report.bad_crc >= 1 and report.lost_pages >= 1
    assert ogg.demux(b"").pages == 0 and ogg.demux(b"OggS").pages == 0 and ogg.demux(b"x" * 99).skipped_bytes == 99
    assert ogg.demux(bytes(media[:-5])).pages < ogg.demux(bytes(media)).pages + 1


def test_media_digests(edges, empty, clashing):
    got = ogg.media_digests(edges).collect()
    want = Counter()
    for doc, text, *_ in edge_rows():
        raw = (text or "").encode()
        payload = raw + b" " * (192 - len(raw) % 192 if len(raw) % 192 or not raw else 0)
        want[doc, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), hashlib.sha256(ogg.mux(payload)).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_sha256) for r in got) == want
    assert ogg.media_digests(empty).count() == 0 and ogg.media_digests(clashing).count() == 6
    packets = ogg.packet_table(ogg.store_texts(edges.filter("doc_id = 5"))).collect()
    assert sum(r.n_bytes for r in packets if r.packet) == len(ogg.padded(edge_rows()[4][1].encode()))


# op2


def test_snapshot_collapse(spark):
    rng = random.Random(3)
    base = [[("user", f"q{i}{j}") if j % 2 == 0 else ("assistant", f"a{i}{j}") for j in range(rng.randrange(1, 7))] for i in range(12)]
    convs = [b[: rng.randrange(1, len(b) + 1)] for b in base for _ in range(4)] + [[(None, None), ("user", "")], [("user", "x")], [("user", "x")]]
    rows = [(c, t, role, text, "e") for c, conv in enumerate(convs) for t, (role, text) in enumerate(conv)]
    rows += [(None, 0, "user", "no id", "e"), (500, None, "user", "null turn", "e"), (500, 1, "user", "tie", "e"), (500, 1, "user", "tie", "e")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rendered string")
    got = {(r.conv_id, r.n_turns, r.copies) for r in chat.collapse_snapshots(df).collect()}
    keys = {c: tuple((r or "", x or "") for r, x in conv) for c, conv in enumerate(convs)} | {None: (("user", "no id"),), 500: (("user", "null turn"), ("user", "tie"), ("user", "tie"))}
    groups = {}
    for c, k in keys.items():
        groups.setdefault(k, []).append(c)
    want = {(min((x for x in cs if x is not None), default=None), len(k), len(cs)) for k, cs in groups.items() if not any(len(o) > len(k) and o[: len(k)] == k for o in groups)}
    assert got == want
    assert chat.collapse_snapshots(df.limit(0)).count() == 0


# op3


def test_toxicity(spark, edges, empty, clashing):
    rng = random.Random(4)
    bad = ["vile", "wretch", "brute", "knave"]
    rows, marks = [], []
    for i in range(400):
        toxic = int(i % 5 == 0)
        text = words(rng, rng.randrange(5, 60)).split() + rng.choices(bad, k=rng.randrange(1, 5)) * toxic
        rng.shuffle(text)
        rows.append((i, " ".join(text), "en", "s", 0))
        marks.append((i, toxic))
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks + [(0, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.severities(docs, labels).collect()}
    held = [i for i, _ in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].toxic == int(i % 5 == 0) for i in held]) >= 0.95
    model = toxicity.train(docs, labels)
    assert model.thresholds == sorted(model.thresholds) and len(model.thresholds) == 2
    few, many = model.word_weight("vile"), sum(map(model.word_weight, bad))
    assert sum(model.reaches(many)) > sum(model.reaches(few)) > sum(model.reaches(0.0))
    assert toxicity.severities(edges, labels).count() == len(edge_rows())
    assert toxicity.severities(empty, labels).count() == 0
    kept = toxicity.drop_toxic(docs.withColumn("toxic", docs.lang), labels)
    assert kept.columns == [*docs.columns, "toxic"] and all(r.doc_id % 5 for r in kept.collect())
    assert toxicity.severities(clashing, labels.filter("false")).filter("toxic = 1").count() == 0


def test_cumulative_link_gradient_direction():
    bags = [{"a"}, {"a", "b"}, {"b"}, {"c"}] * 10
    grades = np.array([1, 2, 1, 0] * 10)
    model = toxicity.fit(bags, grades, {"a": 9.0, "b": 9.0, "c": -9.0})
    expected = [sum(model.reaches(sum(map(model.word_weight, bag)))) for bag in ({"c"}, {"a"}, {"a", "b"})]
    assert expected == sorted(expected) and expected[2] > 1.5 > expected[0] + 1


# op4


def test_mix_targets_and_bounds(spark, edges, empty):
    rng = random.Random(5)
    rows = [(i, words(rng, rng.randrange(0, 300)), "en", rng.choice(["a", "a", "a", "b", "c", None]), 0) for i in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    total = sum(len(r[1].split()) for r in rows)
    by = {}
    for r in got:
        assert r.taken in (0, r["size"], 2 * r["size"])
        x = by.setdefault((r.source_size, r.target), [0, 0])
        x[0] += r.taken
        x[1] = max(x[1], r["size"])
    assert abs(sum(t for _, t in by) - 1.5 * total) < 1e-6
    assert all(abs(taken - target) <= most / 2 + 1e-9 for (_, target), (taken, most) in by.items())
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(spark.createDataFrame(rows[::-1], DOCS)).collect()))
    assert mixing.mix(edges).count() == len(edge_rows()) and mixing.mix(empty).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, None, None, None, None)], DOCS)).first().taken == 0


def test_mix_matches_its_sql(spark, edges):
    duckdb = pytest.importorskip("duckdb")
    documents = edges.toPandas().astype({"doc_id": "Int64"})  # noqa: F841  read by the SQL
    want = duckdb.sql(mixing.ORACLE).fetchall()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, mixing.mix(edges).collect()), key=key) == sorted(want, key=key)


# op5


def test_license_scan(spark, edges, empty, clashing):
    texts = [None, "", "The MIT License, the mit-license!", "Apache LICENSE\nGNU General Public License", "limit license mit licenses", "// SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND Apache-2.0", "SPDX-License-Identifier: MIT AND", "é mit license é" * 3]
    rows = licenses.scan_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    import re

    for r, text in zip(sorted(rows, key=lambda r: r.doc_id), texts):
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(own)) if own[i : i + len(phrase.split())] == phrase.split()]
        at = [p for p, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(own), len(places), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    tagged = sorted(rows, key=lambda r: r.doc_id)
    assert tagged[5].labels == "apache,gpl,mit" and tagged[5].permissive and tagged[6].labels == "mit"
    assert licenses.scan_documents(edges).count() == len(edge_rows()) and licenses.scan_documents(empty).count() == 0 and licenses.scan_documents(clashing).count() == 6


def test_expressions():
    def both(line):
        return licenses.evaluate(licenses.to_postfix(licenses.expression_tokens(line)))

    assert licenses.to_postfix("MIT or GPL-2.0 and Apache-2.0 with X".split()) == ["MIT", "GPL-2.0", "Apache-2.0", "X", "with", "and", "or"]
    assert both("MIT OR GPL-3.0") == (frozenset({"mit", "gpl"}), True)
    assert both("MIT AND GPL-3.0") == (frozenset({"mit", "gpl"}), False)
    assert both("(MIT OR GPL-3.0) AND (BSD-3-Clause OR LGPL-2.1+)")[1] and not both("( MIT")[0] and not both("OR MIT")[0]


# op6


def test_attention_gradient():
    rng = np.random.default_rng(6)
    x, first, y = rng.standard_normal((9, 7)), np.array([0, 2, 5]), np.array([1.0, 0.0, 1.0])
    p = {"A": rng.standard_normal((7, 4)), "a": rng.standard_normal(4), "V": rng.standard_normal((4, 3)), "U": rng.standard_normal((4, 3)), "w": rng.standard_normal(3), "c": rng.standard_normal(4), "d": np.array(0.3)}
    net = quality.Attention(np.zeros(7), np.ones(7), p)

    def loss():
        s = net.forward(x, first)["score"]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for name, g in net.gradient(x, first, y).items():
        flat, own = np.atleast_1d(p[name]).reshape(-1), np.atleast_1d(g).reshape(-1)
        for i in range(0, len(flat), max(1, len(flat) // 3)):
            old = p[name].copy()
            steps = []
            for e in (1e-5, -1e-5):
                new = old.copy().reshape(-1)
                new[i] += e
                p[name] = new.reshape(old.shape)
                steps.append(loss())
            p[name] = old
            assert abs((steps[0] - steps[1]) / 2e-5 - own[i]) < 1e-6
    f = net.forward(x, first)
    assert np.allclose(np.add.reduceat(f["attention"], first), 1)


def test_quality(spark, edges, empty):
    rng = random.Random(7)
    good = lambda: ". ".join(words(rng, 12).capitalize() for _ in range(rng.randrange(1, 30)))
    junk = lambda: " ".join(rng.choice(["$$$", "|||", "BUY!!", "###"]) + "x" for _ in range(rng.randrange(10, 200)))
    rows = [(i, good() if i % 4 else junk(), "en", "s", 0) for i in range(500)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(500)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, DOCS)
    got = quality.quality_scores(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert np.mean([r.predicted == int(r.doc_id % 4 > 0) for r in got if r.held_out]) > 0.95
    model = quality.train(docs, labels)
    scored = quality.score_documents(edges, model).collect()
    assert len(scored) == len(edge_rows()) and all(0 <= r.score <= 1 for r in scored)
    assert len({r.score for r in scored if r.doc_id in (1, 2)}) == 1
    assert quality.score_documents(empty, model).count() == 0
    assert quality.quality_scores(edges, labels.filter("false")).count() == len(edge_rows())


# op7


def slow_fingerprint(text, n=3):
    import xxhash

    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark, edges, empty, clashing):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        text = words(rng, 150).split()
        for _ in range(rng.randrange(1, 6)):
            copy = list(text)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = "Edit"
            rows.append((len(rows), " ".join(copy), "en", "s", 0))
    rows += [(len(rows) + i, x, None, None, None) for i, x in enumerate([None, "", "a", "a b", "A B"])]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    fps = {r[0]: slow_fingerprint(r[1]) for r in rows}
    parent = {i: i for i in fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in fps:
        for j in fps:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{fps[i]:016x}", find(i)) for i in fps}
    assert simhash.near_duplicates(edges).count() == len(edge_rows()) and simhash.near_duplicates(empty).count() == 0
    kept = simhash.drop_near_duplicates(clashing, 3)
    assert kept.columns == clashing.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2]
    assert simhash.drop_near_duplicates(edges).count() < len(edge_rows())


def test_bk_tree_and_schemes():
    rng = random.Random(9)
    values = list({rng.getrandbits(64) ^ (1 << rng.randrange(64)) for _ in range(300)} | {rng.getrandbits(12) for _ in range(200)})
    for probe in values[:20]:
        tree = simhash.BKTree(values)
        assert sorted(values[i] for i in tree.take(probe, 3)) == sorted(v for v in values if (v ^ probe).bit_count() <= 3)
        assert tree.take(probe, 3) == []
    assert simhash.scheme_for(1000, 3) == (4, 1) and simhash.scheme_for(10**9, 3)[1] > 1


@pytest.mark.parametrize("n", [10, 10**8, 10**11])
def test_every_scheme_finds_all_links(spark, n):
    rng = random.Random(10)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = {b ^ sum(1 << p for p in rng.sample(range(64), rng.randrange(0, 4))) for b in base for _ in range(5)}
    nodes = spark.createDataFrame([(v - 2**64 if v >> 63 else v,) for v in values], "fp long")
    links = {(r.u % 2**64, r.v % 2**64) for r in simhash.shard_forests(simhash.shard_rows(nodes, 3, n), 3).collect()}
    assert all((u ^ v).bit_count() <= 3 for u, v in links)
    group = {v: {v} for v in values}
    for u, v in links:
        joined = group[u] | group[v]
        for x in joined:
            group[x] = joined
    assert all(b in group[a] for a in values for b in values if (a ^ b).bit_count() <= 3)


# op8


def slow_repeats(rows):
    seen, out = set(), []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((doc, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("large", [suffix.LARGE, 2, 0])
def test_suffix_repeats(spark, monkeypatch, large):
    monkeypatch.setattr(suffix, "LARGE", large)
    rng = random.Random(11)
    shared = [words(rng, rng.randrange(15, 60)) for _ in range(8)]
    rows = []
    for i in range(80):
        parts = [words(rng, rng.randrange(1, 40)) for _ in range(3)] + rng.sample(shared, rng.randrange(0, 3))
        rng.shuffle(parts)
        rows.append((i, " ".join(parts)))
    rows += [(100, "ab" * 300), (101, "a" * 250), (102, None), (103, ""), (104, "é" * 130), (105, "x" * 99), (106, "a" * 250)]
    got = Counter(map(tuple, suffix.repeat_digests(spark.createDataFrame(rows[::-1], "doc_id long, text string")).collect()))
    assert got == slow_repeats(rows)


def test_suffix_edges(spark, edges, empty, clashing):
    rows = sorted(((r[0], r[1]) for r in edge_rows()), key=lambda r: (r[0] is not None, r[0] or 0))
    got = suffix.repeat_digests(edges)
    assert sum(r.n_removed for r in got.collect()) == sum(k[2] * n for k, n in slow_repeats(rows).items())
    assert suffix.repeat_digests(empty).count() == 0
    texts = [(r.doc_id, r.text) for r in clashing.orderBy("doc_id").collect()]
    assert Counter(map(tuple, suffix.repeat_digests(clashing).collect())) == slow_repeats(texts)


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK", 1000)
    rng = random.Random(12)
    text = words(rng, 900)
    rows = [(1, text), (2, words(rng, 30) + " " + text[500:4000] + " " + words(rng, 300))]
    assert Counter(map(tuple, suffix.repeat_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == slow_repeats(rows)


def test_longest_previous_factor():
    for text in ("abaababaabaab", "aaaa", "abcabcabc", "x", "mississippi"):
        n = len(text)
        order = sorted(range(n), key=lambda i: text[i:])
        common = lambda i, j: next((k for k in range(n) if max(i, j) + k >= n or text[i + k] != text[j + k]), n)
        lcp = [common(a, b) for a, b in zip(order, order[1:])]
        want = [max((common(i, j) for j in range(i)), default=0) for i in range(n)]
        assert suffix.longest_previous_factor(order, lcp) == want


# op9


def slow_lines(rows):
    """Places of lines that repeat an earlier one, by all pairs."""
    def grams(s):
        return {s[i : i + lines.SHINGLE] for i in range(max(1, len(s) - lines.SHINGLE + 1))}

    places = [((d, p), x.lower().strip(" \t\r")) for d, text in rows for p, x in enumerate((text or "").split("\n")) if x.strip(" \t\r")]
    parent = list(range(len(places)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [grams(s) for _, s in places]
    for i in range(len(places)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= lines.LEAST * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {places[i][0] for i in range(len(places)) if find(i) != i}


def test_fuzzy_lines(spark):
    rng = random.Random(13)
    base = [words(rng, rng.randrange(4, 90), 3000) for _ in range(40)]
    rows = []
    for i in range(60):
        own = []
        for _ in range(rng.randrange(1, 5)):
            line = rng.choice(base)
            if rng.random() < 0.5:
                line = line + " end"
            own.append(line.upper() if rng.random() < 0.2 else line)
        rows.append((i, "\n".join([*own, "", words(rng, 5, 10**6), "short", "ha ha " * rng.randrange(9, 200)])))
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    gone = slow_lines(rows)
    for r in got:
        was = dict(rows)[r.doc_id].split("\n")
        assert r.n_lines == len(was) and r.text == "\n".join(x for p, x in enumerate(was) if (r.doc_id, p) not in gone), r.doc_id
        assert r.n_removed == sum(d == r.doc_id for d, _ in gone)


def test_line_edges(spark, edges, empty, clashing):
    got = lines.dedup_lines(edges)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "text", "n_lines", "n_removed"]
    by = got.collect()
    assert len(by) == len(edge_rows())
    assert [r.text for r in by if r.doc_id == 1] == [None] and [r.text for r in by if r.doc_id == 2] == [""] and [r.text for r in by if r.doc_id == 3] == [" \t\n "]
    assert sum(r.n_removed for r in by if r.doc_id == 6) == 1 and [r.n_removed for r in by if r.doc_id == -3] == [14]
    assert lines.dedup_lines(empty).count() == 0
    assert sum(r.n_removed for r in lines.dedup_lines(clashing).collect()) >= 3


# op10


def slow_leaks(rows, items):
    def grams(w):
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    out = set()
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        for item, x in items:
            v = (x or "").encode().lower().split()
            for p in range(len(w) - len(v) + 1 if v else 0):
                a, b = grams(w[p : p + len(v)]), grams(v)
                if (a & b).total() >= 0.8 * ((a | b).total()):
                    out.add((doc, item))
                    break
    return out


def test_leaks(spark, edges, empty, clashing, monkeypatch):
    rng = random.Random(14)
    items = [(i, words(rng, rng.randrange(14, 60))) for i in range(25)] + [(90, "three short words"), (91, None), (92, ""), (93, "Ünï cödé words are in this one too")]
    rows = []
    for i in range(60):
        text = words(rng, rng.randrange(0, 400)).split()
        if i % 3 == 0:
            item = rng.choice(items[:25] + items[-1:] + [items[25]])[1].split()
            if i % 2 and len(item) > 50:
                item[rng.randrange(3)] = "changed"
            at = rng.randrange(len(text) + 1)
            text[at:at] = [x.upper() if x.isascii() else x for x in item]
        rows.append((i, (" " if i % 2 else "\n").join(text)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = slow_leaks(rows, items)
    got = decontam.leaks(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and all(0.8 <= r.similarity <= 1 and r.distance <= 18 for r in got)
    monkeypatch.setattr(decontam, "SLICE", 2000)
    monkeypatch.setattr(decontam, "CHUNK", 600)
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, benchmark).collect()} == want
    assert decontam.drop_leaks(docs, benchmark).count() == len(rows) - len({d for d, _ in want})
    assert decontam.drop_leaks(edges, benchmark).count() == len(edge_rows()) and decontam.leaks(empty, benchmark).count() == 0
    assert decontam.drop_leaks(clashing, benchmark.limit(0)).columns == clashing.columns


def test_blocks_find_all_within_radius():
    rng = random.Random(15)
    items = decontam.index_items([(str(i), words(rng, 30)) for i in range(80)])
    for k in range(60):
        code = int(items.prints[k]) ^ sum(1 << p for p in rng.sample(range(64), rng.randrange(0, 30)))
        want = [i for i, x in enumerate(items.prints.tolist()) if (x ^ code).bit_count() <= decontam.RADIUS]
        assert [i for _, i, _ in decontam.candidates(np.array([code], np.uint64), items.groups[30])] == want
