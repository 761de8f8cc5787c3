"""The pipeline against brute force, stage by stage, on a table with nulls, repeats, ties and planted cases."""

import random

import duckdb
import pytest

import corpus_pipeline
from tests.llm.test_operators import slow_leaks, slow_lines
from turnloom.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n, letters="abcdefghijklmnop"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(3, 8))) for _ in range(n))


def corpus():
    """(documents, labels, benchmark): toxic words mark documents with odd labels, copies and leaks are planted."""
    rng = random.Random(31)
    texts = []
    for i in range(150):
        text = "\n".join(sentence(rng, rng.randrange(12, 30)) for _ in range(rng.randrange(1, 5)))
        texts.append(text + (" vilefool hatescum" if i % 5 == 0 else ""))
    bench = [(k, sentence(rng, 25)) for k in range(4)]
    base = [sentence(rng, 40) for _ in range(6)]
    texts += base + base[:3]  # exact copies
    texts += [x + " " + sentence(rng, 2) for x in base[3:5]]  # near copies
    texts += [sentence(rng, 10) + " " + bench[0][1] + " " + sentence(rng, 9), bench[1][1]]
    texts += [texts[1].split("\n")[0] + "\n" + sentence(rng, 20), "", "  ", None, None, "short"]
    docs = [(None if i == 7 else i, t, rng.choice(["en", None]), rng.choice(["s1", "s2", None]), len(t or "")) for i, t in enumerate(texts)]
    docs += [docs[20], docs[21]]  # repeated rows
    labels = [(i, 1, int(i % 5 == 0)) for i in range(150)]
    return docs, labels, bench


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    docs, labels, bench = corpus()
    frames = {"documents": (docs, SCHEMA), "labels": (labels, "doc_id long, quality long, toxic long"), "benchmark": (bench, "item_id long, text string")}
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    out, now = [], spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = now.collect()
        stage(spark, now, str(folder)).write.parquet(f"{folder}/out{k}")
        now = spark.read.parquet(f"{folder}/out{k}")
        out.append((name, before, now.collect()))
    return str(folder), bench, out


def key(r):
    return (r.doc_id is not None, r.doc_id or 0, r.text or "", r.source or "")


def words(text):
    return (text or "").lower().split()


def test_toxic_documents_go(stages):
    _, before, after = stages[2][0]
    want = [r for r in before if "vilefool" not in (r.text or "")]
    assert sorted(map(key, after)) == sorted(map(key, want)) and len(want) < len(before)


def numbered(rows):
    """Rows in the order of the row key: null ids first, equal ids apart."""
    return [(i, r) for i, r in enumerate(sorted(rows, key=key))]


def test_lines_are_the_brute_force_ones(stages):
    _, before, after = stages[2][1]
    rows = numbered(before)
    gone = slow_lines([(i, r.text) for i, r in rows])
    texts = {i: None if r.text is None else "\n".join(x for p, x in enumerate(r.text.split("\n")) if (i, p) not in gone) for i, r in rows}
    # rows that share an id are interchangeable: compare ids with texts
    want = sorted(((r.doc_id is not None, r.doc_id or 0), texts[i] or "") for i, r in rows)
    assert gone and sorted(((r.doc_id is not None, r.doc_id or 0), r.text or "") for r in after) == want
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after)


def test_near_copies_are_the_brute_force_ones(stages):
    _, before, after = stages[2][2]
    rows = numbered(before)
    sets = []
    for _, r in rows:
        w = words(r.text)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()})
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    want = [r for i, r in rows if find(i) == i]
    assert len(want) < len(rows) and sorted((r.doc_id or -1, len(words(r.text))) for r in after) == sorted((r.doc_id or -1, len(words(r.text))) for r in want)


def test_leaks_are_the_brute_force_ones(stages):
    folder, bench, out = stages
    _, before, after = out[3]
    rows = numbered(before)
    found = {m[0] for m in slow_leaks([(i, r.text) for i, r in rows], bench)}
    want = [r for i, r in rows if i not in found]
    assert found and sorted(map(key, after)) == sorted(map(key, want))


def test_mixing_is_the_sql(stages):
    folder, _, out = stages
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{folder}/out3/*.parquet'")
    want = con.sql(mixing.ORACLE)
    names = [d for d in want.columns]
    got = [tuple(r[c] for c in names) for r in out[4][2]]
    text = lambda rows: sorted(repr([round(x, 6) if isinstance(x, float) else x for x in r]) for r in rows)
    assert text(got) == text(want.fetchall()) and len(got) == len(out[3][2])


def test_run_gives_the_last_stage(stages, spark):
    folder, _, out = stages
    assert sorted(map(repr, corpus_pipeline.run(spark, folder).collect())) == sorted(map(repr, out[4][2]))


def test_stages_keep_the_columns_and_take_empty_tables(stages, spark, tmp_path):
    folder, _, out = stages
    clash = "n_lines n_removed severity grade bucket root k tok size target".split()
    wide = spark.createDataFrame([(i, f"some words of text number {i % 2} and more", "en", "s", 9, *["x"] * len(clash)) for i in range(4)], SCHEMA + "".join(f", {c} string" for c in clash))
    none = wide.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, folder).count() == 0, name
        now = stage(spark, wide, folder)
        assert set(now.columns) == set(wide.columns), name
        now.count()
    assert corpus_pipeline.STAGES[-1][1](spark, none, folder).count() == 0
