"""Token ids against the merge rule written out, and labels with them."""

import os

import pytest
import regex

from turnloom.functions import tokens
from turnloom.plans import scalars
from turnloom.registry import load

PATH = scalars.PUBLIC_VOCABULARY
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no public vocabulary here")

TEXTS = ["", "Hello  world's 123\t\n tokens", "Grüße, naïve élèves \U0001f600\U0001f600!", "<|endoftext|> aaaaaaaaaaaaaaaaaaaaaaaa", " \u00a0\u3000x", "word " * 3000]


def plainly(text, ranks):
    return [i for piece in regex.findall(tokens.PIECES, text or "") for i in tokens.merge_plainly(piece.encode(), ranks)]


def test_ids_follow_the_merge_rule(spark):
    ranks = tokens.read_ranks(PATH)
    df = spark.createDataFrame(list(enumerate([*TEXTS, None])), "k long, text string")
    got = {r.k: list(r.ids) for r in df.select("k", tokens.encoder(spark, PATH)("text").alias("ids")).collect()}
    assert got == {k: plainly(x, ranks) for k, x in enumerate([*TEXTS, None])}


def test_labels_of_all_turns(spark, sf):
    ranks = tokens.read_ranks(PATH)
    rows = {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    got = load()["sc68_token_labels"].run(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        row = rows[r.conv_id, r.turn]
        ids = plainly(f"{row.role}: {row.text}", ranks)
        start = len(plainly(f"{row.role}:", ranks))
        assert r.n_tokens == len(ids) and list(r.input_ids) == ids[:512] and list(r.labels) == [-100] * start + ids[start:512]
