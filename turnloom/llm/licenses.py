"""License scans: Aho-Corasick over words, a shunting-yard evaluator for expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases of the base scan and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notice phrases of well-known licenses, in words, and their labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the mit": "mit",
    "released under the mit": "mit",
    "licensed under the apache": "apache",
    "apache software license": "apache",
    "www apache org licenses license 2 0": "apache",
    "gnu general public license": "gpl",
    "free software foundation either version": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "permission to use copy modify and or distribute this software": "isc",
    "mozilla public license": "mpl",
    "creative commons attribution": "cc-by",
    "licensed under cc by": "cc-by",
    "all rights reserved": "proprietary",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
TAG = "spdx license identifier"
#: Identifiers of tags start with one of these and then end or go on with - or a digit.
FAMILIES = ("agpl", "apache", "bsd", "cc-by", "cc0", "gpl", "isc", "lgpl", "mit", "mpl", "unlicense", "zlib")
PERMISSIVE = frozenset({"apache", "bsd", "cc0", "isc", "mit", "unlicense", "zlib"})

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: What may follow a tag, on its line.
TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+-]*)")
COLON = re.compile(r"[ \t]*:?")
RANK = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> str:
    name = identifier.lower().rstrip("+")
    best = max((f for f in FAMILIES if name == f or re.match(re.escape(f) + r"[-0-9]", name)), key=len, default=None)
    return best or name


def expression_tokens(line: str, at: int = 0) -> list[str]:
    """The longest run from place ``at`` of a line that can be an expression: operand and operator in turn."""
    tokens: list[str] = []
    depth, operand_due = 0, True
    good = 0
    while m := TOKEN.match(line, at):
        token = m[1]
        low = token.lower()
        if token == "(":
            if not operand_due:
                break
            depth += 1
        elif token == ")":
            if operand_due or not depth:
                break
            depth -= 1
        elif low in RANK:
            if operand_due:
                break
            operand_due = True
        else:
            if not operand_due:
                break
            operand_due = False
        tokens.append(low if low in RANK else token)
        at = m.end()
        if not operand_due and not depth:
            good = len(tokens)
    return tokens[:good]


def to_postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: ``with`` binds closest, then ``and``, then ``or``; all to the left."""
    out: list[str] = []
    stack: list[str] = []
    for token in tokens:
        if token == "(":
            stack.append(token)
        elif token == ")":
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif token in RANK:
            while stack and stack[-1] != "(" and RANK[stack[-1]] >= RANK[token]:
                out.append(stack.pop())
            stack.append(token)
        else:
            out.append(token)
    return out + stack[::-1]


def evaluate(postfix: list[str]) -> tuple[frozenset[str], bool]:
    """Families named, and whether the terms can be met under permissive licenses only.

    ``or`` leaves a choice, ``and`` asks for both, ``with`` keeps what its license
    says: an exception adds no license.
    """
    stack: list[tuple[frozenset[str], bool]] = []
    for token in postfix:
        if token not in RANK:
            name = family(token)
            stack.append((frozenset([name]), name in PERMISSIVE))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            stack.append(left)
        else:
            free = (left[1] or right[1]) if token == "or" else (left[1] and right[1])
            stack.append((left[0] | right[0], free))
    return stack[0] if stack else (frozenset(), False)


def build_automaton() -> ahocorasick.Automaton:
    """All phrases, each between blanks, so that only whole words match."""
    automaton = ahocorasick.Automaton()
    kinds: dict[str, list] = {}
    for phrase, label in BASE.items():
        kinds.setdefault(phrase, []).append(("base", label))
    for phrase, label in NOTICES.items():
        kinds.setdefault(phrase, []).append(("notice", label))
    kinds.setdefault(TAG, []).append(("tag", ""))
    for phrase, found in kinds.items():
        automaton.add_word(f" {phrase} ", (phrase, phrase.count(" ") + 1, tuple(found)))
    automaton.make_automaton()
    return automaton


def scan(text: str | None, automaton: ahocorasick.Automaton) -> dict:
    """All of one text's findings; spans are (word, n_words, kind, label).

    The automaton gives the word at which a tag stands, and one pass over the
    words its bytes, so that time grows with the text's length, however many
    tags it has.
    """
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    words = WORD.findall(raw)
    joined = b" " + b" ".join(words) + b" "
    line = joined.decode("latin-1")
    spans, free, tags = [], [], []
    hits = sorted((end - len(phrase) - 1, n, kinds) for end, (phrase, n, kinds) in automaton.iter(line))
    place, at = 0, 0
    for start, n, kinds in hits:
        place, at = place + line.count(" ", at, start), start
        spans += [(place, n, kind, label) for kind, label in kinds if kind != "tag"]
        tags += [place for kind, _ in kinds if kind == "tag"]
    if tags:
        bounds = [m.span() for m in WORD.finditer(raw)]
        shown = raw.decode("latin-1")
        for first in tags:
            start, end = bounds[first][0], bounds[first + 2][1]
            if shown[start:end] != TAG.replace(" ", "-"):
                continue
            found, permissive = evaluate(to_postfix(expression_tokens(shown, COLON.match(shown, end).end())))
            spans += [(first, 3, "tag", label) for label in sorted(found)]
            if found:
                free.append(permissive)
    return {"n_words": len(words), "spans": sorted(spans), "permissive": all(free) if free else None}


def score(spans: list) -> float:
    """How sure it is that the text carries a license: each kind of finding halves the doubt or better."""
    doubt = 1.0
    kinds = {kind for _, _, kind, _ in spans}
    for kind, left in (("tag", 0.05), ("notice", 0.4), ("base", 0.5)):
        if kind in kinds:
            doubt *= left
    return round(1.0 - doubt, 6)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean, spans array<struct<word:long,n_words:int,kind:string,label:string>>"


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row per document with all spans found in its whole text.

    A null text reads as empty: no words, no spans, empty labels, score 0. A very
    long text takes time and memory in proportion to its length.
    Repeated rows give repeated results, an empty table none; only doc_id and
    text are read. Phrases overlap freely and every place counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build_automaton()
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "permissive", "spans"]
        span = pa.list_(pa.struct([("word", pa.int64()), ("n_words", pa.int32()), ("kind", pa.string()), ("label", pa.string())]))
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.bool_(), span]
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = scan(text.as_py(), automaton)
                spans = found["spans"]
                base = [s for s in spans if s[2] == "base"]
                rows.append((
                    doc, found["n_words"], len(base), base[0][0] if base else None, base[-1][0] if base else None,
                    ",".join(sorted({s[3] for s in base})), ",".join(sorted({s[3] for s in spans})),
                    score(spans), found["permissive"],
                    [dict(zip(("word", "n_words", "kind", "label"), s)) for s in spans],
                ))
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
