"""Fill-in-middle: whole texts cut at token bounds and put together out of order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Of a hundred texts so many stay plain, and of the others so many begin with the suffix.
PLAIN, SUFFIX_FIRST = 10, 20
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def as_text(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le")


def token_bounds(points: np.ndarray) -> np.ndarray:
    """Where tokens begin, and the end: a run of A-Z and a-z is one token, any other code point is one too."""
    letter = ((points | 32) - 97) < 26  # unsigned, so whatever is below "a" wraps far above 26
    inside = letter[1:] & letter[:-1]
    return np.concatenate(([0], np.flatnonzero(~inside) + 1, [len(points)] if len(points) else [])).astype(np.int64)


def draws(doc_id: int | None, seed: int) -> tuple[int, ...]:
    """Four numbers from the sha256 of seed and id (null: no digits)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


def arrange(doc_id: int | None, text: str, seed: int, plain: int, suffix_first: int) -> tuple[int, str, int | None, int | None, str]:
    """Tokens, form, code points of prefix and middle, and the text put together."""
    points = code_points(text)
    bounds = token_bounds(points)
    n = len(bounds) - 1
    first, second, kind, order = draws(doc_id, seed)
    if not text or any(mark in text for mark in MARKS) or kind % 100 >= 100 - plain:
        return n, "plain", None, None, text
    start, end = (int(x) for x in bounds[np.sort(np.array([first % (n + 1), second % (n + 1)]))])
    prefix, middle, suffix = as_text(points[:start]), as_text(points[start:end]), as_text(points[end:])
    p, s, m = MARKS
    if order % 100 < suffix_first:
        return n, "spm", start, end - start, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", start, end - start, f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = 1, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars, output of every whole text.

    A text becomes an array of code points; classes of neighbours are compared,
    the bounds between tokens are where they differ, and the two drawn ranks
    among the bounds give the pieces. A null text reads as empty, an empty one
    and one that holds a mark stay plain. Draws depend on the seed and the id
    (null: no digits), so repeated rows give repeated results. Rows are
    independent of each other: nothing is shuffled, an empty table gives none,
    other columns aren't read, and a very long text takes some twelve times its
    bytes in its task while it is cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            rows = [(doc, *arrange(doc, text.as_py() or "", seed, plain, suffix_first)) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1))]
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text from an output and its form: pieces hold no mark, so the first of each one parts them."""
    p, s, m = (F.instr(output, mark) for mark in MARKS)
    wide = len(MARKS[0])
    after = lambda at, until: F.substring(output, at + wide, until - at - wide)
    prefix = F.when(form == "psm", after(p, s)).otherwise(after(p, m))
    suffix = F.when(form == "psm", after(s, m)).otherwise(after(s, p))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, after(m, F.length(output) + 1), suffix))


def digests(transformed: DataFrame) -> DataFrame:
    """The columns of ``fill_in_middle`` with digests in place of the texts."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    out, form = F.col("output"), F.col("form")
    return transformed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(out).alias("output_sha256"), sha(restored(out, form)).alias("restored_sha256"))


ORACLE = r"""
with t as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) as x from documents),
h as (select doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as u,
        list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(x, k, 8))::BIGINT) as h from t),
c as (select *, len(u)::BIGINT as n, text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h[3] % 100 >= 90 as plain from h),
p as (select *, least(h[1] % (n + 1), h[2] % (n + 1)) as a, greatest(h[1] % (n + 1), h[2] % (n + 1)) as b from c),
s as (select doc_id, n, text, case when plain then 'plain' when h[4] % 100 < 20 then 'spm' else 'psm' end as form,
        coalesce(array_to_string(u[1:a], ''), '') as pre, coalesce(array_to_string(u[a + 1:b], ''), '') as mid, coalesce(array_to_string(u[b + 1:], ''), '') as suf from p)
select doc_id, n, form, case when form <> 'plain' then length(pre)::BIGINT end as prefix_chars, case when form <> 'plain' then length(mid)::BIGINT end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(text) as restored_sha256
from s
"""
