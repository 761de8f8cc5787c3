"""Dialogue histories as arrays of 'turn N: user -> device', in higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LABEL = r"(?i)^\s*turn\s+\d+\s*:\s*"


def strip_label(turn: Column) -> Column:
    return F.regexp_replace(turn, LABEL, "")


def relabel(history: Column) -> Column:
    """Number the turns from 1."""
    return F.transform(history, lambda x, i: F.concat(F.lit("turn "), (i + 1).cast("string"), F.lit(": "), strip_label(x)))


def append(history: Column, query: Column, response: Column) -> Column:
    return F.array_append(history, F.concat(F.lit("turn "), (F.size(history) + 1).cast("string"), F.lit(": "), query, F.lit(" -> "), response))


def last_k(history: Column, k: int) -> Column:
    """The last k turns; none for k below 1, all if there are fewer."""
    if k <= 0:
        return F.slice(history, 1, 0)
    return F.slice(history, F.greatest(F.size(history) - (k - 1), F.lit(1)), F.lit(k))


def splice(source: Column, target: Column, referred: Column | int) -> Column:
    """The source's first turns up to the referred one, then the target's."""
    r = F.lit(referred) if isinstance(referred, int) else referred
    return F.concat(F.slice(source, F.lit(1), r), F.slice(target, r + 1, F.greatest(F.size(target) - r, F.lit(0))))


def replace_at(history: Column, index: Column | int, turn: Column) -> Column:
    return F.transform(history, lambda x, i: F.when(i == index, turn).otherwise(x))


def insert_at(history: Column, positions: list[int], turns: list[Column]) -> Column:
    """Insert turns at 1-based places of the result, in ascending order, then renumber."""
    for place, turn in sorted(zip(positions, turns), key=lambda x: x[0]):
        history = F.array_insert(history, place, turn)
    return relabel(history)


def resize(history: Column, depth: int, template: Column) -> Column:
    """Shrink to the last ``depth`` turns, or lengthen with the template's first ones in front."""
    missing = F.greatest(F.lit(depth) - F.size(history), F.lit(0))
    return relabel(F.concat(F.slice(template, F.lit(1), missing), last_k(history, depth)))


def user_part(turn: Column) -> Column:
    return F.substring_index(strip_label(turn), " -> ", 1)


def device_part(turn: Column) -> Column:
    return F.regexp_extract(turn, r"(?s)^.*? -> (.*)$", 1)


def lineage(unique_idx: Column) -> Column:
    """(plan, id) pairs of 'PLAN-id-PLAN-id'; an odd token at the end is left out."""
    tokens = F.split(unique_idx, "-")
    return F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(tokens) / 2) - 1, F.lit(0)).cast("int")), lambda i: F.struct(F.try_element_at(tokens, i * 2 + 1).alias("plan"), F.try_element_at(tokens, i * 2 + 2).alias("id")))
