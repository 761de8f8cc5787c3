"""Strings that differ little: an edit-distance join by segments, and rewrites that keep what they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import strings


def segments(word: Column, length: Column, k: int) -> Column:
    """The k + 1 even parts of a word of the given length, as (i, part); the last ones take what doesn't divide."""
    parts = F.sequence(F.lit(0), F.lit(k))
    return F.transform(parts, lambda i: F.struct(i.alias("i"), F.substring(word, segment_start(length, i, k) + 1, segment_size(length, i, k)).alias("part")))


def segment_size(length: Column, i: Column, k: int) -> Column:
    return F.floor(length / (k + 1)).cast("int") + F.when(i > k - F.pmod(length, F.lit(k + 1)), 1).otherwise(0)


def segment_start(length: Column, i: Column, k: int) -> Column:
    return i * F.floor(length / (k + 1)).cast("int") + F.greatest(F.lit(0), i - (k + 1 - F.pmod(length, F.lit(k + 1))))


def edit_join(words: DataFrame, word: str, k: int) -> DataFrame:
    """a, b, distance: all pairs of different words within k edits, each once, the shorter word (or else the lesser) as a.

    Of k + 1 parts of the shorter word one at least stands in the other, near
    its own place (Li, Deng, Wang and Feng, 2011). Parts of each length are
    joined with the substrings of longer words that could match them; where the
    i-th part begins is off by i edits at most before and by k - i after it. What
    meets is verified before it is shuffled. Words are taken once; null is none.
    A part that very many different words share is Spark's to split; its words
    still meet one by one.
    """
    known = words.select(F.col(word).alias("w")).filter("w is not null").distinct().withColumn("n", F.length("w"))
    parts = known.select(F.col("w").alias("a"), F.col("n").alias("size"), F.explode(segments(F.col("w"), F.col("n"), k)).alias("x")).select("a", "size", "x.i", "x.part")
    sizes = F.sequence(F.greatest(F.col("n") - k, F.lit(0)), F.col("n"))
    probes = known.select("w", "n", F.explode(sizes).alias("size")).select("*", F.explode(F.sequence(F.lit(0), F.lit(k))).alias("i"))
    start, wide, more = segment_start(F.col("size"), F.col("i"), k), segment_size(F.col("size"), F.col("i"), k), F.col("n") - F.col("size")
    before, after = F.col("i"), k - F.col("i")
    first = F.greatest(F.lit(0), start - before, start + more - after)
    last = F.least(F.col("n") - wide, start + before, start + more + after)
    placed = probes.select("w", "size", "i", wide.alias("wide"), first.alias("first"), last.alias("last")).filter("first <= last")
    substrings = F.array_distinct(F.transform(F.sequence("first", "last"), lambda at: F.substring(F.col("w"), at + 1, F.col("wide"))))
    asked = placed.select(F.col("w").alias("b"), "size", "i", F.explode(substrings).alias("part"))
    met = parts.join(asked, ["size", "i", "part"]).filter((F.col("size") < F.length("b")) | (F.col("a") < F.col("b")))
    return met.select("a", "b", F.levenshtein("a", "b", k).alias("distance")).filter("distance > 0").distinct()


#: A capital inside a sentence, which stands for names and nouns: no tagger of parts of speech is used.
INNER_CAPITAL = r"[\p{Ll},;] (\p{Lu}\p{L}+)"


def entity_sets(text: Column) -> Column:
    """(phones, uris, emails, streets, names) of a text, each sorted and without repeats."""
    found = {"phones": strings.PHONE, "uris": strings.URI, "emails": strings.EMAIL, "streets": strings.STREET}
    names = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(INNER_CAPITAL), F.lit(1)), F.lower))
    return F.struct(*(F.array_sort(strings.entities(text, p)).alias(n) for n, p in found.items()), F.array_sort(names).alias("names"))


def rewrite_match(a: Column, b: Column, most: int = 3) -> Column:
    """(close, same_entities, correct) of a rewrite: right within ``most`` edits, or if it names just what the other one does.

    Null reads as empty.
    """
    left, right = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    close, same = strings.within_edits(left, right, most), entity_sets(left) == entity_sets(right)
    return F.struct(close.alias("close"), same.alias("same_entities"), (close | same).alias("correct"))
