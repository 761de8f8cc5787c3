"""Joins of records by lineage: last-wins builds, bags, positions, cursors, audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnloom.operators.ranking import hash_ranked, keep_last, numbered, ranked


def last_wins_join(probe: DataFrame, build: DataFrame, keys: Sequence[str], order: Sequence[str], how: str = "inner") -> DataFrame:
    """Join to a build side that keeps the last row of each key, as overwriting a map does."""
    return probe.join(keep_last(build, keys, order), list(keys), how)


def bag_join(probe: DataFrame, build: DataFrame, keys: Sequence[str], probe_order: Sequence[str], build_order: Sequence[str]) -> DataFrame:
    """The k-th probe of a key takes the k-th last build row of it; surplus probes go.

    ``u_key`` is how many build rows were left, the taken one included.
    """
    b = numbered(build, keys, build_order, "__b", "__size").withColumn("__place", F.col("__size") - F.col("__b") + 1)
    p = numbered(probe, keys, probe_order, "__place")
    return p.join(b, [*keys, "__place"]).withColumn("u_key", F.col("__b").cast("string")).drop("__place", "__b", "__size")


def zip_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: Sequence[Column | str], right_order: Sequence[Column | str], how: str = "inner") -> DataFrame:
    """Pair rows by their place within each key; the shorter side ends it (or ``how`` says else)."""
    return numbered(left, keys, left_order, "__place").join(numbered(right, keys, right_order, "__place"), [*keys, "__place"], how).withColumnRenamed("__place", "place")


def shuffled_zip(left: DataFrame, right: DataFrame, keys: Sequence[str], left_key: str, right_key: str, seed: object) -> DataFrame:
    """``zip_join`` of both sides in their seeded orders, numbered in slices of those."""
    a, b = hash_ranked(left, keys, left_key, seed, "place"), hash_ranked(right, keys, right_key, seed, "place")
    return a.join(b, [*keys, "place"])


def cursor_join(target: DataFrame, source: DataFrame, keys: Sequence[str], target_order: Sequence[str], source_order: Sequence[str], source_value: str) -> DataFrame:
    """Each target takes the next unused source of its key; ``status`` tells why one got none."""
    counts = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    placed = zip_join(target, source, keys, target_order, source_order, "left").join(counts, list(keys), "left")
    status = F.when(F.col(source_value).isNotNull(), "paired").when(F.col("__n").isNull(), "skipped_missing").otherwise("skipped_exhausted")
    return placed.withColumn("status", status).drop("__n", "place")


def named_apart(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Repeated ids get _duplicated, then _duplicated_2 and so on, in the given order."""
    return ranked(df, [key], order, "__n").withColumn(key, F.concat(key, F.when(F.col("__n") == 1, "").when(F.col("__n") == 2, "_duplicated").otherwise(F.concat(F.lit("_duplicated_"), F.col("__n") - 1)))).drop("__n")


def indicator_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join with ``merge`` (both, left_only) and ``fanout`` (matches of the key)."""
    counted = right.withColumn("__hit", F.lit(1)).withColumn("fanout", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    joined = left.join(counted, list(keys), "left")
    return joined.withColumn("merge", F.when(F.col("__hit").isNull(), "left_only").otherwise("both")).withColumn("fanout", F.coalesce("fanout", F.lit(0)).cast("long")).drop("__hit")


def positional_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Full outer join by place: what was replaced, removed, inserted or stayed the same."""
    a = ranked(before, keys, order, "place").select(*keys, "place", F.col(value).alias("old"))
    b = ranked(after, keys, order, "place").select(*keys, "place", F.col(value).alias("new"))
    change = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "remove").when(F.col("old") == F.col("new"), "same").otherwise("replace")
    return a.join(b, [*keys, "place"], "full").withColumn("change", change)


def audit_join(sources: Sequence[tuple[str, DataFrame]], key: str, order: str) -> DataFrame:
    """Ordered union of the keys of several tables, each joined with its last row per key as a struct."""
    ids = None
    for n, (_, df) in enumerate(sources):
        part = df.select(F.col(key), F.lit(n).alias("__s"), F.col(order).alias("__o"))
        ids = part if ids is None else ids.unionByName(part)
    out = ids.groupBy(key).agg(F.min(F.struct("__s", "__o")).alias("first_seen"))
    for name, df in sources:
        last = keep_last(df, [key], [order])
        out = out.join(last.select(key, F.struct(*[c for c in df.columns if c != key]).alias(name)), key, "left")
    return out


def predecessor_counts(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """source, cap: over the edges to target plans, the sum of their counts (1 where none is given)."""
    return edges.join(targets, edges["next"] == targets["plan"]).groupBy(edges["source"]).agg(F.sum(F.coalesce(targets["wanted"], F.lit(1))).cast("long").alias("cap"))


def integrity_errors(source: DataFrame, labels: DataFrame, key: str, value: str) -> DataFrame:
    """One row per broken rule: duplicate ids, ids without a label, values that differ."""
    dup = labels.groupBy(key).count().filter("count > 1").select(key, F.lit("duplicate").alias("error"))
    missing = source.join(labels, key, "left_anti").select(key, F.lit("missing").alias("error"))
    s, l = source.select(key, F.col(value).alias("__a")), labels.select(key, F.col(value).alias("__b"))
    differs = s.join(l, key).filter(~F.col("__a").eqNullSafe(F.col("__b"))).select(key, F.lit("mismatch").alias("error")).distinct()
    return dup.unionByName(missing).unionByName(differs)


def drop_failed(records: DataFrame, verdicts: DataFrame, key: str, bad: Column) -> DataFrame:
    """The records none of whose verdicts is ``bad``; records without a verdict stay."""
    return records.join(verdicts.filter(bad).select(key).distinct(), key, "left_anti")


def matching_rows(rows: DataFrame, results: DataFrame, file: str, keys: Sequence[str], plan: str, plans: Sequence[str]) -> DataFrame:
    """Rows of the given plans that a result of the same file matches in all keys; null keys match null."""
    wanted = results.filter(F.col(plan).isin(*plans)).select(file, *keys).distinct()
    same = F.lit(True)
    for k in (file, *keys):
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return rows.filter(F.col(plan).isin(*plans)).alias("l").join(wanted.alias("r"), same, "left_semi")
