"""Order-dependent operators as windows: keep-first, head-n, quotas, budgets, chunks, deltas.

Every function takes its order explicitly and should be given a total one; nulls
in ordering columns sort as the column expressions say.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

_RN = "__rn"


def hash_order(seed: object, *keys: Column | str) -> Column:
    """The seeded pseudo-random order: md5 of seed and natural key, equal on any engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys)))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = _RN) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def head_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first n rows of each group; Spark limits groups before the shuffle."""
    return ranked(df, keys, order).filter(F.col(_RN) <= n).drop(_RN)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    return head_n(df, keys, order, 1)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """What overwriting a dictionary leaves: the last row of each key."""
    return head_n(df, keys, [F.col(o).desc() if isinstance(o, str) else o for o in order], 1)


def keep_first_exempt(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], exempt: Column) -> DataFrame:
    """Keep-first, with exempt rows and rows with a null key kept as they are."""
    free = F.coalesce(exempt, F.lit(False))
    for k in keys:
        free = free | F.col(k).isNull()
    marked = df.withColumn("__free", free)
    unique = keep_first(marked.filter(~F.col("__free")), keys, order)
    return unique.unionByName(marked.filter("__free")).drop("__free")


def top_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    return head_n(df, keys, order, 1)


def chunks(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, value: str) -> DataFrame:
    """Groups cut into runs of n rows: keys, chunk (from 0), values in order."""
    rows = numbered(df, keys, order, _RN).withColumn("chunk", F.floor((F.col(_RN) - 1) / n).cast("long"))
    gathered = rows.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(F.struct(_RN, F.col(value).alias("v")))).alias("rows"))
    return gathered.select(*keys, "chunk", F.transform("rows", lambda r: r["v"]).alias("values"))


def quota_ladder(count: Column) -> Column:
    """Share of a plan that is kept, by its size, at least one row."""
    ratio = F.when(count > 800, 0.04).when(count > 500, 0.05).when(count > 250, 0.1).when(count > 150, 0.2).when(count > 100, 0.1)
    return ratio


def budgeted(df: DataFrame, plan: str, first: str, amount: str, budget: int) -> DataFrame:
    """Zero the amount of groups once the amounts before them in their plan exceed the budget; ``first`` is a number that tells groups apart.

    Sums before a group are made from ranges of ``first``, so a plan isn't one task.
    """
    dealt = with_ranges(df, first)
    starts, same = slice_starts(dealt, [plan], F.sum(amount))
    before = Window.partitionBy(plan, "__slice").orderBy(first).rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.withColumn("__within", F.coalesce(F.sum(amount).over(before), F.lit(0)))
    spent = F.col("__within") + F.col("__before")
    return within.join(starts, same).withColumn("quota", F.when(spent > budget, F.lit(0)).otherwise(F.col(amount)).cast("long")).select(*df.columns, "quota")


def consume_quota(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], quotas: DataFrame) -> DataFrame:
    """Flag the first ``quota`` rows of each key as kept; keys without a quota pass whole."""
    return numbered(df, keys, order, _RN).join(quotas.select(*keys, "quota"), list(keys), "left").withColumn("kept", F.col("quota").isNull() | (F.col(_RN) <= F.col("quota"))).drop(_RN, "quota")


def lag_delta(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("delta", F.col(value) - F.lag(value).over(w))


def round_robin(df: DataFrame, queue: str, order: Sequence[Column | str], n: int) -> DataFrame:
    """Take one of each queue in turn until n rows are chosen: order (turn, queue)."""
    return ranked(df, [queue], order).orderBy(_RN, queue).limit(n).drop(_RN)


def round_robin_reuse(df: DataFrame, queue: str, key: str, n: int, seed: object) -> DataFrame:
    """``round_robin`` over queues that start again, shuffled anew, once they are used up: exactly n rows of any table with rows.

    Every queue with rows gives one row a turn, so the turns are known before and
    a queue of k rows is repeated only turns / k times. Adds ``turn`` (from 1).
    """
    sizes = df.groupBy(queue).agg(F.count(F.lit(1)).alias("__k"))
    turns = sizes.select("*", F.ceil(F.lit(n) / F.count(F.lit(1)).over(Window.partitionBy())).alias("__turns"))
    passes = turns.withColumn("__pass", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("__turns") / F.col("__k")).cast("long") - 1)))
    dealt = df.join(passes.withColumnRenamed(queue, "__queue"), F.col(queue).eqNullSafe(F.col("__queue"))).drop("__queue")
    shuffled = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__pass").cast("string"), F.col(key).cast("string")))
    placed = ranked(dealt, [queue, "__pass"], [shuffled, F.col(key)]).withColumn("turn", F.col("__pass") * F.col("__k") + F.col(_RN))
    return placed.filter(F.col("turn") <= F.col("__turns")).orderBy("turn", queue).limit(n).select(*df.columns, "turn")


def line_windows(df: DataFrame, place: Column, order: Sequence[Column | str], n: int, value: str) -> DataFrame:
    """A table read n rows at a time: window (from 0) and its values in order; the last one may be shorter."""
    lines = serials(df, place, order, "__line").withColumn("window", F.floor((F.col("__line") - 1) / n).cast("long"))
    gathered = lines.groupBy("window").agg(F.array_sort(F.collect_list(F.struct("__line", F.col(value).alias("v")))).alias("rows"))
    return gathered.select("window", F.transform("rows", lambda r: r["v"]).alias("values"))


#: Ranges that a global numbering is dealt to.
RANGES = 64


def serials(df: DataFrame, place: Column, order: Sequence[Column | str], name: str) -> DataFrame:
    """Rows numbered from 1 over the whole table by ``place`` (a number) and then ``order``, without one task for all.

    Approximate quantiles cut the rows into ranges; each range is numbered apart
    and starts after the rows of those before, which are counted. Any bounds give
    the same numbers. Only the bounds reach the driver.
    """
    cuts = df.agg(F.percentile_approx(place, [(i + 1) / RANGES for i in range(RANGES - 1)], 10_000).alias("b")).first()["b"] or []
    bounds = F.array(*(F.lit(x) for x in sorted(set(cuts)))) if cuts else F.array().cast("array<long>")
    ranged = df.withColumn("__at", place).withColumn("__range", F.get(F.transform(F.array(place), lambda p: F.size(F.filter(bounds, lambda b: b < p))), 0))
    counts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    own = F.row_number().over(Window.partitionBy("__range").orderBy("__at", *order))
    return ranged.join(F.broadcast(before), "__range").withColumn(name, (own + F.col("__before")).cast("long")).drop("__range", "__before", "__at")


def hash_place(seed: object, key: str) -> Column:
    """The first twelve digits of a row's place in the seeded order, as a number."""
    return F.conv(F.substring(hash_order(seed, key), 1, 12), 16, 10).cast("long")


#: Bits of the seeded order that part a group; a group is numbered in 2 ** SLICE_BITS tasks at most.
SLICE_BITS = 8


def hash_ranked(df: DataFrame, keys: Sequence[str], key: str, seed: object, name: str, size: str | None = None) -> DataFrame:
    """``ranked`` by the seeded order, and each group's number of rows as ``size``, without one task per group.

    The order is uniform, so its first bits cut a group into even slices. Each is
    numbered apart and starts after the counted rows of those before it: the
    counts, a row per group and slice, are all that one group has in one window.
    """
    dealt = df.withColumn("__slice", F.shiftright(hash_place(seed, key), 48 - SLICE_BITS))
    return in_slices(dealt, keys, [hash_order(seed, key), F.col(key)], df.columns, name, size)


def slice_starts(dealt: DataFrame, keys: Sequence[str], amount: Column) -> tuple[DataFrame, Column]:
    """For each group's slice the amount of those before it (``__before``) and of the group (``__size``), and the condition that joins them."""
    sums = dealt.groupBy(*keys, "__slice").agg(amount.alias("__n"))
    group = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("__n").over(group.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__slice").alias("__s"), before.alias("__before"), F.sum("__n").over(group).alias("__size"))
    same = F.col("__slice") == F.col("__s")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return starts, same


def in_slices(dealt: DataFrame, keys: Sequence[str], order: Sequence[Column | str], columns: Sequence[str], name: str, size: str | None) -> DataFrame:
    """Rows of each group numbered from 1, from slices (``__slice``) that follow each other in the order."""
    starts, same = slice_starts(dealt, keys, F.count(F.lit(1)))
    joined = ranked(dealt, [*keys, "__slice"], order, "__own").join(starts, same).withColumn(name, (F.col("__own") + F.col("__before")).cast("long"))
    return joined.select(*columns, name, *([F.col("__size").alias(size)] if size else []))


def with_ranges(df: DataFrame, place: str) -> DataFrame:
    """``__slice``: in which of 64 ranges of a numeric column a row is, -1 for null. Approximate quantiles cut the table; only they reach the driver."""
    cuts = df.agg(F.percentile_approx(place, [(i + 1) / RANGES for i in range(RANGES - 1)], 10_000).alias("b")).first()["b"] or []
    bounds = F.array(*(F.lit(x) for x in sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    return df.withColumn("__slice", F.coalesce(F.get(F.transform(F.array(place), lambda p: F.size(F.filter(bounds, lambda b: b < p))), 0), F.lit(-1)))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str, size: str | None = None) -> DataFrame:
    """``ranked``, and each group's number of rows as ``size``, without one task per group where the order begins with a numeric column.

    Ranges of that column cut every group into 64 slices at most, so few keys with
    very many rows still make many tasks. Other orders are left to one window.
    """
    first = order[0] if isinstance(order[0], str) else None
    if first and isinstance(df.schema[first].dataType, T.NumericType) and not isinstance(df.schema[first].dataType, T.DecimalType):
        return in_slices(with_ranges(df, first), keys, order, df.columns, name, size)
    out = ranked(df, keys, order, name)
    return out.withColumn(size, F.count(F.lit(1)).over(Window.partitionBy(*keys))) if size else out
