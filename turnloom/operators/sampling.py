"""Seeded splits and samples with exact counts; identity follows the md5 order of natural keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.operators.ranking import hash_order, hash_place, hash_ranked, ranked, serials


def stratified_split(df: DataFrame, plan: str, key: str, ratio: float, cap: int, seed: object) -> DataFrame:
    """``part`` per plan: single rows test; int(n * ratio) train; if that is above the cap, both parts are capped (rest: null)."""
    sized = hash_ranked(df, [plan], key, seed, "__rn", "__n").withColumn("__train", F.when(F.col("__n") == 1, F.lit(0)).otherwise(F.floor(F.col("__n") * F.lit(ratio))).cast("long"))
    capped = F.col("__train") > cap
    part = (
        F.when(F.col("__rn") <= F.least(F.col("__train"), F.lit(cap)), "train")
        .when((F.col("__rn") > F.col("__train")) & (~capped | (F.col("__rn") <= F.col("__train") + cap)), "test")
    )
    return sized.withColumn("part", part).drop("__rn", "__n", "__train")


def two_streams(df: DataFrame, plan: str, key: str, plain: Column, same: Column, ratio: float, caps: dict[str, int], seed: object) -> DataFrame:
    """``stream`` (NR: records without references, nonNR: the others) and ``part``, each stream split by plan for itself.

    Of the others those go whose query and rewrite are the ``same``. ``caps`` holds the
    most rows of a part for each stream; flags that are null count as not set.
    """
    flagged = df.withColumn("stream", F.when(plain, "NR").otherwise("nonNR")).filter((F.col("stream") == "NR") | ~F.coalesce(same, F.lit(False)))
    parts = [stratified_split(flagged.filter(F.col("stream") == name), plan, key, ratio, cap, seed) for name, cap in caps.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def capped_sample(df: DataFrame, keys: Sequence[str], key: str, n: Column | int, seed: object) -> DataFrame:
    """n rows of each group, or all of smaller ones; by a fixed n Spark cuts groups before it shuffles them."""
    placed = ranked(df, keys, [hash_order(seed, key), F.col(key)], "__rn") if isinstance(n, int) else hash_ranked(df, keys, key, seed, "__rn")
    return placed.filter(F.col("__rn") <= n).drop("__rn")


def fraction_sample(df: DataFrame, keys: Sequence[str], key: str, fraction: float, above: int, seed: object) -> DataFrame:
    """Groups of more than ``above`` rows are cut to round-half-even(n * fraction), others stay."""
    sized = hash_ranked(df, keys, key, seed, "__rn", "__n")
    return sized.filter((F.col("__n") <= above) | (F.col("__rn") <= F.bround(F.col("__n") * F.lit(fraction)))).drop("__rn", "__n")


def group_split(df: DataFrame, group: str, train: float, valid: float, seed: object) -> DataFrame:
    """Whole groups to train, valid and test by round-half-even shares of their number."""
    groups = df.select(group).distinct()
    total = groups.agg(F.count(F.lit(1)).alias("__n"))
    placed = serials(groups, hash_place(seed, group), [hash_order(seed, group), F.col(group)], "__rn").crossJoin(F.broadcast(total))
    first = F.bround(F.col("__n") * F.lit(train))
    second = first + F.bround(F.col("__n") * F.lit(valid))
    part = F.when(F.col("__rn") <= first, "train").when(F.col("__rn") <= second, "valid").otherwise("test")
    return df.join(placed.select(group, part.alias("part")), group)


def apportion(counts: DataFrame, plan: str, total: int, floor: int) -> DataFrame:
    """Largest-remainder shares of ``total`` by count, above a floor of min(floor, count) for each.

    What a share would exceed its plan's rows by goes on to the others, by
    rounds over one row per plan.
    """
    floors = counts.select(plan, F.col("n"), F.least(F.col("n"), F.lit(floor)).cast("long").alias("alloc"))
    rows = [(r[plan], r["n"], r["alloc"]) for r in floors.collect()]
    left = total - sum(r[2] for r in rows)
    if left < 0:
        raise ValueError("the floors exceed the target")
    left = min(left, sum(n - a for _, n, a in rows))
    alloc = {p: a for p, _, a in rows}
    size = {p: n for p, n, _ in rows}
    while left:
        open_ = sorted(p for p in alloc if alloc[p] < size[p])
        room = sum(size[p] - alloc[p] for p in open_)
        exact = {p: left * (size[p] - alloc[p]) / room for p in open_}
        for p in open_:
            alloc[p] += int(exact[p])
        rest = left - sum(int(x) for x in exact.values())
        for p in sorted(open_, key=lambda p: (-(exact[p] - int(exact[p])), -size[p], p)):
            if rest and alloc[p] < size[p]:
                alloc[p] += 1
                rest -= 1
        left = rest
    return counts.sparkSession.createDataFrame(sorted(alloc.items(), key=lambda x: (x[0] is None, x[0])), f"`{plan}` string, alloc long")


def distractors(df: DataFrame, gold: str, key: str, catalog: Sequence[str], n: int, seed: object) -> DataFrame:
    """``candidates``: n other plans in seeded order and the gold one, sorted by the same order."""
    every = F.array(*[F.lit(x) for x in catalog])

    def place(x: Column) -> Column:
        return F.struct(hash_order(seed, F.col(key), x).alias("h"), x.alias("x"))

    others = F.slice(F.array_sort(F.transform(F.filter(every, lambda x: x != F.col(gold)), place)), 1, n)
    both = F.array_sort(F.array_append(others, place(F.col(gold))))
    return df.withColumn("candidates", F.transform(both, lambda s: s["x"]))


def gold_and_others(df: DataFrame, gold: str, key: str, catalog: Sequence[str], n: int, seed: object) -> DataFrame:
    """``tools``: the gold ones, then others in seeded order up to n in all; more than n gold ones stay, alone."""
    every = F.array(*[F.lit(x) for x in catalog])
    others = F.array_sort(F.transform(F.array_except(every, F.col(gold)), lambda x: F.struct(hash_order(seed, F.col(key), x).alias("h"), x.alias("x"))))
    return df.withColumn("tools", F.concat(gold, F.transform(F.slice(others, F.lit(1), F.greatest(F.lit(n) - F.size(gold), F.lit(0))), lambda s: s["x"])))


def with_replacement(df: DataFrame, keys: Sequence[str], key: str, n: int, seed: object) -> DataFrame:
    """n draws from each group: draw k takes row hash(seed, k) mod size of the group's seeded order."""
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).cast("long").alias("__n"))
    draws = size.select(*keys, "__n", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("draw"))
    number = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *keys, F.col("draw").cast("string"))), 1, 12), 16, 10).cast("long")
    placed = draws.withColumn("__rn", F.pmod(number, F.col("__n")) + 1)
    return placed.join(hash_ranked(df, keys, key, seed, "__rn"), [*keys, "__rn"]).drop("__rn", "__n")


def interleave(df: DataFrame, source: str, key: str, weights: dict[str, float], seed: object) -> DataFrame:
    """Merge sources by probability: row k of a source with weight p comes at virtual time k / p."""
    p = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col(source)]
    return hash_ranked(df, [source], key, seed, "__rn").withColumn("time", F.col("__rn") / p).drop("__rn")


def mixture_plan(total: int, ratios: dict[str, float]) -> dict[str, int]:
    """Rows per source: the rounded share (half to even) of each, the last source what is left. Shares have to add up to 1."""
    if abs(sum(ratios.values()) - 1.0) > 1e-9:
        raise ValueError("the ratios don't add up to 1")
    *first, last = ratios
    plan = {s: round(total * ratios[s]) for s in first}
    return plan | {last: total - sum(plan.values())}


def mixture(df: DataFrame, source: str, key: str, total: int, ratios: dict[str, float], seed: object) -> DataFrame:
    """The planned rows of each source in seeded order; a source with too few rows is an error."""
    plan = mixture_plan(total, ratios)
    have = {r[source]: r["n"] for r in df.filter(F.col(source).isin(*plan)).groupBy(source).agg(F.count(F.lit(1)).alias("n")).collect()}
    if short := {s: n for s, n in plan.items() if have.get(s, 0) < n}:
        raise ValueError(f"too few rows for {short}")
    wanted = F.create_map(*[F.lit(x) for kv in plan.items() for x in kv])[F.col(source)]
    return capped_sample(df.filter(F.col(source).isin(*plan)), [source], key, wanted, seed)


def take_in_turn(targets: DataFrame, place: Column, order: Sequence[Column | str], pool: DataFrame, key: str, seed: object) -> DataFrame:
    """Each target takes the next row of the pool in seeded order; a pool that is too small is an error, as rows are used once."""
    wanted, have = targets.count(), pool.count()
    if wanted > have:
        raise ValueError(f"the pool is exhausted: {wanted} rows are wanted, {have} are there")
    shuffled = serials(pool, hash_place(seed, key), [hash_order(seed, key), F.col(key)], "__rn").filter(F.col("__rn") <= wanted)
    return serials(targets, place, order, "__rn").join(shuffled, "__rn").drop("__rn")
