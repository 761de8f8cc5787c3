"""Accuracy, support, offender and agreement aggregates over scored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share(flag: Column) -> Column:
    """Mean of a flag; null flags count as false."""
    return F.avg(F.coalesce(flag.cast("double"), F.lit(0.0)))


def plan_macro(df: DataFrame, correct: Column, plan: str = "plan", by: Sequence[str] = ()) -> DataFrame:
    """Mean over plans of each plan's accuracy; rows without a plan don't count."""
    per_plan = df.filter(F.col(plan).isNotNull()).groupBy(*by, plan).agg(share(correct).alias("__acc"))
    return per_plan.groupBy(*by).agg(F.avg("__acc").alias("plan_macro"))


def support_table(df: DataFrame, correct: Column, by: Sequence[str]) -> DataFrame:
    hits = F.sum(F.coalesce(correct.cast("long"), F.lit(0)))
    return df.groupBy(*by).agg(share(correct).alias("acc"), F.count(F.lit(1)).alias("support"), hits.alias("hits"), (F.count(F.lit(1)) - hits).alias("incorrect"))


def weighted_turn_macro(macros: DataFrame, weights: DataFrame) -> DataFrame:
    """turn, weighted: bucket macros weighted over the buckets that are present."""
    return macros.join(F.broadcast(weights), ["turn", "bucket"]).groupBy("turn").agg((F.sum(F.col("w") * F.col("plan_macro")) / F.sum("w")).alias("weighted"))


def trend_offenders(wide: DataFrame, acc: Sequence[str], support: Sequence[str], least: int) -> DataFrame:
    """Rows whose accuracies aren't falling or level in order, with enough support everywhere; delta is last less first."""
    enough = F.lit(True)
    for c in support:
        enough = enough & (F.coalesce(F.col(c), F.lit(0)) >= least)
    level = F.lit(True)
    for a, b in zip(acc, acc[1:]):
        level = level & (F.col(a) >= F.col(b))
    return wide.filter(enough).withColumn("delta", F.col(acc[-1]) - F.col(acc[0])).withColumn("offender", ~level)


def slot_metrics(gold: Column, pred: Column) -> tuple[Column, Column, Column, Column]:
    """matched, precision, recall, f1 of two item sets; two empty ones agree fully."""
    matched = F.size(F.array_intersect(gold, pred))
    both_empty = (F.size(gold) == 0) & (F.size(pred) == 0)

    def ratio(n: Column) -> Column:
        return F.when(both_empty, 1.0).when(n == 0, 0.0).otherwise(matched / n)

    p, r = ratio(F.size(F.array_distinct(pred))), ratio(F.size(F.array_distinct(gold)))
    return matched, p, r, F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def bootstrap_ci(counts: DataFrame, iterations: int = 2000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Percentile interval of the plan macro from (plan, n, hits): resampling 0/1 rows is a binomial draw.

    Draws are made per plan and iteration by inverting the binomial with a seeded
    uniform in a vectorised function, so nothing larger than plans times
    iterations is ever a row.
    """
    import pandas as pd

    def draw(batches):
        import numpy as np

        for pdf in batches:
            rng = [np.random.default_rng([seed, int(h)]) for h in pdf["h"]]
            parts = [pd.DataFrame({"i": range(iterations), "acc": g.binomial(n, k / n, iterations) / n}) for g, n, k in zip(rng, pdf["n"], pdf["hits"])]
            yield pd.concat(parts) if parts else pd.DataFrame({"i": [], "acc": []})

    keyed = counts.filter("n > 0").select("n", "hits", F.pmod(F.xxhash64("plan"), F.lit(2**31)).alias("h"))
    macros = keyed.mapInPandas(draw, "i long, acc double").groupBy("i").agg(F.avg("acc").alias("macro"))
    return macros.agg(
        F.avg("macro").alias("mean"),
        F.percentile("macro", F.lit(alpha / 2)).alias("low"),
        F.percentile("macro", F.lit(1 - alpha / 2)).alias("high"),
    )


def common_offenders(df: DataFrame, item: str, model: str, score: str, order: str) -> DataFrame:
    """item, models in input order, their number and summed score, most frequent and highest first."""
    seen = F.array_sort(F.collect_list(F.struct(order, model)))
    return df.groupBy(item).agg(F.array_join(F.transform(seen, lambda s: s[model]), ",").alias("models"), F.count(F.lit(1)).alias("n_models"), F.sum(score).alias("total"))
