"""Sinks: JSONL, TSV, partitioned and split outputs, appends with fresh keys, manifests, text reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnloom.operators.ranking import ranked
from turnloom.shared import scratch  # noqa: F401  part of this module for its callers


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_tsv(df: DataFrame, path: str, columns: Sequence[str] | None = None, mode: str = "error") -> None:
    """Fixed column order; nulls are written as empty cells."""
    (df.select(*columns) if columns else df).write.mode(mode).csv(path, sep="\t", header=True, quote='"', escape='"', emptyValue="", nullValue="")


def write_partitioned(df: DataFrame, path: str, keys: Sequence[str], mode: str = "error") -> None:
    """One folder per key; rows are dealt out by key and a salt, so a large key has several files."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64(*[c for c in df.columns]), F.lit(max(1, n // 4)))
    df.repartition(*keys, salt).write.mode(mode).partitionBy(*keys).parquet(path)


def write_split(df: DataFrame, flag: str, kept: str, rest: str) -> None:
    """Kept rows and redundant ones to two folders; the plan runs once, over its written form."""
    df.write.partitionBy(flag).parquet(f"{kept}.parts")
    parts = df.sparkSession.read.schema(df.schema).parquet(f"{kept}.parts")
    parts.filter(F.col(flag)).drop(flag).write.parquet(kept)
    parts.filter(~F.col(flag)).drop(flag).write.parquet(rest)


def fresh_keys(new: DataFrame, existing: DataFrame, key: str, order: Sequence[str], first: int = 100) -> DataFrame:
    """Keys that exist already (or repeat) get a suffix from ``first`` upward that no key with their stem has."""
    stem = F.regexp_replace(key, r"-\d+$", "")
    taken = existing.select(F.col(key)).distinct().withColumn("__taken", F.lit(True))
    marked = ranked(new.join(taken, key, "left"), [key], order, "__n").withColumn("__clash", F.col("__taken").isNotNull() | (F.col("__n") > 1))
    used = existing.select(F.col(key)).unionByName(marked.filter(~F.col("__clash")).select(key))
    highest = used.select(stem.alias("__stem"), F.expr(f"try_cast(regexp_extract({key}, '-(\\\\d+)$', 1) as long)").alias("__k")).groupBy("__stem").agg(F.max("__k").alias("__top"))
    joined = marked.withColumn("__stem", stem).join(highest, "__stem", "left")
    place = F.row_number().over(Window.partitionBy("__stem", "__clash").orderBy(*order))
    start = F.greatest(F.coalesce(F.col("__top") + 1, F.lit(first)), F.lit(first))
    fresh = F.when(F.col("__clash"), F.concat("__stem", F.lit("-"), (start + place - 1).cast("string"))).otherwise(F.col(key))
    return joined.withColumn(key, fresh).select(*new.columns)


def manifest(df: DataFrame, by: Sequence[str], plan: str) -> DataFrame:
    """Rows and plans per output."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(plan).alias("plans"))


def formatted(df: DataFrame, columns: Sequence[str], missing: str = "N/A") -> DataFrame:
    """Numbers as two decimals, nulls and NaN as a mark, for reports."""

    def cell(c: str) -> Column:
        number = F.col(c)
        return F.when(number.isNull() | F.isnan(number), missing).otherwise(F.format_string("%.2f", number)).alias(c)

    return df.select(*(cell(c) if c in columns else F.col(c) for c in df.columns))


#: Rows of a report at most; a larger one is refused, not cut.
REPORT_ROWS = 10_000


def markdown(df: DataFrame) -> str:
    """A small aggregate as a Markdown table."""
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError("a report is for small aggregates")
    lines = [df.columns, ["---"] * len(df.columns), *[["" if v is None else str(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def latex(df: DataFrame) -> str:
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError("a report is for small aggregates")
    body = [" & ".join("--" if v is None else str(v) for v in r) + r" \\" for r in rows]
    head = " & ".join(df.columns) + r" \\ \hline"
    return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", head, *body, r"\end{tabular}"])


def log_events(df: DataFrame, path: str) -> None:
    """Append one JSON object per row to an event log, each with the UTC time of writing."""
    stamped = df.select(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp_utc"), *df.columns)
    write_jsonl(stamped, path, mode="append")


def log_counts(df: DataFrame, plan: str, title: str, path: str) -> None:
    """Append the rows per plan, and the numbers of plans and rows, as text lines under a title."""
    counts = df.groupBy(plan).agg(F.count(F.lit(1)).alias("n"))
    lines = counts.select(F.format_string("[%s] : %s: %d", F.lit(title), F.col(plan), "n").alias("value"))
    total = counts.agg(F.format_string("[%s] : plan_count: %d, total_lens: %d", F.lit(title), F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).alias("value"))
    lines.unionByName(total).write.mode("append").text(path)
