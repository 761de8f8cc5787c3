"""Stand-ins for the engine's record tables, derived from the driver's tables, with their SQL.

``scored``: documents with labels as scored predictions (plan: source, turn 2-5,
bucket and file by id). ``history``: conversations as turn lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.registry import Tables

BUCKETS = ["nonNR", "complex_1", "complex_2", "complex_3"]


def scored(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.col("source").alias("plan"), "lang").join(t.labels, "doc_id")
    bucket = F.element_at(F.array(*map(F.lit, BUCKETS)), (F.floor(F.col("doc_id") / 28) % 4 + 1).cast("int"))
    return (
        d.withColumn("turn", (F.floor(F.col("doc_id") / 7) % 4 + 2).cast("long"))
        .withColumn("bucket", bucket)
        .withColumn("file", F.concat(F.lit("it"), "turn", F.lit("_"), "bucket", F.lit("_tc.tsv")))
        .select("doc_id", "plan", "lang", "turn", "bucket", "file", (F.col("quality") == 1).alias("plan_ok"), (F.col("toxic") == 0).alias("args_ok"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("all_ok"))
    )


SCORED = """with scored as (
  select doc_id, plan, lang, turn, bucket, 'it' || turn || '_' || bucket || '_tc.tsv' as file, plan_ok, args_ok, plan_ok and args_ok as all_ok
  from (select d.doc_id, d.source as plan, d.lang, ((d.doc_id // 7) % 4 + 2)::BIGINT as turn,
               (['nonNR', 'complex_1', 'complex_2', 'complex_3'])[((d.doc_id // 28) % 4 + 1)::INT] as bucket,
               l.quality = 1 as plan_ok, l.toxic = 0 as args_ok
        from documents d join labels l using (doc_id)))
"""


def one(flag: str) -> str:
    return f"(case when {flag} then 1.0 else 0.0 end)::DOUBLE"


def r9(c: Column | str) -> Column:
    return F.round(c if isinstance(c, Column) else F.col(c), 9)


def history(t: Tables) -> DataFrame:
    """conv_id, h: 'turn N: role -> text' in order."""
    said = F.concat(F.lit("turn "), (F.col("turn") + 1).cast("string"), F.lit(": "), "role", F.lit(" -> "), "text")
    rows = t.conversations.select("conv_id", "turn", said.alias("s"))
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "s"))), lambda x: x["s"]).alias("h"))


HISTORY = """with history as (
  select conv_id, list('turn ' || (turn + 1) || ': ' || role || ' -> ' || text order by turn) as h
  from conversations group by conv_id)
"""
