"""Chat formatting by cumulative-snapshot collapse, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TURN_OPEN, TURN_CLOSE = "<|im_start|>", "<|im_end|>"


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """Number the turns of each conversation and add rolling prefix hashes.

    Each turn contributes two independent 64-bit hashes of (place, role, text);
    the prefix hash after turn ``i`` is the pair of running exact sums, obtained
    from the previous one by one addition. Turns are ordered by ``turn`` (null
    first), then role and text, so repeated turn numbers have a defined order;
    null roles and texts read as empty.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rolling = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("i", F.row_number().over(order))
        .withColumn("h1", F.xxhash64(F.lit("a"), "i", "role", "text").cast("decimal(20,0)"))
        .withColumn("h2", F.xxhash64(F.lit("b"), "text", "i", "role").cast("decimal(20,0)"))
        .withColumn("p1", F.sum("h1").over(rolling))
        .withColumn("p2", F.sum("h2").over(rolling))
        .withColumn("more", F.lead(F.lit(True)).over(order))
    )


def collapse_snapshots(turns: DataFrame) -> DataFrame:
    """Keep only maximal conversations and render them as chat text.

    A conversation goes when its turns are a proper prefix of a longer one; of
    identical conversations the smallest ``conv_id`` stays (``copies`` counts
    them). Copies collapse by a map-side combined aggregate before the
    anti-join, and the prefixes are distinct, so both sides of the join have
    unique keys and a very common first turn or conversation is one row there.

    Rows without a ``conv_id`` form one conversation with a null id. A
    conversation without any row doesn't exist; an empty table gives no rows.
    Texts are hashed whole, however long; a conversation's rendered text is one
    value of one row, so its turns together have to fit one (2 GB).
    Only conv_id, turn, role and text are read; other columns don't matter.
    Returns conv_id, n_turns, copies, rendered.
    """
    numbered = turn_prefixes(turns)
    block = F.concat(F.lit(TURN_OPEN), "role", F.lit("\n"), "text", F.lit(TURN_CLOSE))
    whole = numbered.groupBy("conv_id").agg(
        F.max(F.struct("i", "p1", "p2")).alias("last"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", block.alias("block")))), lambda t: t["block"]), "\n").alias("rendered"),
    )
    unique = (
        whole.select("conv_id", "rendered", "last.i", "last.p1", "last.p2")
        .groupBy("i", "p1", "p2")
        .agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"), F.max("rendered").alias("rendered"))
    )
    prefixes = numbered.filter("more").select("i", "p1", "p2").distinct()
    return unique.join(prefixes, ["i", "p1", "p2"], "left_anti").select("conv_id", F.col("i").cast("long").alias("n_turns"), "copies", "rendered")


#: The same in DuckDB, comparing the rendered prefixes themselves.
ORACLE = """
with t as (
  select conv_id, coalesce(role, '') as r, coalesce(text, '') as x,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as i
  from conversations),
p as (
  select conv_id, i,
         string_agg('<|im_start|>' || r || chr(10) || x || '<|im_end|>', chr(10))
           over (partition by conv_id order by i rows between unbounded preceding and current row) as s,
         count(*) over (partition by conv_id) as n
  from t),
w as (select s as rendered, n, min(conv_id) as conv_id, count(*) as copies from p where i = n group by s, n)
select conv_id, n::BIGINT as n_turns, copies::BIGINT as copies, rendered
from w where not exists (select 1 from p where p.i = w.n and p.n > p.i and p.s = w.rendered)
"""
