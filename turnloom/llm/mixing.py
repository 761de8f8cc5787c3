"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnloom.llm.common import cut

#: Source weights by rank, repeating.
WEIGHTS = (3, 1, 2)
#: Targets together, as a share of all words, in halves (3 halves are 150 %).
TOTAL_HALVES = 3
#: No target is above so many times its source's size, no document is taken more often.
MOST_COPIES = 2
#: Ranks are cut into so many steps, so that no source's ranking has to be in one task.
STEPS = 1024
#: Sources whose targets are broadcast; beyond, the join on the source is left to skew handling.
FEW_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def word_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the whole text; null: 0)."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target: water-filling under a cap of twice each size.

    Sharing the excess again and again ends at ``min(cap, level * weight)``. With
    sources in order of cap / weight, the level follows from prefix sums of
    whole numbers, so one division gives each target exactly as any other
    engine would. One row per source goes through the ordering windows.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = by_source.withColumn("w", F.element_at(F.array(*[F.lit(w).cast("long") for w in WEIGHTS]), (F.pmod(rank, F.lit(len(WEIGHTS))) + 1).cast("int")))
    # compare size/w by cross products of whole numbers: size * (6/w) is whole for w in 1, 2, 3
    lcm = 6
    weighed = weighed.withColumn("ratio", F.col("source_size") * (F.lit(lcm) / F.col("w")).cast("long"))
    upto = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    summed = (
        weighed.withColumn("size_upto", F.sum("source_size").over(upto))
        .withColumn("w_upto", F.sum("w").over(upto))
        .withColumn("size_all", F.sum("source_size").over(whole))
        .withColumn("w_all", F.sum("w").over(whole))
    )
    # a source is capped if, with all before it capped, its share of the rest reaches its cap
    rest = F.lit(TOTAL_HALVES) * F.col("size_all") - F.lit(2 * MOST_COPIES) * (F.col("size_upto") - F.col("source_size"))
    capped = F.col("w") * rest >= F.lit(2 * MOST_COPIES) * F.col("source_size") * (F.col("w_all") - F.col("w_upto") + F.col("w"))
    marked = summed.withColumn("capped", capped)
    level = (
        marked.withColumn("cap_size", F.sum(F.when(F.col("capped"), F.col("source_size")).otherwise(0)).over(whole))
        .withColumn("cap_w", F.sum(F.when(F.col("capped"), F.col("w")).otherwise(0)).over(whole))
    )
    share = F.try_divide((F.col("w") * (F.lit(TOTAL_HALVES) * F.col("size_all") - F.lit(2 * MOST_COPIES) * F.col("cap_size"))).cast("double"), (F.lit(2) * (F.col("w_all") - F.col("cap_w"))).cast("double"))
    target = F.when(F.col("capped"), (F.lit(MOST_COPIES) * F.col("source_size")).cast("double")).otherwise(share)
    return level.select("source", "source_size", target.alias("target"))


def tilt(size) -> F.Column:
    """A document's weight within its source: 24 less its size's binary digits, 4 at least.

    Long documents are wanted a little less often, a word of a document of
    20,000 words about two thirds as often as one of a document of 500.
    """
    return F.lit(24) - F.least(F.length(F.regexp_replace(F.bin(size), "^0$", "")), F.lit(20))


def expected_copies(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """source, w, level: copies wanted of a document of weight w are min(2, level * w).

    Within each source the level is found like that of the targets, over its at
    most 21 weights.
    """
    classes = sizes.filter("size > 0").groupBy("source", tilt(F.col("size")).cast("long").alias("w")).agg(F.sum("size").alias("s"))
    joined = classes.join(targets, classes["source"].eqNullSafe(targets["source"])).select(classes["source"], "w", "s", "target")
    heavy = Window.partitionBy("source").orderBy(F.col("w").desc())
    upto = heavy.rowsBetween(Window.unboundedPreceding, -1)
    after = heavy.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rest = F.col("target") - (F.lit(MOST_COPIES) * F.coalesce(F.sum("s").over(upto), F.lit(0))).cast("double")
    stepped = joined.withColumn("rest", rest).withColumn("ws", F.sum(F.col("w") * F.col("s")).over(after))
    stepped = stepped.withColumn("level", F.col("rest") / F.col("ws").cast("double"))
    # the level is that of the first weight that is below its cap with all heavier ones at theirs
    fits = F.when(F.col("level") * F.col("w") <= MOST_COPIES, F.col("level"))
    every = heavy.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return stepped.withColumn("level", F.first(fits, ignorenulls=True).over(every)).select("source", "w", "level")


def mix(docs: DataFrame) -> DataFrame:
    """Take documents so that each source comes near its target of words.

    Copies wanted of a document are ``min(2, level * weight)``. Their whole part
    is taken for certain. The rest is its inclusion probability p in a Pareto
    order sample: documents are ranked by random odds u/(1-u) over inclusion odds
    p/(1-p), u from the md5 of the id, and the first ones are taken. The sample's
    size is fixed in words, as the targets are: the ranking is cut where the sum is
    nearest to the words still due, so a source is off by half a document at most.

    The ranking of a source is cut into steps of the odds; sums per step say
    which steps are taken whole and in which one the cut is, so a source with a
    third of all rows is still spread over 1,024 groups. Documents that are wanted
    a whole number of times, such as all of a source at its cap, and those
    without words aren't ranked. Rows of one id, source and weight have the same
    odds and share a step.

    Null texts and texts without words have size 0 and give nothing; a null
    source is a source of its own; rows with equal ids are separate documents
    with equal odds, in order of their size. An empty table gives no rows. Other
    columns don't matter. Returns doc_id, size, source_size, target, taken.
    """
    sizes = cut(word_sizes(docs))
    targets = cut(source_targets(sizes))
    levels = expected_copies(sizes, targets)
    # sources are joined by a key without nulls
    key = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    per_class = (
        targets.withColumn("k", key).drop("source")
        .join(levels.withColumn("k", key).drop("source"), "k", "left")
        .groupBy("k", "source_size", "target")
        .agg(F.max("level").alias("level"))
    )
    if targets.count() <= FEW_SOURCES:
        per_class = F.broadcast(per_class)
    sized = sizes.withColumn("k", key).join(per_class, "k")
    wanted = F.when(F.col("size") > 0, F.least(F.col("level") * tilt(F.col("size")).cast("long"), F.lit(float(MOST_COPIES)))).otherwise(0.0)
    u = (F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)
    p = F.col("wanted") - F.floor("wanted")
    drawn = (
        sized.withColumn("wanted", wanted)
        .withColumn("whole", F.floor("wanted").cast("long"))
        .withColumn("p", p)
        .withColumn("u", u)
        .withColumn("q", F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) * ((1 - F.col("p")) / F.col("p"))))
        .withColumn("step", F.when(F.col("p") > 0, F.floor(F.col("q") / (1 + F.col("q")) * STEPS)).cast("long"))
        .select("k", "doc_id", "size", "source_size", "target", "whole", "q", "step")
    )
    steps = (
        drawn.groupBy("k", "target", "step")
        .agg(F.sum(F.col("whole") * F.col("size")).alias("sure"), F.sum(F.when(F.col("step").isNotNull(), F.col("size")).otherwise(0)).alias("words"))
    )
    per_source = Window.partitionBy("k")
    before = per_source.orderBy(F.col("step").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    steps = (
        steps.withColumn("due", F.col("target") - F.sum("sure").over(per_source).cast("double"))
        .withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .filter("step is not null")
        .select("k", "step", "due", "before")
    )
    ranked = Window.partitionBy("k", "step").orderBy("q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # what isn't drawn (no words, or wanted a whole number of times) is in no step and takes no part in the ranking
    summed = drawn.filter("q is not null").withColumn("upto", F.sum("size").over(ranked)).join(steps, ["k", "step"])
    in_sample = (2 * (F.col("before") + F.col("upto")) - F.col("size")).cast("double") <= 2 * F.col("due")
    taken = lambda copies: (copies * F.col("size")).cast("long").alias("taken")
    columns = ["doc_id", "size", "source_size", "target"]
    sampled = summed.select(*columns, taken(F.col("whole") + F.when(in_sample, 1).otherwise(0)))
    return sampled.unionByName(drawn.filter("q is null").select(*columns, taken(F.col("whole"))))


ORACLE = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT as size from documents),
s0 as (select source, sum(size)::BIGINT as source_size from d group by source),
s1 as (select *, [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::INT]::BIGINT as w from s0),
s2 as (select *, source_size * (6 // w) as ratio from s1),
s3 as (select *, sum(source_size) over o as size_upto, sum(w) over o as w_upto, sum(source_size) over () as size_all, sum(w) over () as w_all
       from s2 window o as (order by ratio, source nulls last rows between unbounded preceding and current row)),
s4 as (select *, w * (3 * size_all - 4 * (size_upto - source_size)) >= 4 * source_size * (w_all - w_upto + w) as capped from s3),
s5 as (select *, sum(case when capped then source_size else 0 end) over () as cap_size, sum(case when capped then w else 0 end) over () as cap_w from s4),
s as (select source, source_size, case when capped then (2 * source_size)::DOUBLE
        else (w * (3 * size_all - 4 * cap_size))::DOUBLE / (2 * (w_all - cap_w))::DOUBLE end as target from s5),
e as (select d.doc_id, d.source, d.size, s.source_size, s.target,
        24 - least(case when d.size = 0 then 0 else length(bin(d.size)) end, 20)::BIGINT as w
      from d join s on d.source is not distinct from s.source),
c0 as (select source, w, target, sum(size)::BIGINT as z from e where size > 0 group by all),
c1 as (select *, target - (2 * coalesce(sum(z) over (partition by source order by w desc rows between unbounded preceding and 1 preceding), 0))::DOUBLE as rest,
        sum(w * z) over (partition by source order by w desc rows between current row and unbounded following) as ws from c0),
c2 as (select source, w, rest / ws::DOUBLE as level from c1),
c as (select source, arg_max(level, w) as level from c2 where level * w <= 2 group by source),
f as (select e.*, case when size > 0 then least(level * w, 2.0::DOUBLE) else 0.0::DOUBLE end as wanted,
        (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656.0::DOUBLE as u
      from e left join c on e.source is not distinct from c.source),
g as (select *, floor(wanted)::BIGINT as whole, wanted - floor(wanted) as p from f),
h as (select *, case when p > 0 then (u / (1 - u)) * ((1 - p) / p) end as q from g),
r as (select *, sum(whole * size) over (partition by source) as sure,
        case when q is not null then sum(size) over (partition by source, q is null order by q, doc_id, size rows between unbounded preceding and current row) end as upto from h)
select doc_id, size, source_size, target,
  ((whole + case when q is not null and (2 * upto - size)::DOUBLE <= 2 * (target - sure::DOUBLE) then 1 else 0 end) * size)::BIGINT as taken
from r
"""
