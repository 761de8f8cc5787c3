"""Distributed union-find over an edge table, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import cut


#: Edges up to which one task takes all steps, without a shuffle.
FEW_EDGES = 1 << 17


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"),
    ).first()
    return row["n"], row["s"]


def _both(a: str, b: str, c: str, d: str) -> F.Column:
    return F.inline(F.array(F.struct(F.col(a).alias("u"), F.col(b).alias("v")), F.struct(F.col(c).alias("u"), F.col(d).alias("v"))))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Map each node of ``edges(u, v)`` to the smallest node of its component.

    Alternating large-star and small-star steps (Kiveris et al., 2014): every
    round hooks neighbours onto local minima, so chains halve and the result is
    a star around each minimum. State is one row per node; a node's neighbours
    are only ever reduced to their minimum, never gathered. Each round is cut
    by a checkpoint, and the loop ends when the edge set stops changing. A round
    over FEW_EDGES edges or fewer, counted before it, is one task without a
    shuffle: its joins broadcast, as Spark deals both sides of any other join to
    all partitions, also those of one. The steps are the same.

    Nodes without an edge to another node don't appear in the result
    (``node``, ``root``); null nodes and loops are ignored.
    """
    now = cut(
        edges.filter("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    seen = _checksum(now)
    for _ in range(most_rounds if seen[0] else 0):
        few = seen[0] <= FEW_EDGES
        if few:
            now = now.coalesce(1)
        both = now.select(_both("u", "v", "v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(F.broadcast(least) if few else least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        hub = large.groupBy("u").agg(F.min("v").alias("m"))
        now = cut(large.join(F.broadcast(hub) if few else hub, "u").select(_both("v", "m", "u", "m")).filter("u <> v").distinct())
        then, seen = seen, _checksum(now)
        if then == seen:
            break
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


#: Members per block when all pairs of a bucket are made.
BLOCK = 256


def open_buckets(placed: DataFrame) -> DataFrame:
    """Those of the rows (bucket, k, root and more) whose bucket holds more than one component."""
    split = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("bucket")
    return cut(placed.join(split, "bucket"))


def open_members(full: DataFrame, links: DataFrame) -> DataFrame:
    """bucket, k, root of the members of buckets that hold more than one component."""
    roots = connected_components(links)
    return open_buckets(full.join(roots, full["k"] == roots["node"], "left").select("bucket", "k", F.coalesce("root", "k").alias("root")))


def lift_roots(roots: DataFrame | None, members: DataFrame, merged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """roots(node, root) and the open members after the components that ``merged`` maps to each other became one.

    ``merged`` comes from edges between roots, so it is as small as what is
    still open; the graph of all nodes isn't walked again. Its nodes are roots,
    which ``roots`` doesn't list.
    """
    up = merged.toDF("r", "top")
    rest = [c for c in members.columns if c != "root"]
    placed = open_buckets(members.join(up, F.col("root") == F.col("r"), "left").select(*rest, F.coalesce("top", "root").alias("root")))
    if roots is None:
        return merged, placed
    lifted = roots.join(up, F.col("root") == F.col("r"), "left").select("node", F.coalesce("top", "root").alias("root"))
    return cut(lifted.unionByName(merged)), placed


def cross_pairs(members: DataFrame) -> DataFrame:
    """All distinct pairs (u, v) of one bucket whose roots differ, of members (bucket, k, root).

    A large bucket's members are dealt to blocks, and each pair of blocks is
    joined apart, so that no task holds more than two blocks of a bucket.
    """
    sizes = members.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("k", "bucket"), F.col("blocks")).cast("int"))
    a = dealt.select("bucket", F.col("own").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.col("k").alias("u"), F.col("root").alias("ru"))
    b = dealt.select("bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.col("own").alias("j"), F.col("k").alias("v"), F.col("root").alias("rv"))
    return a.join(b, ["bucket", "i", "j"]).filter((F.col("u") < F.col("v")) & (F.col("ru") != F.col("rv"))).select("u", "v").distinct()
