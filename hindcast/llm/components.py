"""Connected components of a pair list by alternating large-star and small-star rewrites.

An edge list is kept as rows (hi, lo) with hi > lo.  The large-star hangs every larger neighbour of a vertex on the vertex's
least neighbour, the small-star does so with the smaller neighbours and the vertex itself.  Both keep the components and
both are plain joins of the edges with one row per vertex, so no vertex is ever gathered into one task.  When a round
changes nothing, every record hangs on the least identifier of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from hindcast.runtime import Scratch, hot_keys

#: A vertex with more than this part of all edges is looked up by broadcast (fewer than PARTS such vertices can exist).
PARTS = 1000


def with_least(edges: DataFrame, least: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """``edges`` left-joined with ``least`` (hub, least; one row a hub) on ``key``.

    ``hot`` (hub) are taken out of the shuffle: they are fewer than PARTS rows by counting, and are broadcast.
    """
    hot_least = hot.join(least, "hub", "left").withColumn("hot", F.lit(True))
    marked = edges.join(F.broadcast(hot_least), edges[key] == hot_least["hub"], "left").drop("hub")
    busy = marked.filter("hot").drop("hot")
    rest = marked.filter("hot is null").drop("hot", "least").join(least, F.col(key) == F.col("hub"), "left").drop("hub")
    return busy.unionByName(rest)


def least_lower(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("hi").alias("hub")).agg(F.min("lo").alias("least"), F.count(F.lit(1)).alias("n_rows"))


def large_star(edges: DataFrame, rows: int) -> DataFrame:
    hot = hot_keys(edges, "lo", rows, PARTS).select(F.col("lo").alias("hub"))
    joined = with_least(edges, least_lower(edges).select("hub", "least"), "lo", hot)
    return joined.select("hi", F.coalesce("least", "lo").alias("lo")).distinct()


def small_star(edges: DataFrame, rows: int) -> DataFrame:
    counted = least_lower(edges)
    hot, least = counted.filter(F.col("n_rows") * PARTS > F.lit(rows)).select("hub"), counted.select("hub", "least")
    joined = with_least(edges, least, "hi", hot)
    moved = joined.filter(F.col("lo") != F.col("least")).select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
    return moved.unionByName(least.select(F.col("hub").alias("hi"), F.col("least").alias("lo"))).distinct()


def kept_with_state(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, tuple[int, int]]:
    """The written edge list, and its rows and an order-free fingerprint, observed while it was written."""
    seen = Observation()
    row = F.xxhash64("hi", "lo").cast("decimal(38,0)")
    kept = scratch.keep(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(row).alias("hash")))
    return kept, (seen.get["n"], int(seen.get["hash"] or 0))


def connected_components(pairs: DataFrame, a: str, b: str, node: str = "node_id", group: str = "group_id") -> DataFrame:
    """One row (``node``, ``group``) for each record that is linked to another one; ``group`` is its least record.

    Pairs may repeat, come in either order, hold nulls or link a record to itself: nulls and self links are no links, and a
    record with no other link has no row.  An empty pair list gives an empty result.  Strings compare by code point.  Other
    columns of ``pairs`` are not read.
    """
    spark = pairs.sparkSession
    scratch = Scratch(spark)
    left, right = F.col(a), F.col(b)
    linked = pairs.filter(left.isNotNull() & right.isNotNull() & (left != right))
    edges, before = kept_with_state(linked.select(F.greatest(left, right).alias("hi"), F.least(left, right).alias("lo")).distinct(), scratch)
    while True:
        wide = scratch.keep(large_star(edges, before[0]))
        narrow, now = kept_with_state(small_star(wide, before[0]), scratch)
        scratch.drop(wide, edges)
        edges = narrow
        if now == before:
            break
        before = now
    members = edges.select(F.col("hi").alias(node), F.col("lo").alias(group))
    return members.unionByName(edges.select(F.col("lo").alias(node), F.col("lo").alias(group)).distinct())
