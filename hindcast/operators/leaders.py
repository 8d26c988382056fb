"""Greedy leader clustering without a driver loop over rows.

Scanning rows in order, each row that matches no earlier leader becomes a leader and takes its later matches.  That is the
lexicographically first maximal independent set of the match graph, found by rounds of joins: an undecided row without an
undecided smaller neighbour and without a leader among its neighbours is a leader; neighbours of leaders are members.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.runtime import Scratch


def leader_clusters(nodes: DataFrame, edges: DataFrame, node: str, a: str, b: str) -> DataFrame:
    """``node, leader``: every node with the leader that takes it (a leader takes itself).

    ``edges`` are matches in any direction; order is the order of ``node``.  Nulls and self matches are no matches, ends that
    aren't nodes are left out, repeated nodes count once.  Each round decides at least the least undecided node, and in
    match graphs of texts nearly all; rounds are cut by written tables.
    """
    scratch = Scratch(nodes.sparkSession)
    ids = nodes.select(F.col(node).alias("id")).filter("id is not null").distinct()
    pairs = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).filter(F.col("lo") < F.col("hi")).distinct()
    live = scratch.keep(pairs.join(ids.withColumnRenamed("id", "lo"), "lo", "left_semi").join(ids.withColumnRenamed("id", "hi"), "hi", "left_semi"))
    every = live
    waiting = scratch.keep(live.select(F.col("lo").alias("id")).unionByName(live.select(F.col("hi").alias("id"))).distinct())
    leaders = scratch.keep(ids.join(waiting, "id", "left_anti"))
    while not live.isEmpty():
        smaller = live.select(F.col("hi").alias("id")).distinct()
        new = scratch.keep(waiting.join(smaller, "id", "left_anti"))
        taken = live.join(new.withColumnRenamed("id", "lo"), "lo", "left_semi").select(F.col("hi").alias("id")).distinct()
        leaders = leaders.unionByName(new)
        rest = scratch.keep(waiting.join(new, "id", "left_anti").join(taken, "id", "left_anti"))
        left = scratch.keep(live.join(rest.withColumnRenamed("id", "lo"), "lo", "left_semi").join(rest.withColumnRenamed("id", "hi"), "hi", "left_semi"))
        if live is not every:
            scratch.drop(live)
        scratch.drop(waiting)
        live, waiting = left, rest
    leaders = scratch.keep(leaders.unionByName(waiting))
    led = every.join(leaders.withColumnRenamed("id", "lo"), "lo", "left_semi").groupBy("hi").agg(F.min("lo").alias("leader"))
    joined = ids.join(leaders.withColumn("is_leader", F.lit(True)), "id", "left").join(led, ids["id"] == led["hi"], "left")
    return joined.select(ids["id"].alias(node), F.when(F.col("is_leader"), ids["id"]).otherwise(F.col("leader")).alias("leader"))


def key_leaders(members: DataFrame, node: str, key: str) -> DataFrame:
    """``node, leader`` as of ``leader_clusters``, where two nodes match if they share a ``key``.

    No pair is ever built: a node is a leader if it is the least undecided one of each of its keys, and every node that shares
    a key with a leader is decided.  No two leaders share a key, so each key names one leader, and a node belongs to the least
    leader of its keys.  Work is linear in the rows of ``members``, whatever the size of a key.  Nodes with only null keys
    lead themselves; null nodes are left out; repeated rows count once.
    """
    scratch = Scratch(members.sparkSession)
    every = scratch.keep(members.select(F.col(node).alias("id"), F.col(key).alias("key")).filter("id is not null").distinct())
    ids = every.select("id").distinct()
    live = keyed = every.filter("key is not null")
    leaders = ids.join(keyed.select("id"), "id", "left_anti")
    while not live.isEmpty():
        marked = live.join(live.groupBy("key").agg(F.min("id").alias("first")), "key")
        new = scratch.keep(marked.groupBy("id").agg(F.bool_and(F.col("id") == F.col("first")).alias("leads")).filter("leads").select("id"))
        held = live.join(new, "id", "left_semi").select("key")
        decided = live.join(held, "key", "left_semi").select("id").distinct()
        left = scratch.keep(live.join(decided, "id", "left_anti"))
        scratch.drop(live)
        live, leaders = left, leaders.unionByName(new)
    leaders = scratch.keep(leaders)
    of_key = keyed.join(leaders, "id", "left_semi").select("key", F.col("id").alias("leader"))
    taken = keyed.join(of_key, "key").groupBy("id").agg(F.min("leader").alias("leader"))
    return ids.join(taken, "id", "left").select(F.col("id").alias(node), F.coalesce("leader", "id").alias("leader"))
