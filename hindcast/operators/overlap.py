"""Pairs of texts that share most of their words, and leaders among such texts, by a prefix filter instead of all pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.runtime import Scratch

SLACK = 1e-9
#: Words of the shorter text up to which a pair meets in two words, if it must share two; a longer text has too many pairs of words.
TWO = 48


def prefix_keys(least: float) -> str:
    """SQL of the join keys of a text ``w`` (words in order of rarity) in block ``block``: structs of ``at`` and ``skip``.

    A pair meets in k words, k by the size of its shorter text, so a text has keys for each size that the shorter can have.
    Texts alike share k of each other's first ``n - ceil(n * least) + k`` words.  ``skip`` has the words before the key's last
    one that are not in the key: two texts meet in their first common words only where these lists have nothing in common.
    """
    need = lambda n: f"int(ceil({n} * {least!r}D - {SLACK!r}D))"
    level = f"array_distinct(transform(sequence({need('size(w)')}, size(w)), m -> IF(m <= {TWO} AND {need('m')} >= 2, 2, 1)))"
    first = f"(size(w) - {need('size(w)')} + 1)"
    one = f"transform(sequence(1, {first}), i -> named_struct('at', xxhash64(block, w[i - 1]), 'skip', slice(w, 1, i - 1)))"
    two = f"""flatten(transform(sequence(1, {first}), i -> transform(sequence(i + 1, {first} + 1), j ->
        named_struct('at', xxhash64(block, w[i - 1], w[j - 1]), 'skip', concat(slice(w, 1, i - 1), slice(w, i + 1, j - i - 1))))))"""
    return f"flatten(transform({level}, k -> IF(k = 2, {two}, {one})))"


def coded(items: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, w, bits0, bits1``: the words of each of ``items`` (id, words) as numbers, the rarest first, and as 128 bits."""
    long = items.select("id", F.explode("words").alias("word"))
    codes = scratch.keep(long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).withColumn("code", F.monotonically_increasing_id()))
    ordered = long.join(codes, "word").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "code"))), lambda x: x["code"]).alias("w"))
    bits = lambda half: F.expr(f"aggregate(filter(w, x -> pmod(xxhash64(x), 128) div 64 = {half}), 0L, (b, x) -> b | shiftleft(1L, int(pmod(xxhash64(x), 64))))").alias(f"bits{half}")
    return ordered.select("id", "w", bits(0), bits(1))


def near_enough(least: float) -> str:
    """SQL of whether the sizes and bits of texts ``l`` and ``r`` leave it open that they share ``least`` of the longer one's words."""
    longer = "greatest(size(l.w), size(r.w))"
    return f"""least(size(l.w), size(r.w)) >= {least!r}D * {longer} - {SLACK!r}D
        AND bit_count(l.bits0 ^ r.bits0) + bit_count(l.bits1 ^ r.bits1) <= size(l.w) + size(r.w) - 2 * ceil({least!r}D * {longer} - {SLACK!r}D)"""


def shared(least: float) -> str:
    """SQL of whether texts ``l`` and ``r`` share ``least`` of the longer one's words."""
    return f"size(array_intersect(l.w, r.w)) >= {least!r}D * greatest(size(l.w), size(r.w)) - {SLACK!r}D"


def overlap_pairs(items: DataFrame, least: float) -> DataFrame:
    """``a < b, words_a, words_b, share``: pairs of items that share at least ``least`` of the words of the longer one.

    ``items``: ``key`` (unique), ``words`` (distinct words), ``here`` (its block) and ``near`` (blocks in which it may find
    partners; of the items of one block, all have it among these or none).  With words in order of rarity, texts that are alike
    share the first of their words, so only these, two at a time, are join keys.  Rows carry the words as numbers and are
    verified where they meet: sizes first, then 128 bits that differ in no more places than there are different words, then
    the words themselves.  A pair leaves only from its first common words, as two numbers and the share.  Items without words
    or with nulls are in no pair.  The join is a merge join by hint: Spark's estimate of a side's size leaves out
    that its rows are exploded from ``texts``, so it would broadcast millions of keys.  Where all items look for partners in
    their own block only, both sides are the same rows, which Spark shuffles once.
    """
    scratch = Scratch(items.sparkSession)
    ready = scratch.keep(items.dropna().filter("size(words) > 0").withColumn("id", F.monotonically_increasing_id()))
    texts = scratch.keep(coded(ready, scratch).join(ready.select("id", "here", "near"), "id"))
    carried = ["id", "w", "bits0", "bits1"]
    rows = lambda df, *more: df.select(*carried, *more, F.explode(F.expr(prefix_keys(least))).alias("k")).select(*carried, *more, "k.at", "k.skip")
    left = rows(texts.withColumn("block", F.col("here")))
    if ready.filter("NOT near <=> array(here)").isEmpty():
        right, order = left, "l.id < r.id"
    else:
        right, order = rows(texts.withColumn("block", F.explode("near")).withColumn("home", F.col("block") == F.col("here")), "home"), "IF(r.home, l.id < r.id, l.id <> r.id)"
    met = left.alias("l").join(right.alias("r").hint("merge"), F.expr(f"l.at = r.at AND {order} AND {near_enough(least)} AND NOT arrays_overlap(l.skip, r.skip) AND {shared(least)}"))
    share = F.expr("size(array_intersect(l.w, r.w)) / greatest(size(l.w), size(r.w))").alias("share")
    pairs = met.select(F.least("l.id", "r.id").alias("x"), F.greatest("l.id", "r.id").alias("y"), share).repartition("x").dropDuplicates(["x", "y"])
    side = lambda i, n: ready.select(F.col("id").alias(i), F.col("key").alias(f"key_{n}"), F.col("words").alias(f"words_{n}"))
    named = pairs.join(side("x", "x"), "x").join(side("y", "y"), "y")
    turned = F.col("key_x") > F.col("key_y")
    pick = lambda c, d: F.when(turned, F.col(d)).otherwise(F.col(c))
    return named.select(pick("key_x", "key_y").alias("a"), pick("key_y", "key_x").alias("b"), pick("words_x", "words_y").alias("words_a"), pick("words_y", "words_x").alias("words_b"), "share")


def overlap_leaders(items: DataFrame, least: float) -> DataFrame:
    """``id, leader``: items in order of ``id``, each kept unless it shares ``least`` of the words of the longer one with a kept one.

    ``items``: ``id`` (unique) and ``words`` (distinct words).  Only items that aren't kept are in the result, with the least kept
    one they match.  These are the rounds of ``leader_clusters`` without its edges, of which there may be as many as the square of
    the items: each round finds in the joins themselves which items have an earlier match, and the least new leader of each
    item, so what is written is in proportion to the items.
    """
    scratch = Scratch(items.sparkSession)
    texts = scratch.keep(coded(items, scratch))
    keys = F.expr(f"array_distinct(transform({prefix_keys(least)}, k -> k.at))")
    rows = lambda df: df.withColumn("block", F.lit(0)).select("id", "w", "bits0", "bits1", F.explode(keys).alias("at"))
    match = lambda order: F.expr(f"l.at = r.at AND l.id {order} r.id AND {near_enough(least)} AND {shared(least)}")
    having = lambda df, order: rows(df).alias("l").join(rows(df).alias("r"), match(order), "left_semi").select(F.col("l.id").alias("id"))
    ends = scratch.keep(having(texts, ">").withColumn("late", F.lit(True)).unionByName(having(texts, "<").withColumn("late", F.lit(False))).distinct())
    late = ends.filter("late").select("id")
    members = waiting = scratch.keep(texts.join(late, "id", "left_semi"))
    new = scratch.keep(texts.join(ends.filter("NOT late").select("id"), "id", "left_semi").join(late, "id", "left_anti"))
    scratch.drop(texts, ends)
    taken = []
    while True:
        met = rows(members).alias("l").join(rows(new).alias("r"), match(">"))
        taken.append(scratch.keep(met.groupBy(F.col("l.id").alias("id")).agg(F.min("r.id").alias("leader"))))
        rest = scratch.keep(waiting.join(taken[-1], "id", "left_anti"))
        scratch.drop(new, *(() if waiting is members else (waiting,)))
        if rest.isEmpty():
            scratch.drop(members, rest)
            return reduce(DataFrame.unionByName, taken).groupBy("id").agg(F.min("leader").alias("leader"))
        late = scratch.keep(having(rest, ">").distinct())
        new, waiting = scratch.keep(rest.join(late, "id", "left_anti")), scratch.keep(rest.join(late, "id", "left_semi"))
        scratch.drop(rest, late)
