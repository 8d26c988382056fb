"""Documents put into context windows with as little unused room as possible.

Method: minimum bin slack.  Each window takes the largest item that is left and the multiset of remaining sizes whose sum comes
closest to the window's capacity.  Which sums can be reached is a bitset of one bit per token, shifted and joined size by size;
walking back through the bitsets gives how many items of each size to take.  As many equal windows as the counts allow are
closed at once.

Items are dealt to shards by a hash, each shard is packed by itself from its histogram of sizes (never more distinct sizes than
the capacity), and windows that stay emptier than ``LOOSE`` are opened again and packed once more in fewer shards, so that
the rest of a shard isn't wasted.  A document larger than the window is split into full windows and one rest, which is an
item like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.runtime import Scratch

#: Tokens of a shard, as a multiple of the capacity: the most that one task packs at a time.
SHARD_WINDOWS = 500
#: Share of unused room above which a window of the first pass is packed again.
LOOSE = 0.005
#: Salt buckets of the second pass per that of the first.
MERGE = 16


def fill(sizes: list[int], counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(size, how many) of the multiset of available ``sizes`` (descending) with the largest sum up to ``room``."""
    mask = (1 << (room + 1)) - 1
    reach = 1
    steps: list[tuple[int, int, list[int]]] = []
    for size in sizes:
        if size > room:
            continue
        able = min(counts[size], room // size)
        befores = []
        taken = 0
        while taken < able:
            after = reach | (reach << size) & mask
            if after == reach:
                break
            befores.append(reach)
            reach = after
            taken += 1
        if befores:
            steps.append((size, taken, befores))
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    picked = []
    for size, _, befores in reversed(steps):
        n = 0
        for before in reversed(befores):
            if not before >> at & 1:
                at -= size
                n += 1
        if n:
            picked.append((size, n))
        if not at:
            break
    return picked


def minimum_slack(counts: dict[int, int], capacity: int) -> Iterator[tuple[list[tuple[int, int]], int]]:
    """Windows as ([(size, how many)], number of windows like this) until every item of ``counts`` is placed."""
    counts = {s: n for s, n in counts.items() if n}
    sizes = sorted(counts, reverse=True)
    while sizes:
        top = sizes[0]
        counts[top] -= 1
        rest = fill(sizes if counts[top] else sizes[1:], counts, capacity - top)
        counts[top] += 1
        need: dict[int, int] = {top: 1}
        for size, n in rest:
            need[size] = need.get(size, 0) + n
        times = min(counts[s] // n for s, n in need.items())
        for s, n in need.items():
            counts[s] -= n * times
            if not counts[s]:
                sizes.remove(s)
        yield list(need.items()), times


def pack_shard(items: pd.DataFrame, capacity: int) -> tuple[list[int], list[int]]:
    """Window number of each item and used tokens of each window; ``items`` has ``n`` (size)."""
    waiting: dict[int, list[int]] = {}
    for at, size in enumerate(items["n"].tolist()):
        waiting.setdefault(size, []).append(at)
    number, window, used = [0] * len(items), 0, []
    for content, times in minimum_slack({s: len(x) for s, x in waiting.items()}, capacity):
        for _ in range(times):
            for size, n in content:
                for _ in range(n):
                    number[waiting[size].pop()] = window
            used.append(sum(s * n for s, n in content))
            window += 1
    return number, used


PACKED = "model_id string, capacity int, shard long, window_no int, used int, doc_id {kind}, start int, n int"


def pack_pass(items: DataFrame, kind: str) -> DataFrame:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start"], kind="stable").reset_index(drop=True)
        number, used = pack_shard(pdf, int(pdf["capacity"].iloc[0]))
        return pdf.assign(window_no=number, used=[used[w] for w in number])[["model_id", "capacity", "shard", "window_no", "used", "doc_id", "start", "n"]]

    return items.groupBy("model_id", "capacity", "shard").applyInPandas(one, PACKED.format(kind=kind))


def pack_windows(sizes: DataFrame, windows: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """``model_id, window_id, doc_id, token_start, token_count``: where every token of every document goes.

    ``sizes`` has one size for each document, ``windows`` ``model_id`` and ``window_tokens``.  A document no larger than the
    window is in one window whole; a larger one fills windows and leaves a rest.  Documents without a token, with a null size
    or a null id have no row; windows with a null or no capacity take nothing.  A repeated id is placed as often as it is there.
    The number of shards follows the sum of all sizes, so a task holds a bounded number of items at any scale: none takes more
    than about ``SHARD_WINDOWS`` windows.  The models, a few rows, go through the driver; each document is repeated once a model.
    """
    scratch = Scratch(sizes.sparkSession)
    kind = sizes.select(id_col).schema[id_col].dataType.simpleString()
    docs = scratch.keep(sizes.select(F.col(id_col).alias("doc_id"), F.col(size_col).cast("int").alias("size")).filter("doc_id is not null and size > 0"))
    total = docs.agg(F.sum("size")).first()[0] or 0
    limits = windows.select("model_id", F.col("window_tokens").cast("int").alias("capacity")).filter("model_id is not null and capacity > 0").distinct().collect()
    asked = [F.struct(F.lit(r.model_id).alias("model_id"), F.lit(r.capacity).alias("capacity")) for r in limits]
    of_all = F.array(*asked) if asked else F.array().cast("array<struct<model_id string, capacity int>>")
    each = docs.withColumn("w", F.explode(of_all)).select("doc_id", "size", "w.model_id", "w.capacity")
    n_full = F.floor(F.col("size") / F.col("capacity")).cast("int")
    full = each.filter(F.col("size") >= F.col("capacity")).select(
        "model_id", "capacity", "doc_id", F.explode(F.transform(F.sequence(F.lit(0), n_full - 1), lambda i: i * F.col("capacity"))).alias("token_start"), F.col("capacity").alias("token_count")
    )
    shards = F.greatest(F.lit(1), F.ceil(F.lit(float(total)) / (F.col("capacity") * SHARD_WINDOWS))).cast("long")
    rest = (
        each.withColumn("start", n_full * F.col("capacity"))
        .withColumn("n", F.col("size") - F.col("start"))
        .filter("n > 0")
        .withColumn("shard", F.pmod(F.xxhash64("doc_id"), shards))
        .select("model_id", "capacity", "shard", "doc_id", "start", "n")
    )
    first = scratch.keep(pack_pass(rest, kind))
    is_loose = F.col("capacity") - F.col("used") > F.col("capacity") * LOOSE
    again = pack_pass(first.filter(is_loose).withColumn("shard", F.floor(F.col("shard") / MERGE)).select("model_id", "capacity", "shard", "doc_id", "start", "n"), kind)
    name = lambda of, *more: F.concat_ws("-", "model_id", F.lit(of), *more)
    columns = lambda w: ["model_id", w.alias("window_id"), "doc_id", F.col("start").alias("token_start"), F.col("n").alias("token_count")]
    return (
        full.select("model_id", name("f", "doc_id", "token_start").alias("window_id"), "doc_id", "token_start", "token_count")
        .unionByName(first.filter(~is_loose).select(*columns(name("a", "shard", "window_no"))))
        .unionByName(again.select(*columns(name("b", "shard", "window_no"))))
    )
