"""Attributes as they were known: a join with two times.

Method: events and attribute versions of one entity are co-grouped, and for all events at once a binary search finds the
latest version that was valid at the event's time among those recorded by its knowledge time.  Versions are sorted by
(valid_from, recorded, id); a table of least recorded times over blocks of 2^k versions lets the search step back over whole
blocks that were all recorded too late.

Equal events of an entity are looked up once.  Entities with many events are split over salts; only their versions are
repeated, once a salt.  An entity with many versions is cut into ranges of days: an event meets the range of its own day and the
latest earlier range with a version recorded in time, which the same search finds among the least recorded times of the ranges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Different events of an entity that one task looks up.
EVENTS_PER_SALT = 100_000

#: Versions with different times from which an entity is cut into ranges of so many days.  A range holds at most as many versions
#: as there are days on which one was recorded, times its days.
VERSIONS_PER_RANGE, RANGE_DAYS = 100_000, 16


def latest_known(valid: np.ndarray, recorded: np.ndarray, event: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Position of the last version with valid <= event and recorded <= known, or -1; versions sorted by valid, recorded."""
    least = [recorded]
    while len(least[-1]) > 1:
        last = least[-1]
        odd = np.append(last, last[-1:]) if len(last) % 2 else last
        least.append(np.minimum(odd[0::2], odd[1::2]))
    at = np.searchsorted(valid, event, side="right")
    # climb: [0, at) is cut into aligned blocks from the right; stop at the first block with a version recorded in time
    found = np.full(len(event), -1)
    level = np.zeros(len(event), int)
    end = at.copy()
    open_ = end > 0
    block_level = np.full(len(event), -1)
    for k in range(len(least)):
        take = open_ & (((end >> k) & 1) == 1) & (end > 0)
        block = (end >> k) - 1
        hit = take & (least[k][np.clip(block, 0, len(least[k]) - 1)] <= known)
        block_level[hit], found[hit] = k, block[hit]
        open_ &= ~hit
        miss = take & ~hit
        end[miss] -= 1 << k
        open_ &= end > 0
    # descend into the block, right half first
    for k in range(len(least) - 1, 0, -1):
        inside = block_level == k
        right = 2 * found[inside] + 1
        size = len(least[k - 1])
        ok = (right < size) & (least[k - 1][np.clip(right, 0, size - 1)] <= known[inside])
        found[inside] = np.where(ok, right, right - 1)
        block_level[inside] = k - 1
    return np.where(block_level == 0, found, -1)


def search(events: DataFrame, versions: DataFrame, by: list[str]) -> DataFrame:
    """Rows of ``events`` (``by``, event, known and others) with the ``version`` (``by``, valid, recorded, version) that each finds."""
    counted = events.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / EVENTS_PER_SALT).cast("int").alias("salts"))
    left = events.join(counted, by).withColumn("salt", F.pmod(F.xxhash64(*events.columns), F.col("salts")).cast("int")).drop("salts")
    right = versions.join(counted, by).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    def look(e: pa.Table, v: pa.Table) -> pa.Table:
        v = v.sort_by([("valid", "ascending"), ("recorded", "ascending"), ("version", "ascending")])
        column = lambda t, name: t.column(name).to_numpy()
        at = latest_known(column(v, "valid"), column(v, "recorded"), column(e, "event"), column(e, "known")) if len(e) and len(v) else np.full(len(e), -1)
        hit = np.flatnonzero(at >= 0)
        return e.drop(["salt"]).take(pa.array(hit)).append_column("version", v.column("version").take(pa.array(at[hit])))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in [*events.schema, versions.schema["version"]])
    return left.groupBy(*by, "salt").cogroup(right.groupBy(*by, "salt")).applyInArrow(look, schema)


def as_known_join(
    events: DataFrame, versions: DataFrame, entity: str, event_time: str, known_time: str, valid_from: str, recorded: str, version_id: str, per_range: int = VERSIONS_PER_RANGE
) -> DataFrame:
    """Each distinct (entity, event_time, known_time) of ``events`` with the ``version_id`` valid and known then.

    Of several the latest ``valid_from``, then the latest ``recorded``, then the largest ``version_id`` counts.  Nulls in an
    entity or time match nothing; an event without a version has no row.  Times are dates.  Other columns are not read.
    An entity with more than ``per_range`` versions is searched range by range, with the same result.
    """
    days = lambda c: F.unix_date(F.to_date(c))
    wanted = events.select(F.col(entity).alias("entity"), days(event_time).alias("event"), days(known_time).alias("known")).dropna().distinct()
    kept = (
        versions.select(F.col(entity).alias("entity"), days(valid_from).alias("valid"), days(recorded).alias("recorded"), F.col(version_id).alias("version"))
        .dropna()
        .groupBy("entity", "valid", "recorded")
        .agg(F.max("version").alias("version"))
    )
    long = kept.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > per_range).select("entity")
    short = search(wanted.join(long, "entity", "left_anti"), kept.join(long, "entity", "left_anti"), ["entity"])

    range_of = lambda c: F.floor(F.col(c) / RANGE_DAYS).cast("int")
    cut = kept.join(long, "entity", "left_semi").withColumn("range", range_of("valid"))
    own = wanted.join(long, "entity", "left_semi").withColumn("range", range_of("event"))
    ranges = cut.groupBy("entity", "range").agg(F.min("recorded").alias("recorded")).select("entity", F.col("range").alias("valid"), "recorded", F.col("range").alias("version"))
    before = search(own.select("entity", (F.col("range") - 1).alias("event"), "known", F.col("event").alias("day")), ranges, ["entity"])
    asked = own.unionByName(before.select("entity", F.col("day").alias("event"), "known", F.col("version").alias("range")))
    in_ranges = search(asked, cut, ["entity", "range"]).groupBy("entity", "event", "known").agg(F.max_by("version", "range").alias("version"))

    found = short.unionByName(in_ranges)
    return found.select(F.col("entity").alias(entity), F.date_from_unix_date("event").alias(event_time), F.date_from_unix_date("known").alias(known_time), F.col("version").alias(version_id))
