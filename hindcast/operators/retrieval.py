"""Date-bounded retrieval over event records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions.scalars import cosine_distance

FAR = 0.8


def one_of_each(events: DataFrame) -> DataFrame:
    """Records without repeated deliveries: the first ingested of each record_id."""
    w = Window.partitionBy("record_id").orderBy("ingestion_date")
    return events.withColumn("delivery", F.row_number().over(w)).filter("delivery = 1").drop("delivery")


def in_window(date: str, cutoff: str | Column, simulation: str | Column) -> Column:
    """Inclusive on both ends; a cutoff after the simulation leaves nothing."""
    return (F.col(date) >= cutoff) & (F.col(date) <= simulation)


def visible(events: DataFrame) -> DataFrame:
    """Records whose date isn't quarantined."""
    return events.filter("date_confidence <> 'uncertain'")


def by_month(events: DataFrame, requests: DataFrame, buckets: int = 8) -> DataFrame:
    """Requests (request_id, cutoff, simulation, ...) with the visible records of their window.

    An equi-join on the month and a bucket of the record's id: a busy month is spread over ``buckets`` tasks, on each of which
    the requests of its window are repeated.
    """
    every = F.explode(F.sequence(F.trunc("cutoff", "month"), F.trunc("simulation", "month"), F.expr("interval 1 month")))
    months = requests.withColumn("month", every).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    dated = visible(events).withColumn("month", F.trunc("event_date", "month")).withColumn("bucket", F.pmod(F.xxhash64("record_id"), F.lit(buckets)).cast("int"))
    return months.join(dated, ["month", "bucket"]).filter(in_window("event_date", F.col("cutoff"), F.col("simulation"))).drop("month", "bucket")


def first_of(rows: DataFrame, by: str, order: list, most: int, limit: str, place: str = "rank") -> DataFrame:
    """Rows of each ``by`` up to the number in its column ``limit``, numbered in ``order``.

    ``most``, the largest of these numbers, is a constant of the plan, so that each task keeps that many rows of a group before
    they are shuffled.
    """
    ranked = rows.withColumn(place, F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.filter(F.col(place) <= F.lit(most)).filter(F.col(place) <= F.col(limit))


def largest(df: DataFrame, column: str) -> int:
    """The largest value of an integer column, 0 of an empty one; one number goes to the driver."""
    return int(df.agg(F.max(column)).first()[0] or 0)


def top_k(events: DataFrame, requests: DataFrame) -> DataFrame:
    """``request_id, record_id, rank, distance``: the ``top_k`` nearest records that each request may see.

    ``requests``: request_id, cutoff, simulation, vector, topics (null or empty: any), top_k.  Ranked by distance times
    (2 - confidence), then record_id; records farther than FAR are left out.
    """
    ready = requests.filter("cutoff <= simulation and vector is not null")
    near = (
        by_month(events.select("record_id", "event_date", "date_confidence", "confidence", "topics", "embedding"), ready.withColumnRenamed("topics", "wanted"))
        .filter(F.coalesce(F.size("wanted"), F.lit(0)).isin(0, -1) | F.arrays_overlap("wanted", "topics"))
        .withColumn("distance", cosine_distance("vector", "embedding"))
        .filter(F.col("distance") <= FAR)
        .withColumn("weighed", F.round(F.col("distance") * (2 - F.col("confidence")), 9))
    )
    kept = first_of(near, "request_id", [F.col("weighed").asc_nulls_last(), F.col("record_id")], largest(requests, "top_k"), "top_k")
    return kept.select("request_id", "record_id", "rank", F.round("distance", 6).alias("distance"))


def window_counts(events: DataFrame, requests: DataFrame) -> DataFrame:
    """``request_id, n_in_window, n_quarantined``: counts ignore topic and distance.

    Records are counted by day and summed up along the calendar, which is as long as the dates go and doesn't grow with the
    rows; a request takes the difference of two sums, at its simulation and before its cutoff, however long its window is.
    Null dates are in no window; a request with a null date or a cutoff after its simulation counts 0.
    """
    days = events.groupBy("event_date").agg(F.count_if(F.col("date_confidence") != "uncertain").alias("n"), F.count_if(F.col("date_confidence") == "uncertain").alias("q"))
    ends = days.agg(F.min("event_date").alias("first"), F.max("event_date").alias("last"))
    calendar = ends.select(F.explode(F.sequence("first", "last")).alias("event_date"))
    so_far = Window.orderBy("event_date").rowsBetween(Window.unboundedPreceding, 0)
    sums = calendar.join(days, "event_date", "left").select(F.col("event_date").alias("day"), F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("n"), F.coalesce(F.sum("q").over(so_far), F.lit(0)).alias("q"))
    spans = requests.filter("cutoff <= simulation").select("request_id", "cutoff", "simulation").crossJoin(F.broadcast(ends))
    edges = F.array(F.struct(F.least("simulation", "last").alias("day"), F.lit(1).alias("sign")), F.struct(F.least(F.date_sub("cutoff", 1), "last").alias("day"), F.lit(-1).alias("sign")))
    looked = spans.select("request_id", F.inline(edges)).join(sums, "day")
    summed = looked.groupBy("request_id").agg(F.sum(F.col("sign") * F.col("n")).alias("n"), F.sum(F.col("sign") * F.col("q")).alias("q"))
    return requests.select("request_id").join(summed, "request_id", "left").select("request_id", F.coalesce("n", F.lit(0)).alias("n_in_window"), F.coalesce("q", F.lit(0)).alias("n_quarantined"))
