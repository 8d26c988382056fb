"""Records returned by requests, with the lead actor's attributes as known at the request's time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.operators.asof import as_known_join
from hindcast.runtime import table


def known_hits(hits: DataFrame, requests: DataFrame, events: DataFrame) -> DataFrame:
    """``request_id, record_id, actor_id, event_date, simulation_date`` of each different hit that may be used then.

    The record exists, is dated no later than the simulation, has a source published by then and a lead actor.
    """
    wanted = hits.select("request_id", "record_id").distinct().join(requests.select("request_id", "simulation_date").distinct(), "request_id")
    facts = events.select(
        "record_id", "event_date", F.get("actors", F.lit(0)).alias("actor_id"), F.array_min(F.transform("sources", lambda s: s["pub_date"])).alias("first_source")
    ).filter("actor_id is not null and first_source is not null")
    lead = facts.groupBy("record_id", "event_date", "actor_id").agg(F.min("first_source").alias("first_source"))
    return (
        wanted.join(lead, "record_id")
        .filter("event_date <= simulation_date and first_source <= simulation_date")
        .select("request_id", "record_id", "actor_id", "event_date", "simulation_date")
        .distinct()
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    hits = known_hits(table(spark, d, "retrieval_hits"), table(spark, d, "retrieval_requests"), table(spark, d, "event_records"))
    versions = table(spark, d, "actor_profiles").select("actor_id", "valid_from", F.col("source.pub_date").alias("pub_date"), "profile_id")
    known = as_known_join(hits, versions, "actor_id", "event_date", "simulation_date", "valid_from", "pub_date", "profile_id")
    return hits.join(known, ["actor_id", "event_date", "simulation_date"]).select("request_id", "record_id", "profile_id")


P2_FOUND_SQL = """
    WITH h AS (SELECT DISTINCT request_id, record_id FROM retrieval_hits), r AS (SELECT DISTINCT request_id, simulation_date FROM retrieval_requests),
    e AS (SELECT DISTINCT record_id, event_date, actors[1] AS actor_id, list_min(list_transform(sources, lambda s: s.pub_date)) AS first_source FROM event_records),
    w AS (SELECT DISTINCT request_id, record_id, actor_id, event_date, simulation_date FROM h JOIN r USING (request_id) JOIN e USING (record_id)
          WHERE event_date <= simulation_date AND first_source <= simulation_date AND actor_id IS NOT NULL),
    p AS (SELECT DISTINCT profile_id, actor_id, valid_from, source.pub_date AS pub_date FROM actor_profiles)
    SELECT request_id, record_id, profile_id FROM (
      SELECT w.request_id, w.record_id, p.profile_id,
             row_number() OVER (PARTITION BY w.request_id, w.record_id ORDER BY p.valid_from DESC, p.pub_date DESC, p.profile_id DESC) AS rn
      FROM w JOIN p ON p.actor_id = w.actor_id AND p.valid_from <= w.event_date AND p.pub_date <= w.simulation_date) WHERE rn = 1"""
