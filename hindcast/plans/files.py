"""Queries through written files: answers as JSON lines and the record index by month."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.functions.scalars import r6
from hindcast.runtime import Scratch, table
from hindcast.sources.files import append_absent, read_index, read_predictions, write_predictions
from hindcast.streaming.ingest import deliveries, follow


def jsonl_scan(spark: SparkSession, d: str) -> DataFrame:
    """All prediction rows written as JSON lines and read again with the declared schema, summed up by experiment."""
    path = f"{Scratch(spark).base}/lines"
    write_predictions(table(spark, d, "predictions"), path)
    p = read_predictions(spark, path)
    return p.groupBy("experiment").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("prediction_id").alias("n_ids"), F.max("created_at").cast("string").alias("last"), r6(F.avg("binary.probability")).alias("probability"), F.sum(F.size("action.probabilities")).alias("n_options")
    )


JSONL = """SELECT experiment, count(*) AS n, count(DISTINCT prediction_id) AS n_ids, CAST(max(created_at) AS VARCHAR) AS last, round(avg("binary".probability), 6) AS probability,
    CAST(sum(CASE WHEN "action".probabilities IS NOT NULL THEN len(map_keys("action".probabilities)) END) AS BIGINT) AS n_options FROM predictions GROUP BY 1"""


def record_index(spark: SparkSession, d: str) -> DataFrame:
    """Records by month in an index to which all deliveries were appended in two parts, each record once."""
    path, raw = f"{Scratch(spark).base}/index", table(spark, d, "event_records").drop("embedding")
    middle = F.lit("2025-01-01")
    append_absent(raw.filter(F.col("ingestion_date") < middle), path)
    append_absent(raw.filter(F.col("ingestion_date") >= middle), path)
    return read_index(spark, path, *ALL).groupBy(F.date_format("event_date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first"))


#: First and last month of an index, dated or not.
ALL = ("0000-00", "none")
INDEX = """WITH e AS (SELECT DISTINCT record_id, event_date FROM event_records) SELECT strftime(event_date, '%Y-%m') AS month, count(*) AS n, min(record_id) AS first FROM e GROUP BY 1"""


def streamed_index(spark: SparkSession, d: str) -> DataFrame:
    """The same of an index that a stream of the record files filled."""
    base, given = Scratch(spark).base, table(spark, d, "event_records")
    follow(deliveries(spark, f"{d}/event_records.parque[t]", given.schema), f"{base}/index", f"{base}/state").awaitTermination()
    return read_index(spark, f"{base}/index", *ALL).groupBy(F.date_format("event_date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first"))


QUERIES = {"jsonl_scan": (jsonl_scan, JSONL), "record_index": (record_index, INDEX), "streamed_index": (streamed_index, INDEX)}
