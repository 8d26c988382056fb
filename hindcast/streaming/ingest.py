"""Record files as a stream into the index, and daily counts while they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from hindcast.sources.files import append_absent


def deliveries(spark: SparkSession, source: str, schema: StructType, files: int = 64) -> DataFrame:
    """Parquet files of ``source`` (a folder or a pattern) as a stream, ``files`` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)


def follow(stream: DataFrame, index: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Append each batch of ``stream`` to the record index; without an ``interval`` what is there is taken and the query ends.

    The index itself tells which records are known, so a batch that is run again after a failure adds nothing twice, and no
    state grows with the ids seen.  A record delivered again, however late, is left out.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: append_absent(batch, index))
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def daily(stream: DataFrame, late: str = "40 days") -> DataFrame:
    """Stream of ``day, n``: deliveries of visible records by the day of ingestion, counted while they come.

    A day is closed ``late`` after the newest ingestion; later deliveries of it are left to the index.  State is one row an
    open day.  Deliveries are counted, not different records.
    """
    timed = stream.filter("date_confidence <> 'uncertain'").withColumn("at", F.to_timestamp("ingestion_date")).withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 day").alias("day")).agg(F.count(F.lit(1)).alias("n")).select(F.to_date("day.start").alias("day"), "n")
