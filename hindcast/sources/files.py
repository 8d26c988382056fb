"""Readers and writers with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.runtime import exists

#: Layout of a prediction line.
PREDICTION = (
    "prediction_id bigint, question_id string, experiment string, sample_idx int, question_format string, model_id string, temperature double, prompt_hash string, briefing_hash string, "
    "binary struct<probability: double, reasoning: string>, action struct<probabilities: map<string, double>, reasoning: string>, raw_response string, tokens_in bigint, tokens_out bigint, "
    "latency_ms bigint, created_at timestamp_ntz, error string"
)

MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def read_predictions(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Prediction lines of a file or of all files in a folder.

    Blank lines are skipped.  ``strict`` fails on a line that is no object; otherwise such lines give rows of nulls.
    """
    return spark.read.schema(PREDICTION).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """Append prediction lines, one folder an experiment, so that a reader of one experiment opens no other's files.

    Nulls are left out of a line and come back as nulls; times keep their microseconds.
    """
    lines = df.withColumn("in_experiment", F.col("experiment")).write.mode("append").partitionBy("in_experiment")
    lines.option("timestampNTZFormat", MICROS).option("timestampFormat", MICROS).json(path)


def read_keyed(spark: SparkSession, path: str, field: str, row_schema: str, key: str) -> DataFrame:
    """Rows of the array ``field`` of JSON documents, one a ``key``; of repeated keys the last counts, null keys are left out.

    One document is parsed by one task, as its format demands; many documents spread over tasks.
    """
    whole = spark.read.schema(f"{field} array<struct<{row_schema}>>").option("multiLine", True).json(path)
    rows = whole.select(F.input_file_name().alias("file"), F.posexplode(field).alias("pos", "row")).filter(F.col("row")[key].isNotNull())
    return rows.groupBy(F.col("row")[key].alias("k")).agg(F.max_by("row", F.struct("file", "pos")).alias("row")).select("row.*")


def write_keyed(df: DataFrame, path: str, *parts: str) -> None:
    """A table as JSON lines, the scalable form of a keyed document; with ``parts`` a folder for each value of these columns."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*parts) if parts else writer).json(path)


def read_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at ``path``, or an empty one of ``schema`` if nothing was written there yet."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def append_keyed(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose ``keys`` the table at ``path`` lacks: a cache that keeps what it has."""
    new = df.join(df.sparkSession.read.parquet(path).select(*keys), keys, "left_anti") if exists(df.sparkSession, path) else df
    new.write.mode("append").parquet(path)


def append_absent(records: DataFrame, path: str, files_a_month: int = 4, moving: bool = False) -> None:
    """Append those records whose id the index at ``path`` lacks, by month of the event, each id once.

    Of rows with one id the first ingested is kept.  The index's ids are the only column read, and of the batch's months only:
    an id that was given is not dated anew (``moving``: it may be, and all months are read).  A month is spread over
    ``files_a_month`` tasks by id, so that a busy month isn't one task's work.  Records without a date go to a month of their own.
    """
    spark = records.sparkSession
    month = F.coalesce(F.date_format("event_date", "yyyy-MM"), F.lit("none"))
    new = records.filter("record_id is not null").groupBy("record_id").agg(F.min_by(F.struct("*"), F.struct("ingestion_date")).alias("r")).select("r.*")
    if exists(spark, path):
        known = spark.read.parquet(path)
        if not moving:
            months = [r.m for r in records.select(month.alias("m")).distinct().collect()]  # as many as the calendar has
            known = known.filter(F.col("event_month").cast("string").isin(months))
        new = new.join(known.select("record_id"), "record_id", "left_anti")
    spread = new.withColumn("event_month", month).repartition("event_month", F.pmod(F.xxhash64("record_id"), F.lit(files_a_month)))
    spread.write.mode("append").partitionBy("event_month").parquet(path)


def read_index(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """Records of the months ``first`` to ``last`` (yyyy-MM, both inclusive); other months' folders are not opened."""
    return spark.read.parquet(path).filter(F.col("event_month").between(first, last))


def markdown(df: DataFrame, order: list[str], digits: int = 4) -> DataFrame:
    """``line_no, line``: a small result table as the rows of a Markdown table, numbered from 1 in the order of ``order``.

    Nulls are shown as a dash, floats with ``digits`` places.  Meant for summaries: numbering needs one ordered window.
    """
    from pyspark.sql import Window

    shown = [F.format_string(f"%.{digits}f", c) if t in ("double", "float") else F.col(c).cast("string") for c, t in df.dtypes]
    cells = F.concat_ws(" | ", *(F.when(F.col(c).isNull(), "-").otherwise(s) for s, c in zip(shown, df.columns)))
    return df.select(F.row_number().over(Window.orderBy(*order)).alias("line_no"), F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))
