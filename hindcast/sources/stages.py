"""Stage tables of a run: a finished stage is a written table and a line in a log, so a run can be taken up again anywhere."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hindcast.runtime import exists

LOG = "run_id string, stage string, ordinal int, written_at timestamp_ntz, path string"


class Stages:
    """Stages of runs below ``base``, a folder all executors share, in the order of ``names``.

    The log line is written after its table: a stage whose writer died has no line and counts as not done.  The log holds one
    row a stage written; no row of a table passes through the driver.
    """

    def __init__(self, spark: SparkSession, base: str, names: list[str]):
        self.spark, self.base, self.names = spark, base.rstrip("/"), names

    def log(self) -> DataFrame:
        """All finished stages; empty if no log was written yet.  A log that can't be read is an error."""
        path = f"{self.base}/log"
        return self.spark.read.schema(LOG).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], LOG)

    def save(self, run_id: str, stage: str, df: DataFrame, at: dt.datetime | None = None) -> DataFrame:
        """Write a stage and return it read again; a later save of the same stage replaces it for readers."""
        at = at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        path = f"{self.base}/{run_id}/{stage}-{at:%Y%m%dT%H%M%S%f}"
        df.write.parquet(path)
        self.spark.createDataFrame([(run_id, stage, self.names.index(stage), at, path)], LOG).coalesce(1).write.mode("append").parquet(f"{self.base}/log")
        return self.spark.read.schema(df.schema).parquet(path)

    def latest(self, run_id: str) -> tuple[str, DataFrame] | None:
        """The most advanced stage of a run with its table, or None."""
        row = self.log().filter(F.col("run_id") == run_id).orderBy(F.desc("ordinal"), F.desc("written_at")).first()
        return (row.stage, self.spark.read.parquet(row.path)) if row else None

    def next_stage(self, run_id: str) -> str | None:
        """The stage to run next: the one after the latest, the first of a new run, None after the last."""
        done = self.latest(run_id)
        at = self.names.index(done[0]) + 1 if done else 0
        return self.names[at] if at < len(self.names) else None

    def stale(self, keep: int = 3) -> DataFrame:
        """``run_id, path``: tables beyond the ``keep`` newest of each run."""
        w = Window.partitionBy("run_id").orderBy(F.desc("written_at"), F.desc("ordinal"))
        return self.log().withColumn("age", F.row_number().over(w)).filter(F.col("age") > keep).select("run_id", "path")

    def remaining(self, run_id: str, stage: str, work: DataFrame, key: str) -> DataFrame:
        """Rows of ``work`` whose key no saved part of the stage holds: the work left after an interruption."""
        paths = [r.path for r in self.log().filter((F.col("run_id") == run_id) & (F.col("stage") == stage)).select("path").collect()]
        return work.join(self.spark.read.parquet(*paths).select(key), key, "left_anti") if paths else work
