"""What every operator needs from the session: tables, checkpoints and partition counts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the directory ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate results.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset in a local session is a temporary folder made;
    on a cluster that fails, as executors would write to their own disks and others wouldn't find the rows.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    found = spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-hindcast-"))
    return spark.sparkContext.getCheckpointDir()


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of ``path`` and the path as it wants it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at ``path``; an empty folder is nothing."""
    files, target = file_system(spark, path)
    return files.exists(target) and len(files.listStatus(target)) > 0


class Scratch:
    """Tables written to the shared checkpoint folder, which cut the lineage and survive the loss of executors.

    ``keep`` writes a DataFrame and returns it read again.  ``drop`` removes tables that no later step reads.  What a result
    still reads is removed when the driver's session ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{checkpoint_dir(spark)}/hindcast-{uuid.uuid4().hex}"
        self.count = 0
        self.kept: list[tuple[DataFrame, str]] = []
        files, target = file_system(spark, self.base)
        files.mkdirs(target)
        files.deleteOnExit(target)

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.base}/t{self.count}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.kept.append((kept, path))
        return kept

    def drop(self, *tables: DataFrame) -> None:
        for _, path in (x for x in self.kept if any(x[0] is t for t in tables)):
            files, target = file_system(self.spark, path)
            files.delete(target, True)
        self.kept = [x for x in self.kept if not any(x[0] is t for t in tables)]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(df: DataFrame, key: str, rows: int, parts: int = 1000) -> DataFrame:
    """Keys that hold more than ``1/parts`` of ``rows`` rows.

    By counting there are fewer than ``parts`` of them, whatever the size of the data, so the result may be broadcast.
    """
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") * parts > F.lit(rows)).select(key, "n_rows")


def pairs_within(df: DataFrame, key: str, value: str, a: str, b: str, rows: int = 2000) -> DataFrame:
    """``key, a, b`` with ``a`` < ``b``: all pairs of different values that share a key, which no task enumerates for a key alone.

    Keys are counted first (partial counts a task); one of n rows is spread over ``ceil(n / rows)`` salts, each of which meets
    all of its rows.  Null keys and values are in no pair.  Meant for keys whose pairs are all wanted.
    """
    several = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_of_key")).filter("n_of_key > 1")
    salted = df.select(key, value).join(several, key).withColumn("salts", F.ceil(F.col("n_of_key") / rows).cast("int"))
    left = salted.select(key, F.pmod(F.xxhash64(value), F.col("salts")).cast("int").alias("salt"), F.col(value).alias(a))
    right = salted.select(key, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col(value).alias(b))
    return left.join(right, [key, "salt"]).filter(F.col(a) < F.col(b)).select(key, a, b)


def split_join(left: DataFrame, right: DataFrame, key: str, rows: int = 20_000) -> DataFrame:
    """Inner join on ``key`` in which no task has more than about ``rows`` rows of ``left`` for one key.

    Keys are counted first (partial counts a task).  One with n rows in ``left`` is spread over ``ceil(n / rows)`` salts, on each
    of which ``right`` has all of its rows.  Null keys match nothing; the tables share no other column.
    """
    counted = left.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("salts"))
    spread = left.join(counted, key).withColumn("salt", F.pmod(F.xxhash64(*left.columns), F.col("salts")).cast("int")).drop("salts")
    repeated = right.join(counted, key).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return spread.join(repeated, [key, "salt"]).drop("salt")
