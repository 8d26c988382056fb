from pyspark.sql import functions as F

from hindcast.streaming.ingest import daily, deliveries, follow


def test_follow_adds_each_record_once(spark, sf, tmp_path):
    given = spark.read.parquet(f"{sf}/event_records.parquet")
    source, index, state = (str(tmp_path / n) for n in ("in", "index", "state"))
    given.repartition(5).write.parquet(source)
    follow(deliveries(spark, source, given.schema, files=2), index, state).awaitTermination()
    ids = given.select("record_id").distinct().count()
    assert spark.read.parquet(index).count() == spark.read.parquet(index).select("record_id").distinct().count() == ids
    given.limit(20).withColumn("record_id", F.concat(F.lit("new "), "record_id")).write.mode("append").parquet(source)
    follow(deliveries(spark, source, given.schema), index, state).awaitTermination()
    follow(deliveries(spark, source, given.schema), index, str(tmp_path / "from the start")).awaitTermination()
    again = spark.read.parquet(index)
    assert again.count() == again.select("record_id").distinct().count() == ids + again.filter("record_id like 'new %'").count()


def test_daily_counts(spark, sf, tmp_path):
    given = spark.read.parquet(f"{sf}/event_records.parquet")
    given.write.parquet(str(tmp_path / "in"))
    q = daily(deliveries(spark, str(tmp_path / "in"), given.schema)).writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = given.filter("date_confidence <> 'uncertain'").groupBy(F.to_date("ingestion_date").alias("day")).count()
    assert {tuple(r) for r in spark.table("days").collect()} == {tuple(r) for r in want.collect()}
