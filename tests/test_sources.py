import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from hindcast.sources.files import append_absent, markdown, read_index, read_keyed, read_predictions, write_predictions
from hindcast.sources.stages import Stages


def test_predictions_round_trip(spark, sf, tmp_path):
    given = spark.read.parquet(f"{sf}/predictions.parquet")
    write_predictions(given, str(tmp_path / "p"))
    again = read_predictions(spark, str(tmp_path / "p"))
    plain = lambda df: sorted(json.dumps(r.asDict(True), default=str, sort_keys=True) for r in df.select(given.columns).collect())
    assert plain(again) == plain(given)


def test_prediction_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"prediction_id": 1, "binary": {"probability": 0.5}}\n\n{"prediction_id": 2, "new": 1}\n')
    assert [r.prediction_id for r in read_predictions(spark, str(tmp_path)).orderBy("prediction_id").collect()] == [1, 2]
    (tmp_path / "b.jsonl").write_text("no object\n")
    with pytest.raises(Exception):
        read_predictions(spark, str(tmp_path)).collect()
    assert read_predictions(spark, str(tmp_path), strict=False).filter("prediction_id is null").count() == 1


def test_keyed_document(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"rows": [{"id": "a", "v": 1}, {"id": "b"}, {"id": "a", "v": 2, "x": 0}, {"v": 9}]}, indent=1))
    assert {tuple(r) for r in read_keyed(spark, str(tmp_path), "rows", "id: string, v: int", "id").collect()} == {("a", 2), ("b", None)}


def test_append_absent(spark, tmp_path):
    path, day = str(tmp_path / "index"), dt.date(2024, 1, 5)
    rows = lambda *r: spark.createDataFrame([(i, d, dt.datetime(2024, 2, n), n) for i, d, n in r], "record_id string, event_date date, ingestion_date timestamp_ntz, v int")
    append_absent(rows(("a", day, 2), ("a", day, 1), ("b", None, 3), (None, day, 1)), path)
    append_absent(rows(("a", day, 4), ("c", dt.date(2024, 3, 1), 5)), path)
    append_absent(rows(), path)
    assert {(r.record_id, r.event_month, r.v) for r in spark.read.parquet(path).collect()} == {("a", "2024-01", 1), ("b", "none", 3), ("c", "2024-03", 5)}
    some = read_index(spark, path, "2024-01", "2024-02")
    assert [r.record_id for r in some.collect()] == ["a"]
    assert "PartitionFilters: [isnotnull(event_month" in some._jdf.queryExecution().toString()


def test_stages(spark, tmp_path):
    s, one = Stages(spark, str(tmp_path), ["draft", "check", "final"]), spark.range(3)
    assert s.latest("r") is None and s.next_stage("r") == "draft" and s.log().count() == 0
    at = lambda n: dt.datetime(2024, 1, 1, 0, n)
    assert s.save("r", "draft", one, at(1)).count() == 3
    s.save("r", "check", one.limit(1), at(2))
    s.save("r", "draft", spark.range(3, 5), at(3))
    s.save("other", "final", one, at(4))
    stage, df = s.latest("r")
    assert (stage, df.count(), s.next_stage("r"), s.next_stage("other")) == ("check", 1, "final", None)
    assert [r.path.rsplit("/", 1)[1][:5] for r in s.stale(keep=2).collect()] == ["draft"]
    assert [r.id for r in s.remaining("r", "draft", spark.range(7), "id").orderBy("id").collect()] == [5, 6]
    assert s.remaining("new", "draft", one, "id").count() == 3


def test_markdown(spark):
    df = spark.createDataFrame([("b", None, 2), ("a", 0.5, None)], "name string, x double, n int")
    assert [r.line for r in markdown(df, ["name"]).orderBy("line_no").collect()] == ["| a | 0.5000 | - |", "| b | - | 2 |"]
    assert markdown(df.filter(F.lit(False)), ["name"]).count() == 0
