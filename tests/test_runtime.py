import pytest

from hindcast import runtime
from hindcast.runtime import Scratch, checkpoint_dir, exists, pairs_within, split_join
from hindcast.sources.stages import Stages


def test_scratch_drops_and_keeps(spark):
    s = Scratch(spark)
    a, b = s.keep(spark.range(3)), s.keep(spark.range(5))
    paths = [p for _, p in s.kept]
    s.drop(a)
    assert [exists(spark, p) for p in paths] == [False, True] and b.count() == 5


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Unset:
        get = staticmethod(lambda key, default=None: default)

    class Session:
        conf, sparkContext = Unset, Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session)


def test_broken_log_is_an_error(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "part-0.parquet").write_text("no table")
    with pytest.raises(Exception):
        Stages(spark, str(tmp_path), ["a"]).log().collect()


def test_pairs_and_joins_of_hot_keys(spark):
    rows = [(k, v) for k, n in (("x", 40), ("y", 1), ("z", 2)) for v in range(n)] + [("x", 3), (None, 1), (None, 2), ("y", None)]
    df = spark.createDataFrame(rows, "k string, v int")
    clean = {(k, v) for k, v in rows if k and v is not None}
    for size in (7, 2000):
        got = {tuple(r) for r in pairs_within(df, "k", "v", "a", "b", size).collect()}
        assert got == {(k, a, b) for k, a in clean for q, b in clean if k == q and a < b}
        right = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("z", 3.0), ("w", 4.0), (None, 5.0)], "k string, w double")
        joined = sorted(map(tuple, split_join(df, right, "k", size).collect()))
        assert joined == sorted(map(tuple, df.join(right, "k").collect()))
    assert runtime.shuffle_partitions(spark) == 4
