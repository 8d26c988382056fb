import random
import statistics
from datetime import date

import pytest
from pyspark.sql import functions as F

from hindcast.functions.scalars import brier_map_strict
from hindcast.operators import scoring as S
from hindcast.operators.overlap import overlap_pairs
from hindcast.plans import evidence
from hindcast.plans.evidence import filled, merged, named_sources, unseen, voted_dates
from hindcast.plans.upkeep import merged_seeds
from hindcast.sources.files import append_keyed, read_or_none


def fold(candidates, existing, alike=0.8):
    bag = lambda t: set((t or "").lower().split())
    near = lambda a, b: a and b and len(a & b) >= alike * max(len(a), len(b)) - 1e-9
    seen, titles = {u for _, _, us in existing for u in us or () if u}, [bag(t) for _, t, _ in existing]
    kept = []
    for i, t, us in sorted(candidates):
        urls, words = {u for u in us or () if u}, bag(t)
        if urls & seen or any(near(words, o) for o in titles):
            continue
        if any(urls & k[1] or near(words, k[2]) for k in kept):
            continue
        kept.append((i, urls, words))
    return {k[0] for k in kept}


def test_unseen_equals_fold(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(14)]
    row = lambda i: (f"r{i:03}", rng.choice([None, "", " ".join(rng.sample(words, rng.randint(1, 6)))]), rng.choice([None, [], [rng.choice("abcdefghijklmnopqrstuvwxyz") * 2 for _ in range(rng.randint(1, 2))], [None, ""]]))
    candidates, existing = [row(i) for i in range(70)], [row(i) for i in range(100, 112)]
    schema = "id string, title string, urls array<string>"
    df = lambda rows: spark.createDataFrame(rows, schema).selectExpr("*", "1 as words", "2 as key")
    got = [r.id for r in unseen(df(candidates).select("id", "title", "urls"), df(existing).select("id", "title", "urls")).collect()]
    assert len(got) == len(set(got)) and set(got) == fold(candidates, existing)
    assert {r.id for r in unseen(df(candidates).select("id", "title", "urls"), df(existing).select("id", "title", "urls").limit(0)).collect()} == fold(candidates, [])


def test_strict_brier(spark):
    df = spark.createDataFrame([({"A": 0.1, "B": 0.9}, "B"), ({"A": 1.0}, "B")], "m map<string,double>, t string")
    assert [r.x for r in df.select(brier_map_strict(F.col("m"), F.col("t"), fail=False).alias("x")).collect()] == [pytest.approx(0.02), None]
    with pytest.raises(Exception, match="truth"):
        df.select(brier_map_strict(F.col("m"), F.col("t")).alias("x")).collect()


def test_medians_and_intervals(spark):
    rng = random.Random(9)
    rows = [("a", g, f"q{i}", round(rng.gauss(0, 1), 3)) for g, n in (("b", 101), ("c", 200), ("d", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "a string, b string, question_id string, delta double")
    values = {g: [r[3] for r in rows if r[1] == g] for g in "bcd"}
    assert {r.b: r.median for r in S.medians(df).collect()} == {g: pytest.approx(statistics.median(v)) for g, v in values.items()}
    got = {r.b: r for r in S.bootstrap_intervals(df, ["a", "b"], "question_id", "delta", 4000, groups=2).collect()}
    again = {r.b: r for r in S.bootstrap_intervals(df.repartition(3), ["a", "b"], "question_id", "delta", 4000).collect()}
    for g, v in values.items():
        assert got[g].mean == pytest.approx(statistics.mean(v), abs=1e-6) and got[g].low == pytest.approx(again[g].low, abs=1e-6)
        if len(v) > 1:
            half = 1.96 * statistics.stdev(v) / len(v) ** 0.5
            assert got[g].low == pytest.approx(got[g].mean - half, abs=0.3 * half) and got[g].high == pytest.approx(got[g].mean + half, abs=0.3 * half)
    assert S.bootstrap_intervals(df.limit(0), ["a", "b"], "question_id", "delta", 10).count() == 0


def test_cache_and_template(spark, tmp_path):
    path, schema = str(tmp_path / "cache"), "k string, v int"
    assert read_or_none(spark, path, schema).count() == 0
    append_keyed(spark.createDataFrame([("a", 1)], schema), path, ["k"])
    append_keyed(spark.createDataFrame([("a", 2), ("b", 3)], schema), path, ["k"])
    assert {tuple(r) for r in read_or_none(spark, path, schema).collect()} == {("a", 1), ("b", 3)}
    got = spark.createDataFrame([("x", None)], "p string, q string").select(filled("{p}-{q}-{r}", p=F.col("p"), q=F.col("q")).alias("t")).first().t
    assert got == "x--{r}"


def test_records_of_a_cluster_merged(spark):
    schema = (
        "leader string, record_id string, event_date date, event_date_precision string, key_facts array<string>, topics array<string>, direct_quotes array<struct<quote:string,speaker:string>>,"
        "sources array<struct<name:string,url:string>>, first int"
    )
    day = lambda n: date(2024, 1, n)
    rows = [
        ("a", "r2", day(2), "day", [" f", "g", None], ["Trade Talks"], [(" Yes ", "X"), ("no", None)], [("n", "https://b.org/1"), ("n", "https://a.org/2")], 1),
        ("a", "r1", day(1), "day", ["f", ""], ["trade-talks", " x"], [("yes", None)], [("n", "https://a.org/2"), ("n", None)], 1),
        ("a", "r3", day(2), "month", None, None, None, None, 1),
        ("b", "r4", None, "day", None, None, None, [], 1),
        ("c", "r5", day(5), "day", [], [], [], [("n", "host")], 1), ("c", "r6", day(5), "day", [], [], [], None, 1), ("d", "r7", day(3), "day", [], [], [], None, 1), ("d", "r8", day(4), "day", [], [], [], None, 1), ("d", "r9", day(4), "day", [], [], [], None, 1),
    ]
    df = spark.createDataFrame(rows, schema)
    m = {r.leader: tuple(r)[1:] for r in merged(df.drop("first"), ["leader"]).collect()}
    assert m["a"] == (3, "r1", "f|g", "trade_talks|x", 2, 0) and m["b"] == (1, "r4", "", "", 0, 0)
    assert {tuple(r) for r in voted_dates(df, ["leader"]).collect()} == {("a", day(1), "uncertain"), ("c", day(5), "high"), ("d", day(4), "medium")}
    assert {tuple(r) for r in named_sources(df, ["leader"]).collect()} == {("a", "https://a.org/2|https://b.org/1", "a.org|b.org"), ("c", "host", "")}
    assert merged(df.limit(0).drop("first"), ["leader"]).count() == voted_dates(df.limit(0), ["leader"]).count() == 0


def test_seeds_merged(spark):
    q = spark.createDataFrame(
        [
            ("q2", "long title", None, ["Yes", "Maybe"], ["f"]), ("q2", "long title", None, ["Yes", "Maybe"], ["f"]), ("q1", "same title", "b", ["yes", None, "No"], None), ("q3", None, None, None, []), ("q4", "lost", "x", [], []),
        ], "question_id string, title string, background string, options array<string>, flags array<string>",
    )
    q = q.selectExpr("*", "'s' as seed_id", "0 as pos")
    seeds = spark.createDataFrame([("q1", "q1"), ("q2", "q1"), ("q3", "q3")], "question_id string, seed_id string")
    got = {tuple(r) for r in merged_seeds(q, seeds).select("seed_id", "n", "title", "background", "options", "flagged").collect()}
    assert got == {("q1", 2, "same title", "b", "yes|No|Maybe", True), ("q3", 1, None, None, "", False)}
    assert merged_seeds(q.limit(0), seeds).count() == 0


def test_unseen_builds_no_pairs_of_old_titles(spark, monkeypatch):
    found = []
    monkeypatch.setattr(evidence, "overlap_pairs", lambda items, least: found.append(overlap_pairs(items, least)) or found[0])
    old = [(f"o{i:02}", f"one two three four five six seven eight nine w{i}", [f"u{i}"]) for i in range(30)]
    new = [("c0", "quite another title", []), ("c1", "one two three four five six seven eight nine ten", []), ("c2", "quite another title", ["v"])]
    df = lambda rows: spark.createDataFrame(rows, "id string, title string, urls array<string>")
    assert [r.id for r in unseen(df(new), df(old)).collect()] == ["c0"]
    assert found[0].count() == 30
