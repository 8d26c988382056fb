import math
import random

import pytest
from pyspark.sql import functions as F

from hindcast.functions.scalars import brier_map, cosine_distance, host, netloc, normal_topics, words
from hindcast.operators import scoring as S


def one(spark, column, **values):
    schema = ", ".join(f"{k} {v[0]}" for k, v in values.items())
    return spark.createDataFrame([tuple(v[1] for v in values.values())], schema).select(column.alias("x")).first().x


def test_brier_of_options(spark):
    f = lambda m, t: one(spark, brier_map(F.col("m"), F.col("t")), m=("map<string,double>", m), t=("string", t))
    assert f({"A": 0.1, "B": 0.9}, "B") == pytest.approx(0.02)
    assert f({k: 0.25 for k in "ABCD"}, "C") == pytest.approx(0.75)
    assert f({"A": 1.0}, "B") == pytest.approx(2.0)
    assert f({"A": None, "B": 1.0}, "B") == 0.0


def test_cosine(spark):
    f = lambda a, b: one(spark, cosine_distance("a", "b"), a=("array<float>", a), b=("array<float>", b))
    assert f([1.0, 0.0], [1.0, 0.0]) == pytest.approx(0.0)
    assert f([1.0, 0.0], [0.0, 2.0]) == pytest.approx(1.0)
    assert f([0.0, 0.0], [1.0, 0.0]) is None
    assert f([1.0], [1.0, 0.0]) is None


def test_hosts_and_topics(spark):
    assert one(spark, netloc("u"), u=("string", "https://www.Reuters.com:80/a?b")) == "www.Reuters.com:80"
    assert one(spark, host("u"), u=("string", "https://www.wsj.com/a")) == "sj.com"
    assert one(spark, netloc("u"), u=("string", "no scheme")) == ""
    assert one(spark, normal_topics("t"), t=("array<string>", [" Trade-Policy", "trade policy", "", "tax"])) == ["tax", "trade_policy"]


def test_words_between_any_blanks(spark):
    text = "\u2003Two\u00a0Words\x0band\x1cmore\u3000here\x85now\u2028 end \u200bzero"
    assert one(spark, words("t"), t=("string", text)) == text.lower().split()
    assert one(spark, words("t"), t=("string", " \u00a0 ")) == []


@pytest.mark.parametrize("wins,losses,p", [(50, 46, 0.7596), (45, 48, 0.8358), (41, 51, 0.3481), (47, 40, 0.5203), (51, 45, 0.6101), (0, 0, 1.0), (3, 0, 0.25)])
def test_sign_test_published(spark, wins, losses, p):
    df = spark.createDataFrame([("a", "b", wins, losses)], "a string, b string, wins long, losses long")
    assert S.sign_test(df).first().p_value == pytest.approx(p, abs=6e-5)


def binary(spark, rows):
    return spark.createDataFrame([("e", f"q{i}", float(p), float(y)) for i, (p, y) in enumerate(rows)], "experiment string, question_id string, p double, y double")


def test_calibration(spark):
    even = S.calibration(binary(spark, [(0.7, 1)] * 7 + [(0.7, 0)] * 3)).first()
    assert (even.ece, even.reliability, even.resolution, even.uncertainty) == (0.0, 0.0, 0.0, 0.21)
    assert S.calibration(binary(spark, [(0.9, 1)] * 5 + [(0.9, 0)] * 5)).first().ece == pytest.approx(0.4)


def test_temperature(spark):
    rng = random.Random(1)
    rows = [(p, rng.random() < p) for p in (rng.uniform(0.05, 0.95) for _ in range(1500))]
    assert 0.8 <= S.fit_temperature(binary(spark, rows)).first().t <= 1.2
    sure = [(1 / (1 + math.exp(-3 * math.log(p / (1 - p)))), y) for p, y in rows]
    assert S.fit_temperature(binary(spark, sure)).first().t > 1.5


def test_wilcoxon_brute(spark):
    rng = random.Random(3)
    d = [rng.choice([-3, -2, -1, 0, 1, 2, 3, 4]) for _ in range(40)]
    df = spark.createDataFrame([("a", "b", str(i), float(x)) for i, x in enumerate(d)], "a string, b string, question_id string, delta double")
    nz = [x for x in d if x]
    rank = {s: (sum(abs(x) < s for x in nz) + 1 + sum(abs(x) <= s for x in nz)) / 2 for s in {abs(x) for x in nz}}
    plus, minus = sum(rank[abs(x)] for x in nz if x > 0), sum(rank[abs(x)] for x in nz if x < 0)
    got = S.wilcoxon(df).first()
    assert (got.n, got.w) == (len(nz), min(plus, minus))


def test_upper_median_and_ranks(spark):
    rng = random.Random(5)
    groups = {g: [round(rng.uniform(-2, 2), rng.choice([1, 9])) for _ in range(n)] for g, n in (("a", 1), ("b", 40), ("c", 41))}
    df = spark.createDataFrame([(g, "z", x) for g, v in groups.items() for x in v], "a string, b string, delta double")
    assert {r.a: r.median for r in S.upper_median(df).collect()} == {g: sorted(v)[len(v) // 2] for g, v in groups.items()}
    assert S.upper_median(df.limit(0)).count() == 0


@pytest.mark.parametrize("z", [0.0, 0.5, -1.96, 4.0])
def test_two_sided_p(spark, z):
    assert one(spark, S.normal_two_sided(F.col("z")), z=("double", z)) == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=3e-7)


def test_window_counts_brute(spark):
    import datetime as dt

    from hindcast.operators.retrieval import window_counts

    rng, day = random.Random(2), lambda n: None if n is None else dt.date(2024, 1, 1) + dt.timedelta(days=n)
    records = [(rng.choice([None, *range(20, 60)]), rng.choice(["high", "uncertain", None])) for _ in range(80)]
    asked = [(i, rng.choice([None, *range(0, 80)]), rng.choice([None, *range(0, 80)])) for i in range(60)]
    ev = spark.createDataFrame([(day(n), c) for n, c in records], "event_date date, date_confidence string")
    rq = spark.createDataFrame([(i, day(a), day(b)) for i, a, b in asked], "request_id long, cutoff date, simulation date")
    count = lambda a, b, ok: sum(None not in (n, a, b, c) and a <= n <= b and ok == (c != "uncertain") for n, c in records)
    assert {tuple(r) for r in window_counts(ev, rq).collect()} == {(i, count(a, b, True), count(a, b, False)) for i, a, b in asked}
    assert window_counts(ev.limit(0), rq).filter("n_in_window = 0").count() == 60
