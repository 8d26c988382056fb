import inspect
import random
from datetime import date, timedelta

import pytest

from hindcast.functions.objects import first_object, object_of
from hindcast.operators.leaders import key_leaders, leader_clusters
from hindcast.plans.ordered import bootstrap_ci, event_keys, text_leaders
from hindcast.runtime import Scratch


def fold(nodes, edges):
    match = {frozenset(e) for e in edges if None not in e}
    leader, leaders = {}, []
    for x in sorted(nodes):
        leader[x] = next((y for y in leaders if frozenset((x, y)) in match), x)
        if leader[x] == x:
            leaders.append(x)
    return leader


@pytest.mark.parametrize("seed", range(3))
def test_leaders_equal_the_fold(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{i:02}" for i in range(30)]
    edges = [tuple(rng.sample(nodes, 2)) for _ in range([0, 25, 60][seed])] + [(None, "n01"), ("n02", "n02"), ("n03", "gone")]
    n = spark.createDataFrame([(x,) for x in nodes + nodes[:3]] + [(None,)], "id string")
    e = spark.createDataFrame(edges, "a string, b string")
    got = {r.id: r.leader for r in leader_clusters(n, e, "id", "a", "b").collect()}
    assert got == fold(nodes, [p for p in edges if p[0] != p[1] and "gone" not in p])


@pytest.mark.parametrize("seed", range(3))
def test_key_leaders_equal_the_fold(spark, seed):
    rng = random.Random(seed)
    rows = [(f"n{rng.randrange(40):02}", rng.choice([None, *range(5 + 15 * seed)])) for _ in range(90)]
    edges = [(x, y) for x, k in rows for y, m in rows if k is not None and k == m and x != y]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)] + [(None, 1, 0)], "id string, k long, first long")
    got = {r.id: r.leader for r in key_leaders(df, "id", "k").collect()}
    assert got == fold({x for x, _ in rows}, edges)
    assert key_leaders(df.limit(0), "id", "k").count() == 0


def same_event(x, y):
    a, b = (set((r[2] or "").lower().split()) for r in (x, y))
    share = len(a & b) / max(len(a), len(b)) if a and b else 0
    apart = abs((x[1] - y[1]).days) if x[1] and y[1] else None
    return apart is not None and (apart <= 2 and share > 0.5 or apart == 0 and bool(set(x[3] or ()) & set(y[3] or ()))) or share > 0.75


@pytest.mark.parametrize("seed", range(3))
def test_event_clusters_equal_the_fold(spark, seed):
    rng = random.Random(seed)
    headline = lambda: " ".join(rng.choice("Wab") + rng.choice("cde") for _ in range(rng.randint(1, 6)))
    some = [(f"r{i:02}", rng.choice([None] + [date(2024, 2, 27) + timedelta(days=n) for n in range(9)]), rng.choice([None, "", " ", headline(), headline(), headline()]), rng.choice([None, [], ["x"], ["y", "z"], ["z", f"t{i % 5}"]])) for i in range(60)]
    half = [("s0", date(2023, 1, 3), "one two Three four", None), ("s1", date(2023, 1, 5), "one two three five", None), ("s2", date(2023, 1, 6), "one two three five six", None), ("s3", date(2023, 1, 3), "one two six seven", None)]
    rows = some + half + [("t0", None, "one two three five SIX", None), ("u0", date(2022, 1, 1), None, ["x", None]), ("u1", date(2022, 1, 1), "other", [None, "x"]), ("u2", date(2022, 1, 1), "another", [None])]
    df = spark.createDataFrame(rows, "record_id string, event_date date, headline string, topics array<string>")
    edges = [(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and same_event(x, y) and (x[0], y[0]) not in {("u0", "u2"), ("u1", "u2")}]
    got = {r.record_id: r.leader for r in key_leaders(event_keys(df), "record_id", "key").collect()}
    assert got == fold([r[0] for r in rows], edges)
    assert (got["s1"], got["s2"], got["s3"], got["t0"], got["u1"], got["u2"]) == ("s0", "s2", "s3", "s2", "u0", "u2")
    assert event_keys(df.limit(0)).count() == 0


def test_leaders_of_nothing(spark):
    n, e = spark.createDataFrame([], "id string"), spark.createDataFrame([], "a string, b string")
    assert leader_clusters(n, e, "id", "a", "b").count() == 0


@pytest.mark.parametrize(
    "text,want",
    [
        ('{"probability": 0.4}', ("strict", 0.4)), ('```json\n{"probability": 1}\n```', ("fenced", 1.0)), ('so {"probability": 0.2, "r": "a}\\"b"} end', ("balanced", 0.2)), ('{"probability": 0.3, "r": "cut', ("balanced", 0.3)),
        ("prose", ("none", None)), ("", (None, None)), (None, (None, None)), ("[1]", ("none", None)),
        ('{bad {"probability": 0.5} {"p": 1}', ("inner", 0.5)), ('x {"a": {"probability": 1}, "probability": 2} {', ("balanced", 2.0)), ("{" * 5000, ("none", None)), ("[" * 100_000, ("none", None)),
        ('{"probability": 1' + "0" * 400 + "}", ("strict", float("inf"))),
    ],
)
def test_objects(text, want):
    assert first_object(text) == want


def test_objects_of_whole_texts_equal_the_search(spark):
    bodies = ["0.4", "3", "true", '"0.4"', "null", "1e-3", "NaN", '{"probability": 1}', "[0.5]", "9" * 45, ".5"]
    objects = ['{"probability": ' + b + "}" for b in bodies] + ['{"r": "a}", "probability": 0.25}', "{}", '{"a": 1, "a": 2}', '{"a": "x\ty"}', "{'a': 1}"]
    ends = ["", " ", "\n", " x", "}", "]", "] }", "} ]", ', {"b": 2}', ' {"b": 2}', ', "b": 2', "\u00a0"]
    texts = [o + e for o in objects for e in ends] + ["[1]", '"s"', "1", "null", '1, "o": {"probability": 1}', '{"probability": 1}, null', "", " ", None]
    rows = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, o int").select("text", object_of("text").alias("o"))
    for r in rows.collect():
        how, p = first_object(r.text)
        assert (r.o.how, r.o.probability) == (how, pytest.approx(p) if p is not None else None), r.text


def test_bootstrap_takes_as_many_draws_as_the_reference():
    assert inspect.signature(bootstrap_ci).parameters["draws"].default == 10_000


def test_text_leaders_equal_the_fold(spark):
    rng = random.Random(4)
    texts = {" ".join(sorted({"in", "of", "stalls", "as", *(f"w{rng.randrange(12)}" for _ in range(6))})) for _ in range(80)}
    like = lambda a, b: len(set(a.split()) & set(b.split())) >= 0.8 * max(len(a.split()), len(b.split())) - 1e-9
    got = {r.key: r.leader for r in text_leaders(spark.createDataFrame([(t,) for t in texts], "title string"), "title").collect()}
    assert got == fold(texts, [(a, b) for a in texts for b in texts if a < b and like(a, b)])


def test_pairs_of_alike_texts_are_not_written(spark, monkeypatch):
    keep, rows = Scratch.keep, []

    def counted(self, df):
        kept = keep(self, df)
        rows.append(kept.count())
        return kept

    monkeypatch.setattr(Scratch, "keep", counted)
    texts = [f"brokers in stalls over text while under {word} w{i:03}" for word in ("floor", "grant") for i in range(100)]
    got = {r.key: r.leader for r in text_leaders(spark.createDataFrame([(t,) for t in texts + texts[:9] + [None, " "]], "title string"), "title").collect()}
    keys = [" ".join(sorted(t.split())) for t in texts]
    like = [(a, b) for a in keys for b in keys if a < b and len(set(a.split()) & set(b.split())) >= 8]
    assert got == fold(keys, like) and len(like) == 9900 + 100
    assert max(rows) <= 2 * len(texts)
