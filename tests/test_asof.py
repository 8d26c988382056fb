import datetime as dt
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from hindcast.operators.asof import as_known_join, latest_known

small = st.integers(0, 9)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(small, small), min_size=1, max_size=20), st.lists(st.tuples(small, small), min_size=1, max_size=10))
def test_search_agrees_with_scan(versions, events):
    v = np.array(sorted(versions))
    e = np.array(events)
    got = latest_known(v[:, 0], v[:, 1], e[:, 0], e[:, 1])
    assert list(got) == [max((i for i, (a, b) in enumerate(v) if a <= x and b <= y), default=-1) for x, y in e]


def day(n):
    return dt.date(2024, 1, n)


def test_as_known_join_cases(spark):
    events = spark.createDataFrame(
        [("a", day(10), day(12), 1), ("a", day(10), day(12), 2), ("a", day(2), day(3), 3), ("b", day(9), day(9), 4), (None, day(9), day(9), 5), ("c", None, day(9), 6)], "actor string, event date, sim date, version long"
    )
    versions = spark.createDataFrame(
        [
            ("a", day(1), day(1), 1), ("a", day(5), day(20), 2), ("a", day(4), day(5), 3), ("a", day(4), day(6), 4), ("a", day(4), day(6), 5), ("a", day(4), day(6), 5),
            ("b", day(1), None, 6), ("b", day(20), day(1), 7), ("z", day(1), day(1), 8),
        ], "actor string, valid date, pub date, id long",
    )
    out = as_known_join(events, versions, "actor", "event", "sim", "valid", "pub", "id")
    assert sorted(map(tuple, out.collect())) == [("a", day(2), day(3), 1), ("a", day(10), day(12), 5)]
    assert as_known_join(events.limit(0), versions, "actor", "event", "sim", "valid", "pub", "id").count() == 0
    assert as_known_join(events, versions.limit(0), "actor", "event", "sim", "valid", "pub", "id").count() == 0


def test_ranges_of_versions_give_the_same(spark):
    rng = random.Random(3)
    at = lambda: dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(200))
    events = spark.createDataFrame([(rng.choice("ab"), at(), at(), i) for i in range(300)], "actor string, event date, sim date, range long")
    versions = spark.createDataFrame([(rng.choice("aaaab"), at(), at(), i) for i in range(120)], "actor string, valid date, pub date, id long")
    rows = lambda n: sorted(map(tuple, as_known_join(events, versions, "actor", "event", "sim", "valid", "pub", "id", per_range=n).collect()))
    whole, vs = rows(1000), versions.collect()
    best = lambda a, e, k: max(((v.valid, v.pub, v.id) for v in vs if v.actor == a and v.valid <= e and v.pub <= k), default=None)
    asked = {(r.actor, r.event, r.sim) for r in events.collect()}
    assert whole == sorted((*x, best(*x)[2]) for x in asked if best(*x))
    assert rows(50) == whole and rows(0) == whole
