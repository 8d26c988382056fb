import collections
import math
import random
import re

import numpy as np

from hindcast.llm import neardup
from hindcast.llm.neardup import candidates, elements, joint_estimate, least_estimate, near_duplicate_groups, near_duplicate_pairs, overlap, sketches
from hindcast.runtime import Scratch

WORDS = [f"word{i}" for i in range(4000)]


def share(a, b):
    x, y = (collections.Counter(re.findall(r"\w+", t.lower())) for t in (a, b))
    n = sum((x & y).values())
    return n / (sum(x.values()) + sum(y.values()) - n)


def test_sketch_estimates_overlap():
    rng = np.random.default_rng(0)
    base = rng.choice(10**6, 300, replace=False).astype(np.uint32)
    for keep in (60, 150, 240):
        a, b = np.sort(base[:240]), np.sort(np.concatenate([base[:keep], base[240:300][: 240 - keep]]))
        x, y = (sketches(elements(w, np.array([0])), np.ones(len(w)), np.array([0]), 1200)[0].astype(int) for w in (a, b))
        more, less = (x > y).sum(), (x < y).sum()
        got = joint_estimate(*(np.array([v]) for v in (more, less, 1200 - more - less, len(a), len(b))))[0]
        assert abs(got - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.06
    weight = np.where(np.arange(300) < 150, 0.1, 1.0)
    x, y = (sketches(elements(w, np.array([0])), v, np.array([0]), 1200)[0].astype(int) for w, v in ((np.arange(150), weight[:150]), (np.arange(300), weight)))
    assert abs((x == y).mean() - 15 / 165) < 0.03
    assert overlap(np.array([1, 1, 2]), np.array([1, 2, 2])) == 0.5


def test_sketches_merge(monkeypatch):
    rng = np.random.default_rng(2)
    element, starts = rng.integers(0, 1 << 62, 5000).astype(np.uint64), np.array([0, 3, 4, 900, 4990])
    weight = np.where(element % 3 == 0, 0.2, 1.0)
    whole = sketches(element, weight, starts, 24)
    monkeypatch.setattr(neardup, "BLOCK", 700)
    monkeypatch.setattr(neardup, "PART", 130)
    assert (sketches(element, weight, starts, 24) == whole).all()
    parts = sketches(element, weight, np.array([0]), 24)
    assert (whole.max(0) == parts[0]).all()


def test_no_pair_over_the_threshold_has_a_lower_estimate():
    rng = np.random.default_rng(3)
    for _ in range(500):
        both, a, b = rng.random(rng.integers(1, 60)), rng.random(rng.integers(0, 20)), rng.random(rng.integers(0, 20))
        share = len(both) / (len(both) + len(a) + len(b))
        true = both.sum() / (both.sum() + a.sum() + b.sum())
        args = [np.array([float(v)]) for v in (len(both) + len(a), len(both) + len(b), both.sum() + a.sum(), both.sum() + b.sum())]
        assert least_estimate(*args, share)[0] <= true + 1e-9


def corpus():
    rng = random.Random(11)
    rows = []
    for i in range(120):
        text = [*rng.choices(WORDS, k=40), *"the of and a".split()]
        rows.append(("e", f"r{i:03}", " ".join(text)))
        if i % 4 == 0:
            for j in range(rng.randint(1, 3)):
                t = text[:]
                for _ in range(rng.randint(0, 4)):
                    t[rng.randrange(len(t))] = rng.choice(WORDS)
                rng.shuffle(t)
                rows.append(("e", f"r{i:03}v{j}", " ".join(t).upper() + "!"))
    return rows + [("q", "other", rows[0][2]), ("e", None, rows[0][2]), ("e", "null", None), ("e", "blank", " .. "), ("e", "short", "one two"), ("e", "short2", "Two, one"), ("e", "r000", rows[0][2]), ("e", "long", "lorem " * 30000)]


def test_pairs_and_groups(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "kind string, id string, text string").selectExpr("*", "1 as uid", "2 as words")
    live = {(k, i): t for k, i, t in rows if i and t and re.search(r"\w", t)}
    want = {(a[1], b[1]) for a in live for b in live if a[0] == b[0] and a[1] < b[1] and share(live[a], live[b]) >= 0.65}
    got = {tuple(r) for r in near_duplicate_pairs(df, "kind", "id", "text").collect()}
    assert got == want and ("short", "short2") in got
    groups = {r.id: r.group_id for r in near_duplicate_groups(df, "kind", "id", "text").collect()}
    assert set(groups) == {x for p in want for x in p} and all(groups[a] == groups[b] for a, b in want)
    assert near_duplicate_pairs(df.limit(0), "kind", "id", "text").count() == 0
    assert near_duplicate_groups(df.limit(0), "kind", "id", "text").count() == 0


def test_large_bands_are_paired_whole(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BAND", 5)
    rows = [(k, u) for k, n in ((1, 1), (2, 2), (3, 5), (4, 6), (5, 40)) for u in range(100 * k, 100 * k + n)] + [(5, 500), (2, 200)]
    got = {tuple(r) for r in candidates(spark.createDataFrame(rows, "key long, uid long"), 3, Scratch(spark)).collect()}
    assert got == {(a, b) for k, a in rows for q, b in rows if k == q and a < b}


def test_short_texts_of_common_words(spark):
    rows = [("q", f"r{i:02}", "will the vote pass in " + w) for i, w in enumerate("may june july may".split())] + [("q", f"s{i:03}", f"will the court rule on {i}") for i in range(150)]
    df = spark.createDataFrame(rows, "kind string, id string, text string")
    live = {i: t for _, i, t in rows}
    want = {(a, b) for a in live for b in live if a < b and share(live[a], live[b]) >= 0.65}
    assert {tuple(r) for r in near_duplicate_pairs(df, "kind", "id", "text").collect()} == want


def test_texts_that_share_a_band_by_chance_are_dropped_where_they_meet(spark, monkeypatch):
    rng = np.random.default_rng(5)
    apart = lambda m, n: m ^ sum(int(rng.integers(1, 4)) << 2 * int(t) for t in rng.permutation(32)[:n])
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    one = int(rng.integers(1 << 62)) * 4 + 3
    rows = [(1, 10, one), (1, 11, apart(one, 13)), (1, 12, apart(one, 14)), (1, 13, one), (2, 10, one), (2, 14, one)]
    df = spark.createDataFrame([(k, u, signed(m)) for k, u, m in rows], "key long, uid long, mark long")
    unlike = lambda x, y: sum((x ^ y) >> 2 * t & 3 > 0 for t in range(32))
    want = {(a, b) for k, a, x in rows for q, b, y in rows if k == q and a < b and unlike(x, y) <= 13}
    assert {(10, 11), (10, 13), (10, 14)} <= want and (10, 12) not in want
    for band in (64, 2):
        monkeypatch.setattr(neardup, "BAND", band)
        assert {tuple(r) for r in candidates(df, 3, Scratch(spark)).collect()} == want


def test_marks_lose_no_pair():
    unmarked = lambda j, bands: (1 - j**6) ** bands
    for j in np.arange(0.6, 1.0, 0.01):
        same = j + (1 - j) / 4
        passed = sum(math.comb(32, k) * same**k * (1 - same) ** (32 - k) for k in range(neardup.MARK_LEAST, 33))
        assert (1 - j**6 * passed) ** neardup.BANDS <= unmarked(j, 60)
