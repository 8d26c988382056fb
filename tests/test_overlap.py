import random

import pytest

from hindcast.operators.overlap import overlap_leaders, overlap_pairs


@pytest.mark.parametrize("least", [0.5, 0.8])
def test_pairs_equal_brute_force(spark, least):
    rng = random.Random(8)
    rows = [(f"k{i:03}", sorted({f"w{int(rng.random() ** 2 * 25)}" for _ in range(rng.randint(0, 8))}), i % 3, [i % 3, (i + 1) % 3]) for i in range(80)] + [("nul", None, 0, [0])]
    df = spark.createDataFrame(rows, "key string, words array<string>, here int, near array<int>")
    near = lambda x, y: x[2] in y[3] or y[2] in x[3]
    want = set()
    for x in rows[:-1]:
        for y in rows[:-1]:
            if x[0] < y[0] and x[1] and y[1] and near(x, y) and len(set(x[1]) & set(y[1])) / max(len(x[1]), len(y[1])) >= least - 1e-9:
                want.add((x[0], y[0]))
    assert {(r.a, r.b) for r in overlap_pairs(df, least).collect()} == want
    assert overlap_pairs(df.limit(0), least).count() == 0


def shuffled(plan):
    """Rows that the exchanges of an executed plan have written."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return shuffled(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return shuffled(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(shuffled(plan.children().apply(i)) for i in range(plan.children().size()))


def test_candidates_that_fail_are_not_shuffled(spark):
    rng = random.Random(9)
    texts = {tuple(sorted({"in", "of", "over", "stalls", *(f"w{rng.randrange(60)}" for _ in range(6))})) for _ in range(1200)}
    rows = [(f"k{i:04}", list(t), 0, [0]) for i, t in enumerate(sorted(texts))]
    pairs = overlap_pairs(spark.createDataFrame(rows, "key string, words array<string>, here int, near array<int>"), 0.8).select("a", "b")
    found = len(pairs.collect())
    want = sum(len(set(x[1]) & set(y[1])) / max(len(x[1]), len(y[1])) >= 0.8 - 1e-9 for i, x in enumerate(rows) for y in rows[i + 1 :])
    assert found == want > 0
    assert shuffled(pairs._jdf.queryExecution().executedPlan()) < 25 * len(rows) + 4 * found


def broadcast(plan):
    """Bytes of each broadcast of an executed plan."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return broadcast(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return broadcast(plan.plan())
    own = [plan.metrics().apply("dataSize").value()] if kind == "BroadcastExchangeExec" else []
    return own + [b for i in range(plan.children().size()) for b in broadcast(plan.children().apply(i))]


def test_keys_are_not_broadcast(spark):
    rng = random.Random(10)
    texts = {tuple(sorted({"in", "of", *(f"w{rng.randrange(300)}" for _ in range(9))})) for _ in range(3000)}
    rows = [(f"k{i:04}", list(t), 0, [0]) for i, t in enumerate(sorted(texts))]
    pairs = overlap_pairs(spark.createDataFrame(rows, "key string, words array<string>, here int, near array<int>"), 0.6)
    pairs.collect()
    assert sum(broadcast(pairs._jdf.queryExecution().executedPlan())) < 3000 * len(rows)


def test_keys_of_one_block_are_shuffled_once(spark):
    rng = random.Random(11)
    texts = sorted({tuple(sorted(rng.sample(range(100, 150), 10))) for _ in range(1200)} | {tuple(range(200, 210)), tuple(range(201, 211))})
    rows = [(f"k{i:04}", [str(w) for w in t], 0, [0]) for i, t in enumerate(texts)]
    pairs = overlap_pairs(spark.createDataFrame(rows, "key string, words array<string>, here int, near array<int>"), 0.8).select("a", "b")
    found = len(pairs.collect())
    assert found == sum(len({*x[1]} & {*y[1]}) >= 8 for i, x in enumerate(rows) for y in rows[i + 1 :]) > 0
    assert 6 * len(rows) <= shuffled(pairs._jdf.queryExecution().executedPlan()) < 9 * len(rows) + 4 * found  # a text has 6 keys


@pytest.mark.parametrize("least,seed", [(0.5, 1), (0.5, 2), (0.8, 3)])
def test_leaders_equal_the_fold(spark, least, seed):
    rng = random.Random(seed)
    rows = [(3 * i, sorted({f"w{int(rng.random() ** 2 * 14)}" for _ in range(rng.randint(1, 8))})) for i in range(90)]
    alike = lambda x, y: len(set(x) & set(y)) / max(len(x), len(y)) >= least - 1e-9
    kept, want = [], {}
    for i, w in rows:
        first = next((j for j, v in kept if alike(v, w)), None)
        if first is None:
            kept.append((i, w))
        else:
            want[i] = first
    df = spark.createDataFrame(rows, "id long, words array<string>")
    assert {r.id: r.leader for r in overlap_leaders(df, least).collect()} == want and len(want) > 10
    assert overlap_leaders(df.limit(0), least).count() == 0
