import random

from hindcast.llm.packing import fill, minimum_slack, pack_windows


def best_sum(items, room):
    sums = {0}
    for x in items:
        sums |= {s + x for s in sums if s + x <= room}
    return max(sums)


def test_fill_is_closest():
    rng = random.Random(2)
    for _ in range(300):
        items = [rng.randint(1, 30) for _ in range(rng.randint(0, 9))]
        counts = {s: items.count(s) for s in items}
        room = rng.randint(0, 60)
        picked = fill(sorted(counts, reverse=True), counts, room)
        assert sum(s * n for s, n in picked) == best_sum(items, room)
        assert all(n <= counts[s] for s, n in picked)


def test_every_item_once():
    rng = random.Random(4)
    items = [rng.randint(1, 100) for _ in range(500)]
    windows = list(minimum_slack({s: items.count(s) for s in set(items)}, 100))
    placed = [s for content, times in windows for s, n in content for _ in range(n * times)]
    assert sorted(placed) == sorted(items)
    assert all(sum(s * n for s, n in content) <= 100 for content, _ in windows)
    assert sum(t for _, t in windows) <= 1.02 * sum(items) / 100


def test_windows(spark):
    rng = random.Random(9)
    rows = [(i, rng.randint(1, 90)) for i in range(300)] + [(1000, 205), (1001, 100), (1002, 0), (1003, None), (None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens int").selectExpr("*", "1 as shard", "2 as used")
    models = spark.createDataFrame([("m", 100), ("n", 64), ("o", None), ("p", 0)], "model_id string, window_tokens int")
    out = pack_windows(df, models).collect()
    for model, capacity in (("m", 100), ("n", 64)):
        mine = [r for r in out if r.model_id == model]
        used, tokens = {}, {}
        for r in mine:
            used[r.window_id] = used.get(r.window_id, 0) + r.token_count
            tokens.setdefault(r.doc_id, []).append((r.token_start, r.token_count))
        assert max(used.values()) <= capacity
        for doc, size in rows:
            if doc is None or not size:
                assert doc is None or doc not in tokens
                continue
            at = 0
            for start, n in sorted(tokens[doc]):
                assert start == at
                at += n
            assert at == size and (size > capacity or len(tokens[doc]) == 1)
        assert len(used) <= -(-sum(n for d, n in rows if d is not None and n) // capacity) + 2 + (capacity == 64) * 40
    assert {r.model_id for r in out} == {"m", "n"}
    assert pack_windows(df.limit(0), models).count() == 0
