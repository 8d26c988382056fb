import random

import pytest

from hindcast.llm.components import connected_components


def brute(pairs):
    up = {}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = root(up.setdefault(a, a)), root(up.setdefault(b, b))
            up[max(x, y)] = min(x, y)
    return {(x, root(x)) for x in up}


rng = random.Random(7)
CASES = {
    "chain": [(f"q{i:03}", f"q{i + 1:03}") for i in range(40)] + [(None, "q001"), ("q005", "q005"), ("q003", None)],
    "random": [(f"q{rng.randrange(60):03}", f"q{rng.randrange(60):03}") for _ in range(45)] * 2,
    "star": [("hub", f"x{i:03}") for i in range(200)] + [("a", "hub")],
    "empty": [],
}


@pytest.mark.parametrize("name", CASES)
def test_components(spark, name):
    df = spark.createDataFrame(CASES[name], "a string, b string").selectExpr("a", "b", "1 as group_id", "2 as hi")
    assert {tuple(r) for r in connected_components(df, "a", "b").collect()} == brute(CASES[name])
