import random

from leadloom.operators import dedup
from leadloom.operators.graph import components


def union_find(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in parent}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 240)] + [(300, i) for i in range(301, 360)]
    pairs += pairs[:5] + [(5, 5), (None, 3), (4, None)]
    got = components(spark.createDataFrame(pairs, "a int, b int"))
    want = union_find([(a, b) for a, b in pairs if a is not None and b is not None and a != b])
    assert {r.node: r.component for r in got.collect()} == want and got.count() == len(want)


def test_components_empty(spark):
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def greedy(rows):
    out, by = {}, ({}, {})
    for i, rank, *keys in sorted(rows, key=lambda r: (r[1], r[0])):
        of = next((by[k][v] for k, v in enumerate(keys) if v is not None and v in by[k]), None)
        out[i] = of
        if of is None:
            for k, v in enumerate(keys):
                if v is not None:
                    by[k][v] = i
    return out


def test_first_winners_is_the_greedy_rule(spark):
    rng = random.Random(5)
    for n in (12, 60):
        rows = [(f"s{i:02}", rng.randrange(9), rng.choice([None, *"abcdefgh"[: n // 6 + 2]]), rng.choice([None, *"uvwxyz"])) for i in range(n)]
        got = dedup.first_winners(spark.createDataFrame(rows, "id string, r int, a string, b string"), "id", ["r"], ["a", "b"])
        assert {r.id: r.duplicate_of for r in got.collect()} == greedy(rows)


def test_a_duplicate_registers_nothing(spark):
    rows = [("a", 1, "i1", "u1"), ("b", 2, "i1", "u2"), ("c", 3, "i3", "u2")]
    got = dedup.first_winners(spark.createDataFrame(rows, "id string, r int, a string, b string"), "id", ["r"], ["a", "b"])
    assert {r.id: r.duplicate_of for r in got.collect()} == {"a": None, "b": "a", "c": None}
