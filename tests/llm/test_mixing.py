import math
import random

import pytest
from pyspark.sql import functions as F

from leadloom.llm import mixing as m

TARGETS = [("a page", 0.5, 2), ("b_page", 0.3, 3), ("none", 0.1, 4), ("c", 0.1, 1)]


def docs(spark, n=400):
    rng = random.Random(6)
    rows = [(i, " ".join(["tea", "brass", "handmade"][rng.randrange(3)] for _ in range(rng.randrange(1, 60))), rng.choice(["a page", "A_PAGE ", "a-page", "c", "c", "unlisted", None]) if i % 9 else "b page") for i in range(n)]
    return spark.createDataFrame(rows + [(9001, None, "c"), (9002, "", "a page")], "doc_id bigint, text string, source string").withColumn("tokens", F.lit("clash")).withColumn("h", F.lit(1))


def targets(spark, rows=TARGETS):
    return spark.createDataFrame(rows, "source string, weight double, max_repeats int")


@pytest.mark.parametrize("seed", range(3))
def test_knapsack_is_exact(seed):
    rng = random.Random(seed)
    for _ in range(60):
        have = {rng.randrange(1, 40): rng.randrange(1, 6) for _ in range(rng.randrange(0, 6))}
        budget, sums = rng.randrange(0, 150), {0}
        for n, k in have.items():
            sums = {s + n * j for s in sums for j in range(k + 1) if s + n * j <= budget}
        take = m.knapsack(have, budget)
        assert sum(n * k for n, k in take.items()) == max(sums) and all(k <= have[n] for n, k in take.items())


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(m, "RESERVE", 300)
    d = docs(spark)
    x = m.Mix(d, targets(spark))
    plan, report = {r.source: r for r in x.plan.collect()}, {r.source: r for r in x.report.collect()}
    total = sum(r.tokens for r in plan.values())
    assert {r.total for r in plan.values()} == {total} and plan["none"].docs == 0 and "unlisted" not in plan
    for s, r in report.items():
        most = {"a_page": 2, "b_page": 3, "none": 4, "c": 1}[s]
        assert r.most <= most and r.used <= max(r.budget, 0) and r.reachable == (r.tokens * most >= r.weight * total)
        assert r.used == r.budget if r.reachable else r.used == r.tokens * most
    chosen = x.selected.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("d")).first()
    assert chosen.n == chosen.d
    again = m.Mix(d.repartition(7), targets(spark))
    key = lambda y: sorted((r.doc_id, r.repeats) for r in y.selected.collect())
    assert key(x) == key(again) != key(m.Mix(d, targets(spark), seed=1))


def best_sum(counts, budget, most):
    sums = {0}
    for n, k in counts.items():
        sums = {t for s in sums for j in range(k * most + 1) if (t := s + n * j) <= budget}
    return max(sums)


@pytest.mark.parametrize("seed", range(4))
def test_fill_is_exact(seed, monkeypatch):
    monkeypatch.setattr(m, "RESERVE", 20)
    rng = random.Random(seed)
    for _ in range(80):
        counts = {rng.choice([rng.randrange(0, 30), 6 * rng.randrange(1, 20), rng.randrange(60, 400)]): rng.randrange(1, 6) for _ in range(rng.randrange(1, 7))}
        most, total = rng.randrange(1, 4), sum(n * k for n, k in counts.items())
        budget = rng.randrange(0, total * most + 5)
        uses = m.fill(counts, budget, most)
        assert all(0 <= uses[n] <= k * most for n, k in counts.items())
        assert sum(n * k for n, k in uses.items()) == (best_sum(counts, budget, most) if budget < total * most else total * most)


def test_fill_meets_large_budgets():
    rng = random.Random(1)
    for counts in ({200_000: 1} | {n: 10 for n in range(1, 301)}, {rng.randrange(1, 300_000): 1 for _ in range(3000)}, {n: 40_000_000_000 for n in range(40, 900, 7)}):
        total = sum(n * k for n, k in counts.items())
        for share in (0.07, 0.3, 0.96, 1.9):
            uses = m.fill(counts, math.floor(share * total), 2)
            assert sum(n * k for n, k in uses.items()) == math.floor(share * total) and all(k <= 2 * counts[n] for n, k in uses.items())


def test_long_documents_stop_no_source(spark):
    rows = [(i, " tea" * 3000, "c") for i in range(20)] + [(100 + i, " tea" * (20 + i % 30), "c") for i in range(300)]
    rows += [(1000, " tea" * 900, "e")] + [(1001 + i, " tea" * (1 + i % 20), "e") for i in range(100)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    x = m.Mix(d, targets(spark, [("c", 0.03, 1), ("e", 0.02, 1)]))
    r = {r.source: r for r in x.report.collect()}
    assert 500 < r["c"].budget < 3000 and r["e"].tokens - 900 < r["e"].budget < r["e"].tokens
    assert {s: v.used for s, v in r.items()} == {s: v.budget for s, v in r.items()} and {v.most for v in r.values()} == {1}


def test_a_length_that_most_documents_have(spark, monkeypatch):
    """Uses end within a hash prefix; repeated rows and ties of hashes neither lose nor repeat a use."""
    monkeypatch.setattr(m, "PREFIX_BITS", 2)
    d = spark.createDataFrame([(i // 2, " tea" * 5, "c") for i in range(2000)], "doc_id bigint, text string, source string")
    x = m.Mix(d, targets(spark, [("c", 0.4321, 1)]))
    assert x.selected.agg(F.sum("repeats")).first()[0] == 864 and x.report.first().used == 4320


def test_empty(spark):
    d = docs(spark)
    assert m.Mix(d.limit(0), targets(spark)).selected.count() == 0 and m.Mix(d, targets(spark, [])).report.count() == 0
    assert {r.used for r in m.Mix(d.limit(0), targets(spark)).report.collect()} == {0}


def test_targets(spark):
    t = targets(spark, [("A page", 0.1, 1), ("a_page ", 0.2, 3), (None, 0.5, 1), ("b", None, None)])
    assert {(r.source, round(r.weight, 6), r.max_repeats) for r in m.targets_of(t).collect()} == {("a_page", 0.3, 3), ("b", 0.0, 1)}


def test_tokens_are_the_tokenizers(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(m.VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=m.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["It's a  test\n\n 123 चाय", "<|endoftext|>", "x" * 5000]
    got = m.token_lengths(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, source string"))
    assert {r.doc_id: r.tokens for r in got.collect()} == {i: len(enc.encode_ordinary(t)) for i, t in enumerate(texts)}
