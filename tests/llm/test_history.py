import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from leadloom.functions.urls import KnownHosts
from leadloom.llm import history as h

DAY = [dt.datetime(2025, 1, 1) + dt.timedelta(days=i) for i in range(60)]
KNOWN = KnownHosts(frozenset({"example", "in.example"}), frozenset({"shops.example"}), frozenset({"tapcards.example"}))
LEADS = "id string, url string, discovered_at timestamp_ntz"


def typo(rng, s):
    k, c = rng.randrange(len(s) - 1), rng.choice("abcdefghijklmnopqrstuvwxyz")
    return rng.choice([s[:k] + s[k + 1 :], s[:k] + c + s[k:], s[:k] + c + s[k + 1 :], s[:k] + s[k + 1] + s[k] + s[k + 2 :], s[:k] + "-" + s[k:]])


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return a == b
    if len(a) == len(b):
        d = [k for k in range(len(a)) if a[k] != b[k]]
        return len(d) == 1 or len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]]
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def test_blocks_lose_no_typo(spark):
    rng = random.Random(2)
    names = ["".join(rng.choice("bdgklmnprt") + rng.choice("aeiou") for _ in range(rng.randrange(1, 8))) for _ in range(150)]
    names += [typo(rng, n).replace("-", "") for n in names for _ in range(3)]
    names = sorted({n for n in names if n})
    f = spark.createDataFrame([(n + ".x", n, "x") for n in names], "front string, name string, suffix string")
    b = h.block_rows(f).cache()
    got = {(r.a, r.b) for r in h._matches(b, b).collect()}
    want = {(a + ".x", b + ".x") for i, a in enumerate(names) for b in names[i + 1 :] if distance_one(a, b)}
    assert got == {tuple(sorted(p)) for p in want} and len(want) > 300


ROWS = [
    ("a", "https://Bonolika.in.example/x", DAY[5]), ("b", "m.bonolika.in.example.?u=1", DAY[3]), ("c", "http://bonólika.in.example", DAY[9]), ("d", "bonlika.in.example", DAY[4]),
    ("e", "bonolika.example", DAY[20]), ("f", "bonolika.shops.example", DAY[21]), ("g", "bonolikafoods.in.example", DAY[22]), ("h", None, DAY[1]), ("i", "n/a", DAY[1]), ("j", "tapcards.example/z", DAY[1]),
    ("k", "tapcards.example", DAY[2]), ("l", "bono-lika.in.example", None), ("m", "same-time.example", DAY[7]), ("n", "sametime.example", DAY[7]), ("o", "x" * 5000 + ".example", DAY[1]), ("p", "", DAY[1]),
]
WANT = {("a", "b"), ("c", "b"), ("d", "b"), ("l", "b")}


def batch(spark, rows):
    return spark.createDataFrame(rows, LEADS)


def holds(spark, folder):
    return {(r.id, r.first_id) for r in h.last_reports(h.FrontHistory.load(spark, folder).tables["reports"]).collect() if r.first_id}


def told(spark, folder, *batches):
    """What holds after the batches, each loaded, checked and saved."""
    for rows in batches:
        h.FrontHistory.load(spark, folder).check(batch(spark, rows), KNOWN).save()
    return holds(spark, folder)


def test_repeats(spark, tmp_path):
    assert told(spark, str(tmp_path / "h"), ROWS) == WANT


def test_empty_batches(spark, tmp_path):
    assert told(spark, str(tmp_path / "h"), [], ROWS[:2], []) == {("a", "b")}


def test_late_leads_and_joining_typos_reach_accepted_leads(spark, tmp_path):
    first = [("b", "bonolika.example", DAY[5]), ("c", "bonolikxyz.example", DAY[3]), ("d", "bonolikxyz.example", DAY[6])]
    late = [("a", "bonolika.example", DAY[2])]  # now b is a repeat
    assert told(spark, str(tmp_path / "h"), first, late) == {("b", "a"), ("d", "c")}
    between = [("e", "bonolikxya.example", DAY[8]), ("f", "bonolikxa.example", DAY[9])]  # a chain that joins both shops
    chain = told(spark, str(tmp_path / "h"), between)
    assert chain == {("b", "a"), ("c", "a"), ("d", "a"), ("e", "a"), ("f", "a")}
    earlier = [("f", "bonolikxa.example", DAY[0])]  # f comes again with an earlier time: its report no longer holds
    assert told(spark, str(tmp_path / "h"), earlier) == {("b", "f"), ("c", "f"), ("d", "f"), ("e", "f"), ("a", "f")}


@pytest.mark.parametrize("seed", [4])
def test_batches_equal_one_batch_whatever_their_order(spark, tmp_path, seed, monkeypatch):
    monkeypatch.setattr(h.FrontHistory, "COMPACT", 2)
    rng = random.Random(seed)
    names = ["".join(rng.choice("bdg") + rng.choice("ae") for _ in range(3)) for _ in range(12)]
    rows = ROWS + [(f"x{i}", typo(rng, rng.choice(names)) + rng.choice([".example", ".in.example"]), rng.choice(DAY)) for i in range(60)]
    rows += [(i, u, rng.choice(DAY)) for i, u, _ in rng.sample(rows, 12)]  # named again, earlier or later
    rng.shuffle(rows)
    folder = str(tmp_path / "parts")
    assert told(spark, folder, rows[:25], rows[25:50], rows[50:70], rows[70:]) == told(spark, str(tmp_path / "whole"), rows)
    assert len(h.Versions(spark, folder).folders()) == 2


def test_of_two_batches_from_one_version_the_first_is_saved(spark, tmp_path):
    folder = str(tmp_path / "h")
    told(spark, folder, ROWS[:3])
    one, two = (h.FrontHistory.load(spark, folder).check(batch(spark, rows), KNOWN) for rows in (ROWS[3:6], ROWS[6:9]))
    two.save()
    with pytest.raises(RuntimeError, match="another run"):
        one.save()
    assert told(spark, folder, ROWS[3:6]) == told(spark, str(tmp_path / "whole"), ROWS[:9])


def test_a_small_batch_shuffles_no_history(spark, tmp_path):
    """Rows of history are scanned and dropped below the first exchange: what is shuffled is in proportion to the batch."""
    folder = str(tmp_path / "h")
    told(spark, folder, [(f"i{i}", f"{a}{b}{c}{d}.example", DAY[1]) for i, (a, b, c, d) in enumerate(itertools.product(["ba", "ce", "di"], ["fo", "gu", "la"], ["me", "ni", "po"], ["ra", "se", "tu"]))])
    past = h.FrontHistory.load(spark, folder)
    some = batch(spark, [("z", "bafomeraa.example", DAY[2])])
    for joined in (h.of_small(past.tables["shops"], some.select(F.col("url").alias("front")), ["front"]), h._matches(h.small(h.block_rows(h.with_front(some, KNOWN))), past.tables["blocks"])):
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("FileScan") == 1
    assert told(spark, folder, [("z", "bafomera.example", DAY[2])]) == {("z", "i0")}


def test_leads_takes_the_earliest_source_and_ignores_other_columns(spark):
    c = spark.createDataFrame([("a", "u", 1), ("a", "u", 2), (None, "v", 3), ("b", "w", 1)], "id string, url string, front int")
    s = spark.createDataFrame([("a", DAY[4], "x"), ("a", DAY[2], None), ("z", DAY[1], "x"), (None, DAY[0], "x")], "candidate_id string, discovered_at timestamp_ntz, id string")
    assert {(r.id, r.discovered_at) for r in h.leads(c, s).collect()} == {("a", DAY[2]), ("b", None)}


def test_replay_of_weekly_batches(spark):
    """Nulls, repeats, clashing columns; a lead that a later list names again; what no list names comes first."""
    c = spark.createDataFrame([(i, u, "clash", 1) for i, u, _ in ROWS] + [(None, "x.example", "", 2), ("q", None, None, 3), ("r", "bonolika.in.example", None, 4)], "id string, url string, front string, back int")
    named = [(i, t) for i, _, t in ROWS if t] * 2 + [("d", DAY[59]), ("a", DAY[58]), (None, DAY[1]), ("zz", DAY[2])]
    s = spark.createDataFrame([(i, t, "x") for i, t in named], "candidate_id string, discovered_at timestamp_ntz, week string")
    hosts = spark.createDataFrame([("example", "suffix"), ("in.example", "suffix"), ("shops.example", "platform"), ("tapcards.example", "link_page")], "host string, role string")
    got = {(r.id, r.first_id) for r in h.replayed(spark, c, s, hosts).collect()}
    assert got == WANT | {("r", "b")}
    assert {(r.id, r.first_id) for r in h.replayed(spark, c, s, hosts, weeks=0).collect()} == got
    assert h.replayed(spark, c.limit(0), s.limit(0), hosts.limit(0), weeks=1).count() == 0 and h.replayed(spark, c, s.limit(0), hosts, weeks=0).count() == 0
