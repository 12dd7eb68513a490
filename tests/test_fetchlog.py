import datetime as dt
import random

from pyspark.sql import functions as F

from leadloom.operators import fetchlog


def test_paced_is_the_recurrence(spark, monkeypatch):
    monkeypatch.setattr(fetchlog, "SLICE", 7)
    rng, base = random.Random(1), dt.datetime(2025, 1, 1)
    rows = [(i, "hot" if i % 3 else f"h{i % 5}", base + dt.timedelta(seconds=rng.randrange(90))) for i in range(120)] + [(900, None, base), (901, "hot", None)]
    got = fetchlog.paced(spark.createDataFrame(rows, "id int, host string, at timestamp_ntz"), "host", "at", "id", 2.0)
    got = {r.id: r.start_us for r in got.collect()}
    want, last = {}, {}
    for i, h, t in sorted((r for r in rows if r[1] and r[2]), key=lambda r: (r[1], r[2], r[0])):
        us = int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)
        last[h] = want[i] = max(us, last.get(h, 0) + 2_000_000)
    assert got == want


def test_redirects(spark):
    u = lambda x: f"https://{x}.example/"
    e = [(u(a), u(b)) for a, b in [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), *[(f"n{i}", f"n{i + 1}") for i in range(9)]]] + [(u("p"), u("q")), (u("q"), "http://127.0.0.1/"), (u("r"), "ftp://a.example/")]
    rows = spark.createDataFrame(e, "url string, location string").withColumn("_bad", F.lit("clash"))
    got = {r.url: (r.final_url, r.outcome) for r in fetchlog.redirects(rows).collect()}
    assert got[u("a")] == (u("c"), "end") and got[u("b")] == (u("c"), "end") and got[u("x")][1] == "loop" and got[u("n0")][1] == "limit" and got[u("n6")] == (u("n9"), "end")
    assert got[u("p")] == (u("q"), "unsafe") and got[u("q")] == (u("q"), "unsafe") and got[u("r")] == (u("r"), "unsafe")
    barred = rows.withColumn("allowed", F.col("location") != u("c"))
    assert {r.url: r.outcome for r in fetchlog.redirects(barred).collect()}[u("a")] == "blocked"


def test_busy_answers_hold_a_host_back(spark, monkeypatch):
    monkeypatch.setattr(fetchlog, "SLICE", 2)
    base = dt.datetime(2025, 1, 1)
    log = [(1, "h", 0, 200, None), (2, "h", 1, 429, None), (3, "h", 2, 200, None), (4, "h", 3, 503, "40"), (5, "h", 5, 200, None), (6, "h", 60, 200, None), (7, "k", 2, 200, None)]
    rows = spark.createDataFrame([(i, h, base + dt.timedelta(seconds=s), s * 1_000_000, c, r, i) for i, h, s, c, r in log], "id int, host string, at timestamp_ntz, start_us long, status_code int, retry_after string, k int")
    got = {r.id: (r.held_us and r.held_us // 1_000_000, r.deferred) for r in fetchlog.pushed(rows, "host", "at", 2.0).collect()}
    assert got == {1: (None, False), 2: (None, False), 3: (6, False), 4: (6, False), 5: (43, True), 6: (None, False), 7: (None, False)}


def test_robots_answers(spark):
    t = dt.datetime(2025, 1, 2)
    rows = [("ok", 200, "Text/Plain; charset=utf-8", t, "rules"), ("ok", 200, None, t, "rules"), ("ok", 200, "text/html", t, "defer"), ("http_error", 404, None, t, "allow"), ("http_error", 500, None, t, "defer"), ("ok", 200, "", t - dt.timedelta(days=2), "expired"), ("ok", 200, "", None, "expired")]
    x = spark.createDataFrame(rows, "o string, c int, k string, t timestamp_ntz, want string")
    got = x.select("want", fetchlog.robots_state(F.col("o"), F.col("c"), F.col("k"), F.col("t"), F.lit(t)).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_robots():
    t = "User-agent: a\nUser-agent: b\nDisallow: /x\nAllow: /x/y$\n\n# c\nUser-agent: *\nDisallow: /"
    assert not fetchlog.robots_allow(t, "a/1", "/x/1") and fetchlog.robots_allow(t, "b", "/x/y") and not fetchlog.robots_allow(t, "b", "/x/y/z")
    assert not fetchlog.robots_allow(t, "other", "/") and fetchlog.robots_allow("", "other", "/")


def test_retry_after_and_budget(spark):
    x = spark.createDataFrame([("3",), ("-2",), ("soon",), (None,)], "h string")
    assert [r.s for r in x.select(fetchlog.retry_after(F.col("h")).alias("s")).collect()] == [3.0, 0.0, 0.0, 0.0]
    b = spark.createDataFrame([(b"abcdef",), (b"ab",)], "b binary").select(fetchlog.within_budget(F.col("b"), 4).alias("r")).collect()
    assert [(r.r.outcome, bytes(r.r.body)) for r in b] == [("too_large", b"abcd"), ("ok", b"ab")]


def test_waits_beyond_bigint(spark):
    base = dt.datetime(2025, 1, 1)
    rows = [(i, "hot", None) for i in range(1, 1101)] + [(2001, "long", "1e300"), (2002, "long", "9"), (2003, "long", None)]
    o = spark.createDataFrame([(i, "r", "c", u, "fetch_failed", None, base, h) for i, u, h in rows], "id long, run_id string, candidate_id string, url string, outcome string, status_code int, observed_at timestamp_ntz, retry_after string")
    got = {(r.url, r.attempt): (r.wait_s, r.again) for r in fetchlog.retries(o).collect()}
    want = {("hot", k): (min(2**k, 2**63 - 1), k <= 2) for k in range(1, 1101)}
    assert got == want | {("long", 1): (2**63 - 1, False), ("long", 2): (9, True), ("long", 3): (8, False)}
    assert {r.attempt: r.wait_s for r in fetchlog.retries(o.drop("retry_after").where("url = 'hot'")).collect()} == {k: w for (_, k), (w, _) in want.items()}
