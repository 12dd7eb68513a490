import datetime as dt

import pytest
from pyspark.sql import functions as F

from leadloom.operators import incremental as inc

T = [dt.datetime(2025, 1, d) for d in range(1, 9)]
CAND = "id string, url string, status string, updated_at timestamp_ntz, extra string"
EV = "store_id string, field string, value string, observed_at timestamp_ntz"
ITEMS = "run_id string, candidate_id string, status string, result_json string, error string"
RUNS = "id string, started_at timestamp_ntz, status string"


def found(spark, cand, ev, items, runs):
    x = inc.candidates_to_process(spark.createDataFrame(cand, CAND), spark.createDataFrame(ev, EV), spark.createDataFrame(items, ITEMS), spark.createDataFrame(runs, RUNS))
    return {r.candidate_id: r.change for r in x.collect()}


def test_candidates_to_process(spark):
    cand = [
        ("same", "u", "ok", T[3], "x"), ("same", "u", "old", T[1], "x"), ("same", "u", "older", None, "x"),
        ("status", "u", "new", T[3], None), ("evidence", "u", "ok", None, None), ("never", "u", "ok", T[0], None),
        ("failed", "u", "ok", T[0], None), ("later", "u", "ok", T[7], None), ("nullstatus", "u", None, T[7], None), (None, "u", "ok", T[1], None),
    ]
    ev = [("same", "f", None, T[0])] * 2 + [("same", "f", "", T[0]), ("evidence", "f", "a", T[0]), (None, "f", "a", T[0])]
    ok = lambda c, n, s="ok", run="r2": (run, c, "done", f'{{"evidence_rows": {n}, "status":"{s}"}}', None)
    items = [
        ok("same", 2), ok("same", 2), ok("same", 9, run="r1"), ok("status", 0), ok("evidence", 0), ("r2", "failed", "done", None, "lost"), ("r2", "never", "pending", None, None),
        ("r3", "later", "done", '{"status": "ok", "updated_at": null}', None), ("r2", "nullstatus", "done", '{"evidence_rows":0}', None), ok("failed", 0, run="gone") [:3] + (None, "x"),
    ]
    runs = [("r1", T[1], "completed"), ("r2", T[2], "failed"), ("r2", T[2], "failed"), ("r3", T[4], "failed")]
    assert found(spark, cand, ev, items, runs) == {"status": "changed", "evidence": "changed", "never": "new", "failed": "new"}


def test_empty_tables(spark):
    assert found(spark, [], [], [], []) == {}
    assert found(spark, [("a", "u", "s", None, None)], [], [], []) == {"a": "new"}


def rows(spark, **x):
    return spark.createDataFrame(list(x.items()), "key string, content_hash string")


def keys(df):
    return {r.key: r.change for r in df.collect()}


def test_change_log_survives_failures(spark, tmp_path):
    log = inc.ChangeLog(spark, str(tmp_path / "state"))
    one = rows(spark, a="1", b="1")
    assert keys(log.changes(one)) == {"a": "new", "b": "new"}
    one.write.parquet(log.versions.draft())  # a run that died before its pointer
    assert log.versions.current() == -1 and keys(log.changes(one)) == {"a": "new", "b": "new"}
    assert log.commit(one) == 0 and keys(log.changes(one)) == {}
    two = rows(spark, a="1", b="2", c="1")
    assert keys(log.changes(two)) == {"b": "changed", "c": "new"}
    assert log.commit(log.changes(two)) == 1
    assert keys(log.changes(two)) == {} and {r.key for r in log.state().collect()} == {"a", "b", "c"}


def test_of_two_runs_from_one_version_the_first_commits(spark, tmp_path):
    a, b = (inc.ChangeLog(spark, str(tmp_path / "state")) for _ in "ab")
    mine, theirs = rows(spark, a="1", b="1"), rows(spark, a="1", c="1")
    assert keys(a.changes(mine)) == {"a": "new", "b": "new"} and keys(b.changes(theirs)) == {"a": "new", "c": "new"}
    assert a.commit(mine) == 0
    with pytest.raises(RuntimeError, match="another run"):
        b.commit(theirs)
    assert {r.key for r in a.state().collect()} == {"a", "b"}
    assert keys(b.changes(theirs)) == {"c": "new"} and b.commit(theirs) == 1 and {r.key for r in a.state().collect()} == {"a", "b", "c"}


def test_commits_write_what_was_processed_and_compact_now_and_then(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inc.ChangeLog, "COMPACT", 3)
    log, sizes = inc.ChangeLog(spark, str(tmp_path / "state")), []
    for i in range(5):
        log.commit(rows(spark, a=str(9 - i), **{f"k{i}": "1"}))
        sizes.append(len(log.versions.folders()))
    assert sizes == [1, 2, 3, 1, 2]
    assert {r.key: r.content_hash for r in log.state().collect()} == {"a": "5"} | {f"k{i}": "1" for i in range(5)}


def test_hashes(spark):
    x = spark.createDataFrame([(None, "a"), ("a", None), ("", "a")], "p string, q string")
    assert x.select(inc.content_hash("p", "q").alias("h")).distinct().count() == 3
    assert x.select(*inc.row_key(x)).distinct().count() == 3
    y = spark.createDataFrame([("k", {"a": 1}), ("k", {"a": 1}), ("k", {"a": 2}), (None, None)], "k string, m map<string,int>")
    assert [tuple(r) for r in inc.distinct_rows_by(y, "k").collect()] == [("k", 2)]


def test_latest_ties(spark):
    x = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("b", None, "z"), (None, 3, "w")], "k string, o int, v string")
    assert sorted(tuple(r) for r in inc.latest(x, "k", "o", "v").select("k", "v").collect()) == [("a", "y"), ("b", "z")]
    assert F is not None
