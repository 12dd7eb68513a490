import datetime as dt

from pyspark.sql import functions as F

from leadloom.llm import sampling as s

EMPTY = "store_id string, probability double"


def ids(df):
    return {r.store_id for r in df.collect()}


def pop(spark, n, weight="1"):
    return spark.range(n).select(F.concat(F.lit("s"), "id").alias("store_id"), F.expr(weight).cast("double").alias("weight"), F.lit(1).alias("probability"))


def test_same_at_any_partitioning(spark):
    p, e = pop(spark, 3000), spark.createDataFrame([], EMPTY)
    a, b = (ids(s.draw(x, e, 0.1)[0]) for x in (p, p.repartition(9).unionByName(p)))
    assert a == b and 230 < len(a) < 370 and a != ids(s.draw(p, e, 0.1, seed=1)[0])


def test_growth_keeps_what_was_selected(spark):
    first, state = s.draw(pop(spark, 1000), spark.createDataFrame([], EMPTY), 0.1)
    second, state = s.draw(pop(spark, 2000, "0.2 + id % 3"), state, 0.1)
    third, _ = s.draw(pop(spark, 2000, "0.01"), state, 0.05)
    assert ids(first) <= ids(second) <= ids(third)
    gone, state = s.draw(pop(spark, 10), state, 0.1)
    assert ids(gone) == {i for i in ids(third) if int(i[1:]) < 10} and ids(s.draw(pop(spark, 2000, "0"), state, 0.1)[0]) == ids(second)


def test_weights(spark):
    p = spark.createDataFrame([("a", None), ("b", -3.0), ("c", 1e9), (None, 5.0)], "store_id string, weight double")
    sample, state = s.draw(p, spark.createDataFrame([], EMPTY), 0.5)
    assert [(r.store_id, r.probability, r.kept) for r in sample.collect()] == [("c", 1.0, False)] and state.count() == 3


def test_not_kept(spark):
    t = [dt.datetime(2025, 1, d) for d in (1, 2)]
    log = [(" A1", 1), ("a1", 1), ("b2\n", 1), ("c3", 1), ("d4", 1), ("C3", 2), ("e5", 2), ("gone", 2), (None, 1), ("x", None), ("e5", 4), ("a1", 4)]
    stores = [("a1", "accepted", 3, t[1]), ("a1", "review", 3, t[0]), ("b2", "review", 1, t[1]), ("b2", "accepted", 1, t[0]), ("c3", "accepted", None, None), ("d4", "accepted", 2, t[0]), ("e5", "accepted", 1, t[0]), (None, "accepted", 1, t[0])]
    audit = spark.createDataFrame(log, "store_id string, wave int")
    rows = spark.createDataFrame(stores, "store_id string, status string, pages_checked int, observed_at timestamp_ntz")
    assert {tuple(r) for r in s.not_kept(audit, rows).collect()} == {("a1", 2), ("d4", 2), ("c3", 4)}
    assert s.not_kept(audit.limit(0), rows).count() == 0 and s.not_kept(audit, rows.limit(0)).count() == 0


def test_replay_draws_with_the_state_of_the_wave_before(spark):
    p = pop(spark, 400).drop("probability")
    log = [(f"S{i} ", 1) for i in range(40)] + [(f"s{i}", 2) for i in range(0, 40, 2)] + [(f"s{i}", 5) for i in range(40)]
    rows = s.replay(spark.createDataFrame(log, "store_id string, wave int"), p, 0.05).collect()
    drawn = ids(s.draw(p, spark.createDataFrame([], EMPTY), 0.05)[0])
    even = {f"s{i}" for i in range(0, 40, 2)}
    of = lambda wave, **flags: {r.store_id for r in rows if r.wave == wave and all(r[k] == v for k, v in flags.items())}
    assert of(1) == drawn and not of(1, kept=True)
    assert of(2, kept=True) == {f"s{i}" for i in range(40)} and of(2) == drawn | of(2, kept=True) and of(2, kept=True, recorded=False) == of(2, kept=True) - even
    assert of(5, kept=True) == even and not of(5, kept=True, recorded=False)


def test_state_is_kept_between_runs(spark, tmp_path):
    run = lambda p, c: ids(s.SampleState(spark, str(tmp_path / "s")).draw(p.drop("probability"), c))
    first, second, third = run(pop(spark, 500), 0.1), run(pop(spark, 900), 0.1), run(pop(spark, 900), 0.01)
    assert first <= second == third and s.SampleState(spark, str(tmp_path / "s")).read().count() == 900
