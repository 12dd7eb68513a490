import datetime as dt

import pytest
from pyspark.sql import functions as F

from leadloom.operators import browse, export, ledger, statistics, validation
from leadloom.sources import leads
from leadloom.streaming import observations as streams


def test_csv_safe(spark):
    x = spark.createDataFrame([("=1+2",), (" @x",), ("\tx",), ("plain",), (None,)], "c string")
    assert [r.c for r in x.select(export.csv_safe(F.col("c")).alias("c")).collect()] == ["'=1+2", "' @x", "'\tx", "plain", ""]


def test_snapshot_digest_ignores_partitioning(spark):
    x = spark.range(500).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("v"))
    a = [export.snapshot_digest(export.row_digest(y, "k"), "k", 64).first() for y in (x, x.repartition(7), x.orderBy(F.desc("v")).coalesce(1))]
    assert a[0] == a[1] == a[2] and a[0].rows == 500
    assert export.snapshot_digest(export.row_digest(x.where("v < 499"), "k"), "k", 64).first().digest != a[0].digest


def test_snapshot_files(spark, tmp_path):
    m = export.write_snapshot(spark, str(tmp_path), {"a.csv": spark.range(3), "b.jsonl": spark.range(2)}, "f" * 64)
    assert m["snapshot_id"] == "f" * 16 and m["rows"] == {"a.csv": 3, "b.jsonl": 2} and spark.read.json(str(tmp_path / "b.jsonl")).count() == 2
    manifest, back = export.read_snapshot(spark, str(tmp_path))
    assert manifest == m and sorted(r.id for r in back["a.csv"].collect()) == ["0", "1", "2"] and export.changed_files(spark, str(tmp_path)).count() == 0
    part = max((tmp_path / "b.jsonl").glob("part-*"), key=lambda p: p.stat().st_size)
    part.write_bytes(part.read_bytes() + b"\n")
    (part.parent / f".{part.name}.crc").unlink()
    max((tmp_path / "a.csv").glob("part-*"), key=lambda p: p.stat().st_size).unlink()
    assert sorted((r.file.split("/")[0], r.state) for r in export.changed_files(spark, str(tmp_path)).collect()) == [("a.csv", "missing"), ("b.jsonl", "changed")]
    z, sums = export.zip_bundle({"x": b"1"})
    assert z == export.zip_bundle({"x": b"1"})[0] and len(sums["x"]) == 64


def test_page_is_clamped(spark):
    x = spark.range(250).orderBy("id")
    assert [r.id for r in browse.page(x, 0, 1000).collect()][-1] == 99 and browse.page(x, 3, 100).count() == 50 and browse.page(x, 9).count() == 0


def test_last_page_and_detail(spark):
    assert [browse.last_page(n, 12, 25) for n in (0, 1, 3, 9)] == [1, 1, 3, 3] and browse.last_page(4, 12, 0) == 1
    o = spark.createDataFrame([(i, "a" if i % 2 else "b", "page", "ok", None) for i in range(9)], "id int, candidate_id string, kind string, outcome string, observed_at timestamp_ntz")
    r = browse.detail(spark.createDataFrame([("a", 1), ("b", 2)], "id string, x int"), o, "a", 3).collect()
    assert len(r) == 1 and [x.id for x in r[0].observations] == [7, 5, 3]
    assert tuple(browse.summary(spark.createDataFrame([("review",), ("accepted",), ("x",)], "status string")).first()) == (3, 1, 1, 33)


def test_sinks(spark, tmp_path):
    x = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    export.write_by_key(x, str(tmp_path / "by"), "k")
    assert sorted(p.name for p in (tmp_path / "by").iterdir() if p.is_dir()) == ["k=a", "k=b"]
    assert export.publish_if_any(spark, str(tmp_path / "s"), {"x.csv": x.limit(0)}, "0" * 64, "x.csv") is None and not (tmp_path / "s").exists()
    assert export.publish_if_any(spark, str(tmp_path / "s"), {"x.csv": x}, "0" * 64, "x.csv")["rows"] == {"x.csv": 3}
    text = leads.from_text(spark, "a.in\r\n\n b.in ", "paste", "https://p.example/")
    assert [r.url for r in text.collect()] == ["a.in", "b.in"]


def test_import_leads(spark):
    e = [("A.in/x", "s", "u"), ("https://a.in/", "t", "u"), ("bad", "s", "u"), ("b.in", " ", "u"), (None, "s", "u")]
    entries = spark.createDataFrame(e, "url string, source string, source_url string")
    new, att, n = ledger.import_leads(entries, spark.createDataFrame([], "id string"))
    assert tuple(n.first()) == (1, 1, 3) and new.count() == 1 and att.count() == 2
    assert tuple(ledger.import_leads(entries, new)[2].first()) == (0, 2, 3)


def test_missingness_and_percent(spark):
    s = spark.createDataFrame([([], None, {}, "", "d", None, "x"), (["a"], ["p"], {"n": ["l"]}, "c", None, "l", None)], "emails array<string>, phones array<string>, socials map<string,array<string>>, category string, description string, logo_url string, state string")
    assert {(r.missing, r.percent_missing) for r in statistics.missingness(s).collect()} == {(1, 50.0)}
    assert {r.percent_missing for r in statistics.missingness(s.limit(0)).collect()} == {None}
    assert {r.percent for r in statistics.coverage(s.limit(0)).collect()} == {0}
    assert spark.range(1).select(statistics.percent(F.lit(1), F.lit(16))).first()[0] == 6.2


STORE = "store_id string, domain_url string, emails array<string>, phones array<string>, socials map<string,array<string>>, category string, description string, logo_url string, state string, shop_identity string, shopify string, india string, observed_at timestamp_ntz"


def test_each_violation_is_found(spark):
    row = lambda i, **x: {"store_id": i, "domain_url": f"https://{i}.in/", "emails": ["a@shop.in"], "phones": None, "socials": {"instagram": ["https://instagram.com/a"]}, "category": None, "description": None, "logo_url": None, "state": "", "shop_identity": i, "shopify": "verified", "india": "verified", "observed_at": None} | x
    cases = {
        "ok": {}, "unverified": {"india": "conflict"}, "email": {"emails": ["a@example.com"]}, "social": {"socials": {"instagram": ["https://instagram.com/p/x"]}}, "missing_identity": {"shop_identity": None},
        "unsupported_field": {"state": "Arkanadu"}, "attribution": {}, "families": {}, "runtime": {}, "provenance": {}, "required_evidence": {}, "repeated_domain": {"domain_url": "https://ok.in/"}, "repeated_identity": {"shop_identity": "ok"},
    }
    stores = spark.createDataFrame([tuple(row(i, **x).values()) for i, x in cases.items()], STORE)
    js = "https://cdn.shopify.com/shopifycloud/a.js"
    fact = lambda i, field, value, family, h="0" * 64: (i, field, value, "https://u/", h, dt.datetime(2025, 1, 1), family)
    facts = [f for i in cases for f in (fact(i, "shopify", i, "identity"), fact(i, "shopify", "x", "commerce"), fact(i, "india", "India", ""), fact(i, "emails", "x", ""), fact(i, "socials", "x", ""), fact(i, "shopify", js, "delivery", "" if i == "provenance" else "0" * 64))]
    facts = [f for f in facts if not (f[0] == "families" and f[6] == "commerce") and not (f[0] == "required_evidence" and f[1] == "india")]
    facts = [(*f[:2], "/icon.png", *f[3:]) if f[0] == "runtime" and f[6] == "delivery" else f for f in facts]
    evidence = spark.createDataFrame(facts, "store_id string, field string, value string, source_url string, content_hash string, observed_at timestamp_ntz, family string")
    sources = spark.createDataFrame([(i,) for i in cases if i != "attribution"], "candidate_id string")
    v = validation.store_violations(stores, evidence, sources)
    got = {(r.code, r.store_id) for r in v.collect()}
    assert got == {(i, i) for i in cases if i != "ok"} | {("repeated_domain", "ok"), ("repeated_identity", "ok")}
    assert [r.field for r in v.where("code = 'unsupported_field'").collect()] == ["state"] and not validation.verdict(v).first().passed
    good = stores.where("store_id = 'ok'")
    assert validation.verdict(validation.store_violations(good, evidence, sources)).first().passed
    cells = export.records(stores)
    assert validation.cell_differences(stores, cells).count() == 0
    bad = cells.where("store_id <> 'email'").withColumn("state", F.when(F.col("store_id") == "ok", "x").otherwise(F.col("state")))
    assert {tuple(r) for r in validation.cell_differences(stores, bad).collect()} == {("ok", "state"), ("email", "store_id")}
    assert validation.counts_differ(a=good, b=good).count() == 0 and validation.counts_differ(a=good, b=stores).count() == 2


def test_differences_are_multisets(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (3,)], "x int")
    assert sorted(tuple(r) for r in validation.differences(a, b).collect()) == [("left", 1), ("left", 2), ("right", 3)]


@pytest.fixture
def log(spark, tmp_path):
    base = dt.datetime(2025, 1, 1)
    for part in range(3):
        rows = [(i, f"c{i % 4}", base + dt.timedelta(minutes=i)) for i in range(part * 10, part * 10 + 15)]
        spark.createDataFrame(rows, "id int, candidate string, at timestamp_ntz").coalesce(1).write.mode("append").parquet(str(tmp_path / "log.parquet"))
    return str(tmp_path)


def test_streams_in_several_triggers(spark, log):
    batch = spark.read.parquet(log + "/log.parquet")
    s = lambda: streams.log_stream(spark, log, "log", 1)
    assert streams.run_append(streams.deduplicated(s())).count() == batch.select("id").distinct().count() == 35
    got = {r.candidate: r.id for r in streams.run_complete(streams.latest_by(s(), "candidate", "id", "at")).collect()}
    assert got == {r.candidate: r.id for r in batch.groupBy("candidate").agg(F.max("id").alias("id")).collect()}
    assert streams.run_complete(streams.windows(s(), "at", "10 minutes")).agg(F.sum("n")).first()[0] == 45
    assert streams.run_complete(streams.sessions(s(), "candidate", "at", "5 minutes")).agg(F.sum("n")).first()[0] == 45
    assert streams.run_append(streams.deduplicated_within(s(), "id", "at", "1 day")).count() == 35
