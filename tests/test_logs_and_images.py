import datetime as dt
import struct
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from leadloom.__main__ import main
from leadloom.functions import images
from leadloom.operators import logs, refine
from leadloom.plans import storefront

PNG = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 40, 30)


def test_logos(spark):
    svg = b'<svg xmlns="http://www.w3.org/2000/svg" onload="x()"><script>1</script><path fill="#fff" style="fill:url(http://x)"/><a href="http://x"/><use href="#a"/></svg>'
    clean = images.clean_svg(svg)
    assert b"script" not in clean and b"onload" not in clean and b"http://x" not in clean and b"#a" in clean
    assert images.svg_background(b'<svg fill="#FFF"/>') == "dark" and images.svg_background(b'<svg fill="#000000"/>') is None
    assert images.image_size(PNG) == ("png", 40, 30) and images.image_size(b"GIF89a" + struct.pack("<HH", 5, 6)) == ("gif", 5, 6)
    assert images.image_size(b"\xff\xd8\xff\xe0\x00\x04\x00\x00\xff\xc0\x00\x11\x08\x00\x20\x00\x30" + b"\0" * 9) == ("jpg", 48, 32)
    x = spark.createDataFrame([(PNG,), (b"GIF89a" + struct.pack("<HH", 5, 6),), (svg,), (b"junk",), (None,)], "b binary")
    assert [r.l.kind for r in x.select(images.safe_logo(F.col("b")).alias("l")).collect()] == ["png", None, "svg", None, None]
    assert images.clean_svg(b'<!DOCTYPE svg [<!ENTITY a "b">]><svg/>') is None


def test_overrides_and_baseline(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, v string")
    t = [dt.datetime(2025, 1, d) for d in (1, 2)]
    log = spark.createDataFrame([("a", "old", t[0]), ("a", "new", t[1])], "k string, v string, at timestamp_ntz")
    assert {tuple(r) for r in logs.with_overrides(rows, "k", "v", log).select("k", "v").collect()} == {("a", "new"), ("b", "y")}
    base = spark.createDataFrame([("a", "x"), ("b", None), ("c", "z")], "k string, v string")
    assert {tuple(r) for r in logs.against_baseline(rows.unionByName(spark.createDataFrame([("n", None)], rows.schema)), base, "k", "v").collect()} == {("a", "same"), ("b", "changed"), ("c", "missing"), ("n", "new")}


def test_top_valid_and_reason(spark):
    x = spark.createDataFrame([("a", 9, 1, False), ("a", 8, 2, True), ("a", 7, 3, True), ("b", 1, 4, False)], "k string, s int, id int, ok boolean")
    assert [r.id for r in logs.top_valid(x, "k", "s", "id", F.col("ok")).collect()] == [2]
    assert [r.id for r in logs.top_valid(x, "k", "s", "id", F.col("ok"), 1).collect()] == []
    y = spark.createDataFrame([("",), (None,), ("why",)], "r string").select(logs.first_reason((F.lit(True), F.col("r")), (F.lit(True), F.lit("none"))).alias("r"))
    assert [r.r for r in y.collect()] == ["none", "none", "why"]


def test_reviews(spark):
    s = spark.createDataFrame([("a", "verified", "verified"), ("b", "verified", "conflict")], "store_id string, shopify string, india string")
    e = spark.createDataFrame([("a", "f", "1", dt.datetime(2025, 1, 1)), ("a", "f", "2", None)], "store_id string, field string, value string, observed_at timestamp_ntz")
    new = spark.createDataFrame([(1, "a", "confirmed", "", "r"), (2, "b", "confirmed", "", "r"), (3, "c", "excluded", "", "r"), (4, "b", "maybe", None, None), (5, "b", "excluded", "", "r")], "id int, candidate_id string, decision string, note string, reviewer string")
    good, bad = logs.checked_reviews(new, s, e)
    assert {r.id: r.error for r in bad.collect()} == {2: "not verified both ways", 3: "no evidence was collected", 4: "invalid decision"}
    kept = {r.id: r.evidence_hash for r in good.collect()}
    assert set(kept) == {1, 5} and len(kept[1]) == 64 and kept[5] is None
    again = lambda x: logs.evidence_hashes(x).first().evidence_hash
    assert again(e.orderBy("value").unionByName(e)) == again(e.repartition(3)) == kept[1] != again(e.where("value = '1'"))


def test_refine_is_idempotent(spark):
    rows = [("a", "emails", "x@shop.in", ""), ("a", "emails", "bad", ""), ("a", "phones", "98765 43210", ""), ("a", "phones", "12", ""), ("a", "shopify", "/x/icon.png", "delivery"), ("a", "state", "y", "")]
    e = spark.createDataFrame(rows, "store_id string, field string, value string, family string")
    once = refine.refined(e)
    assert once.count() == 3 and refine.refined(once).count() == 3
    s = spark.createDataFrame([("a", "accepted"), ("b", "review")], "store_id string, status string")
    assert [r.store_id for r in refine.demoted(s, once).collect()] == ["a"]


def test_links_that_show_another_address_and_unfit_logos(spark):
    page = "<a href='mailto:old%40shop.in?x=1'>new@shop.in</a><a href='mailto:kept@shop.in'>Write</a><a href='mailto:both@shop.in'>new@shop.in</a><a href='mailto:x@shop.in'>both@shop.in</a>"
    pages = spark.createDataFrame([("a", 0, "https://shop.in/", page)], "store_id string, page_no int, url string, html string")
    rows = [("a", "emails", v, "https://shop.in/", r) for v, r in [("old@shop.in", "mailto_link"), ("old@shop.in", "visible_email"), ("kept@shop.in", "mailto_link"), ("both@shop.in", "mailto_link"), ("new@shop.in", "mailto_link")]] + [("b", "emails", "old@shop.in", "https://shop.in/", "mailto_link")]
    e = spark.createDataFrame(rows, "store_id string, field string, value string, source_url string, rule string")
    once = refine.uncontradicted(e, storefront.parsed_pages(pages))
    assert {tuple(r) for r in once.collect()} == set(rows[1:]) == {tuple(r) for r in refine.uncontradicted(once, storefront.parsed_pages(pages)).collect()}
    s = spark.createDataFrame([("a", "u"), ("b", "v"), ("c", None)], "store_id string, logo_url string")
    c = spark.createDataFrame([("a", "u", 3), ("a", "w", 1), ("b", "u", 2)], "store_id string, src string, score int")
    assert {tuple(r) for r in refine.eligible_logos(s, c).collect()} == {("a", "u"), ("b", None), ("c", None)}


def test_command_line(capsys):
    assert main(["list"]) == 0 and "p3_found" in capsys.readouterr().out


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").is_dir(), reason="no test tables")
def test_verbs(spark, tmp_path, capsys):
    (tmp_path / "in.json").write_text('[{"url":"a.in","source":"s","source_url":"u"},{"url":"bad","source":"s","source_url":"u"}]')
    assert main(["import", str(tmp_path / "in.json"), str(tmp_path / "i")]) == 0 and spark.read.parquet(str(tmp_path / "i" / "candidates.parquet")).count() == 1
    out = str(tmp_path / "o")
    assert main(["export", "/root/testdata/sf0.001", out]) == 0 and main(["validate", "/root/testdata/sf0.001", out]) == 1
    assert "files changed 0, cells changed 0" in capsys.readouterr().out
