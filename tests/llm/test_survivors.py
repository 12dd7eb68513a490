import datetime as dt
import random
from collections import Counter

import pytest

from leadloom.llm import queries
from leadloom.llm import survivors as s

T = [dt.datetime(2025, 1, d) for d in range(1, 20)]
STORE = "store_id string, domain_url string, name string, emails array<string>, phones array<string>, socials map<string,array<string>>, category string, description string, logo_url string, state string, shop_identity string, aliases array<string>, observed_at timestamp_ntz, group_id string, source int"
KNOWN = [("example", "suffix"), ("in.example", "suffix"), ("shops.example", "platform"), ("tapcards.example", "link_page"), ("unknown.shops.example", "placeholder")]
SOURCE = "candidate_id string, name string, discovered_at timestamp_ntz"


def store(i, url, ident=None, aliases=None, emails=None, name=None, category=None, state=None, at=T[5]):
    return (i, url, name, emails, None, {}, category, None, "", state, ident, aliases, at, "clash", 7)


def build(spark, rows, sources=()):
    return s.Survivors(spark.createDataFrame(rows, STORE), spark.createDataFrame(list(sources), SOURCE), spark.createDataFrame(KNOWN, "host string, role string"))


def test_groups_and_survivors(spark):
    rows = [
        store("a", "one.shops.example", "ONE.shops.example/", category="x", state="y"), store("b", "https://one.in.example/p", "https://one.shops.example"), store("b", "https://old.example", at=T[1]),
        store("c", None, None, ["http://www.one.in.example/z", None, "tapcards.example/?f=bio"]), store("d", "two.example", "unknown.shops.example", ["tapcards.example"]), store("e", "three.example", "n/a", ["-", ""]),
        store("f", "unknown.shops.example", "null"), store("g", "old.example", "unknown.shops.example"), store(None, "two.example"), store("d", "two.example", "unknown.shops.example", ["tapcards.example"]),
    ]
    got = {(r.group_id, r.store_id, r.survivor_id) for r in build(spark, rows).members.collect()}
    assert got == {("a", "a", "b"), ("a", "b", "b"), ("a", "c", "b")}


def test_survivor_order(spark):
    rows = [store("a", "z.example", "q.shops.example"), store("b", "https://b.example/", "q.shops.example"), store("c", "https://a.example/", "q.shops.example"), store("d", "q.shops.example", None, state="s", category="c")]
    assert {r.survivor_id for r in build(spark, rows).members.collect()} == {"c"}
    rows[0] = store("a", "z.example", "q.shops.example", state="s")
    assert {r.survivor_id for r in build(spark, rows).members.collect()} == {"a"}


def test_empty(spark):
    x = build(spark, [])
    assert x.members.count() == 0 and x.records.count() == 0


def test_records(spark):
    rows = [store(f"s{i}", f"s{i}.example", "q.shops.example", None, [f" MAILTO:care@s{i}.example.", "team@agency.example"], "Clay  Lane" if i else "Other", state="Arkanadu" if i else None) for i in range(3)]
    rows += [store(f"t{i}{k}", f"t{i}{k}.example", f"t{i}.shops.example", None, ["team@agency.example"]) for i in range(4) for k in range(2)]
    r = {x.group_id: x for x in build(spark, rows, [(f"s{i}", f"L{i}", T[i]) for i in range(3)]).records.collect()}
    assert r["s0"].name == "Clay Lane" and r["s0"].state == "Arkanadu" and r["s0"].emails == ["care@s0.example", "care@s1.example", "care@s2.example"] and r["t00"].emails is None and r["t00"].agency_emails == ["team@agency.example"] == r["s0"].agency_emails


def test_records_hold_every_field_of_all_stores(spark):
    rows = [
        ("a", "HTTPS://a.example/home", "n", None, ["+91 98765 43210", " ", "022-1 x5"], {"Net": ["https://net.example/a"], "vid": None}, None, None, None, None, "q.shops.example", ["https://a.example/old", None, "-"], T[5], "clash", 7),
        ("b", "https://b.example/", "n", None, ["9876543210", "022-1 x6"], {"net": ["https://net.example/b", "https://net.example/a "]}, None, None, None, None, "https://q.shops.example/", ["tapcards.example/?f=bio"], T[5], "clash", 7),
        ("c", "https://b.example/", "n", None, None, None, None, None, None, None, "n/a", None, T[5], "clash", 7),
        ("d", "tapcards.example", "n", None, None, None, None, None, None, None, "unknown.shops.example", ["b.example"], T[5], "clash", 7),
    ]
    (r,) = build(spark, rows, [(i, f"L{i}", T[1]) for i in "abcd"]).records.collect()
    assert (r.domain_url, r.shop_identity) == ("https://b.example/", "q.shops.example") and 0 < r.p_domain_url < 1 and 0 < r.p_shop_identity <= 1
    assert r.phones == ["+91 98765 43210", "022-1 x5", "022-1 x6"] or r.phones == ["022-1 x5", "022-1 x6", "9876543210"]
    assert r.socials == {"net": ["https://net.example/a", "https://net.example/b"]}
    assert r.aliases == ["HTTPS://a.example/home", "b.example", "https://a.example/old", "https://b.example/", "tapcards.example", "tapcards.example/?f=bio"]


def test_found_rows_come_through_the_fusion(spark, tmp_path, monkeypatch):
    rows = [store("a", "one.shops.example", "q.shops.example", name="Fair"), store("b", "https://b.example/", "q.shops.example", name="False"), store("c", "c.example", None, ["b.example"], name=" fair"), store("d", "d.example", name="Alone")]
    tables = {"stores": (rows, STORE), "sources": ([(i, f"L{i}", T[1]) for i in "abcd"], SOURCE), "known_hosts": (KNOWN, "host string, role string")}
    for name, (x, kind) in tables.items():
        spark.createDataFrame(x, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    fuse, runs = s.fuse, []

    def watched(claimed, rounds):
        runs.append(({(r.field, r.value, r.source) for r in claimed.where("field = 'name'").collect()}, rounds))
        return fuse(claimed, rounds)

    monkeypatch.setattr(s, "fuse", watched)
    got = {tuple(r) for r in queries.p2_found(spark, str(tmp_path)).collect()}
    assert got == {("a", "a", "c"), ("a", "b", "c"), ("a", "c", "c")}
    assert runs == [({("name", "fair", "la"), ("name", "false", "lb"), ("name", "fair", "lc")}, s.ROUNDS)]


def test_members_are_those_of_the_fused_records(spark, monkeypatch):
    """The fused values are really computed: a plan from which Spark drops them would not meet the fault in them."""
    fused = spark.range(1).selectExpr("'a' AS group_id", "'name' AS field", "raise_error('read') AS value", "1.0D AS p")
    monkeypatch.setattr(s.Survivors, "fused", fused)
    with pytest.raises(Exception, match="read"):
        build(spark, [store("a", "one.example"), store("b", "https://one.example/b")]).members.collect()


def test_no_email_is_left_out(spark):
    rows = [store(f"s{i}", f"s{i}.example", "q.shops.example", None, [f"m{i}-{k:02}@s{i}.example" for k in range(30)]) for i in range(2)]
    x, every = build(spark, rows), sorted(e for r in rows for e in r[3])
    assert x.records.first().emails == every
    assert sorted(r.value for r in x.values.where("field = 'emails'").collect()) == every


def test_copied_votes_are_discounted(spark):
    """A bad list and its two copies outvote four fair lists where those do not all agree, unless copying is found."""
    rng, claims = random.Random(8), []
    for g in range(120):
        bad = "true" if rng.random() < 0.4 else f"false{rng.randrange(8)}"
        for src in ("bad", "copy1", "copy2"):
            claims.append((f"g{g}", "f", bad, src))
        for src in ("good1", "good2", "good3", "good4"):
            claims.append((f"g{g}", "f", "true" if rng.random() < 0.7 else f"false{rng.randrange(8)}", src))
    values, accuracy, dependence = s.fuse(spark.createDataFrame(claims, "group_id string, field string, value string, source string"), rounds=5)
    best = values.groupBy("group_id").agg({"p": "max"}).withColumnRenamed("max(p)", "p").join(values, ["group_id", "p"])
    right = best.where("value = 'true'").select("group_id").distinct().count()
    dep = {(r.s, r.t): r.dep for r in dependence.collect()}
    acc = {r.source: r.accuracy for r in accuracy.collect()}
    votes = [Counter(c[2] for c in claims if c[0] == f"g{g}") for g in range(120)]
    plain = sum(v["true"] == max(v.values()) for v in votes)
    assert min(dep[("bad", "copy1")], dep[("copy1", "copy2")]) > 0.9 > 0.5 > dep[("good1", "good2")]
    assert right > plain + 15 and acc["good1"] > acc["bad"]


@pytest.mark.parametrize("n", [400])
def test_a_hot_group_and_a_hot_source(spark, n):
    rows = [store(f"s{i:04}", f"s{i}.example", "hot.shops.example" if i % 3 == 0 else f"h{i // 6}.shops.example", name=f"n{i % 50}") for i in range(n)]
    x = build(spark, rows, [(f"s{i:04}", "one list" if i % 2 else f"l{i % 7}", T[1]) for i in range(n)])
    assert x.members.where("group_id = 's0000'").count() == (n + 2) // 3 and x.records.where("group_id = 's0000'").first()["size"] == (n + 2) // 3
