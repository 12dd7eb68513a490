from pyspark.sql import functions as F

from leadloom.functions import contacts, html, rules
from leadloom.plans import storefront
from leadloom.queries import texts
from leadloom.sources import leads


def test_parse_visible_text_and_repair():
    p = html.parse('<title>T | x</title><p>One <b>two<br>three paragraph text<p>Next <span hidden>no</span><script>var a="<p>";</script><div aria-hidden="true">gone</div><li>a<li>b')
    assert p["title"] == "T | x" and "no" not in p["visible_text"].split() and "gone" not in p["visible_text"] and p["scripts"][0]["text"] == 'var a="<p>";'
    assert p["blocks"] == ["One twothree paragraph text"] and p["visible_text"].startswith("One two three paragraph text Next")


def test_parse_odd_pages():
    for page in (None, "", "<", "</p></div>", "<a href='x'>" * 300, "<p>" + "x" * 200_000):
        assert html.parse(page)["error"] is None


def test_tables_and_json():
    t = "<table><tr><th>Store<th>x</tr><tr><td>shop.a.in</td><td>no</td></tr></table><table><tr><th>Other</th></tr><tr><td>b.in</td></tr></table>"
    assert html.table_cells(t) == ["shop.a.in"]
    assert [o["a"] for o in html.json_objects('[{"a":1,"b":{"a":2}},{"a":3}]')] == [1, 2, 3] and html.json_objects("{") == []


def test_mutations_change_one_decision(spark):
    page = texts.STOREFRONT
    pages = {
        "base": page,
        "second": page.replace("</head>", '<script>Shopify.shop = "other.myshopify.com"</script></head>'),
        "pre": page.replace('<script>Shopify.shop = "clay-lane.myshopify.com";</script>', '<pre>Shopify.shop = "clay-lane.myshopify.com";</pre>'),
        "icon": page.replace("/assets/app.js", "/assets/favicon.png"),
        "noaddress": page.replace("Registered office: 12 Potter Street, Arkapet, Arkanadu 560001, India", "Delivering to Arkanadu and all of India 560001"),
        "woo": page.replace("</body>", '<script src="/wp-content/plugins/woocommerce/a.js"></script></body>'),
    }
    names = rules.dimension(spark.createDataFrame([("Arkanadu", "Arkanadu"), ("Girivana", "Girivana")], "l string, n string"), "l", "n")
    keys = rules.dimension(spark.createDataFrame([("Brass", "brass"), ("Tea", "teapots")], "l string, n string"), "l", "n")
    x = spark.createDataFrame([(k, 0, "https://claylane.in/", v) for k, v in pages.items()], "store_id string, page_no int, url string, html string")
    got = {r.store_id: r for r in storefront.stores(storefront.parsed_pages(x.withColumn("observed_at", F.lit(None).cast("timestamp_ntz"))), names, keys).collect()}
    assert {k: (r.shopify, r.india, r.status) for k, r in got.items()} == {
        "base": ("verified", "verified", "accepted"), "second": ("conflict", "verified", "review"), "pre": ("unconfirmed", "verified", "review"),
        "icon": ("unconfirmed", "verified", "review"), "noaddress": ("verified", "unconfirmed", "review"), "woo": ("conflict", "verified", "review"),
    }
    assert got["base"].state == "Arkanadu" and got["base"].category is None and got["base"].emails == ["care@claylane.in", "office@claylane.in"]


def test_addresses(spark):
    states = rules.dimension(spark.createDataFrame([("Arkanadu", "Arkanadu"), ("Girivana", "Girivana")], "l string, n string"), "l", "n")
    rows = [
        ("s", "https://a.in/contact", "Registered office: 4 Hill Road, Arkanadu 560001"),
        ("s", "https://a.in/contact", "Clay. Registered office: 4 Hill Road, Arkanadu 560001, since ever"),
        ("s", "https://a.in/contact", "Corporate office: 9 Lake Street, Girivana 560002"),
        ("s", "https://a.in/contact", "Return address: 9 Lake Street, Girivana 560002"),
        ("s", "https://a.in/", "We make pots in Girivana and like it there"),
        ("t", "https://b.in/terms", "Registered office: 4 Hill Road, Arkanadu 560001"),
        ("t", "https://b.in/terms", "Registered office: 4 Hill Road, Girivana 560001"),
        ("t", None, None),
    ]
    a = rules.address_candidates(spark.createDataFrame(rows, "store_id string, page_url string, block string"), states)
    assert sorted((r.store_id, r.priority) for r in a.collect()) == [("s", 3), ("s", 4), ("t", 4), ("t", 4)]
    assert {r.store_id: (r.state, r.reason) for r in rules.one_state(a).collect()} == {"s": ("Arkanadu", None), "t": (None, "ambiguous")}


def test_contacts(spark):
    x = spark.createDataFrame([("Mail a.b+c@shop.co.in, or X@Y.com.", "+91 98765 43210 ext. 4"), (None, "12")], "t string, p string")
    r = x.select(contacts.emails_in(F.col("t")).alias("e"), contacts.phone(F.col("p")).alias("p")).collect()
    assert r[0].e == ["a.b+c@shop.co.in", "x@y.com"] and r[1].e is None and [y.p for y in r] == ["+919876543210", None]
    v = spark.createDataFrame([("a@shop.in",), ("a@example.com",), ("a@b.png",), ("yourname@shop.in",), ("nope",)], "e string")
    assert [y.v for y in v.select(contacts.valid_email(F.col("e")).alias("v")).collect()] == [True, False, False, False, False]


def test_visible_phones_and_extensions(spark):
    t = [("Call us: 98765 43210 or +91 22 4567 8901 ext. 5, fax 12", ["98765 43210", "+91 22 4567 8901 ext. 5"]), ("Order 9876543210 shipped", []), ("+49 30 1234567", ["+49 30 1234567"]), (None, None), ("x" * 60 + " 9876543210 " + "y" * 30 + " phone", [])]
    got = [r.p for r in spark.createDataFrame([(a,) for a, _ in t], "t string").select(contacts.phones_in(F.col("t")).alias("p")).collect()]
    assert got == [b for _, b in t]
    x = spark.createDataFrame([("022 4567 8901 x12",), ("9876543210",), ("1",)], "p string").select(contacts.phone_with_extension(F.col("p")).alias("p"))
    assert [r.p for r in x.collect()] == ["+912245678901 ext. 12", "+919876543210", None]


def test_a_store_of_several_pages(spark):
    home = '<title>Loom</title><header class="Header-1"><a href="https://www.loom.in/"><img data-src="/i/Logo.svg?v=1" alt="x"></a><img src="/cupid-logo.png"><img src="/pay.png" alt="Payment logo"></header><a href="/pages/about-us">us</a><a href="/products/contact">x</a><a href="https://other.in/contact">y</a>'
    contact = '<p>Corporate address: 4 Hill Road, New Arkanadu, India 560001</p><p>Phone: 98765 43210</p><a href="https://facebook.com/people/a/1">f</a><a href="https://facebook.com/b">g</a><a hidden href="mailto:no@loom.in">n</a><script type="application/ld+json">{"@type":["Thing","Store"],"url":"https://www.loom.in","contactPoint":[{"email":["Desk@loom.in"]}],"logo":{"contentUrl":"/l.png"}}</script>'
    rows = [("s", 0, "https://loom.in/", home, "https://old.in/", ["https://old.in/", "https://loom.in/"]), ("s", 1, "https://loom.in/contact", contact, None, None)]
    x = spark.createDataFrame(rows, "store_id string, page_no int, url string, html string, candidate_url string, chain array<string>").withColumn("observed_at", F.lit(None).cast("timestamp_ntz"))
    parsed = storefront.parsed_pages(x)
    dim = lambda *names: rules.dimension(spark.createDataFrame([(n.split(":")[0], n.split(":")[-1]) for n in names], "l string, n string"), "l", "n")
    s = storefront.stores(parsed, dim("New Arkanadu", "Arkanadu"), dim("Tea", "Cups"), towns=dim("Girivana:Hill")).first()
    assert (s.emails, s.phones, s.socials) == (["desk@loom.in"], ["+919876543210"], {"facebook": ["https://facebook.com/b", "https://facebook.com/people/a/1"]})
    assert s.state == "New Arkanadu" and s.india == "verified" and s.reason == "Shopify identity needs review." and s.aliases == ["https://old.in/", "https://loom.in/"]
    assert s.missing == {c: "not_found_in_allowed_pages" for c in ("category", "description", "logo_url")} and s.pages_checked == 2 and s.domain_url == "https://loom.in/"
    assert {(r.src, r.score) for r in storefront.logo_candidates(parsed).collect()} == {("https://loom.in/i/Logo.svg?v=1", 23), ("https://loom.in/cupid-logo.png", 11), ("https://loom.in/l.png", 20)}
    assert {(r.link, r.score) for r in storefront.select_links(parsed).collect()} == {("https://loom.in/pages/about-us", 8)}
    both = storefront.with_unreachable(storefront.stores(parsed, dim("A"), dim("B")), spark.createDataFrame([("s", "u"), ("t", "v")], "id string, url string"))
    assert {r.store_id: r.status for r in both.collect()} == {"s": "review", "t": "unreachable"}


def test_address_wording(spark):
    states = rules.dimension(spark.createDataFrame([("Arkanadu", "Arkanadu")], "l string, n string"), "l", "n")
    said = ["Shipping to Hill Road, Arkanadu 560001", "We are delivering across Arkanadu, Hill Road 560001", "Our registered address: 4 Hill Road, Arkanadu 560001", "Principal offices at Hill Road, Arkanadu, India, plot A-12", "Corporate address Hill Road, Arkanadu 560001"]
    a = rules.address_candidates(spark.createDataFrame([("s", "https://a.in/contact", x) for x in said], "store_id string, page_url string, block string"), states)
    assert {(r.excerpt, r.priority, r.basis) for r in a.collect()} == {(said[2], 4, "business_address"), (said[3], 4, "registered_office_without_pin"), (said[4], 3, "business_address")}


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('﻿[{"url":"a.in","source":"s","source_url":"u"},{"candidate_url":"b.in","status":"x","sources":[{"name":"n","source_url":"m"}]}]', encoding="utf-8")
    assert sorted(tuple(r) for r in leads.read_json_import(spark, str(tmp_path / "a.json")).collect()) == [("a.in", "s", "u"), ("b.in", "n", "m")]
    (tmp_path / "c.jsonl").write_text('{"url":"u1","urlkey":"k","timestamp":"2","status":"200"}\n\n{"url":"u0","urlkey":"k","timestamp":"1","status":"200"}\n{"url":"u3","urlkey":"z","timestamp":"1","status":"404"}\n')
    cdx = leads.read_cdx_lines(spark, str(tmp_path / "c.jsonl"))
    assert cdx.count() == 3 and [tuple(r) for r in leads.collapsed(cdx, 0).collect()] == [("k", "1", "u0")]
    lines = spark.createDataFrame([(1, ' "A.in" '), (2, "a.in"), (3, "bad"), (4, "b.in")], "pos int, value string")
    assert sorted(tuple(r) for r in leads.parsed_lines(lines).collect()) == [(1, "https://a.in/"), (4, "https://b.in/")]
    page = spark.createDataFrame([("<table><tr><th>store</th></tr><tr><td>Go to shop.a.in now</td></tr></table>",), (None,)], "html string")
    assert [r.domain for r in leads.parsed_tables(page).collect()] == ["shop.a.in"]
    b = spark.createDataFrame([(b"x",), (b"x",), (b"",)], "body binary")
    new = leads.store_blobs(b, spark.createDataFrame([], "digest string"))
    assert new.count() == 1 and leads.store_blobs(b, new).count() == 0 and leads.verified_blobs(new).first().intact
    long = leads.store_blobs(spark.createDataFrame([(b"tea " * 500,)], "body binary"), new)
    r = leads.verified_blobs(long).first()
    assert long.first().packed and len(long.first().body) < 100 and r.intact and bytes(r.body) == b"tea " * 500
    assert not leads.verified_blobs(long.withColumn("body", F.lit(b"junk"))).first().intact
