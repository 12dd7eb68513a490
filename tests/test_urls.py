import pytest
from pyspark.sql import functions as F

from leadloom.functions import urls

KNOWN = urls.KnownHosts(frozenset({"example", "in.example"}), frozenset({"shops.example"}), frozenset({"tapcards.example", "demo.shops.example"}))


@pytest.mark.parametrize(
    "url, want",
    [
        ("www.Brand.in", "https://www.brand.in/"),
        (" HTTPS://Brand.in:443/Case?utm_source=x&variant=123#top", "https://brand.in/Case?variant=123"),
        ("http://brand.in:443", "http://brand.in:443/"),
        ("http://brand.in.:80?a&FBCLID=1", "http://brand.in/?a="),
        ("https://user@brand.in/", None),
        ("ftp://brand.in/", None),
        ("https://127.0.0.1/", None),
        ("https://10.1.1.1/", None),
        ("https://brand.in:8080/", None),
        ("https://shop.local/", None),
        ("localhost", None),
        ("n/a", None),
        ("", None),
        (None, None),
        ("https://rejúna.in/", "https://rejúna.in/"),
    ],
)
def test_normalized(spark, url, want):
    x = urls.with_normalized(spark.createDataFrame([(url,)], "u string"), "u", "n")
    assert x.first().n == want


def test_homepage_and_id(spark):
    x = urls.with_normalized(spark.createDataFrame([("http://a.in/x?y=1",)], "u string"), "u", "n", homepage=True)
    r = x.select("n", urls.candidate_id(F.col("n")).alias("id"), urls.origin(F.col("n")).alias("o"), urls.host_label(F.lit("https://www.a.in/")).alias("l")).first()
    assert r.n == "http://a.in/" and len(r.id) == 16 and r.o == "http://a.in" and r.l == "a.in"


def test_sites(spark):
    values = ["HTTPS://WWW.Foo.IN.example:443/x", "m.foo.example.", "one.shops.example", "demo.shops.example", "x.tapcards.example", "shops.example", "n/a", "-", None, "", "foo.com"]
    x = KNOWN.with_site(spark.createDataFrame([(v,) for v in values], "v string"), "v").collect()
    assert [r.site for r in x] == ["foo.in.example", "foo.example", "one.shops.example", None, None, None, None, None, None, None, "foo.com"]
    assert [r.tenant for r in x][:3] == [False, False, True]


def test_known_hosts(spark):
    k = urls.KnownHosts.read(spark.createDataFrame([("Example ", "suffix"), (None, "suffix"), ("a.example", None), ("p.example", "platform")], "host string, role string"))
    assert k.suffixes == {"example"} and k.platforms == {"p.example"}
    none = urls.KnownHosts.read(spark.createDataFrame([], "host string, role string"))
    assert none.with_site(spark.createDataFrame([("www.foo.example",)], "v string"), "v").first().site == "foo.example"


def test_arrow_functions(spark):
    x = spark.createDataFrame([("https://a.in/x/y", "../z"), (None, "z")], "b string, h string")
    assert [r.u for r in x.select(urls.resolved(F.col("b"), F.col("h")).alias("u")).collect()] == ["https://a.in/z", None]
    y = spark.createDataFrame([("bücher.in",), ("a.in",), (None,)], "h string")
    assert [r.a for r in y.select(urls.to_ascii(F.col("h")).alias("a")).collect()] == ["xn--bcher-kva.in", "a.in", None]
