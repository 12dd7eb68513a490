"""Queries over document texts, and rules over literal pages.

SQL whose both sides are literals is a regression check: its values are written by hand from the rule, and are said so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import contacts, rules, urls
from leadloom.functions.html import parse_page
from leadloom.functions.urls import KnownHosts
from leadloom.operators import fetchlog
from leadloom.plans import storefront
from leadloom.queries import sql
from leadloom.session import cut, table
from leadloom.sources import leads

QUERIES, SQL = {}, {}


def query(text: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add


_EMAIL = contacts.EMAIL.replace("'", "''")
_FOLD = "trim(regexp_replace(strip_accents(lower({0})), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g'))"


@query(f"SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '{_EMAIL}'), lambda e: regexp_replace(lower(e), '^[.,;]+|[.,;]+$', '', 'g')))) AS email FROM documents")
def email_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(contacts.emails_in(F.col("text"))).alias("email"))


@query(
    f"SELECT store_id, e AS email, regexp_full_match(e, '{_EMAIL}') AND NOT list_contains({list(contacts.TEMPLATE_DOMAINS)}, lower(split_part(e, '@', -1))) AND NOT regexp_matches(lower(e), '\\.(png|jpg|webp)$')"
    " AND NOT regexp_matches(lower(e), '^(yourname|example)@') AS valid FROM (SELECT DISTINCT store_id, unnest(emails) AS e FROM stores)"
)
def email_valid(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "stores").select("store_id", F.explode("emails").alias("email")).distinct()
    return x.select("store_id", "email", contacts.valid_email(F.col("email")).alias("valid"))


@query("SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[0-9+][0-9 ()-]{8,16}[0-9]'))) AS phone FROM documents")
def phone_candidates(spark: SparkSession, d: str) -> DataFrame:
    found = F.array_distinct(F.regexp_extract_all("text", F.lit("([0-9+][0-9 ()-]{8,16}[0-9])"), 1))
    return table(spark, d, "documents").select("doc_id", F.explode(found).alias("phone"))


_NAMES = f"names AS (SELECT label, {_FOLD.format('n')} AS gram FROM (SELECT canonical AS label, unnest(list_prepend(canonical, also_known)) AS n FROM canon_values WHERE kind = 'state'))"


@query(f"WITH {_NAMES}, s AS (SELECT DISTINCT state FROM stores WHERE state <> '') SELECT DISTINCT state, label FROM s JOIN names ON contains(' ' || {_FOLD.format('state')} || ' ', ' ' || gram || ' ')")
def gazetteer_states(spark: SparkSession, d: str) -> DataFrame:
    """The states that a typed value names in so many words."""
    c = table(spark, d, "canon_values").where("kind = 'state'")
    names = c.select("canonical", F.explode(F.concat(F.array("canonical"), "also_known")).alias("n"))
    x = table(spark, d, "stores").select("state").where("state <> ''").distinct()
    return rules.mentions(x, "state", "state", rules.dimension(names, "canonical", "n")).select("state", "label").distinct()


_KEYS = f"keys AS (SELECT DISTINCT label, gram FROM (SELECT canonical AS label, unnest(string_split({_FOLD.format('canonical')}, ' ')) AS gram FROM canon_values WHERE kind = 'category') WHERE len(gram) >= 4)"


@query(
    f"""WITH {_KEYS}, t AS (SELECT doc_id, ' ' || {_FOLD.format('text')} || ' ' AS a, ' ' || {_FOLD.format("coalesce(page_url, '')")} || ' ' AS b FROM documents),
m AS (SELECT doc_id, label, sum(CASE WHEN contains(a, ' ' || gram || ' ') THEN 4 ELSE 1 END)::BIGINT AS score FROM t JOIN keys ON contains(a, ' ' || gram || ' ') OR contains(b, ' ' || gram || ' ') GROUP BY 1, 2 HAVING score >= 2),
top AS (SELECT doc_id, max(score) AS score FROM m GROUP BY 1)
SELECT doc_id, CASE WHEN count(*) = 1 THEN min(label) END AS label, score, count(*) AS tied FROM m JOIN top USING (doc_id, score) GROUP BY doc_id, score"""
)
def taxonomy_classify(spark: SparkSession, d: str) -> DataFrame:
    """The category that most of a text's words speak for (words in the page's address count less)."""
    c = table(spark, d, "canon_values").where("kind = 'category'")
    words = c.select("canonical", F.explode(rules.words(F.col("canonical"))).alias("w")).where(F.length("w") >= 4)
    return rules.classified(table(spark, d, "documents"), "doc_id", "text", "page_url", rules.dimension(words, "canonical", "w"))


@query(f"WITH {sql.STORE} SELECT store_id, CASE WHEN len(trim(description)) >= 20 THEN left(trim(description), 700) WHEN len(trim(name)) >= 20 THEN left(trim(name), 700) END AS text FROM store")
def description_pick(spark: SparkSession, d: str) -> DataFrame:
    """The description, else the name, if it is long enough to say something."""
    from leadloom.operators.dedup import current_stores

    x = current_stores(table(spark, d, "stores"), ["store_id", "description", "name", "observed_at"])
    return x.select("store_id", rules.description(F.col("description"), F.col("name"))["text"].alias("text"))


@query("SELECT doc_id, regexp_replace(text, '&nbsp;?', ' ', 'g') AS text FROM documents WHERE contains(text, '&nbsp')")
def nbsp_repair(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").where(F.contains("text", F.lit("&nbsp")))
    return x.select("doc_id", rules.without_nbsp(F.col("text")).alias("text"))


@query("SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_doc FROM documents WHERE text <> '' GROUP BY 1")
def blob_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Texts as content-addressed blobs: each content stored once, with its copies."""
    x = table(spark, d, "documents").where("text <> ''").select("doc_id", F.encode("text", "utf-8").alias("body"))
    stored = leads.store_blobs(x, spark.createDataFrame([], "digest string")).select("digest")
    copies = x.select("doc_id", F.sha2("body", 256).alias("digest")).groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))
    return stored.join(copies, "digest")


@query("SELECT sha256(text) AS digest, bool_and(doc_id % 7 <> 0) AS intact FROM documents WHERE text <> '' AND doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text) GROUP BY text")
def blob_verify(spark: SparkSession, d: str) -> DataFrame:
    """Stored blobs, of which those whose first document's id divides by 7 were damaged by cutting off their last byte."""
    x = table(spark, d, "documents").where("text <> ''").select("doc_id", F.encode("text", "utf-8").alias("body"))
    first = x.groupBy(F.sha2("body", 256).alias("digest")).agg(F.min("doc_id").alias("first"))
    stored = leads.store_blobs(x, spark.createDataFrame([], "digest string")).join(first, "digest")
    damaged = stored.withColumn("body", F.when(F.col("first") % 7 == 0, F.substring(F.col("body"), F.lit(1), F.length("body") - 1)).otherwise(F.col("body")))
    return leads.verified_blobs(damaged).select("digest", "intact")


@query("SELECT doc_id, regexp_extract(page_url, '^([a-z]+://[^/?#]+)', 1) || regexp_replace(coalesce(nullif(regexp_extract(regexp_extract(page_url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '^(.*/)', 1), ''), '/'), '[^/]+/$', '') || 'pages/contact#form' AS url FROM documents WHERE page_url IS NOT NULL")
def resolve_url(spark: SparkSession, d: str) -> DataFrame:
    """A contact link on each document's page, as an absolute address (an Arrow function over the standard library)."""
    x = table(spark, d, "documents").where("page_url IS NOT NULL")
    return x.select("doc_id", urls.resolved(F.col("page_url"), F.lit("../pages/contact#form")).alias("url"))


_SOCIAL = [
    ("https://www.instagram.com/brand/?utm_source=x", "instagram", "https://instagram.com/brand"),
    ("https://twitter.com/brand", "x", "https://x.com/brand"),
    ("https://x.com/intent/post?text=a", None, None),
    ("https://m.facebook.com/profile.php?id=77", "facebook", "https://facebook.com/profile.php?id=77"),
    ("https://facebook.com/pages/Brand/99", "facebook", "https://facebook.com/pages/Brand/99"),
    ("https://facebook.com/sharer/sharer.php?u=a", None, None),
    ("https://linkedin.com/company/brand/mycompany", "linkedin", "https://linkedin.com/company/brand"),
    ("https://linkedin.com/feed", None, None),
    ("https://youtube.com/@brand/videos", "youtube", "https://youtube.com/@brand"),
    ("https://youtube.com/watch?v=1", None, None),
    ("https://pinterest.com/brand/board", None, None),
    ("https://instagram.com/accounts", None, None),
    ("https://facebook.com/marketplace", None, None),
    ("https://x.com/Brand_9", "x", "https://x.com/Brand_9"),
    ("https://youtube.com/c/brand/playlists", "youtube", "https://youtube.com/c/brand"),
    ("https://youtube.com/c/brand/more", None, None),
    ("https://facebook.com/people/a%20b/9", None, None),
    ("HTTPS://user@www.linkedin.com:443/in/some-one/", "linkedin", "https://linkedin.com/in/some-one"),
]
_lit = lambda v: "NULL" if v is None else f"'{v}'"


@query("SELECT * FROM (VALUES " + ", ".join(f"({_lit(a)}, {_lit(b)}, {_lit(c)})" for a, b, c in _SOCIAL) + ") AS t(url, network, profile)")
def social_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Regression check on literals."""
    x = spark.createDataFrame([(a,) for a, _, _ in _SOCIAL], "url string")
    return contacts.with_social(x, "url").select("url", "network", "profile")


_ASSETS = [("https://cdn.shopify.com/shopifycloud/a.js", True), ("https://shopifycloud.example/a.js", False), ("/cdn/shopifycloud/x.MJS?v=2", True), ("/cdn/shop/t/4/assets/theme.css?v=1", True), ("/cdn/shop/t/4/assets/icon.png", False), ("/assets/theme.css", False)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', {b})" for a, b in _ASSETS) + ") AS t(src, runtime)")
def runtime_asset(spark: SparkSession, d: str) -> DataFrame:
    """Regression check on literals."""
    return spark.createDataFrame([(a,) for a, _ in _ASSETS], "src string").select("src", rules.runtime_asset(F.col("src")).alias("runtime"))


_RETRY = [("10", 10.0), ("-1", 0.0), ("junk", 0.0), ("", 0.0), ("2.5", 2.5), ("Wed, 01 Jan 2025 00:01:30 GMT", 90.0), ("Tue, 31 Dec 2024 00:00:00 GMT", 0.0)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', {b}::DOUBLE)" for a, b in _RETRY) + ") AS t(header, seconds)")
def retry_after_parse(spark: SparkSession, d: str) -> DataFrame:
    """Regression check on literals."""
    return spark.createDataFrame([(a,) for a, _ in _RETRY], "header string").select("header", fetchlog.retry_after(F.col("header"), F.lit("2025-01-01").cast("timestamp_ntz")).alias("seconds"))


_ROBOTS = "User-agent: *\nDisallow: /*.json$\nDisallow: /cart\nAllow: /cart/help\n\nUser-agent: loombot\nDisallow: /private"
_PATHS = [("/a.json", "other", False), ("/a.json?x=1", "other", True), ("/cart/add", "other", False), ("/cart/help", "other", True), ("/a.json", "loombot/1.0", True), ("/private/x", "loombot/1.0", False)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{a}', {b})" for p, a, b in _PATHS) + ") AS t(path, agent, allowed)")
def robots_eval(spark: SparkSession, d: str) -> DataFrame:
    """Regression check on literals."""
    parts = []
    for agent in ("other", "loombot/1.0"):
        x = spark.createDataFrame([(p, a) for p, a, _ in _PATHS if a == agent], "path string, agent string")
        parts.append(x.select("path", "agent", fetchlog.robots_allowed(F.lit(_ROBOTS), agent, F.col("path")).alias("allowed")))
    return parts[0].unionByName(parts[1])


STOREFRONT = """<html><head><title>Clay Lane | Teapots</title><meta name="description" content="Handmade clay teapots and brass cups from one lane.">
<script>Shopify.shop = "clay-lane.myshopify.com";</script><script src="/cdn/shop/t/3/assets/app.js"></script>
<script type="application/ld+json">{"@graph":[{"@type":"Organization","url":"https://claylane.in/","telephone":"080 4567 8901","email":"Office@claylane.in"}]}</script></head>
<body><header><a href="/"><img class="logo" src="/logo.png"></a></header><nav><a href="/products/teapot">Teapot</a> <a href="/pages/contact">Contact us</a> <a href="/cart">Cart</a></nav>
<p>Registered office: 12 Potter Street, Arkapet, Arkanadu 560001, India<p><b>Write</b> to <a href="mailto:wrong@claylane.in">care@claylane.in</a>
<div hidden>ghost@claylane.in</div><a href="tel:+919876543210">call</a> <a href="https://www.instagram.com/claylane?utm_source=a">photos</a> <a href="https://facebook.com/sharer.php?u=x">share</a></body></html>"""


def _storefront(spark: SparkSession) -> DataFrame:
    pages = spark.createDataFrame([("s1", 0, "https://claylane.in/", STOREFRONT)], "store_id string, page_no int, url string, html string")
    return storefront.parsed_pages(pages.withColumn("observed_at", F.lit("2025-01-01").cast("timestamp_ntz")))


@query(
    """SELECT * FROM (VALUES ('s1', 'Clay Lane', 'care@claylane.in|office@claylane.in', '+918045678901|+919876543210', 'instagram=https://instagram.com/claylane', 'Brass tableware', 'Arkanadu', 'clay-lane.myshopify.com', 'verified', 'verified', 'accepted',
'Store identity and Indian business address are supported by live pages.', 'logo_url=not_found_in_allowed_pages'))
AS t(store_id, name, emails, phones, socials, category, state, shop_identity, shopify, india, status, reason, missing)"""
)
def storefront_extract(spark: SparkSession, d: str) -> DataFrame:
    """One literal page through the whole extraction; a regression check whose values are written by hand."""
    c = table(spark, d, "canon_values")
    names = c.where("kind = 'state'").select("canonical", F.explode(F.concat(F.array("canonical"), "also_known")).alias("n"))
    words = c.where("kind = 'category'").select("canonical", F.explode(rules.words(F.col("canonical"))).alias("w")).where(F.length("w") >= 4)
    x = storefront.stores(_storefront(spark), rules.dimension(names, "canonical", "n"), rules.dimension(words, "canonical", "w"))
    joined = [F.array_join(f, "|").alias(f) for f in ("emails", "phones")]
    pairs = lambda c, v: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], v(e["value"]))), "|").alias(c)
    return x.select("store_id", "name", *joined, pairs("socials", lambda v: F.array_join(v, ",")), "category", "state", "shop_identity", "shopify", "india", "status", "reason", pairs("missing", lambda v: v))


def _escaped(c) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _document_pages(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, page_url, page): each document's text written as an HTML page, a paragraph a line, with links, and parsed."""
    x = table(spark, d, "documents").where("text <> ''")
    ps = F.array_join(F.transform(F.split("text", "\n"), lambda p: F.concat(F.lit("<p>"), _escaped(p), F.lit("</p>"))), "<script>var hidden = '<p>no</p>';</script>")
    head = F.concat(F.lit("<html><head><title>"), _escaped(F.coalesce("source", F.lit(""))), F.lit(" | Shop</title></head><body><header><a href='/'>Home</a></header>"))
    page = F.concat(head, ps, F.lit("<div hidden>Nobody sees this paragraph here.</div><a href='/pages/contact?x=1'>Contact</a> <a href='/pages/about'>About us</a></body></html>"))
    return x.select("doc_id", "page_url", page.alias("html")).withColumn("page", parse_page(F.col("html")))


_SPACES = "[\\s\\p{Z}\\x1c-\\x1f\\x85]+"
_LINES = f"SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '{_SPACES}', ' ', 'g')) AS line FROM documents WHERE text <> ''"


@query(
    f"SELECT doc_id, trim(regexp_replace(regexp_replace('Home ' || text || ' Contact About us', '&nbsp;?', ' ', 'g'), '{_SPACES}', ' ', 'g')) AS seen,"
    f" coalesce(nullif(trim(regexp_replace(coalesce(source, ''), '{_SPACES}', ' ', 'g')), ''), '| Shop') AS name FROM documents WHERE text <> ''"
)
def page_visible_text(spark: SparkSession, d: str) -> DataFrame:
    """What a visitor sees of each document as a page, and the name its title gives: scripts and hidden parts are not seen."""
    x = _document_pages(spark, d)
    return x.select("doc_id", F.col("page.visible_text").alias("seen"), rules.store_name(F.lit(None).cast("string"), F.col("page.title"), F.lit("-")).alias("name"))


@query(f"SELECT doc_id, line AS block, count(*) AS n FROM ({_LINES}) WHERE len(line) BETWEEN 20 AND 900 GROUP BY ALL")
def page_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The text blocks of each document as a page."""
    return _document_pages(spark, d).select("doc_id", F.explode("page.blocks").alias("block")).groupBy("doc_id", "block").agg(F.count("*").alias("n"))


@query("SELECT doc_id, regexp_extract(page_url, '^([a-z]+://[^/?#]+)', 1) || '/pages/about' AS link, 8 AS score FROM documents WHERE text <> '' AND page_url LIKE 'http%'")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    """The informative links of each document as a page: same site, no query."""
    x = _document_pages(spark, d).where("page_url LIKE 'http%'").select(F.col("doc_id").alias("store_id"), F.lit(0).alias("page_no"), F.col("page_url").alias("url"), "page")
    return storefront.select_links(x, KnownHosts.read(table(spark, d, "known_hosts"))).select(F.col("store_id").alias("doc_id"), "link", "score")


_OK_MAIL = f"list_filter(list_transform(regexp_extract_all(e, '{_EMAIL}'), lambda m: regexp_replace(lower(m), '^[.,;]+|[.,;]+$', '', 'g')), lambda m: regexp_full_match(m, '{_EMAIL}') AND m LIKE '%.example' AND NOT regexp_matches(m, '@(in|co|store).example$') AND NOT regexp_matches(m, '^(yourname|example)@'))"


@query(
    f"""WITH {sql.STORE}, m AS (SELECT store_id, string_agg(DISTINCT mail, '|' ORDER BY mail) AS emails FROM (SELECT store_id, unnest({_OK_MAIL}) AS mail FROM (SELECT store_id, unnest(emails) AS e FROM store)) GROUP BY 1)
SELECT store_id, left(trim(name), 120) AS name, CASE WHEN len(trim(description)) >= 20 THEN left(trim(description), 700) END AS description, coalesce(m.emails, '') AS emails, 'review' AS status,
(m.emails IS NULL)::INT + (description IS NULL OR len(trim(description)) < 20)::INT + 5 AS missing FROM store LEFT JOIN m USING (store_id) WHERE trim(name) <> ''"""
)
def storefront_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every current store written as a page of its own and read again by the whole extraction: name, description, e-mails."""
    from leadloom.operators.dedup import current_stores

    x = current_stores(table(spark, d, "stores"), ["store_id", "name", "description", "emails", "observed_at"]).where("trim(name) <> ''")
    mails = F.array_join(F.transform(F.coalesce("emails", F.array().cast("array<string>")), lambda e: F.concat(F.lit("<p>"), _escaped(F.coalesce(e, F.lit(""))), F.lit("</p>"))), "")
    meta = lambda key, c: F.concat(F.lit(f'<meta {key} content="'), _escaped(F.coalesce(c, F.lit(""))), F.lit('">'))
    page = F.concat(meta('property="og:site_name"', F.col("name")), meta('name="description"', F.col("description")), mails)
    pages = x.select("store_id", F.lit(0).alias("page_no"), F.lit("https://shop.example/").alias("url"), "observed_at", page.alias("html"))
    none = rules.dimension(spark.createDataFrame([], "l string, n string"), "l", "n")
    s = storefront.stores(storefront.parsed_pages(pages), none, none, KnownHosts.read(table(spark, d, "known_hosts")))
    return s.select("store_id", "name", "description", F.array_join("emails", "|").alias("emails"), "status", F.size("missing").alias("missing"))


_FIRST = f"SELECT store_id, emails[1] AS e, phones[1] AS p FROM store WHERE len(emails) > 0 OR len(phones) > 0"
_TEL = "regexp_replace(regexp_replace(p, '(?i)\\s*(?:ext\\.?|x)\\s*[0-9]{1,7}\\s*$', ''), '[^0-9+]', '', 'g')"
_NUMBER = f"CASE WHEN regexp_matches({_TEL}, '^(\\+?91|0)?[1-9][0-9]{{9}}$') THEN '+91' || right({_TEL}, 10) WHEN regexp_matches({_TEL}, '^\\+[1-9][0-9]{{7,14}}$') AND NOT starts_with({_TEL}, '+91') THEN {_TEL} END"


@query(
    f"""WITH {sql.STORE}, f AS ({_FIRST}), m AS (SELECT store_id, {_OK_MAIL} AS ok, len(regexp_extract_all(coalesce(e, ''), '{_EMAIL}')) AS n FROM f)
SELECT store_id, 'emails' AS field, 'mailto_link' AS rule, CASE WHEN n > 0 THEN ok[1] ELSE 'other@mail.example' END AS value FROM m WHERE n = 0 OR len(ok) > 0
UNION ALL SELECT store_id, 'phones', 'merchant_organization_contact', concat_ws(' ext. ', {_NUMBER}, nullif(regexp_extract(p, '(?i)\\s*(?:ext\\.?|x)\\s*([0-9]{{1,7}})\\s*$', 1), '')) FROM f WHERE {_NUMBER} IS NOT NULL"""
)
def contact_links(spark: SparkSession, d: str) -> DataFrame:
    """A page for each current store with its first e-mail as the text of a link to another address, and its first number in
    structured data of the shop's own site and of another's: what is shown and what is the shop's own counts."""
    from leadloom.operators.dedup import current_stores

    x = current_stores(table(spark, d, "stores"), ["store_id", "emails", "phones", "observed_at"]).where("size(emails) > 0 OR size(phones) > 0")
    e, p = F.coalesce(F.get("emails", F.lit(0)), F.lit("")), F.get("phones", F.lit(0))
    link = F.concat(F.lit("<a href='mailto:other@mail.example?subject=x'>"), _escaped(e), F.lit("</a>"))
    thing = lambda url, tel: F.concat(F.lit("<script type='application/ld+json'>"), F.to_json(F.struct(F.lit("LocalBusiness").alias("@type"), F.lit(url).alias("url"), F.array(F.struct(tel.alias("telephone"))).alias("contactPoint"))), F.lit("</script>"))
    page = F.concat(link, thing("https://www.shop.example/x", p), thing("https://elsewhere.example/", F.lit("+4930123456")))
    pages = x.select("store_id", F.lit(0).alias("page_no"), F.lit("https://shop.example/").alias("url"), F.lit(None).cast("timestamp_ntz").alias("observed_at"), page.alias("html"))
    found = storefront.evidence(storefront.parsed_pages(pages), KnownHosts.read(table(spark, d, "known_hosts")))
    return found.where("rule IN ('mailto_link', 'merchant_organization_contact')").groupBy("store_id", "field", "rule").agg(F.min_by("value", "pos").alias("value"))


@query(
    f"""WITH {sql.STORE}, s AS (SELECT store_id, c.canonical AS state FROM store JOIN canon_values c ON c.kind = 'state' AND c.canonical = store.state)
SELECT store_id, state, 2 + (store_id[1] = 'a')::INT AS addresses, (state IS NULL)::INT AS ambiguous FROM (SELECT store_id, CASE WHEN store_id[1] <> 'a' OR state = 'Arkanadu' THEN state END AS state FROM s) WHERE state IS NOT NULL OR store_id[1] = 'a'"""
)
def address_states(spark: SparkSession, d: str) -> DataFrame:
    """Address blocks written from the states of current stores: a registered office, the same within a longer block, a corporate
    office elsewhere and a warehouse; for ids that begin with ``a`` a second registered office. The state of the registered ones,
    how many addresses are left, and whether they disagree."""
    from leadloom.operators.dedup import current_stores

    c = table(spark, d, "canon_values").where("kind = 'state'").select(F.col("canonical").alias("state"))
    s = current_stores(table(spark, d, "stores"), ["store_id", "state", "observed_at"]).join(c, "state").select("store_id", "state")
    office = F.concat(F.lit("Registered office: 4 Hill Road, "), "state", F.lit(" 560001"))
    blocks = [office, F.concat(F.lit("Here we are. "), office, F.lit(" since 1999")), F.lit("Corporate office: 9 Lake Street, Arkanadu 560002"), F.concat(F.lit("Returns warehouse: 1 Far Road, "), "state", F.lit(" 560003"))]
    blocks.append(F.when(F.substring("store_id", 1, 1) == "a", F.lit("Principal office: 7 Old Lane, Arkanadu 560004")))
    x = s.select("store_id", F.lit("https://shop.example/contact").alias("page_url"), F.explode(F.array_compact(F.array(*blocks))).alias("block"))
    a = cut(rules.address_candidates(x, rules.dimension(c, "state", "state")))
    n = a.groupBy("store_id").agg(F.count("*").cast("int").alias("addresses"))
    r = rules.one_state(a).join(n, "store_id")
    return r.select("store_id", "state", "addresses", F.coalesce((F.col("reason") == "ambiguous").cast("int"), F.lit(0)).alias("ambiguous"))


@query("SELECT * FROM (VALUES ('https://claylane.in/pages/contact', 10)) AS t(link, score)")
def link_select(spark: SparkSession, d: str) -> DataFrame:
    """Regression check on a literal page."""
    return storefront.select_links(_storefront(spark)).select("link", "score")


@query("SELECT * FROM (VALUES ('https://claylane.in/logo.png', 23)) AS t(src, score)")
def logo_rank(spark: SparkSession, d: str) -> DataFrame:
    """Regression check on a literal page."""
    return storefront.logo_candidates(_storefront(spark)).select("src", "score")


@query("SELECT * FROM (VALUES ('https://a.example/', 'list', 'https://l.example/'), ('https://b.example/', 'x', 'https://m.example/'), ('https://b.example/', 'y', 'https://n.example/')) AS t(url, source, source_url)")
def manifest_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Regression check on literals in both shapes."""
    rows = [("https://a.example/", "list", "https://l.example/", None, None, None), (None, None, None, "https://b.example/", "accepted", [("x", "https://m.example/"), ("y", "https://n.example/")])]
    return leads.flattened(spark.createDataFrame(rows, leads.ENTRY))
