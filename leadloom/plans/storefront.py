"""From saved pages to stores: every page is parsed once, its parts become evidence rows, evidence becomes a store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions import contacts, rules, urls
from leadloom.functions.html import ld_objects, parse_page
from leadloom.functions.text import is_missing
from leadloom.functions.urls import KnownHosts
from leadloom.session import cut

#: Kinds of organisation in structured data whose contacts count (fixed values).
ORGANIZATIONS = ("Organization", "LocalBusiness", "Store", "OnlineStore", "Corporation")
#: How much a link to an informative page is worth (fixed values).
LINK_WEIGHTS = (("contact", 10), ("about", 8), ("privacy", 7), ("terms", 7), ("legal", 7), ("return", 6), ("shipping", 4))
FIELDS = ("emails", "phones", "socials", "category", "description", "logo_url", "state")


def parsed_pages(pages: DataFrame) -> DataFrame:
    """``pages`` (store_id, page_no, url, observed_at, html) with the struct ``page``; kept, since all rules read it."""
    return cut(pages.withColumn("page", parse_page(F.col("html"))))


def _objects(parsed: DataFrame, known: KnownHosts) -> DataFrame:
    """(store_id, page_no, url, o): organisations in structured data whose own address is of the page's site."""
    o = parsed.select("store_id", "page_no", "url", F.explode(ld_objects(F.col("page.ldjson"))).alias("o")).where(F.arrays_overlap("o.types", F.array(*map(F.lit, ORGANIZATIONS))))
    o = cut(known.with_site(known.with_site(o.withColumn("o_url", F.col("o.url")), "o_url", "o_"), "url", "p_"))
    return o.where("o_site = p_site").select("store_id", "page_no", "url", "o")


def evidence(parsed: DataFrame, known: KnownHosts = KnownHosts()) -> DataFrame:
    """(store_id, field, value, source_url, rule, page_no, pos, family): all evidence rows, one per sighting.

    Contacts are those that a visitor sees: of hidden links none counts. ``family`` of a social profile is its network.
    """
    base = parsed.select("store_id", "page_no", "url", "html", "page")
    row = lambda x, field, value, rule, family=F.lit(""), pos=F.lit(0): x.select("store_id", F.lit(field).alias("field"), value.alias("value"), F.col("url").alias("source_url"), (F.lit(rule) if isinstance(rule, str) else rule).alias("rule"), "page_no", pos.cast("int").alias("pos"), family.alias("family"))
    scripts = base.select("store_id", "page_no", "url", F.posexplode("page.scripts").alias("pos", "s"))
    identity = scripts.where(~F.contains(F.col("s.type"), F.lit("json"))).select("store_id", "page_no", "url", "pos", F.explode(F.regexp_extract_all("s.text", F.lit(rules.IDENTITY), 1)).alias("v"))
    assets = scripts.select("store_id", "page_no", "url", "pos", F.col("s.src").alias("v")).unionByName(base.select("store_id", "page_no", "url", F.posexplode("page.links").alias("pos", "l")).select("store_id", "page_no", "url", "pos", F.col("l.href").alias("v")))
    assets = assets.where(rules.runtime_asset(F.col("v"))).withColumn("v", urls.resolved(F.col("url"), F.col("v")))
    anchors = base.select("store_id", "page_no", "url", F.explode("page.anchors").alias("a")).where("NOT a.hidden")
    anchors = anchors.withColumn("to", urls.resolved(F.col("url"), F.col("a.href")))
    mails = anchors.where(F.col("a.href").rlike("^(?i)mailto:"))
    written, meant = contacts.emails_in(F.col("a.text")), contacts.emails_in(F.regexp_replace(F.regexp_replace("a.href", "^(?i)mailto:|[?].*$", ""), "(?i)%40", "@"))
    mails = mails.select("store_id", "page_no", "url", "a", F.explode(F.when(F.size(written) > 0, written).otherwise(meant)).alias("v"))
    objects = _objects(parsed, known)
    org_mails = objects.select("store_id", "page_no", "url", F.explode("o.emails").alias("m")).select("store_id", "page_no", "url", F.explode(contacts.emails_in(F.col("m"))).alias("v"))
    org_phones = objects.select("store_id", "page_no", "url", F.explode("o.telephones").alias("v"))
    seen = base.select("store_id", "page_no", "url", F.posexplode(contacts.emails_in(F.col("page.visible_text"))).alias("pos", "v"))
    dialled = base.select("store_id", "page_no", "url", F.posexplode(contacts.phones_in(F.col("page.visible_text"))).alias("pos", "v"))
    meta = base.where("page_no = 0").withColumn("d", rules.description(F.col("page.metas")["description"], F.col("page.metas")["og:description"]))
    tel = F.regexp_replace(F.regexp_extract(F.col("a.href"), r"^(?i)tel:([^?]*)", 1), "%20", " ")
    wa = F.regexp_extract(F.col("a.href"), r"^https?://(?:wa\.me/|api\.whatsapp\.com/send/?\?(?:.*&)?phone=)(?:\+|%2B)?([0-9]+)", 1)
    number = contacts.phone_with_extension
    parts = [
        row(identity, "shopify", F.lower("v"), "shopify_shop_assignment", F.lit("identity"), F.col("pos")),
        row(assets, "shopify", F.col("v"), "shopify_runtime_asset", F.lit("delivery"), F.col("pos")),
        row(base.where("page.commerce"), "shopify", F.lit("commerce_markup"), "storefront_commerce_markup", F.lit("commerce")),
        row(base.where(F.contains("html", F.lit("/wp-content/plugins/woocommerce/"))), "conflict", F.lit("woocommerce"), "other_platform"),
        row(seen, "emails", F.col("v"), "visible_email", pos=F.col("pos")),
        row(org_mails, "emails", F.col("v"), "merchant_organization_contact"),
        row(mails, "emails", F.col("v"), "mailto_link", pos=F.col("a.pos")),
        row(org_phones, "phones", number(F.col("v")), "merchant_organization_contact"),
        row(anchors.where(tel != ""), "phones", number(tel), "tel_link", pos=F.col("a.pos")),
        row(anchors.where(wa != ""), "phones", number(F.concat(F.lit("+"), wa)), "whatsapp_business_link", pos=F.col("a.pos")),
        row(dialled, "phones", number(F.col("v")), "visible_phone", pos=F.col("pos")),
        row(cut(contacts.with_social(anchors, "to")), "socials", F.col("profile"), "merchant_profile_link", F.coalesce("network", F.lit("")), F.col("a.pos")),
        row(meta.where("d IS NOT NULL"), "description", F.col("d.text"), F.col("d.rule")),
    ]
    out = reduce(DataFrame.unionByName, parts).where("value IS NOT NULL")
    return out.where((F.col("field") != "emails") | contacts.valid_email(F.col("value"), known.suffixes))


#: In which order rules of one page count as the first sighting; links stand in the order of the page.
RULE_ORDER = {"visible_email": 0, "merchant_organization_contact": 1, "mailto_link": 2, "tel_link": 2, "whatsapp_business_link": 2, "visible_phone": 3}


def first_sightings(rows: DataFrame) -> DataFrame:
    """One row for each (store_id, field, value): the first by page, kind of rule and place. Of the families delivery and
    commerce a store has one row each, whatever its value."""
    order = F.coalesce(F.create_map(*[F.lit(x) for kv in RULE_ORDER.items() for x in kv])[F.col("rule")], F.lit(1))
    once = F.when(F.col("family").isin("delivery", "commerce"), F.col("family")).otherwise(F.col("value"))
    first = rows.groupBy("store_id", "field", once.alias("once")).agg(F.min(F.struct("page_no", order.alias("o"), "pos", "value", "rule", "source_url", "family")).alias("f"))
    return first.select("store_id", "field", "f.value", "f.page_no", "f.rule", "f.source_url", "f.family")


def stores(parsed: DataFrame, states: DataFrame, keywords: DataFrame, known: KnownHosts = KnownHosts(), towns: DataFrame | None = None) -> DataFrame:
    """One row a store: contacts, category, description, state, the two verifications, status and reason, and for each field
    that is empty why (``missing``).

    ``socials`` maps networks to their profiles; lists are sorted. ``parsed`` may have ``candidate_url`` and ``chain`` (the addresses
    that led to the first page): with it, ``aliases`` has them, each once in order.
    """
    found = cut(first_sightings(evidence(parsed, known)))
    of = lambda f: F.array_sort(F.collect_set(F.when(F.col("field") == f, F.col("value"))))
    agg = found.groupBy("store_id").agg(
        of("emails").alias("emails"), of("phones").alias("phones"), F.collect_set(F.when(F.col("field") == "socials", F.struct(F.col("family").alias("k"), F.col("value").alias("v")))).alias("profiles"),
        F.min_by("value", F.when(F.col("field") == "description", F.struct("page_no", "value"))).alias("description"),
        F.collect_set(F.when(F.col("family") == "identity", F.col("value"))).alias("identities"),
        F.bool_or(F.col("family") == "delivery").alias("delivery"), F.bool_or(F.col("family") == "commerce").alias("commerce"), F.bool_or(F.col("field") == "conflict").alias("conflict"),
    )
    nets = F.array_sort(F.array_distinct(F.transform("profiles", lambda p: p["k"])))
    in_net = lambda k: F.array_sort(F.transform(F.filter("profiles", lambda p: p["k"] == k), lambda p: p["v"]))
    agg = agg.withColumn("socials", F.map_from_arrays(nets, F.transform(nets, in_net))).drop("profiles")
    led = [c for c in ("candidate_url", "chain") if c in parsed.columns]
    first = parsed.groupBy("store_id").agg(F.min_by(F.struct("url", "page", *led), "page_no").alias("p"), F.max("observed_at").alias("observed_at"), F.count("*").cast("int").alias("pages_checked"))
    name = rules.store_name(F.col("p.page.metas")["og:site_name"], F.col("p.page.title"), urls.host_of(F.col("p.url")))
    parts = [F.array(f"p.{c}") if c == "candidate_url" else F.coalesce(f"p.{c}", F.array().cast("array<string>")) for c in led]
    aliases = F.array_distinct(F.array_compact(F.concat(*parts))) if led else F.array().cast("array<string>")
    first = first.select("store_id", F.col("p.url").alias("url"), name.alias("name"), F.col("p.page.nav_text").alias("nav"), aliases.alias("aliases"), "observed_at", "pages_checked")
    first = urls.with_normalized(first, "url", "domain_url", homepage=True).drop("url")
    blocks = parsed.select("store_id", F.col("url").alias("page_url"), F.explode("page.blocks").alias("block"))
    state = rules.one_state(cut(rules.address_candidates(blocks, states, towns))).withColumnRenamed("reason", "state_note")
    x = first.join(agg, "store_id", "left").join(state.withColumn("addressed", F.lit(True)), "store_id", "left")
    x = x.withColumn("about", F.concat_ws(" ", "name", "description"))
    label = rules.classified(cut(x.select("store_id", "about", "nav")), "store_id", "about", "nav", keywords)
    x = x.join(label.select("store_id", F.col("label").alias("category"), F.when(F.col("tied") > 1, "ambiguous").alias("category_note")), "store_id", "left")
    none = F.array().cast("array<string>")
    ids, has = F.coalesce("identities", none), lambda c: F.coalesce(F.col(c), F.lit(False))
    shopify = F.when((F.size(ids) > 1) | has("conflict"), "conflict").when((F.size(ids) == 1) & has("delivery") & has("commerce"), "verified").otherwise("unconfirmed")
    x = x.withColumns({"shop_identity": F.when(F.size(ids) == 1, F.get(ids, F.lit(0))), "shopify": shopify, "india": F.when(has("addressed"), "verified").otherwise("unconfirmed"), "logo_url": F.lit(None).cast("string")})
    ok = (F.col("shopify") == "verified") & (F.col("india") == "verified")
    reason = (
        F.when(ok, "Store identity and Indian business address are supported by live pages.")
        .when(F.col("shopify") == "conflict", "Conflicting platform evidence.")
        .when(F.col("shopify") != "verified", "Shopify identity needs review.")
        .otherwise("Shopify is supported; an Indian business address is still needed.")
    )
    x = x.withColumns({"status": F.when(ok, "accepted").otherwise("review"), "reason": reason, "emails": F.coalesce("emails", none), "phones": F.coalesce("phones", none), "socials": F.coalesce("socials", F.create_map().cast("map<string,array<string>>"))})
    return with_missing(x, {"state": F.col("state_note"), "category": F.col("category_note")}).select(
        "store_id", "domain_url", "name", "aliases", "emails", "phones", "socials", "category", "description", "logo_url", "state", "shop_identity", "shopify", "india", "status", "reason", "missing", "pages_checked", "observed_at"
    )


def with_missing(rows: DataFrame, notes: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` and ``missing``: for each optional field without content, its note in ``notes``, or that it was not found."""
    kinds, notes = dict(rows.dtypes), notes or {}
    empty = lambda c: is_missing(F.col(c), "array" if kinds[c].startswith("array") else "map" if kinds[c].startswith("map") else "string")
    why = [F.when(empty(c), F.struct(F.lit(c).alias("k"), F.coalesce(notes.get(c, F.lit(None).cast("string")), F.lit("not_found_in_allowed_pages")).alias("v"))) for c in FIELDS]
    return rows.withColumn("missing", F.map_from_entries(F.array_compact(F.array(*why))))


def with_unreachable(found: DataFrame, candidates: DataFrame) -> DataFrame:
    """``found`` stores and, for candidates (id, url) without a page, a row that says so."""
    x = candidates.select(F.col("id").alias("store_id"), F.col("url").alias("domain_url")).join(found.select("store_id"), "store_id", "left_anti")
    return found.unionByName(x.withColumns({"status": F.lit("unreachable"), "reason": F.lit("No allowed HTML page was retrieved.")}), allowMissingColumns=True)


def select_links(parsed: DataFrame, known: KnownHosts = KnownHosts()) -> DataFrame:
    """(store_id, page_no, link, score): informative pages of the same site, by the greatest weight of path and text."""
    a = parsed.select("store_id", "page_no", "url", F.explode("page.anchors").alias("a")).where(~F.col("a.href").rlike(r"^(?:#|mailto:|tel:|javascript:|$)"))
    a = urls.with_normalized(a.withColumn("to", urls.resolved(F.col("url"), F.col("a.href"))), "to", "link")
    a = cut(known.with_site(known.with_site(a, "link", "l_"), "url", "p_")).where("link IS NOT NULL AND l_site = p_site")
    path = F.lower(F.regexp_extract("link", r"^[a-z]+://[^/?#]+([^?#]*)", 1))
    a = a.where(~path.rlike(r"/(?:cart|checkout|account|search)(?:/|$)|^/(?:products|collections|apps)/|^/blogs/[^/]+/") & ~F.contains("link", F.lit("?")))
    text = F.concat_ws(" ", path, F.lower("a.text"))
    score = F.greatest(*[F.when(F.contains(text, F.lit(w)), F.lit(n)).otherwise(0) for w, n in LINK_WEIGHTS])
    return a.select("store_id", "page_no", "link", score.alias("score")).where("score > 0").groupBy("store_id", "page_no", "link").agg(F.max("score").alias("score"))


#: Pictures that are no logo, by address or by their own words (fixed values).
NO_LOGO = "favicon|payment|visa|mastercard|placeholder|pixel|whatsapp|facebook|linkedin|instagram|youtube|logout|login|account|cart|social"


def logo_candidates(parsed: DataFrame, known: KnownHosts = KnownHosts()) -> DataFrame:
    """(store_id, page_no, src, score) of pictures that can be the logo: marked ones in the header or in a link home, and
    those in a header's link home; icons, payment marks and social networks are none. Top three by score, then address."""
    i = parsed.select("store_id", "page_no", "url", F.explode("page.imgs").alias("i")).where("i.src <> ''")
    i = i.where(~F.concat_ws(" ", "i.src", "i.name").rlike(rf"(?i){NO_LOGO}"))
    i = cut(known.with_site(known.with_site(i.withColumn("to", urls.resolved(F.col("url"), F.col("i.link"))), "to", "l_"), "url", "p_"))
    home = F.coalesce((F.col("l_site") == F.col("p_site")) & F.col("to").rlike(r"^[a-z]+://[^/?#]+/?(?:[?#]|$)"), F.lit(False))
    i = i.withColumn("home", home).where((F.col("i.marked") & (F.col("i.header") | F.col("home"))) | (F.col("i.header") & F.col("home")))
    score = 6 * F.col("i.marked").cast("int") + 5 * F.col("i.header").cast("int") + 12 * F.col("home").cast("int")
    i = i.select("store_id", "page_no", urls.resolved(F.col("url"), F.col("i.src")).alias("src"), score.alias("score"))
    o = parsed.select("store_id", "page_no", "url", F.explode(ld_objects(F.col("page.ldjson"))).alias("o"))
    o = o.where(F.exists("o.types", lambda t: t.contains("Organization") | t.contains("Store")) & F.col("o.logo").isNotNull())
    o = o.select("store_id", "page_no", urls.resolved(F.col("url"), F.col("o.logo")).alias("src"), F.lit(20).alias("score"))
    x = i.unionByName(o).where(F.col("src").rlike(r"^https?://[^/?#]") & ~F.col("src").rlike(r"(?i)favicon|\.ico(?:[?#]|$)"))
    x = x.groupBy("store_id", "src").agg(F.max("score").alias("score"), F.min("page_no").alias("page_no"))
    rank = F.row_number().over(Window.partitionBy("store_id").orderBy(F.desc("score"), "src"))
    return x.withColumn("rank", rank).where("rank <= 3").select("store_id", "page_no", "src", "score")
