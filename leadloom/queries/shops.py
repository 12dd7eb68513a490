"""Queries over stores, evidence and audit samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import contacts, rules, urls
from leadloom.operators import browse, dedup, export, statistics, validation
from leadloom.operators.incremental import distinct_rows_by
from leadloom.plans import projection
from leadloom.queries import sql
from leadloom.session import new_folder, table

QUERIES, SQL = {}, {}
AS_OF = "2025-12-01 00:00:00"


def query(text: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add


def _accepted(spark: SparkSession, d: str) -> DataFrame:
    return dedup.current_stores(table(spark, d, "stores")).where("status = 'accepted'")


_OK = f"{sql.STORE}, ok AS (SELECT * FROM store WHERE status = 'accepted')"
_MISSING = {
    **{c: f"coalesce(len({c}), 0) = 0" for c in ("emails", "phones")},
    "socials": "coalesce(cardinality(socials), 0) = 0",
    **{c: f"coalesce({c}, '') = ''" for c in ("category", "description", "logo_url", "state")},
}
_M = " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER (WHERE {m}) AS missing, count(*) FILTER (WHERE NOT ({m})) AS present FROM ok" for c, m in _MISSING.items())


@query(f"WITH {_OK}, m AS ({_M}) SELECT field, missing, present, round_even(100.0 * missing / nullif(missing + present, 0), 1)::DOUBLE AS percent_missing FROM m")
def stat_missing(spark: SparkSession, d: str) -> DataFrame:
    return statistics.missingness(_accepted(spark, d))


@query(f"WITH {_OK}, m AS ({_M}) SELECT field, floor(100.0 * present / (missing + present) + 0.5)::BIGINT AS percent FROM m")
def stat_coverage(spark: SparkSession, d: str) -> DataFrame:
    return statistics.coverage(_accepted(spark, d))


@query(f"WITH {_OK} " + " UNION ALL ".join(f"SELECT '{c}' AS field, coalesce(nullif({c}, ''), 'unknown') AS value, count(*) AS n FROM ok WHERE '{c}' = 'rule_version' OR coalesce({c}, '') <> '' GROUP BY 2" for c in ("state", "category", "rule_version")))
def stat_hist(spark: SparkSession, d: str) -> DataFrame:
    x = _accepted(spark, d)
    part = lambda c: statistics.by_value(x, c, skip_missing=c != "rule_version").select(F.lit(c).alias("field"), "value", "n")
    return part("state").unionByName(part("category")).unionByName(part("rule_version"))


@query(f"WITH {sql.STORE} SELECT reason, status, count(*) AS n FROM store WHERE coalesce(reason, '') <> '' GROUP BY ALL")
def stat_reasons(spark: SparkSession, d: str) -> DataFrame:
    x = dedup.current_stores(table(spark, d, "stores"), ["store_id", "reason", "status", "observed_at"])
    return x.where("reason <> ''").groupBy("reason", "status").agg(F.count("*").alias("n"))


@query(f"WITH {_OK} SELECT store_id, {sql.FILLED} AS filled, regexp_replace({sql.host('domain_url')}, '^www\\.', '') AS label FROM ok")
def coverage_rank(spark: SparkSession, d: str) -> DataFrame:
    x = _accepted(spark, d)
    return x.select("store_id", dedup.completeness().alias("filled"), F.regexp_replace(urls.host_of(F.col("domain_url")), r"^www\.", "").alias("label"))


# The greedy rule, row by row in order, with the keys of winners in lists.
_GREEDY = f"""WITH RECURSIVE {_OK},
s AS (SELECT store_id, domain_url, {sql.site('shop_identity')} AS identity, {sql.site('domain_url')} AS site, {sql.FILLED} AS filled, emails, phones, aliases, socials FROM ok),
o AS (SELECT *, row_number() OVER (ORDER BY coalesce(site LIKE '%.shops.example', TRUE), -filled, domain_url NULLS FIRST, store_id) AS k FROM s),
g AS (SELECT 0::BIGINT AS k, NULL::VARCHAR AS id, NULL::VARCHAR AS duplicate_of, MAP([]::VARCHAR[], []::VARCHAR[]) AS ids, MAP([]::VARCHAR[], []::VARCHAR[]) AS sites
UNION ALL
SELECT k, id, of, CASE WHEN of IS NULL AND identity IS NOT NULL THEN map_concat(ids, MAP([identity], [id])) ELSE ids END, CASE WHEN of IS NULL AND site IS NOT NULL THEN map_concat(sites, MAP([site], [id])) ELSE sites END
FROM (SELECT o.k, o.store_id AS id, o.identity, o.site, g.ids, g.sites, coalesce(g.ids[o.identity], g.sites[o.site]) AS of FROM g JOIN o ON o.k = g.k + 1)),
decided AS (SELECT id, duplicate_of FROM g WHERE k > 0)
"""


@query(_GREEDY + "SELECT id, duplicate_of FROM decided")
def dedup_winner(spark: SparkSession, d: str) -> DataFrame:
    known = urls.KnownHosts.read(table(spark, d, "known_hosts"))
    return dedup.shop_winners(dedup.shop_rows(table(spark, d, "stores"), known))


@query(
    _GREEDY
    + ", m AS (SELECT coalesce(duplicate_of, id) AS w, emails, phones, list_concat(coalesce(aliases, []::VARCHAR[]), CASE WHEN duplicate_of IS NULL THEN [] ELSE [domain_url] END) AS aliases, socials FROM decided JOIN o ON o.store_id = decided.id),"
    " n AS (SELECT w, k, string_agg(DISTINCT v, ',' ORDER BY v) AS vs FROM (SELECT w, k, unnest(v) AS v FROM (SELECT w, unnest(map_keys(socials)) AS k, unnest(map_values(socials)) AS v FROM m)) GROUP BY 1, 2),"
    " t AS (SELECT w, string_agg(k || '=' || vs, '|' ORDER BY k) AS socials FROM n GROUP BY 1) SELECT m.w AS store_id, "
    + ", ".join(f"array_to_string(list_sort(list_distinct(flatten(list(coalesce({c}, []::VARCHAR[]))))), '|') AS {c}" for c in ("emails", "phones", "aliases"))
    + ", coalesce(any_value(t.socials), '') AS socials FROM m LEFT JOIN t USING (w) GROUP BY m.w"
)
def dedup_merge(spark: SparkSession, d: str) -> DataFrame:
    known = urls.KnownHosts.read(table(spark, d, "known_hosts"))
    shops = dedup.shop_rows(table(spark, d, "stores"), known)
    x = dedup.merged_contacts(shops, dedup.shop_winners(shops))
    nets = F.array_join(F.transform(F.array_sort(F.map_entries("socials")), lambda e: F.concat_ws("=", e["key"], F.array_join(e["value"], ","))), "|").alias("socials")
    return x.select("store_id", *[F.array_join(c, "|").alias(c) for c in ("emails", "phones", "aliases")], nets)


_FACT = "field, value, source_url, rule, excerpt, observed_at, content_hash, family"


@query(
    _GREEDY
    + f", m AS (SELECT coalesce(d.duplicate_of, d.id) AS w, d.duplicate_of IS NOT NULL AS added, e.* FROM evidence e JOIN decided d ON d.id = e.store_id WHERE d.duplicate_of IS NULL OR e.field IN ('emails', 'phones', 'socials'))"
    f" SELECT w AS store_id, {_FACT}, bool_and(added) AS added FROM m GROUP BY w, {_FACT}"
)
def evidence_append(spark: SparkSession, d: str) -> DataFrame:
    """Each winner's evidence, with what its duplicates' contacts add to it."""
    shops = dedup.shop_rows(table(spark, d, "stores"), urls.KnownHosts.read(table(spark, d, "known_hosts")))
    return dedup.merged_evidence(dedup.shop_winners(shops), table(spark, d, "evidence"))


_PROJECT = f"""WITH {sql.NOW}, {sql.STORE}, ev AS (SELECT store_id, min(observed_at) AS oldest FROM evidence WHERE field IN ('shopify', 'india') GROUP BY 1),
p AS (SELECT now.id, now.url, now.created_at, store.store_id IS NOT NULL AS has_store, store.name, store.state, store.category, store.description, store.observed_at,
  CASE WHEN now.status = 'accepted' AND (store.observed_at < TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY OR ev.oldest < TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY) THEN 'stale'
       WHEN now.status = 'accepted' AND NOT coalesce(store.shopify = 'verified' AND store.india = 'verified', FALSE) THEN 'review' ELSE now.status END AS status
  FROM now LEFT JOIN store ON store.store_id = now.id LEFT JOIN ev ON ev.store_id = now.id)
"""


def _projected(spark: SparkSession, d: str) -> DataFrame:
    t = {n: table(spark, d, n) for n in ("candidates", "stores", "evidence")}
    return projection.project(**t, as_of=AS_OF, days=90)


@query(_PROJECT + "SELECT id, status, has_store FROM p")
def project_status(spark: SparkSession, d: str) -> DataFrame:
    return _projected(spark, d).select("id", "status", "has_store")


@query(
    _PROJECT
    + "SELECT id, url, name, status FROM p WHERE status IN ('review', 'blocked', 'unreachable', 'error', 'stale') AND contains(lower(coalesce(url, '') || ' ' || coalesce(name, '') || ' ' || coalesce(state, '')), 'ra')"
    " ORDER BY CASE status WHEN 'review' THEN 1 WHEN 'blocked' THEN 3 ELSE 4 END, CASE WHEN has_store THEN lower(coalesce(name, '')) ELSE lower(url) END, created_at, id LIMIT 100 OFFSET 100"
)
def browse_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of what needs attention and has "ra" in address, name or state."""
    x = browse.in_order(browse.listed(_projected(spark, d), q="RA", status="attention"))
    return browse.page(x, 2, 100).select("id", "url", "name", "status")


@query(_PROJECT + "SELECT DISTINCT 'category' AS facet, category AS value FROM p WHERE category <> '' UNION SELECT DISTINCT 'state', state FROM p WHERE state <> ''")
def browse_facets(spark: SparkSession, d: str) -> DataFrame:
    return browse.facets(_projected(spark, d), "category", "state")


@query(
    f"WITH {_OK}, x AS (SELECT store_id, name, {sql.FILLED} AS filled, regexp_replace({sql.host('domain_url')}, '^www\\.', '') AS label, category, state, description FROM ok)"
    " SELECT store_id, name, filled FROM x WHERE contains(lower(label), 'oo') OR contains(lower(category), 'oo') OR contains(lower(state), 'oo') OR contains(lower(description), 'oo') ORDER BY filled DESC, name, store_id LIMIT 18"
)
def site_explorer(spark: SparkSession, d: str) -> DataFrame:
    """The first page of the site's list: best covered first, "oo" in host, category, state or description."""
    x = _accepted(spark, d)
    label = F.regexp_replace(urls.host_of(F.col("domain_url")), r"^www\.", "")
    x = x.where(browse.matches_any("oo", label, F.col("category"), F.col("state"), F.col("description")))
    return x.select("store_id", "name", dedup.completeness().alias("filled")).orderBy(F.desc("filled"), "name", "store_id").limit(18)


_FILTERS = ("all", "attention", *browse.STATUS_RANK, "stale", "error")


@query(_PROJECT + " UNION ALL ".join(f"SELECT '{s}' AS filter, count(*) AS n FROM p WHERE {'TRUE' if s == 'all' else f'status IN {browse.ATTENTION}' if s == 'attention' else f'status = {s!r}'}" for s in _FILTERS))
def status_filters(spark: SparkSession, d: str) -> DataFrame:
    """How many candidates each filter of the list shows."""
    x = _projected(spark, d).select("status")
    return x.agg(*[F.count_if(browse.status_filter(s)).alias(s) for s in _FILTERS]).select(F.explode(F.array(*[F.struct(F.lit(s).alias("filter"), F.col(s).alias("n")) for s in _FILTERS])).alias("x")).select("x.*")


_X = f"WITH {_OK}, x AS (SELECT store_id, name, {sql.FILLED} AS filled, observed_at FROM ok), n AS (SELECT count(*) AS total FROM x)"
_SORTED = {"name": "name NULLS FIRST, store_id", "coverage": "filled DESC NULLS LAST, name NULLS FIRST, store_id", "newest": "observed_at DESC NULLS LAST, name NULLS FIRST, store_id"}


@query(
    _X + ", r AS (" + " UNION ALL ".join(f"SELECT '{k}' AS sort, store_id, row_number() OVER (ORDER BY {o}) AS position, {('least(2, ceil(total / 18.0))', 'ceil(total / 18.0)', '1')[i]} AS page, total FROM x, n" for i, (k, o) in enumerate(_SORTED.items()))
    + ") SELECT sort, position::INT AS position, store_id, total FROM r WHERE position > (page - 1) * 18 AND position <= page * 18"
)
def site_pages(spark: SparkSession, d: str) -> DataFrame:
    """The second page by name, the last by coverage (asked for as one past the end) and the first of the newest (as page 0)."""
    x = _accepted(spark, d).select("store_id", "name", dedup.completeness().alias("filled"), "observed_at")
    parts = [browse.explored(x, k, n).select(F.lit(k).alias("sort"), "position", "store_id", "total") for k, n in (("name", 2), ("coverage", 1 << 30), ("newest", 0))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {_OK} SELECT count(*) AS stores, sum({sql.FILLED})::BIGINT AS filled, floor(100.0 * sum({sql.FILLED}) / (count(*) * 7) + 0.5)::BIGINT AS percent FROM ok")
def stat_filled(spark: SparkSession, d: str) -> DataFrame:
    return statistics.filled_share(_accepted(spark, d))


@query(f"WITH {_OK}, m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS field, CASE WHEN '{c}' = 'state' AND reason <> '' THEN reason ELSE 'not_found_in_allowed_pages' END AS reason FROM ok WHERE {m}" for c, m in _MISSING.items()) + ") SELECT field, reason, count(*) AS n FROM m GROUP BY ALL")
def stat_missing_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why fields are missing: for the state what the store's reason says, else the default."""
    x = _accepted(spark, d)
    return statistics.missing_reasons(x.withColumn("missing", F.create_map(F.lit("state"), F.nullif("reason", F.lit("")))))


_RISKY = lambda c: f"CASE WHEN {c} IS NULL THEN '' WHEN regexp_matches({c}, '^[ \\t\\n\\x0b\\f\\r]*[=+@-]') OR regexp_matches({c}, '^[\\t\\r\\n]') THEN '''' || {c} ELSE {c} END"


@query(f"WITH {_OK} SELECT store_id, " + ", ".join(f"{_RISKY(c)} AS {c}" for c in ("domain_url", "category", "description", "logo_url", "state")) + f", {_RISKY('phones[1]')} AS phone FROM ok")
def csv_safe(spark: SparkSession, d: str) -> DataFrame:
    x = _accepted(spark, d)
    cells = [export.csv_safe(F.col(c)).alias(c) for c in ("domain_url", "category", "description", "logo_url", "state")]
    return x.select("store_id", *cells, export.csv_safe(F.get("phones", F.lit(0))).alias("phone"))


_JSON = {c: f"to_json({c})::VARCHAR" for c in ("emails", "phones")} | {
    "socials": "CASE WHEN socials IS NOT NULL THEN '{' || array_to_string(list_transform(list_sort(map_entries(socials)), lambda e: to_json(e.key)::VARCHAR || ':' || to_json(e.value)::VARCHAR), ',') || '}' END",
    "observed_at": "rtrim(rtrim(strftime(observed_at, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.')",
}


@query(f"WITH {_OK} SELECT " + ", ".join(f"{_RISKY(_JSON.get(c, c))} AS {c}" for c in export.RECORD) + " FROM ok")
def export_records(spark: SparkSession, d: str) -> DataFrame:
    """Guarded public records as text cells, nested ones as JSON."""
    return export.records(_accepted(spark, d))


_LIST = lambda c: f"'[' || array_to_string({c}, ',') || ']'"
_CANON = {c: c for c in ("store_id", "domain_url", "name", "category", "description", "logo_url", "state", "shop_identity", "shopify", "india", "status", "reason", "rule_version")}
_CANON |= {c: _LIST(c) for c in ("emails", "phones", "aliases")} | {"pages_checked": "pages_checked::VARCHAR", "observed_at": "epoch_us(observed_at)::VARCHAR"}
_CANON["socials"] = f"'{{{{' || array_to_string(list_transform(list_sort(map_entries(socials)), lambda e: e.key || '=' || {_LIST('e.value')}), ';') || '}}}}'".replace("{{", "{").replace("}}", "}")
_ROW = "concat_ws(chr(10), " + ", ".join(f"'{c}=' || {v}" for c, v in sorted(_CANON.items())) + ")"


@query(
    f"""WITH {_OK}, r AS (SELECT store_id, sha256({_ROW}) AS digest, ('0x' || sha256(store_id)[1:15])::BIGINT % (count(*) OVER () // 4096 + 1) AS b FROM ok),
x AS (SELECT b, count(*) AS n, sha256(string_agg(digest, '' ORDER BY store_id)) AS digest FROM r GROUP BY b)
SELECT sum(n)::BIGINT AS rows, CASE WHEN count(*) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY b)) END AS digest FROM x"""
)
def snapshot_hash(spark: SparkSession, d: str) -> DataFrame:
    """One digest over all accepted records, the same at any partitioning."""
    return export.snapshot_digest(export.row_digest(_accepted(spark, d), "store_id"), "store_id")


@query(f"WITH {_OK}, n AS (SELECT count(*) AS n FROM ok), e AS (SELECT count(*) AS n FROM evidence WHERE store_id IN (SELECT store_id FROM ok)) SELECT n.n AS stores, e.n AS evidence, 0 AS files_changed, 0 AS cells_changed FROM n, e")
def snapshot_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A whole snapshot written to the shared folder, read again and compared: files by their checksums, cells one by one."""
    now = _accepted(spark, d)
    folder, rows = new_folder(spark, "snapshot"), now.select(F.col("store_id").alias("id"), F.col("domain_url").alias("url"), "status", "reason", F.lit(None).cast("string").alias("duplicate_of"))
    tables = export.snapshot_tables(rows, now, table(spark, d, "evidence"), table(spark, d, "sources"), table(spark, d, "runs"))
    export.write_snapshot(spark, folder, tables, export.snapshot_digest(export.row_digest(now, "store_id"), "store_id").first().digest or "")
    _, back = export.read_snapshot(spark, folder)
    n = lambda x, c: x.agg(F.count("*").alias(c))
    files, cells = n(export.changed_files(spark, folder), "files_changed"), n(validation.cell_differences(now, back["stores.csv"]), "cells_changed")
    return n(back["stores.jsonl"], "stores").join(n(back["evidence.jsonl"], "evidence")).join(files).join(cells)


@query(f"WITH {_OK} SELECT store_id FROM (SELECT DISTINCT store_id FROM ok) ORDER BY sha256('20260929:' || store_id), store_id LIMIT 150")
def audit_sample(spark: SparkSession, d: str) -> DataFrame:
    return export.ordered_sample(_accepted(spark, d), "store_id")


@query(
    f"""WITH {_OK}, e AS (SELECT store_id, list(DISTINCT field) AS fields, list(DISTINCT family) AS families,
  bool_or(coalesce(field = 'shopify' AND family = 'delivery' AND regexp_matches(value, '{rules.RUNTIME}') AND regexp_matches(value, '(?i)^[^?#]*\\.(js|mjs|css)([?#]|$)'), FALSE)) AS delivered,
  bool_or(coalesce(source_url = '', TRUE) OR observed_at IS NULL OR NOT coalesce(regexp_full_match(content_hash, '[0-9a-f]{{64}}'), FALSE)) AS bad FROM evidence GROUP BY 1),
x AS (SELECT ok.*, e.fields, e.families, e.bad, e.delivered, ok.store_id IN (SELECT candidate_id FROM sources) AS named FROM ok LEFT JOIN e USING (store_id)),
u AS (SELECT 'unverified' AS code, store_id FROM x WHERE NOT coalesce(shopify = 'verified' AND india = 'verified', FALSE)
UNION ALL SELECT 'required_evidence', store_id FROM x WHERE NOT coalesce(list_has_all(fields, ['shopify', 'india']), FALSE)
UNION ALL SELECT 'families', store_id FROM x WHERE NOT coalesce(list_has_all(families, ['identity', 'delivery', 'commerce']), FALSE)
UNION ALL SELECT 'attribution', store_id FROM x WHERE NOT named
UNION ALL SELECT 'email', store_id FROM x WHERE len(list_filter(emails, lambda a: NOT (regexp_full_match(a, '{contacts.EMAIL.replace("'", "''")}')
  AND NOT list_contains({list(contacts.TEMPLATE_DOMAINS)}, lower(split_part(a, '@', -1))) AND NOT regexp_matches(lower(a), '\\.(png|jpg|webp)$') AND NOT regexp_matches(lower(a), '^(yourname|example)@')))) > 0
UNION ALL SELECT 'provenance', store_id FROM x WHERE bad
UNION ALL SELECT 'runtime', store_id FROM x WHERE NOT coalesce(delivered, FALSE)
UNION ALL SELECT 'missing_identity', store_id FROM x WHERE coalesce(shop_identity, '') = ''
UNION ALL SELECT DISTINCT 'social', store_id FROM (SELECT store_id, unnest(flatten(map_values(socials))) AS v FROM x)
UNION ALL SELECT 'repeated_domain', store_id FROM ok WHERE domain_url IN (SELECT domain_url FROM ok GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'repeated_identity', store_id FROM ok WHERE shop_identity IN (SELECT shop_identity FROM ok GROUP BY 1 HAVING count(*) > 1))
SELECT *, NULL::VARCHAR AS field FROM u UNION ALL """
    + " UNION ALL ".join(f"SELECT 'unsupported_field', store_id, '{c}' FROM x WHERE NOT ({m}) AND NOT coalesce(list_contains(fields, '{c}'), FALSE)" for c, m in _MISSING.items())
)
def validate_violations(spark: SparkSession, d: str) -> DataFrame:
    return validation.store_violations(_accepted(spark, d), table(spark, d, "evidence"), table(spark, d, "sources"))


@query(f"WITH {_OK} SELECT shop_identity AS value, count(*) AS n FROM ok WHERE shop_identity IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def uniqueness(spark: SparkSession, d: str) -> DataFrame:
    return validation.repeated(_accepted(spark, d), "shop_identity")


@query(f"WITH {_OK} SELECT FALSE AS passed, count(*) AS repeated FROM (SELECT 1 FROM ok WHERE shop_identity IS NOT NULL GROUP BY shop_identity HAVING count(*) > 1)")
def snapshot_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Whether the accepted stores pass all checks (these do not), and how many identities repeat."""
    now = _accepted(spark, d)
    v = validation.verdict(validation.store_violations(now, table(spark, d, "evidence"), table(spark, d, "sources")))
    return v.join(validation.repeated(now, "shop_identity").agg(F.count("*").alias("repeated"))).select("passed", "repeated")


@query("SELECT store_id, count(*) AS n FROM (SELECT DISTINCT * FROM evidence) GROUP BY 1")
def evidence_distinct(spark: SparkSession, d: str) -> DataFrame:
    return distinct_rows_by(table(spark, d, "evidence"), "store_id")


@query(
    "SELECT store_id, field, value, source_url, rule, excerpt, max(observed_at) AS observed_at, arg_max(content_hash, (observed_at, content_hash)) AS content_hash, arg_max(family, (observed_at, content_hash, family)) AS family"
    " FROM evidence GROUP BY store_id, field, value, source_url, rule, excerpt"
)
def evidence_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """One row a fact, with the values of its last sighting."""
    return projection.last_sightings(table(spark, d, "evidence"))


@query("SELECT store_id, coalesce(array_to_string(list_sort(list(DISTINCT nullif(family, '')) FILTER (WHERE family <> '')), '|'), '') AS families, array_to_string(list_filter(['commerce', 'delivery', 'identity'], lambda f: NOT coalesce(list_contains(list(DISTINCT family), f), FALSE)), '|') AS lacking FROM evidence GROUP BY 1")
def signal_families(spark: SparkSession, d: str) -> DataFrame:
    x = statistics.evidence_families(table(spark, d, "evidence"))
    return x.select("store_id", F.array_join("families", "|").alias("families"), F.array_join("lacking", "|").alias("lacking"))


@query("WITH e AS (SELECT store_id, value, count(*) AS n FROM (SELECT DISTINCT * FROM evidence) WHERE field = 'shopify' AND value IS NOT NULL GROUP BY 1, 2), m AS (SELECT store_id, max(n) AS top FROM e GROUP BY 1) SELECT store_id, CASE WHEN count(*) = 1 THEN min(value) END AS value, count(*) AS tied FROM e JOIN m USING (store_id) WHERE n = top GROUP BY store_id")
def priority_value(spark: SparkSession, d: str) -> DataFrame:
    """The identity that most of a store's evidence names, null where several tie."""
    return projection.strict_winner(table(spark, d, "evidence").where("field = 'shopify'").distinct(), "store_id", "value")


@query(
    "WITH s AS (SELECT DISTINCT store_id, network, link FROM (SELECT store_id, unnest(map_keys(socials)) AS network, unnest(map_values(socials)) AS links FROM stores), unnest(links) AS t(link)) SELECT network, count(*) AS profiles, count(DISTINCT store_id) AS stores FROM s GROUP BY 1"
)
def social_networks(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "stores").select("store_id", F.explode("socials").alias("network", "links")).select("store_id", "network", F.explode("links").alias("link")).distinct()
    return x.groupBy("network").agg(F.count("*").alias("profiles"), F.count_distinct("store_id").alias("stores"))


_PHONE = "regexp_replace(regexp_replace(p, '(?i)\\s*(ext\\.?|x)\\s*[0-9]+\\s*$', ''), '[^0-9+]', '', 'g')"


@query(
    f"WITH p AS (SELECT DISTINCT store_id, unnest(phones) AS p FROM stores) SELECT store_id, p AS phone, CASE WHEN regexp_matches({_PHONE}, '^(\\+?91|0)?[1-9][0-9]{{9}}$') THEN '+91' || right({_PHONE}, 10)"
    f" WHEN regexp_matches({_PHONE}, '^\\+[1-9][0-9]{{7,14}}$') AND NOT starts_with({_PHONE}, '+91') THEN {_PHONE} END AS e164 FROM p"
)
def phone_normalize(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "stores").select("store_id", F.explode("phones").alias("phone")).distinct()
    return x.select("store_id", "phone", contacts.phone(F.col("phone")).alias("e164"))


@query(
    "WITH a AS (SELECT DISTINCT store_id, field, value FROM evidence WHERE field IN ('emails', 'phones') AND value IS NOT NULL), b AS (SELECT DISTINCT store_id, 'emails' AS field, unnest(emails) AS value FROM stores UNION SELECT DISTINCT store_id, 'phones', unnest(phones) FROM stores)"
    " SELECT 'left' AS side, store_id, field, value FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT 'right', store_id, field, value FROM (FROM b EXCEPT ALL FROM a)"
)
def set_equality(spark: SparkSession, d: str) -> DataFrame:
    """Contacts that only the evidence or only the stores have."""
    a = table(spark, d, "evidence").where("field IN ('emails', 'phones') AND value IS NOT NULL").select("store_id", "field", "value").distinct()
    s = table(spark, d, "stores")
    part = lambda c: s.select("store_id", F.lit(c).alias("field"), F.explode(c).alias("value")).distinct()
    return validation.differences(a, part("emails").unionByName(part("phones")))


@query("SELECT 'stores' AS name, count(DISTINCT store_id) AS n FROM stores UNION ALL SELECT 'candidates', count(DISTINCT id) FROM candidates UNION ALL SELECT 'observed', count(DISTINCT candidate_id) FROM observations")
def parity_check(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of stores, candidates and observed candidates, shown since they differ."""
    key = lambda n, c: table(spark, d, n).where(F.col(c).isNotNull()).select(c).distinct()
    return validation.counts_differ(stores=key("stores", "store_id"), candidates=key("candidates", "id"), observed=key("observations", "candidate_id"))


@query(
    "WITH c AS (SELECT DISTINCT store_id FROM stores), o AS (SELECT DISTINCT candidate_id FROM observations) SELECT 'stores_without_candidate' AS code, count(*) AS n FROM c WHERE store_id NOT IN (SELECT id FROM candidates)"
    " UNION ALL SELECT 'stores_without_observation', count(*) FROM c WHERE store_id NOT IN (FROM o) UNION ALL SELECT 'evidence_without_store', count(*) FROM (SELECT DISTINCT store_id FROM evidence) WHERE store_id NOT IN (FROM c)"
)
def references(spark: SparkSession, d: str) -> DataFrame:
    """Keys that refer to nothing."""
    key = lambda n, c: table(spark, d, n).select(F.col(c).alias("k")).distinct()
    gone = lambda code, a, b: a.join(b, "k", "left_anti").agg(F.count("*").alias("n")).select(F.lit(code).alias("code"), "n")
    stores = key("stores", "store_id")
    return gone("stores_without_candidate", stores, key("candidates", "id")).unionByName(gone("stores_without_observation", stores, key("observations", "candidate_id"))).unionByName(gone("evidence_without_store", key("evidence", "store_id"), stores))


@query(_PROJECT + "SELECT count(*) AS rows, count(*) FILTER (WHERE status = 'accepted') AS accepted, count(*) FILTER (WHERE status IN ('review', 'blocked', 'unreachable', 'error', 'stale')) AS attention, floor(100.0 * count(*) FILTER (WHERE status IN ('review', 'blocked', 'unreachable', 'error', 'stale')) / count(*) + 0.5)::BIGINT AS percent FROM p")
def overview(spark: SparkSession, d: str) -> DataFrame:
    return browse.summary(_projected(spark, d))


@query(
    "WITH s AS (SELECT store_id, max(observed_at) AS last_at FROM stores GROUP BY 1), e AS (SELECT store_id, field, value, observed_at FROM evidence WHERE value IS NOT NULL),"
    " l AS (SELECT store_id, field, max(observed_at) AS seen_at FROM e GROUP BY 1, 2) SELECT l.store_id, l.field, l.seen_at, date_diff('day', l.seen_at, s.last_at) AS days FROM l JOIN s USING (store_id) WHERE l.seen_at <= s.last_at"
)
def evidence_age(spark: SparkSession, d: str) -> DataFrame:
    """How many calendar days before its store's last state a field was last seen."""
    e = table(spark, d, "evidence").where("value IS NOT NULL").groupBy("store_id", "field").agg(F.max("observed_at").alias("seen_at"))
    s = table(spark, d, "stores").groupBy("store_id").agg(F.max("observed_at").alias("last_at"))
    return e.join(s, "store_id").where("seen_at <= last_at").select("store_id", "field", "seen_at", F.date_diff("last_at", "seen_at").alias("days"))
