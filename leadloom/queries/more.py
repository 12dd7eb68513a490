"""Queries over logs and ordered rules; SQL over literals is a regression check written by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import rules
from leadloom.functions.html import ld_objects
from leadloom.operators import dedup, ledger, logs, refine
from leadloom.queries import sql
from leadloom.session import table
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


@query(
    "WITH x AS (SELECT i.candidate_id, r.started_at, i.run_id, i.result_json, row_number() OVER (PARTITION BY i.candidate_id ORDER BY r.started_at DESC, i.run_id DESC, i.result_json DESC) AS rn"
    " FROM run_items i JOIN runs r ON r.id = i.run_id WHERE i.status = 'done' AND i.result_json IS NOT NULL) SELECT candidate_id, started_at, run_id, result_json FROM x WHERE rn = 1"
)
def latest_result(spark: SparkSession, d: str) -> DataFrame:
    x = logs.current_results(table(spark, d, "run_items"), table(spark, d, "runs"))
    return x.select("candidate_id", "started_at", "run_id", "result_json")


@query(
    f"""WITH {sql.NOW}, o AS (SELECT store_id AS id, arg_max(status, (observed_at, status)) AS status FROM stores WHERE observed_at IS NOT NULL GROUP BY 1)
SELECT now.id, coalesce(o.status, now.status) AS status FROM now LEFT JOIN o USING (id)"""
)
def status_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Candidates' statuses, overridden by the last state of their stores."""
    log = table(spark, d, "stores").where("observed_at IS NOT NULL").select(F.col("store_id").alias("id"), "status", F.col("observed_at").alias("at"))
    return logs.with_overrides(ledger.current_candidates(table(spark, d, "candidates")).select("id", "status"), "id", "status", log)


@query(
    f"""WITH {sql.NOW}, {sql.STORE} SELECT now.id, CASE WHEN now.status = 'duplicate' THEN 'duplicate' WHEN now.status = 'queued' THEN 'queued' ELSE coalesce(nullif(store.reason, ''), 'Not collected') END AS reason
FROM now LEFT JOIN store ON store.store_id = now.id WHERE now.status <> 'accepted'"""
)
def rejection_reasons(spark: SparkSession, d: str) -> DataFrame:
    now = ledger.current_candidates(table(spark, d, "candidates")).where("status <> 'accepted'").select("id", "status")
    s = dedup.current_stores(table(spark, d, "stores"), ["store_id", "reason", "observed_at"]).select(F.col("store_id").alias("id"), "reason")
    st = F.col("status")
    why = logs.first_reason((st == "duplicate", F.lit("duplicate")), (st == "queued", F.lit("queued")), (F.lit(True), F.col("reason")), (F.lit(True), F.lit("Not collected")))
    return now.join(s, "id", "left").select("id", why.alias("reason"))


@query(
    f"""WITH {sql.SEEN}, r AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY bytes DESC, id) AS rn FROM seen WHERE candidate_id IS NOT NULL),
v AS (SELECT candidate_id, id, bytes, row_number() OVER (PARTITION BY candidate_id ORDER BY rn) AS k FROM r WHERE rn <= 3 AND outcome = 'ok') SELECT candidate_id, id, bytes FROM v WHERE k = 1"""
)
def top3_first_valid(spark: SparkSession, d: str) -> DataFrame:
    """The first usable one of a candidate's three largest responses."""
    x = ledger.observed_once(table(spark, d, "observations")).where("candidate_id IS NOT NULL").select("candidate_id", "id", "bytes", "outcome")
    return logs.top_valid(x, "candidate_id", "bytes", "id", F.col("outcome") == "ok").select("candidate_id", "id", "bytes")


@query(f"WITH {sql.SEEN} SELECT run_id, candidate_id, id, rank FROM (SELECT run_id, candidate_id, id, row_number() OVER (PARTITION BY run_id, candidate_id ORDER BY id) AS rank FROM seen WHERE kind = 'page') WHERE rank <= 7")
def frontier_budget(spark: SparkSession, d: str) -> DataFrame:
    """The page requests of a candidate in a run that its budget of seven allows."""
    x = ledger.observed_once(table(spark, d, "observations")).where("kind = 'page'").select("run_id", "candidate_id", "id", F.struct("run_id", "candidate_id").alias("key"))
    return logs.within_budget(x, "key", ["id"], 7).select("run_id", "candidate_id", "id", "rank")


@query("SELECT store_id, value, min(part)::INT AS part FROM (SELECT store_id, unnest(emails) AS value, 0 AS part FROM stores UNION ALL SELECT store_id, value, 1 FROM evidence WHERE field = 'emails') GROUP BY 1, 2")
def ordered_union(spark: SparkSession, d: str) -> DataFrame:
    """E-mails of stores, then those that only their evidence has."""
    a = table(spark, d, "stores").select("store_id", F.explode("emails").alias("value"))
    b = table(spark, d, "evidence").where("field = 'emails'").select("store_id", "value")
    return logs.ordered_union("store_id", "value", a, b)


@query(
    f"""WITH {sql.STORE}, first AS (SELECT store_id, arg_min(domain_url, observed_at) AS domain_url, arg_min(rule_version, observed_at) AS v FROM stores GROUP BY 1),
x AS (SELECT coalesce(s.store_id, f.store_id) AS store_id, s.rule_version AS a, f.v AS b FROM store s FULL JOIN first f USING (store_id)) SELECT store_id, CASE WHEN a IS NOT DISTINCT FROM b THEN 'same' ELSE 'changed' END AS state FROM x"""
)
def baseline_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether a store's current rule version is that of its first state."""
    s = table(spark, d, "stores")
    first = s.groupBy("store_id").agg(F.min_by("rule_version", "observed_at").alias("rule_version"))
    return logs.against_baseline(dedup.current_stores(s, ["store_id", "rule_version", "observed_at"]), first, "store_id", "rule_version")


_TEXT = lambda cols: "concat_ws(chr(10), " + ", ".join(f"'{c}=' || {v}" for c, v in sorted(cols.items())) + ")"
_EVIDENCE = _TEXT({c: c for c in ("store_id", "field", "value", "source_url", "rule", "excerpt", "content_hash", "family")} | {"observed_at": "epoch_us(observed_at)"})
_HASHES = f"""h AS (SELECT DISTINCT store_id AS candidate_id, sha256({_EVIDENCE}) AS h FROM evidence),
hashes AS (SELECT candidate_id, sha256(count(*) || ':' || sum(('0x' || h[1:15])::BIGINT) || ':' || sum(('0x' || h[16:30])::BIGINT) || ':' || sum(('0x' || h[31:45])::BIGINT) || ':' || sum(('0x' || h[46:60])::BIGINT)) AS evidence_hash FROM h GROUP BY 1)"""


@query(f"WITH {_HASHES} FROM hashes")
def evidence_hash(spark: SparkSession, d: str) -> DataFrame:
    """A digest of each store's evidence, in whatever order its rows come."""
    return logs.evidence_hashes(table(spark, d, "evidence"))


@query(
    "WITH s AS (SELECT store_id, arg_max(status, observed_at) AS status FROM stores GROUP BY 1), e AS (SELECT store_id, list(DISTINCT family) AS f FROM evidence GROUP BY 1)"
    " SELECT store_id, 'review' AS status FROM s LEFT JOIN e USING (store_id) WHERE status = 'accepted' AND NOT coalesce(list_has_all(f, ['identity', 'delivery', 'commerce']), FALSE)"
)
def refine_migration(spark: SparkSession, d: str) -> DataFrame:
    """Accepted stores that their re-checked evidence no longer carries."""
    s = dedup.current_stores(table(spark, d, "stores"), ["store_id", "status", "observed_at"])
    return refine.demoted(s, refine.refined(table(spark, d, "evidence"))).select("store_id", "status")


@query("SELECT * FROM (VALUES ('a', 'keep', TRUE), ('b', 'drop', FALSE)) AS t(candidate_id, decision, current)")
def review_current(spark: SparkSession, d: str) -> DataFrame:
    """Regression check on literals: the last review counts, and only while its evidence is unchanged."""
    r = spark.createDataFrame([(1, "a", "drop", "h1"), (2, "a", "keep", "h2"), (3, "b", "drop", "h1")], "id int, candidate_id string, decision string, evidence_hash string")
    return logs.current_reviews(r, spark.createDataFrame([("a", "h2"), ("b", "h9")], "candidate_id string, evidence_hash string"))


@query("SELECT * FROM (VALUES ('Organization', 'https://a.in/', 'a@a.in|c@a.in', '1', 'https://a.in/l.png'), ('Thing|Store', NULL, 'b@a.in', '', NULL), ('ContactPoint', NULL, 'c@a.in', '1', NULL)) AS t(types, url, emails, telephones, logo)")
def ldjson_walk(spark: SparkSession, d: str) -> DataFrame:
    """Regression check on a literal: objects at any depth, a malformed text beside them."""
    t = '{"@graph":[{"@type":"Organization","url":"https://a.in/","email":"a@a.in","logo":{"contentUrl":"https://a.in/l.png"},"sub":{"@type":["Thing","Store"],"email":["b@a.in",3]},"contactPoint":{"@type":"ContactPoint","email":"c@a.in","telephone":"1"}}]}'
    x = spark.createDataFrame([([t, "{bad"],)], "t array<string>").select(F.explode(ld_objects(F.col("t"))).alias("o"))
    joined = [F.array_join(f"o.{c}", "|").alias(c) for c in ("types", "emails", "telephones")]
    return x.where("size(o.types) > 0").select(*joined, "o.url", "o.logo")


@query(f"WITH {sql.NOW} SELECT id, regexp_extract(lower(url), '((?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\\.)+[a-z]{{2,}})', 1) AS domain FROM now WHERE url IS NOT NULL AND NOT regexp_matches(url, '[<>&]') AND status <> 'queued'")
def lead_table_cells(spark: SparkSession, d: str) -> DataFrame:
    """A page for each candidate that is no longer queued, with its address in a table of stores and another in a table of other
    things; the first domain of each store cell."""
    x = ledger.current_candidates(table(spark, d, "candidates")).where(F.col("url").isNotNull() & ~F.col("url").rlike("[<>&]") & (F.col("status") != "queued"))
    page = F.concat(F.lit("<table><tr><th>Store<th>Town<tr><td>"), "url", F.lit("<td>x.example</table><table><tr><th>No</th></tr><tr><td>c.example</td></tr></table>"))
    return leads.parsed_tables(x.select("id", page.alias("html")), keep=["id"]).select("id", "domain")


@query(
    f"""WITH {sql.STORE}, r AS (SELECT store_id AS candidate_id, ('0x' || left(store_id, 1))::INT AS k, shopify = 'verified' AND india = 'verified' AS ok FROM store)
SELECT candidate_id, CASE WHEN k % 4 = 3 THEN 'invalid decision' WHEN k % 4 = 0 AND NOT coalesce(ok, FALSE) THEN 'not verified both ways' END AS error FROM r
UNION ALL SELECT 'x' || candidate_id, 'no evidence was collected' FROM r WHERE k = 1"""
)
def review_checks(spark: SparkSession, d: str) -> DataFrame:
    """Reviews made up from the first digit of the store's id: which are kept and why others are refused."""
    s = dedup.current_stores(table(spark, d, "stores"), ["store_id", "shopify", "india", "observed_at"])
    good, bad = logs.checked_reviews(_reviews(s), s, table(spark, d, "evidence"))
    return good.select("candidate_id", F.lit(None).cast("string").alias("error")).unionByName(bad.select("candidate_id", "error"))


def _reviews(stores: DataFrame) -> DataFrame:
    k = F.conv(F.substring("store_id", 1, 1), 16, 10).cast("int")
    r = stores.select(k.alias("id"), F.col("store_id").alias("candidate_id"), F.get(F.array(*map(F.lit, (*logs.DECISIONS, "perhaps"))), k % 4).alias("decision"), F.lit("note").alias("note"), F.lit("r").alias("reviewer"))
    return r.unionByName(r.where("id = 1").withColumn("candidate_id", F.concat(F.lit("x"), "candidate_id")))


@query(
    f"""WITH {sql.NOW}, {sql.STORE}, {_HASHES}, ev AS (SELECT store_id, min(observed_at) AS oldest FROM evidence WHERE field IN ('shopify', 'india') GROUP BY 1),
p AS (SELECT now.id, store.store_id IS NOT NULL AS has_store, ('0x' || left(now.id, 1))::INT AS k, hashes.evidence_hash IS NOT NULL AS hashed,
  CASE WHEN now.status = 'accepted' AND (store.observed_at < TIMESTAMP '2025-12-01' - INTERVAL 90 DAY OR ev.oldest < TIMESTAMP '2025-12-01' - INTERVAL 90 DAY) THEN 'stale'
       WHEN now.status = 'accepted' AND NOT coalesce(store.shopify = 'verified' AND store.india = 'verified', FALSE) THEN 'review' ELSE now.status END AS status
  FROM now LEFT JOIN store ON store.store_id = now.id LEFT JOIN ev ON ev.store_id = now.id LEFT JOIN hashes ON hashes.candidate_id = now.id)
SELECT id, has_store AND hashed AND k < 8 AS review_current, CASE WHEN has_store AND hashed AND k < 8 AND status <> 'queued' AND k % 4 IN (1, 2) THEN CASE k % 4 WHEN 1 THEN 'excluded' ELSE 'review' END ELSE status END AS status FROM p"""
)
def review_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Statuses with reviews made up from the id's first digit: from 8 on they were made on evidence that is another now."""
    from leadloom.plans import projection

    t = {n: table(spark, d, n) for n in ("candidates", "stores", "evidence")}
    r = _reviews(ledger.current_candidates(t["candidates"]).select(F.col("id").alias("store_id"))).join(logs.evidence_hashes(t["evidence"]), "candidate_id")
    r = r.withColumn("evidence_hash", F.when(F.col("id") < 8, F.col("evidence_hash")).otherwise("old"))
    return projection.project(**t, as_of="2025-12-01 00:00:00", days=90, reviews=r).select("id", "review_current", "status")


@query(
    f"""WITH {sql.NOW}, {sql.STORE}, {_HASHES}, ev AS (SELECT store_id, min(observed_at) AS oldest FROM evidence WHERE field IN ('shopify', 'india') GROUP BY 1),
p AS (SELECT now.id, store.reason, store.store_id IS NOT NULL AND hashes.evidence_hash IS NOT NULL AND ('0x' || left(now.id, 1))::INT < 8 AS reviewed, ('0x' || left(now.id, 1))::INT % 4 AS k,
  CASE WHEN now.status = 'accepted' AND (store.observed_at < TIMESTAMP '2025-12-01' - INTERVAL 90 DAY OR ev.oldest < TIMESTAMP '2025-12-01' - INTERVAL 90 DAY) THEN 'stale'
       WHEN now.status = 'accepted' AND NOT coalesce(store.shopify = 'verified' AND store.india = 'verified', FALSE) THEN 'review' ELSE now.status END AS was
  FROM now LEFT JOIN store ON store.store_id = now.id LEFT JOIN ev ON ev.store_id = now.id LEFT JOIN hashes ON hashes.candidate_id = now.id),
q AS (SELECT *, CASE WHEN reviewed AND was <> 'queued' AND k = 1 THEN 'excluded' WHEN reviewed AND was <> 'queued' AND k = 2 THEN 'review' ELSE was END AS status FROM p)
SELECT id, status, CASE status WHEN 'stale' THEN 'Evidence is older than the freshness window.' WHEN 'queued' THEN 'Queued for collection.'
  ELSE CASE WHEN reviewed AND status IN ('excluded', 'review') THEN 'Review: note' ELSE coalesce(nullif(reason, ''), 'Not collected') END END AS reason FROM q WHERE status <> 'accepted'"""
)
def unresolved(spark: SparkSession, d: str) -> DataFrame:
    """Why each candidate that is not accepted is not, reviews (as in review_overrides) included."""
    from leadloom.plans import projection

    t = {n: table(spark, d, n) for n in ("candidates", "stores", "evidence")}
    r = _reviews(ledger.current_candidates(t["candidates"]).select(F.col("id").alias("store_id"))).join(logs.evidence_hashes(t["evidence"]), "candidate_id")
    r = r.withColumn("evidence_hash", F.when(F.col("id") < 8, F.col("evidence_hash")).otherwise("old"))
    return projection.rejections(projection.project(**t, as_of="2025-12-01 00:00:00", days=90, reviews=r))


@query("WITH e AS (SELECT store_id, count(*) AS n FROM (SELECT DISTINCT * FROM evidence) GROUP BY 1) SELECT c.id, coalesce(e.n, 0) AS evidence_count FROM (SELECT DISTINCT id FROM candidates) c LEFT JOIN e ON e.store_id = c.id")
def evidence_count(spark: SparkSession, d: str) -> DataFrame:
    from leadloom.plans import projection

    return projection.project(*(table(spark, d, n) for n in ("candidates", "stores", "evidence")), as_of="2025-12-01").select("id", "evidence_count")


_BLOCKS = [
    ("s", "https://a.in/contact", "Registered office: 4 Hill Road, Arkanadu 560001", 4),
    ("s", "https://a.in/contact", "Corporate office: 9 Lake Street, Girivana 560002", 3),
    ("s", "https://a.in/contact", "Return address: 9 Lake Street, Girivana 560002", None),
    ("s", "https://a.in/contact", "About us. Registered office: 4 Hill Road, Arkanadu 560001. Since 1999.", None),
    ("t", "https://b.in/", "We deliver across Arkanadu 560001, Hill Road", None),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{b}', {p})" for s, _, b, p in _BLOCKS if p) + ") AS t(store_id, excerpt, priority)")
def address_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Regression check on literal blocks."""
    c = table(spark, d, "canon_values").where("kind = 'state'")
    x = spark.createDataFrame([b[:3] for b in _BLOCKS], "store_id string, page_url string, block string")
    return rules.address_candidates(x, rules.dimension(c, "canonical", "canonical")).select("store_id", "excerpt", "priority")
