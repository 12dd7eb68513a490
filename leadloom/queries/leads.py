"""Queries over candidates, sources, runs and observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import urls
from leadloom.operators import fetchlog, ledger, statistics
from leadloom.queries import sql
from leadloom.sources import leads as sources
from leadloom.session import cut, new_folder, table

AS_OF = "2025-12-31 00:00:00"
QUERIES, SQL = {}, {}


def query(text: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add


def _addresses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidates").select("id", "url").distinct()


_U = sql.trim("url")
_NORMAL = rf"""
WITH a AS (SELECT DISTINCT id, {_U} AS u FROM candidates),
b AS (SELECT id, CASE WHEN regexp_matches(u, '^[A-Za-z]+://') THEN u ELSE 'https://' || u END AS u FROM a),
c AS (SELECT id, lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(u, '^[A-Za-z]+://([^/?#]*)', 1)) AS auth,
  regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '^[^?#]*\?([^#]*)', 1) AS query FROM b),
e AS (SELECT *, regexp_replace(regexp_replace(auth, ':[0-9]*$', ''), '\.+$', '') AS host, regexp_extract(auth, ':([0-9]+)$', 1) AS port,
  array_to_string(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(lower(split_part(p, '=', 1)), '^(utm_.*|fbclid|gclid|msclkid)$')), '&') AS kept FROM c),
normal AS (SELECT id, host, scheme || '://' || host || CASE WHEN port = '' OR (scheme = 'https' AND port = '443') OR (scheme = 'http' AND port = '80') THEN '' ELSE ':' || port END AS origin,
  CASE WHEN path = '' THEN '/' ELSE path END AS path, CASE WHEN kept = '' THEN '' ELSE '?' || kept END AS query FROM e)
"""


@query(_NORMAL + "SELECT id, origin || path || query AS url FROM normal")
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    return urls.with_normalized(_addresses(spark, d), "url", "n").select("id", F.col("n").alias("url"))


@query(_NORMAL + "SELECT id, substr(sha256(origin || '/'), 1, 16) AS home_id, origin || '/' AS home FROM normal")
def url_candidate_id(spark: SparkSession, d: str) -> DataFrame:
    x = urls.with_normalized(_addresses(spark, d), "url", "home", homepage=True)
    return x.select("id", urls.candidate_id(F.col("home")).alias("home_id"), "home")


@query(_NORMAL + r"SELECT id, origin, regexp_replace(host, '^www\.', '') AS label FROM normal")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    x = urls.with_normalized(_addresses(spark, d), "url", "u")
    return x.select("id", urls.origin(F.col("u")).alias("origin"), urls.host_label(F.col("u")).alias("label"))


@query()
def url_ascii(spark: SparkSession, d: str) -> DataFrame:
    """Hosts with international names in the form of the name system; no SQL function does that."""
    x = _addresses(spark, d).select("id", urls.host_of(F.col("url")).alias("host")).where(F.col("host").rlike(r"[^\x00-\x7f]"))
    return x.select("id", "host", urls.to_ascii(F.col("host")).alias("ascii"))


@query(f"SELECT site, count(*) AS candidates FROM (SELECT DISTINCT id, {sql.site('url')} AS site FROM candidates) WHERE site IS NOT NULL GROUP BY site")
def site_group(spark: SparkSession, d: str) -> DataFrame:
    known = urls.KnownHosts.read(table(spark, d, "known_hosts"))
    x = cut(known.with_site(_addresses(spark, d), "url").select("id", "site"))  # else the filter's push-down would nest the steps
    return x.groupBy("site").agg(F.count("*").alias("candidates")).where("site IS NOT NULL")


@query(f"WITH {sql.STORE} SELECT store_id, CASE {sql.site('domain_url')} = {sql.site('shop_identity')} WHEN TRUE THEN 'same' WHEN FALSE THEN 'other' ELSE 'unknown' END AS relation FROM store")
def same_site(spark: SparkSession, d: str) -> DataFrame:
    from leadloom.operators.dedup import current_stores

    known = urls.KnownHosts.read(table(spark, d, "known_hosts"))
    x = current_stores(table(spark, d, "stores"), ["store_id", "domain_url", "shop_identity", "observed_at"])
    x = known.with_site(known.with_site(x, "domain_url", "a_"), "shop_identity", "b_")
    return x.select("store_id", F.when(F.col("a_site") == F.col("b_site"), "same").when(F.col("a_site") != F.col("b_site"), "other").otherwise("unknown").alias("relation"))


@query(
    _NORMAL.replace("SELECT DISTINCT id, ", "SELECT id, created_at, ").replace("SELECT id, CASE WHEN reg", "SELECT id, created_at, CASE WHEN reg").replace("(SELECT id, lower", "(SELECT id, created_at, lower").replace("normal AS (SELECT id,", "normal AS (SELECT id, created_at,")
    + ", good AS (SELECT origin || '/' AS url, created_at FROM normal), old AS (SELECT DISTINCT url FROM good WHERE created_at < TIMESTAMP '2025-07-01'), new AS (SELECT url FROM good WHERE created_at >= TIMESTAMP '2025-07-01')"
    ", bad AS (SELECT count(*) AS n FROM candidates WHERE created_at >= TIMESTAMP '2025-07-01' AND right(id, 1) = '7')"
    " SELECT count(DISTINCT url) FILTER (WHERE url NOT IN (FROM old)) AS added, count(*) - count(DISTINCT url) FILTER (WHERE url NOT IN (FROM old)) AS duplicates, any_value(bad.n) AS errors FROM new, bad"
)
def import_counts(spark: SparkSession, d: str) -> DataFrame:
    """The second half of the year imported into the first, and once more without a source those whose id ends in 7: errors."""
    x = table(spark, d, "candidates").select("url", "created_at", F.lit("export").alias("source"), F.lit("https://lists.example/").alias("source_url"))
    half = F.col("created_at") >= F.lit("2025-07-01").cast("timestamp_ntz")
    empty = spark.createDataFrame([], "id string")
    old, _, _ = ledger.import_leads(x.where(~half), empty)
    bad = table(spark, d, "candidates").where(half & (F.substring("id", -1, 1) == "7")).select("url", "created_at", F.lit(" ").alias("source"), F.lit("https://lists.example/").alias("source_url"))
    return ledger.import_leads(x.where(half).unionByName(bad), old)[2]


@query(f"SELECT candidate_id, substr({sql.trim('name')}, 1, 200) AS name, substr({sql.trim('source_url')}, 1, 2000) AS source_url, min(discovered_at) AS discovered_at FROM sources GROUP BY ALL")
def import_attribution(spark: SparkSession, d: str) -> DataFrame:
    return ledger.attributions(table(spark, d, "sources"))


@query(_NORMAL + "SELECT origin || '/' AS url, min(id) AS id FROM normal WHERE origin IS NOT NULL GROUP BY 1")
def url_keep_first(spark: SparkSession, d: str) -> DataFrame:
    """The addresses as a list of lines: home pages, each once, with the first line that has it."""
    return sources.parsed_lines(_addresses(spark, d), "id", "url")


@query("SELECT coalesce(url, '') AS urlkey, status_code::VARCHAR AS status, count(*) AS n FROM observations WHERE kind = 'discovery' GROUP BY ALL")
def jsonl_leads(spark: SparkSession, d: str) -> DataFrame:
    """Discovery rows written to the shared folder as JSON lines, with blank lines between, and read again as an index file."""
    x = table(spark, d, "observations").where("kind = 'discovery'").select(F.coalesce("url", F.lit("")).alias("urlkey"), "url", F.col("status_code").cast("string").alias("status"))
    folder = new_folder(spark, "cdx")
    x.select(F.concat(F.to_json(F.struct("urlkey", "url", "status")), F.lit("\n")).alias("value")).write.text(folder)
    return sources.read_cdx_lines(spark, folder, (1 << 31) - 1).groupBy("urlkey", "status").agg(F.count("*").alias("n"))


@query(f"WITH {sql.NOW} SELECT id, url FROM now ORDER BY created_at, id LIMIT 300 OFFSET 100")
def lead_slice(spark: SparkSession, d: str) -> DataFrame:
    """A page of the leads in order of arrival: what the operator is for."""
    return sources.lead_slice(ledger.current_candidates(table(spark, d, "candidates")), 100, 300, "created_at", "id").select("id", "url")


@query(f"WITH {sql.NOW}, u AS (SELECT DISTINCT url FROM now WHERE url IS NOT NULL) SELECT 'export' AS source, 100 AS offset, 300 AS limit, count(*) AS available, least(300, greatest(0, (SELECT count(*) FROM now) - 100)) AS selected FROM u")
def slice_manifest(spark: SparkSession, d: str) -> DataFrame:
    x = ledger.current_candidates(table(spark, d, "candidates"))
    page = sources.lead_slice(x, 100, 300, "created_at", "id")
    return sources.slice_manifest(x.where("url IS NOT NULL"), page, "export", 100, 300).drop("content_hash")


@query(
    f"WITH {sql.SEEN}, x AS (SELECT url AS urlkey, strftime(observed_at, '%Y%m%d%H%M%S') AS timestamp, coalesce(final_url, url) AS url FROM seen WHERE status_code = 200 AND url IS NOT NULL AND observed_at IS NOT NULL),"
    " f AS (SELECT urlkey, min(timestamp) AS timestamp, arg_min(url, (timestamp, url)) AS url FROM x GROUP BY 1) SELECT * FROM f ORDER BY urlkey LIMIT 200"
)
def cdx_collapse(spark: SparkSession, d: str) -> DataFrame:
    """The first capture of each address, as an index lookup gives it: at most 200, which is the lookup's limit."""
    x = ledger.observed_once(table(spark, d, "observations")).where("url IS NOT NULL AND observed_at IS NOT NULL")
    rows = x.select(F.col("url").alias("urlkey"), F.date_format("observed_at", "yyyyMMddHHmmss").alias("timestamp"), F.coalesce("final_url", "url").alias("url"), F.col("status_code").cast("string").alias("status"))
    return sources.collapsed(rows, 1000)


@query(f"WITH {sql.NOW} SELECT id, url, created_at FROM now WHERE status = 'queued'")
def queue_collect(spark: SparkSession, d: str) -> DataFrame:
    return ledger.work_list(table(spark, d, "candidates"), F.col("status") == "queued")


@query(f"WITH {sql.NOW} SELECT id, url, created_at FROM now WHERE store_json IS NOT NULL")
def queue_replay(spark: SparkSession, d: str) -> DataFrame:
    return ledger.work_list(table(spark, d, "candidates"), F.col("store_json").isNotNull())


@query(f"WITH {sql.NOW} SELECT id, url, created_at FROM now WHERE json_extract_string(store_json, '$.rule_version') IN ('2025.3.1', '2025.3.2')")
def queue_refine(spark: SparkSession, d: str) -> DataFrame:
    return ledger.work_list(table(spark, d, "candidates"), F.get_json_object("store_json", "$.rule_version").isin("2025.3.1", "2025.3.2"))


@query(
    f"WITH {sql.NOW} SELECT id, url FROM now WHERE (status = 'unreachable' OR (status = 'review' AND json_extract_string(store_json, '$.shopify') = 'verified'))"
    " AND id NOT IN (SELECT i.candidate_id FROM run_items i JOIN runs r ON r.id = i.run_id WHERE json_extract_string(r.config, '$.operation') = 'enrich' AND i.candidate_id IS NOT NULL)"
)
def queue_enrich(spark: SparkSession, d: str) -> DataFrame:
    due = (F.col("status") == "unreachable") | ((F.col("status") == "review") & (F.get_json_object("store_json", "$.shopify") == "verified"))
    return ledger.never_in("enrich", table(spark, d, "candidates"), table(spark, d, "run_items"), table(spark, d, "runs"), due)


@query(
    "SELECT DISTINCT i.run_id, i.candidate_id FROM run_items i JOIN runs r ON r.id = i.run_id WHERE r.status IN ('interrupted', 'cancelled', 'failed') AND json_extract_string(r.config, '$.operation') <> 'refine'"
    " AND i.status <> 'done' AND NOT EXISTS (SELECT 1 FROM run_items j WHERE j.run_id = i.run_id AND j.candidate_id = i.candidate_id AND j.status = 'done')"
)
def queue_resume(spark: SparkSession, d: str) -> DataFrame:
    return ledger.unfinished(table(spark, d, "run_items"), table(spark, d, "runs"))


@query(
    f"""WITH {sql.SEEN} SELECT r.id, r.status, json_extract_string(r.config, '$.operation') AS operation,
  (SELECT count(DISTINCT candidate_id) FROM run_items i WHERE i.run_id = r.id) AS total,
  (SELECT count(DISTINCT candidate_id) FROM run_items i WHERE i.run_id = r.id AND i.status = 'done') AS done,
  (SELECT count(*) FROM seen o WHERE o.run_id = r.id AND kind <> 'cached_page' AND status_code IS NOT NULL) AS responses,
  (SELECT coalesce(sum(bytes), 0)::BIGINT FROM seen o WHERE o.run_id = r.id) AS bytes,
  greatest(0, round(epoch_us(coalesce(r.finished_at, TIMESTAMP '{AS_OF}') - r.started_at) / 1e6))::BIGINT AS seconds FROM runs r"""
)
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return ledger.run_summary(table(spark, d, "runs"), table(spark, d, "run_items"), table(spark, d, "observations"), AS_OF)


@query(f"SELECT id, coalesce(heartbeat, started_at) AS heartbeat FROM runs WHERE finished_at IS NULL AND date_diff('second', coalesce(heartbeat, started_at), TIMESTAMP '{AS_OF}') > 120")
def stale_runs(spark: SparkSession, d: str) -> DataFrame:
    return ledger.stale_runs(table(spark, d, "runs"), AS_OF)


@query(f"WITH {sql.SEEN} SELECT candidate_id, max(id) AS id, arg_max(run_id, id) AS run_id, arg_max(observed_at, id) AS observed_at FROM seen WHERE kind IN ('page', 'cached_page') AND outcome = 'ok' AND candidate_id IS NOT NULL GROUP BY 1")
def latest_page_run(spark: SparkSession, d: str) -> DataFrame:
    return ledger.latest_page_run(table(spark, d, "observations"))


@query(
    f"WITH {sql.SEEN} SELECT candidate_id, final_url, id, run_id, content_hash, observed_at FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id, final_url ORDER BY id) AS rn FROM seen"
    " WHERE kind IN ('page', 'cached_page') AND outcome = 'ok' AND final_url IS NOT NULL) WHERE rn = 1"
)
def cached_pages(spark: SparkSession, d: str) -> DataFrame:
    return ledger.saved_pages(table(spark, d, "observations"))


@query(
    f"""WITH {sql.SEEN}, ok AS (SELECT * FROM seen WHERE kind IN ('page', 'cached_page') AND outcome = 'ok'), last AS (SELECT candidate_id, arg_max(run_id, id) AS run_id FROM ok WHERE candidate_id IS NOT NULL GROUP BY 1)
SELECT 'next' AS run_id, candidate_id, final_url, 'cached_page' AS kind, 'ok' AS outcome, id AS copied_from, content_hash, observed_at
FROM (SELECT ok.*, row_number() OVER (PARTITION BY candidate_id, final_url ORDER BY id) AS rn FROM ok JOIN last USING (candidate_id, run_id) WHERE final_url IS NOT NULL) WHERE rn = 1"""
)
def reused_pages(spark: SparkSession, d: str) -> DataFrame:
    """What a run that works on saved pages adds to the log."""
    return ledger.reused_pages(table(spark, d, "observations"), "next")


@query(
    f"""WITH {sql.NOW}, s AS (SELECT candidate_id, substr({sql.trim('name')}, 1, 200) AS name, substr({sql.trim('source_url')}, 1, 2000) AS source_url, min(discovered_at) AS first_at FROM sources GROUP BY ALL)
SELECT id, url, count(s.candidate_id) AS n, coalesce(string_agg(name, '|' ORDER BY first_at, name, source_url), '') AS names FROM now LEFT JOIN s ON s.candidate_id = now.id GROUP BY id, url"""
)
def candidate_nest(spark: SparkSession, d: str) -> DataFrame:
    x = ledger.nested_sources(table(spark, d, "candidates"), table(spark, d, "sources"))
    return x.select("id", "url", F.size("sources").cast("bigint").alias("n"), F.array_join(F.transform("sources", lambda s: s["name"]), "|").alias("names"))


@query(f"WITH {sql.SEEN} SELECT id, candidate_id, kind, outcome, observed_at FROM seen ORDER BY id DESC LIMIT 100")
def detail_top100(spark: SparkSession, d: str) -> DataFrame:
    return ledger.observed_once(table(spark, d, "observations")).orderBy(F.desc("id")).limit(100).select("id", "candidate_id", "kind", "outcome", "observed_at")


@query(f"WITH {sql.NOW} SELECT status, count(*) AS n FROM now GROUP BY 1")
def stat_status(spark: SparkSession, d: str) -> DataFrame:
    return ledger.current_candidates(table(spark, d, "candidates")).groupBy("status").agg(F.count("*").alias("n"))


@query(
    f"""WITH {sql.NOW}, s AS (SELECT candidate_id, {sql.trim('name')} AS name, source_url, min(discovered_at) AS first_at FROM sources GROUP BY ALL)
SELECT name, arg_min(source_url, (first_at, source_url)) AS first_source_url, count(*) AS listed, count(*) FILTER (WHERE status = 'accepted') AS accepted, count(*) FILTER (WHERE store_json IS NOT NULL) AS collected
FROM s LEFT JOIN now ON now.id = s.candidate_id GROUP BY name"""
)
def stat_sources(spark: SparkSession, d: str) -> DataFrame:
    return statistics.by_source(table(spark, d, "candidates"), table(spark, d, "sources"))


@query(
    f"""WITH {sql.NOW}, {sql.SEEN} SELECT (SELECT count(*) FROM now) AS candidates, (SELECT count(*) FROM now WHERE status = 'accepted') AS accepted,
  (SELECT count(*) FROM seen WHERE kind <> 'cached_page' AND status_code IS NOT NULL) AS requests, (SELECT count(DISTINCT id) FROM runs) AS runs"""
)
def stat_totals(spark: SparkSession, d: str) -> DataFrame:
    return statistics.totals(table(spark, d, "candidates"), table(spark, d, "observations"), table(spark, d, "runs"))


_CLASS = "CASE WHEN outcome IN ('ok', 'too_large', 'deferred') THEN outcome WHEN outcome = 'fetch_failed' OR status_code IN (429, 500, 502, 503, 504) THEN 'transient' WHEN status_code BETWEEN 400 AND 499 THEN 'refused' WHEN status_code IS NULL THEN 'no_response' ELSE 'other' END"


@query(f"WITH {sql.SEEN}, c AS (SELECT kind, {_CLASS} AS class FROM seen) SELECT kind, " + ", ".join(f"count(*) FILTER (WHERE class = '{c}') AS {c}" for c in statistics.CLASSES) + " FROM c GROUP BY kind")
def status_pivot(spark: SparkSession, d: str) -> DataFrame:
    return statistics.outcome_pivot(table(spark, d, "observations"))


@query(
    """WITH x AS (SELECT DISTINCT i.candidate_id, r.started_at, i.run_id, json_extract_string(i.result_json, '$.status') AS status FROM run_items i JOIN runs r ON r.id = i.run_id WHERE i.status = 'done' AND i.error IS NULL),
y AS (SELECT status AS before, lead(status) OVER w AS after, row_number() OVER w AS rn, count(*) OVER (PARTITION BY candidate_id) AS n FROM x WINDOW w AS (PARTITION BY candidate_id ORDER BY started_at, run_id))
SELECT before, after, count(*) AS n FROM y WHERE rn < n GROUP BY 1, 2"""
)
def transition_pivot(spark: SparkSession, d: str) -> DataFrame:
    return statistics.transitions(table(spark, d, "run_items"), table(spark, d, "runs"))


@query(
    f"""WITH {sql.SEEN}, o AS (SELECT id, {sql.host('url')} AS host, observed_at FROM seen WHERE kind <> 'cached_page'),
p AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY observed_at, id) AS k FROM o WHERE host IS NOT NULL AND observed_at IS NOT NULL),
q AS (SELECT *, max(epoch_us(observed_at) - k * 2000000) OVER (PARTITION BY host ORDER BY k) + k * 2000000 AS start_us FROM p)
SELECT host, count(*) AS requests, max(start_us - epoch_us(observed_at)) AS most_wait_us, max(start_us) AS last_start_us FROM q GROUP BY host"""
)
def host_schedule(spark: SparkSession, d: str) -> DataFrame:
    """When each host's requests could start at two seconds apart, summed up by host."""
    x = ledger.observed_once(table(spark, d, "observations")).where("kind <> 'cached_page'")
    x = x.select("id", urls.host_of(F.col("url")).alias("host"), "observed_at")
    s = fetchlog.paced(x, "host", "observed_at", "id", 2.0)
    return s.groupBy("host").agg(F.count("*").alias("requests"), F.max(F.col("start_us") - F.col("asked_us")).alias("most_wait_us"), F.max("start_us").alias("last_start_us"))


@query(
    """WITH RECURSIVE e AS (SELECT url, min(final_url) AS location FROM observations WHERE url <> final_url GROUP BY url),
w AS (SELECT url, location AS spot, [url] AS path, 1 AS hops, NULL::VARCHAR AS outcome FROM e
  UNION ALL SELECT w.url, CASE WHEN o IS NULL THEN e.location ELSE w.spot END, CASE WHEN o IS NULL THEN list_append(w.path, w.spot) ELSE w.path END, w.hops + (o IS NULL)::INT, o
  FROM w LEFT JOIN e ON e.url = w.spot, LATERAL (SELECT CASE WHEN list_contains(w.path, w.spot) THEN 'loop' WHEN e.location IS NULL THEN 'end' WHEN w.hops >= 5 THEN 'limit' END AS o) WHERE w.outcome IS NULL)
SELECT url, spot AS final_url, hops::INT AS hops, outcome FROM w WHERE outcome IS NOT NULL"""
)
def redirect_chain(spark: SparkSession, d: str) -> DataFrame:
    """Where the addresses that ever led elsewhere lead to, following up to five hops."""
    x = table(spark, d, "observations").where("url IS NOT NULL AND final_url IS NOT NULL AND url <> final_url").select("url", "final_url").distinct()
    edges = x.groupBy("url").agg(F.min("final_url").alias("location"))
    return fetchlog.redirects(edges)


@query(
    f"""WITH {sql.SEEN}, f AS (SELECT *, {_CLASS} AS class FROM seen),
t AS (SELECT run_id, candidate_id, url, class, row_number() OVER (PARTITION BY run_id, candidate_id, url ORDER BY id) AS attempt FROM f)
SELECT run_id, candidate_id, url, attempt, pow(2, attempt)::BIGINT AS wait_s, attempt <= 2 AND pow(2, attempt) <= 30 AS again FROM t WHERE class = 'transient'"""
)
def retry_plan(spark: SparkSession, d: str) -> DataFrame:
    return fetchlog.retries(ledger.observed_once(table(spark, d, "observations")))
