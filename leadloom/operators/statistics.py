"""Statistics over candidates, stores, sources and observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import is_missing, trimmed
from leadloom.operators.dedup import OPTIONAL, completeness
from leadloom.operators.ledger import current_candidates, observed_once


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 part / whole, half to even; null where ``whole`` is 0."""
    return F.when(whole > 0, F.bround(100.0 * part / whole, digits))


def by_value(df: DataFrame, column: str, skip_missing: bool = True) -> DataFrame:
    """(value, n); null and empty values are skipped or counted as ``unknown``."""
    c = F.nullif(F.col(column), F.lit(""))
    x = df.select(c.alias("value"))
    x = x.where("value IS NOT NULL") if skip_missing else x.select(F.coalesce("value", F.lit("unknown")).alias("value"))
    return x.groupBy("value").agg(F.count("*").alias("n"))


def missingness(stores: DataFrame) -> DataFrame:
    """(field, missing, present, percent_missing) of the optional fields, in one pass."""
    total = [F.count_if(is_missing(F.col(c), k)).alias(c) for c, k in OPTIONAL.items()]
    x = stores.agg(F.count("*").alias("n"), *total)
    x = x.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("missing")) for c in OPTIONAL])).alias("x")).select("n", "x.*")
    return x.select("field", "missing", (F.col("n") - F.col("missing")).alias("present"), percent(F.col("missing"), F.col("n")).alias("percent_missing"))


def missing_reasons(stores: DataFrame, default: str = "not_found_in_allowed_pages") -> DataFrame:
    """(field, reason, n) of optional fields without content: the reason that a column ``missing`` (a map by field) gives, if
    there is one, else ``default``."""
    given = (lambda c: F.col("missing")[c]) if "missing" in stores.columns else (lambda c: F.lit(None).cast("string"))
    why = F.array_compact(F.array(*[F.when(is_missing(F.col(c), k), F.struct(F.lit(c).alias("field"), F.coalesce(given(c), F.lit(default)).alias("reason"))) for c, k in OPTIONAL.items()]))
    return stores.select(F.explode(why).alias("x")).groupBy("x.field", "x.reason").agg(F.count("*").alias("n"))


def filled_share(stores: DataFrame) -> DataFrame:
    """One row (stores, filled, percent): how many optional fields are filled, and of all there could be, in percent half up."""
    x = stores.agg(F.count("*").alias("stores"), F.coalesce(F.sum(completeness()), F.lit(0)).alias("filled"))
    return x.withColumn("percent", F.when(F.col("stores") > 0, F.floor(100.0 * F.col("filled") / (F.col("stores") * len(OPTIONAL)) + 0.5)).otherwise(0))


def coverage(stores: DataFrame) -> DataFrame:
    """(field, percent): share of stores that have the field, whole numbers, half up, 0 without stores."""
    m = missingness(stores)
    n = F.col("missing") + F.col("present")
    return m.select("field", F.when(n > 0, F.floor(100.0 * F.col("present") / n + 0.5)).otherwise(0).alias("percent"))


def by_source(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """(name, first_source_url, listed, accepted, collected) by trimmed source name.

    A candidate that a name listed under two source addresses counts twice; ``first_source_url`` is the earliest seen.
    """
    s = sources.select("candidate_id", trimmed(F.col("name")).alias("name"), "source_url", "discovered_at")
    s = s.groupBy("candidate_id", "name", "source_url").agg(F.min("discovered_at").alias("at"))
    now = current_candidates(candidates).select(F.col("id").alias("candidate_id"), "status", F.col("store_json").isNotNull().alias("has_store"))
    x = s.join(now, "candidate_id", "left")
    return x.groupBy("name").agg(
        F.min_by("source_url", F.struct("at", "source_url")).alias("first_source_url"),
        F.count("*").alias("listed"),
        F.count_if(F.col("status") == "accepted").alias("accepted"),
        F.count_if("has_store").alias("collected"),
    )


def totals(candidates: DataFrame, observations: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: candidates, accepted, requests (responses with a status, not from the cache), runs."""
    c = current_candidates(candidates).agg(F.count("*").alias("candidates"), F.count_if(F.col("status") == "accepted").alias("accepted"))
    o = observed_once(observations.select("id", "kind", "status_code")).agg(F.count_if((F.col("kind") != "cached_page") & F.col("status_code").isNotNull()).alias("requests"))
    return c.join(o).join(runs.agg(F.count_distinct("id").alias("runs")))


#: What an observation can come to.
CLASSES = ("ok", "too_large", "deferred", "transient", "refused", "no_response", "other")


def outcome_class() -> Column:
    """What an observation came to, from its outcome and status."""
    s = F.col("status_code")
    return (
        F.when(F.col("outcome").isin("ok", "too_large", "deferred"), F.col("outcome"))
        .when(F.col("outcome").isin("fetch_failed") | s.isin(429, 500, 502, 503, 504), "transient")
        .when(s.between(400, 499), "refused")
        .when(s.isNull(), "no_response")
        .otherwise("other")
    )


def outcome_pivot(observations: DataFrame) -> DataFrame:
    """(kind, and a column for each of CLASSES): observations counted once."""
    o = observed_once(observations.select("id", "kind", "outcome", "status_code")).withColumn("class", outcome_class())
    return o.groupBy("kind").pivot("class", list(CLASSES)).agg(F.count(F.lit(1))).fillna(0)


def transitions(run_items: DataFrame, runs: DataFrame) -> DataFrame:
    """(before, after, n): status of a candidate in one processed item and in its next, over runs in order of their start.

    One row a candidate and run; the order is found by a sort within each candidate's array, whose size is its runs.
    """
    x = run_items.where("status = 'done' AND error IS NULL").select("run_id", "candidate_id", F.get_json_object("result_json", "$.status").alias("status"))
    x = x.distinct().join(runs.groupBy(F.col("id").alias("run_id")).agg(F.max("started_at").alias("started_at")), "run_id")
    a = x.groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct("started_at", "run_id", "status"))).alias("a"))
    pairs = F.when(F.size("a") > 1, F.transform(F.sequence(F.lit(0), F.size("a") - 2), lambda i: F.struct(F.col("a")[i]["status"].alias("before"), F.col("a")[i + 1]["status"].alias("after"))))
    return a.select(F.explode(pairs).alias("p")).groupBy("p.before", "p.after").agg(F.count("*").alias("n"))


def evidence_families(evidence: DataFrame, needed: tuple[str, ...] = ("identity", "delivery", "commerce")) -> DataFrame:
    """(store_id, families, lacking): the families of a store's evidence, sorted, and which of ``needed`` it lacks."""
    x = evidence.where("store_id IS NOT NULL").groupBy("store_id").agg(F.array_sort(F.collect_set(F.nullif("family", F.lit("")))).alias("families"))
    return x.withColumn("lacking", F.array_sort(F.array_except(F.array(*map(F.lit, needed)), "families")))
