"""The projection that every reader shares: candidates with their current store and effective status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.operators.dedup import current_stores
from leadloom.operators.incremental import distinct_rows_by
from leadloom.operators.ledger import current_candidates
from leadloom.operators.logs import current_reviews, evidence_hashes, first_reason

#: Evidence that an accepted store has to keep fresh.
REQUIRED = ("shopify", "india")


def project(candidates: DataFrame, stores: DataFrame, evidence: DataFrame, as_of: str, days: int = 7, reviews: DataFrame | None = None) -> DataFrame:
    """Candidates (id, url, created_at) with has_store, evidence_count, store columns and the effective status at ``as_of``.

    An accepted candidate is stale if its store or any required evidence is older than ``days``, else in review if it is not
    verified both ways. The last of ``reviews`` (id, candidate_id, decision, evidence_hash), if given, then overrides with
    excluded or needs_review, as long as the store's evidence is what it was made on (``review_current``). Dedup and every filter come after this, since filtering before would change winners.
    """
    now = current_candidates(candidates)
    s = current_stores(stores).drop("status")
    e = evidence.where(F.col("field").isin(*REQUIRED)).groupBy("store_id").agg(F.min("observed_at").alias("oldest"))
    e = distinct_rows_by(evidence, "store_id", "evidence_count").join(e, "store_id", "left")
    x = now.join(s, now["id"] == s["store_id"], "left").join(e.withColumnRenamed("store_id", "_e"), now["id"] == F.col("_e"), "left")
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")
    stale = F.coalesce(F.col("observed_at") < cutoff, F.lit(False)) | F.coalesce(F.col("oldest") < cutoff, F.lit(False))
    verified = F.coalesce((F.col("shopify") == "verified") & (F.col("india") == "verified"), F.lit(False))
    status = F.when((F.col("status") == "accepted") & stale, "stale").when((F.col("status") == "accepted") & ~verified, "review").otherwise(F.col("status"))
    x = x.withColumns({"status": status, "has_store": F.col("store_id").isNotNull(), "evidence_count": F.coalesce("evidence_count", F.lit(0))})
    if reviews is not None:
        noted = ["note"] if "note" in reviews.columns else []
        r = current_reviews(reviews, evidence_hashes(evidence), *noted).select(F.col("candidate_id").alias("_r"), "decision", F.col("current").alias("review_current"), *noted)
        x = x.join(r, x["id"] == F.col("_r"), "left").withColumn("review_current", F.coalesce("review_current", F.lit(False)) & F.col("has_store"))
        held = F.col("review_current") & (F.col("status") != "queued")
        x = x.withColumn("status", F.when(held & (F.col("decision") == "excluded"), "excluded").when(held & (F.col("decision") == "needs_review"), "review").otherwise(F.col("status"))).drop("_r", "decision")
    return x.drop("_e", "oldest", "store_json", "updated_at")


def rejections(projected: DataFrame) -> DataFrame:
    """(id, status, reason) of projected candidates that are not accepted: a duplicate and of what, stale, queued, the note of a
    current review, what its store says, or that it was not collected. Columns ``duplicate_of``, ``note`` and ``review_current`` count
    where they are there."""
    have = lambda c, kind="string": F.col(c) if c in projected.columns else F.lit(None).cast(kind)
    s, noted = F.col("status"), F.coalesce(have("review_current", "boolean"), F.lit(False))
    why = first_reason(
        (have("duplicate_of").isNotNull(), F.concat(F.lit("Duplicate of accepted store "), have("duplicate_of"), F.lit("."))),
        (s == "stale", F.lit("Evidence is older than the freshness window.")),
        (s == "queued", F.lit("Queued for collection.")),
        (noted & s.isin("excluded", "review"), F.concat(F.lit("Review: "), F.coalesce(have("note"), F.lit("")))),
        (F.lit(True), have("reason")),
        (F.lit(True), F.lit("Not collected")),
    )
    return projected.where(s != "accepted").select("id", "status", why.alias("reason"))


def last_sightings(evidence: DataFrame) -> DataFrame:
    """One row for each (store_id, field, value, source_url, rule, excerpt), with the other columns of its last sighting."""
    key = ["store_id", "field", "value", "source_url", "rule", "excerpt"]
    best = F.max(F.struct("observed_at", "content_hash", "family")).alias("b")
    return evidence.groupBy(*key).agg(best).select(*key, "b.observed_at", "b.content_hash", "b.family")


def strict_winner(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, tied): the most frequent non-null value of each key, null where several tie."""
    n = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    top = n.groupBy(key).agg(F.max("n").alias("top"))
    x = n.join(top, key).where("n = top").groupBy(key).agg(F.min(value).alias("first"), F.count("*").alias("tied"))
    return x.select(key, F.when(F.col("tied") == 1, F.col("first")).alias(value), "tied")
