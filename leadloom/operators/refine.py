"""Re-checking stored evidence under newer rules, without fetching: idempotent, it only ever drops or demotes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.functions import contacts, rules


#: A value that is the address of a file (values can also be an identity).
ASSET = r"^(?:(?:https?:)?//[^/]+)?/[^/].*\.[a-z0-9]+(?:[?#]|$)"


def refined(evidence: DataFrame) -> DataFrame:
    """Evidence that still holds: e-mails and phones that are valid, and of files that speak for delivery only runtime assets.

    Rules apply to the values of their own fields; everything else is kept as it is. refined(refined(x)) = refined(x).
    """
    f, v = F.col("field"), F.col("value")
    holds = (
        F.when(f == "emails", contacts.valid_email(F.lower(F.trim(v))))
        .when(f == "phones", contacts.phone(v).isNotNull())
        .when((f == "shopify") & (F.col("family") == "delivery") & v.rlike(ASSET), rules.runtime_asset(v))
        .otherwise(F.lit(True))
    )
    return evidence.where(F.coalesce(holds, F.lit(True)))


def uncontradicted(evidence: DataFrame, parsed: DataFrame) -> DataFrame:
    """``evidence`` without addresses of mail links (rule ``mailto_link``) that their page shows otherwise: where a link shows an
    address, that is the one it means. ``parsed``: pages as in plans.storefront. Idempotent."""
    a = parsed.select("store_id", F.col("url").alias("source_url"), F.explode("page.anchors").alias("a")).where(F.col("a.href").rlike("^(?i)mailto:"))
    shown = contacts.emails_in(F.col("a.text"))
    meant = contacts.emails_in(F.regexp_replace(F.regexp_replace("a.href", "^(?i)mailto:|[?].*$", ""), "(?i)%40", "@"))
    said = a.select("store_id", "source_url", F.explode(shown).alias("value")).distinct()
    bad = a.where(F.size(shown) > 0).select("store_id", "source_url", F.explode(F.array_except(meant, shown)).alias("value")).distinct().join(said, ["store_id", "source_url", "value"], "left_anti")
    bad = bad.withColumns({"field": F.lit("emails"), "rule": F.lit("mailto_link")})
    return evidence.join(bad, ["store_id", "source_url", "value", "field", "rule"], "left_anti").select(*evidence.columns)


def eligible_logos(stores: DataFrame, candidates: DataFrame) -> DataFrame:
    """``stores`` without a ``logo_url`` that is none of their ``candidates`` (store_id, src). Idempotent."""
    fit = candidates.select("store_id", F.col("src").alias("logo_url")).distinct().withColumn("_fit", F.lit(True))
    x = stores.join(fit, ["store_id", "logo_url"], "left")
    return x.withColumn("logo_url", F.when(F.col("_fit"), F.col("logo_url"))).select(*stores.columns)


def demoted(stores: DataFrame, evidence: DataFrame, needed: tuple[str, ...] = ("identity", "delivery", "commerce")) -> DataFrame:
    """(store_id, status, reason): accepted stores whose evidence no longer has all ``needed`` families go to review."""
    have = evidence.groupBy("store_id").agg(F.collect_set("family").alias("families"))
    x = stores.join(have, "store_id", "left")
    lacks = F.size(F.array_except(F.array(*map(F.lit, needed)), F.coalesce("families", F.array().cast("array<string>")))) > 0
    return x.where((F.col("status") == "accepted") & lacks).select("store_id", F.lit("review").alias("status"), F.lit("platform unconfirmed").alias("reason"))
