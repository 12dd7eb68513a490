"""Integrity checks; each returns its violations, all together (code, store_id, field)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.functions.contacts import valid_email, with_social
from leadloom.functions.rules import runtime_asset
from leadloom.functions.text import is_missing
from leadloom.operators.dedup import OPTIONAL
from leadloom.session import cut


def repeated(df: DataFrame, column: str) -> DataFrame:
    """(value, n): values that more than one row has."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).where("n > 1")


def store_violations(stores: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """(code, store_id, field) over accepted current ``stores``: each rule in one branch, all branches over one join. ``field`` is
    that of ``unsupported_field`` (filled, but without evidence), else null."""
    e = evidence.groupBy("store_id").agg(
        F.collect_set("field").alias("fields"),
        F.collect_set("family").alias("families"),
        F.bool_or(F.coalesce((F.col("field") == "shopify") & (F.col("family") == "delivery") & runtime_asset(F.col("value")), F.lit(False))).alias("delivered"),
        F.bool_or(F.coalesce(F.col("source_url") == "", F.lit(True)) | F.col("observed_at").isNull() | ~F.coalesce(F.col("content_hash").rlike("^[0-9a-f]{64}$"), F.lit(False))).alias("unattributed"),
    )
    s = sources.select(F.col("candidate_id").alias("store_id")).distinct().withColumn("named", F.lit(True))
    x = stores.join(e, "store_id", "left").join(s, "store_id", "left")
    none = F.array().cast("array<string>")
    fields, families = F.coalesce("fields", none), F.coalesce("families", none)
    lacks = lambda have, *names: F.size(F.array_except(F.array(*map(F.lit, names)), have)) > 0
    rules = {
        "unverified": ~(F.coalesce((F.col("shopify") == "verified") & (F.col("india") == "verified"), F.lit(False))),
        "required_evidence": lacks(fields, "shopify", "india"),
        "families": lacks(families, "identity", "delivery", "commerce"),
        "attribution": F.col("named").isNull(),
        "email": F.exists(F.coalesce("emails", none), lambda a: ~F.coalesce(valid_email(a), F.lit(False))),
        "provenance": F.coalesce("unattributed", F.lit(False)),
        "runtime": ~F.coalesce("delivered", F.lit(False)),
        "missing_identity": is_missing(F.col("shop_identity"), "string"),
    }
    codes = F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules.items()]))
    found = x.select("store_id", F.explode(codes).alias("code"))
    profiles = stores.select("store_id", F.explode("socials").alias("k", "vs")).select("store_id", "k", F.explode("vs").alias("v"))
    fixed = F.coalesce((F.col("network") == F.lower("k")) & (F.col("profile") == F.col("v")), F.lit(False))
    found = found.unionByName(cut(with_social(profiles, "v")).where(~fixed).select("store_id", F.lit("social").alias("code")).distinct())
    for code, c in (("repeated_domain", "domain_url"), ("repeated_identity", "shop_identity")):
        twice = repeated(stores, c).withColumnRenamed("value", c)
        found = found.unionByName(stores.join(twice, c).select("store_id", F.lit(code).alias("code")))
    bare = F.array_compact(F.array(*[F.when(~is_missing(F.col(c), k) & ~F.array_contains(fields, c), F.lit(c)) for c, k in OPTIONAL.items()]))
    unsupported = x.select(F.lit("unsupported_field").alias("code"), "store_id", F.explode(bare).alias("field"))
    return found.select("code", "store_id", F.lit(None).cast("string").alias("field")).unionByName(unsupported)


def verdict(violations: DataFrame) -> DataFrame:
    """One row (passed, violations, stores)."""
    return violations.agg((F.count("*") == 0).alias("passed"), F.count("*").alias("violations"), F.count_distinct("store_id").alias("stores"))


def cell_differences(stores: DataFrame, cells: DataFrame, key: str = "store_id") -> DataFrame:
    """(store_id, field): guarded text cells of ``stores`` that an exported table lacks or has otherwise; ``field`` is the key
    where a whole row is on one side only."""
    from leadloom.operators.export import records

    a, b = records(stores), cells
    names = [c for c in a.columns if c != key]
    x = a.join(b.select(key, F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in names]).alias("_b")), key, "full").withColumn("_a", F.struct(*names))
    one_side = F.col("_b").isNull() | F.col(names[0]).isNull()
    wrong = F.when(one_side, F.array(F.lit(key))).otherwise(F.array_compact(F.array(*[F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in names])))
    return x.select(key, F.explode(wrong).alias("field"))


def counts_differ(**tables: DataFrame) -> DataFrame:
    """(name, n) of each table if their numbers of rows are not all the same, else nothing."""
    n = row_counts(**tables)
    same = n.agg((F.min("n") == F.max("n")).alias("same"))
    return n.join(F.broadcast(same)).where("NOT same").select("name", "n")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, ...): rows that only one of two tables has, as multisets."""
    return a.exceptAll(b).select(F.lit("left").alias("side"), "*").unionByName(b.exceptAll(a).select(F.lit("right").alias("side"), "*"))


def row_counts(**tables: DataFrame) -> DataFrame:
    """(name, n) of each table."""
    return reduce(lambda a, b: a.unionByName(b), [t.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n, t in tables.items()])
