"""Queries of the problems that live in this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm import canonical, history, language, leakage, mixing, sampling, survivors
from leadloom.session import table


def _reports(spark: SparkSession, d: str) -> DataFrame:
    return history.replayed(spark, table(spark, d, "candidates"), table(spark, d, "sources"), table(spark, d, "known_hosts"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _reports(spark, d).select(F.least("id", "first_id").alias("first_id"), F.greatest("id", "first_id").alias("second_id"))


def _survivors(spark: SparkSession, d: str) -> survivors.Survivors:
    return survivors.Survivors(table(spark, d, "stores"), table(spark, d, "sources"), table(spark, d, "known_hosts"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _survivors(spark, d).members.select("group_id", "store_id", "survivor_id")


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    """The fused record of each group; probabilities are rounded, since sums of doubles depend on their order."""
    r = _survivors(spark, d).records
    return r.select("group_id", "survivor_id", "size", *survivors.FUSED, *survivors.UNITED, *[F.round(f"p_{c}", 6).alias(f"p_{c}") for c in survivors.FUSED])


def p2_fused(spark: SparkSession, d: str) -> DataFrame:
    """The fused value of each field of each group and its probability, a row each."""
    return _survivors(spark, d).fused.select("group_id", "field", "value", F.round("p", 5).alias("p"))


def p2_values(spark: SparkSession, d: str) -> DataFrame:
    """Every e-mail, phone number, alias and social profile of the groups, a row each, for groups too large for one row."""
    return _survivors(spark, d).values.select("group_id", "field", "network", "value", "n")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return sampling.not_kept(table(spark, d, "audit_sample"), table(spark, d, "stores"))


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample of the accepted stores that keeps every accepted store of the recorded samples."""
    stores = sampling.accepted_stores(table(spark, d, "stores"))
    kept = sampling.recorded(table(spark, d, "audit_sample")).select(F.col("id").alias("store_id"), F.lit(1.0).alias("probability")).distinct()
    sample, _ = sampling.draw(stores, kept)
    return sample.select("store_id", F.round("probability", 6).alias("probability"), "kept")


def p4_waves(spark: SparkSession, d: str) -> DataFrame:
    """Of each recorded wave: how many stores the replayed sampler selects, keeps from the wave before, and finds recorded."""
    x = sampling.replay(table(spark, d, "audit_sample"), sampling.accepted_stores(table(spark, d, "stores")))
    return x.groupBy("wave").agg(F.count("*").alias("selected"), F.count_if(F.col("kept")).alias("kept"), F.count_if(F.expr("kept AND recorded")).alias("recorded_again"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.map_stores(table(spark, d, "stores"), table(spark, d, "canon_values")).select("store_id", "field_name", "canon_id")


def p5_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The values that mean no entry, and how many stores have them."""
    x = canonical.map_stores(table(spark, d, "stores"), table(spark, d, "canon_values")).where("canon_id = 0")
    return x.groupBy("field_name", "value").agg(F.count("*").alias("n"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.leaked(table(spark, d, "documents"), leakage.passages(table(spark, d, "eval_items")))
    return found.select("doc_id", "item_id")


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """The items that leaked, into how many documents."""
    return p6_found(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.Mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).plan.where("NOT reachable").select("source")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """What each source gets: tokens, its share of what is mixed and of the total aimed at."""
    r = mixing.Mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).report
    mixed = r.agg(F.sum("used").alias("mixed"))
    share = F.round(F.try_divide("used", "mixed"), 6)
    r = r.join(mixed).withColumns({"share": share, "of_target": F.round(F.try_divide("used", F.col("weight") * F.col("total")), 6)})
    return r.select("source", F.round("weight", 6).alias("weight"), "docs", "tokens", "budget", "used", "uses", "most", "share", "of_target", "reachable")


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every stretch of every document in one language: where it begins and ends, and how sure that is."""
    documents = table(spark, d, "documents")
    x = language.segments(documents, language.train(documents))
    return x.select("doc_id", "start", "end", "lang", F.round("confidence", 4).alias("confidence"), "sentences")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    found = language.segments(documents, language.train(documents))
    return language.relabel(documents, found).select("doc_id", "lang")


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_records, p2_fused, p2_values, p4_found, p4_sample, p4_waves, p5_found, p5_unmatched, p6_found, p6_items, p7_found, p7_shares, p8_found, p8_segments)}
