"""Append-only logs read as current state, and small ordered rules over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.operators.export import row_text
from leadloom.operators.incremental import latest


def current_results(run_items: DataFrame, runs: DataFrame) -> DataFrame:
    """(candidate_id, started_at, run_id, result_json): each candidate's last result, by the start of its run."""
    done = run_items.where("status = 'done' AND result_json IS NOT NULL").select("run_id", "candidate_id", "result_json").distinct()
    started = runs.groupBy(F.col("id").alias("run_id")).agg(F.max("started_at").alias("started_at"))
    return latest(done.join(started, "run_id"), "candidate_id", "started_at", "run_id", "result_json")


def with_overrides(rows: DataFrame, key: str, value: str, *logs: DataFrame) -> DataFrame:
    """``rows`` with ``value`` replaced by the last entry of each log (key, value, at) in turn; later logs win."""
    out = rows
    for i, log in enumerate(logs):
        last = latest(log.select(key, F.col(value).alias(f"_v{i}"), "at"), key, "at", f"_v{i}").drop("at")
        out = out.join(last, key, "left").withColumn(value, F.coalesce(f"_v{i}", value)).drop(f"_v{i}")
    return out


def current_reviews(reviews: DataFrame, hashes: DataFrame, *keep: str) -> DataFrame:
    """(candidate_id, decision, current), and columns ``keep``: each candidate's last review by id; ``current`` tells whether the evidence it was
    made on (evidence_hash) is still what the candidate has (candidate_id, evidence_hash)."""
    last = latest(reviews, "candidate_id", "id", "decision", "evidence_hash", *keep)
    x = last.join(hashes.select("candidate_id", F.col("evidence_hash").alias("now")), "candidate_id", "left")
    return x.select("candidate_id", "decision", F.coalesce(F.col("evidence_hash") == F.col("now"), F.lit(False)).alias("current"), *keep)


def evidence_hashes(evidence: DataFrame) -> DataFrame:
    """(candidate_id, evidence_hash): a digest of the distinct evidence rows of a store, in whatever order.

    Each row's SHA-256 is cut into pieces of 60 bits, which are added up map-side, so that no store's rows meet in a task;
    the digest is the SHA-256 over the number of rows and the sums.
    """
    x = evidence.select(F.col("store_id").alias("candidate_id"), F.sha2(row_text(evidence), 256).alias("h")).distinct()
    piece = lambda i: F.sum(F.conv(F.substring("h", 15 * i + 1, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return x.groupBy("candidate_id").agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), *map(piece, range(4))), 256).alias("evidence_hash"))


#: What a review can decide (fixed values).
DECISIONS = ("confirmed", "excluded", "needs_review")


def checked_reviews(new: DataFrame, stores: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reviews to append, with the ``evidence_hash`` they were made on, and refused ones with ``error``.

    ``new``: id, candidate_id, decision, note, reviewer. A review needs a current store; what is confirmed must be verified
    both ways. A bad review is refused and stops nothing.
    """
    s = stores.select(F.col("store_id").alias("candidate_id"), F.coalesce((F.col("shopify") == "verified") & (F.col("india") == "verified"), F.lit(False)).alias("_ok"))
    x = new.join(s, "candidate_id", "left")
    error = (
        F.when(F.col("_ok").isNull(), "no evidence was collected")
        .when(~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False)), "invalid decision")
        .when((F.col("decision") == "confirmed") & ~F.col("_ok"), "not verified both ways")
    )
    x = x.withColumn("error", error).drop("_ok")
    good = x.where("error IS NULL").drop("error").join(evidence_hashes(evidence), "candidate_id", "left")
    return good, x.where("error IS NOT NULL")


def first_reason(*cases: tuple[Column, Column]) -> Column:
    """The text of the first case whose condition holds and whose text is not empty."""
    picks = [F.when(c, F.nullif(t, F.lit(""))) for c, t in cases]
    return F.coalesce(*picks)


def top_valid(rows: DataFrame, key: str, score: str, tie: str, valid: Column, tries: int = 3) -> DataFrame:
    """The best row of each key that is valid, among its ``tries`` best; keys without one are not returned."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), tie))
    x = rows.withColumn("_rank", rank).where(F.col("_rank") <= tries).where(valid)
    return x.groupBy(key).agg(F.min_by(F.struct(*rows.columns), "_rank").alias("_r")).select("_r.*")


def within_budget(rows: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each key by ``order``, with their numbers from 1."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most)


def ordered_union(key: str, value: str, *frames: DataFrame) -> DataFrame:
    """(key, value, part): each value of a key once, from the first of ``frames`` that has it."""
    parts = [f.select(key, value, F.lit(i).alias("part")) for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy(key, value).agg(F.min("part").alias("part"))


def against_baseline(rows: DataFrame, baseline: DataFrame, key: str, column: str) -> DataFrame:
    """(key, state): ``same``, ``changed``, ``missing`` (only in the baseline) or ``new``, comparing ``column``."""
    a, b = rows.select(key, F.col(column).alias("_a"), F.lit(True).alias("_in_a")), baseline.select(key, F.col(column).alias("_b"), F.lit(True).alias("_in_b"))
    x = a.join(b, key, "full")
    state = F.when(F.col("_in_b").isNull(), "new").when(F.col("_in_a").isNull(), "missing").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed")
    return x.select(key, state.alias("state"))
