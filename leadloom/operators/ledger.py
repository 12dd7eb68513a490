"""The ledger: importing leads, runs and their work lists, saved pages; all logs are append-only, the last write wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import trimmed
from leadloom.functions.urls import candidate_id, with_normalized
from leadloom.operators.incremental import latest

#: A run without a heartbeat for so long has stopped.
STALE_SECONDS = 120
PAGE_KINDS = ("page", "cached_page")


def keep_first(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row for each distinct ``keys``: the first by ``order``, ties by all other columns. Aggregated map-side."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_first"))
    return first.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest]).select(*df.columns)


def import_leads(entries: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New candidates (id, url), attributions (candidate_id, name, source_url) and counts (added, duplicates, errors).

    ``entries``: url, source, source_url. Addresses are normalized as home pages; source and source_url are trimmed and
    must not be blank (cut to 200 and 2,000 characters). A bad entry is an error and stops nothing; repeats within the
    entries and of ``existing`` (id) are duplicates.
    """
    e = with_normalized(entries.select("url", "source", "source_url"), "url", "home", homepage=True).select(
        F.col("home").alias("url"),
        F.substring(trimmed(F.col("source")), 1, 200).alias("name"),
        F.substring(trimmed(F.col("source_url")), 1, 2000).alias("source_url"),
    )
    e = e.withColumn("ok", F.coalesce(F.col("url").isNotNull() & (F.col("name") != "") & (F.col("source_url") != ""), F.lit(False)))
    good = e.where("ok").withColumn("id", candidate_id(F.col("url")))
    new = good.select("id", "url").distinct().join(existing.select("id"), "id", "left_anti")
    totals = e.agg(F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("errors"))
    counts = new.agg(F.count("*").alias("added")).join(totals).select("added", (F.col("good") - F.col("added")).alias("duplicates"), "errors")
    return new, good.select(F.col("id").alias("candidate_id"), "name", "source_url").distinct(), counts


def attributions(sources: DataFrame) -> DataFrame:
    """Each (candidate_id, name, source_url) once, with its first ``discovered_at``; names trimmed and cut."""
    x = sources.select("candidate_id", F.substring(trimmed(F.col("name")), 1, 200).alias("name"), F.substring(trimmed(F.col("source_url")), 1, 2000).alias("source_url"), "discovered_at")
    return x.groupBy("candidate_id", "name", "source_url").agg(F.min("discovered_at").alias("discovered_at"))


def observed_once(observations: DataFrame) -> DataFrame:
    """Exact repeats of an observation (same ``id``) once."""
    return observations.dropDuplicates(["id"])


def saved_pages(observations: DataFrame) -> DataFrame:
    """(candidate_id, final_url, id, run_id, content_hash, observed_at): the first saved page of each final address."""
    x = observations.where(F.col("kind").isin(*PAGE_KINDS) & (F.col("outcome") == "ok") & F.col("final_url").isNotNull())
    return keep_first(x.select("candidate_id", "final_url", "id", "run_id", "content_hash", "observed_at"), ["candidate_id", "final_url"], "id")


def latest_page_run(observations: DataFrame, kinds: tuple[str, ...] = PAGE_KINDS) -> DataFrame:
    """(candidate_id, id, run_id, observed_at) of each candidate's last usable observation of ``kinds`` by id."""
    x = observations.where(F.col("kind").isin(*kinds) & (F.col("outcome") == "ok"))
    return latest(x, "candidate_id", "id", "run_id", "observed_at")


def reused_pages(observations: DataFrame, run_id: str) -> DataFrame:
    """Rows to append to the log for a run that works on saved pages: of each candidate the saved pages of its last page run, one
    for each final address, as ``cached_page`` of ``run_id`` with the date and content they had."""
    last = latest_page_run(observations).select("candidate_id", F.col("run_id").alias("_run"))
    x = observations.join(last, "candidate_id").where(F.col("run_id") == F.col("_run"))
    return saved_pages(x).select(F.lit(run_id).alias("run_id"), "candidate_id", "final_url", F.lit("cached_page").alias("kind"), F.lit("ok").alias("outcome"), F.col("id").alias("copied_from"), "content_hash", "observed_at")


def run_summary(runs: DataFrame, run_items: DataFrame, observations: DataFrame, as_of: str) -> DataFrame:
    """Each run with its items (total, done), responses that came over the network, their bytes, and its seconds.

    Items and observations are counted once however often their rows are repeated; an unfinished run lasts until ``as_of``.
    The latest run comes first.
    """
    items = run_items.select("run_id", "candidate_id", "status").distinct().groupBy("run_id").agg(F.count_distinct("candidate_id").alias("total"), F.count_distinct(F.when(F.col("status") == "done", F.col("candidate_id"))).alias("done"))
    o = observed_once(observations.select("id", "run_id", "kind", "status_code", "bytes"))
    o = o.groupBy("run_id").agg(F.count_if((F.col("kind") != "cached_page") & F.col("status_code").isNotNull()).alias("responses"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    seconds = F.greatest(F.lit(0), F.round(F.timestamp_diff("MICROSECOND", "started_at", F.coalesce("finished_at", F.lit(as_of).cast("timestamp_ntz"))) / 1e6).cast("bigint"))
    x = runs.join(items, runs["id"] == items["run_id"], "left").drop("run_id").join(o, runs["id"] == o["run_id"], "left").drop("run_id")
    x = x.fillna(0, ["total", "done", "responses", "bytes"])
    x = x.orderBy(F.desc("started_at"), "id")
    return x.select("id", "status", F.get_json_object("config", "$.operation").alias("operation"), "total", "done", "responses", "bytes", seconds.alias("seconds"))


def stale_runs(runs: DataFrame, as_of: str, seconds: int = STALE_SECONDS) -> DataFrame:
    """(id, heartbeat): unfinished runs whose last heartbeat is older than ``seconds`` (no heartbeat: their start counts)."""
    beat = F.coalesce("heartbeat", "started_at")
    old = F.timestamp_diff("SECOND", beat, F.lit(as_of).cast("timestamp_ntz")) > seconds
    return runs.where(F.col("finished_at").isNull() & old).select("id", beat.alias("heartbeat"))


def current_candidates(candidates: DataFrame) -> DataFrame:
    """(id, url, created_at, status, store_json, updated_at): the current row of each candidate."""
    return latest(candidates, "id", "updated_at", "status", "url", "created_at", "store_json").select("id", "url", "created_at", "status", "store_json", "updated_at")


def work_list(candidates: DataFrame, where, limit: int | None = None) -> DataFrame:
    """(id, url, created_at) of current candidates that satisfy ``where``, in queue order; ``limit`` is the batch size."""
    x = current_candidates(candidates).where(where).select("id", "url", "created_at").orderBy("created_at", "id")
    return x.limit(limit) if limit is not None else x


def never_in(operation: str, candidates: DataFrame, run_items: DataFrame, runs: DataFrame, where) -> DataFrame:
    """Current candidates (id, url) that satisfy ``where`` and were in no run of ``operation``."""
    past = run_items.join(runs.where(F.get_json_object("config", "$.operation") == operation).select(F.col("id").alias("run_id")), "run_id").select(F.col("candidate_id").alias("id"))
    return current_candidates(candidates).where(where).select("id", "url").join(past, "id", "left_anti")


def unfinished(run_items: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, candidate_id): what a run that ended without completing still has to do; running items are pending again."""
    ended = runs.where(F.col("status").isin("interrupted", "cancelled", "failed") & (F.get_json_object("config", "$.operation") != "refine")).select(F.col("id").alias("run_id"))
    done = run_items.where("status = 'done'").select("run_id", "candidate_id")
    return run_items.where("status <> 'done'").select("run_id", "candidate_id").distinct().join(ended, "run_id").join(done, ["run_id", "candidate_id"], "left_anti")


def nested_sources(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, url, sources ARRAY<STRUCT<name, source_url, discovered_at>> in order of discovery); candidates without any have []."""
    s = attributions(sources).groupBy(F.col("candidate_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("discovered_at", "name", "source_url"))).alias("sources"))
    x = current_candidates(candidates).select("id", "url").join(s, "id", "left")
    return x.withColumn("sources", F.coalesce("sources", F.array().cast("array<struct<discovered_at:timestamp_ntz,name:string,source_url:string>>")))
