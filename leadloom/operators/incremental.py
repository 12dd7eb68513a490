"""Problem 3: processing only new or changed records.

State is a table (key, content_hash) of what was last processed with success. A run hashes the current rows, joins them
with the state, works on what is new or changed, and only then commits: what it processed is written beside the old parts
of the state and a pointer to all of them is swapped in by renaming. A run that fails before the swap has changed nothing,
so its records are selected again; a run that is repeated after the swap selects nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.session import new_folder

#: Stands for null inside hashed content; no text of the tables has it.
NULL = "\u0000"


def content_hash(*cols: str) -> Column:
    """SHA-256 over the columns' names and values. Null differs from the empty string; column order doesn't matter."""
    parts = [x for c in sorted(cols) for x in (F.lit(c), F.coalesce(_text(c), F.lit(NULL)))]
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def _text(c: str) -> Column:
    return F.col(f"`{c}`").cast("string")


def row_key(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes over all columns of ``df`` (h1, h2): equal rows agree in both, nulls count as values."""
    texts = [F.coalesce(F.to_json(F.struct(F.col(f"`{c}`").alias("x"))) if kind.startswith(("map", "array", "struct")) else _text(c), F.lit(NULL)) for c, kind in df.dtypes]
    return [F.xxhash64(F.lit(0), *texts).alias("h1"), F.xxhash64(F.lit(1), *reversed(texts)).alias("h2")]


def distinct_rows_by(df: DataFrame, key: str, out: str = "n") -> DataFrame:
    """(key, n): distinct rows of ``df`` by ``key``; null keys are dropped.

    Only the key and 128 bits of hash are shuffled, first by all of them and then counted by key, so that no key's rows
    have to meet in one task.
    """
    h = df.where(F.col(key).isNotNull()).select(F.col(key), *row_key(df)).distinct()
    return h.groupBy(key).agg(F.count("*").alias(out))


def latest(df: DataFrame, key: str, order: str, *cols: str) -> DataFrame:
    """One row a key: ``cols`` of its row with the greatest ``order`` (null is earliest; ties: the greatest values of
    ``cols`` in their order). Null keys are dropped. Aggregated map-side, so that a hot key costs one row a task."""
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(F.col(order).alias("_order"), *cols)).alias("_best"))
    return best.select(key, F.col("_best._order").alias(order), *[F.col(f"_best.{c}").alias(c) for c in cols if c != order])


def select_changed(current: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Rows of ``current`` (key, ..., content_hash) that are new or changed against ``state`` (key, content_hash).

    Adds ``change``: "new" or "changed". Keys that are only in the state are not returned. Each key is expected once on
    either side; a repeated key of the state counts as unchanged if any of its hashes agrees.
    """
    s = state.groupBy(F.col(key)).agg(F.collect_set("content_hash").alias("_known")).withColumnRenamed(key, "_key")
    x = current.join(s, current[key] == s["_key"], "left")
    x = x.where(F.col("_known").isNull() | ~F.array_contains("_known", F.col("content_hash")))
    return x.withColumn("change", F.when(F.col("_key").isNull(), "new").otherwise("changed")).drop("_key", "_known")


@dataclass
class Versions:
    """Numbered versions in a folder, each a list of data folders named in its pointer, a small JSON file.

    A data folder has a name of its own, so that no run writes where another has written; it is complete before a pointer
    names it. A pointer is written beside its place and moved there by one rename that never replaces another, so of two
    runs that started from one version only the first can commit, and the other leaves nothing but unnamed folders.
    """

    spark: SparkSession
    folder: str

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("pointers").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def current(self) -> int:
        """The committed version, -1 if nothing was ever committed."""
        fs, path = self._fs(), self._path("pointers")
        if not fs.exists(path):
            return -1
        return max((int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit()), default=-1)

    def folders(self, version: int | None = None) -> list[str]:
        """The data folders of a version (the current one by default), oldest first."""
        version = self.current() if version is None else version
        if version < 0:
            return []
        stream = self._fs().open(self._path(f"pointers/{version}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [f"{self.folder}/{name}" for name in json.loads(text)]

    def draft(self) -> str:
        """The path of a new data folder."""
        return f"{self.folder}/data-{uuid.uuid4().hex}"

    def commit(self, base: int, folders: list[str]) -> int:
        """Makes ``folders`` the version after ``base``, which this run started from; raises RuntimeError if another run was first."""
        jvm, version = self.spark._jvm, base + 1
        fs, draft, pointer = self._fs(), self._path(f"draft-{uuid.uuid4().hex}"), self._path(f"pointers/{version}")
        fs.mkdirs(self._path("pointers"))
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps([f.rpartition("/")[2] for f in folders]).encode()))
        out.close()
        never_replace = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, pointer, never_replace)
        except Py4JJavaError as e:
            fs.delete(draft, False)
            if fs.exists(pointer):
                raise RuntimeError(f"version {version} was committed by another run") from e
            raise
        return version


class ChangeLog:
    """The state (key, content_hash) in a folder; a version is a list of parts, of which a later one holds for its keys.

    A run calls ``changes``, works on what it gets and then calls ``commit`` on the same object: the commit counts only if no
    other run has committed since. A commit writes what was processed and nothing else; after ``COMPACT`` parts it writes
    the state as one. Null keys are dropped; a key that is processed twice in one commit keeps its greatest hash.
    """

    COMPACT = 20

    def __init__(self, spark: SparkSession, folder: str, key: str = "key"):
        self.spark, self.key, self.versions = spark, key, Versions(spark, folder)
        self.base: int | None = None

    def _of(self, folders: list[str]) -> DataFrame:
        parts = [self.spark.read.parquet(f).withColumn("_part", F.lit(i)) for i, f in enumerate(folders)]
        if not parts:
            return self.spark.createDataFrame([], f"{self.key} string, content_hash string")
        if len(parts) == 1:
            return parts[0].drop("_part")
        x = reduce(DataFrame.unionByName, parts).groupBy(self.key)
        return x.agg(F.max_by("content_hash", F.struct("_part", "content_hash")).alias("content_hash"))

    def state(self) -> DataFrame:
        return self._of(self.versions.folders())

    def changes(self, current: DataFrame) -> DataFrame:
        """``current`` must have the key and content_hash. Remembers the version that it compares with."""
        self.base = self.versions.current()
        return select_changed(current, self._of(self.versions.folders(self.base)), self.key)

    def commit(self, processed: DataFrame) -> int:
        """Makes ``processed`` (key, content_hash) the last processed state of its keys; returns the new version."""
        base = self.versions.current() if self.base is None else self.base
        parts, part = self.versions.folders(base), self.versions.draft()
        new = processed.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max("content_hash").alias("content_hash"))
        new.write.parquet(part)
        parts.append(part)
        if len(parts) > self.COMPACT:
            whole = self.versions.draft()
            self._of(parts).write.parquet(whole)
            parts = [whole]
        self.base = self.versions.commit(base, parts)
        return self.base


def candidate_content(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """(candidate_id, status, evidence_rows, content_hash) of each candidate's current state."""
    now = latest(candidates, "id", "updated_at", "status").select(F.col("id").alias("candidate_id"), "status")
    rows = distinct_rows_by(evidence, "store_id", "evidence_rows").withColumnRenamed("store_id", "candidate_id")
    x = now.join(rows, "candidate_id", "left").withColumn("evidence_rows", F.coalesce("evidence_rows", F.lit(0)))
    return x.withColumn("content_hash", content_hash("status", "evidence_rows"))


def processed_content(run_items: DataFrame, runs: DataFrame) -> DataFrame:
    """(candidate_id, content_hash) of each candidate's last processed item.

    Processed: done without an error, whatever became of the run; last: of the latest ``started_at`` (an item whose run
    is unknown counts as earliest). A missing ``evidence_rows`` is 0; an unreadable ``result_json`` never agrees.
    """
    done = run_items.where("status = 'done' AND error IS NULL").select("run_id", "candidate_id", "result_json")
    done = done.join(runs.groupBy(F.col("id").alias("run_id")).agg(F.max("started_at").alias("started_at")), "run_id", "left")
    last = latest(done, "candidate_id", "started_at", "result_json")
    x = last.withColumn("_r", F.from_json("result_json", "status string, evidence_rows bigint"))
    x = x.select("candidate_id", F.col("_r.status").alias("status"), F.coalesce("_r.evidence_rows", F.lit(0)).alias("evidence_rows"))
    return x.select("candidate_id", content_hash("status", "evidence_rows").alias("content_hash"))


def candidates_to_process(candidates: DataFrame, evidence: DataFrame, run_items: DataFrame, runs: DataFrame, log: ChangeLog | None = None) -> DataFrame:
    """(candidate_id, status, evidence_rows, content_hash, change): candidates that the next run has to work on.

    Goes through the persisted state: what the ledger's items say was processed is committed to ``log`` (a new one in the
    shared folder by default) where it differs from it, and the current rows are compared with the committed version.
    """
    log = log or ChangeLog(candidates.sparkSession, new_folder(candidates.sparkSession, "processed"), "candidate_id")
    log.commit(log.changes(processed_content(run_items, runs)))
    return log.changes(candidate_content(candidates, evidence))
