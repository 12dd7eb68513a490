"""Export: guarded CSV cells, records, checksummed snapshots."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = ("store_id", "domain_url", "emails", "phones", "socials", "category", "description", "logo_url", "state", "observed_at")


def csv_safe(c: Column) -> Column:
    """A cell that no spreadsheet takes for a formula: null as empty; text that begins (after blanks) with ``= + - @``, or
    with a tab or line break, gets an apostrophe before it."""
    risky = c.rlike(r"^\s*[=+\-@]") | c.rlike(r"^[\t\r\n]")
    return F.coalesce(F.when(risky, F.concat(F.lit("'"), c)).otherwise(c), F.lit(""))


def sorted_json(df: DataFrame, column: str) -> Column:
    """Arrays and maps as JSON, map entries by key; other values as text."""
    kind = dict(df.dtypes)[column]
    c = F.col(column)
    if kind.startswith("map"):
        c = F.map_from_entries(F.array_sort(F.map_entries(c)))
    return F.to_json(c) if kind.startswith(("map", "array", "struct")) else c.cast("string")


def records(stores: DataFrame) -> DataFrame:
    """The public columns of ``stores`` as guarded text cells."""
    return stores.select(*[csv_safe(sorted_json(stores, c)).alias(c) for c in RECORD])


def canonical(df: DataFrame, column: str) -> Column:
    """A value as one text that is the same in any engine: arrays in brackets, maps by key, times in microseconds, null as null."""
    kind, c = dict(df.dtypes)[column], F.col(column)
    if kind.startswith("map"):
        entries = F.array_sort(F.map_entries(c))
        shown = (lambda v: F.concat(F.lit("["), F.array_join(v, ","), F.lit("]"))) if "array" in kind else (lambda v: v.cast("string"))
        return F.when(c.isNotNull(), F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), shown(e["value"]))), ";"), F.lit("}")))
    if kind.startswith("array"):
        return F.when(c.isNotNull(), F.concat(F.lit("["), F.array_join(c, ","), F.lit("]")))
    if kind.startswith("timestamp"):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast(kind), c).cast("string")
    return c.cast("string")


def row_text(df: DataFrame) -> Column:
    """A row as lines ``column=value`` in alphabetic order; nulls are left out."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{c}="), canonical(df, c)) for c in sorted(df.columns)])


def row_digest(df: DataFrame, key: str) -> DataFrame:
    """(key, digest): SHA-256 over each row's text."""
    return df.select(key, F.sha2(row_text(df), 256).alias("digest"))


def snapshot_digest(digests: DataFrame, key: str, per_bucket: int = 4096) -> DataFrame:
    """One row (rows, digest): a tree of SHA-256 sums. Rows fall into hash buckets, each digested in order of the key; levels of
    ``per_bucket`` buckets are digested in order until one is left.

    No task and not the driver ever holds more than some ``per_bucket`` rows; the number of buckets depends on the number of
    rows alone, so the digest is independent of partitioning.
    """
    buckets = digests.count() // per_bucket + 1
    b = F.pmod(F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 15), 16, 10).cast("bigint"), F.lit(buckets))
    x, order = digests.select(b.alias("b"), F.lit(1).cast("bigint").alias("n"), F.col(key).alias("o"), "digest"), True
    while order or buckets > 1:
        if not order:
            x, buckets = x.select(F.floor(F.col("b") / per_bucket).alias("b"), "n", F.col("b").alias("o"), "digest"), (buckets - 1) // per_bucket + 1
        order = False
        every = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "digest"))), lambda s: s["digest"]), "")
        x = x.groupBy("b").agg(F.sum("n").alias("n"), F.sha2(every, 256).alias("digest"))
    return x.select(F.col("n").alias("rows"), "digest") if not digests.isEmpty() else digests.sparkSession.createDataFrame([(0, None)], "rows bigint, digest string")


def snapshot_tables(projected: DataFrame, stores: DataFrame, evidence: DataFrame, sources: DataFrame, runs: DataFrame, sample: int = 150) -> dict[str, DataFrame]:
    """The seven artifacts of a snapshot from one projection (id, url, status, duplicate_of, reason): ``stores.csv``, ``stores.jsonl``,
    ``evidence.jsonl`` (one line an evidence row), ``run-report.jsonl`` (counts by status, and runs), ``source-manifest.jsonl``,
    ``unresolved.jsonl`` and ``audit-sample.jsonl``. ``stores``: current rows."""
    accepted = projected.where("status = 'accepted'").select(F.col("id").alias("store_id"))
    kept = stores.join(accepted, "store_id", "left_semi")
    report = projected.groupBy("status").agg(F.count("*").alias("n")).select(F.lit("candidates").alias("kind"), "status", "n")
    return {
        "stores.csv": records(kept),
        "stores.jsonl": kept.select(*RECORD),
        "evidence.jsonl": evidence.join(accepted, "store_id", "left_semi"),
        "run-report.jsonl": report.unionByName(runs.groupBy("status").agg(F.count("*").alias("n")).select(F.lit("runs").alias("kind"), "status", "n")),
        "source-manifest.jsonl": sources.select("candidate_id", "name", "source_url", "discovered_at").distinct(),
        "unresolved.jsonl": projected.where("status <> 'accepted'").select(F.col("id").alias("store_id"), "url", "status", "reason", "duplicate_of"),
        "audit-sample.jsonl": ordered_sample(accepted, "store_id", sample),
    }


def _files(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """(file, bytes, sha256) of every data file of the named artifacts, each read whole by one task."""
    x = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load([f"{folder}/{n}" for n in names])
    file = F.regexp_extract("path", r"([^/]+/[^/]+)$", 1)
    return x.select(file.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_snapshot(spark: SparkSession, folder: str, tables: dict[str, DataFrame], digest: str, rows_per_file: int = 1_000_000) -> dict:
    """Writes each table as Parquet, CSV or JSON lines by the ending of its name, then ``checksums.jsonl`` (file, bytes, sha256),
    and ``manifest.json`` last: the snapshot's id, the rows of each artifact and a digest over all checksums."""
    counts = {}
    for name, df in tables.items():
        w = df.write.mode("overwrite").options(maxRecordsPerFile=rows_per_file, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        {"csv": lambda p: w.option("header", True).option("escape", '"').csv(p), "jsonl": w.json}.get(name.rpartition(".")[2], w.parquet)(f"{folder}/{name}")
        back = spark.read.json(f"{folder}/{name}") if name.endswith("jsonl") else read_csv(spark, f"{folder}/{name}") if name.endswith("csv") else spark.read.parquet(f"{folder}/{name}")
        counts[name] = back.count()
    _files(spark, folder, list(tables)).write.mode("overwrite").json(f"{folder}/checksums.jsonl")
    sums = spark.read.schema("file string, bytes bigint, sha256 string").json(f"{folder}/checksums.jsonl")
    manifest = {"snapshot_id": digest[:16], "rows": counts, "files": sums.count(), "checksum": snapshot_digest(sums.select("file", F.col("sha256").alias("digest")), "file").first().digest}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest.json")
    return manifest


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("nullValue", "\u0000").option("emptyValue", "").csv(path)


def read_snapshot(spark: SparkSession, folder: str) -> tuple[dict, dict[str, DataFrame]]:
    """The manifest, and the tables that it names, of a written snapshot."""
    manifest = json.loads(spark.read.text(f"{folder}/manifest.json").first().value)
    readers = {"csv": lambda p: read_csv(spark, p), "jsonl": spark.read.json}
    some = {n: readers.get(n.rpartition(".")[2], spark.read.parquet)(f"{folder}/{n}") for n, k in manifest["rows"].items() if k}
    return manifest, some


def changed_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, state): files of a snapshot that are ``changed``, ``missing`` or ``unknown`` against its checksums, or ``unsafe`` (a
    checksum of a path outside of the snapshot)."""
    manifest = json.loads(spark.read.text(f"{folder}/manifest.json").first().value)
    want = spark.read.schema("file string, bytes bigint, sha256 string").json(f"{folder}/checksums.jsonl").select("file", F.col("sha256").alias("want"))
    x = want.join(_files(spark, folder, list(manifest["rows"])).select("file", "sha256"), "file", "full")
    unsafe = F.col("file").rlike(r"^/|(^|/)\.\.(/|$)|^[a-z]+:")
    state = F.when(unsafe, "unsafe").when(F.col("sha256").isNull(), "missing").when(F.col("want").isNull(), "unknown").when(F.col("want") != F.col("sha256"), "changed")
    return x.select("file", state.alias("state")).where("state IS NOT NULL")


def zip_bundle(files: dict[str, bytes]) -> tuple[bytes, dict[str, str]]:
    """A deflated bundle of small files and their SHA-256 sums."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(files):
            z.writestr(zipfile.ZipInfo(name), files[name], zipfile.ZIP_DEFLATED)
    return out.getvalue(), {n: hashlib.sha256(b).hexdigest() for n, b in files.items()}


def ordered_sample(ids: DataFrame, key: str, size: int = 150, seed: int = 20260929) -> DataFrame:
    """(key): a simple random sample of ``size`` distinct ids, those of the smallest SHA-256 of seed and id."""
    return ids.select(key).distinct().orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), key).limit(size)


def write_by_key(df: DataFrame, folder: str, key: str) -> None:
    """JSON lines in one folder a key; each key's rows are brought together first, so that it gets few files."""
    df.repartition(key).write.mode("overwrite").partitionBy(key).json(folder)


def publish_if_any(spark: SparkSession, folder: str, tables: dict[str, DataFrame], digest: str, needed: str) -> dict | None:
    """``write_snapshot`` unless the table ``needed`` is empty; then nothing is written and an older snapshot stays."""
    return None if tables[needed].isEmpty() else write_snapshot(spark, folder, tables, digest)
