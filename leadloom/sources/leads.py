"""Sources of leads: JSON arrays in two shapes, JSON lines of an index, line lists, HTML tables, content-addressed blobs."""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions.html import table_cells
from leadloom.functions.urls import with_normalized

#: Imports beyond this size are refused, as objects and as flattened pairs.
MOST_ENTRIES = 50_000
ENTRY = "url string, source string, source_url string, candidate_url string, status string, sources array<struct<name:string,source_url:string>>"
CDX = "urlkey string, timestamp string, url string, mime string, status string, digest string, length string"


def flattened(entries: DataFrame) -> DataFrame:
    """(url, source, source_url) of entries in either shape: flat, or a saved manifest's candidate_url with its sources.

    A former status is ignored. Raises ValueError beyond MOST_ENTRIES objects or pairs.
    """
    flat = entries.where("url IS NOT NULL").select("url", "source", "source_url")
    saved = entries.where("url IS NULL AND candidate_url IS NOT NULL").select(F.col("candidate_url").alias("url"), F.explode("sources").alias("s"))
    out = flat.unionByName(saved.select("url", F.col("s.name").alias("source"), F.col("s.source_url").alias("source_url")))
    if len(entries.limit(MOST_ENTRIES + 1).select(F.lit(1)).collect()) > MOST_ENTRIES or len(out.limit(MOST_ENTRIES + 1).select(F.lit(1)).collect()) > MOST_ENTRIES:
        raise ValueError(f"more than {MOST_ENTRIES} entries")
    return out


def read_json_import(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of entries (a byte-order mark is skipped); malformed JSON raises."""
    return flattened(spark.read.schema(ENTRY).option("multiLine", True).option("mode", "FAILFAST").json(path))


def read_cdx_lines(spark: SparkSession, path: str, limit: int = 5000) -> DataFrame:
    """(url, urlkey, timestamp, status) of a file of JSON lines in file order; blank lines are skipped, bad ones raise."""
    x = spark.read.text(path).where(F.trim("value") != "").limit(limit)
    return x.select(F.from_json("value", CDX, {"mode": "FAILFAST"}).alias("r")).select("r.url", "r.urlkey", "r.timestamp", "r.status")


def collapsed(cdx: DataFrame, limit: int = 100) -> DataFrame:
    """Successful rows, the first capture of each urlkey; ``limit`` is kept within 1 and 200."""
    x = cdx.where("status = '200'").groupBy("urlkey").agg(F.min(F.struct("timestamp", "url")).alias("f"))
    return x.select("urlkey", "f.timestamp", "f.url").orderBy("urlkey").limit(min(200, max(1, limit)))


def parsed_lines(lines: DataFrame, pos: str = "pos", text: str = "value") -> DataFrame:
    """(pos, url) of a line list: quotes and blanks stripped, normalized as home pages, bad lines dropped, first of each kept."""
    x = lines.select(pos, F.regexp_replace(text, r'^[\s"]+|[\s"]+$', "").alias("u"))
    x = with_normalized(x, "u", "url", homepage=True).where("url IS NOT NULL")
    return x.groupBy("url").agg(F.min(pos).alias(pos)).select(pos, "url")


def parsed_tables(pages: DataFrame, html: str = "html", header: str = "store", keep: list[str] | None = None) -> DataFrame:
    """(cell, domain), and the columns ``keep``: first cells of the tables headed ``header``, by an Arrow function over pages."""

    @F.pandas_udf("array<string>")
    def cells(column: pd.Series) -> pd.Series:
        return column.map(lambda h: table_cells(h or "", header))

    x = pages.select(*(keep or []), F.explode(cells(F.col(html))).alias("cell"))
    return x.select(*(keep or []), "cell", F.regexp_extract(F.lower("cell"), r"((?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,})", 1).alias("domain"))


def lead_slice(leads: DataFrame, offset: int = 0, limit: int = 300, *order: str) -> DataFrame:
    """A page of a source's leads. Raises ValueError for a limit outside 1 to 10,000 or a negative offset."""
    if not 1 <= limit <= 10_000 or offset < 0:
        raise ValueError("limit must be within 1 and 10000, offset at least 0")
    return leads.orderBy(*order).offset(offset).limit(limit)


def store_blobs(blobs: DataFrame, existing: DataFrame) -> DataFrame:
    """(digest, body, packed) of ``blobs`` (body) that are new against ``existing`` (digest), each content once; empty bodies are
    none. A body is kept deflated where that is smaller; the digest is that of the plain body."""

    @F.pandas_udf("binary")
    def deflated(column: pd.Series) -> pd.Series:
        return column.map(lambda b: gzip.compress(bytes(b), 3, mtime=0))

    x = blobs.where(F.length("body") > 0).select(F.sha2("body", 256).alias("digest"), "body").dropDuplicates(["digest"])
    x = x.join(existing.select("digest"), "digest", "left_anti").withColumn("_z", deflated(F.col("body")))
    small = F.length("_z") < F.length("body")
    return x.select("digest", F.when(small, F.col("_z")).otherwise(F.col("body")).alias("body"), small.alias("packed"))


def verified_blobs(blobs: DataFrame) -> DataFrame:
    """``blobs`` (digest, body, packed) with the plain body and ``intact``: the digest is well formed and that of the plain body. What
    cannot be unpacked has a null body and is not intact. Without a column ``packed`` all bodies are plain."""

    @F.pandas_udf("binary")
    def plain(column: pd.Series, packed: pd.Series) -> pd.Series:
        def one(b, z):
            try:
                return bytes(b) if b is None or not z else gzip.decompress(bytes(b))
            except (OSError, EOFError, zlib.error):
                return None

        return pd.Series([one(b, z) for b, z in zip(column, packed)], dtype=object)

    x = blobs.withColumn("body", plain(F.col("body"), F.coalesce("packed", F.lit(False)))) if "packed" in blobs.columns else blobs
    return x.withColumn("intact", F.coalesce(F.col("digest").rlike("^[0-9a-f]{64}$") & (F.sha2("body", 256) == F.col("digest")), F.lit(False)))


def slice_manifest(leads: DataFrame, selected: DataFrame, source: str, offset: int, limit: int, column: str = "url") -> DataFrame:
    """One row (source, offset, limit, available, selected, content_hash): what a page of a source's leads was taken from; the
    hash is over the distinct leads, in whatever order."""
    from leadloom.operators.export import snapshot_digest

    every = leads.select(column).distinct()
    digest = snapshot_digest(every.select(column, F.sha2(column, 256).alias("digest")), column).select(F.col("rows").alias("available"), F.col("digest").alias("content_hash"))
    return digest.join(selected.agg(F.count("*").alias("selected"))).select(F.lit(source).alias("source"), F.lit(offset).alias("offset"), F.lit(limit).alias("limit"), "available", "selected", "content_hash")


def from_text(spark: SparkSession, text: str, source: str, source_url: str) -> DataFrame:
    """(url, source, source_url): one entry for each non-blank line of a pasted text."""
    x = spark.createDataFrame([(text,)], "t string").select(F.explode(F.split("t", r"\r?\n")).alias("url"))
    return x.select(F.trim("url").alias("url"), F.lit(source).alias("source"), F.lit(source_url).alias("source_url")).where("url <> ''")
