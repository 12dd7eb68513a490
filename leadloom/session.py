"""Session helpers: building a session, reading tables, cutting lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "leadloom", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings the library is written for; a cluster brings its own."""
    n = cpus or os.cpu_count() or 4
    settings = {
        "spark.master": f"local[{n}]",
        "spark.app.name": app,
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    return SparkSession.builder.config(map=settings).getOrCreate()


#: Rows of more bytes than this are not broadcast.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if its bytes, which are summed first, are few; else as it is. Meant for what is cut or cheap."""
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns), F.lit(16 + 8 * len(df.columns)))
    size = df.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode, as in tests.

    On a cluster an unset folder is refused: a temporary one would be on another disk for each executor.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return folder or have.get()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="leadloom-")
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder of its own, not yet made, below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
