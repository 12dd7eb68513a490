"""Command line: ``python -m leadloom QUERY FOLDER [OUT]`` runs a query over a folder of tables and shows or writes its result;
``python -m leadloom list`` names the queries. ``export FOLDER OUT`` writes a snapshot of the accepted stores, ``validate FOLDER
OUT`` checks one against its checksums and the tables, ``import FILE OUT`` writes the candidates of a JSON import."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from leadloom.operators import dedup, export, ledger, validation
from leadloom.queries.catalog import QUERIES
from leadloom.session import build_session, table
from leadloom.sources import leads

VERBS = ("import", "export", "validate")


def _verb(name: str, folder: str, out: str) -> int:
    """0 if the verb ended well and, for validate, nothing is wrong."""
    spark = build_session()
    if name == "import":
        new, attributed, counts = ledger.import_leads(leads.read_json_import(spark, folder), spark.createDataFrame([], "id string"))
        new.write.mode("overwrite").parquet(f"{out}/candidates.parquet")
        attributed.write.mode("overwrite").parquet(f"{out}/sources.parquet")
        counts.show()
        return 0
    now = dedup.current_stores(table(spark, folder, "stores"))
    kept = now.where("status = 'accepted'")
    if name == "export":
        rows = now.select(F.col("store_id").alias("id"), F.col("domain_url").alias("url"), "status", "reason", F.lit(None).cast("string").alias("duplicate_of"))
        tables = export.snapshot_tables(rows, now, table(spark, folder, "evidence"), table(spark, folder, "sources"), table(spark, folder, "runs"))
        print(export.write_snapshot(spark, out, tables, export.snapshot_digest(export.row_digest(kept, "store_id"), "store_id").first().digest or ""))
        return 0
    _, back = export.read_snapshot(spark, out)
    files, cells = export.changed_files(spark, out), validation.cell_differences(kept, back["stores.csv"])
    wrong = validation.verdict(validation.store_violations(kept, table(spark, folder, "evidence"), table(spark, folder, "sources"))).first()
    n = files.count(), cells.count(), wrong.violations
    print("files changed {}, cells changed {}, violations {}".format(*n))
    return int(any(n))


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="leadloom", description=__doc__)
    p.add_argument("query", help="name of a query, or list")
    p.add_argument("folder", nargs="?", help="folder of Parquet tables")
    p.add_argument("out", nargs="?", help="where to write the result as Parquet; without it the first rows are shown")
    p.add_argument("--rows", type=int, default=20)
    a = p.parse_args(args)
    if a.query == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    if a.query in VERBS and a.folder and a.out:
        return _verb(a.query, a.folder, a.out)
    if a.query not in QUERIES or not a.folder:
        p.error("unknown query or no folder")
    result = QUERIES[a.query](build_session(), a.folder)
    if a.out:
        result.write.mode("overwrite").parquet(a.out)
    else:
        result.show(a.rows, truncate=60)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
