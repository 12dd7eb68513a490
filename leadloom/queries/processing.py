"""Queries about what the next run has to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leadloom.operators import incremental
from leadloom.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    t = {n: table(spark, d, n) for n in ("candidates", "evidence", "run_items", "runs")}
    return incremental.candidates_to_process(**t).select("candidate_id")


P3_SQL = """
WITH now AS (
  SELECT id, arg_max(status, (coalesce(updated_at, TIMESTAMP '0001-01-01'), status)) AS status FROM candidates GROUP BY id),
ev AS (SELECT store_id, count(*) AS n FROM (SELECT DISTINCT * FROM evidence) GROUP BY store_id),
item AS (
  SELECT i.candidate_id, arg_max(i.result_json, (r.started_at, i.result_json)) AS j
  FROM run_items i JOIN runs r ON r.id = i.run_id WHERE i.status = 'done' AND i.error IS NULL GROUP BY 1)
SELECT now.id AS candidate_id FROM now LEFT JOIN ev ON ev.store_id = now.id LEFT JOIN item ON item.candidate_id = now.id
WHERE item.candidate_id IS NULL OR json_extract_string(item.j, '$.status') IS DISTINCT FROM now.status
   OR coalesce(CAST(json_extract(item.j, '$.evidence_rows') AS BIGINT), 0) <> coalesce(ev.n, 0)
"""

QUERIES = {"p3_found": p3_found}
SQL = {"p3_found": P3_SQL}
