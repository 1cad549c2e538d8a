"""Queries of the general problems, and the SQL they are held against."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changed_records import ChangeLog, upper_limit
from ..operators.snapshot_changes import snapshot_changes
from ..session import shared_folder, table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The cases that a log holds after two steps: one up to the middle of the time in which runs were reported, one up
    to what is there now."""
    runs, state = table(spark, folder, "scan_runs"), table(spark, folder, "scan_state")
    high = upper_limit(runs, state)
    first = runs.agg(F.min("updated_at")).first()[0]
    log = ChangeLog(spark, f"{shared_folder(spark)}/log-{uuid.uuid4().hex}")
    if first is not None and first < high:
        log.step(runs, state, first + (high - first) / 2)
    log.step(runs, state, high)
    return log.cases().select("run_id", "path")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot_changes(table(spark, folder, "scan_runs"), table(spark, folder, "context_records"))


QUERIES = {"p1_found": p1_found, "p3_found": p3_found}

_RUNS = """
runs AS (
  SELECT run_id, root_id, run_no, status, config_hash, tool_version FROM scan_runs
  QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY updated_at DESC NULLS LAST, status DESC) = 1)"""

SQL = {
    "p1_found": f"""
WITH {_RUNS},
ok AS (
  SELECT run_id, root_id, row_number() OVER w AS n, lag(run_id) OVER w AS base,
         config_hash IS NOT DISTINCT FROM lag(config_hash) OVER w AND tool_version IS NOT DISTINCT FROM lag(tool_version) OVER w AS same
  FROM runs WHERE status = 'succeeded' WINDOW w AS (PARTITION BY root_id ORDER BY run_no, run_id)),
listed AS (
  SELECT run_id, path, hash FROM (
    SELECT run_id, arrived_at, regexp_replace(replace(path, chr(92), '/'), '^([.]/+)+', '') AS path,
           regexp_replace(lower(trim(hash)), '^sha-?256[:=]', '') AS hash FROM scan_state)
  QUALIFY row_number() OVER (PARTITION BY run_id, path ORDER BY arrived_at DESC NULLS LAST, hash DESC NULLS LAST) = 1)
SELECT l.run_id, l.path
FROM listed l JOIN ok ON l.run_id = ok.run_id LEFT JOIN listed b ON b.run_id = ok.base AND b.path = l.path
WHERE l.hash <> '' AND (ok.n = 1 OR NOT ok.same OR b.hash IS DISTINCT FROM l.hash)""",
    "p3_found": f"""
WITH {_RUNS},
one AS (
  SELECT run_id, section, record_key, payload FROM context_records
  QUALIFY row_number() OVER (PARTITION BY run_id, section, record_key ORDER BY delivered_at DESC) = 1),
n AS (
  SELECT run_id, root_id, row_number() OVER (PARTITION BY root_id ORDER BY run_no) AS n
  FROM runs WHERE status = 'succeeded' AND run_id IN (SELECT run_id FROM one)),
members AS (
  SELECT o.run_id, o.section, o.record_key, k.key AS name, k.value AS value
  FROM (SELECT * FROM one WHERE payload IS NOT NULL) o, LATERAL json_each(o.payload) k
  WHERE k.key <> 'scannedAt'),
flat AS (
  SELECT run_id, section, record_key, string_agg(name || '=' || coalesce(CASE
           WHEN json_type(value) IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN CAST(CAST(value AS DOUBLE) AS VARCHAR)
           WHEN json_type(value) = 'VARCHAR' THEN 's' || (value ->> '$')
           ELSE replace(CAST(value AS VARCHAR), ' ', '') END, 'null'), ';' ORDER BY name) AS v
  FROM members GROUP BY ALL),
v AS (
  SELECT n.root_id, n.n, o.section, o.record_key, CASE WHEN o.payload IS NULL THEN '(null)' ELSE coalesce(f.v, '') END AS v
  FROM one o JOIN n ON o.run_id = n.run_id LEFT JOIN flat f ON f.run_id = o.run_id AND f.section = o.section AND f.record_key = o.record_key)
SELECT n.run_id, d.section, d.record_key, d.change_kind FROM (
  SELECT root_id, n, section, record_key, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
  FROM (SELECT coalesce(c.root_id, p.root_id) AS root_id, coalesce(c.n, p.n) AS n, coalesce(c.section, p.section) AS section,
               coalesce(c.record_key, p.record_key) AS record_key, c.v AS new, p.v AS old
        FROM v c FULL JOIN (SELECT root_id, n + 1 AS n, section, record_key, v FROM v) p
          ON c.root_id = p.root_id AND c.n = p.n AND c.section = p.section AND c.record_key = p.record_key)
  WHERE new IS DISTINCT FROM old) d JOIN n ON n.root_id = d.root_id AND n.n = d.n AND n.n > 1""",
}
