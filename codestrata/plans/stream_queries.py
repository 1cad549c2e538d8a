"""Streams over the delivered records, run to the end of what is there, written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, table
from ..streaming.change_stream import follow_changes, hourly_activity


def _drain(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives for the data that is there now, as a table in the shared folder."""
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def _state(spark: SparkSession, folder: str) -> DataFrame:
    schema = table(spark, folder, "scan_state").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/scan_state.parquet*")
    return rows.select(F.col("root_id").cast("string").alias("repo"), "path", "hash", "arrived_at")


def streamed_changes(spark: SparkSession, folder: str) -> DataFrame:
    out = _drain(spark, follow_changes(_state(spark, folder)))
    return out.select("repo", "path", "change", "hash", F.col("arrived_at").cast("timestamp_ntz").alias("arrived_at"))


def streamed_activity(spark: SparkSession, folder: str) -> DataFrame:
    """Records per hour and root of the hours that are complete."""
    out = _drain(spark, hourly_activity(_state(spark, folder)))
    return out.select("repo", F.col("window.start").cast("timestamp_ntz").alias("hour"), "records")


QUERIES = {f.__name__: f for f in (streamed_changes, streamed_activity)}

SQL = {
    "streamed_changes": """SELECT repo, path, CASE WHEN n = 1 THEN 'added' ELSE 'modified' END AS change, hash, arrived_at FROM (
  SELECT CAST(root_id AS VARCHAR) AS repo, path, hash, arrived_at, row_number() OVER w AS n, lag(hash) OVER w AS old FROM scan_state WHERE path IS NOT NULL AND arrived_at IS NOT NULL
  WINDOW w AS (PARTITION BY root_id, path ORDER BY arrived_at, hash NULLS LAST)) WHERE n = 1 OR hash IS DISTINCT FROM old""",
    "streamed_activity": """SELECT repo, hour, count(*) AS records FROM (SELECT CAST(root_id AS VARCHAR) AS repo, date_trunc('hour', arrived_at) AS hour FROM scan_state)
WHERE hour + INTERVAL 1 HOUR <= (SELECT max(arrived_at) - INTERVAL 1 HOUR FROM scan_state) GROUP BY ALL""",
}
