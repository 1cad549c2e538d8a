"""File records as a stream: each delivery is compared with the last known record of its file.

The batch operator (``operators.files.changes``) needs both listings; here listings arrive in pieces. State per
(repo, path) is the last hash, size and time; the first record of a file is an addition, a later one with another
hash a modification. A record older than the last one of its file is ignored, so late deliveries don't turn back time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "repo string, path string, change string, hash string, arrived_at timestamp"
STATE = "hash string, at bigint"


def _follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    known, at = state.get if state.exists else (None, None)
    rows = pd.concat(list(batches)).sort_values(["arrived_at", "hash"], kind="stable")  # deliveries of one file in one trigger
    out = []
    for hash_, when in zip(rows["hash"], rows["arrived_at"]):
        micros = int(pd.Timestamp(when).value // 1000)
        hash_ = None if pd.isna(hash_) else hash_
        if at is not None and micros < at:
            continue
        if at is None or hash_ != known:
            out.append((key[0], key[1], "added" if at is None else "modified", hash_, when))
        known, at = hash_, micros
    if at is not None:
        state.update((known, at))
    yield pd.DataFrame(out, columns=["repo", "path", "change", "hash", "arrived_at"])


def follow_changes(records: DataFrame) -> DataFrame:
    """Additions and modifications of a stream of records (repo, path, hash, arrived_at)."""
    rows = records.select("repo", "path", "hash", F.col("arrived_at").cast("timestamp").alias("arrived_at")).filter("path IS NOT NULL AND arrived_at IS NOT NULL")
    return rows.groupBy("repo", "path").applyInPandasWithState(_follow, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def hourly_activity(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Records per hour and repository, late ones up to a limit."""
    t = events.withColumn("at", F.col("arrived_at").cast("timestamp")).withWatermark("at", late)
    return t.groupBy(F.window("at", "1 hour"), "repo").agg(F.count("*").alias("records"))
