"""What went wrong or was left out while sources were read, as a table in one order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FIELDS = ("repo", "code", "severity", "source", "message")


def collected(parts: list[DataFrame]) -> DataFrame:
    """``repo, code, severity, source, message, rank`` of all parts (tables of FIELDS); ``rank`` orders those of a
    repository by code, source (null first) and message. Equal ones are kept once; ranks are by repository and code, so
    that a code that most files have isn't ordered with the others: ``rank`` counts within the code."""
    rows = reduce(DataFrame.unionByName, [p.select(*FIELDS) for p in parts]).distinct()
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("repo", "code").orderBy(F.asc_nulls_first("source"), "message")))


def of_files(files: DataFrame) -> DataFrame:
    """Diagnostics of file records (``repo, path, parse_status, skipped_reason, sensitive``): files that failed, that were
    read in part, that were skipped or never opened. A null status tells nothing; a null path is a source like any."""
    def part(rows: DataFrame, code: str, severity: str, message) -> DataFrame:
        return rows.select("repo", F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col("path").alias("source"), message.alias("message"))

    return collected([
        part(files.filter("parse_status = 'failed'"), "failed-parse", "warning", F.lit("no facts were read")),
        part(files.filter("parse_status = 'partial'"), "partial-parse", "info", F.lit("read in part")),
        part(files.filter("sensitive"), "sensitive-file", "info", F.lit("not opened")),
        part(files.filter("skipped_reason IS NOT NULL AND NOT coalesce(sensitive, false)"), "skipped-file", "info", F.concat(F.lit("left out: "), F.lower(F.trim("skipped_reason")))),
    ])


def of_severity(rows: DataFrame, severity: str) -> DataFrame:
    return rows.filter(F.col("severity") == severity)
