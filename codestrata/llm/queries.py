"""Queries of the problems on texts, and SQL where it can say the same over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators.resolution import candidates
from ..session import table
from .credentials import compiled, find, redact
from .machine_written import machine_written
from .mixing import mix
from .repetition import SHARE, repetition
from .tokenizing import encode_column, vocabulary_path
from .unparsable import rates, unparsable


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return unparsable(table(spark, folder, "documents"), only_broken=True).select("doc_id")


def p2_rates(spark: SparkSession, folder: str) -> DataFrame:
    return rates(table(spark, folder, "documents"), table(spark, folder, "files"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return machine_written(table(spark, folder, "documents"), table(spark, folder, "library_files"), only_found=True).select("doc_id")


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """Why a file isn't hand-written, beside the kind the scanner gave it and the imports that called it build output."""
    d = table(spark, folder, "documents")
    why = machine_written(d, table(spark, folder, "library_files"))
    kind = table(spark, folder, "files").groupBy("repo", "path").agg(F.max(F.struct("scanned_at", "kind")).alias("f")).select("repo", "path", "f.kind")
    u = table(spark, folder, "unresolved_imports").filter("reason = 'excluded-build-output' AND specifier LIKE '.%'").select("repo", "file", "specifier").distinct()
    at = P.join_strict(P.dirname(F.col("file")), F.col("specifier"))
    told = u.select("repo", "file", at.alias("j")).filter("NOT j.escaped AND NOT j.absolute").select("repo", "file", F.explode(candidates(F.col("j.path"))).alias("path")).groupBy("repo", "path").agg(F.count_distinct("file").alias("called_output"))
    rows = d.select("doc_id", "repo", "path").join(why, "doc_id").join(kind, ["repo", "path"], "left").join(told, ["repo", "path"], "left")
    return rows.select("doc_id", "reason", "kind", F.coalesce("called_output", F.lit(0)).alias("called_output"))


def _patterns(spark: SparkSession, folder: str) -> tuple:
    """The fixed list of eight expressions."""
    return compiled(table(spark, folder, "secret_patterns").orderBy("pattern_id").collect())


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = find(table(spark, folder, "documents"), _patterns(spark, folder))
    return rows.dropDuplicates(["doc_id", "line_no"]).select("doc_id", "line_no")


def p5_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return redact(table(spark, folder, "documents"), table(spark, folder, "policies"), _patterns(spark, folder))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_column(table(spark, folder, "documents"), vocabulary_path())


def p7_draws(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), vocabulary_path())[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), vocabulary_path())[1]


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return repetition(table(spark, folder, "documents"), SHARE).select("doc_id")


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return repetition(table(spark, folder, "documents")).select("doc_id", "words", "repeated")


QUERIES = {"p2_found": p2_found, "p2_rates": p2_rates, "p4_found": p4_found, "p4_report": p4_report, "p5_found": p5_found, "p5_redacted": p5_redacted, "p6_ids": p6_ids, "p7_draws": p7_draws, "p7_shares": p7_shares, "p8_found": p8_found, "p8_shares": p8_shares}

_WORDS = r"""
w AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents)),
g AS (
  SELECT doc_id, i, CASE WHEN count(*) OVER r = 10 THEN string_agg(word, ' ') OVER r END AS gram
  FROM w WINDOW r AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
s AS (
  SELECT doc_id, i, gram IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, gram ORDER BY i) > 1 AS again FROM g),
c AS (
  SELECT doc_id, i, coalesce(bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), false) AS rep FROM s),
m AS (SELECT doc_id, count(*) AS words, count(*) FILTER (WHERE rep) AS repeated FROM c GROUP BY doc_id)"""

SQL = {
    "p8_found": f"WITH {_WORDS} SELECT doc_id FROM m WHERE words >= 10 AND repeated >= 0.4 * words",
    "p8_shares": f"WITH {_WORDS} SELECT doc_id, coalesce(words, 0) AS words, coalesce(repeated, 0) AS repeated FROM documents LEFT JOIN m USING (doc_id)",
}
