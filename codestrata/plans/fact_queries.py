"""Queries over the facts that readers take from source texts, on whole tables. What a token reader finds SQL can't
say, so these have none; they are tested on small trees in ``tests/``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..session import table


def _engine(spark: SparkSession, folder: str) -> Engine:
    return Engine(spark, table(spark, folder, "documents"))


def source_facts(spark, folder) -> DataFrame:
    sizes = (F.coalesce(F.size(c), F.lit(0)).cast("long").alias(c) for c in ("imports", "exports", "symbols", "calls", "routes"))
    return _engine(spark, folder).facts.select("repo", "path", "language", "status", *sizes, F.array_join("signals", ",").alias("signals"))


def symbols(spark, folder):
    return _engine(spark, folder).symbols.select("repo", "path", "name", "kind", "exported", "is_default", F.array_join("extends", ",").alias("extends"), "line")


def symbol_edges(spark, folder):
    return _engine(spark, folder).symbol_edges


def public_exports(spark, folder):
    return _engine(spark, folder).exports


def entry_points(spark, folder):
    return _engine(spark, folder).entry_points


def module_roles(spark, folder):
    return _engine(spark, folder).roles.select("repo", "module", "rank", "role", "confidence", F.size("evidence").alias("evidence"))


def module_responsibilities(spark, folder):
    return _engine(spark, folder).responsibilities


def repository_conventions(spark, folder):
    return _engine(spark, folder).conventions.select("repo", "rank", "id", "category", "statement", "confidence", "origin")


def repository_decisions(spark, folder):
    return _engine(spark, folder).decisions.select("repo", "id", "title", "status", "source", "origin", "kind", "confidence")


def repository_issues(spark, folder):
    return _engine(spark, folder).issues.select("repo", "kind", "severity", "count", "subject", "detail")


def analysis_coverage(spark, folder):
    return _engine(spark, folder).coverage


QUERIES = {f.__name__: f for f in (source_facts, symbols, symbol_edges, public_exports, entry_points, module_roles, module_responsibilities, repository_conventions, repository_decisions, repository_issues, analysis_coverage)}
SQL: dict[str, str] = {}
