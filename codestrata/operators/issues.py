"""What an analysis could not determine: issues by kind and severity with samples, and coverage ratios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import fold

#: Modules of a cycle that are named.
SHOWN = 12
BUILD_OUTPUT = r"(?:^|/)(?:dist|build|out|lib|coverage|node_modules|vendor|target)(?:/|$)"
# Cause, kind, severity, text.
KINDS = (
    ("path-escape", "path-escape", "error", "imports that lead out of the repository; not followed"), ("unresolved-alias", "unresolved-alias", "error", "imports through a path alias for which no file was found"), ("missing", "unresolved-import", "warning", "imports for which no file was found; the graph lacks these edges"),
    ("excluded-build-output", "unresolved-import", "info", "imports of build output, which is left out on purpose"), ("excluded-file", "excluded-file", "info", "imports of files that are there but weren't read"), ("failed", "failed-parse", "warning", "files that no reader could read"),
    ("partial", "partial-parse", "info", "files read in part; some of their facts may be missing"), ("sensitive", "sensitive-skipped", "info", "sensitive files, which are never opened"), ("cycle", "import-cycle", "warning", "groups of modules that need each other"),
    ("layering", "layering-violation", "warning", "modules that use a layer they shouldn't know"), ("isolated", "module-without-dependencies", "info", "modules without any edge; some of theirs are probably missing"),
)


def causes(unresolved: DataFrame) -> DataFrame:
    """``repo, cause, subject`` of unresolved imports; an escape is one whatever its path looks like."""
    cause = F.when(F.col("reason") == "path-escape", "path-escape").when(F.col("specifier").rlike(BUILD_OUTPUT), "excluded-build-output").otherwise(F.coalesce("reason", F.lit("missing")))
    return unresolved.select("repo", cause.alias("cause"), F.concat("file", F.lit(" -> "), "specifier").alias("subject"))


def subjects(unresolved: DataFrame, files: DataFrame, facts: DataFrame, cycles: DataFrame, layering: DataFrame, modules: DataFrame, edges: DataFrame) -> DataFrame:
    """``repo, cause, subject`` of everything that is worth telling."""
    row = lambda df, cause, subject: df.select("repo", F.lit(cause).alias("cause"), subject.alias("subject"))
    linked = edges.select("repo", F.col("source").alias("module")).union(edges.select("repo", "target")).distinct()
    size = cycles.groupBy("repo", "component").agg(F.count("*").alias("n"))
    first = cycles.withColumn("r", F.row_number().over(W.partitionBy("repo", "component").orderBy("node"))).filter(F.col("r") <= SHOWN)
    ring = first.groupBy("repo", "component").agg(F.array_join(F.array_sort(F.collect_list("node")), " -> ").alias("s")).join(size, ["repo", "component"])
    ring = ring.withColumn("s", F.when(F.col("n") > SHOWN, F.concat("s", F.lit(" .. "), F.col("n").cast("string"), F.lit(" modules"))).otherwise(F.col("s")))
    parts = [
        causes(unresolved), row(facts.filter("status = 'failed'"), "failed", F.col("path")), row(facts.filter("status = 'partial'"), "partial", F.col("path")), row(files.filter("sensitive"), "sensitive", F.col("path")), row(ring, "cycle", F.col("s")),
        row(layering, "layering", F.concat("source", F.lit(" -> "), "target", F.lit(" ("), "kind", F.lit(")"))), row(modules.select("repo", "module").distinct().join(linked, ["repo", "module"], "left_anti"), "isolated", F.col("module")),
    ]
    return reduce(DataFrame.unionByName, parts)


def issues(rows: DataFrame) -> DataFrame:
    """``repo, kind, severity, rank, count, subject, samples, detail``; errors rank 0, warnings 1, infos 2."""
    kinds = F.broadcast(rows.sparkSession.createDataFrame(list(KINDS), "cause string, kind string, severity string, detail string"))
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return fold(rows, ["repo", "cause"]).join(kinds, "cause").select("repo", "kind", "severity", rank.alias("rank"), "count", "subject", "samples", "detail")


def coverage(files: DataFrame, facts: DataFrame, unresolved: DataFrame, edges: DataFrame, resolved: DataFrame) -> DataFrame:
    """Per repository: files, parsed share, module edges against misses, and the share of imports that resolved."""
    one = lambda df, *aggs: df.groupBy("repo").agg(*aggs)
    f = one(files, F.count("*").alias("files"), F.count_if("sensitive").alias("sensitive"))
    p = one(facts, F.count("*").alias("parsed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "partial").alias("partial"))
    u = one(causes(unresolved), F.count_if(F.col("cause").isin("missing", "unresolved-alias")).alias("misses"), F.count_if(F.col("cause") == "path-escape").alias("escapes"), F.count_if(F.col("cause").isin("excluded-file", "excluded-build-output")).alias("excluded"))
    e = one(edges, F.count("*").alias("module_edges"))
    i = one(resolved, F.count("*").alias("imports"), F.count_if(F.col("kind") != "unresolved").alias("resolved"))
    j = f.join(p, "repo", "left").join(u, "repo", "left").join(e, "repo", "left").join(i, "repo", "left").na.fill(0)
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(1.0)), 4)
    return j.withColumns({"parsed_share": share(F.col("parsed"), F.col("files")), "resolution_rate": share(F.col("module_edges"), F.col("module_edges") + F.col("misses")), "import_resolution_rate": share(F.col("resolved"), F.col("imports"))})
