"""Differences between two states of the analysis: each section is one full outer join on its key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def section(name: str, before: DataFrame, now: DataFrame, key: Column, value: Column | None = None) -> DataFrame:
    """``repo, section, key, change`` (added, removed, changed). Without ``value`` nothing changes, keys come and go."""
    v = F.lit(0) if value is None else value
    b = before.select("repo", key.alias("key"), v.alias("old"), F.lit(True).alias("was")).dropDuplicates(["repo", "key"])
    n = now.select("repo", key.alias("key"), v.alias("new"), F.lit(True).alias("is")).dropDuplicates(["repo", "key"])
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return b.join(n, ["repo", "key"], "full_outer").select("repo", F.lit(name).alias("section"), "key", change.alias("change")).filter("change IS NOT NULL")


def context_diff(before: dict[str, DataFrame], now: dict[str, DataFrame]) -> DataFrame:
    """All sections that both states have: files by hash, modules by roles, entry points, edges, externals, conventions
    by statement, decisions."""
    arrow, line = lambda a, b: F.concat(a, F.lit(" -> "), b), lambda a, b: F.concat(a, F.lit(" ("), b, F.lit(")"))
    roles = lambda df: df.groupBy("repo", "module").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))
    parts = []
    for name, key, value, shape in (
        ("files", F.col("path"), F.col("hash"), None), ("modules", F.col("module"), None, None), ("roles", F.col("module"), F.col("roles"), roles), ("entry_points", line("path", "type"), None, None),
        ("module_edges", arrow("source", "target"), None, None), ("externals", F.col("name"), None, None), ("conventions", F.col("id"), F.col("statement"), None), ("decisions", F.concat("id", F.lit(" "), "title"), None, None),
    ):
        if name in before and name in now:
            b, n = (shape(x[name]) if shape else x[name] for x in (before, now))
            parts.append(section(name, b, n, key, value))
    return reduce(DataFrame.unionByName, parts)
