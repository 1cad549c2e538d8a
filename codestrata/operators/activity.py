"""Change activity from commits: per file and per module, with buckets by quantiles of the repository."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.secret_rules import redact
from ..functions.words import truncate

# Parts of subjects that hint at a change of architecture.
ARCHITECTURE = ("refactor", "architecture", "adr", "breaking", "migrat", "restructure", "rewrite")


def nearest_rank(counts: DataFrame, by: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Per group the value at place ``round(f * (n - 1))`` of the sorted values, for each named fraction. Values are
    counted before they are shuffled, and running sums of the counts give the places: a group takes part with its
    distinct values, not with its rows. Null values aren't counted."""
    n = counts.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_k"))
    w = W.partitionBy(*by)
    upto = F.sum("_k").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = n.withColumns({"_to": upto, "_n": F.sum("_k").over(w)})
    place = lambda f: F.floor(f * (F.col("_n") - 1) + 0.5)
    met = lambda f: (F.col("_to") > place(f)) & (F.col("_to") - F.col("_k") <= place(f))
    return placed.groupBy(*by).agg(*(F.max(F.when(met(f), F.col(value))).alias(name) for name, f in fractions.items()))


def bucket(count: Column, low: Column, high: Column) -> Column:
    """none, low, medium or high; the high threshold is tested first, with floors of 1 and 2."""
    return F.when(count <= 0, "none").when(count >= F.greatest(high, F.lit(2)), "high").when(count >= F.greatest(low, F.lit(1)), "medium").otherwise("low")


def activity(touches: DataFrame, key: str, now: datetime | Column, recent_days: int = 30) -> DataFrame:
    """``repo, key, changes, recent, last_changed, authors, frequency`` of each key of ``touches`` (repo, key, sha,
    author, ts): distinct commits, those of the last days before ``now``, the last day, distinct authors."""
    start = (now if isinstance(now, Column) else F.lit(now)) - F.make_dt_interval(F.lit(recent_days))
    a = touches.groupBy("repo", key).agg(F.count_distinct("sha").alias("changes"), F.count_distinct(F.when(F.col("ts") >= start, F.col("sha"))).alias("recent"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_changed"), F.count_distinct("author").alias("authors"))
    q = nearest_rank(a, ["repo"], "changes", {"low": 0.33, "high": 0.66})
    return a.join(q, "repo").withColumn("frequency", bucket(F.col("changes"), F.col("low"), F.col("high"))).drop("low", "high")


def touches(commits: DataFrame, commit_files: DataFrame, files: DataFrame, modules: DataFrame) -> DataFrame:
    """``repo, path, module, sha, author, ts, subject`` of the known files that commits touch."""
    known = files.select("repo", "path").distinct()
    rows = commit_files.withColumn("path", F.replace("path", F.lit("\\"), F.lit("/"))).join(known, ["repo", "path"]).join(commits, ["repo", "sha"])
    return rows.join(modules.select("repo", "path", "module"), ["repo", "path"], "left").select("repo", "path", "module", "sha", "author", "ts", "subject")


def top_contributors(touched: DataFrame, key: str, most: int = 3) -> DataFrame:
    """``repo, key, rank, author, commits, touches``: by distinct commits, then name; ``touches`` counts files."""
    a = touched.groupBy("repo", key, "author").agg(F.count_distinct("sha").alias("commits"), F.count("*").alias("touches"))
    rank = F.row_number().over(W.partitionBy("repo", key).orderBy(F.desc("commits"), "author"))
    return a.withColumn("rank", rank).filter(F.col("rank") <= most).select("repo", key, "rank", "author", "commits", "touches")


def is_architectural(subject: Column, patterns: tuple[str, ...] = ARCHITECTURE) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.lower(subject).contains(p.lower())
    return out


def architecture_signals(touched: DataFrame, patterns: tuple[str, ...] = ARCHITECTURE, most: int = 5) -> DataFrame:
    """The newest commits per module whose subject hints at a change of architecture; secrets redacted."""
    rows = touched.filter(F.col("module").isNotNull() & is_architectural(F.col("subject"), patterns)).select("repo", "module", "sha", "ts", "subject").distinct()
    rank = F.row_number().over(W.partitionBy("repo", "module").orderBy(F.desc("ts"), "sha"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= most).select("repo", "module", "rank", F.substring("sha", 1, 8).alias("sha"), F.date_format("ts", "yyyy-MM-dd").alias("date"), truncate(redact(F.col("subject")), 120).alias("subject"))


def history(commits: DataFrame, commit_files: DataFrame, scope: DataFrame, limit: int = 50) -> DataFrame:
    """The newest commits that touch a file of ``scope`` (repo, path), with those files."""
    hit = commit_files.join(scope.select("repo", "path").distinct(), ["repo", "path"], "left_semi").groupBy("repo", "sha").agg(F.array_sort(F.collect_set("path")).alias("files"))
    return commits.join(hit, ["repo", "sha"]).withColumn("architectural", is_architectural(F.col("subject"))).orderBy(F.desc("ts"), "sha").limit(max(1, min(limit, 200)))
