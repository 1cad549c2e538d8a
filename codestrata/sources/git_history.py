"""Version history as tables: the text that ``git log`` and ``git diff`` print, parsed with Columns.

The commands run on the driver, where the checkouts are, some at a time; of their output each commit is a row. A missing
git or history is reported, never an error; one that takes too long is a warning."""

from __future__ import annotations

import subprocess
import warnings
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD, FIELD = "\x1e", "\x1f"
FORMAT = "%x1e%H%x1f%an%x1f%aI%x1f%s"


@dataclass
class Git:
    root: str
    timeout: int = 20

    def run(self, *args: str) -> str | None:
        try:
            done = subprocess.run(["git", "-c", "safe.directory=*", "-C", self.root, *args], capture_output=True, text=True, errors="replace", timeout=self.timeout)
        except subprocess.TimeoutExpired:
            warnings.warn(f"git {args[0]} in {self.root} took more than {self.timeout} s; what it would tell is left out", stacklevel=2)
            return None
        except OSError:
            return None
        return done.stdout if done.returncode == 0 else None

    def probe(self) -> dict:
        """Whether there is a history here, and where it stands."""
        if self.run("rev-parse", "--is-inside-work-tree") is None:
            return {"available": False, "reason": "not a git repository, or git is missing"}
        head, branch = self.run("rev-parse", "HEAD"), self.run("rev-parse", "--abbrev-ref", "HEAD")
        return {"available": head is not None, "head": (head or "").strip() or None, "branch": (branch or "").strip() or None, "reason": None if head else "repository has no commits yet"}

    def log(self, window_days: int = 180, most: int = 5000, revision: str | None = None) -> str:
        since = [f"--since={window_days}.days.ago"] if window_days > 0 else []
        return self.run("log", *since, f"--max-count={most}", *([revision] if revision else []), f"--format={FORMAT}", "--name-only", "--date-order") or ""

    def diff(self, revision: str, base: str = "HEAD") -> str:
        return self.run("diff", "--name-status", "--find-renames", base, revision) or ""


def parse_log(logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(commits: repo, sha, author, ts, subject; commit files: repo, sha, path) of rows ``repo, log``."""
    chunk = logs.select("repo", F.explode(F.split("log", RECORD)).alias("c")).filter("trim(c) <> ''").select("repo", F.split(F.regexp_replace("c", r"^\s+", ""), "\n").alias("l"))
    h = F.split(F.col("l")[0], FIELD)
    c = chunk.filter(F.size(h) >= 3).select("repo", F.trim(h[0]).alias("sha"), F.trim(h[1]).alias("author"), F.to_timestamp(h[2]).alias("ts"), F.trim(F.array_join(F.slice(h, 4, 1000), FIELD)).alias("subject"), F.slice("l", 2, 1_000_000).alias("l"))
    path = F.replace(F.trim("p"), F.lit("\\"), F.lit("/"))
    return c.select("repo", "sha", "author", "ts", "subject"), c.select("repo", "sha", F.explode("l").alias("p")).select("repo", "sha", path.alias("path")).filter("path <> ''").distinct()


def parse_diff(diffs: DataFrame) -> DataFrame:
    """``repo, path, status, old_path`` of rows ``repo, diff``; renames and copies carry the old path."""
    p = F.split("line", "\t")
    line = diffs.select("repo", F.explode(F.split("diff", "\n")).alias("line")).select("repo", F.trim("line").alias("line")).filter("line LIKE '%\t%'")
    code = F.substring(p[0], 1, 1)
    status = F.when(code == "A", "added").when(code == "D", "deleted").when(code == "R", "renamed").when(code == "C", "copied").otherwise("modified")
    moved = status.isin("renamed", "copied") & (F.size(p) >= 3)
    posix = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    return line.select("repo", posix(F.when(moved, F.get(p, F.lit(2))).otherwise(p[1])).alias("path"), status.alias("status"), F.when(moved, posix(p[1])).alias("old_path"))


def read_history(spark: SparkSession, roots: dict[str, str], window_days: int = 180, most: int = 5000) -> tuple[DataFrame, DataFrame]:
    with ThreadPoolExecutor(8) as pool:
        logs = list(pool.map(lambda root: Git(root).log(window_days, most), roots.values()))
    rows = [(repo, RECORD + c) for repo, log in zip(roots, logs) for c in log.split(RECORD) if c.strip()]
    return parse_log(spark.createDataFrame(rows, "repo string, log string"))
