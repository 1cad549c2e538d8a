"""A data source that lists (and reads) the files of source trees, hidden ones and names with ``_`` included.

``spark.read.format("repo_files").option("root", …)``: one partition per directory at the top, so listing and reading
run on the executors. Directories that an exclude rule covers, or in which no include rule can fit, are not entered.
Contents are read only for files that are not sensitive and not too large, and only if the column is asked for.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.globs import ignore_lines, matcher, rules
from ..operators.files import EXCLUDE, INCLUDE, LARGEST, SENSITIVE

SCHEMA = "repo string, path string, size bigint, mtime_ms bigint, sensitive boolean, too_large boolean, text string"
MOST_FILES = 500_000


class Part(InputPartition):
    def __init__(self, repo: str, root: str, top: str):
        self.repo, self.root, self.top = repo, root, top


class RepoFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repo_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        get = lambda k, d: json.loads(options[k]) if k in options else d
        self.roots: dict[str, str] = get("roots", None) or {options.get("repo", ""): options["root"]}
        self.include, self.exclude = get("include", INCLUDE), get("exclude", EXCLUDE)
        self.ignore, self.extra = get("ignore", []), get("extrasensitive", get("extraSensitive", []))
        self.largest, self.contents = int(options.get("largest", LARGEST)), options.get("contents", "true") == "true"
        self.follow = options.get("followsymlinks", options.get("followSymlinks", "false")) == "true"
        self.allow = options.get("allowsensitive", options.get("allowSensitive", "false")) == "true"

    def partitions(self) -> list[Part]:
        out = []
        for repo, root in self.roots.items():
            tops = sorted(e.name for e in os.scandir(root) if e.is_dir(follow_symlinks=self.follow))
            out += [Part(repo, root, ""), *(Part(repo, root, t) for t in tops)]
        return out

    def read(self, part: Part) -> Iterator[tuple]:
        try:
            with open(os.path.join(part.root, ".gitignore"), encoding="utf-8", errors="replace") as f:
                ignored = [*self.ignore, *ignore_lines(f.read())]
        except OSError:
            ignored = self.ignore
        included, excluded, hidden = matcher([p + "**" if p.endswith("/") else p for p in self.include]), matcher(self.exclude), matcher(ignored)
        secret = matcher([] if self.allow else [*SENSITIVE, *self.extra])
        prefixes = [r.literal_prefix() for r in rules(self.include) if not r.negated]
        anywhere = "" in prefixes

        def below(d: str) -> bool:
            return anywhere or any(p == d or p.startswith(d + "/") or d.startswith(p + "/") for p in prefixes)

        queue, count = [part.top], 0
        if part.top and (excluded(part.top) or hidden(part.top) or not below(part.top)):
            return
        while queue:
            d = queue.pop(0)
            try:
                entries = sorted(os.scandir(os.path.join(part.root, d)), key=lambda e: e.name)
            except OSError:
                continue
            for e in entries:
                path = f"{d}/{e.name}" if d else e.name
                try:
                    if e.is_symlink() and not self.follow:
                        continue
                    if e.is_dir():
                        if part.top and not (excluded(path) or hidden(path)) and below(path):
                            queue.append(path)
                        continue
                    if not e.is_file() or excluded(path) or hidden(path):
                        continue
                    blocked = secret(path)
                    if not blocked and not included(path):
                        continue
                    s = e.stat()
                except OSError:
                    continue
                count += 1
                if count > MOST_FILES:
                    raise RuntimeError(f"more than {MOST_FILES} files below {part.root}/{part.top}; narrow include or exclude")
                large = s.st_size > self.largest
                text = None
                if self.contents and not blocked and not large:
                    try:
                        with open(e.path, encoding="utf-8", errors="replace", newline="") as f:
                            text = f.read()
                    except OSError:
                        pass
                yield part.repo, path, s.st_size, int(s.st_mtime * 1000), blocked, large, text


def read_tree(spark: SparkSession, roots: dict[str, str], contents: bool = True, **options) -> DataFrame:
    """The files of several trees, by repository name. Options as in the reader; lists are given as lists."""
    spark.dataSource.register(RepoFiles)
    r = spark.read.format("repo_files").option("roots", json.dumps(roots)).option("contents", str(contents).lower())
    for k, v in options.items():
        r = r.option(k, json.dumps(list(v)) if isinstance(v, (list, tuple)) else str(v).lower() if isinstance(v, bool) else str(v))
    return r.load()
