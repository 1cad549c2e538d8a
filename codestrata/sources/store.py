"""Stored tables of an engine: Parquet for tables, canonical JSON for the small documents of one repository.

A scan writes its tables and documents into a folder of its own; one small file, ``current.json``, names it. That file is
replaced as the last act, so that a reader sees all of one scan or all of the one before."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1


def canonical(value) -> str:
    """JSON with keys in order, two spaces of indentation and a newline at the end."""
    return json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False, default=str) + "\n"


class Unreadable(Exception):
    """A stored table or document that is there, but can't be read."""


class Store:
    """A folder of scans. Written is what ``begin`` .. ``commit`` enclose; read is what the last commit names."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._draft: str | None = None

    def begin(self) -> None:
        self._draft = f"scans/{uuid.uuid4().hex}"

    def commit(self, **facts) -> None:
        """Make what was written since ``begin`` the stored scan; ``facts`` go beside its name. Of the scans before, the
        last one stays, for what is still being read from it."""
        before = self.current()
        self.put_text("current.json", canonical({"schema_version": SCHEMA_VERSION, "scan": self._draft, **facts}))
        keep, self._draft = {self._draft, before and before["scan"]}, None
        for s in self._fs.listStatus(self._path(f"{self.folder}/scans")):
            if f"scans/{s.getPath().getName()}" not in keep:
                self._fs.delete(s.getPath(), True)

    def current(self) -> dict | None:
        """What the last commit says, or None where there is none or of another schema version."""
        found, _, _ = self.documents(["current.json"])
        return found.get("current.json")

    def at(self, name: str) -> str | None:
        c = self.current()
        return f"{self.folder}/{c['scan']}/{name}" if c else None

    def exists(self, name: str) -> bool:
        at = self.at(name)
        return at is not None and self._fs.exists(self._path(at))

    def write(self, name: str, rows: DataFrame, partition_by: list[str] | None = None) -> None:
        w = rows.write
        (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{self.folder}/{self._draft}/{name}")

    def read(self, name: str) -> DataFrame | None:
        """The table, or None where it is missing; Unreadable where it is there and no table."""
        if not self.exists(name):
            return None
        try:
            return self.spark.read.parquet(self.at(name))
        except AnalysisException as e:
            raise Unreadable(name) from e

    def write_facts(self, facts: DataFrame) -> None:
        """Facts by content, spread over folders by the first two digits of the hash."""
        self.write("facts_cache", facts.withColumn("shard", F.substring("hash", 1, 2)), ["shard"])

    def write_text(self, name: str, text: str) -> str:
        """Write a small document of this scan; its SHA-256."""
        return self.put_text(f"{self._draft}/{name}", text)

    def put_text(self, name: str, text: str) -> str:
        """Write a small document that belongs to no scan, by a draft that takes its place; its SHA-256."""
        jvm = self.spark._jvm
        data, target, draft = text.encode(), self._path(f"{self.folder}/{name}"), self._path(f"{self.folder}/_draft_{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(data))
        out.close()
        self._fs.mkdirs(target.getParent())
        options = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, target, options)
        return hashlib.sha256(data).hexdigest()

    def get_text(self, name: str) -> str | None:
        at = self._path(f"{self.folder}/{name}")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def documents(self, names: list[str]) -> tuple[dict, list[str], list[str]]:
        """(documents, missing, invalid): of another schema version or no JSON counts as invalid."""
        found, missing, invalid = {}, [], []
        for n in names:
            text = self.get_text(n)
            if text is None:
                missing.append(n)
                continue
            try:
                value = json.loads(text)
                if value.get("schema_version") != SCHEMA_VERSION:
                    raise ValueError
                found[n] = value
            except (ValueError, AttributeError):
                invalid.append(n)
        return found, missing, invalid

    def clear(self, keep: tuple[str, ...] = ("config.json",)) -> None:
        if self._fs.exists(self._path(self.folder)):
            for s in self._fs.listStatus(self._path(self.folder)):
                if s.getPath().getName() not in keep:
                    self._fs.delete(s.getPath(), True)
