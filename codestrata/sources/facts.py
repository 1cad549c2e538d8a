"""Source texts to tables of facts: a registry of readers by file name and extension, run where the text is read."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.packages import signals
from ..session import spread
from .documents import read_compiler, read_json, read_markdown, read_package, read_workspace
from .script_facts import read_script

_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


LISTS = {
    "imports": _struct(specifier=_S, syntax=_S, names=T.ArrayType(_S), default_import=_S, namespace_import=_S, line=_I, type_only=_B),
    "exports": _struct(name=_S, kind=_S, is_default=_B, line=_I, from_specifier=_S, type_only=_B),
    "symbols": _struct(name=_S, kind=_S, exported=_B, is_default=_B, extends=T.ArrayType(_S), implements=T.ArrayType(_S), line=_I),
    "calls": _struct(name=_S, line=_I),
    "routes": _struct(method=_S, path=_S, line=_I),
}
FACTS = T.StructType([T.StructField("repo", _S), T.StructField("path", _S), T.StructField("language", _S), T.StructField("status", _S), *(T.StructField(k, T.ArrayType(v)) for k, v in LISTS.items()), T.StructField("signals", T.ArrayType(_S)), T.StructField("metadata", _S)])

Read = Callable[[str], dict]


@dataclass
class Registry:
    """Readers: by name first, then by extension. A reader takes a text and gives a dictionary with ``status`` and
    any of the lists above; it must not raise. ``enabled`` limits the languages, those in ``always`` aside."""

    names: dict[str, tuple[str, Read]] = field(default_factory=dict)
    extensions: dict[str, tuple[str, Read]] = field(default_factory=dict)
    always: frozenset[str] = frozenset(("json", "markdown", "package-json", "tsconfig", "pnpm-workspace"))

    def find(self, path: str, enabled: tuple[str, ...] | None = None) -> tuple[str, Read] | None:
        name = path.rpartition("/")[2]
        hit = self.names.get(name)
        if hit is None and "." in name[1:]:
            hit = self.extensions.get(name[name.rindex(".") :].lower())
        if hit and enabled is not None and hit[0] not in enabled and hit[0] not in self.always:
            return None
        return hit


def default_registry() -> Registry:
    r = Registry()
    for e in (".ts", ".tsx", ".mts", ".cts"):
        r.extensions[e] = ("typescript", lambda t, j=e == ".tsx": read_script(t, j))
    for e in (".js", ".jsx", ".mjs", ".cjs"):
        r.extensions[e] = ("javascript", lambda t: read_script(t, True))
    for e in (".md", ".mdx", ".markdown"):
        r.extensions[e] = ("markdown", read_markdown)
    r.extensions[".json"] = ("json", read_json)
    r.names["package.json"] = ("package-json", read_package)
    for n in ("tsconfig.json", "tsconfig.base.json", "tsconfig.build.json", "jsconfig.json"):
        r.names[n] = ("tsconfig", read_compiler)
    r.names["pnpm-workspace.yaml"] = ("pnpm-workspace", read_workspace)
    return r


def read_facts(files: DataFrame, languages: tuple[str, ...] | None = None, registry: Callable[[], Registry] = default_registry) -> DataFrame:
    """One row of facts per file (``repo, path, text``) that a reader is known for; null texts have none.

    One narrow stage. Facts of importing known packages are added to ``signals`` as Columns. A reader that fails
    gives status failed; repeated rows are read each; further columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        known, schema = registry(), to_arrow_schema(FACTS)
        for batch in batches:
            rows, pending = [], 0
            for repo, path, text in zip(*(c for c in batch.columns)):
                p, t = path.as_py(), text.as_py()
                reader = known.find(p, languages) if p is not None and t is not None else None
                if reader is None:
                    continue
                try:
                    facts = reader[1](t)
                except Exception as e:  # a reader's fault must not end the job
                    facts = {"status": "failed", "metadata": {"error": f"{type(e).__name__}: {e}"[:200]}}
                rows.append({"repo": repo.as_py(), "path": p, "language": reader[0], "status": facts["status"], **{k: facts.get(k, []) for k in LISTS}, "signals": facts.get("signals", []), "metadata": json.dumps(facts.get("metadata", {}), sort_keys=True)})
                pending += len(t)
                if pending > 8_000_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, pending = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    read = spread(files.select("repo", "path", "text")).mapInArrow(run, FACTS)
    implied = F.flatten(F.transform("imports", lambda i: signals(i["specifier"])))
    return read.withColumn("signals", F.array_sort(F.array_distinct(F.concat("signals", implied))))


def exploded(facts: DataFrame, what: str) -> DataFrame:
    """The rows of one list, with ``repo``, ``path`` (of the file; ``route_path`` in routes) and their fields."""
    rows = facts.select("repo", "path", F.posexplode(what).alias("at", "r"))
    names = LISTS[what].names
    return rows.select("repo", "path", "at", *(F.col(f"r.{n}").alias("route_path" if n == "path" else n) for n in names))
