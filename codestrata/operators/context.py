"""Bounded answers about a repository: what a target is, what it depends on, what a change touches, what a task needs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions import paths as P
from .graph import between, reachable
from .modules import neighbour_lists

COMPACT_BELOW = 8192


@dataclass
class Tables:
    """The tables that answers are made from; each has a ``repo`` column."""

    files: DataFrame
    facts: DataFrame
    symbols: DataFrame
    modules: DataFrame
    file_edges: DataFrame
    module_edges: DataFrame
    externals: DataFrame
    exports: DataFrame
    entry_points: DataFrame
    roles: DataFrame
    responsibilities: DataFrame
    conventions: DataFrame
    decisions: DataFrame
    packages: DataFrame


def resolve_target(t: Tables, repo: str, target: str) -> Row | None:
    """``module, path, matched, scope`` of what a text means: module id, file, package, name, directory, containing
    module, prefix of an id; the first that fits, of several the longest or least. One row comes back."""
    import posixpath

    target = posixpath.normpath(target.replace("\\", "/")).removeprefix("./").strip("/") if target else ""
    if target in ("", "."):
        return None
    m = t.modules.filter(F.col("repo") == repo)
    ids = m.select("module", "basis", "directory").distinct()
    name = F.when(F.col("basis") == "single-file", P.stem(F.col("module"))).otherwise(P.basename(F.col("directory")))
    none = F.lit(None).cast("string")

    def row(df, rank, what, order, path=none, scope=none):
        return df.select(F.lit(rank).alias("rank"), order.alias("order"), "module", path.alias("path"), F.lit(what).alias("matched"), scope.alias("scope"))

    pk = t.packages.filter((F.col("repo") == repo) & (F.col("name") == target)).select(F.col("name").alias("pn"), F.col("directory").alias("pd"))
    found = row(ids.filter(F.col("module") == target), 1, "module id", F.lit(""))
    for part in (
        row(m.filter(F.col("path") == target), 2, "file path", F.lit(""), F.lit(target)),
        row(ids.join(F.broadcast(pk), (F.col("module") == F.col("pn")) | (F.col("directory") == F.col("pd"))), 3, "workspace package name", F.col("module")),
        row(ids.filter((name == target) | F.col("module").endswith("/" + target)), 4, "module name", F.col("module")),
        row(m.filter(F.col("path").startswith(target + "/")), 5, "directory scope", F.col("path"), none, F.lit(target)),
        row(ids.filter((F.col("directory") != "") & P.is_inside(F.col("directory"), F.lit(target))), 6, "module directory", F.lpad((1_000_000 - F.length("directory")).cast("string"), 8, "0")),
        row(ids.filter(F.col("module").startswith(target)), 7, "module id prefix", F.col("module")),
    ):
        found = found.unionByName(part)
    return found.orderBy("rank", "order", "module").limit(1).first()


def scope_of(t: Tables, repo: str, target: Row) -> DataFrame:
    """``repo, path, module, kind``: the files that an answer is about."""
    m = t.modules.filter(F.col("repo") == repo)
    inside = F.col("path").startswith(target.scope + "/") if target.scope else F.col("module") == target.module
    return m.filter(inside).select("repo", "path", "module", "kind")


def scope_neighbours(t: Tables, scope: DataFrame, outgoing: bool) -> DataFrame:
    """``repo, module, relationships, files``: other modules that the files use, or that use them."""
    own, other = ("source", "target") if outgoing else ("target", "source")
    s = scope.select("repo", F.col("path").alias(own), F.col("module").alias("own"))
    e = t.file_edges.filter("target_kind = 'file'").select("repo", "source", "target", "relationship").join(s, ["repo", own])
    e = e.join(t.modules.select("repo", F.col("path").alias(other), "module"), ["repo", other]).filter("module <> own")
    return e.groupBy("repo", "module").agg(F.array_sort(F.collect_set("relationship")).alias("relationships"), F.count_distinct("source", "target").alias("files"))


def explain(t: Tables, repo: str, target: str, detail: str = "auto", threshold: int = COMPACT_BELOW, most: int = 100) -> dict[str, DataFrame] | None:
    """The parts of an explanation as tables, or None where nothing fits the target. Compact (small sources, or asked
    for): one piece of evidence, no internal symbols, only facts about the files themselves."""
    hit = resolve_target(t, repo, target)
    if hit is None:
        return None
    spark = t.modules.sparkSession
    scope = scope_of(t, repo, hit)
    of = F.col("repo") == repo
    size = t.files.filter(of).join(scope.select("repo", "path"), ["repo", "path"], "left_semi").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    compact = detail == "compact" or detail == "auto" and size < threshold
    budget = 1 if compact else 2
    in_module = of & (F.col("module") == hit.module)
    edges = t.module_edges.filter(of)
    start = spark.createDataFrame([(repo, hit.module)], "repo string, node string")
    if hit.scope:
        near = scope_neighbours(t, scope, False).select("repo", F.col("module").alias("node")).filter(F.col("node") != hit.module)
        impact = near.select("node").union(reachable(edges, near, 3, reverse=True).select("node")).filter(F.col("node") != hit.module).distinct()
        touched = t.file_edges.filter(of & (F.col("target_kind") == "file")).join(scope.select("repo", F.col("path").alias("target")), ["repo", "target"], "left_semi").select(F.col("source").alias("path")).distinct()
        depends, used = scope_neighbours(t, scope, True), scope_neighbours(t, scope, False)
    else:
        impact = reachable(edges, start, 3, reverse=True).select("node")
        touched = t.modules.filter(of).join(impact.withColumnRenamed("node", "module"), "module", "left_semi").select("path")
        pairs = edges.filter((F.col("source") == hit.module) | (F.col("target") == hit.module)).select("repo", "source", "target")
        b = between(t.file_edges.filter(of), pairs, t.modules.filter(of))
        depends = b.filter(F.col("source") == hit.module).select("repo", F.col("target").alias("module"), "relationships", "files")
        used = b.filter(F.col("target") == hit.module).select("repo", F.col("source").alias("module"), "relationships", "files")
    paths = scope.select("repo", "path")
    ext = t.file_edges.filter(of & (F.col("target_kind") == "package")).join(paths.withColumnRenamed("path", "source"), ["repo", "source"], "left_semi").groupBy("repo", F.col("target").alias("name")).agg(F.count("*").alias("count"))
    ext = ext.join(t.externals.select("repo", "name", "scope", "importance", "confidence"), ["repo", "name"], "left")
    from ..functions.packages import is_builtin

    public = t.exports.filter(in_module).join(paths, ["repo", "path"], "left_semi")
    inner = t.symbols.filter(of).join(paths, ["repo", "path"], "left_semi").join(public.select("repo", "path", "name"), ["repo", "path", "name"], "left_anti").select("path", "name", "kind", "line")
    said = t.conventions.filter(of).withColumn("file", F.explode("evidence")).join(paths.withColumnRenamed("path", "file"), ["repo", "file"], "left_semi").select("id", "category", "statement", "confidence").distinct()
    out = {
        "target": spark.createDataFrame([(repo, hit.module, hit.path, hit.matched, hit.scope, "compact" if compact else "full", int(size))], "repo string, module string, path string, matched string, scope string, detail string, source_bytes bigint"),
        "roles": t.roles.filter(in_module).withColumn("evidence", F.slice("evidence", 1, budget)).orderBy("rank"),
        "responsibilities": t.responsibilities.filter(in_module & ~F.col("statement").startswith("role: ")).orderBy("rank"),
        "entry_points": t.entry_points.filter(of).join(paths, ["repo", "path"], "left_semi").orderBy("path", "type"),
        "depends_on": depends.orderBy("module"),
        "used_by": used.orderBy("module"),
        "externals": ext.orderBy(is_builtin(F.col("name")), F.desc("confidence"), F.desc("count"), "name"),
        "public_api": public.orderBy("name"),
        "internal_symbols": inner.orderBy("path", "line").limit(0 if compact else 40),
        "conventions": said.orderBy("category", "statement").limit(6),
        "decisions": t.decisions.filter(of).join(paths.withColumnRenamed("path", "file"), F.substring_index("source", "#", 1) == F.col("file"), "left_semi").orderBy("id").limit(5),
        "tests": scope.filter("kind = 'test'").select("path").orderBy("path"),
        "impact_modules": impact.orderBy("node"),
        "impact_files": touched.distinct().orderBy("path").limit(most),
        "files": paths.select("path").orderBy("path"),
    }
    return out


def repository_overview(t: Tables, repo: str | None = None, modules: int = 25, externals: int = 25, entries: int = 30) -> dict[str, DataFrame]:
    """Counts, the most important modules (used by ten times, then files), packages by class and use, entry points."""
    f = lambda df: df if repo is None else df.filter(F.col("repo") == repo)
    files, mods = f(t.files), f(t.modules)
    n = neighbour_lists(f(t.module_edges))
    m = mods.groupBy("repo", "module", "basis", "directory").agg(F.count("*").alias("files")).join(n, ["repo", "module"], "left")
    score = F.coalesce("used_by_n", F.lit(0)) * 10 + F.col("files")
    from ..functions.packages import is_builtin

    rank = F.when(F.col("importance") == "infrastructure", 3).when(F.col("importance") == "framework", 2).when(F.col("importance") == "tooling", 1).otherwise(0) * 1000 + F.col("modules") - F.when(is_builtin(F.col("name")), 10_000).otherwise(0)
    return {
        "counts": files.groupBy("repo").agg(F.count("*").alias("files"), F.count_if(F.col("kind") == "source").alias("sources"), F.count_if(F.col("kind") == "test").alias("tests"), F.count_if("sensitive").alias("sensitive")),
        "modules": m.withColumn("score", score).orderBy(F.desc("score"), "module").limit(max(1, min(modules, 100))),
        "externals": f(t.externals).withColumn("rank", rank).orderBy(F.desc("rank"), "name").limit(max(1, min(externals, 200))),
        "entry_points": f(t.entry_points).orderBy(F.desc("confidence"), "path").limit(max(1, min(entries, 200))),
        "conventions": f(t.conventions).orderBy("rank"),
        "decisions": f(t.decisions).orderBy(F.col("origin") != "explicit", "id"),
    }


def revision_counts(t: Tables, repo: str, paths: list[str]) -> Row:
    """How much of the current tables a commit's files touch: modules, module edges (by their modules), entry points,
    decisions."""
    spark = t.modules.sparkSession
    c = spark.createDataFrame([(repo, p) for p in paths], "repo string, path string")
    mods = t.modules.join(c, ["repo", "path"], "left_semi").select("repo", "module").distinct()
    edges = t.module_edges.join(mods, (t.module_edges.repo == mods.repo) & ((t.module_edges.source == mods.module) | (t.module_edges.target == mods.module)), "left_semi")
    own = F.substring_index("source", "#", 1).alias("path")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(mods, "modules").crossJoin(count(edges, "edges")).crossJoin(count(t.entry_points.join(c, ["repo", "path"], "left_semi"), "entry_points")).crossJoin(count(t.decisions.select("repo", own).join(c, ["repo", "path"], "left_semi"), "decisions")).first()
