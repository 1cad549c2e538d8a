"""Modules of repositories: which directories are modules, which file belongs to which, edges between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths as P

ENTRY_NAME = r"^(index|mod)\.[cm]?[jt]sx?$"
MOST_EXPORTS = 40


def prefixes(path):
    """The root, all directories above the path, and the path itself."""
    return F.concat(F.array(F.lit("")), P.ancestors(path), F.array(path))


def longest_prefix(rows: DataFrame, path: str, directories: DataFrame, value: str) -> DataFrame:
    """``rows`` with ``value`` of the longest of ``directories`` (repo, directory, value) that holds ``path``, by
    joining each ancestor; null where none does. Needs repo and path to name a row."""
    own = rows.select("repo", path).distinct()
    d = directories.select(F.col("repo").alias("_r"), F.col("directory").alias("_d"), F.col(value).alias("_v"))
    met = own.select("repo", path, F.explode(prefixes(F.col(path))).alias("up")).join(d, (F.col("repo") == F.col("_r")) & (F.col("up") == F.col("_d")))
    best = met.groupBy("repo", path).agg(F.max(F.struct(F.length("up").alias("n"), "_v")).alias("b")).select("repo", path, F.col("b._v").alias(value))
    return rows.join(best, ["repo", path], "left")


def build_modules(files: DataFrame, packages: DataFrame, depth: int = 2) -> DataFrame:
    """``repo, path, kind, module, basis, directory, package`` of each source and test file.

    Candidates: workspace packages, directories with an index or mod file, directories of two files or more up
    to ``depth`` below their package; of one directory the first of these. The longest candidate that holds a
    file is its module; else the file is one of its own. A package's name that another package has too gives way
    to its directory. Null paths are left out; repeated rows count once."""
    f = files.filter("kind IN ('source', 'test') AND path IS NOT NULL").select("repo", "path", "kind").dropDuplicates(["repo", "path"]).withColumn("dir", P.dirname(F.col("path")))
    spaces = packages.select("repo", F.col("name").alias("package"), F.col("directory")).dropDuplicates(["repo", "directory"])
    named = F.row_number().over(W.partitionBy("repo", "package").orderBy("directory"))
    ids = spaces.withColumn("n", named).select("repo", "directory", F.lit(1).alias("rank"), F.lit("workspace-package").alias("basis"), F.when(F.col("n") == 1, F.col("package")).otherwise(F.col("directory")).alias("module"), "package")
    dirs = f.groupBy("repo", F.col("dir").alias("directory")).agg(F.count("*").alias("n"), F.max(P.basename(F.col("path")).rlike(ENTRY_NAME)).alias("entry"))
    owned = longest_prefix(dirs, "directory", spaces.withColumn("owner", F.struct(F.col("directory").alias("root"), "package")), "owner").withColumn("root", F.coalesce("owner.root", F.lit(""))).withColumn("package", F.col("owner.package"))
    below = F.when(F.col("directory") == "", 0).otherwise(P.depth(F.coalesce(P.relative_to(F.col("root"), F.col("directory")), F.col("directory"))))
    below = F.when(F.col("directory") == F.col("root"), 0).otherwise(below)
    index = owned.filter("entry AND directory <> root").select("repo", "directory", F.lit(2).alias("rank"), F.lit("index-file").alias("basis"), F.col("directory").alias("module"), "package")
    plain = owned.filter((F.col("n") >= 2) & below.between(1, depth)).select("repo", "directory", F.lit(3).alias("rank"), F.lit("directory").alias("basis"), F.col("directory").alias("module"), "package")
    best = ids.unionByName(index).unionByName(plain).groupBy("repo", "directory").agg(F.min(F.struct("rank", "basis", "module", "package")).alias("b"))
    found = longest_prefix(f, "path", best.select("repo", "directory", F.struct("b.basis", "b.module", "b.package", F.col("directory").alias("at")).alias("m")), "m")
    return found.select("repo", "path", "kind", F.coalesce("m.module", "path").alias("module"), F.coalesce("m.basis", F.lit("single-file")).alias("basis"), F.coalesce("m.at", "dir").alias("directory"), F.col("m.package").alias("package"))


def file_edges(imports: DataFrame, resolved: DataFrame) -> DataFrame:
    """``repo, source, target, target_kind, relationship, kind, specifier, syntax, confidence, evidence`` of each import
    that resolved; re-exports are ``exports``, everything else ``imports``."""
    one = imports.select("repo", "path", "specifier", "syntax").distinct()
    to = F.when(F.col("kind") == "internal-file", "file").when(F.col("kind") == "workspace-package", "module").otherwise("package")
    rows = one.join(resolved.filter("kind <> 'unresolved'"), ["repo", "path", "specifier"])
    return rows.select("repo", F.col("path").alias("source"), "target", to.alias("target_kind"), F.when(F.col("syntax") == "reexport", "exports").otherwise("imports").alias("relationship"), "kind", "specifier", "syntax", "confidence", "evidence")


def symbol_edges(facts_calls: DataFrame, symbols: DataFrame, names: DataFrame, resolved: DataFrame) -> DataFrame:
    """Calls, extends and implements edges, only for names that the file imports from a file that declares them.

    ``facts_calls``: repo, path, name. ``symbols``: repo, path, name, extends, implements. ``names``: repo, path, name,
    specifier (see ``imported_names``)."""
    inside = resolved.filter("kind = 'internal-file'").select("repo", "path", "specifier", "target")
    bound = names.join(inside, ["repo", "path", "specifier"]).select("repo", "path", F.col("name").alias("used"), "target")
    declared = symbols.select("repo", F.col("path").alias("target"), F.col("name").alias("used")).distinct()
    meant = bound.join(declared, ["repo", "target", "used"])
    calls = facts_calls.select("repo", "path", F.col("name").alias("used")).distinct().withColumn("source", F.col("path")).withColumn("relationship", F.lit("calls")).withColumn("confidence", F.lit(0.6))
    heir = lambda c: symbols.select("repo", "path", F.concat("path", F.lit("#"), "name").alias("source"), F.explode(c).alias("used")).distinct().withColumn("relationship", F.lit(c)).withColumn("confidence", F.lit(0.62))
    uses = calls.unionByName(heir("extends")).unionByName(heir("implements"))
    return uses.join(meant, ["repo", "path", "used"]).select("repo", "source", F.concat("target", F.lit("#"), "used").alias("target"), "relationship", "confidence")


def imported_names(imports: DataFrame) -> DataFrame:
    """Local names and the specifier they come from: namespace and default bindings first, then by place."""
    each = F.array_compact(F.concat(F.array(F.struct(F.col("namespace_import").alias("name"), F.lit(0).alias("rank")), F.struct(F.col("default_import").alias("name"), F.lit(0).alias("rank"))), F.transform("names", lambda n: F.struct(n.alias("name"), F.lit(1).alias("rank")))))
    rows = imports.select("repo", "path", "specifier", "at", F.explode(each).alias("n")).filter("n.name IS NOT NULL")
    # a binding overwrites what came before, a named import only fills a gap: the last binding, else the first name
    rank = F.struct(F.col("n.rank").alias("rank"), F.when(F.col("n.rank") == 0, -F.col("at")).otherwise(F.col("at")).alias("at"), "specifier")
    return rows.groupBy("repo", "path", F.col("n.name").alias("name")).agg(F.min(rank).alias("b")).select("repo", "path", "name", F.col("b.specifier").alias("specifier"))


def module_edges(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Edges between modules: ``repo, source, target, files, relationships, kinds, evidence`` (a summary and the first
    four by file and specifier), without edges inside a module."""
    m = modules.select("repo", "path", "module")
    lifted = edges.filter("target_kind IN ('file', 'module')").join(m.withColumnsRenamed({"path": "source", "module": "from"}), ["repo", "source"])
    to = lifted.join(m.withColumnsRenamed({"path": "target", "module": "to"}), ["repo", "target"], "left").withColumn("to", F.when(F.col("target_kind") == "module", F.col("target")).otherwise(F.col("to"))).filter("to IS NOT NULL AND from <> to")
    # per file first, so that what is gathered per pair is bounded: the four least items of the files, map-side
    item = F.struct(F.col("source").alias("file"), "specifier", F.col("evidence").alias("detail"))
    ranked = to.withColumn("n", F.row_number().over(W.partitionBy("repo", "from", "to").orderBy("source", "specifier", "evidence", "relationship")))
    out = ranked.withColumn("item", item).groupBy("repo", "from", "to").agg(F.count_distinct("source").alias("files"), F.array_sort(F.collect_set("relationship")).alias("relationships"), F.array_sort(F.collect_set("kind")).alias("kinds"), F.array_sort(F.collect_list(F.when(F.col("n") <= 4, F.col("item")))).alias("e"))
    head = F.struct(F.col("from").alias("source"), F.concat(F.col("files").cast("string"), F.lit(" files use "), F.col("to")).alias("detail"))
    evidence = F.concat(F.array(head), F.transform("e", lambda x: F.struct(x["file"].alias("source"), x["detail"].alias("detail"))))
    return out.select("repo", F.col("from").alias("source"), F.col("to").alias("target"), "files", "relationships", "kinds", evidence.alias("evidence"))


def externals(edges: DataFrame, modules: DataFrame, declared: DataFrame) -> DataFrame:
    """Imported packages and built-ins: ``repo, name, scope, declared_by, files, modules, importance, confidence, undeclared``.
    ``declared``: repo, package, dependency, scope (runtime, peer, development; of several the strongest)."""
    from ..functions.packages import importance

    used = edges.filter("target_kind = 'package'").join(modules.select("repo", F.col("path").alias("source"), "module"), ["repo", "source"], "left")
    a = used.groupBy("repo", F.col("target").alias("name")).agg(F.max(F.col("kind") == "node-builtin").alias("builtin"), F.count_distinct("source").alias("files"), F.count_distinct("module").alias("modules"))
    rank = F.when(F.col("scope") == "runtime", 3).when(F.col("scope") == "peer", 2).otherwise(1)
    d = declared.groupBy("repo", F.col("dependency").alias("name")).agg(F.max(F.struct(rank.alias("r"), "scope")).alias("s"), F.array_sort(F.collect_set("package")).alias("declared_by"))
    j = a.join(d, ["repo", "name"], "left").withColumn("scope", F.when(F.col("builtin"), "runtime").otherwise(F.coalesce("s.scope", F.lit("runtime"))))
    j = j.withColumn("i", importance(F.col("name"), F.col("builtin"), F.col("scope") == "development")).withColumn("undeclared", F.col("s").isNull() & ~F.col("builtin"))
    level = F.when(F.col("undeclared"), F.least(F.col("i.confidence"), F.lit(0.6))).otherwise(F.col("i.confidence"))
    return j.select("repo", "name", "scope", F.coalesce("declared_by", F.array().cast("array<string>")).alias("declared_by"), "files", "modules", F.col("i.value").alias("importance"), level.alias("confidence"), "undeclared")


def file_dependencies(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """``repo, path, modules, packages``: of each file with an edge, the modules (other than its own) and the packages
    and built-ins that it uses, each once, in order. What one file imports is gathered, which its text bounds."""
    m = modules.select("repo", "path", "module")
    e = edges.select("repo", F.col("source").alias("path"), "target", "target_kind").distinct().join(m.withColumnRenamed("module", "own"), ["repo", "path"], "left").join(m.withColumnsRenamed({"path": "target", "module": "to"}), ["repo", "target"], "left")
    to = F.when(F.col("target_kind") == "module", F.col("target")).when(F.col("target_kind") == "file", F.col("to"))
    each = lambda c: F.array_sort(F.collect_set(c))
    return e.groupBy("repo", "path").agg(each(F.when(~to.eqNullSafe(F.col("own")), to)).alias("modules"), each(F.when(F.col("target_kind") == "package", F.col("target"))).alias("packages"))


def neighbours(edges: DataFrame) -> DataFrame:
    """``repo, module, side, other``: one row per neighbour, side is ``depends_on`` or ``used_by``. A hub's neighbours
    are rows like any others; see ``neighbour_lists``."""
    rows = edges.select("repo", "source", "target").distinct()
    out = rows.select("repo", F.col("source").alias("module"), F.lit("depends_on").alias("side"), F.col("target").alias("other"))
    return out.unionByName(rows.select("repo", F.col("target").alias("module"), F.lit("used_by").alias("side"), F.col("source").alias("other")))


def neighbour_lists(edges: DataFrame, most: int = 50) -> DataFrame:
    """``repo, module, depends_on, depends_on_n, used_by, used_by_n``: how many neighbours on each side, and the first
    of them by name. A hub is spread by a hash of its neighbours, of which each part gives its first ones."""
    n = neighbours(edges).withColumn("part", F.pmod(F.xxhash64("other"), F.lit(64)))
    r = n.withColumn("r", F.row_number().over(W.partitionBy("repo", "module", "side", "part").orderBy("other")))
    parts = r.groupBy("repo", "module", "side", "part").agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("r") <= most, F.col("other"))).alias("l"))
    side = lambda c, s: F.when(F.col("side") == s, F.col(c))
    a = parts.groupBy("repo", "module").agg(*(f for s in ("depends_on", "used_by") for f in (F.slice(F.array_sort(F.flatten(F.collect_list(side("l", s)))), 1, most).alias(s), F.coalesce(F.sum(side("n", s)), F.lit(0)).alias(f"{s}_n"))))
    return a.select("repo", "module", "depends_on", "depends_on_n", "used_by", "used_by_n")


def incoming(edges: DataFrame) -> DataFrame:
    """How many import edges lead to each file."""
    return edges.filter("target_kind = 'file'").groupBy("repo", F.col("target").alias("path")).agg(F.count("*").alias("imported"))


def public_exports(symbols: DataFrame, modules: DataFrame) -> DataFrame:
    """``repo, module, name, kind, path``: exported symbols of a module, a name once (first path, then line), through
    the file that brings the number to MOST_EXPORTS."""
    s = symbols.filter("exported").select("repo", "path", "name", F.col("kind").alias("symbol_kind"), "line").join(modules.select("repo", "path", "module"), ["repo", "path"])
    first = s.withColumn("n", F.row_number().over(W.partitionBy("repo", "module", "name").orderBy("path", "line", "symbol_kind"))).filter("n = 1")
    upto = W.partitionBy("repo", "module").orderBy("path").rangeBetween(W.unboundedPreceding, W.currentRow)
    per_file = first.groupBy("repo", "module", "path").agg(F.count("*").alias("n"))
    before = per_file.withColumn("before", F.sum("n").over(upto) - F.col("n")).filter(F.col("before") < MOST_EXPORTS).select("repo", "module", "path")
    return first.join(before, ["repo", "module", "path"], "left_semi").select("repo", "module", "name", F.col("symbol_kind").alias("kind"), "path")
