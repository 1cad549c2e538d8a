"""Resolving import specifiers to files, packages and built-in modules, for many repositories at once.

Every lookup is an equi-join: a specifier's base path is expanded to its candidate paths in the order in which
they are tried, the candidates are joined with the files, and the first one that exists wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.packages import is_builtin, package_name

# Extensions that are tried, in order, and what a written extension may stand for.
EXTENSIONS = (".ts", ".tsx", ".mts", ".cts", ".d.ts", ".js", ".jsx", ".mjs", ".cjs", ".json")
REWRITES = {".js": (".ts", ".tsx", ".d.ts", ".js"), ".jsx": (".tsx", ".jsx"), ".mjs": (".mts", ".mjs"), ".cjs": (".cts", ".cjs")}
CODE_EXTENSIONS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".json", ".node")
ALIASES = "repo string, pattern string, targets array<string>, base string, source string"


def candidates(base: Column) -> Column:
    """The paths that a base may mean, in the order they are tried."""
    ext = P.extname(base)
    bare = F.regexp_replace(base, r"\.[^./]*$", "")
    own = F.array(base)
    out = F.when(ext == "", F.concat(own, *(F.array(*(F.concat(base, F.lit(x + e)) for e in EXTENSIONS)) for x in ("", "/index"))))
    for written, meant in REWRITES.items():
        out = out.when(ext == written, F.concat(own, F.array(*(F.concat(bare, F.lit(e)) for e in meant))))
    return out.otherwise(own)


def first_existing(wanted: DataFrame, files: DataFrame, by: list[str]) -> DataFrame:
    """Of rows ``by, repo, order, base``: per ``by`` the first candidate that exists, ``hit`` (struct of order,
    whether excluded, place among the candidates, path, why excluded). ``files``: ``repo, path, excluded`` (null
    where analyzed). Within one base an analyzed file comes before an excluded one."""
    tried = wanted.select(*dict.fromkeys([*by, "repo", "order"]), F.posexplode(candidates(F.col("base"))).alias("place", "candidate"))
    known = files.select(F.col("repo").alias("_r"), F.col("path").alias("_p"), F.col("excluded").alias("why"))
    met = tried.join(known, (F.col("repo") == F.col("_r")) & (F.col("candidate") == F.col("_p")))
    hit = F.min(F.struct("order", F.col("why").isNotNull().alias("excluded"), "place", F.col("candidate").alias("path"), "why"))
    return met.groupBy(*by).agg(hit.alias("hit"))


def resolve(imports: DataFrame, files: DataFrame, aliases: DataFrame, packages: DataFrame) -> DataFrame:
    """``repo, path, specifier, kind, target, entry, confidence, reason, evidence`` of each distinct import.

    ``imports``: repo, path, specifier. ``files``: repo, path, excluded (why a file isn't analyzed, else null).
    ``aliases``: see ALIASES; the deepest base first, then the pattern; only the first alias that fits is tried.
    ``packages``: repo, name, directory, entries (candidate paths, in order).

    Kinds: internal-file, workspace-package, node-builtin, external-package, unresolved (with a reason: missing,
    path-escape, excluded-file, unresolved-alias). Null specifiers and paths are left out; repeated imports give
    one row; an empty specifier is missing; empty tables give what is left. A repository with a third of all
    imports is spread by path and specifier; only the joins with aliases and packages, a few rows a repository,
    go by repository, and AQE splits them."""
    one = imports.filter("path IS NOT NULL AND specifier IS NOT NULL").select("repo", "path", "specifier").distinct().withColumn("spec", P.to_posix(F.col("specifier")))
    relative = F.col("spec").startswith(".") | F.col("spec").startswith("/")
    joined = P.join_strict(P.dirname(F.col("path")), F.col("spec"))
    key = ["repo", "path", "specifier"]
    rel = one.filter(relative).withColumn("j", joined).select(*key, F.lit(0).alias("order"), F.col("j.path").alias("base"), (F.col("j.escaped") | F.col("j.absolute")).alias("escapes"))

    # the first alias that fits
    a = aliases.select(F.col("repo").alias("_r"), "pattern", "targets", F.col("base").alias("alias_base"), F.col("source").alias("alias_source"))
    wild = F.instr("pattern", "*") > 0
    prefix = F.when(wild, F.substring_index("pattern", "*", 1)).otherwise(F.col("pattern"))
    fits = F.when(wild, F.col("spec").startswith(prefix)).otherwise(F.col("spec") == F.col("pattern"))
    near = one.filter(~relative & (F.col("spec") != "")).join(a, (F.col("repo") == F.col("_r")) & fits).withColumn("rest", F.when(wild, F.substr("spec", F.length(prefix) + 1)).otherwise(""))
    order = W.partitionBy(*key).orderBy(F.desc(F.length("alias_base")), "pattern", "alias_source")
    alias = near.withColumn("n", F.row_number().over(order)).filter("n = 1")
    put = F.when(wild, F.regexp_replace(F.col("target"), r"^([^*]*)\*", F.concat(F.lit("$1"), F.regexp_replace("rest", r"([\\$])", r"\\$1")))).otherwise(F.col("target"))
    via = alias.select(*key, "alias_base", F.posexplode("targets").alias("order", "target"), "rest", "pattern").withColumn("j", P.join_strict(F.col("alias_base"), put)).filter("NOT j.escaped AND NOT j.absolute").select(*key, "order", F.col("j.path").alias("base"))

    hits = first_existing(rel.filter("NOT escapes").drop("escapes").unionByName(via), files, key)
    # entry files of workspace packages
    p = packages.select("repo", "name", "directory", F.posexplode_outer("entries").alias("order", "base"))
    entries = first_existing(p.filter("base IS NOT NULL").select("repo", "name", "order", "base"), files.filter("excluded IS NULL"), ["repo", "name"])
    space = packages.select("repo", "name", "directory").join(entries, ["repo", "name"], "left").select(F.col("repo").alias("_pr"), F.col("name").alias("_pn"), "directory", F.col("hit.path").alias("entry"))

    rows = (
        one.join(rel.select(*key, F.col("base").alias("rel_base"), "escapes"), key, "left")
        .join(alias.select(*key, F.col("pattern").alias("alias"), "alias_source"), key, "left")
        .join(hits, key, "left")
        .withColumn("name", package_name(F.col("spec")))
        .join(space, (F.col("repo") == F.col("_pr")) & (F.col("name") == F.col("_pn")), "left")
    )
    found = F.col("hit").isNotNull() & ~F.col("hit.excluded")
    blocked = F.col("hit.excluded")
    is_rel, named = relative, F.col("name").isNotNull()
    kind = F.when(F.coalesce(found, F.lit(False)), "internal-file").when(is_rel | F.coalesce(blocked, F.lit(False)) | (F.col("alias").isNotNull() & ~named) | ~named, "unresolved").when(F.col("directory").isNotNull(), "workspace-package").when(is_builtin(F.col("spec")), "node-builtin").otherwise("external-package")
    reason = F.when(F.col("kind") != "unresolved", None).when(F.col("escapes"), "path-escape").when(F.col("hit.excluded"), "excluded-file").when(F.col("alias").isNotNull(), "unresolved-alias").otherwise("missing")
    target = F.when(F.col("kind") == "internal-file", F.col("hit.path")).when(F.col("kind").isin("workspace-package", "external-package"), F.col("name")).otherwise(F.col("specifier"))
    level = F.when(F.col("kind") == "internal-file", F.when(is_rel, 0.99).otherwise(0.95)).when(F.col("kind") == "workspace-package", 0.97).when(F.col("kind") == "node-builtin", 0.99).when(F.col("kind") == "external-package", 0.96).otherwise(0.3)
    here = P.dirname(F.col("path"))
    evidence = (
        F.when((F.col("kind") == "internal-file") & is_rel & (here == P.dirname(F.col("hit.path"))), F.concat(F.lit("same directory: "), F.when(here == "", "the root").otherwise(here)))
        .when((F.col("kind") == "internal-file") & is_rel, F.concat(F.lit("by relative path: "), F.col("hit.path")))
        .when(F.col("kind") == "internal-file", F.concat(F.lit('by the alias "'), F.col("alias"), F.lit('" of '), F.col("alias_source"), F.lit(": "), F.col("hit.path")))
        .when(F.col("kind") == "workspace-package", F.concat(F.lit('workspace package "'), F.col("name"), F.lit('" ('), F.col("directory"), F.lit(")")))
        .when(F.col("kind") == "node-builtin", "specifier is a Node.js built-in module")
        .when(F.col("kind") == "external-package", "specifier is an external package dependency")
        .when(F.col("reason") == "path-escape", F.concat(F.lit('"'), F.col("specifier"), F.lit('" leads out of the repository')))
        .when(F.col("reason") == "excluded-file", F.concat(F.lit('"'), F.col("hit.path"), F.lit('" is there but not read: '), F.col("hit.why")))
        .when(F.col("reason") == "unresolved-alias", F.concat(F.lit('by the alias "'), F.col("alias"), F.lit('" of '), F.col("alias_source"), F.lit(": no such file")))
        .when(is_rel, F.concat(F.lit('neither a file nor an index file at "'), F.col("rel_base"), F.lit('"')))
        .otherwise("specifier is neither relative, aliased, nor a package name")
    )
    return rows.withColumn("kind", kind).withColumn("reason", reason).select(*key, "kind", target.alias("target"), F.when(F.col("kind") == "workspace-package", F.col("entry")).alias("entry"), level.alias("confidence"), "reason", evidence.alias("evidence"))


def unresolved(resolved: DataFrame) -> DataFrame:
    """Unresolved imports that look like code: no extension, a code extension, or an escape (never hidden)."""
    ext = F.regexp_extract(F.substring_index("specifier", "/", -1), r"(\.[^.]*)$", 1)
    return resolved.filter((F.col("kind") == "unresolved") & ((F.col("reason") == "path-escape") | (ext == "") | ext.isin(*CODE_EXTENSIONS))).select("repo", F.col("path").alias("file"), "specifier", "reason", "evidence")


def alias_entries(facts: DataFrame, levels: int = 16) -> DataFrame:
    """Path aliases of all compiler configurations, inherited ones included (see ALIASES).

    ``extends`` chains are followed level by level, each step a join of configurations with their parents; a
    configuration that was met before on its own chain ends it. Configurations are a few rows a repository."""
    meta = F.from_json("metadata", "extends array<string>, base_url string, paths map<string, array<string>>")
    c = facts.filter("language = 'tsconfig' AND status = 'ok'").select("repo", "path", meta.alias("m")).select("repo", "path", "m.*", P.dirname(F.col("path")).alias("dir"))
    base = P.normalize(P.join(F.col("dir"), F.coalesce("base_url", F.lit("."))))
    entry = F.when(F.size("paths") > 0, F.transform(F.map_entries("paths"), lambda e: F.struct(e["key"].alias("pattern"), F.array_sort(e["value"]).alias("targets")))).when(F.col("base_url").isNotNull(), F.array(F.struct(F.lit("*").alias("pattern"), F.array(F.lit("*")).alias("targets"))))
    declared = c.select("repo", F.col("path").alias("source"), base.alias("base"), F.explode(entry).alias("e")).select("repo", "source", "base", "e.*").filter(F.size("targets") > 0)
    parent = F.explode("extends").alias("up")
    target = F.when(F.col("up").startswith("."), P.normalize(P.join(F.col("dir"), F.col("up")))).otherwise(F.col("up"))
    up = c.select("repo", F.col("path").alias("child"), "dir", parent).select("repo", "child", F.explode(F.array(target, F.concat(target, F.lit(".json")))).alias("path")).join(c.select("repo", "path"), ["repo", "path"]).withColumnRenamed("path", "parent")
    reach = c.select("repo", F.col("path").alias("root"), F.col("path").alias("at"))
    whole = reach
    for _ in range(levels):
        step = reach.alias("a").join(up.alias("u"), (F.col("a.repo") == F.col("u.repo")) & (F.col("a.at") == F.col("u.child"))).select("a.repo", "a.root", F.col("u.parent").alias("at")).distinct().join(whole, ["repo", "root", "at"], "left_anti")
        if step.isEmpty():
            break
        reach = step
        whole = whole.unionByName(step)
    used = whole.select("repo", F.col("at").alias("source")).distinct()
    return declared.join(used, ["repo", "source"], "left_semi").select("repo", "pattern", "targets", "base", "source").distinct()
