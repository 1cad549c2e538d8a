"""Workspaces: packages of repositories from their manifests, package managers from lockfiles and declarations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P

MANIFEST = """name string, version string, private boolean, type string, package_manager string, scripts map<string, string>, dependencies array<string>,
dev_dependencies array<string>, peer_dependencies array<string>, workspaces array<string>, entries array<struct<field: string, value: string>>"""
# Lockfiles at the root and what they stand for.
LOCKFILES = {"package-lock.json": "npm", "npm-shrinkwrap.json": "npm", "pnpm-lock.yaml": "pnpm", "yarn.lock": "yarn", "bun.lock": "bun", "bun.lockb": "bun", "pnpm-workspace.yaml": "pnpm"}
MANAGERS = ("npm", "pnpm", "yarn", "bun")
SCRIPT_FILE = r"[\w./@-]+\.(?:[cm]?[jt]sx?)"


def manifests(facts: DataFrame) -> DataFrame:
    """``repo, path, directory`` and the fields of each valid package.json (column ``m`` fields flattened)."""
    m = F.from_json("metadata", MANIFEST)
    return facts.filter("language = 'package-json' AND status = 'ok'").select("repo", "path", P.dirname(F.col("path")).alias("directory"), m.alias("m")).select("repo", "path", "directory", "m.*")


def glob_regex(glob: Column) -> Column:
    """A workspace pattern (``packages/*``, ``apps/**``, ``tools/``) as an expression over directories: stars, question
    marks and everything else literally."""
    g = F.regexp_replace(F.regexp_replace(glob, r"^\./", ""), r"/+$", "/**")
    quoted = F.regexp_replace(g, r"([.+()|^$\\{}\[\]])", r"\\$1")
    deep = F.regexp_replace(F.regexp_replace(F.regexp_replace(quoted, r"/\*\*$", "(?:/.*)?"), r"\*\*/", "(?:[^/]*/)\u0001"), r"(?<!\.)\*\*", ".\u0001")
    one = F.regexp_replace(F.regexp_replace(F.regexp_replace(deep, r"(?<![.)\]])\*", "[^/]\u0001"), r"(?<!\()\?(?!:)", "[^/]"), "\u0001", "*")
    return F.concat(F.when(F.contains(glob, F.lit("/")), "^").otherwise("^(?:.*/)?"), one, F.lit("$"))


def packages(facts: DataFrame) -> DataFrame:
    """``repo, name, directory`` and manifest fields of the workspace packages: those below a declared pattern, or
    the root manifest alone where nothing is declared. Patterns come from the root manifest and the workspace list."""
    m = manifests(facts)
    declared = m.filter("path = 'package.json'").select("repo", F.explode("workspaces").alias("glob"))
    listed = facts.filter("language = 'pnpm-workspace' AND path = 'pnpm-workspace.yaml'").select("repo", F.explode(F.from_json(F.get_json_object("metadata", "$.packages"), "array<string>")).alias("glob"))
    globs = declared.unionByName(listed).distinct().withColumn("rx", glob_regex(F.col("glob")))
    below = m.filter(r"path <> 'package.json' AND NOT path RLIKE '(^|/)node_modules/'").join(globs.select("repo", "rx"), "repo").filter("directory RLIKE rx").drop("rx").dropDuplicates(["repo", "path"])
    alone = m.filter("path = 'package.json'").join(globs.select("repo").distinct(), "repo", "left_anti")
    last = F.when(F.col("directory") == "", "root").otherwise(P.basename(F.col("directory")))
    return below.unionByName(alone).withColumn("name", F.coalesce("name", last))


def entry_bases(pkgs: DataFrame) -> DataFrame:
    """``repo, name, directory, entries``: paths at which a package's entry file may lie, declared ones first."""
    named = F.filter("entries", lambda e: ~e["value"].contains("*") & (e["value"].rlike(r"\.(ts|tsx|mts|cts|js|jsx|mjs|cjs|json)$") | e["value"].startswith(".")))
    own = F.transform(F.coalesce(named, F.array().cast("array<struct<field: string, value: string>>")), lambda e: P.normalize(P.join(F.col("directory"), e["value"])))
    usual = F.array(*(P.normalize(P.join(F.col("directory"), F.lit(x))) for x in ("src/index", "index", "src/main")))
    return pkgs.select("repo", "name", "directory", F.concat(own, usual).alias("entries"))


def declared_dependencies(pkgs: DataFrame) -> DataFrame:
    """``repo, package, dependency, scope``."""
    part = lambda c, s: pkgs.select("repo", F.col("name").alias("package"), F.explode(c).alias("dependency"), F.lit(s).alias("scope"))
    return part("dependencies", "runtime").unionByName(part("peer_dependencies", "peer")).unionByName(part("dev_dependencies", "development"))


def managers(files: DataFrame, facts: DataFrame) -> DataFrame:
    """``repo, manager, lockfiles, signals``: the declared manager if it is a known one, else the one that all lockfiles
    stand for; unknown where there is none or more than one."""
    stands = F.create_map(*(F.lit(x) for kv in LOCKFILES.items() for x in kv))
    locks = files.filter(F.col("path").isin(list(LOCKFILES))).select("repo", "path", F.element_at(stands, F.col("path")).alias("manager")).groupBy("repo").agg(F.array_sort(F.collect_set(F.when(F.col("path") != "pnpm-workspace.yaml", F.col("path")))).alias("lockfiles"), F.array_sort(F.collect_set("manager")).alias("signals"))
    root = manifests(facts).filter("path = 'package.json'").select("repo", F.substring_index("package_manager", "@", 1).alias("declared"))
    repos = files.select("repo").distinct()
    j = repos.join(locks, "repo", "left").join(root, "repo", "left")
    manager = F.when(F.col("declared").isin(*MANAGERS), F.col("declared")).when(F.size("signals") == 1, F.col("signals")[0]).otherwise("unknown")
    empty = F.array().cast("array<string>")
    return j.select("repo", manager.alias("manager"), F.coalesce("lockfiles", empty).alias("lockfiles"), F.coalesce("signals", empty).alias("signals"))


def commands(pkgs: DataFrame, managers_: DataFrame) -> DataFrame:
    """``repo, name, command, script, scope`` of runnable scripts, well-known names first."""
    order = F.array(*map(F.lit, "start dev build test lint typecheck format".split()))
    s = pkgs.select("repo", F.col("name").alias("package"), "directory", F.explode("scripts").alias("script_name", "script")).filter(r"script_name RLIKE '^(start|dev|serve|build|test|lint|typecheck|check|format|migrate|seed|generate|clean)$' OR script_name LIKE 'test:%'")
    runner = F.when(F.col("manager") == "unknown", "npm").otherwise(F.col("manager"))
    where = F.when(F.col("directory") == "", "").otherwise(F.concat(F.lit(" --workspace "), "package"))
    rank = F.coalesce(F.nullif(F.array_position(order, F.col("script_name")), F.lit(0)), F.lit(8))
    out = s.join(managers_.select("repo", "manager"), "repo", "left").select("repo", F.col("script_name").alias("name"), F.concat(F.coalesce(runner, F.lit("npm")), F.lit(" run "), "script_name", where).alias("command"), "script", F.when(F.col("directory") == "", "root").otherwise(F.col("package")).alias("scope"), rank.alias("rank"))
    return out
