"""Entry points of repositories: declared in manifests, run by scripts, named or behaving like one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from .resolution import first_existing
from .tables import first_wins
from .workspace import SCRIPT_FILE

CLI = r"(?i)^(cli|bin|command|commands)([-_.].*)?$"
APPLICATION = r"(?i)^(index|main|server|app|bootstrap|start)$"
WORKER = r"(?i)^(worker|workers|job|jobs|scheduler|consumer)([-_.].*)?$"
COLUMNS = ["repo", "path", "type", "confidence", "detail"]


def entry_points(files: DataFrame, facts: DataFrame, modules: DataFrame, pkgs: DataFrame) -> DataFrame:
    """``repo, path, module, type, confidence, detail``; of one path and type the strongest source holds (manifest,
    script, behaviour, name). ``files``: repo, path, kind."""
    known = files.select("repo", "path", F.lit(None).cast("string").alias("excluded"))
    # manifests
    d = pkgs.select("repo", "name", "directory", F.explode("entries").alias("e")).filter("e.field <> 'types'")
    d = d.select("repo", "name", F.col("e.field").alias("field"), F.col("e.value").alias("value"), F.lit(0).alias("order"), P.normalize(P.join(F.col("directory"), F.col("e.value"))).alias("base"))
    hit = first_existing(d, known, ["repo", "name", "field", "value"])
    kind = F.when(F.col("field") == "bin", "package-bin").when(F.col("field") == "exports", "package-export").otherwise("package-main")
    declared = d.join(hit, ["repo", "name", "field", "value"], "left").filter("hit IS NOT NULL OR value NOT LIKE '%*%'")
    declared = declared.select("repo", F.coalesce("hit.path", "base").alias("path"), kind.alias("type"), F.when(F.col("hit").isNotNull(), 0.99).otherwise(0.6).alias("confidence"), F.concat(F.lit("package.json "), "field", F.lit(" of "), "name").alias("detail"))
    # scripts
    s = pkgs.select("repo", "name", "directory", F.explode("scripts").alias("script", "command")).select("repo", "name", "directory", "script", F.explode(F.regexp_extract_all("command", F.lit(SCRIPT_FILE), 0)).alias("value")).filter("value NOT LIKE '%node_modules%'")
    s = s.select("repo", "name", "script", "value", F.lit(0).alias("order"), P.normalize(P.join(F.col("directory"), F.col("value"))).alias("base"))
    run = s.join(first_existing(s, known, ["repo", "name", "script", "value"]), ["repo", "name", "script", "value"])
    stem = P.stem(F.col("hit.path"))
    type_ = F.when(F.col("script").rlike("test|spec") | stem.rlike("test|spec"), "test").when(stem.rlike(CLI), "cli").when(F.col("script").rlike("^(start|dev|serve|preview|run)$"), "application").otherwise("library")
    scripts = run.select("repo", F.col("hit.path").alias("path"), type_.alias("type"), F.lit(0.85).alias("confidence"), F.concat(F.lit("npm script "), "script").alias("detail"))
    # names and behaviour
    f = files.filter("kind NOT IN ('config', 'docs', 'asset')").select("repo", "path", "kind").join(facts.select("repo", "path", "routes", "signals", "exports"), ["repo", "path"], "left").join(modules.select("repo", "path", "module"), ["repo", "path"], "left")
    f = f.withColumns({"stem": P.stem(F.col("path")), "cli": F.coalesce(F.array_contains("signals", "cli:framework"), F.lit(False))})
    tests = f.filter("kind = 'test'").select("repo", "path", F.lit("test").alias("type"), F.lit(0.95).alias("confidence"), F.lit("file name matches the test conventions").alias("detail"))
    g = f.filter("kind <> 'test'")
    some = lambda n: F.array_join(F.transform(F.slice("routes", 1, n), lambda r: F.concat(r["method"], F.lit(" "), r["path"])), ", ")
    routes = g.filter("size(routes) > 0").select("repo", "path", F.lit("http-routes").alias("type"), F.lit(0.87).alias("confidence"), F.concat(F.lit("registers HTTP routes: "), some(4)).alias("detail"))
    works = g.filter("arrays_overlap(signals, array('worker:usage', 'schedule:usage'))").select("repo", "path", F.lit("worker").alias("type"), F.lit(0.7).alias("confidence"), F.lit("background work signals").alias("detail"))
    is_cli = F.col("stem").rlike(CLI) | F.col("cli")
    clis = g.filter(is_cli).select("repo", "path", F.lit("cli").alias("type"), F.when(F.col("cli"), 0.85).otherwise(0.8).alias("confidence"), F.lit("entry naming matches CLI conventions").alias("detail"))
    rest = g.filter(~is_cli)
    named = rest.filter(F.col("stem").rlike(WORKER)).select("repo", "path", F.lit("worker").alias("type"), F.lit(0.7).alias("confidence"), F.lit("entry naming matches worker conventions").alias("detail"))
    rest = rest.filter(~F.col("stem").rlike(WORKER))
    roots = pkgs.select("repo", F.explode(F.array("directory", F.when(F.col("directory") == "", "src").otherwise(F.concat("directory", F.lit("/src"))))).alias("dir")).distinct()
    at_root = rest.withColumn("dir", P.dirname(F.col("path"))).join(roots.withColumn("root", F.lit(True)), ["repo", "dir"], "left")
    app = F.col("root").isNotNull() & F.col("stem").rlike(APPLICATION)
    apps = at_root.filter(app).select("repo", "path", F.when((F.col("stem") == "index") & (F.coalesce(F.size("exports"), F.lit(0)) <= 0), "library").otherwise("application").alias("type"), F.when(F.col("stem") == "index", 0.7).otherwise(0.85).alias("confidence"), F.lit("entry naming convention at the source root").alias("detail"))
    barrels = at_root.filter(~app & (F.col("stem") == "index") & (F.col("module") != F.col("path"))).select("repo", "path", F.lit("library").alias("type"), F.lit(0.65).alias("confidence"), F.lit("module barrel file").alias("detail"))
    best = first_wins([declared, scripts, tests, routes, works, clis, named, apps, barrels], ["repo", "path", "type"], ["confidence", "detail"])
    return best.join(modules.select("repo", "path", "module"), ["repo", "path"], "left").select("repo", "path", "module", "type", "confidence", "detail")
