"""More operators over whole tables, each beside SQL that says the same: texts, records, declared packages, history, diffs.

Where the tables have nothing of a kind (declared packages, settings of a workspace), a few fixed rows stand for it in
every repository, and the rest is the whole of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import words
from ..functions.packages import FRAMEWORKS, INFRASTRUCTURE, TOOLING, signals
from ..functions.spelling import plain_hash
from ..operators import activity, diagnostics, diff, modules, resolution, rules, search
from ..operators import files as file_ops
from ..session import table
from . import source_queries as S
from . import source_sql as Q

#: Packages of each repository's workspace, and what its manifest declares.
WORKSPACE = (("lodash", "packages/lodash"), ("zod", "packages/zod"))
DECLARED = (("express", "runtime"), ("lodash", "development"), ("commander", "development"), ("zod", "peer"), ("zod", "development"), ("@loomkit/core", "development"))
LARGEST = 3000


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def word_functions(spark, folder):
    d = _docs(spark, folder)
    n, lines = F.coalesce(F.length("text"), F.lit(0)).cast("double"), F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return d.select("doc_id", words.truncate(F.col("text"), 60).alias("short"), words.plural(lines, "line").alias("lines"), words.plural(lines, "entry", "entries").alias("entries"), words.confidence(n / 5003).alias("level"), F.round(words.ratio(lines.cast("double"), n), 6).alias("share"), words.day(F.col("fetched_at")).alias("day"), words.short_hash(F.col("path")).alias("key"))


def file_records(spark, folder):
    r = file_ops.records(_docs(spark, folder).select("repo", "path", "text"), ["deploy/**", "!deploy/**/*.md"], False, LARGEST)
    return r.select("repo", "path", "hash", "size", "sensitive", "too_large")


def status_of_roots(spark, folder):
    return file_ops.status(S.listing_changes(spark, folder), True).select("repo", "state", "added", "modified", "deleted")


def _everywhere(spark, folder, rows, schema):
    return _docs(spark, folder).select("repo").distinct().crossJoin(F.broadcast(spark.createDataFrame(list(rows), schema)))  # a few fixed rows


def workspace_imports(spark, folder):
    """Imports of which some name packages of the workspace."""
    packages = _everywhere(spark, folder, WORKSPACE, "name string, directory string").select("repo", "name", "directory", F.array(F.concat("directory", F.lit("/src/index"))).alias("entries"))
    known = _docs(spark, folder).select("repo", "path", F.lit(None).cast("string").alias("excluded"))
    r = resolution.resolve(S._imports(spark, folder), known, spark.createDataFrame([], "repo string, pattern string, targets array<string>, base string, source string"), packages)
    return r.filter("kind IN ('workspace-package', 'external-package', 'node-builtin')").select("repo", "path", "specifier", "kind", "target", "confidence")


def declared_packages(spark, folder):
    declared = _everywhere(spark, folder, DECLARED, "dependency string, scope string").select("repo", F.lit("root").alias("package"), "dependency", "scope")
    x = modules.externals(S._edges(spark, folder), S._modules(spark, folder), declared)
    return x.select("repo", "name", "scope", F.array_join("declared_by", ",").alias("declared_by"), "files", "modules", "importance", "confidence", "undeclared")


def module_signals(spark, folder):
    told = S._imports(spark, folder).select("repo", "path", signals(F.col("specifier")).alias("signals"))
    return rules.module_signals(told, S._modules(spark, folder))


def bm25_of_types(spark, folder):
    d = S._search_documents(spark, folder).join(_docs(spark, folder).select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("type")), "id")
    return search.search(search.Index.build(d), Q.QUERY, limit=None, types=["markdown", "python"], min_score=2.0).select("id", "score", F.array_join("matched", ",").alias("matched"))


def context_diff(spark, folder):
    """What the scanner's latest records and the documents say of the files, and of the modules they make."""
    f = table(spark, folder, "files").groupBy("repo", "path").agg(F.max(F.struct("scanned_at", plain_hash(F.col("hash")).alias("hash"))).alias("b")).select("repo", "path", "b.hash")
    now = _docs(spark, folder).select("repo", "path", F.sha2("text", 256).alias("hash"))
    kind = lambda df: df.select("repo", "path", F.when(F.col("path").rlike(S.SCRIPTS), "source").otherwise("other").alias("kind"))
    none = spark.createDataFrame([], S.NO_PACKAGES)
    before = {"files": f, "modules": modules.build_modules(kind(f), none)}
    return diff.context_diff(before, {"files": now, "modules": modules.build_modules(kind(now), none)})


def _history(spark, folder):
    """Orders as commits of the repositories (part types) whose files (parts) they touch."""
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("k"), F.col("p_type").alias("repo"), F.col("p_partkey").cast("string").alias("path"), F.col("p_brand").alias("module"), "p_size")
    cf = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("k")).join(p, "k").select("repo", F.col("o").cast("string").alias("sha"), "path")
    o = table(spark, folder, "orders").select(F.col("o_orderkey").cast("string").alias("sha"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("subject"))
    return cf.select("repo", "sha").distinct().join(o, "sha"), cf, p


def commit_touches(spark, folder):
    commits, cf, p = _history(spark, folder)
    t = activity.touches(commits, cf, p.filter("p_size >= 10"), p.filter("p_size < 40"))
    return t.groupBy("repo", "module").agg(F.count("*").alias("touches"), F.count_distinct("sha").alias("commits"), F.max("ts").alias("last"))


def commit_history(spark, folder):
    commits, cf, p = _history(spark, folder)
    h = activity.history(commits, cf, p.filter("module = 'Brand#11'").select("repo", "path"), 50)
    return h.select("repo", "sha", "author", F.array_join("files", ",").alias("files"), "architectural")


def file_dependencies(spark, folder):
    d = modules.file_dependencies(S._edges(spark, folder), S._modules(spark, folder))
    return d.select("repo", "path", F.array_join("modules", ",").alias("modules"), F.array_join("packages", ",").alias("packages"))


def file_diagnostics(spark, folder):
    """Of the scanner's latest record of each file."""
    best = F.max(F.struct("scanned_at", "parse_status", "skipped_reason", "sensitive"))
    f = table(spark, folder, "files").groupBy("repo", "path").agg(best.alias("b")).select("repo", "path", "b.parse_status", "b.skipped_reason", "b.sensitive")
    return diagnostics.of_files(f).withColumn("rank", F.col("rank").cast("long"))


QUERIES = {f.__name__: f for f in (file_dependencies, file_diagnostics, word_functions, file_records, status_of_roots, workspace_imports, declared_packages, module_signals, bm25_of_types, context_diff, commit_touches, commit_history)}

_HISTORY = "cf AS (SELECT p_type AS repo, CAST(l_orderkey AS VARCHAR) AS sha, CAST(l_partkey AS VARCHAR) AS path FROM lineitem JOIN part ON p_partkey = l_partkey), co AS (SELECT c.repo, c.sha, o_custkey AS author, o_orderdate AS ts FROM (SELECT DISTINCT repo, sha FROM cf) c JOIN orders ON CAST(o_orderkey AS VARCHAR) = c.sha)"
_LINES = "length(text) - length(replace(text, chr(10), ''))"
_ONE = f"trim(regexp_replace(text, {Q.q(words.SPACE)}, ' ', 'g'))"
_MODULES_OF = lambda t, name: Q.MODULES.replace("FROM documents WHERE", f"FROM {t} WHERE").replace("src AS", f"src_{name} AS").replace("FROM src ", f"FROM src_{name} ").replace("dirs AS", f"dirs_{name} AS").replace("FROM dirs ", f"FROM dirs_{name} ").replace("mdir AS", f"mdir_{name} AS").replace("JOIN mdir ", f"JOIN mdir_{name} ").replace("mods AS", f"mods_{name} AS").replace("FROM src GROUP", f"FROM src_{name} GROUP")

SQL = {
    "file_dependencies": f"""WITH {Q.EDGES}, x AS (SELECT DISTINCT e.repo, e.source AS path, CASE WHEN e.target_kind = 'file' AND b.module IS DISTINCT FROM a.module THEN b.module END AS m, CASE WHEN e.target_kind = 'package' THEN e.target END AS p
  FROM fe e LEFT JOIN mods a ON a.repo = e.repo AND a.path = e.source LEFT JOIN mods b ON b.repo = e.repo AND b.path = e.target)
SELECT repo, path, coalesce(array_to_string(list_sort(list(DISTINCT m) FILTER (m IS NOT NULL)), ','), '') AS modules, coalesce(array_to_string(list_sort(list(DISTINCT p) FILTER (p IS NOT NULL)), ','), '') AS packages FROM x GROUP BY ALL""",
    "file_diagnostics": """WITH l AS (SELECT repo, path, parse_status, skipped_reason, sensitive FROM files QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY scanned_at DESC NULLS LAST, parse_status DESC NULLS LAST, skipped_reason DESC NULLS LAST, sensitive DESC NULLS LAST) = 1),
x AS (SELECT repo, 'failed-parse' AS code, 'warning' AS severity, path AS source, 'no facts were read' AS message FROM l WHERE parse_status = 'failed' UNION ALL SELECT repo, 'partial-parse', 'info', path, 'read in part' FROM l WHERE parse_status = 'partial'
  UNION ALL SELECT repo, 'sensitive-file', 'info', path, 'not opened' FROM l WHERE sensitive UNION ALL SELECT repo, 'skipped-file', 'info', path, 'left out: ' || lower(trim(skipped_reason)) FROM l WHERE skipped_reason IS NOT NULL AND NOT coalesce(sensitive, false))
SELECT *, row_number() OVER (PARTITION BY repo, code ORDER BY source NULLS FIRST, message) AS rank FROM x""",
    "word_functions": f"""SELECT doc_id, CASE WHEN text IS NULL THEN '…' WHEN length(one) <= 60 THEN one ELSE rtrim(substr(one, 1, 59)) || '…' END AS short, CAST(lines AS VARCHAR) || CASE WHEN lines = 1 THEN ' line' ELSE ' lines' END AS lines,
  CAST(lines AS VARCHAR) || CASE WHEN lines = 1 THEN ' entry' ELSE ' entries' END AS entries, round(least(0.99::DOUBLE, n / 5003), 2) AS level, CASE WHEN n > 0 THEN round(lines / n, 6) ELSE 0 END AS share, strftime(fetched_at, '%Y-%m-%d') AS day, substr(sha256(path), 1, 8) AS key
FROM (SELECT *, {_LINES} AS lines, {_ONE} AS one, coalesce(length(text), 0)::DOUBLE AS n FROM documents)""".replace("CASE WHEN text IS NULL THEN '…' WHEN", "CASE WHEN text IS NULL THEN NULL WHEN"),
    "file_records": f"""SELECT repo, path, CASE WHEN s OR size > {LARGEST} THEN '' ELSE sha256(text) END AS hash, size, s AS sensitive, size > {LARGEST} AS too_large
FROM (SELECT repo, path, text, coalesce(strlen(text), 0)::BIGINT AS size, {Q.glob_sql([*file_ops.SENSITIVE, 'deploy/**', '!deploy/**/*.md'], 'path')} AS s FROM (SELECT *, {Q.ABOVE} AS above FROM documents))""",
    "status_of_roots": f"""SELECT repo, CASE WHEN count(*) FILTER (change <> 'unchanged') = 0 THEN 'up-to-date' ELSE 'stale' END AS state, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'modified') AS modified, count(*) FILTER (change = 'deleted') AS deleted
FROM ({Q.SQL['listing_changes']}) GROUP BY repo""",
    "workspace_imports": f"""WITH {Q.IMPORTS}, o AS (SELECT DISTINCT repo, path, specifier, {Q.PACKAGE} AS name, {Q.BUILTIN} AS builtin FROM im WHERE specifier NOT LIKE '.%' AND specifier NOT LIKE '/%'), w AS (SELECT * FROM {Q.values(WORKSPACE)} AS t(name, directory)),
k AS (SELECT o.*, CASE WHEN w.name IS NOT NULL THEN 'workspace-package' WHEN builtin THEN 'node-builtin' ELSE 'external-package' END AS kind FROM o LEFT JOIN w USING (name) WHERE o.name IS NOT NULL)
SELECT repo, path, specifier, kind, CASE kind WHEN 'node-builtin' THEN specifier ELSE name END AS target, CASE kind WHEN 'workspace-package' THEN 0.97::DOUBLE WHEN 'node-builtin' THEN 0.99 ELSE 0.96 END AS confidence FROM k""",
    "declared_packages": f"""WITH {Q.EDGES}, d AS (SELECT name, max_by(scope, CASE scope WHEN 'runtime' THEN 3 WHEN 'peer' THEN 2 ELSE 1 END) AS scope FROM {Q.values(DECLARED)} AS t(name, scope) GROUP BY name),
x AS (SELECT e.repo, e.target AS name, bool_or(e.kind = 'node-builtin') AS builtin, count(DISTINCT e.source) AS files, count(DISTINCT m.module) AS modules FROM fe e LEFT JOIN mods m ON m.repo = e.repo AND m.path = e.source WHERE target_kind = 'package' GROUP BY ALL),
y AS (SELECT x.*, d.scope AS said, d.name IS NULL AND NOT builtin AS undeclared, CASE WHEN builtin OR x.name IN {Q.lst(INFRASTRUCTURE)} THEN 'infrastructure' WHEN x.name IN {Q.lst(FRAMEWORKS)} THEN 'framework' WHEN x.name IN {Q.lst(TOOLING)} OR (d.scope = 'development' AND NOT builtin) THEN 'tooling' ELSE 'utility' END AS importance,
  CASE WHEN builtin THEN 0.99::DOUBLE WHEN x.name IN {Q.lst([*INFRASTRUCTURE, *FRAMEWORKS, *TOOLING])} THEN 0.72 WHEN d.scope = 'development' THEN 0.52 ELSE 0.3 END AS level FROM x LEFT JOIN d ON d.name = x.name)
SELECT repo, name, CASE WHEN builtin THEN 'runtime' ELSE coalesce(said, 'runtime') END AS scope, CASE WHEN said IS NULL THEN '' ELSE 'root' END AS declared_by, files, modules, importance, CASE WHEN undeclared THEN least(level, 0.6) ELSE level END AS confidence, undeclared FROM y""",
    "module_signals": f"""WITH {Q.IMPORTS}, {Q.MODULES}, {Q.SIGNALS}, i AS (SELECT *, {Q.PACKAGE} AS package FROM im)
SELECT repo, module, signal, min(path) AS path FROM (
  SELECT i.repo, m.module, p.signal, i.path FROM i JOIN mods m ON m.repo = i.repo AND m.path = i.path JOIN pk_signal p ON i.specifier NOT LIKE 'node:%' AND {Q.SIG_JOIN}
  UNION ALL SELECT i.repo, m.module, 'worker:usage', i.path FROM i JOIN mods m ON m.repo = i.repo AND m.path = i.path WHERE i.specifier = 'node:worker_threads') GROUP BY ALL""",
    "bm25_of_types": Q.SQL["bm25_search"].replace("ORDER BY score DESC, id LIMIT 20", "JOIN sd USING (id) WHERE sd.k1 IN ('markdown', 'python') AND a.s * pow(1.35::DOUBLE, boosts) + len(list_filter(matched, lambda m: list_contains(pw.place, m))) * 0.9::DOUBLE >= 2.0"),
    "context_diff": f"""WITH f AS (SELECT repo, path, max_by(h, (scanned_at, h)) AS h FROM (SELECT *, regexp_replace(lower(trim(hash)), '^sha-?256[:=]', '') AS h FROM files) GROUP BY ALL), d AS (SELECT repo, path, sha256(text) AS h FROM documents), {_MODULES_OF('f', 'f')}, {_MODULES_OF('documents', 'd')},
x AS (SELECT coalesce(f.repo, d.repo) AS repo, 'files' AS section, coalesce(f.path, d.path) AS key, CASE WHEN f.path IS NULL THEN 'added' WHEN d.path IS NULL THEN 'removed' WHEN f.h IS DISTINCT FROM d.h THEN 'changed' END AS change FROM f FULL JOIN d ON f.repo = d.repo AND f.path = d.path
  UNION ALL SELECT coalesce(a.repo, b.repo), 'modules', coalesce(a.module, b.module), CASE WHEN a.module IS NULL THEN 'added' WHEN b.module IS NULL THEN 'removed' END FROM (SELECT DISTINCT repo, module FROM mods_f) a FULL JOIN (SELECT DISTINCT repo, module FROM mods_d) b ON a.repo = b.repo AND a.module = b.module)
SELECT * FROM x WHERE change IS NOT NULL""",
    "commit_touches": f"""WITH {_HISTORY} SELECT repo, module, count(*) AS touches, count(DISTINCT sha) AS commits, max(ts) AS last FROM (SELECT cf.repo, cf.sha, co.ts, CASE WHEN p_size < 40 THEN p_brand END AS module FROM cf JOIN part ON CAST(p_partkey AS VARCHAR) = cf.path AND p_size >= 10 JOIN co ON co.repo = cf.repo AND co.sha = cf.sha) GROUP BY ALL""",
    "commit_history": f"""WITH {_HISTORY}, h AS (SELECT cf.repo, sha, array_to_string(list_sort(list(DISTINCT path)), ',') AS files FROM cf JOIN part ON CAST(p_partkey AS VARCHAR) = path AND p_brand = 'Brand#11' GROUP BY ALL)
SELECT co.repo, co.sha, author, files, false AS architectural FROM co JOIN h ON h.repo = co.repo AND h.sha = co.sha ORDER BY ts DESC, co.sha LIMIT 50""",
}
