"""Queries of the operators on source collections, over whole tables, and the SQL they are held against.

``documents`` is the file table (repo, path, text). Imports are those of ``quick_imports``, which SQL can say too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import words
from ..functions.globs import any_match, last_match
from ..functions.packages import importance, is_builtin, package_name, signals
from ..functions.secret_rules import contains_secret, matched_rules, redact
from ..operators import files as file_ops
from ..operators import conventions, graph, issues, modules, resolution, rules, search, tables, workspace
from ..session import cut, table
from ..sources.facts import read_facts
from ..sources.quick_imports import SCRIPTS, quick_imports

NO_PACKAGES = "repo string, name string, directory string, entries array<string>"
SINCE = "2024-06-01 00:00:00"
ALIASES = (("@app/*", ["src/*", "lib/*"], "", "tsconfig.json"), ("~/*", ["src/*"], "", "tsconfig.json"))


def _docs(spark, folder):
    return table(spark, folder, "documents")


# texts and paths
def path_parts(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("path")
    return _docs(spark, folder).select("doc_id", P.dirname(p).alias("dir"), P.basename(p).alias("name"), P.extname(p).alias("ext"), P.stem(p).alias("stem"), P.depth(p).cast("long").alias("depth"), F.array_join(P.ancestors(p), "|").alias("above"), P.is_inside(F.lit("src"), p).alias("in_src"), P.module_id(p, ("src", "packages")).alias("module_id"))


def identifier_case_tally(spark, folder):
    d = _docs(spark, folder).filter(F.col("path").rlike(SCRIPTS) & ~P.basename(F.col("path")).startswith("index."))
    return d.groupBy("repo", words.identifier_case(P.stem(F.col("path"))).alias("case")).agg(F.count("*").alias("n"))


def dominant_case(spark, folder):
    d = _docs(spark, folder).filter(F.col("path").rlike(SCRIPTS)).select("repo", words.identifier_case(P.stem(F.col("path"))).alias("case")).filter("case <> 'other'")
    return tables.dominant(d, ["repo"], "case", 6, 0.4).select("repo", "case", "count", F.col("total").cast("long").alias("total"))


def stem_terms(spark, folder):
    w = _docs(spark, folder).select(F.explode(words.split_identifier(F.col("text"))).alias("word")).filter("word RLIKE '^[a-z]{2,}$'").groupBy("word").agg(F.count("*").alias("n"))
    return w.select("word", "n", words.stem(F.col("word")).alias("stem"))


def path_words(spark, folder):
    return _docs(spark, folder).select("doc_id", F.array_join(words.path_words(F.col("path")), " ").alias("words"))


def classified_files(spark, folder):
    return _docs(spark, folder).groupBy("repo", file_ops.kind_of(F.col("path")).alias("kind"), file_ops.language_of(F.col("path")).alias("language")).agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))


def sensitive_files(spark, folder):
    return table(spark, folder, "files").select("repo", "path").distinct().filter(file_ops.is_sensitive(F.col("path"), ["deploy/**", "!deploy/**/*.md"]))


def scan_scope(spark, folder):
    f = table(spark, folder, "files").select("repo", "path").distinct()
    return f.select("repo", "path", any_match(F.col("path"), file_ops.INCLUDE).alias("included"), last_match(F.col("path"), [*file_ops.EXCLUDE, "!vendor/**/*.ts"]).alias("excluded")).groupBy("repo", "included", "excluded").agg(F.count("*").alias("files"))


def secret_rules(spark, folder):
    line = _docs(spark, folder).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).filter(contains_secret(F.col("line")))
    return line.select("doc_id", (F.col("n") + 1).cast("long").alias("line_no"), F.array_join(matched_rules(F.col("line")), ",").alias("rules"), redact(F.col("line")).alias("redacted"))


def languages_counted(spark, folder):
    d = _docs(spark, folder).select(file_ops.language_of(F.col("path")).alias("language"))
    return tables.count_by(d, "language")


def content_duplicates(spark, folder):
    return file_ops.duplicates(_docs(spark, folder).select("repo", "path", F.sha2("text", 256).alias("hash")))


def _read(spark, folder, suffix):
    """Facts of the documents whose path ends so, by the readers of their language."""
    return read_facts(_docs(spark, folder).filter(F.col("path").endswith(suffix)))


def markdown_headings(spark, folder):
    h = F.from_json(F.get_json_object("metadata", "$.headings"), "array<struct<level: bigint, title: string, line: bigint>>")
    return _read(spark, folder, ".md").select("repo", "path", F.explode(h).alias("h")).select("repo", "path", F.col("h.line").alias("line_no"), "h.level", "h.title")


def markdown_links(spark, folder):
    links = F.from_json(F.get_json_object("metadata", "$.links"), "array<struct<target: string>>")
    return _read(spark, folder, ".md").select("repo", "path", F.explode(links).alias("l")).groupBy("repo", "path", F.col("l.target").alias("target")).agg(F.count("*").alias("n"))


def json_keys(spark, folder):
    d = _read(spark, folder, ".json").filter("language = 'json' AND status = 'ok'").filter(F.get_json_object("metadata", "$.root") == "object")
    return d.select("repo", "path", F.array_join(F.from_json(F.get_json_object("metadata", "$.keys"), "array<string>"), ",").alias("keys"))


def manifests(spark, folder):
    d = _read(spark, folder, "package.json").filter("language = 'package-json' AND status = 'ok'")
    g = lambda k: F.get_json_object("metadata", f"$.{k}")
    return d.select("repo", P.dirname(F.col("path")).alias("directory"), g("name").alias("name"), g("version").alias("version"), g("type").alias("type"), (g("private") == "true").alias("private"))


# imports and the graph
def _imports(spark, folder):
    return quick_imports(_docs(spark, folder))


def static_imports(spark, folder):
    """All imports, with their kind."""
    return _imports(spark, folder).select("repo", "path", F.col("at").cast("long").alias("at"), "specifier", "syntax")


def _resolved(spark, folder, imports):
    d = _docs(spark, folder)
    hidden = table(spark, folder, "files").filter("sensitive").select("repo", "path", F.lit("sensitive").alias("excluded")).distinct()
    known = d.select("repo", "path", F.lit(None).cast("string").alias("excluded")).join(hidden.select("repo", "path"), ["repo", "path"], "left_anti").unionByName(hidden)
    a = spark.createDataFrame(list(ALIASES), "pattern string, targets array<string>, base string, source string")
    aliases = d.select("repo").distinct().crossJoin(F.broadcast(a)).select("repo", "pattern", "targets", "base", "source")
    return resolution.resolve(imports, known, aliases, spark.createDataFrame([], NO_PACKAGES))


def resolved_imports(spark, folder):
    return _resolved(spark, folder, _imports(spark, folder)).select("repo", "path", "specifier", "kind", "target", "reason", "confidence")


def import_gaps(spark, folder):
    u = issues.causes(resolution.unresolved(_resolved(spark, folder, _imports(spark, folder))))
    return tables.fold(u, ["repo", "cause"]).select("repo", "cause", "count", "subject", F.array_join("samples", "|").alias("samples"))


def package_signals(spark, folder):
    s = _imports(spark, folder).select("specifier").distinct()
    i = importance(package_name(F.col("specifier")), is_builtin(F.col("specifier")), F.lit(False))
    return s.select("specifier", package_name(F.col("specifier")).alias("package"), is_builtin(F.col("specifier")).alias("builtin"), F.array_join(signals(F.col("specifier")), ",").alias("signals"), F.when(package_name(F.col("specifier")).isNotNull(), i["value"]).alias("importance"))


def _modules(spark, folder):
    f = _docs(spark, folder).select("repo", "path", F.when(F.col("path").rlike(SCRIPTS), "source").otherwise("other").alias("kind"))
    return modules.build_modules(f, spark.createDataFrame([], NO_PACKAGES))


def module_files(spark, folder):
    return _modules(spark, folder).select("repo", "path", "module", "basis", "directory")


def _edges(spark, folder):
    imports = cut(_imports(spark, folder))  # read twice; the texts aren't
    return cut(modules.file_edges(imports, _resolved(spark, folder, imports)))


def _module_edges(spark, folder, mods=None):
    return modules.module_edges(_edges(spark, folder), _modules(spark, folder) if mods is None else mods)


def module_edges(spark, folder):
    return _module_edges(spark, folder).select("repo", "source", "target", "files", F.array_join("relationships", ",").alias("relationships"), (F.size("evidence") - 1).cast("long").alias("shown"))


def module_neighbours(spark, folder):
    return modules.neighbours(_module_edges(spark, folder))


def neighbour_lists(spark, folder):
    n = modules.neighbour_lists(_module_edges(spark, folder), 5)
    return n.select("repo", "module", F.array_join("depends_on", "|").alias("depends_on"), "depends_on_n", F.array_join("used_by", "|").alias("used_by"), "used_by_n")


def incoming_imports(spark, folder):
    return modules.incoming(_edges(spark, folder))


def external_packages(spark, folder):
    none = spark.createDataFrame([], "repo string, package string, dependency string, scope string")
    return modules.externals(_edges(spark, folder), _modules(spark, folder), none).select("repo", "name", "scope", "files", "modules", "importance", "confidence")


def directory_cycles(spark, folder):
    """Cycles between directories, whatever their depth."""
    e = _edges(spark, folder).filter("target_kind = 'file'")
    return graph.cycles(e.select("repo", P.dirname(F.col("source")).alias("source"), P.dirname(F.col("target")).alias("target")).filter("source <> target").distinct())


def dependents_within_3(spark, folder):
    e = _edges(spark, folder).filter("target_kind = 'file'").select("repo", "source", "target").distinct()
    starts = e.select("repo", F.col("target").alias("node")).distinct()
    return graph.reachable(e, starts, 3, reverse=True).select("repo", "start", "node", F.col("level").cast("long").alias("level"))


def affected_modules(spark, folder):
    changed = _docs(spark, folder).filter("fetched_at >= TIMESTAMP_NTZ '2024-06-01 00:00:00'").select("repo", "path")
    mods = cut(_modules(spark, folder))
    return graph.affected(changed, mods, _module_edges(spark, folder, mods))


def edges_between(spark, folder):
    e, m = _edges(spark, folder), cut(_modules(spark, folder))
    pairs = modules.module_edges(e, m).select("repo", "source", "target")
    return graph.between(e, pairs, m).select("repo", "source", "target", "files", F.array_join("relationships", ",").alias("relationships"))


def longest_prefix(spark, folder):
    d = _docs(spark, folder).select("repo", "path")
    dirs = d.select("repo", P.dirname(F.col("path")).alias("directory")).groupBy("repo", "directory").agg(F.count("*").alias("n")).filter("n >= 2").withColumn("owner", F.col("directory"))
    return modules.longest_prefix(d, "path", dirs.select("repo", "directory", "owner"), "owner")


# rules
def _roles(spark, folder, mods):
    told = _imports(spark, folder).select("repo", "path", signals(F.col("specifier")).alias("signals"))
    entries = spark.createDataFrame([], "repo string, module string, type string, path string")
    return rules.roles(mods, rules.module_signals(told, mods), entries, spark.createDataFrame([], "repo string, name string"))


def noisy_or_roles(spark, folder):
    """Roles from names and from what imports tell; entry points and manifests are left to ``module_roles``."""
    return _roles(spark, folder, cut(_modules(spark, folder))).select("repo", "module", F.col("rank").cast("long").alias("rank"), "role", "confidence")


def layering_violations(spark, folder):
    mods = cut(_modules(spark, folder))
    return rules.layering(_module_edges(spark, folder, mods), _roles(spark, folder, mods)).select("repo", "source", "target", "kind")


def precision_recall(spark, folder):
    f = table(spark, folder, "files").filter("path LIKE '%.json' AND doc_id IS NOT NULL")
    found = f.groupBy("doc_id").agg(F.max_by("parse_status", F.struct("scanned_at", "parse_status")).alias("s")).filter("s IN ('failed', 'partial')").select("doc_id")
    truth = _docs(spark, folder).filter(F.col("path").like("%.json") & F.col("text").isNotNull() & F.try_parse_json("text").isNull()).select("doc_id")
    return tables.agreement(found, truth, ["doc_id"])


def evidence_coverage(spark, folder):
    u = table(spark, folder, "unresolved_imports").select("repo", "file", "specifier", "attempts")
    return tables.evidence_coverage(u, "attempts")


def first_wins(spark, folder):
    f = table(spark, folder, "files").select("repo", "path", F.col("language").alias("said")).filter("said IS NOT NULL")
    d = _docs(spark, folder).select("repo", "path", F.col("lang").alias("said")).filter("said IS NOT NULL")
    return tables.first_wins([d, f], ["repo", "path"], ["said"])


def set_difference(spark, folder):
    return tables.difference(table(spark, folder, "files"), _docs(spark, folder), ["repo", "path"])


def import_statistics(spark, folder):
    i = _imports(spark, folder).select("repo", "path", "specifier", "syntax", F.col("at").alias("line"), (F.col("syntax") == "type-only").alias("type_only"))
    a = spark.createDataFrame(list(ALIASES), "pattern string, targets array<string>, base string, source string")
    a = i.select("repo").distinct().crossJoin(F.broadcast(a))
    return conventions.import_statistics(i, a).select("repo", "files", *(F.col(c).cast("long").alias(c) for c in ("relative", "alias", "external", "explicit", "requires", "typed_files", "mixed_files", "external_first")))


def package_managers(spark, folder):
    d = _docs(spark, folder)
    m = workspace.managers(d, read_facts(d.filter("path LIKE '%package.json'")))
    return m.select("repo", "manager", F.array_join("lockfiles", ",").alias("lockfiles"))


def parse_reuse(spark, folder):
    """Documents fetched since SINCE, or at an unknown time: how many have a content that stands in one fetched before."""
    d = _docs(spark, folder).select("repo", "path", F.sha2("text", 256).alias("hash"), file_ops.language_of(F.col("path")).alias("language"), F.coalesce(F.col("fetched_at") < F.lit(SINCE).cast("timestamp_ntz"), F.lit(False)).alias("before")).filter("hash IS NOT NULL")
    fresh, known = file_ops.to_parse(d.filter("NOT before").drop("before"), d.filter("before").select("hash", "language"))
    n = lambda df, name: df.groupBy("repo").agg(F.count("*").alias(name))
    return n(fresh, "fresh").join(n(known, "known"), "repo", "full_outer").na.fill(0)


def unread_targets(spark, folder):
    """Delivered records of files without a document, by the kind their path stands for."""
    f = table(spark, folder, "files").select("repo", "path").distinct()
    return tables.difference(f, _docs(spark, folder), ["repo", "path"]).groupBy("repo", file_ops.kind_of(F.col("path")).alias("kind")).agg(F.count("*").alias("files"))


# search
def _search_documents(spark, folder):
    d = _docs(spark, folder)
    return d.select(F.col("doc_id").cast("string").alias("id"), F.col("path").alias("title"), F.array_compact(F.array("lang", "source")).alias("keywords"), F.col("text").alias("body"))


def bm25_search(spark, folder):
    i = search.Index.build(_search_documents(spark, folder))
    return search.search(i, QUERY, limit=20).select("id", "score", F.array_join("matched", ",").alias("matched"))


def term_frequencies(spark, folder):
    p = search.Index.build(_search_documents(spark, folder)).postings
    return p.filter("term RLIKE '^[a-z]{2,}$'").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("tf"))


# changes
def listing_changes(spark, folder):
    """First against last listing of each root."""
    s = table(spark, folder, "scan_state").select(F.col("root_id").cast("string").alias("repo"), "run_id", F.regexp_replace(F.replace("path", F.lit("\\"), F.lit("/")), r"^(\./+)+", "").alias("path"), F.regexp_replace(F.lower("hash"), "^sha256:", "").alias("hash"), "size", "mtime_ms", "arrived_at")
    r = table(spark, folder, "scan_runs").filter("status = 'succeeded'").select(F.col("root_id").cast("string").alias("repo"), "run_id", "run_no").distinct()
    ends = r.groupBy("repo").agg(F.min_by("run_id", "run_no").alias("first"), F.max_by("run_id", "run_no").alias("last")).filter("first <> last")
    pick = lambda c: s.join(ends.select("repo", F.col(c).alias("run_id")), ["repo", "run_id"]).groupBy("repo", "path").agg(F.max(F.struct("arrived_at", "hash", "size", "mtime_ms")).alias("b")).select("repo", "path", "b.hash", "b.size", "b.mtime_ms")
    c = file_ops.changes(pick("first"), pick("last").withColumn("blocked", F.coalesce(F.col("hash") == "", F.lit(False))))
    return c.select("repo", "path", "change")


from .source_sql import QUERY, SQL  # noqa: E402, F401

QUERIES = {
    f.__name__: f
    for f in (
        path_parts, identifier_case_tally, dominant_case, stem_terms, path_words, classified_files, sensitive_files, scan_scope, secret_rules, languages_counted, content_duplicates, markdown_headings, markdown_links, json_keys, manifests, static_imports, resolved_imports, import_gaps, package_signals,
        module_files, module_edges, module_neighbours, neighbour_lists, incoming_imports, external_packages, directory_cycles, dependents_within_3, affected_modules, edges_between, longest_prefix, noisy_or_roles, layering_violations, precision_recall, evidence_coverage, first_wins, set_difference, import_statistics, package_managers, parse_reuse, unread_targets, bm25_search, term_frequencies, listing_changes,
    )
}
