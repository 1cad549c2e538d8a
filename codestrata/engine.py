"""One object per set of source trees: scan, tables, answers. Tables are lazy and kept between calls."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .config import Config, Policy
from .errors import AnalysisError, ReadOnlyError, StateError
from .functions import paths as P
from .functions.words import query_weights
from .operators import activity, context, conventions, decisions, diagnostics, diff, entry_points, graph, issues, modules, resolution, rules, search, workspace
from .operators import files as file_ops
from .session import cut, stored
from .sources.facts import Registry, default_registry, exploded, read_facts
from .sources.git_history import Git, parse_diff, read_history
from .sources.repo_files import read_tree
from .sources.store import SCHEMA_VERSION, Store, canonical

FACTS_KEY = ("hash", "reader")
STORED = ("files", "modules", "roles", "entry_points", "module_edges", "externals", "conventions", "decisions", "cycles", "issues")


class Engine:
    """``sources``: a DataFrame (repo, path, text), or folders by repository name. ``store``: folder for stored tables."""

    def __init__(self, spark: SparkSession, sources: DataFrame | dict[str, str], store: str | None = None, config: Config | None = None, policy: Policy | None = None, commits: DataFrame | None = None, commit_files: DataFrame | None = None, registry=default_registry):
        self.spark, self.sources, self.registry = spark, sources, registry
        self.config = (policy or Policy(forbid_sensitive=False, redact_secrets=False)).apply(config or Config())
        self.store = Store(spark, store) if store else None
        self._given = (commits, commit_files)
        if isinstance(sources, dict):
            import os

            for root in sources.values():
                if not os.path.isdir(root):
                    raise AnalysisError(f"no such folder: {root}", "give the root of a checkout")

    def _write(self) -> Store:
        if self.config.read_only:
            raise ReadOnlyError("this engine may only read")
        if self.store is None:
            raise StateError("the engine has no store", "give a folder as store")
        return self.store

    # tables
    @cached_property
    def sources_table(self) -> DataFrame:
        if isinstance(self.sources, DataFrame):
            c = self.config
            have = self.sources.select("repo", "path", "text")
            r = have.withColumn("sensitive", file_ops.is_sensitive(F.col("path"), list(c.extra_sensitive), c.allow_sensitive)).withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
            blocked = F.col("sensitive") | (F.col("size") > c.largest)
            return r.select("repo", "path", "size", F.lit(None).cast("long").alias("mtime_ms"), "sensitive", (F.col("size") > c.largest).alias("too_large"), F.when(~blocked, F.col("text")).alias("text"))
        c = self.config
        return cut(read_tree(self.spark, self.sources, include=c.include, exclude=c.exclude, ignore=c.ignore, extraSensitive=c.extra_sensitive, allowSensitive=c.allow_sensitive, largest=c.largest, followSymlinks=c.follow_symlinks))

    @cached_property
    def _cache(self) -> DataFrame | None:
        """Facts of the stored scan, by content, if readers and settings are the same."""
        now = self.store.current() if self.store else None
        return self.store.read("facts_cache") if now and now.get("readers") == self._readers() else None

    def _readers(self) -> str:
        return f"{__version__} {self.config.languages} {self.registry.__module__}.{self.registry.__qualname__}"

    @cached_property
    def contents(self) -> DataFrame:
        """``repo, path, hash, reader`` of the texts; equal ones with the same reader have the same facts."""
        reader = F.concat_ws(":", file_ops.language_of(F.col("path")), F.lower(P.extname(F.col("path"))))
        return cut(self.sources_table.filter("text IS NOT NULL").select("repo", "path", F.sha2("text", 256).alias("hash"), reader.alias("reader")))

    @cached_property
    def to_read(self) -> DataFrame:
        """``repo, path`` of the files whose content the stored facts don't know."""
        if self._cache is None:
            return self.contents.select("repo", "path")
        return file_ops.to_parse(self.contents, self._cache, FACTS_KEY)[0].select("repo", "path")

    @cached_property
    def facts(self) -> DataFrame:
        """Stored facts where the content is known, else the readers'. Texts stay where they are if few are new, for then
        AQE sends the paths of those to them."""
        texts = self.sources_table.filter("text IS NOT NULL")
        if self._cache is None:
            return cut(read_facts(texts, self.config.languages, self.registry))
        fresh = read_facts(texts.join(self.to_read.distinct(), ["repo", "path"], "left_semi"), self.config.languages, self.registry)
        _, known = file_ops.to_parse(self.contents, self._cache, FACTS_KEY)
        return cut(fresh.unionByName(known.filter("status IS NOT NULL").select(fresh.columns)))  # no status: no reader

    @cached_property
    def files(self) -> DataFrame:
        s = self.sources_table.join(self.facts.select("repo", "path", F.col("language").alias("l"), "signals", "status"), ["repo", "path"], "left")
        kind = F.when(F.col("sensitive"), "other").otherwise(file_ops.kind_of(F.col("path"), F.col("signals")))
        hash_ = F.when(F.col("sensitive") | F.col("too_large"), "").otherwise(F.sha2("text", 256))
        return cut(s.select("repo", "path", hash_.alias("hash"), "size", "mtime_ms", F.coalesce("l", F.lit("unknown")).alias("language"), kind.alias("kind"), F.col("sensitive"), "too_large", F.coalesce("status", F.lit("skipped")).alias("parse_status"), "signals"))

    def list_of(self, what: str) -> DataFrame:
        """imports, exports, symbols, calls or routes of all files."""
        return exploded(self.facts, what)

    @cached_property
    def packages(self) -> DataFrame:
        return cut(workspace.packages(self.facts))

    @cached_property
    def managers(self) -> DataFrame:
        return cut(workspace.managers(self.files, self.facts))

    @cached_property
    def modules(self) -> DataFrame:
        return cut(modules.build_modules(self.files, self.packages, self.config.module_depth))

    @cached_property
    def aliases(self) -> DataFrame:
        return cut(resolution.alias_entries(self.facts))

    @cached_property
    def resolved(self) -> DataFrame:
        reached = F.when(F.col("sensitive"), "the sensitive-file policy forbids reading it").when(F.col("too_large"), "it exceeds the largest size that is read")
        known = self.files.select("repo", "path", reached.alias("excluded"))
        return cut(resolution.resolve(self.list_of("imports"), known, self.aliases, workspace.entry_bases(self.packages)))

    @cached_property
    def unresolved(self) -> DataFrame:
        return resolution.unresolved(self.resolved)

    @cached_property
    def file_edges(self) -> DataFrame:
        return cut(modules.file_edges(self.list_of("imports"), self.resolved))

    @cached_property
    def symbols(self) -> DataFrame:
        """The first symbol of a name per file."""
        return self.list_of("symbols").groupBy("repo", "path", "name").agg(F.min(F.struct("at", "kind", "exported", "is_default", "extends", "implements", "line")).alias("s")).select("repo", "path", "name", "s.*").transform(cut)

    @cached_property
    def symbol_edges(self) -> DataFrame:
        return modules.symbol_edges(self.list_of("calls"), self.symbols, modules.imported_names(self.list_of("imports")), self.resolved)

    @cached_property
    def module_edges(self) -> DataFrame:
        return cut(modules.module_edges(self.file_edges, self.modules))

    @cached_property
    def externals(self) -> DataFrame:
        return cut(modules.externals(self.file_edges, self.modules, workspace.declared_dependencies(self.packages)))

    @cached_property
    def exports(self) -> DataFrame:
        return cut(modules.public_exports(self.symbols, self.modules))

    @cached_property
    def cycles(self) -> DataFrame:
        return cut(graph.cycles(self.module_edges))

    @cached_property
    def entry_points(self) -> DataFrame:
        return cut(entry_points.entry_points(self.files, self.facts, self.modules, self.packages))

    @cached_property
    def roles(self) -> DataFrame:
        return cut(rules.roles(self.modules, rules.module_signals(self.facts, self.modules), self.entry_points.filter("module IS NOT NULL"), self.externals))

    @cached_property
    def responsibilities(self) -> DataFrame:
        return cut(rules.responsibilities(self.modules, self.roles, self.exports, rules.module_signals(self.facts, self.modules), self.facts))

    @cached_property
    def layering(self) -> DataFrame:
        return cut(rules.layering(self.module_edges, self.roles))

    @cached_property
    def conventions(self) -> DataFrame:
        c = conventions.conventions(self.files, self.facts, self.symbols, self.list_of("imports"), self.aliases, self.modules, self.roles, self.packages, self.managers)
        return cut(c if self.config.conventions else c.limit(0))

    @cached_property
    def history(self) -> tuple[DataFrame, DataFrame]:
        if self._given[0] is not None:
            return self._given
        if isinstance(self.sources, dict) and self.config.git:
            return read_history(self.spark, self.sources, self.config.window_days, self.config.most_commits)
        return self.spark.createDataFrame([], "repo string, sha string, author string, ts timestamp, subject string"), self.spark.createDataFrame([], "repo string, sha string, path string")

    @cached_property
    def decisions(self) -> DataFrame:
        d = decisions.decisions(self.facts, self.packages, self.managers, self.externals, self.history[0] if self.config.git else None)
        return cut(d if self.config.decisions else d.limit(0))

    @cached_property
    def touches(self) -> DataFrame:
        return cut(activity.touches(*self.history, self.files, self.modules))

    def activity(self, key: str, now) -> DataFrame:
        """Activity per ``path`` or ``module`` at a given time."""
        return activity.activity(self.touches.filter(F.col(key).isNotNull()), key, now, self.config.recent_days)

    @cached_property
    def issues(self) -> DataFrame:
        return cut(issues.issues(issues.subjects(self.unresolved, self.files, self.facts, self.cycles, self.layering, self.modules, self.module_edges)))

    @cached_property
    def coverage(self) -> DataFrame:
        return issues.coverage(self.files, self.facts, self.unresolved, self.module_edges, self.resolved)

    # answers
    @cached_property
    def context_tables(self) -> context.Tables:
        return context.Tables(self.files, self.facts, self.symbols, self.modules, self.file_edges, self.module_edges, self.externals, self.exports, self.entry_points, self.roles, self.responsibilities, self.conventions, self.decisions, self.packages)

    def dependents(self, repo: str, module: str) -> list[str]:
        e = self.module_edges.filter((F.col("repo") == repo) & (F.col("target") == module))
        return [r[0] for r in e.select("source").orderBy("source").collect()]

    def dependencies(self, repo: str, module: str) -> list[str]:
        e = self.module_edges.filter((F.col("repo") == repo) & (F.col("source") == module))
        return [r[0] for r in e.select("target").orderBy("target").collect()]

    def overview(self, repo: str | None = None, **limits) -> dict[str, DataFrame]:
        return context.repository_overview(self.context_tables, repo, **limits)

    def explain(self, repo: str, target: str, **options) -> dict[str, DataFrame] | None:
        return context.explain(self.context_tables, repo, target, **options)

    def impact(self, repo: str, target: str, most: int = 100) -> dict:
        """Modules, files (bounded, with a flag) and tests that a change of the target touches."""
        most = max(1, min(most, 500))
        e = self.explain(repo, target, most=most + 1)
        if e is None:
            raise AnalysisError(f'no module or file matched "{target}"')
        found = [r[0] for r in e["impact_files"].collect()]
        return {"modules": [r[0] for r in e["impact_modules"].collect()], "files": found[:most], "tests": [r[0] for r in e["tests"].collect()], "truncated": len(found) > most}

    def task(self, repo: str, text: str, target: str | None = None, most: int = 5) -> dict:
        """The modules that a task is about: the target's, then those that a search finds."""
        if not text.strip():
            raise AnalysisError("task must not be empty")
        most = max(1, min(most, 12))
        chosen: list[str] = []
        if target and (hit := context.resolve_target(self.context_tables, repo, target)):
            chosen.append(hit.module)
        prefix = f"module:{repo}:"
        for r in self.search(text, limit=most * 2, types=["module"], repo=repo).collect():
            name = r["id"].removeprefix(prefix)
            if name not in chosen:
                chosen.append(name)
        return {"task": text.strip(), "modules": [{"module": m, "depends_on": self.dependencies(repo, m), "used_by": self.dependents(repo, m)} for m in chosen[:most]], "truncated": len(chosen) >= most}

    def module_history(self, repo: str, target: str, limit: int = 50) -> DataFrame:
        hit = context.resolve_target(self.context_tables, repo, target)
        if hit is None:
            raise AnalysisError(f'no module or file matched "{target}"')
        c, f = self.history
        return activity.history(c.filter(F.col("repo") == repo), f.filter(F.col("repo") == repo), context.scope_of(self.context_tables, repo, hit), limit)

    def revision_diff(self, repo: str, revision: str, base: str = "HEAD") -> DataFrame:
        text = Git(self.sources[repo]).diff(revision, base) if isinstance(self.sources, dict) else ""
        return parse_diff(self.spark.createDataFrame([(repo, text)], "repo string, diff string"))

    def revision_snapshot(self, repo: str, revision: str) -> dict:
        c, f = self.history
        one = c.filter((F.col("repo") == repo) & F.col("sha").startswith(revision)).orderBy(F.desc("ts")).first()
        if one is None:
            return {"revision": revision, "available": False, "reason": "revision is unavailable or repository has no commit"}
        paths = [r[0] for r in f.filter((F.col("repo") == repo) & (F.col("sha") == one.sha)).select("path").orderBy("path").collect()]
        return {"revision": revision, "available": True, "sha": one.sha, "author": one.author, "subject": one.subject, "files": paths, **context.revision_counts(self.context_tables, repo, paths).asDict()}

    @cached_property
    def search_documents(self) -> DataFrame:
        """Files, modules, symbols, decisions, conventions and entry points as documents of one shape."""
        word = lambda label, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(label), c))
        text = lambda *p: F.concat_ws("\n", *p)
        some = lambda c, n: F.array_join(F.slice(c, 1, n), ", ")
        key = lambda kind, *c: F.concat(F.lit(kind + ":"), "repo", F.lit(":"), *c).alias("id")
        m, f = self.modules, self.facts
        public = self.symbols.filter("exported").groupBy("repo", "path").agg(F.array_sort(F.collect_set("name")).alias("names"))
        ff = self.files.join(f.select("repo", "path", "routes", "imports"), ["repo", "path"], "left").join(public, ["repo", "path"], "left").join(m.select("repo", "path", "module"), ["repo", "path"], "left")
        body = text(word("kind: ", F.col("kind")), word("language: ", F.col("language")), word("module: ", F.col("module")), word("signals: ", F.array_join("signals", ", ")), word("exports: ", some("names", 25)), word("routes: ", F.array_join(F.transform("routes", lambda r: F.concat(r["method"], F.lit(" "), r["path"])), ", ")), word("imports: ", some(F.array_distinct(F.transform("imports", lambda i: i["specifier"])), 20)))
        parts = [ff.select("repo", key("file", "path"), F.lit("file").alias("type"), F.col("path").alias("title"), body.alias("body"), F.array_compact(F.concat(F.array("language", "kind", "module"), F.coalesce("signals", F.array().cast("array<string>")))).alias("keywords"))]
        r = self.roles.groupBy("repo", "module").agg(F.array_sort(F.collect_list("role")).alias("roles"))
        mm = m.groupBy("repo", "module", "basis", "directory").agg(F.count("*").alias("n")).join(r, ["repo", "module"], "left").join(modules.neighbour_lists(self.module_edges, 2**31 - 1), ["repo", "module"], "left")
        body = text(word("path: ", F.col("directory")), word("basis: ", F.col("basis")), word("roles: ", F.array_join("roles", ", ")), word("depends on: ", F.array_join("depends_on", ", ")), word("used by: ", F.array_join("used_by", ", ")), F.concat(F.lit("files: "), F.col("n").cast("string")))
        parts.append(mm.select("repo", key("module", "module"), F.lit("module").alias("type"), F.col("module").alias("title"), body.alias("body"), F.array_compact(F.concat(F.array("directory", "basis"), F.coalesce("roles", F.array().cast("array<string>")))).alias("keywords")))
        s = self.symbols
        parts.append(s.select("repo", key("symbol", "path", F.lit("#"), "name"), F.lit("symbol").alias("type"), F.col("name").alias("title"), text(F.concat("kind", F.lit(" in "), "path"), F.when(F.col("exported"), "exported").otherwise("internal"), word("extends ", F.array_join("extends", ", ")), word("implements ", F.array_join("implements", ", "))).alias("body"), F.array("path", "kind").alias("keywords")))
        parts.append(self.decisions.select("repo", key("decision", "id"), F.lit("decision").alias("type"), "title", text("excerpt", F.concat(F.lit("status: "), "status"), F.concat(F.lit("origin: "), "origin"), "source").alias("body"), F.array("id", "status", "kind").alias("keywords")))
        parts.append(self.conventions.select("repo", F.concat(F.lit("convention:"), "repo", F.lit(":"), "id").alias("id"), F.lit("convention").alias("type"), F.col("statement").alias("title"), text("category", F.array_join("evidence", "\n")).alias("body"), F.array("category", "origin").alias("keywords")))
        parts.append(self.entry_points.select("repo", key("entry-point", "path", F.lit(":"), "type"), F.lit("entry-point").alias("type"), F.concat("path", F.lit(" ("), "type", F.lit(")")).alias("title"), F.col("detail").alias("body"), F.array_compact(F.array("type", "module")).alias("keywords")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return cut(out)

    @cached_property
    def index(self) -> search.Index:
        i = search.Index.build(self.search_documents)
        return search.Index(i.documents, stored(i.rows))

    def search(self, text: str, limit: int = 10, types: list[str] | None = None, repo: str | None = None, backend=search.search, reranker=None) -> DataFrame:
        i = self.index
        if repo is not None:
            i = search.Index.build(self.search_documents.filter(F.col("repo") == repo))
        found = backend(i, text, limit=limit, types=types)
        if reranker:
            found = reranker(text, found)
        return search.results(found, i.documents, len(query_weights(text))).orderBy(F.desc("score"), "id")

    @cached_property
    def diagnostics(self) -> DataFrame:
        """Files that failed, were read in part, or weren't opened, in one order."""
        left_out = F.when(F.col("too_large"), "larger than the limit")
        return cut(diagnostics.of_files(self.files.withColumn("skipped_reason", left_out)))

    # state
    def state(self) -> DataFrame:
        return self.files.select("repo", "path", "hash", "size", "mtime_ms", "language", "kind", (F.col("sensitive") | F.col("too_large")).alias("blocked"))

    def changes(self) -> DataFrame:
        now = self.store.current() if self.store else None
        old = self.store.read("state") if now and now.get("config_hash") == self.config.hash(__version__) else None
        if old is None:
            old = self.state().limit(0)
        return file_ops.changes(old, self.state())

    def status(self) -> DataFrame:
        """Per repository: up-to-date, stale or missing. Nothing is written."""
        return file_ops.status(self.changes(), self.store is not None and self.store.exists("state"))

    def diff(self) -> DataFrame:
        """What changed against the stored tables; everything is added where none are stored."""
        now = {n: getattr(self, n) for n in STORED if n not in ("cycles", "issues")}
        old = {n: (self.store.read(n) if self.store else None) for n in now}
        return diff.context_diff({n: t if t is not None else now[n].limit(0) for n, t in old.items()}, now)

    def scan(self, dry_run: bool = False) -> dict:
        """Analyze and store. The report counts changes; a dry run writes nothing."""
        counts = {r["change"]: r["count"] for r in self.changes().groupBy("change").count().collect()}
        report = {"schema_version": SCHEMA_VERSION, "changes": counts, "files": self.files.count(), "stored": []}
        if dry_run:
            return report
        store = self._write()
        store.begin()
        for name in STORED:
            store.write(name, getattr(self, name))
            report["stored"].append(name)
        store.write_facts(self.contents.join(self.facts, ["repo", "path"], "left").dropDuplicates(list(FACTS_KEY)).drop("repo", "path"))
        store.write("state", self.state())
        store.write_text("index.json", canonical({"schema_version": SCHEMA_VERSION, "tables": sorted(STORED)}))
        for r in conventions.markdown(self.conventions).collect() if self.files.select("repo").distinct().count() == 1 else []:
            store.write_text("conventions.md", r["text"])
        store.commit(config_hash=self.config.hash(__version__), readers=self._readers(), tables=sorted(STORED))
        return report

    def init(self, force: bool = False) -> bool:
        """Write the settings beside the store unless they are there; whether they were written."""
        import json
        from dataclasses import asdict

        store = self._write()
        if store.get_text("config.json") is not None and not force:
            return False
        store.put_text("config.json", canonical(json.loads(json.dumps(asdict(self.config)))))
        return True

    def stored(self, name: str) -> DataFrame:
        t = self.store.read(name) if self.store else None
        if t is None:
            raise StateError(f"no stored table {name}", "run scan first")
        return t

    def verify(self) -> bool:
        """Whether the stored tables are those of the sources as they are."""
        return self.store is not None and self.store.exists("state") and self.status().filter("state <> 'up-to-date'").isEmpty()

    def clean(self) -> None:
        self._write().clear()


class Pool:
    """One engine per set of sources, made when it is first asked for. One that can't be made isn't kept."""

    def __init__(self, make, most: int = 8):
        self.make, self.most, self._kept = make, most, {}

    def get(self, name: str) -> Engine:
        """The engine of a name, the least recently asked for giving way beyond ``most``."""
        if name in self._kept:
            self._kept[name] = self._kept.pop(name)
        else:
            self._kept[name] = self.make(name)  # what is raised here leaves nothing behind
            while len(self._kept) > self.most:
                self._kept.pop(next(iter(self._kept)))
        return self._kept[name]


__all__ = ["Engine", "Pool", "Registry"]
