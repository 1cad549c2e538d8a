"""The engine end to end on a small tree: two packages, an alias, a cycle, tests, a decision record, secrets."""

import subprocess

import pytest

from codestrata.config import Config, Policy
from codestrata.engine import Engine
from codestrata.errors import AnalysisError, ConfigError, ReadOnlyError, StateError

TREE = {
    "package.json": '{"name": "root", "private": true, "type": "module", "workspaces": ["packages/*"], "scripts": {"test": "node --test", "start": "node packages/api/server.ts"}}',
    "tsconfig.json": '{ // strict\n "compilerOptions": {"strict": true, "baseUrl": ".", "paths": {"@lib/*": ["packages/core/*"],}}}',
    "README.md": "# Shop\n\nAll about payments.\n\n## Architecture\n\nLayers.\n",
    "docs/adr/0001-use-postgres.md": "# ADR-0001: Use Postgres\n\nStatus: accepted. token = abcdefgh12345678\n",
    "packages/core/package.json": '{"name": "@shop/core", "main": "index.ts", "dependencies": {"pg": "8"}, "devDependencies": {"eslint": "1"}}',
    "packages/core/index.ts": "export * from './model.js';\nexport { store } from './store';\n",
    "packages/core/model.ts": "export class Thing extends Error {}\nexport interface Shape { a: Map<string, Array<number>>; }\nexport const limit = 1, other = 2;\n",
    "packages/core/store.ts": "import pg from 'pg';\nimport { Thing } from './model';\nimport { server } from '@shop/api';\nexport function store() { return new Thing(pg); }\n",
    "packages/api/package.json": '{"name": "@shop/api", "bin": {"shop": "cli.ts"}}',
    "packages/api/server.ts": "import express from 'express';\nimport { store } from '@shop/core';\nimport { Thing } from '@lib/model';\nimport fs from 'node:fs';\nimport x from '../../../../etc/passwd';\nimport y from './gone';\nexport const app = express();\nexport function routes() { app.get('/health', () => store()); process.env.PORT; }\n",
    "packages/api/cli.ts": "import { Command } from 'commander';\nconst late = require('./server');\nimport('./server');\n",
    "packages/api/__tests__/server.test.ts": "import { app } from '../server.js';\ndescribe('x', () => {});\n",
    ".github/workflows/ci.yml": "on: push\n",
    ".env": "TOKEN=secretsecret\n",
    "node_modules/x/index.js": "module.exports = 1;\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("shop")
    for path, text in TREE.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    git = lambda *a: subprocess.run(["git", "-c", "user.name=Ada", "-c", "user.email=a@b", "-C", str(root), *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "packages", "README.md")
    git("commit", "-qm", "refactor everything")
    return str(root)


@pytest.fixture(scope="module")
def engine(spark, tree, tmp_path_factory):
    return Engine(spark, {"shop": tree}, str(tmp_path_factory.mktemp("store")), Config(include=("**/*",)))


def test_listing_keeps_hidden_names_and_never_reads_secrets(engine, rows):
    found = dict(rows(engine.sources_table, "path", "text"))
    assert ".github/workflows/ci.yml" in found and "packages/api/__tests__/server.test.ts" in found
    assert found[".env"] is None and not any(p.startswith("node_modules") for p in found)


def test_imports_resolve(engine, rows):
    got = {(r["path"].rpartition("/")[2], r["specifier"]): (r["kind"], r["target"], r["reason"]) for r in engine.resolved.collect()}
    assert got["index.ts", "./model.js"] == ("internal-file", "packages/core/model.ts", None)
    assert got["server.ts", "@lib/model"] == ("internal-file", "packages/core/model.ts", None)
    assert got["server.ts", "@shop/core"][0] == "workspace-package"
    assert got["server.ts", "express"] == ("external-package", "express", None)
    assert got["server.ts", "node:fs"][0] == "node-builtin"
    assert got["server.ts", "../../../../etc/passwd"][2] == "path-escape"
    assert got["server.ts", "./gone"][2] == "missing"
    assert got["server.test.ts", "../server.js"][1] == "packages/api/server.ts"


def test_facts_reach_bodies(engine, rows):
    assert ("GET", "/health") in rows(engine.list_of("routes"), "method", "route_path")
    syntaxes = {r[0] for r in rows(engine.list_of("imports"), "syntax")}
    assert syntaxes == {"static", "reexport", "require", "dynamic"}
    names = {r[0] for r in rows(engine.symbols, "name")}
    assert {"Thing", "Shape", "limit", "other", "store", "app", "routes"} <= names
    assert rows(engine.symbol_edges.filter("relationship = 'calls'"), "source", "target") == [("packages/core/store.ts", "packages/core/model.ts#Thing")]


def test_modules_edges_and_cycle(engine, rows):
    assert {r[0] for r in rows(engine.modules, "module")} >= {"@shop/core", "@shop/api"}
    assert {(r[0], r[1]) for r in rows(engine.module_edges, "source", "target")} >= {("@shop/api", "@shop/core"), ("@shop/core", "@shop/api")}
    assert rows(engine.cycles, "component", "node") == [("@shop/api", "@shop/api"), ("@shop/api", "@shop/core")]
    assert engine.dependents("shop", "@shop/core") == ["@shop/api"]


def test_judgements_carry_evidence(engine, rows):
    roles = rows(engine.roles, "module", "role", "confidence", "evidence")
    assert all(0.3 <= r[2] <= 0.99 and r[3] for r in roles)
    assert ("@shop/core", "repository") in {r[:2] for r in roles}
    types = {r[:2] for r in rows(engine.entry_points, "path", "type")}
    assert ("packages/core/index.ts", "package-main") in types and ("packages/api/cli.ts", "package-bin") in types
    assert ("packages/api/server.ts", "http-routes") in types and ("packages/api/server.ts", "application") in types
    said = {r[0] for r in rows(engine.conventions, "statement")}
    assert any("ESLint" in s for s in said) and any("Strict" in s for s in said) and any("GitHub" in s for s in said)
    d = {r[0]: r for r in rows(engine.decisions, "id", "status", "excerpt", "origin")}
    assert d["ADR-0001"][1] == "accepted" and "abcdefgh" not in d["ADR-0001"][2]
    assert any(k.startswith("GIT-") for k in d) and any(k.startswith("DOC-") for k in d)
    kinds = {(r[0], r[1]) for r in rows(engine.issues, "kind", "severity")}
    assert {("path-escape", "error"), ("import-cycle", "warning"), ("unresolved-import", "warning"), ("sensitive-skipped", "info")} <= kinds
    assert engine.coverage.first()["import_resolution_rate"] < 1


def test_answers(engine, rows):
    hit = engine.search("postgres decision", limit=5).collect()
    assert hit and hit[0]["score"] >= hit[-1]["score"]
    e = engine.explain("shop", "packages/core/store.ts")
    assert e["target"].first()["matched"] == "file path" and e["target"].first()["module"] == "@shop/core"
    assert rows(e["used_by"], "module") == [("@shop/api",)]
    assert engine.explain("shop", "nothing/here/at/all") is None
    i = engine.impact("shop", "@shop/core", most=1)
    assert i["truncated"] and i["modules"] == ["@shop/api"]
    assert engine.task("shop", "core store")["modules"]
    assert rows(engine.module_history("shop", "@shop/core"), "author") == [("Ada",)]
    assert engine.overview("shop")["counts"].first()["tests"] == 1
    with pytest.raises(AnalysisError):
        engine.impact("shop", "zzz")


def test_scan_state_and_diff(engine, spark, tree, rows):
    assert {r[0] for r in rows(engine.status(), "state")} == {"missing"}
    report = engine.scan()
    assert report["changes"]["added"] > 5
    again = Engine(spark, {"shop": tree}, engine.store.folder, engine.config)
    assert again.verify() and again.diff().count() == 0
    assert again.to_read.isEmpty() and not engine.to_read.isEmpty()  # all facts are stored
    assert sorted(again.facts.drop("metadata").collect(), key=str) == sorted(engine.facts.drop("metadata").collect(), key=str)
    with open(f"{tree}/README.md", "a") as f:
        f.write("more\n")
    later = Engine(spark, {"shop": tree}, engine.store.folder, engine.config)
    assert not later.verify()
    assert ("files", "README.md", "changed") in rows(later.diff(), "section", "key", "change")
    assert rows(later.to_read, "path") == [("README.md",)]
    before = later.store.current()
    with pytest.MonkeyPatch.context() as m:  # a scan that dies leaves the one before
        m.setattr(type(later.store), "write_text", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            later.scan()
    assert later.store.current() == before and engine.stored("files").count() > 0
    later.scan()
    assert Engine(spark, {"shop": tree}, engine.store.folder, engine.config).verify()
    other = Engine(spark, {"shop": tree}, engine.store.folder, Config(include=("**/*",), module_depth=3))
    assert {r[0] for r in rows(other.changes(), "change")} <= {"added", "unchanged"}  # other settings: nothing is reused
    assert engine.stored("modules").count() > 0
    with pytest.raises(StateError):
        engine.stored("nothing")


def test_settings():
    with pytest.raises(ConfigError):
        Config(module_depth=0)
    with pytest.raises(ConfigError):
        Config.read('{"include": "src"}')
    c, warnings = Config.read('{"module_depth": 3, "colour": 1}')
    assert c.module_depth == 3 and warnings
    tight = Policy(exclude=("x/**",), largest=10, read_only=True).apply(c)
    assert tight.read_only and tight.largest == 10 and "x/**" in tight.exclude and Policy().apply(tight).read_only


def test_read_only(spark, tree):
    with pytest.raises(ReadOnlyError):
        Engine(spark, {"shop": tree}, "/tmp/never", Config(read_only=True)).scan()
    with pytest.raises(AnalysisError):
        Engine(spark, {"shop": tree + "/gone"})
