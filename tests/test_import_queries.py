"""The queries on imports over all imports: a small tree whose every edge is written down."""

from datetime import datetime, timedelta

import pytest

from codestrata.plans import activity_queries
from codestrata.plans.source_queries import QUERIES
from codestrata.sources.quick_imports import quick_imports

TEXTS = {
    "src/a/one.js": "const b = require('../b/two');\nrequire('express');\n",
    "src/a/index.ts": "export * from './one';\n",
    "src/b/two.ts": "import {\n  x,\n  y,\n} from '../c/three';\nexport async function f() { return import('../a/one'); }\n",
    "src/b/index.ts": "﻿import '../c/three';\n",
    "src/c/broken.ts": "import { a\x00\nimport '../a/index';\n",
    "src/c/three.ts": "import fs from 'node:fs';\nexport const x = 1, y = 2;\n",
}
EDGES = {("src/a/one.js", "src/b/two.ts"), ("src/a/index.ts", "src/a/one.js"), ("src/b/two.ts", "src/c/three.ts"), ("src/b/two.ts", "src/a/one.js"), ("src/b/index.ts", "src/c/three.ts"), ("src/c/broken.ts", "src/a/index.ts")}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, "o/r", p, t, datetime(2024, 7, 1)) for i, (p, t) in enumerate(TEXTS.items())] + [(99, "o/r", "src/n.ts", None, datetime(2024, 7, 1))]
    spark.createDataFrame(rows, "doc_id bigint, repo string, path string, text string, fetched_at timestamp_ntz").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "repo string, path string, sensitive boolean").write.parquet(f"{d}/files.parquet")
    return d


def test_every_import_is_an_edge(spark, folder, rows):
    got = QUERIES["resolved_imports"](spark, folder)
    assert set(rows(got.filter("kind = 'internal-file'"), "path", "target")) == EDGES
    assert rows(got.filter("kind <> 'internal-file'"), "path", "target", "kind") == [("src/a/one.js", "express", "external-package"), ("src/c/three.ts", "node:fs", "node-builtin")]


def test_queries_over_all_edges(spark, folder, rows):
    run = lambda name: QUERIES[name](spark, folder)
    assert rows(run("module_edges"), "source", "target", "files") == [("src/a", "src/b", 1), ("src/b", "src/a", 1), ("src/b", "src/c", 2), ("src/c", "src/a", 1)]
    assert rows(run("incoming_imports"), "path", "imported") == [("src/a/index.ts", 1), ("src/a/one.js", 2), ("src/b/two.ts", 1), ("src/c/three.ts", 2)]
    users: dict = {}
    for s, t in EDGES:
        users.setdefault(t, set()).add(s)
    want = []
    for start in users:
        seen, front = {start}, {start}
        for level in (1, 2, 3):
            front = {s for n in front for s in users.get(n, ())} - seen
            seen |= front
            want += [(start, n, level) for n in front]
    assert rows(run("dependents_within_3"), "start", "node", "level") == sorted(want, key=repr)


FORMS = [
    ("import a, { b as c,\n  d } from 'x';", [("x", "static")]), ("import type { T } from \"./t\"; import type from 'u'", [("./t", "type-only"), ("u", "static")]), ("import 'side'\nimport * as n from`no`", [("side", "side-effect")]), ("export * from './a'; export * as ns from './b'; export { x, y as z } from './c'; export type { T } from './d'", [(f"./{c}", "reexport") for c in "abcd"]),
    ("export default 'x'; export const y = 'z'; export { q };", []), ("const a = require('r'), b = require( `s` ); require.resolve('no'); x.require('no')", [("r", "require"), ("s", "require")]), ("import q = require('q')", [("q", "import-equals")]), ("await import('./lazy'); import(\"./b\", {}); import(`./${x}`)", [("./lazy", "dynamic"), ("./b", "dynamic")]),
    ("// import 'no'\n/* import 'no'\nrequire('no') */ import 'yes' // require('no')", [("yes", "side-effect")]), ("const s = \"import 'no'\", t = `require('no')`, u = 'it\\'s require(\"no\")';", []), ("﻿import 'bom'", [("bom", "side-effect")]), ("import { a, // c 'x'\n b } from 'y'", [("y", "static")]), ("reimport 'no'; $import('no'); const http = 'http://x'; import z from 'z'", [("z", "static")]),
]


def test_forms_of_imports(spark):
    df = spark.createDataFrame([(str(n), "a.ts", t) for n, (t, _) in enumerate(FORMS)] + [("x", "a.ts", None), ("x", None, "import 'a'"), ("x", "a.md", "import 'a'")], "repo string, path string, text string")
    got = {}
    for r in quick_imports(df).orderBy("at").collect():
        got.setdefault(int(r["repo"]), []).append((r["specifier"], r["syntax"]))
    assert [got.get(n, []) for n in range(len(FORMS))] == [want for _, want in FORMS]


def test_cycles_of_whole_directories(spark, folder, rows):
    assert rows(QUERIES["directory_cycles"](spark, folder), "component", "node") == [("src/a", "src/a"), ("src/a", "src/b"), ("src/a", "src/c")]


def test_reuse_by_time(spark, tmp_path, rows):
    old, new = datetime(2024, 5, 31), datetime(2024, 6, 1)
    d = [(2, "r", "a.ts", "x", old), (4, "r", "b.ts", "x", new), (6, "r", "c.ts", "y", new), (8, "r", "d.py", "x", None), (10, "r", "e.ts", None, new)]
    spark.createDataFrame(d, "doc_id bigint, repo string, path string, text string, fetched_at timestamp_ntz").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(QUERIES["parse_reuse"](spark, str(tmp_path)), "repo", "fresh", "known") == [("r", 2, 1)]


def test_all_events_and_suppliers(spark, tmp_path, rows):
    types = "abcacdc"  # b is never the most frequent successor of anything
    e = [(i, 1, t, datetime(2024, 1, 1) + timedelta(hours=i)) for i, t in enumerate(types)] + [(20, 2, "d", datetime(2024, 1, 1)), (21, 2, "e", datetime(2024, 1, 2)), (30, 3, "e", datetime(2024, 1, 1)), (31, 3, "d", datetime(2024, 1, 2))]
    spark.createDataFrame(e, "event_id bigint, user_id bigint, event_type string, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    assert [r[1] for r in rows(activity_queries.QUERIES["event_cycles"](spark, str(tmp_path)), "component", "node")] == list("abcde")
    line = [(1, 10), (2, 10), (3, 10), (3, 11), (4, 11), (4, 12), (5, 12), (6, 13)]
    spark.createDataFrame(line, "l_suppkey bigint, l_partkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(2, 0), (9, 0), (5, 1), (6, 2)], "s_suppkey bigint, s_nationkey bigint").write.parquet(f"{tmp_path}/supplier.parquet")
    assert rows(activity_queries.QUERIES["supplier_reach"](spark, str(tmp_path)), "start", "level", "reached") == [("2", 1, 2), ("2", 2, 1), ("5", 1, 1), ("5", 2, 1)]
