"""Problem 4: notices, marks, paths, copies, minified code and data, and what only looks like them."""

import pytest

pytest.importorskip("ahocorasick")
from codestrata.llm import machine_written as mw  # noqa: E402

CODE = "import { a } from './a';\n\nexport function run(x) {\n  return a(x) + 1;\n}\n"
LIBRARY = "/* quick-sort 1.2.3 - BSD licensed */\n" + "\n".join(f"export function part{i}(left, right) {{ return left + right * {i}; }}" for i in range(40))


@pytest.mark.parametrize("text", ["// Code generated by protoc-gen. DO NOT EDIT.\n", "/* eslint-disable */\n// @generated by x from y\n", "# This file was automatically generated by tool; do not modify it by hand.\n", "'use strict';\n/*\n * AUTO-GENERATED FILE\n */\n", "// Diese Datei wurde automatisch erzeugt (x). Nicht bearbeiten.\n", "// Fichier produit par xgen, ne pas modifier\n", "﻿// Built by x-codegen at build 4. Manual changes get reverted.\n", "/* Output of `x y` - please edit a.yaml instead */\n"])
def test_notices(text):
    assert mw.reason("src/a.ts", text + CODE, False) == "notice"


@pytest.mark.parametrize("text", ["const b = `// Code generated by ${t}. DO NOT EDIT.`;\n", "// The ids are generated by the service, never by hand.\n", "// minified bundles are skipped; vendored files too\n", "/*\n * Part of the shop. Licensed under the terms in LICENSE.\n */\n", "let x = 1;\n// Code generated by hand. DO NOT EDIT.\n", "// edit this instead of that\n"])
def test_hand_written(text):
    assert mw.reason("src/vendors/generated-reports/a.ts", text + CODE, False) is None


@pytest.mark.parametrize("path, why", [("a/package-lock.json", "lockfile"), ("a/pnpm-lock.yaml", "lockfile"), ("a/node_modules/b/c.js", "vendored"), ("src/a.min.js", "named"), ("src/a_pb.ts", "named"), ("x/a.js.map", "named"), ("src/__generated__/a.ts", "output"), ("vendor/x/a.js", None), ("src/external/stripe.ts", None), ("src/deps/index.ts", None), ("src/gen/rand.ts", None), ("dist/a.js", None), ("build/tools/a.ts", None), ("src/distribution/a.ts", None), ("docs/vendors/a.md", None), ("src/lock.ts", None), ("dist/readme.md", None)])
def test_paths(path, why):
    assert mw.reason(path, CODE, False) == why


def test_names_count_where_texts_show_it(spark):
    rows = [(1, "vendor/a.js", "// @generated\n" + CODE), (2, "x/vendor/b.js", CODE), (3, "external/a.js", CODE), (4, "external/b.js", CODE), (5, "external/c.js", "// @generated\n" + CODE), (6, "vendor/readme.md", CODE), (7, "build/tools/a.js", CODE)]
    d = spark.createDataFrame(rows, "doc_id bigint, path string, text string")
    got = {r["doc_id"]: r["reason"] for r in mw.machine_written(d, spark.createDataFrame([], "lib_id bigint, text string")).collect()}
    assert got == {1: "notice", 2: "directory", 3: None, 4: None, 5: "notice", 6: None, 7: None}


def test_contents():
    assert mw.reason("a.js", '"use strict";\n\nObject.defineProperty(exports, "__esModule", { value: true });\n' + CODE, False) == "mark"
    assert mw.reason("a.js", "!function(e){" + "var a=b(c,1);try{d.e()}catch(f){g(f)}" * 20 + "}(h);", False) == "minified"
    assert mw.reason("a.ts", "export const d = [\n" + "  0x1f, 0x2e, 0x3d, 0x4c, 0x5b, 0x6a, 0x79, 0x88, 0x97, 0xa6,\n" * 20 + "];\n", False) == "data"
    assert mw.reason("a.ts", "export default [\n" + "\n".join(f'{{"id": {i}, "name": "n{i}", "lat": {i}.5}},' for i in range(40)) + "\n];\n", False) == "data"
    assert mw.reason("a.ts", CODE * 10 + "export const q = '" + "select a, b from c where d = e and " * 30 + "';\n", False) is None
    assert mw.reason("a.ts", CODE + "const rows = [\n" + "  { name: 'the first', note: 'a second', n: 3 },\n" * 30 + "];\n", False) is None
    assert mw.reason("a.ts", "", False) is None
    wrapped = "\n".join("var a=b(c,1);d.e(f,g);h=i?j:k;for(l in m)n(o);" for _ in range(12))
    assert mw.reason("a.js", wrapped, False) == "minified"
    assert mw.reason("a.js", CODE * 400 + "//# sourceMappingURL=a.js.map\n", False) == "mark" and mw.reason("a.js", "İ" * 9 + "\n/******/ x\n", False) == "mark"
    assert mw.reason("a.js", CODE + "const s = '//# sourceMappingURL=x';\n", False) is None


def test_copies():
    known = mw.Libraries([LIBRARY, None, ""])
    changed = LIBRARY.replace("quick-sort 1.2.3", "x").replace("part7(", "portion7(").replace("right * 9;", "right * 99;")
    half = "\n".join(LIBRARY.split("\n")[1:15]) + CODE * 30
    assert known.copies([LIBRARY, changed, changed.replace("\n", "\r\n"), CODE, half, None, "", CODE + LIBRARY]).tolist() == [True, True, True, False, False, False, False, True]


def test_operator_both_ways(spark, monkeypatch):
    rows = [(1, "src/a.js", LIBRARY, 0), (2, "src/b.js", CODE, 0), (3, None, None, 0), (4, "x/yarn.lock", None, 0), (5, None, "// @generated\n" + CODE, 0), (2, "src/b.js", CODE, 0), (6, "a.js", LIBRARY.replace("part3", "p3"), 0)]
    d = spark.createDataFrame(rows, "doc_id bigint, path string, text string, reason int")
    half = "\n".join(LIBRARY.split("\n")[1:15]) + CODE * 30
    rows += [(7, "a.js", half, 0), *[(8, "a.js", half, 0)] * 3, (9, "a.js", CODE + LIBRARY, 0), (10, "vendor/a.js", LIBRARY, 0), (11, "vendor/b.js", CODE, 0)]
    d = spark.createDataFrame(rows, "doc_id bigint, path string, text string, reason int")
    libs = spark.createDataFrame([(1, LIBRARY), (2, None), (3, LIBRARY), (4, "a b"), (5, CODE * 2)], "lib_id bigint, text string")
    got = {r["doc_id"]: r["reason"] for r in mw.machine_written(d, libs).collect()}
    assert got == {1: "copy", 2: None, 3: None, 4: "lockfile", 5: "notice", 6: "copy", 7: None, 8: None, 9: "copy", 10: "copy", 11: "directory"}
    monkeypatch.setattr(mw, "BROADCAST_BYTES", 10)
    assert {r["doc_id"]: r["reason"] for r in mw.machine_written(d, libs).collect()} == got
    assert mw.machine_written(d.limit(0), libs, only_found=True).count() == 0 and mw.machine_written(d, libs.limit(0), only_found=True).count() == 6  # the release header still tells


LONG = '"dependencies": {' + ", ".join(f'"p{i}": "1.{i}.0"' for i in range(400)) + "}"


@pytest.mark.parametrize(
    "path, text, why",
    [
        ("deps.json", "{" + LONG + ', "lockfileVersion": 3}', "lockfile"), ("deps.json", "{" + LONG + ', "x": {"lockfileVersion": 3}}', None), ("deps.json", '{"x": "lockfileVersion"}', None), ("pins.yaml", "# pins\nimporters:\n" + "  a: b\n" * 900 + "lockfileVersion: '6.0'\n", "lockfile"), ("notes.md", "The file begins so:\n\nlockfileVersion: 6\n", None),
        ("a.js", "/*!\n * kit v1.2.3\n" + " * more words\n" * 400 + " * Licensed under MIT license\n */\nlet a = 1;\n", "released"), ("a.js", "/*!\n * kit v1.2.3\n" + " * more words\n" * 400 + " */\nlet license = 1;\n", None),
    ],
)
def test_whole_texts_are_searched(path, text, why):
    assert mw.reason(path, text, False) == why
