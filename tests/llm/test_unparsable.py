"""Problem 2: constructs that are valid and ones that aren't, by language; the tests by rows of tokens on their own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from codestrata.llm.token_pairs import JSON, PYTHON, SCRIPT, YAML, permitted, within
from codestrata.llm.unparsable import DEPTH, GRAMMAR, OPENING, PAIR, ROLE, lexed, numbers, odd_nesting, odd_pairs, odd_windows, pair_table, rates, scope_table, token_rows, unparsable
from codestrata.llm.yaml_tokens import scan

VALID = {
    "a.ts": [
        "import a, { type B, c as d } from 'x';\nimport type { E } from \"y\";\nexport * as ns from './n';\nexport type { F } from './f';\nimport q = require('q');\nexport = q;",
        "export abstract class A<T extends object = {}> extends B<T> implements C, D {\n  private readonly x: Map<string, Array<number>> = new Map();\n  static { init(); }\n  #p = 1;\n  get v(): number { return this.#p; }\n  constructor(private a?: string, ...rest: unknown[]) { super(); }\n  abstract m(): void;\n  [k: string]: any;\n  async *gen<U>(this: A<T>, u: U): AsyncGenerator<U> { yield* u; }\n}",
        "type X<T> = T extends (infer U)[] ? U : { readonly [K in keyof T]-?: T[K] };\ntype L = `a-${string}`;\ninterface I { (x: number): string; new (x: number): I; readonly a?: (b: string) => void; method?(): void }\ndeclare module 'm' { export const z: number; }\nenum E { A = 1, B = A << 2, 'C' }\nnamespace N.M { export let v = 1 }",
        "const f = async <T,>(x: T, { a = 1, b: [c] }: P = {}): Promise<void> => { await g(x!); };\nlet y = x as unknown as string satisfies string;\nfunction isS(v: unknown): v is string { return typeof v === 'string'; }\nfunction over(a: string): void;\nfunction over(a: any) {}\nlabel: for (const k of ks) { if (k) continue label; else break; }",
        "const r = /[/\\]]+/g.test(s) ? a / b / c : `t ${`n ${1}`} e`;\na ??= b?.[0]?.(c) ?? d;\nx = y\n++z\nconst o = { async *m() {}, get g() { return 1 }, [k]: v, 'q': 1, new: 2, ...s };\n({ a = 1 } = o);\nif (a) ; else b\ndo x++; while (x < 5) y",
        "@Dec({ a: 1 }) export class Q { @In() p!: string; @Out() m(@Param('x') x: number) {} }",
        "export default async function () {}\nexport { a as default, b as 'str' };\nimport data from './d.json' with { type: 'json' };\nfor await (const x of y()) {}\nconst big = 1_000n + 0xFFn + .5e-3;",
        "﻿let async = 1, of = 2, type = 3; type = of; async\n(x)",
        "#!/usr/bin/env node\nlet a = b < c && d > e; f<g>(h); new M<string>;",
    ],
    "a.tsx": ["const a = <A<string> b=\"x\" {...p} c={<B/>}>t &amp; {/* c */} {x ? <></> : null}</A>;", "const g = <T,>(x: T) => <b>{x}</b>;\nreturnType();"],
    "a.js": ["const a = <div className='x'>y</div>;\nclass A { static #x = 1; x = () => 1; 'y'() {} }\nvar { a: { b = 1 } = {}, ...c } = d;", "export default { a, b() {}, async c() {} };\nlet x = a ? (b, c) : d => e;"],
    "a.mjs": ["await import('x'); import.meta.url; new.target ? 1 : 2;"],
    "a.json": ['{"a": [1, -2.5e3, "\\u00e9", null, true], "b": {}}', "﻿[]", '"x"'],
    "tsconfig.base.json": ['{ // c\n "a": [1, 2,], /* d */ "b": "//no",\n}'],
    "a.yml": ["a: 1\nb:\n  - c: d\n    e: |\n      text: here\n  - [f, {g: h}]\n---\n? k\n: v\n", "x: \"a: b\" # c\n", "a:\n- b\n- c: d\n  e: f\ng: h\n", "- - a\n  - b\n-\n  c: !!str d\n", "a: &x\n  b: *x\n? [c]\n: {d: e, 'f', \"g\": h}\n", "%YAML 1.1\n---\na: >-\n  folded\n\n  text: here\nb: plain\n  goes on\n...\n---\n- x\n", "{a: b, c}", "a: 'it''s\n  two lines'\n", "", "# only\n", "a: http://x.y#z\n"],
    "a.py": ["@d\n@e(1)\nclass A:\n    pass\nif x: pass\nelif y: pass\nelse:\n    pass\n\n# c\ntry:\n  x\nexcept (A, B) as e:\n  y\nfinally:\n  z\n", "type X[T] = list[T]\nx: int = 1; y += 2\nprint(*a, **b, sep='' 'x', c=[i async for i in y if i], d={**a, 'b': 1}, e=lambda a, *b: (yield))\nfrom . import (a, b as c,)\nif (n := len(a)) > 1 and a[1:, ::2] is not None: return\n", "match x:\n    case {'a': [1, *r]} if r: pass\nasync def f(a, /, b, *, c: int = 1) -> None:\n    async with x as y, z: yield\n", "﻿x = f'{a!r:>{w}}'\r\nif x:\r\n\ty = 1\r\n"],
    "a.md": ["anything ((("],
}
BROKEN = {
    "a.ts": [
        "function f() {", "const x = ;", "if (a { b(); }", "functoin f(x) { return x; }", "import { a from 'x';", "<<<<<<< HEAD\na();\n=======\nb();\n>>>>>>> x\n", "let s = 'open\n;", "foo(a,, b);", "class { }", "const a = 1 const b = 2", "return 1;", "x = { a: 1, b 2 };", "export const y = async (a) = > 1;",
        "const t = `a ${b`;", "import pathlib\nimport re\n\ndef f(a):\n    return a\n", '{"name": "x", "v": 1}', "# Title\n\ntext here\n", "const {{name}} = 1;", "type A = { b: string", "interface I { a: ; }", "for (let i = 0; i < 3) {}", "a = <div/>;", "try { a() }", "const c;", "x?.y = 1", "new", "1 = a", "class A { constructor( { } }", "let a = (1, 2", "switch (a) { case 1 b(); }", "a ?? b || c", "({a = 1})", "/* open", "async function f() {} await", "function g() { await x; }", "enum E { A B }", "\x00\x01",
    ],
    "a.tsx": ["const a = <A><B></A></B>;", "const a = <A b=>x</A>;", "const a = <A>}</A>;"],
    "a.js": ["function f(x: number) {}", "const a = b as c;", "interface I {}", "type A = string;", "class A { private x = 1 }", "let x: string = 1"],
    "a.json": ["{'a': 1}", '{"a": 1,}', "{a: 1}", '{"a": 1} x', '{"a" 1}', "[1 2]", "{", '{"a": NaN}', '{"a": 01}', '{"a": "\t"}', "// c\n{}", "<html></html>"],
    "tsconfig.json": ['{"a": 1,,}', '{"a": [,]}', "{", "{'a': 1}"],
    "a.yaml": ["a: b: c\n", "a:\n\tb: 1\n", "a: [1, 2\n", "a: \"open\nb: 1\n", "<<<<<<< HEAD\na: 1\n=======\n", "a: 1\n  b: 2\n", "a: [1, 2", "a: {b: 1", "a: b\n- c", "a: [b]]", "a: &x &y b", "key: value\nkey2", "a: {b: c: d}", "a: [b,,c]", "a: 'b", "a: *", "%x\na", "a: b: c", "{a: [}]", "- a\nb: c", "a: @b", "a: |x\n b\n", "a: !<b c"],
    "a.py": ["def f()\n    pass\n", "print 'x'\n", "if x:\npass\n", "x = (1,\n", "x = (1]\n", "def f(:\n  pass\n", "x = 1 2\n", "f(a for)\n", "x = f'{a'\n", "try:\n  x\ny = 1\n", "else:\n  x\n", "a = b = \n", "x = " + "-" * 3000 + "1 2\n", "  x = 1\ny = 2\n   z\n", "const a = 1;\n"],
}


DEEP = [("a.ts", "(", ")", "a", "a b"), ("a.js", "[", "]", "a", "a b"), ("a.ts", "{", "}", "a", "if (a"), ("a.json", "[", "]", "1", "1 2"), ("a.json", '{"a":', "}", "1", '{"b"}'), ("a.json", "[", "]", "{}", '{"b",1}'), ("a.yml", "[", "]", "a", "a,,b"), ("a.tsx", "<A>", "</A>", "{a}", "{a b}"), ("a.js", "`${", "}`", "a", "a b")]
TRUNCATED = VALID["a.ts"][1]


@pytest.fixture(scope="module")
def judged(spark):
    """what is wrong, by (path, text), of all cases of this module in one call."""
    cases = {(p, t) for table in (VALID, BROKEN) for p, ts in table.items() for t in ts}
    cases |= {(p, a * 3000 + t + b * 3000) for p, a, b, x, y in DEEP for t in (x, y)}
    cases |= {("a.ts", TRUNCATED[:i]) for i in range(1, len(TRUNCATED) + 1)}
    cases |= {("a.ts", t) for t in ("x = a >> b;\ny;", "x = a > > b;\ny;", "x = ((" + "(" * 3000 + "1" + ")" * 3000 + "));\nlet y = = 3;")}
    cases = sorted(cases)
    df = spark.createDataFrame([(n, "r", f"d/{p}", t) for n, (p, t) in enumerate(cases)], "doc_id int, repo string, path string, text string")
    return {cases[r["doc_id"]]: r["what"] for r in unparsable(df).collect()}


@pytest.mark.parametrize("path, text", [(p, t) for p, ts in VALID.items() for t in ts])
def test_valid(judged, path, text):
    assert judged[path, text] is None


@pytest.mark.parametrize("path, text", [(p, t) for p, ts in BROKEN.items() for t in ts])
def test_broken(judged, path, text):
    assert judged[path, text] is not None


def test_truncation_is_found(judged):
    assert sum(judged["a.ts", TRUNCATED[:i]] is None for i in range(1, len(TRUNCATED) + 1)) <= 6  # the first letters are a name, and the whole


@pytest.mark.parametrize("path, left, right, good, bad", DEEP)
def test_deep_nesting_is_followed(judged, path, left, right, good, bad):
    deep = lambda text: left * 3000 + text + right * 3000
    assert judged[path, deep(good)] is None and judged[path, deep(bad)] is not None


def test_an_error_after_deep_nesting_is_found(judged):
    assert all(w for (p, t), w in judged.items() if t.endswith("let y = = 3;"))


def test_equal_windows_keep_blanks(judged):
    assert judged["a.ts", "x = a >> b;\ny;"] is None and judged["a.ts", "x = a > > b;\ny;"] is not None


def test_pairs_of_grammars():
    pairs = permitted(JSON)
    assert ("name", "str") in pairs and ("str", "str") not in pairs and (",n", "}") not in pairs and ("start", "{") in pairs
    assert ("name", "name") in permitted(SCRIPT) and (",", ",") in permitted(SCRIPT) and ("=", ";") not in permitted(SCRIPT)
    assert ("scalar", "scalar") not in permitted(YAML) and ("m(", "key") in permitted(YAML) and ("nl", "in(") in permitted(PYTHON)
    inside = within(JSON, OPENING[2])
    assert ("{", "str", ",n") in inside and ("[", "str", ",n") not in inside and ("", "num", ",") not in inside


def test_nesting_of_rows(spark):
    texts = ["(x)[()]", "(]", "(()", ")", "x", "[(])", "()()", "", "x)(", "((x)"]
    of = {**numbers(1)[0], "x": numbers(1)[0]["num"]}
    rows = [(n, p, int(t)) for n, text in enumerate(texts) for p, t in enumerate(token_rows(1, np.array([of[c] for c in text] + [of["eof"]])))]
    tokens = spark.createDataFrame(rows, "row bigint, position int, t bigint").select("row", "position", F.shiftright("t", DEPTH).alias("depth"), F.shiftright("t", ROLE).bitwiseAND(3).alias("role"), F.col("t").bitwiseAND(PAIR).alias("pair"))
    assert {r["row"] for r in odd_nesting(tokens, scope_table(spark)).collect()} == {1, 2, 3, 5, 8, 9}


def test_tables_decide(spark):
    """A pair taken from the table makes documents with it broken; a window is reduced by itself."""
    df = spark.createDataFrame([(1, "r", "a.ts", "let a = 1;\nf(a);\n"), (2, "r", "b.ts", "let b = 2;\n"), (3, "r", "c.json", "[1]")], "doc_id int, repo string, path string, text string")
    of, by = numbers(1)
    without = pair_table(spark).filter(F.col("pair") != (1 << 16 | int(by[of["name"]]) << 8 | of["("]))
    assert unparsable(df).filter("broken").count() == 0
    assert [(r["doc_id"], r["what"]) for r in unparsable(df, pairs=without).filter("broken").collect()] == [(1, "pair")]
    windows = lexed(df).select(F.explode("windows").alias("window"))
    assert windows.count() == 3 and odd_windows(windows).count() == 0 and odd_windows(windows.limit(0)).count() == 0
    assert odd_pairs(spark.createDataFrame([(1, 0, 1 << 16)], "row bigint, position int, pair bigint"), pair_table(spark)).count() == 1


def test_yaml_brackets():
    kinds, _, bad = scan("a:\n- b\n- {c: d}\ne: |\n  f\n")
    assert bad < 0 and kinds == "m( key scalar val s( item scalar item { key scalar val scalar } s) key scalar val scalar m) eof".split()
    assert all(len(numbers(f)[0]) < 256 for f in GRAMMAR)


def test_operator_and_rates(spark):
    rows = [(1, "o/r", "a.ts", "let a = 1;", 0), (2, "o/r", "b.ts", "let a = ;", 0), (3, None, "c.py", "x = (", 0), (4, "o/r", None, "let", 0), (5, "o/r", "d.ts", None, 0), (6, "o/r", "e.ts", "", 0), (7, "o/r", "f.ts", " \n", 0), (8, "o/r", "g.md", "(", 0), (2, "o/r", "b.ts", "let a = ;", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, repo string, path string, text string, broken int")
    assert sorted(r["doc_id"] for r in unparsable(df, only_broken=True).collect()) == [2, 2, 3]
    assert unparsable(df).count() == len(rows) and unparsable(df.limit(0)).count() == 0
    files = spark.createDataFrame([("o/r", "b.ts", "ok", None, "typescript", None), ("o/r", "a.ts", "ok", "size", None, None)], "repo string, path string, parse_status string, skipped_reason string, language string, scanned_at timestamp")
    got = {(r["repo"], r["language"]): (r["files"], r["broken"], r["called_fine"], r["skipped"]) for r in rates(df.dropDuplicates(["doc_id"]), files).collect()}
    assert got["o/r", "typescript"] == (4, 1, 1, 1) and got[None, "python"][1] == 1
