"""DuckDB SQL with the same results as the queries of ``source_queries``."""

from __future__ import annotations

from ..functions.packages import BUILTINS, BUILTINS_ONLY_PREFIXED, FRAMEWORKS, INFRASTRUCTURE, SIGNAL_PACKAGES, TOOLING
from ..functions.secret_rules import RULES
from ..functions.words import SPACE, query_weights
from ..operators import files as file_ops
from ..operators import rules as role_rules
from ..operators.issues import BUILD_OUTPUT
from ..sources.quick_imports import COMMENT, ESCAPE, SCRIPTS, SPECIFIER, STATEMENT, SYNTAX


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lst(items) -> str:
    return "(" + ", ".join(map(q, items)) + ")"


def values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(q(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"


QUERY = "payment cache errors in queue workers"
#: DuckDB also takes trailing commas as valid JSON.
JSON_OK = "(json_valid(text) AND NOT regexp_matches(text, ',\\s*[}\\]]'))"
DIR = lambda p: f"regexp_extract({p}, '^(.*)/[^/]*$', 1)"
BASE = lambda p: f"regexp_extract({p}, '([^/]*)$', 1)"
EXT = lambda p: f"regexp_extract({BASE(p)}, '^.+([.][^.]*)$', 1)"
STEM = lambda p: f"CASE WHEN {EXT(p)} = '' THEN {BASE(p)} ELSE regexp_extract({BASE(p)}, '^(.+)[.][^.]*$', 1) END"
CASE = lambda n: f"""CASE WHEN regexp_matches({n}, '^[A-Z][A-Za-z0-9]*$') AND regexp_matches({n}, '[a-z]') THEN 'PascalCase' WHEN regexp_matches({n}, '^[a-z][A-Za-z0-9]*$') THEN 'camelCase'
  WHEN regexp_matches({n}, '^[a-z0-9]+(-[a-z0-9]+)+$') THEN 'kebab-case' WHEN regexp_matches({n}, '^[a-z0-9]+(_[a-z0-9]+)+$') THEN 'snake_case'
  WHEN regexp_matches({n}, '^[A-Z0-9]+(_[A-Z0-9]+)+$') THEN 'SCREAMING_SNAKE_CASE' ELSE 'other' END"""  # noqa: E731
SPLIT = lambda t: f"""list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_replace({t}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[_\\-.]+', ' ', 'g')), {q(SPACE)}), lambda w: w <> '')"""


def stem_sql(w: str) -> str:
    out = f"CASE WHEN length({w}) <= 3 THEN {w}"
    for rx, by in (("ies$", "y"), ("(ss|us|is)es$", "\\1"), ("([^s])s$", "\\1"), ("ing$", ""), ("edly$", ""), ("ed$", ""), ("ally$", "al")):
        cut = f"regexp_replace({w}, '{rx}', '{by}')"
        out += f" WHEN regexp_matches({w}, '{rx}') AND length({cut}) >= 3 THEN {cut}"
    return out + f" ELSE {w} END"


KIND = f"""CASE WHEN regexp_matches(path, {q(file_ops.TEST_PATH)}) THEN 'test' WHEN lower({EXT('path')}) IN {lst(file_ops.DOC_EXTENSIONS)} THEN 'docs'
  WHEN {BASE('path')} IN {lst(file_ops.CONFIG_NAMES)} OR lower({EXT('path')}) IN {lst(file_ops.CONFIG_EXTENSIONS)} OR regexp_matches({BASE('path')}, '[.]config[.][cm]?[jt]s$') OR path LIKE '.github/%' OR {BASE('path')} LIKE '._%' THEN 'config'
  WHEN lower({EXT('path')}) IN {lst(file_ops.ASSET_EXTENSIONS)} THEN 'asset' WHEN lower({EXT('path')}) IN {lst(file_ops.SOURCE_EXTENSIONS)} THEN 'source' ELSE 'other' END"""
LANGUAGE = f"CASE WHEN {BASE('path')} = 'package.json' THEN 'package-json' WHEN {BASE('path')} IN ('tsconfig.json', 'tsconfig.base.json', 'tsconfig.build.json', 'jsconfig.json') THEN 'tsconfig' " + " ".join(f"WHEN lower({EXT('path')}) IN {lst(e.split())} THEN {q(n)}" for n, e in file_ops.LANGUAGES.items()) + " ELSE 'unknown' END"

# imports, resolution, modules
IMPORTS = f"""
im AS (SELECT repo, path, n - 1 AS n, regexp_extract(s, {q(SPECIFIER)}, 1) AS specifier, CASE {' '.join(f"WHEN regexp_matches(s, {q(rx)}) THEN {q(name)}" for rx, name in SYNTAX)} ELSE 'static' END AS syntax FROM (
  SELECT repo, path, unnest(s) AS s, generate_subscripts(s, 1) AS n FROM (
    SELECT repo, path, list_filter(regexp_extract_all(regexp_replace(regexp_replace(text, {q(ESCAPE)}, '', 'g'), {q(COMMENT)}, {q(chr(92) + '1')}, 'g'), {q(STATEMENT)}, 1), lambda x: x <> '') AS s FROM documents WHERE regexp_matches(path, {q(SCRIPTS)}))))"""
_EXTENSIONS = ".ts .tsx .mts .cts .d.ts .js .jsx .mjs .cjs .json".split()
_REWRITES = {".js": ".ts .tsx .d.ts .js", ".jsx": ".tsx .jsx", ".mjs": ".mts .mjs", ".cjs": ".cts .cjs"}
_CANDIDATES = (
    f"CASE WHEN {EXT('base')} = '' THEN [base] || list_transform([{', '.join(q(x + e) for x in ('', '/index') for e in _EXTENSIONS)}], lambda e: base || e) "
    + " ".join(f"WHEN {EXT('base')} = '{w}' THEN [base] || list_transform([{', '.join(map(q, m.split()))}], lambda e: regexp_replace(base, '[.][^./]*$', '') || e)" for w, m in _REWRITES.items())
    + " ELSE [base] END"
)
PACKAGE = "CASE WHEN specifier = '' OR specifier LIKE '.%' OR specifier LIKE '/%' THEN NULL WHEN specifier LIKE '@%' THEN CASE WHEN specifier LIKE '%/%' THEN regexp_extract(specifier, '^(@[^/]*/[^/]*)', 1) END ELSE regexp_extract(specifier, '^([^/]*)', 1) END"
BUILTIN = f"specifier IN {lst([*BUILTINS, *('node:' + b for b in BUILTINS), *BUILTINS_ONLY_PREFIXED])}"
RESOLVED = f"""{IMPORTS},
one AS (SELECT DISTINCT repo, path, specifier FROM im),
hidden AS (SELECT DISTINCT repo, path FROM files WHERE sensitive),
known AS (SELECT repo, path, NULL::VARCHAR AS why FROM documents d WHERE NOT EXISTS (FROM hidden h WHERE h.repo = d.repo AND h.path = d.path) UNION ALL SELECT repo, path, 'sensitive' FROM hidden),
rel AS (
  SELECT repo, path, specifier, up > len(parts) OR specifier LIKE '/%' AS escapes, array_to_string(list_filter(parts[1:len(parts) - up] || string_split(rest, '/'), lambda x: x NOT IN ('', '.')), '/') AS base
  FROM (SELECT *, length(regexp_extract(specifier, '^(?:[.]/)?((?:[.][.]/)*)', 1)) // 3 AS up, regexp_replace(specifier, '^(?:[.]/)?(?:[.][.]/)*', '') AS rest, list_filter(string_split({DIR('path')}, '/'), lambda x: x <> '') AS parts
        FROM one WHERE specifier LIKE '.%' OR specifier LIKE '/%')),
via AS (
  SELECT repo, path, specifier, 0 AS ord, base FROM rel WHERE NOT escapes
  UNION ALL SELECT repo, path, specifier, 0, 'src/' || substr(specifier, 6) FROM one WHERE specifier LIKE '@app/%'
  UNION ALL SELECT repo, path, specifier, 1, 'lib/' || substr(specifier, 6) FROM one WHERE specifier LIKE '@app/%'
  UNION ALL SELECT repo, path, specifier, 0, 'src/' || substr(specifier, 3) FROM one WHERE specifier LIKE '~/%'),
cand AS (SELECT repo, path, specifier, ord, unnest(c) AS candidate, generate_subscripts(c, 1) AS place FROM (SELECT *, {_CANDIDATES} AS c FROM via)),
hit AS (
  SELECT c.repo, c.path, c.specifier, arg_min(struct_pack(p := c.candidate, w := k.why), (c.ord, k.why IS NOT NULL, c.place)) AS h
  FROM cand c JOIN known k ON k.repo = c.repo AND k.path = c.candidate GROUP BY ALL),
resolved AS (
  SELECT o.repo, o.path, o.specifier, {PACKAGE.replace('specifier', 'o.specifier')} AS package, h.h.p AS hp, h.h.w AS hw, h.h IS NOT NULL AS met, coalesce(r.escapes, false) AS escapes, o.specifier LIKE '.%' OR o.specifier LIKE '/%' AS relative,
    o.specifier LIKE '@app/%' OR o.specifier LIKE '~/%' AS aliased, {BUILTIN.replace('specifier', 'o.specifier')} AS builtin
  FROM one o LEFT JOIN hit h USING (repo, path, specifier) LEFT JOIN rel r USING (repo, path, specifier)),
res AS (
  SELECT repo, path, specifier, kind, CASE kind WHEN 'internal-file' THEN hp WHEN 'external-package' THEN package ELSE specifier END AS target,
    CASE WHEN kind <> 'unresolved' THEN NULL WHEN escapes THEN 'path-escape' WHEN met THEN 'excluded-file' WHEN aliased THEN 'unresolved-alias' ELSE 'missing' END AS reason,
    CASE kind WHEN 'internal-file' THEN CASE WHEN relative THEN 0.99::DOUBLE ELSE 0.95 END WHEN 'node-builtin' THEN 0.99 WHEN 'external-package' THEN 0.96 ELSE 0.3 END AS confidence
  FROM (SELECT *, CASE WHEN met AND hw IS NULL THEN 'internal-file' WHEN relative OR met OR package IS NULL THEN 'unresolved' WHEN builtin THEN 'node-builtin' ELSE 'external-package' END AS kind FROM resolved))"""
MODULES = f"""
src AS (SELECT repo, path, {DIR('path')} AS dir FROM documents WHERE regexp_matches(path, {q(SCRIPTS)})),
dirs AS (SELECT repo, dir, count(*) AS n, bool_or(regexp_matches({BASE('path')}, '^(index|mod)[.][cm]?[jt]sx?$')) AS entry FROM src GROUP BY ALL),
mdir AS (SELECT repo, dir, CASE WHEN entry AND dir <> '' THEN 'index-file' ELSE 'directory' END AS basis FROM dirs WHERE (entry AND dir <> '') OR (n >= 2 AND dir <> '' AND len(string_split(dir, '/')) <= 2)),
mods AS (
  SELECT s.repo, s.path, coalesce(m.dir, s.path) AS module, coalesce(m.basis, 'single-file') AS basis, coalesce(m.dir, s.dir) AS directory
  FROM src s LEFT JOIN mdir m ON m.repo = s.repo AND starts_with(s.path, m.dir || '/')
  QUALIFY row_number() OVER (PARTITION BY s.repo, s.path ORDER BY length(m.dir) DESC NULLS LAST) = 1)"""
EDGES = f"""{RESOLVED}, {MODULES},
fe AS (SELECT repo, path AS source, target, CASE WHEN kind = 'internal-file' THEN 'file' ELSE 'package' END AS target_kind, kind, specifier, CASE WHEN syntax = 'reexport' THEN 'exports' ELSE 'imports' END AS relationship
  FROM res JOIN (SELECT DISTINCT repo, path, specifier, syntax FROM im) USING (repo, path, specifier) WHERE kind <> 'unresolved'),
lifted AS (SELECT e.repo, a.module AS source, b.module AS target, e.source AS f, e.specifier, e.relationship FROM fe e JOIN mods a ON a.repo = e.repo AND a.path = e.source JOIN mods b ON b.repo = e.repo AND b.path = e.target WHERE e.target_kind = 'file' AND a.module <> b.module),
me AS (SELECT repo, source, target, count(DISTINCT f) AS files, least(4, count(*)) AS shown, array_to_string(list_sort(list(DISTINCT relationship)), ',') AS relationships FROM lifted GROUP BY ALL)"""
SIGNALS = "node_signal AS (SELECT 1), pk_signal AS (SELECT * FROM " + values([(s, n) for s, names in SIGNAL_PACKAGES.items() for n in names]) + " AS t(signal, name))"
SIG_JOIN = "(p.name = package OR (p.name LIKE '%/*' AND starts_with(package, left(p.name, -1))))"
NAME_TABLE = values([(r, role_rules.name_pattern(w), x) for r, w, x in role_rules.NAME_RULES])
SIGNAL_TABLE = values([(s, r, w) for s, r, w, _ in role_rules.SIGNAL_RULES])
ROLES = f"""{SIGNALS},
mm AS (SELECT DISTINCT repo, module, directory FROM mods),
weights AS (
  SELECT repo, module, role, w FROM mm, {NAME_TABLE} AS n(role, rx, w) WHERE regexp_matches(module || '/' || directory, rx)
  UNION ALL SELECT s.repo, s.module, r.role, r.w FROM (
    SELECT DISTINCT i.repo, m.module, p.signal FROM (SELECT *, {PACKAGE} AS package FROM im) i JOIN mods m ON m.repo = i.repo AND m.path = i.path JOIN pk_signal p ON i.specifier NOT LIKE 'node:%' AND {SIG_JOIN}
    UNION SELECT DISTINCT i.repo, m.module, 'worker:usage' FROM im i JOIN mods m ON m.repo = i.repo AND m.path = i.path WHERE i.specifier = 'node:worker_threads') s
  JOIN {SIGNAL_TABLE} AS r(signal, role, w) ON r.signal = s.signal),
roles AS (
  SELECT repo, module, row_number() OVER (PARTITION BY repo, module ORDER BY confidence DESC, role) AS rank, role, confidence FROM (
    SELECT repo, module, role, round(least(0.99, 1 - product(1 - least(0.75, w::DOUBLE))), 2) AS confidence FROM weights GROUP BY ALL) WHERE confidence >= 0.3
  QUALIFY rank <= 4)"""


def term_rows(field: str, weight: int, first: str) -> str:
    return f"""SELECT id, unnest(list_distinct(list_concat(w, list_transform(w, lambda x: {stem_sql('x')})))) AS term, {weight} AS w, {first} AS t
      FROM (SELECT id, list_filter({SPLIT(field)}, lambda x: length(x) >= 2 AND NOT regexp_matches(x, '^[0-9]+$')) AS w FROM sd WHERE {field} IS NOT NULL)"""


POSTINGS = f"""
sd AS (SELECT CAST(doc_id AS VARCHAR) AS id, path AS title, text AS body, lang AS k1, source AS k2 FROM documents),
po AS (SELECT id, term, sum(w)::BIGINT AS tf, bool_or(t) AS in_title FROM (
  {term_rows('title', 3, 'true')} UNION ALL {term_rows('k1', 2, 'false')} UNION ALL {term_rows('k2', 2, 'false')} UNION ALL {term_rows('body', 1, 'false')}) GROUP BY ALL)"""
_WEIGHTS = values([(t, float(w)) for t, w in query_weights(QUERY).items()])
PATH_WORDS = lambda p: f"list_filter(flatten(list_transform(string_split({p}, '/'), lambda s: {SPLIT('s')})), lambda w: length(w) > 1)"


def glob_sql(patterns: list[str], path: str) -> str:
    """Last match wins, over the path and its directories."""
    from ..functions.globs import rules

    out = "false"
    for r in rules(patterns):
        fits = f"regexp_matches({path}, {q(r.regex)})"
        if r.directory:
            fits += f" OR len(list_filter(above, lambda a: regexp_matches(a, {q(r.regex)}))) > 0"
        out = f"CASE WHEN {fits} THEN {str(not r.negated).lower()} ELSE {out} END"
    return out


ABOVE = "list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))"
ANY = lambda patterns: " OR ".join(f"regexp_matches(path, {q(r.regex)})" for r in __import__('codestrata.functions.globs', fromlist=['rules']).rules(patterns) if not r.negated)
_REDACT = "line"
for _, _rx, _by in RULES:
    _REDACT = f"regexp_replace({_REDACT}, {q(_rx)}, {q(_by.replace('$1', chr(92) + '1'))}, 'g')"

SQL = {
    "path_parts": f"""SELECT doc_id, {DIR('path')} AS dir, {BASE('path')} AS name, {EXT('path')} AS ext, {STEM('path')} AS stem, len(string_split(path, '/')) AS depth, array_to_string({ABOVE}, '|') AS above,
  path = 'src' OR path LIKE 'src/%' AS in_src, CASE WHEN path LIKE 'packages/%' THEN substr(path, 10) WHEN path LIKE 'src/%' THEN substr(path, 5) ELSE path END AS module_id FROM documents""",
    "identifier_case_tally": f"""SELECT repo, "case", count(*) AS n FROM (SELECT repo, {CASE('s')} AS "case" FROM (SELECT repo, {STEM('path')} AS s FROM documents WHERE regexp_matches(path, {q(SCRIPTS)}) AND NOT starts_with({BASE('path')}, 'index.'))) GROUP BY ALL""",
    "dominant_case": f"""WITH c AS (SELECT repo, "case", count(*) AS n FROM (SELECT repo, {CASE('s')} AS "case" FROM (SELECT repo, {STEM('path')} AS s FROM documents WHERE regexp_matches(path, {q(SCRIPTS)}))) WHERE "case" <> 'other' GROUP BY ALL)
SELECT repo, "case", n AS count, sum(n) OVER (PARTITION BY repo)::BIGINT AS total FROM c QUALIFY row_number() OVER (PARTITION BY repo ORDER BY n DESC, "case") = 1 AND total >= 6 AND n >= 0.4 * total""",
    "stem_terms": f"SELECT word, n, {stem_sql('word')} AS stem FROM (SELECT word, count(*) AS n FROM (SELECT unnest({SPLIT('text')}) AS word FROM documents) WHERE regexp_matches(word, '^[a-z]{{2,}}$') GROUP BY word)",
    "path_words": f"SELECT doc_id, array_to_string({PATH_WORDS('path')}, ' ') AS words FROM documents",
    "classified_files": f"SELECT repo, {KIND} AS kind, {LANGUAGE} AS language, count(*) AS files, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents GROUP BY ALL",
    "sensitive_files": f"SELECT repo, path FROM (SELECT DISTINCT repo, path, {ABOVE} AS above FROM files) WHERE {glob_sql([*file_ops.SENSITIVE, 'deploy/**', '!deploy/**/*.md'], 'path')}",
    "scan_scope": f"SELECT repo, included, excluded, count(*) AS files FROM (SELECT repo, {ANY(file_ops.INCLUDE)} AS included, {glob_sql([*file_ops.EXCLUDE, '!vendor/**/*.ts'], 'path')} AS excluded FROM (SELECT DISTINCT repo, path, {ABOVE} AS above FROM files)) GROUP BY ALL",
    "secret_rules": f"""SELECT doc_id, n AS line_no, array_to_string(list_filter([{', '.join(f"CASE WHEN regexp_matches(line, {q(rx)}) THEN {q(name)} END" for name, rx, _ in RULES)}], lambda x: x IS NOT NULL), ',') AS rules, {_REDACT} AS redacted
FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE {' OR '.join(f'regexp_matches(line, {q(rx)})' for _, rx, _ in RULES)}""",
    "languages_counted": f"SELECT {LANGUAGE} AS language, count(*) AS count FROM documents GROUP BY 1",
    "content_duplicates": "SELECT sha256(text) AS hash, count(*) AS copies, arg_min(repo, (repo, path)) AS first_repo, arg_min(path, (repo, path)) AS first_path FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "markdown_headings": r"""WITH l AS (SELECT repo, path, unnest(x) AS line, generate_subscripts(x, 1) AS n FROM (SELECT repo, path, string_split(replace(ltrim(text, chr(65279)), chr(13) || chr(10), chr(10)), chr(10)) AS x FROM documents WHERE path LIKE '%.md' AND text IS NOT NULL)),
f AS (SELECT *, regexp_matches(line, '^\s*(```|~~~)') AS fence FROM l), o AS (SELECT *, sum(fence::INT) OVER (PARTITION BY repo, path ORDER BY n) % 2 AS open FROM f)
SELECT repo, path, n AS line_no, length(regexp_extract(line, '^(#+)', 1)) AS level, trim(regexp_replace(regexp_extract(line, '^#+\s+(.*)$', 1), '[#\s]+$', '')) AS title FROM o WHERE NOT fence AND open = 0 AND regexp_matches(line, '^#{1,6}\s+')""",
    "markdown_links": r"SELECT repo, path, target, count(*) AS n FROM (SELECT repo, path, unnest(regexp_extract_all(text, '\[[^\[\]\n]*\]\(([^)\s]+)\)', 1)) AS target FROM documents WHERE path LIKE '%.md') GROUP BY ALL",
    "json_keys": f"SELECT repo, path, array_to_string(list_sort(list_distinct(json_keys(text))), ',') AS keys FROM (SELECT repo, path, ltrim(text, chr(65279)) AS text FROM documents) WHERE {LANGUAGE} = 'json' AND ltrim(text) LIKE '{{%' AND {JSON_OK}",
    "manifests": f"SELECT repo, {DIR('path')} AS directory, text ->> '$.name' AS name, text ->> '$.version' AS version, CASE WHEN text ->> '$.type' IN ('module', 'commonjs') THEN text ->> '$.type' END AS type, coalesce(text ->> '$.private', '') = 'true' AS private FROM documents WHERE regexp_matches(path, '(^|/)package[.]json$') AND {JSON_OK}",
    "static_imports": f'WITH {IMPORTS} SELECT repo, path, n AS "at", specifier, syntax FROM im',
    "resolved_imports": f"WITH {RESOLVED} SELECT repo, path, specifier, kind, target, reason, confidence FROM res",
    "import_gaps": f"""WITH {RESOLVED},
u AS (SELECT DISTINCT repo, CASE WHEN reason = 'path-escape' THEN reason WHEN regexp_matches(specifier, {q(BUILD_OUTPUT)}) THEN 'excluded-build-output' ELSE reason END AS cause, path || ' -> ' || specifier AS subject
  FROM (SELECT *, regexp_extract(regexp_extract(specifier, '([^/]*)$', 1), '([.][^.]*)$', 1) AS ext FROM res) WHERE kind = 'unresolved' AND (reason = 'path-escape' OR ext IN ('', '.ts', '.tsx', '.mts', '.cts', '.js', '.jsx', '.mjs', '.cjs', '.json', '.node')))
SELECT repo, cause, count(*) AS count, CASE WHEN count(*) = 1 THEN min(subject) END AS subject, array_to_string(list_sort(list(subject))[1:5], '|') AS samples FROM u GROUP BY ALL""",
    "package_signals": f"""WITH {IMPORTS}, {SIGNALS}, s AS (SELECT DISTINCT specifier, {PACKAGE} AS package, {BUILTIN} AS builtin FROM im),
g AS (SELECT specifier, package, builtin, array_to_string(list_filter([{', '.join("CASE WHEN " + " OR ".join(f"package = {q(n)}" if not n.endswith('/*') else f"starts_with(package, {q(n[:-1])})" for n in names) + f" THEN {q(s)} END" for s, names in SIGNAL_PACKAGES.items())}], lambda x: x IS NOT NULL), ',') AS signals FROM s)
SELECT specifier, package, builtin, CASE WHEN specifier = 'node:worker_threads' THEN 'worker:usage' WHEN specifier LIKE 'node:%' THEN '' ELSE signals END AS signals,
  CASE WHEN package IS NULL THEN NULL WHEN builtin OR package IN {lst(INFRASTRUCTURE)} THEN 'infrastructure' WHEN package IN {lst(FRAMEWORKS)} THEN 'framework' WHEN package IN {lst(TOOLING)} THEN 'tooling' ELSE 'utility' END AS importance FROM g""",
    "module_files": f"WITH {MODULES} SELECT repo, path, module, basis, directory FROM mods",
    "module_edges": f"WITH {EDGES} SELECT repo, source, target, files, relationships, shown FROM me",
    "module_neighbours": f"WITH {EDGES} SELECT repo, source AS module, 'depends_on' AS side, target AS other FROM me UNION ALL SELECT repo, target, 'used_by', source FROM me",
    "neighbour_lists": f"""WITH {EDGES}, b AS (SELECT repo, source AS module, target AS t, NULL AS s FROM me UNION ALL SELECT repo, target, NULL, source FROM me)
SELECT repo, module, coalesce(array_to_string(list_sort(list(DISTINCT t) FILTER (t IS NOT NULL))[1:5], '|'), '') AS depends_on, count(DISTINCT t) AS depends_on_n, coalesce(array_to_string(list_sort(list(DISTINCT s) FILTER (s IS NOT NULL))[1:5], '|'), '') AS used_by, count(DISTINCT s) AS used_by_n FROM b GROUP BY ALL""",
    "incoming_imports": f"WITH {EDGES} SELECT repo, target AS path, count(*) AS imported FROM fe WHERE target_kind = 'file' GROUP BY ALL",
    "external_packages": f"""WITH {EDGES}
SELECT repo, name, 'runtime' AS scope, files, modules, CASE WHEN builtin OR name IN {lst(INFRASTRUCTURE)} THEN 'infrastructure' WHEN name IN {lst(FRAMEWORKS)} THEN 'framework' WHEN name IN {lst(TOOLING)} THEN 'tooling' ELSE 'utility' END AS importance,
  CASE WHEN builtin THEN 0.99::DOUBLE WHEN name IN {lst([*INFRASTRUCTURE, *FRAMEWORKS, *TOOLING])} THEN 0.6 ELSE 0.3 END AS confidence
FROM (SELECT e.repo, e.target AS name, bool_or(e.kind = 'node-builtin') AS builtin, count(DISTINCT e.source) AS files, count(DISTINCT m.module) AS modules FROM fe e LEFT JOIN mods m ON m.repo = e.repo AND m.path = e.source WHERE target_kind = 'package' GROUP BY ALL)""",
    "directory_cycles": f"""WITH RECURSIVE {RESOLVED},
g AS (SELECT DISTINCT repo, {DIR('path')} AS a, {DIR('target')} AS b FROM res WHERE kind = 'internal-file'), e AS (SELECT * FROM g WHERE a <> b),
r AS (SELECT repo, a, b FROM e UNION SELECT r.repo, r.a, e.b FROM r JOIN e ON e.repo = r.repo AND e.a = r.b),
m AS (SELECT x.repo, x.a, x.b FROM r x JOIN r y ON y.repo = x.repo AND y.a = x.b AND y.b = x.a WHERE x.a <> x.b)
SELECT repo, least(a, min(b)) AS component, a AS node FROM m GROUP BY repo, a""",
    "dependents_within_3": f"""WITH RECURSIVE {RESOLVED}, e AS (SELECT DISTINCT repo, path AS a, target AS b FROM res WHERE kind = 'internal-file'),
r AS (SELECT DISTINCT repo, b AS start, b AS node, 0 AS level FROM e UNION SELECT r.repo, r.start, e.a, r.level + 1 FROM r JOIN e ON e.repo = r.repo AND e.b = r.node WHERE r.level < 3)
SELECT repo, start, node, min(level)::BIGINT AS level FROM r WHERE node <> start GROUP BY ALL""",
    "affected_modules": f"""WITH {EDGES}, own AS (SELECT DISTINCT m.repo, m.module FROM mods m JOIN documents d ON d.repo = m.repo AND d.path = m.path WHERE d.fetched_at >= TIMESTAMP '2024-06-01 00:00:00')
SELECT repo, module, bool_or(direct) AS direct FROM (SELECT repo, module, true AS direct FROM own UNION ALL SELECT me.repo, me.source, false FROM me JOIN own ON own.repo = me.repo AND own.module = me.target) GROUP BY ALL""",
    "edges_between": f"WITH {EDGES} SELECT repo, source, target, files, relationships FROM me",
    "longest_prefix": f"""WITH d AS (SELECT repo, {DIR('path')} AS dir FROM documents GROUP BY ALL HAVING count(*) >= 2)
SELECT x.repo, x.path, max_by(d.dir, length(d.dir)) AS owner FROM documents x LEFT JOIN d ON d.repo = x.repo AND (d.dir = '' OR starts_with(x.path, d.dir || '/')) GROUP BY ALL""",
    "noisy_or_roles": f"WITH {IMPORTS}, {MODULES}, {ROLES} SELECT repo, module, rank, role, confidence FROM roles",
    "layering_violations": f"WITH {EDGES}, {ROLES} SELECT e.repo, e.source, e.target, l.kind FROM me e JOIN roles a ON a.repo = e.repo AND a.module = e.source JOIN roles b ON b.repo = e.repo AND b.module = e.target JOIN {values(role_rules.LAYERING)} AS l(a, b, kind) ON l.a = a.role AND l.b = b.role",
    "precision_recall": f"""WITH f AS (SELECT doc_id FROM (SELECT doc_id, arg_max(parse_status, (scanned_at, parse_status)) AS s FROM files WHERE path LIKE '%.json' AND doc_id IS NOT NULL GROUP BY 1) WHERE s IN ('failed', 'partial')),
t AS (SELECT doc_id FROM documents WHERE path LIKE '%.json' AND text IS NOT NULL AND NOT {JSON_OK}),
c AS (SELECT count(*) FILTER (f.doc_id IS NOT NULL AND t.doc_id IS NOT NULL) AS tp, count(*) FILTER (t.doc_id IS NULL) AS fp, count(*) FILTER (f.doc_id IS NULL) AS fn FROM f FULL JOIN t ON f.doc_id = t.doc_id)
SELECT tp AS true_positives, fp AS false_positives, fn AS false_negatives, round(tp / nullif(tp + fp, 0), 4) AS precision, round(tp / nullif(tp + fn, 0), 4) AS recall FROM c""",
    "evidence_coverage": "SELECT count(*) AS judgements, count(*) FILTER (len(attempts) > 0) AS with_evidence, round(count(*) FILTER (len(attempts) > 0) / nullif(count(*), 0), 4) AS share FROM unresolved_imports",
    "first_wins": "SELECT repo, path, said FROM (SELECT repo, path, lang AS said, 0 AS p FROM documents WHERE lang IS NOT NULL UNION ALL SELECT repo, path, language, 1 FROM files WHERE language IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY p, said) = 1",
    "set_difference": "SELECT DISTINCT repo, path FROM files f WHERE NOT EXISTS (FROM documents d WHERE d.repo = f.repo AND d.path = f.path)",
    "import_statistics": f"""WITH {IMPORTS}, c AS (SELECT *, specifier LIKE '.%' AS rel, specifier LIKE '@app/%' OR specifier LIKE '~/%' AS ali FROM im),
f AS (SELECT repo, path, count(*) FILTER (rel) AS relative, count(*) FILTER (ali) AS alias, count(*) FILTER (NOT rel AND NOT ali AND specifier NOT LIKE 'node:%') AS external, count(*) FILTER (rel AND regexp_matches(specifier, '[.](js|mjs|cjs)$')) AS explicit, count(*) FILTER (syntax = 'require') AS requires, bool_or(syntax = 'type-only') AS typed, min(n) FILTER (rel OR ali) AS fi, max(n) FILTER (NOT rel AND NOT ali) AS le FROM c GROUP BY ALL)
SELECT repo, count(*) AS files, sum(relative)::BIGINT AS relative, sum(alias)::BIGINT AS alias, sum(external)::BIGINT AS external, sum(explicit)::BIGINT AS explicit, sum(requires)::BIGINT AS requires, count(*) FILTER (typed) AS typed_files, count(*) FILTER (fi IS NOT NULL AND le IS NOT NULL) AS mixed_files, count(*) FILTER (le < fi) AS external_first FROM f GROUP BY repo""",
    "package_managers": f"""WITH l AS (SELECT repo, list_sort(list(DISTINCT path) FILTER (path <> 'pnpm-workspace.yaml')) AS files, list(DISTINCT m) AS ms FROM documents JOIN (VALUES ('package-lock.json', 'npm'), ('npm-shrinkwrap.json', 'npm'), ('pnpm-lock.yaml', 'pnpm'), ('yarn.lock', 'yarn'), ('bun.lock', 'bun'), ('bun.lockb', 'bun'), ('pnpm-workspace.yaml', 'pnpm')) AS k(p, m) ON p = path GROUP BY repo),
r AS (SELECT repo, split_part(text ->> '$.packageManager', '@', 1) AS declared FROM documents WHERE path = 'package.json' AND {JSON_OK})
SELECT d.repo, CASE WHEN declared IN ('npm', 'pnpm', 'yarn', 'bun') THEN declared WHEN len(ms) = 1 THEN ms[1] ELSE 'unknown' END AS manager, coalesce(array_to_string(files, ','), '') AS lockfiles FROM (SELECT DISTINCT repo FROM documents) d LEFT JOIN l USING (repo) LEFT JOIN r USING (repo)""",
    "parse_reuse": f"""WITH d AS (SELECT repo, sha256(text) AS h, {LANGUAGE} AS l, coalesce(fetched_at < TIMESTAMP '2024-06-01 00:00:00', false) AS old FROM documents WHERE text IS NOT NULL), k AS (SELECT DISTINCT h, l FROM d WHERE old)
SELECT repo, count(*) FILTER (k.h IS NULL) AS fresh, count(*) FILTER (k.h IS NOT NULL) AS known FROM d LEFT JOIN k ON k.h = d.h AND k.l = d.l WHERE NOT old GROUP BY repo""",
    "unread_targets": f"SELECT repo, {KIND} AS kind, count(*) AS files FROM (SELECT DISTINCT repo, path FROM files f WHERE NOT EXISTS (FROM documents d WHERE d.repo = f.repo AND d.path = f.path)) GROUP BY ALL",
    "bm25_search": f"""WITH {POSTINGS}, t AS (SELECT term, weight::DOUBLE AS weight FROM {_WEIGHTS} AS v(term, weight)),
n AS (SELECT (SELECT count(*) FROM sd)::DOUBLE AS n, (SELECT sum(tf) FROM po)::DOUBLE AS total), l AS (SELECT id, sum(tf)::DOUBLE AS len FROM po GROUP BY id),
df AS (SELECT term, count(*)::DOUBLE AS df FROM po GROUP BY term),
s AS (SELECT po.id, po.term, ln(1 + (n.n - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE)) * po.tf * 2.2::DOUBLE / (po.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.len / greatest(1, n.total / n.n))) * t.weight AS s, po.in_title FROM po JOIN t USING (term) JOIN df USING (term) JOIN l USING (id), n),
pw AS (SELECT id, {PATH_WORDS('title')} AS place FROM sd),
iw AS (SELECT id, unnest(list_distinct(list_concat(place, list_transform(place, lambda x: {stem_sql('x')})))) AS word FROM pw),
i AS (SELECT DISTINCT iw.id, t.term, t.weight * CASE WHEN df.df IS NULL THEN 0.6::DOUBLE ELSE 0.3 END AS s FROM iw JOIN t ON iw.word = t.term OR iw.word = {stem_sql('t.term')} LEFT JOIN df ON df.term = t.term WHERE NOT EXISTS (FROM po WHERE po.id = iw.id AND po.term = t.term)),
a AS (SELECT id, sum(s) AS s, sum(b) AS boosts, list_sort(list(term)) AS matched FROM (SELECT id, term, s, in_title::INT AS b FROM s UNION ALL SELECT id, term, s, 0 FROM i) GROUP BY id)
SELECT id, round(a.s * pow(1.35::DOUBLE, boosts) + len(list_filter(matched, lambda m: list_contains(pw.place, m))) * 0.9::DOUBLE, 4) AS score, array_to_string(matched, ',') AS matched FROM a JOIN pw USING (id) ORDER BY score DESC, id LIMIT 20""",
    "term_frequencies": f"WITH {POSTINGS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM po WHERE regexp_matches(term, '^[a-z]{{2,}}$') GROUP BY term",
    "listing_changes": """WITH r AS (SELECT DISTINCT root_id, run_id, run_no FROM scan_runs WHERE status = 'succeeded'),
e AS (SELECT CAST(root_id AS VARCHAR) AS repo, arg_min(run_id, run_no) AS a, arg_max(run_id, run_no) AS b FROM r GROUP BY 1 HAVING a <> b),
s AS (SELECT CAST(root_id AS VARCHAR) AS repo, run_id, regexp_replace(replace(path, chr(92), '/'), '^([.]/+)+', '') AS path, regexp_replace(lower(hash), '^sha256:', '') AS hash, size, mtime_ms, arrived_at FROM scan_state
  QUALIFY row_number() OVER (PARTITION BY run_id, path ORDER BY arrived_at DESC, hash DESC NULLS LAST, size DESC NULLS LAST, mtime_ms DESC NULLS LAST) = 1),
p AS (SELECT s.* FROM s JOIN e ON e.repo = s.repo AND e.a = s.run_id), c AS (SELECT s.* FROM s JOIN e ON e.repo = s.repo AND e.b = s.run_id)
SELECT coalesce(p.repo, c.repo) AS repo, coalesce(p.path, c.path) AS path, CASE WHEN c.run_id IS NULL THEN 'deleted' WHEN c.hash = '' THEN 'unchanged' WHEN p.run_id IS NULL THEN 'added'
  WHEN coalesce(c.hash <> '' AND c.hash = p.hash, false) THEN 'unchanged' WHEN coalesce(p.hash <> '' AND c.size IS NOT DISTINCT FROM p.size AND c.mtime_ms IS NOT DISTINCT FROM p.mtime_ms, false) THEN 'unchanged' ELSE 'modified' END AS change
FROM p FULL JOIN c ON p.repo = c.repo AND p.path = c.path""",
}
