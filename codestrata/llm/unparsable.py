"""Source files that do not parse.

Texts are lexed into rows of tokens ``(row, position, depth, pair)``, where ``pair`` is the token with its language
and the token before it. Then, each as operations on rows:

* neighbouring pairs are anti-joined with the pairs that the grammar of the language permits (``token_pairs``);
* nesting is validated by windows over (document, depth): the bracket before a closing one must be its partner, and
  pairs that only some brackets may hold must stand in one of these;
* statements are windows of tokens (of source lines in Python) that are reduced to productions: equal windows of all
  documents are one row, each is reduced once, and documents with a window that reduces to no production are broken.

A document is broken if one of the tests finds something. The structure that layout carries in YAML and Python is
written as brackets by their lexers, so that the same tests see it. JSON and YAML have no statements: pairs and
nesting decide.
"""

from __future__ import annotations

import io
import keyword
import re
import tokenize
import warnings
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread, stored
from ..sources.script_tokens import CONTEXTUAL, RESERVED, Tokens, lex
from .script_grammar import ASSIGN, NAMES, Module
from .token_pairs import JSON, PYTHON, SCRIPT, YAML, permitted, within
from .tokenizing import chunks
from .yaml_tokens import scan

# The language by extension, and which scripts may hold JSX.
LANGUAGES = {"ts": "typescript", "tsx": "typescript", "mts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "json": "json", "yml": "yaml", "yaml": "yaml", "py": "python"}
JSX = {"tsx", "jsx", "js", "mjs"}
FAMILY = {"typescript": 1, "javascript": 1, "json": 2, "yaml": 3, "python": 4}
GRAMMAR = {1: SCRIPT, 2: JSON, 3: YAML, 4: PYTHON}
OPENING = {1: {"(": ")", "[": "]", "{": "}", "th": "tt", "jx(": "jx)", "jx{": "jx}"}, 2: {"[": "]", "{": "}"}, 3: {"m(": "m)", "s(": "s)", "[": "]", "{": "}"}, 4: {"(": ")", "[": "]", "{": "}", "in(": "in)", "f(": "f)"}}
# Python's operators by their place in the grammar.
BINARY = frozenset("% // << >> & | ^ == != < <= > >=".split())
AUGMENTED = frozenset(f"{x}=" for x in "+ - * / // % @ & | ^ >> << **".split())
# Tokens after which a statement may be over at the end of a line, and tokens that begin the next one
# wherever they stand; after the first list any of the second, after the others only words that continue nothing.
OVER = {";", "}"}
OPERANDS = {"str", "num", "tpl", "tt", "]", "true", "false", "null", "this", "re"}
BEGINS = frozenset("import export const var function class if for return throw try switch let type interface async declare abstract enum namespace @ id do break continue".split())
ALONE = frozenset("const var if for throw try switch".split())

_json_token = re.compile(r'(?P<name>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"[ \t\r\n]*:)|(?P<str>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<num>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))|(?P<word>true|false|null)(?!\w)|(?P<op>[{}\[\]:,])|(?P<gap>[ \t\r\n]+)|(?P<note>//[^\n\r]*|/\*[\s\S]*?\*/)')
_json_note = re.compile(r"(?:[ \t\r\n]|//[^\n\r]*|/\*[\s\S]*?\*/)*:")


# Lexing


class Numbers(dict):
    """Numbers of token kinds; 0 for others."""

    def __missing__(self, kind: str) -> int:
        return 0


@lru_cache(8)
def numbers(family: int) -> tuple[dict[str, int], np.ndarray]:
    """Numbers of a family's token kinds, and by number that of the kind by which its pairs are known; 0 is none."""
    terms = sorted({k for p in permitted(GRAMMAR[family]) for k in p})
    of = Numbers({k: n for n, k in enumerate(terms, 1)})
    if family != 1:
        return of, np.arange(len(of) + 1)
    kinds = Numbers({**of, **{k: n for n, k in enumerate(sorted((NAMES | ASSIGN | RESERVED | CONTEXTUAL | set("|| && ?? ^ == != === !== <= << / % **".split())) - set(of)), len(of) + 1)}})
    by = np.arange(len(kinds) + 1)
    for k, n in kinds.items():
        if k in of and k not in ASSIGN:
            continue
        by[n] = of["name"] if k in NAMES else of["="] if k == "=" else of["set"] if k in ASSIGN else of["op"] if k not in RESERVED else 0
    for k in NAMES:
        by[kinds[k]] = of["name"]
    by[kinds["="]] = of["set"]
    return kinds, by


def lex_json(text: str, relaxed: bool) -> tuple[list[str], list[int], int]:
    """(kinds, places, place of what is no token or -1); ``relaxed``: comments are blank and a comma may stand
    before a closing bracket."""
    kinds, places, at = [], [], 1 if text.startswith("﻿") else 0
    while at < len(text):
        m = _json_token.match(text, at)
        if m is None or m.lastgroup == "note" and not relaxed:
            break
        kind, end = m.lastgroup, m.end()
        if kind not in ("gap", "note"):
            kind = m.group() if kind == "op" else kind
            if relaxed and kind == "str" and (colon := _json_note.match(text, end)):
                kind, end = "name", colon.end()
            if relaxed and kind in ("]", "}") and len(kinds) > 1 and kinds[-1] == "," and kinds[-2] not in ("[", "{", ","):
                kinds.pop(), places.pop()
            kinds.append(kind)
            places.append(at)
        at = end
    kinds = [",n" if a == "," and b == "name" else a for a, b in zip(kinds, [*kinds[1:], ""])]
    return [*kinds, "eof"], [*places, len(text)], at if at < len(text) else -1


def lex_python(text: str) -> tuple[list[str], list[int], int, list[str]]:
    """(kinds, lines, line of what is no token or -1, source of each statement at the left edge)."""
    text = text.removeprefix("﻿")
    kinds, lines, cuts, depth, decorated, start = [], [], [0], 0, False, True
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            for t in tokenize.generate_tokens(io.StringIO(text).readline):
                s, k = t.string, tokenize.tok_name[t.type]
                if k in ("COMMENT", "NL", "ENDMARKER"):
                    continue
                if k == "NAME":
                    kind = "none" if s in ("None", "True", "False") else s if keyword.iskeyword(s) else "soft" if s in ("match", "case", "type") else "name"
                elif k == "OP":
                    kind = "op" if s in BINARY else "set" if s in AUGMENTED else s
                else:
                    kind = {"NUMBER": "num", "STRING": "str", "NEWLINE": "nl", "INDENT": "in(", "DEDENT": "in)", "FSTRING_START": "f(", "FSTRING_MIDDLE": "fm", "FSTRING_END": "f)"}.get(k, "?")
                if start and depth == 0 and kind not in ("in)", "in(", "else", "elif", "except", "finally"):
                    if not decorated:
                        cuts.append(t.start[0] - 1)
                    decorated = kind == "@"
                start = kind in ("nl", "in)")
                depth += (kind == "in(") - (kind == "in)")
                kinds.append(kind)
                lines.append(t.start[0])
    except (tokenize.TokenError, SyntaxError, ValueError) as e:
        at = e.args[1] if len(e.args) > 1 else None
        return [*kinds, "eof"], [*lines, len(lines)], max(1, int(at[0] if isinstance(at, tuple) and len(at) == 2 else getattr(e, "lineno", 1) or 1)), []
    source = text.split("\n")
    cuts = sorted(set(cuts))
    return [*kinds, "eof"], [*lines, len(source)], -1, ["\n".join(source[a:b]) + "\n" for a, b in zip(cuts, [*cuts[1:], len(source)])]


def statements(kinds: np.ndarray, breaks: np.ndarray, close: np.ndarray, depth: np.ndarray, head: int) -> tuple[list[int], list[bytes]]:
    """(first tokens, windows) of a script: cut where outside all brackets a line ends a statement and the next one
    begins another for certain. A window is ``head``, the numbers of its tokens, then for each whether a line ends
    before it and, of ``>``, whether it stands close to the one before; so equal windows reduce alike."""
    over, operand, begins, alone, import_, call, angle = _roles()
    b = np.flatnonzero(breaks[1:-1] & (depth[1:-1] == 0)) + 1
    a, k, nxt = kinds[b - 1], kinds[b], kinds[b + 1]
    ok = begins[k] & over[a] | alone[k] & operand[a] | (k == import_) & (operand[a] | over[a])
    at = [0, *b[ok & ~((k == import_) & call[nxt])].tolist()]
    flags = (breaks.astype(np.uint8) | ((close & (kinds == angle)).astype(np.uint8) << 1)).tobytes()
    codes = kinds.astype(np.uint8).tobytes()
    return at, [bytes([head]) + codes[i:j] + flags[i:j] for i, j in zip(at, [*at[1:], len(kinds) - 1]) if j > i]


@lru_cache(1)
def _roles():
    of = numbers(1)[0]
    table = lambda words: np.isin(np.arange(len(of) + 1), [of[w] for w in words])
    return table(OVER), table(OPERANDS), table(BEGINS), table(ALONE), of["import"], table("(."), of[">"]


@lru_cache(8)
def _sides(family: int) -> tuple[np.ndarray, np.ndarray]:
    """By number of a kind: 1 opens, -1 closes, 0; and its role: 1 opens, 2 closes, 3 depends on the bracket
    around it, 0."""
    of = numbers(family)[0]
    side, roles = np.zeros(len(of) + 1, np.int64), np.zeros(len(of) + 1, np.int64)
    for a, b in OPENING[family].items():
        side[of[a]], side[of[b]] = 1, -1
    roles[side > 0], roles[side < 0] = 1, 2
    roles[[of[k] for k in {k for _, k in bound(family)} if not side[of[k]]]] = 3
    return side, roles


@lru_cache(8)
def bound(family: int) -> set[tuple[str, str]]:
    """(bracket or '', kind) of all kinds that stand in some brackets only: the closing ones, the end and, where
    there are no statements to decide, separators and keys."""
    pairs = within(GRAMMAR[family], OPENING[family])
    some = {*OPENING[family].values(), "eof", *({2: (",", ",n"), 3: ("key", "val", "item")}.get(family, ()))}
    return {(around, b) for around, _, b in pairs if b in some}


#: Layout of a token: depth, role (2 bits), family (4), number of the token before (8), its own (8).
DEPTH, ROLE, PAIR = 22, 20, (1 << 20) - 1


def token_rows(family: int, kinds: np.ndarray) -> np.ndarray:
    """The tokens of one document; ``kinds``: their numbers."""
    side, roles = _sides(family)
    by = numbers(family)[1]
    step = side[kinds]
    depth = np.cumsum(step) + (step < 0)  # an opener and its closer have the depth of what is between them
    code = by[kinds]
    before = np.concatenate([[by[numbers(family)[0]["start"]]], code[:-1]])
    return depth << DEPTH | roles[kinds] << ROLE | family << 16 | before << 8 | code


def lexed_text(path: str | None, text: str | None, placed: bool = True) -> tuple:
    """(language, tokens, their lines, windows, their first lines, line of what is no token or None); lines of tokens
    only if ``placed``."""
    name = (path or "").rpartition("/")[2]
    suffix = name.rpartition(".")[2] if "." in (path or "") else ""
    language = LANGUAGES.get(suffix)
    none = np.zeros(0, np.int64)
    if language is None or text is None or not text.strip("﻿ \t\r\n\v\f"):
        return language, none, none, [], [], None
    family = FAMILY[language]
    of = numbers(family)[0]
    windows, begins = [], []
    if family == 4:
        kinds, lines, bad, sources = lex_python(text)
        codes = np.fromiter(map(of.__getitem__, kinds), np.int64, len(kinds))
        lines = np.asarray(lines, np.int64) if placed else none
        windows = [b"\x04" + s.encode("utf-8", "surrogatepass") for s in sources]
        begins = list(np.cumsum([1, *(s.count("\n") for s in sources[:-1])])) if sources else []
        return language, token_rows(family, codes), lines, windows, begins, None if bad < 0 else bad
    if family == 1:
        tokens: Tokens = lex(text, suffix in JSX)
        kinds, places, bad = tokens.kinds, tokens.places, tokens.bad
    elif family == 2:
        kinds, places, bad = lex_json(text, name.startswith("tsconfig"))
    else:
        kinds, places, bad = scan(text)
    codes = np.fromiter(map(of.__getitem__, kinds), np.int64, len(kinds))
    lines = none
    if placed:
        ends = np.fromiter((m.start() for m in re.finditer("\n", text)), np.int64)
        lines = np.searchsorted(ends, np.asarray(places, np.int64), side="left") + 1
    rows = token_rows(family, codes)
    if family == 1 and bad < 0:
        at, windows = statements(codes, np.array(tokens.lines), np.array(tokens.near), rows >> DEPTH, 1 | (language == "typescript") << 3)
        begins = lines[at[: len(windows)]].tolist() if placed else [0] * len(windows)
    return language, rows, lines, windows, begins, None if bad < 0 else text.count("\n", 0, bad) + 1


def lexed(documents: DataFrame, key: str = "doc_id", placed: bool = True) -> DataFrame:
    """``key, repo, language, tokens, lines, windows, begins, bad`` of each file, in one narrow stage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(2).to_pylist()
            for first, texts in chunks(batch.column(3)):
                out = [lexed_text(p, t, placed) for p, t in zip(paths[first : first + len(texts)], texts)]
                part = batch.slice(first, len(texts))
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(o[n]) for o in out])]), pa.int32()), pa.array(np.concatenate([o[n] for o in out]), t)) for n, t in ((1, pa.int64()), (2, pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([o[0] for o in out], pa.string()), *lists, pa.array([o[3] for o in out], pa.list_(pa.binary())), pa.array([o[4] for o in out], pa.list_(pa.int32())), pa.array([o[5] for o in out], pa.int32())], names=[key, "repo", "language", "tokens", "lines", "windows", "begins", "bad"])

    rows = spread(documents.select(key, "repo", "path", "text"))
    fields = [T.StructField("repo", T.StringType()), T.StructField("language", T.StringType()), T.StructField("tokens", T.ArrayType(T.LongType())), T.StructField("lines", T.ArrayType(T.IntegerType())), T.StructField("windows", T.ArrayType(T.BinaryType())), T.StructField("begins", T.ArrayType(T.IntegerType())), T.StructField("bad", T.IntegerType())]
    return rows.mapInArrow(run, T.StructType([rows.schema[key], *fields]))


# Tests on rows


def pair_table(spark: SparkSession) -> DataFrame:
    """The permitted pairs of all grammars, a few thousand numbers."""
    rows = []
    for family, grammar in GRAMMAR.items():
        of, by = numbers(family)
        term = lambda k: int(by[of[k]])  # noqa: B023, E731
        rows += sorted({(family << 16 | term(a) << 8 | term(b),) for a, b in permitted(grammar)})
    return spark.createDataFrame(rows, "pair bigint")


def scope_table(spark: SparkSession) -> DataFrame:
    """The kinds that an open bracket permits and others don't, as (number of the bracket or 0, kind)."""
    rows = {(numbers(f)[0].get(around, 0), f << 8 | numbers(f)[0][k]) for f in GRAMMAR for around, k in bound(f)}
    return spark.createDataFrame(sorted(rows), "around int, item int")


def odd_pairs(tokens: DataFrame, pairs: DataFrame) -> DataFrame:
    """``row, position`` of tokens that may not stand after the one before: an anti-join, narrow for the table is
    a few thousand numbers."""
    return tokens.join(F.broadcast(pairs), "pair", "left_anti").select("row", "position")


def odd_nesting(tokens: DataFrame, scopes: DataFrame) -> DataFrame:
    """``row, position`` of tokens that the bracket around them doesn't permit: closing brackets of another kind, ends
    inside a bracket, separators of something else. Only brackets and such tokens are shuffled, by document and depth.
    Openers need no test: one that isn't closed is the bracket before the next closing one of its depth, or the end."""
    near = tokens.filter("role > 0")
    own = F.col("pair").bitwiseAND(0xFF).cast("int")
    w = W.partitionBy("row", "depth").orderBy("position").rowsBetween(W.unboundedPreceding, -1)
    around = F.coalesce(F.last(F.when(F.col("role") < 3, own), ignorenulls=True).over(w), F.lit(0))
    item = F.shiftleft(F.shiftright("pair", 16), 8).bitwiseOR(own).cast("int")
    found = near.withColumns({"around": around, "item": item}).filter("role > 1")
    return found.join(F.broadcast(scopes), ["around", "item"], "left_anti").select("row", "position")


def reduces(window: bytes) -> bool:
    """Whether a window is a sequence of statements."""
    if window[0] == 4:
        return parses(window[1:].decode("utf-8", "surrogatepass"))
    n = (len(window) - 1) // 2
    names = _names()
    tokens = Tokens()
    tokens.kinds = [*map(names.__getitem__, window[1 : n + 1]), "eof"]
    flags = window[n + 1 :]
    tokens.lines, tokens.near = [*(bool(f & 1) for f in flags), True], [*(bool(f & 2) for f in flags), False]
    return Module(tokens, bool(window[0] & 8)).check() < 0


@lru_cache(1)
def _names() -> list[str]:
    of = numbers(1)[0]
    out = ["?"] * (len(of) + 1)
    for k, n in of.items():
        out[n] = k
    return out


def parses(source: str) -> bool:
    """Whether source lines are statements of Python. What is nested deeper than its parser can follow is left to
    pairs and nesting."""
    import ast

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(source)
            return True
        except (SyntaxError, ValueError):
            return False
        except (RecursionError, MemoryError):
            return True


def odd_windows(windows: DataFrame) -> DataFrame:
    """``window`` of those that reduce to no production. Equal windows are one row before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wrong = [not reduces(w.as_py()) for w in batch.column(0)]
            yield batch.filter(pa.array(wrong, pa.bool_()))

    return windows.select("window").distinct().mapInArrow(run, "window binary")


def unparsable(documents: DataFrame, only_broken: bool = False, key: str = "doc_id", pairs: DataFrame | None = None) -> DataFrame:
    """``key, repo, language, broken, what, line_no`` of each file: whether the grammar of the language of its
    name rejects it, at which of the tests (token, pair, nesting, production) and about where (of a production the
    line on which the statement begins). ``only_broken``: without the others, and without places. ``pairs``: a table of permitted pairs instead of ``pair_table``.

    The language is null for names without one of the known extensions, and such files, as null, empty and
    blank texts, are never broken. Null path: no language. Repeated rows are judged each, further columns are
    ignored. An empty table gives no rows.

    Plan: tokens are written once to the shared folder, about as many bytes as the texts, packed. Pairs are tested
    where they are read; brackets are shuffled by (document, depth), distinct windows and the documents' windows by
    the window, so that a statement that many documents share is reduced once; AQE splits it in the join."""
    spark = documents.sparkSession
    rows = stored(lexed(documents, key, not only_broken).withColumn("row", F.monotonically_increasing_id()))
    one = rows.filter("bad IS NULL").select("row", F.posexplode("tokens").alias("position", "t"))
    tokens = one.select("row", "position", F.shiftright("t", DEPTH).alias("depth"), F.shiftright("t", ROLE).bitwiseAND(3).alias("role"), F.col("t").bitwiseAND(PAIR).alias("pair"))
    windows = rows.filter("bad IS NULL").select("row", F.explode(F.arrays_zip("windows", "begins")).alias("w")).select("row", F.col("w.windows").alias("window"), F.col("w.begins").alias("line"))
    finding = lambda df, order, what, at: df.select("row", F.struct(F.lit(order).alias("order"), F.col(at).alias("at"), F.lit(what).alias("what")).alias("f"))
    found = (
        finding(rows.filter("bad IS NOT NULL"), 0, "token", "bad")
        .union(finding(odd_pairs(tokens, pair_table(spark) if pairs is None else pairs), 1, "pair", "position"))
        .union(finding(odd_nesting(tokens, scope_table(spark)), 2, "nesting", "position"))
        .union(finding(windows.join(odd_windows(windows), "window", "left_semi"), 3, "production", "line"))
    )
    first = found.groupBy("row").agg(F.min("f").alias("f"))
    out = rows.select("row", key, "repo", "language", *([] if only_broken else ["lines"])).join(first, "row", "inner" if only_broken else "left")
    line = F.lit(None).cast("int")
    if not only_broken:
        line = F.when(F.col("f.order").isin(0, 3), F.col("f.at")).otherwise(F.element_at("lines", F.col("f.at") + 1))
    return out.select(key, "repo", "language", F.col("f").isNotNull().alias("broken"), F.col("f.what").alias("what"), line.alias("line_no"))


def latest_records(files: DataFrame) -> DataFrame:
    """The scanner's newest record of each file (ties by their fields)."""
    best = F.max(F.struct("scanned_at", "parse_status", "skipped_reason", "language"))
    return files.groupBy("repo", "path").agg(best.alias("b")).select("repo", "path", "b.parse_status", "b.skipped_reason", F.col("b.language").alias("scanned_language"))


def rates(documents: DataFrame, files: DataFrame) -> DataFrame:
    """Per repository and language: files with a text, broken ones and their share, and how many of those the
    scanner called fine, or skipped. Repositories without such files have no row; a null repository is one."""
    judged = unparsable(documents.filter("text IS NOT NULL")).filter("language IS NOT NULL")
    paths = documents.select("doc_id", "path")
    status = latest_records(files)
    rows = judged.join(paths, "doc_id").join(status, ["repo", "path"], "left")
    n = F.count("*")
    broken = F.count_if("broken")
    return rows.groupBy("repo", "language").agg(n.alias("files"), broken.alias("broken"), F.round(broken / n, 6).alias("rate"), F.count_if(F.col("broken") & (F.col("parse_status") == "ok")).alias("called_fine"), F.count_if(F.col("skipped_reason").isNotNull()).alias("skipped"))
