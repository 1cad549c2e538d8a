"""Source files that nobody of the project wrote by hand.

A multi-pattern automaton goes over each whole text and looks for generation notices, which count in comments before
the first code, and for the marks that compilers and bundlers leave at the beginning of a line. Path rules know
directories that package managers own, lockfiles and the suffixes of generated and minified files. Names of directories
that people use as well (``vendor``, ``dist``, ``gen`` ..) count only where the collection itself shows that they hold
what tools or third parties wrote. Two more tests look at content: word shingles against published libraries (copies,
also slightly changed ones), and the shape of minified code and of bulk data stored as a script.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread, stored
from ..sources.script_tokens import RESERVED
from .tokenizing import chunks

SHINGLE, SIMILAR = 5, 0.8
#: Shingles of a published file from which on a text that holds SIMILAR of them is a copy whatever else it holds.
LEAST = 30
#: Largest text of all libraries that is sent to every worker; above it shingles are joined, with the same result.
BROADCAST_BYTES = 32 << 20
#: Share of the scripts in directories of a doubtful name that must show it, for the name to count.
SHOWN = 0.5

# Parts of generation notices (lower case). They count in comments above the first code.
NOTICES = (
    "autogenerated", "auto-generated", "auto generated", "automatically generated", "machine-written", "machine-generated", "machine generated", "code generated by", "generated code", "this file is generated", "this file was generated", "file generated by", "@generated",
    "generated by the protocol buffer compiler", "do not edit", "do not modify it by hand", "edits will be overwritten", "changes will be lost", "manual changes get reverted", "automatisch erzeugt", "automatisch generiert", "nicht bearbeiten",
    "généré automatiquement", "fichier produit par", "ne pas modifier", "generado automáticamente", "no editar", "gerado automaticamente", "自动生成", "自動生成", "автоматически сгенерирован", "instead",
)
# Of these a notice needs one more word beside it, for people write them too.
WEAK_NOTICES = {"generated code": r"generated code\b.*(?:see|do not|by)\b", "instead": r"\b(?:output|result|product) of\b.*\b(?:edit|change|modify)\b.*\binstead", "do not edit": r"generated|do not edit(?:\.|!|$| this file| by hand)", "no editar": r"gener", "ne pas modifier": r"g[ée]n[ée]r|produit par", "autogenerated": r"autogenerated (?:from|by|file|code)|autogenerated\.|^\W*autogenerated", "this file is generated": r".", "@generated": r"@generated(?:\s|$)"}
# Marks of tools, at the beginning of a line (the last ones of the text).
MARKS = ('Object.defineProperty(exports, "__esModule"', "Object.defineProperty(exports, '__esModule'", "var __awaiter = (this && this.__awaiter)", "var __importDefault = (this && this.__importDefault)", "var __createBinding = (this && this.__createBinding)", "var __extends = (this && this.__extends)", "/******/", "/***/ ", "//# sourceMappingURL=", "System.register([", "parcelRequire", "__d(function(")
AT_START = ("version https://git-lfs.github.com/spec/", "(() => { // webpackBootstrap", "(() => { var __", "(function(modules) { // webpackBootstrap", "(()=>{var __webpack_")
# Directories that belong to package managers and tools, as path expressions.
VENDORED = re.compile(r"(?:^|/)(?:node_modules|bower_components|jspm_packages|\.yarn|site-packages)/")
OUTPUT = re.compile(r"(?:^|/)(?:__generated__|\.next|\.nuxt)/")
# Names that third-party code and output often have, and people's directories as well.
DOUBTFUL = re.compile(r"(?:^|/)(vendor|third[_-]party|deps|external|assets/lib|generated|gen|dist|out|coverage|build(?!/(?:tools|scripts|config)/))/")
LOCKFILE = re.compile(r"(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.ya?ml|bun\.lockb?|composer\.lock|poetry\.lock|Pipfile\.lock|Cargo\.lock|Gemfile\.lock|go\.sum|uv\.lock|deno\.lock)$")
NAMED = re.compile(r"(?:\.pb|_pb|_pb2|_pb2_grpc|\.g|\.gen|\.generated|\.designer|\.min|[-.]min|\.bundle|\.chunk)\.(?:[cm]?[jt]sx?|py|css|d\.ts)$|\.map$|\.snap$")
SCRIPT = re.compile(r"\.(?:[cm]?[jt]sx?|py)$")
HEADER_END = re.compile(r"\s*(?:(?://|#|--|;)[^\n]*(?:\n|$)|/\*[\s\S]*?\*/|<!--[\s\S]*?-->|(?:'use strict'|\"use strict\");?\s*(?:\n|$)|\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?''')")
RELEASE = re.compile(r"^/\*[!*]?\s*(?:@preserve\s+|@license\s+)?[\w@./-]+\s+v?\d+\.\d+(?:\.\d+)?\b[^\n]*(?:\(c\)|copyright|licen[sc]e|\bMIT\b|\bBSD|Apache)", re.I)
RELEASE_BLOCK = re.compile(r"^/\*!\s*(?:\*\s*)?[\w@./-]+\s+v\d+\.\d+(?:\.\d+)?[^*\n]*\n", re.I)
RIGHTS = re.compile(r"\(c\)|licen[sc]e", re.I)
LOCK_TOKEN = re.compile(r"\"(?:[^\"\\]|\\.)*\"|[{}\[\]]", re.S)
LOCK_KEY = re.compile(r"(?m)^[\"']?lockfileVersion[\"']?[ \t]*:")
COLON = re.compile(r"\s*:")
NO_DATA = re.compile(r"\.(?:[cm]?[jt]sx?|py|mdx?|markdown|rst)$")
GENERATED_TYPES = re.compile(r"^\s*(?:get|set)\w+\(\w*\) \{ (?:return )?this\.\w+\.\w+\(\d+, \w+\); \}|^\s*/\*\* I?[A-Z]\w+ \w+ \*/\s*$", re.M)
DATA = re.compile(r"(?:0x[0-9a-fA-F]{1,8},?\s*){8,}|(?:-?\d+(?:\.\d+)?(?:e-?\d+)?,\s*){6,}-?[\d.]*|[\"'`][A-Za-z0-9+/=_-]{56,}[\"'`],?\s*|(?m:^[ \t]*(?:\{\"[^{}\n]*\}|\[(?:[^\[\]\n]*,){2,}[^\[\]\n]*\]),?[ \t]*\r?$)|[\"'`](?:\\x[0-9a-fA-F]{2}|\\\d{1,3}){16,}[\"'`]")
NAME = re.compile(r"(?<![\w$.])[A-Za-z_$][\w$]*")
STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|/\*[\s\S]*?\*/|//[^\n]*")
_words = re.compile(r"\w+").findall


@lru_cache(1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for words, kind in ((NOTICES, "notice"), (MARKS, "mark"), (AT_START, "start")):
        for w in words:
            a.add_word(w.lower(), (kind, w))
    a.make_automaton()
    return a


def header(text: str) -> str:
    """The comments (and directives) above the first code."""
    at = 1 if text.startswith("﻿") else 0
    if text.startswith("#!", at):
        at = text.find("\n", at) + 1 or len(text)
    while m := HEADER_END.match(text, at):
        if m.end() == at:
            break
        at = m.end()
    return text[:at]


def traces(text: str) -> str | None:
    """What the automaton finds: a notice in the header, or the mark of a tool anywhere."""
    lower = text.lower()
    if len(lower) != len(text):  # a letter whose small form is longer: places would differ
        lower = "".join(c if len(c) == 1 else "?" for c in map(str.lower, text))
    end, marked = -1, False
    for last, (kind, word) in _automaton().iter(lower):
        at = last + 1 - len(word)
        if kind == "notice":
            end = len(header(text)) if end < 0 else end
            if last >= end:
                continue
            stop = lower.find("\n", last)
            line = lower[lower.rfind("\n", 0, last) + 1 : end if stop < 0 else min(stop, end)]
            if word not in WEAK_NOTICES or re.search(WEAK_NOTICES[word], line):
                return "notice"
        elif text.startswith(word, at):
            before = text[text.rfind("\n", 0, at) + 1 : at].strip("\ufeff")
            if kind == "mark" and not (before.strip() if word.startswith("/*") else before) or kind == "start" and not text[:at].strip("\ufeff \t\r\n"):
                marked = True
    if end < 0 and "built by " in lower:
        end = len(header(text))
    if end > 0 and re.search(r"(?m)^\W*built by \S+.*(?:reverted|overwritten|lost)", lower[:end]):
        return "notice"
    return "mark" if marked else None


def minified(text: str) -> bool:
    """Long lines almost without blanks, or names of a letter or two throughout and hardly a blank."""
    body = re.sub(r"^\s*/\*[\s\S]*?\*/", "", text.lstrip("\ufeff")).strip()
    if len(body) < 200:
        return False
    lines = body.count("\n") + 1
    blank = sum(map(body.count, " \n\t\r")) / len(body)
    if len(body) / lines > 110 and blank < 0.10:
        return True
    if blank >= 0.12:
        return False
    names = [n for n in NAME.findall(STRING.sub("", body)) if n not in RESERVED]
    return len(names) >= 40 and sum(len(n) <= 2 for n in names) >= 0.8 * len(names)


def bulk(text: str) -> bool:
    """Mostly literal data: numbers, bytes, encoded strings, rows of records."""
    body = text.strip("﻿ \t\r\n")
    if len(body) < 500:
        return False
    data = sum(m.end() - m.start() for m in DATA.finditer(body))
    code = re.sub(r"(?m)^\s*(?://|#|/?\*|import\b|from\b).*$", "", body)
    return data >= 400 and data >= 0.6 * len(code)


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts, codes) of the distinct five-word shingles of each text, in order of both, and their number by text.
    Codes are made from 64-bit hashes of the words, the same on every machine."""
    found = [_words(t.lower()) if t else [] for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    code = {w: xxhash.xxh64_intdigest(w) for w in dict.fromkeys(chain.from_iterable(found))}
    c = np.fromiter(map(code.__getitem__, chain.from_iterable(found)), np.uint64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(found)), sizes)
    n = max(0, len(c) - SHINGLE + 1)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            total = (total + c[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(31)
    whole = doc[:n] == doc[SHINGLE - 1 : SHINGLE - 1 + n]
    doc, total = doc[:n][whole], total[whole]
    order = np.lexsort((total, doc))
    doc, total = doc[order], total[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (total[1:] != total[:-1])])[: len(doc)]
    return doc[new], total[new], np.bincount(doc[new], minlength=len(found))


def similar(shared, own, known):
    """Whether a text is a copy of a published file: a Jaccard similarity of SIMILAR or more, or that share of the
    file's shingles, if they are LEAST or more. Numbers, arrays or Columns."""
    return (shared >= SIMILAR * (own + known - shared)) | ((shared >= SIMILAR * known) & (known >= LEAST))


class Libraries:
    """The shingles of published files, for comparison inside a task."""

    def __init__(self, texts: list[str]):
        file, codes, self.sizes = shingles(texts)
        order = np.argsort(codes, kind="stable")
        self.codes, self.files = codes[order], file[order]

    def copies(self, texts: list[str | None]) -> np.ndarray:
        """Which texts are copies of one of the files."""
        out = np.zeros(len(texts), bool)
        doc, codes, own = shingles(texts)
        first = np.searchsorted(self.codes, codes, "left")
        count = np.searchsorted(self.codes, codes, "right") - first
        hit = np.flatnonzero(count)
        if not len(hit):
            return out
        n = count[hit]
        at = np.repeat(first[hit] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        pair = np.repeat(doc[hit], n) * len(self.sizes) + self.files[at]
        pair, shared = np.unique(pair, return_counts=True)
        d, f = pair // len(self.sizes), pair % len(self.sizes)
        out[d[similar(shared, own[d], self.sizes[f])]] = True
        return out


_at_hand: dict[str, Libraries] = {}


def _libraries(name: str, texts) -> Libraries:
    """Those of a broadcast, built once in each worker."""
    if name not in _at_hand:
        _at_hand.clear()
        _at_hand[name] = Libraries(texts.value)
    return _at_hand[name]


def locks(path: str, text: str) -> bool:
    """Whether a text is a lockfile by its content: its version is a key of the outermost object."""
    if "lockfileVersion" not in text and not path.endswith(".json"):
        return False
    body = text.lstrip("\ufeff \t\r\n")
    if path.endswith(".json") and re.match(r"\{\s*\"(?:lockfileVersion|version)\"\s*:\s*\d+\s*,\s*\"(?:sources|file|names|mappings|requires|packages)\"", body):
        return True
    if body.startswith("{"):
        depth = 0
        for m in LOCK_TOKEN.finditer(body) if '"lockfileVersion"' in body else ():
            k = m.group()
            if k == '"lockfileVersion"' and depth == 1 and COLON.match(body, m.end()):
                return True
            depth += 1 if k in "{[" else -1 if k in "}]" else 0
        return False
    return body.startswith("lockfileVersion:") or not NO_DATA.search(path) and bool(LOCK_KEY.search(body))


def released(text: str) -> bool:
    """Whether the header is that of a release: name, version, and rights in the same comment."""
    head = header(text).lstrip("\ufeff \t\r\n")
    if RELEASE.match(head):
        return True
    m = RELEASE_BLOCK.match(head)
    return bool(m and RIGHTS.search(head, m.end(), end if (end := head.find("*/", m.end())) >= 0 else len(head)))


def reason(path: str, text: str, copied: bool) -> str | None:
    """Why a file isn't hand-written, or None: what its text and the certain path rules say."""
    if copied:
        return "copy"
    if LOCKFILE.search(path):
        return "lockfile"
    if VENDORED.search(path):
        return "vendored"
    if NAMED.search(path):
        return "named"
    if OUTPUT.search(path) and SCRIPT.search(path):
        return "output"
    if found := traces(text):
        return found
    if locks(path, text):
        return "lockfile"
    if SCRIPT.search(path):
        if released(text):
            return "released"
        if minified(text):
            return "minified"
        if bulk(text):
            return "data"
        members = GENERATED_TYPES.findall(text)
        if len(members) >= 4 and len(members) * 4 >= text.count("\n"):
            return "shape"
    return None


def machine_written(documents: DataFrame, libraries: DataFrame, only_found: bool = False, key: str = "doc_id") -> DataFrame:
    """``key, reason``: why the file isn't hand-written (copy, lockfile, vendored, named, output, notice, mark,
    released, minified, data, shape, directory), null where it is. ``only_found``: without those.

    Null texts count as empty, null paths as empty: only what the other one says can make a case. An empty text
    is no case unless its path makes it one. Repeated rows are judged each; further columns are ignored. An empty
    table of libraries makes no copies.

    A script in a directory of a doubtful name is a case (``directory``) if of all scripts in directories of that
    name at least SHOWN are cases by their own text.

    Plan: one narrow stage over whole texts writes a row of few bytes per file to the shared folder; a count by name
    (some ten groups, summed before they are shuffled) is joined to it. Libraries are a fixed, small table: their texts
    are read by the driver, whose total is checked against BROADCAST_BYTES; beyond it the files' shingles are written
    as well and joined (``copies_by_join``), by the same codes and the same condition."""
    size = libraries.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    known, shared = uuid.uuid4().hex, None
    if size <= BROADCAST_BYTES:
        texts = [r[0] for r in libraries.filter("text IS NOT NULL").select("text").distinct().collect()]
        shared = documents.sparkSession.sparkContext.broadcast(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_hand = _libraries(known, shared) if shared is not None else None
        for batch in batches:
            paths = batch.column(1).to_pylist()
            for first, texts in chunks(batch.column(2)):
                n = len(texts)
                copied = at_hand.copies(texts).tolist() if at_hand else [False] * n
                some = paths[first : first + n]
                why = [reason(p, t or "", c) for p, t, c in zip(some, texts, copied)]
                names = [m.group(1) if (m := DOUBTFUL.search(p)) and SCRIPT.search(p) else None for p in some]
                codes = pa.nulls(n, pa.list_(pa.int64()))
                if not at_hand:
                    _, all_codes, sizes = shingles(texts)
                    codes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(all_codes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(why, pa.string()), pa.array(names, pa.string()), codes], names=[key, "reason", "name", "codes"])

    rows = spread(documents.select(key, F.coalesce("path", F.lit("")).alias("path"), "text"))
    out = T.StructType([rows.schema[key], T.StructField("reason", T.StringType()), T.StructField("name", T.StringType()), T.StructField("codes", T.ArrayType(T.LongType()))])
    judged = stored(rows.mapInArrow(run, out).withColumn("row", F.monotonically_increasing_id()))
    if shared is None:
        copies = copies_by_join(judged, libraries).withColumn("copied", F.lit("copy"))
        judged = judged.join(copies, "row", "left").withColumn("reason", F.coalesce("copied", "reason"))
    doubtful = judged.filter("name IS NOT NULL").groupBy("name").agg((F.count("reason") / F.count("*")).alias("shown")).filter(F.col("shown") >= SHOWN)
    judged = judged.join(F.broadcast(doubtful), "name", "left").select(key, F.coalesce("reason", F.when(F.col("shown").isNotNull(), "directory")).alias("reason"))
    return judged.filter("reason IS NOT NULL") if only_found else judged


def copies_by_join(judged: DataFrame, libraries: DataFrame) -> DataFrame:
    """``row`` of copies where the libraries are too many to send around; ``judged`` has rows with their ``codes``.

    A copy holds at least SIMILAR of a file's shingles, so it holds one of any set of more than the other ones: of each
    file its rarest such set is joined with the documents' shingles, so that what many files and documents share (a
    licence) joins nothing. The pairs found are counted exactly: each joined with its document's and its file's codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in chunks(batch.column(0)):
                doc, codes, sizes = shingles(texts)
                first = np.concatenate([[0], np.cumsum(sizes)])
                names = [uuid.uuid5(uuid.NAMESPACE_OID, t).hex for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(codes.view(np.int64)))], names=["file", "known", "codes"])

    files = stored(libraries.filter("text IS NOT NULL").select("text").distinct().mapInArrow(run, "file string, known long, codes array<long>"))
    of_files = files.select("file", "known", F.explode("codes").alias("code"))
    often = of_files.groupBy("code").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("file").orderBy("n", "code"))
    prefix = of_files.join(often, "code").withColumn("r", rank).filter(F.col("r") <= F.floor(F.col("known") * (1 - SIMILAR) + 1e-9) + 1).select("file", "code")
    of_rows = judged.select("row", F.size("codes").alias("own"), F.explode("codes").alias("code"))
    pairs = stored(of_rows.join(prefix, "code").select("row", "file", "own").distinct())
    shared = pairs.join(files, "file").select("row", "file", "own", "known", F.explode("codes").alias("code")).join(of_rows.select("row", "code"), ["row", "code"]).groupBy("row", "file", "own", "known").agg(F.count("*").alias("shared"))
    return shared.filter(similar(F.col("shared"), F.col("own"), F.col("known"))).select("row").distinct()
