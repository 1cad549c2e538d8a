"""Imports of scripts by expressions over the whole text, without leaving the JVM: static ones over any lines, re-exports,
``import x = require``, ``require`` and ``import()``. Comments, strings and templates are skipped by the same expression,
so that what they hold is no import. The token reader (``facts``) also knows expressions and JSX; see the tests for how
the two compare."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

SCRIPTS = r"\.[cm]?[jt]sx?$"
# Escapes go first, so that strings end at the next quote; then comments, strings kept.
ESCAPE = r"\\[^\n]"
STRINGS = r"""\"[^\"\n]*\"|'[^'\n]*'|`[^`]*`"""
COMMENT = rf"({STRINGS})|/\*[\s\S]*?\*/|//[^\n]*"
STATEMENT = (
    rf"""(?:{STRINGS})|(?:^|[^\w$.])("""
    r"""import\s*(?:[\s{*][\w$*{},\s]*?\bfrom\s*)?[\"'][^\"'\n]+[\"']"""
    r"""|export\s*(?:type\s*)?(?:\*|\{[\w$,\s]*\})[\w$\s]*?\bfrom\s*[\"'][^\"'\n]+[\"']"""
    r"""|import\s+(?:type\s+)?[\w$]+\s*=\s*require\s*\(\s*[\"'][^\"'\n]+[\"']\s*\)"""
    r"""|import\s*\(\s*(?:\"[^\"\n]+\"|'[^'\n]+'|`[^`$]+`)\s*[,)]"""
    r"""|require\s*\(\s*(?:\"[^\"\n]+\"|'[^'\n]+'|`[^`$]+`)\s*\))"""
)
SPECIFIER = r"""[\"'`]([^\"'`]+)[\"'`][^\"'`]*$"""
# The kind of a statement by the first of these that fits.
SYNTAX = (
    (r"^export", "reexport"), (r"^require", "require"), (r"^import\s*\(", "dynamic"), (r"^import[^\"']*=", "import-equals"), (r"^import\s*[\"']", "side-effect"), (r"^import\s+type\s+(?:[\w$]+\s+from|[*{])", "type-only"),
)


def quick_imports(files: DataFrame) -> DataFrame:
    """``repo, path, at, specifier, syntax`` of scripts, in the order of the text; null texts and paths have none."""
    rows = spread(files.filter(F.col("path").rlike(SCRIPTS)).select("repo", "path", "text"))
    plain = F.regexp_replace(F.regexp_replace("text", ESCAPE, ""), COMMENT, "$1")
    found = F.filter(F.regexp_extract_all(plain, F.lit(STATEMENT), 1), lambda s: s != "")
    kind = F.lit("static")
    for pattern, name in reversed(SYNTAX):
        kind = F.when(F.col("s").rlike(pattern), name).otherwise(kind)
    return rows.select("repo", "path", F.posexplode(found).alias("at", "s")).select("repo", "path", "at", F.regexp_extract("s", SPECIFIER, 1).alias("specifier"), kind.alias("syntax"))
