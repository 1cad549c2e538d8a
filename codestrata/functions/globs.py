"""Ordered path patterns as Column expressions: compiled once on the driver to regular expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import ancestors

_LITERAL = set(".+()|^$\\/")


def _alternatives(body: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(body):
        depth += (c == "{") - (c == "}")
        if c == "," and not depth:
            out.append(body[start:i])
            start = i + 1
    return [*out, body[start:]]


def _closing_brace(pattern: str, at: int) -> int:
    depth = 0
    for i in range(at, len(pattern)):
        depth += (pattern[i] == "{") - (pattern[i] == "}")
        if not depth:
            return i
    return -1


def _expression(pattern: str) -> str:
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(?:[^/]*/)*")
            i += 3
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
        elif c == "*":
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[" and (end := pattern.find("]", i + 1)) > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = end + 1
        elif c == "{" and (end := _closing_brace(pattern, i)) > 0:
            out.append("(?:" + "|".join(map(_expression, _alternatives(pattern[i + 1 : end]))) + ")")
            i = end + 1
        else:
            out.append("\\" + c if c in _LITERAL or c in "[{" else c)
            i += 1
    return "".join(out)


@dataclass(frozen=True)
class Rule:
    """A pattern: without ``/`` it fits names at any depth; a trailing ``/`` or ``/**`` also covers all below."""

    raw: str
    negated: bool
    directory: bool
    regex: str

    @classmethod
    def of(cls, raw: str) -> Rule:
        p = raw.strip()
        negated = p.startswith("!")
        p = p.removeprefix("!")
        directory = p.endswith(("/", "/**"))
        p = p.removesuffix("/").removesuffix("/**")
        return cls(raw, negated, directory, ("^" if "/" in p else "^(?:.*/)?") + _expression(p) + ("(?:/.*)?$" if directory else "$"))

    def literal_prefix(self) -> str:
        """The directories that every fitting path begins with; '' if none are sure."""
        p = self.raw.strip().removeprefix("!")
        return p[: m.start()].rpartition("/")[0] if "/" in p and (m := re.search(r"[*?\[{]|$", p)) else ""


def rules(patterns: list[str]) -> list[Rule]:
    return [Rule.of(p) for p in patterns if p.strip()]


def plain(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", ""), r"^/+|/+$", "")


def _any_fits(paths: Column, regex: str) -> Column:
    return F.exists(paths, lambda a: a.rlike(regex))


def last_match(path: Column, patterns: list[str]) -> Column:
    """Whether the last rule that fits isn't negated (as in ignore files); false where none fits."""
    p, out = plain(path), F.lit(False)
    for r in rules(patterns):
        fits = p.rlike(r.regex)
        if r.directory:
            fits = fits | _any_fits(ancestors(p), r.regex)
        out = F.when(fits, not r.negated).otherwise(out)
    return F.when(p == "", False).otherwise(out)


def any_match(path: Column, patterns: list[str]) -> Column:
    """Whether a positive rule fits."""
    p, out = plain(path), F.lit(False)
    for r in rules(patterns):
        if not r.negated:
            out = out | p.rlike(r.regex)
    return out


def matcher(patterns: list[str]):
    """The same as ``last_match`` for one path on the driver or in a listing task."""
    compiled = [(r, re.compile(r.regex)) for r in rules(patterns)]

    def test(path: str) -> bool:
        p = path.replace("\\", "/").removeprefix("./").strip("/")
        if not p:
            return False
        parts = p.split("/")
        above = ["/".join(parts[:i]) for i in range(1, len(parts))]
        out = False
        for r, x in compiled:
            if x.search(p) or r.directory and any(x.search(a) for a in above):
                out = not r.negated
        return out

    return test


def ignore_lines(text: str | None) -> list[str]:
    """The patterns of an ignore file: lines that aren't blank or comments."""
    return [s for line in (text or "").split("\n") if (s := line.strip()) and not s.startswith("#")]
