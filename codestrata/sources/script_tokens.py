"""Tokens of TypeScript and JavaScript modules, with JSX.

A token is its kind: punctuation, reserved and contextual words stand for themselves, everything else for its
class. Of ``>`` each character is a token of its own, ``Tokens.near`` tells that nothing stands before it.
"""

from __future__ import annotations

import re
import sys

RESERVED = frozenset("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split())
CONTEXTUAL = frozenset("abstract accessor any as assert asserts async await boolean constructor declare from get global implements infer interface is keyof let module namespace never number object of out override package private protected public readonly require satisfies set static string symbol target type undefined unique unknown using yield meta defer".split())

_space = re.compile(r"(?:[ \t\v\f\xa0﻿  -   　]+|//[^\n\r  ]*)+")
_break = re.compile(r"[\n\r  ]\s*")
_main = re.compile(
    r"[ \t]*(?:(?P<id>[A-Za-z_$\\\xaa\xb5\xba\xc0-῿‌‍Ⰰ-⿯、-﻾\U00010000-\U000e01ef][\w$\\‌‍]*)"
    r"|(?P<str>\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')"
    r"|(?P<num>(?:0[xX][\da-fA-F](?:_?[\da-fA-F])*n?|0[bB][01](?:_?[01])*n?|0[oO][0-7](?:_?[0-7])*n?|(?:\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?n?)(?![\w$]))"
    r"|(?P<op>\.\.\.|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|=>|==|!=|<=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|%=|&=|\|=|\^=|\*\*|<<|[{}()\[\];,<>+\-*%&|^!~?:=.@])"
    r"|(?P<priv>\#[A-Za-z_$\xaa-￿][\w$‌‍]*))"
)
_known = RESERVED | CONTEXTUAL
_comment = re.compile(r"/\*(?:[^*]|\*(?!/))*\*/")
_regex = re.compile(r"/(?![*/])(?:[^\n\r/\\\[]|\\[^\n\r]|\[(?:[^\n\r\]\\]|\\[^\n\r])*\])+/[A-Za-z]*")
_template = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)?")
_jsx_name = re.compile(r"[A-Za-z_$][\w$.:-]*")
_jsx_attr = re.compile(r"[A-Za-z_$][\w$:-]*")
_jsx_str = re.compile(r"\"[^\"]*\"|'[^']*'")
_blank = re.compile(r"(?:\s|/\*[\s\S]*?\*/|//[^\n]*)*")
_angle = re.compile(r"<|(?<!=)>")
_jsx_text = re.compile(r"[^{}<>]*")
_generic_arrow = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|extends\b[^=>]*[,>])")

#: After these an operand ends, so that a slash divides.
_ENDS = frozenset(") ] } id num str tpl tt re this super null true false jx) priv".split()) | (CONTEXTUAL - {"of", "await", "yield"})


class Tokens:
    """``kinds``; ``lines``: whether a line ends before the token; ``near``: nothing stands before it; ``places``."""

    __slots__ = ("kinds", "lines", "near", "places", "bad")

    def __init__(self):
        self.kinds: list[str] = []
        self.lines: list[bool] = []
        self.near: list[bool] = []
        self.places: list[int] = []
        self.bad = -1


class Unlexable(Exception):
    pass


def lex(text: str, jsx: bool) -> Tokens:
    """All tokens, with ``eof`` at the end; ``bad`` is the place of a character that starts no token, or -1."""
    out = Tokens()
    start = 1 if text.startswith("\ufeff") else 0
    if text.startswith("#!", start):
        start = len(text) if (e := text.find("\n", start)) < 0 else e
    try:
        try:
            end = _run(text, start, jsx, out, False)
        except RecursionError:  # once more, as deep as templates and elements can be nested; frames are on the heap
            limit = sys.getrecursionlimit()
            out = Tokens()
            sys.setrecursionlimit(limit + 3 * (text.count("{") + text.count("<")))
            try:
                end = _run(text, start, jsx, out, False)
            finally:
                sys.setrecursionlimit(limit)
        if end < len(text):
            out.bad = end
    except Unlexable as e:
        out.bad = e.args[0]
    for k, v in ((out.kinds, "eof"), (out.lines, True), (out.near, False), (out.places, len(text))):
        k.append(v)
    return out


def _run(text: str, at: int, jsx: bool, out: Tokens, nested: bool) -> int:
    """Lex from ``at`` to the end, or if nested to the brace that isn't opened here (which is not consumed)."""
    kinds, lines, near, places = out.kinds, out.lines, out.near, out.places
    space, brk, main = _space.match, _break.match, _main.match
    depth, newline, close, size = 0, True, False, len(text)
    first = len(kinds)
    while at < size:
        m = main(text, at)
        if m is None:
            if m := space(text, at):
                at, close = m.end(), False
                continue
            if m := brk(text, at):
                at, newline, close = m.end(), True, False
                continue
            c = text[at]
            if c == "/":
                if text.startswith("/*", at):
                    m = _comment.match(text, at)
                    if m is None:
                        raise Unlexable(at)
                    if "\n" in m.group():
                        newline = True
                    at, close = m.end(), False
                    continue
                prev = kinds[-1] if len(kinds) > first else "("
                if prev not in _ENDS or (prev == "}" and newline):
                    m = _regex.match(text, at)
                    if m is None:
                        raise Unlexable(at)
                    kind, end = "re", m.end()
                else:
                    kind = "/=" if text.startswith("/=", at) else "/"
                    end = at + len(kind)
            elif c == "`":
                m = _template.match(text, at + 1)
                if m.group(1) is None:
                    raise Unlexable(at)
                if m.group(1) == "`":
                    kind, end = "tpl", m.end()
                else:
                    kinds.append("th"), lines.append(newline), near.append(close), places.append(at)
                    newline, at = False, m.end()
                    while True:
                        at = _run(text, at, jsx, out, True)
                        if at >= size:
                            raise Unlexable(at)
                        m = _template.match(text, at + 1)
                        if m.group(1) is None:
                            raise Unlexable(at)
                        kinds.append("tt" if m.group(1) == "`" else "tm"), lines.append(False), near.append(False), places.append(at)
                        at = m.end()
                        if m.group(1) == "`":
                            break
                    close = True
                    continue
            else:
                raise Unlexable(at)
        else:
            kind = m.lastgroup
            start, end = m.span(kind)
            if start != at:
                at, close = start, False
            if kind == "id":
                word = m[kind]
                if word in _known and not (kinds and kinds[-1] in (".", "?.") and len(kinds) > first):  # after a dot any word is a plain name
                    kind = word
            elif kind == "op":
                kind = m[kind]
                if kind == "{":
                    depth += 1
                elif kind == "}":
                    if not depth and nested:
                        return at
                    depth -= 1
                elif kind == "<" and jsx and (not kinds or len(kinds) == first or kinds[-1] not in _ENDS) and (text[end : end + 1].isalpha() or text[end : end + 1] in (">", "_", "$")) and not _generic_arrow.match(text, at):
                    kinds.append("jx("), lines.append(newline), near.append(close), places.append(at)
                    at = _jsx(text, at, out)
                    kinds.append("jx)"), lines.append(False), near.append(False), places.append(at)
                    newline, close = False, True
                    continue
        kinds.append(kind)
        lines.append(newline)
        near.append(close)
        places.append(at)
        newline, close, at = False, True, end
    return at


def _inner(text: str, at: int, out: Tokens) -> int:
    """The expression in braces of a JSX element; ``at`` is after the opening brace."""
    out.kinds.append("jx{"), out.lines.append(False), out.near.append(False), out.places.append(at)
    at = _run(text, at, True, out, True)
    if at >= len(text):
        raise Unlexable(at)
    out.kinds.append("jx}"), out.lines.append(False), out.near.append(False), out.places.append(at)
    return at + 1


def _jsx(text: str, at: int, out: Tokens) -> int:
    """One JSX element from its ``<``; tags must match, and text holds no bare ``>`` or ``}``."""
    start = at
    m = _jsx_name.match(text, at + 1)
    name, at = (m.group(), m.end()) if m else ("", at + 1)
    if name and text.startswith("<", at):  # type arguments
        depth = 0
        while True:
            m = _angle.search(text, at)
            if m is None:
                raise Unlexable(start)
            depth += 1 if m.group() == "<" else -1
            at = m.end()
            if not depth:
                break
    while True:
        at = _blank.match(text, at).end()
        if text.startswith("/>", at):
            return at + 2
        c = text[at : at + 1]
        if c == ">":
            at += 1
            break
        if c == "{":
            at = _inner(text, at + 1, out)
        elif m := _jsx_attr.match(text, at):
            at = _blank.match(text, m.end()).end()
            if text.startswith("=", at):
                at = _blank.match(text, at + 1).end()
                if m := _jsx_str.match(text, at):
                    at = m.end()
                elif text.startswith("{", at):
                    at = _inner(text, at + 1, out)
                elif text.startswith("<", at):
                    at = _jsx(text, at, out)
                else:
                    raise Unlexable(at)
        else:
            raise Unlexable(at if at < len(text) else start)
    while True:
        at = _jsx_text.match(text, at).end()
        c = text[at : at + 1]
        if c == "{":
            at = _inner(text, at + 1, out)
        elif c == "<":
            if text.startswith("</", at):
                at = _blank.match(text, at + 2).end()
                m = _jsx_name.match(text, at)
                closing, at = (m.group(), m.end()) if m else ("", at)
                at = _blank.match(text, at).end()
                if closing != name or text[at : at + 1] != ">":
                    raise Unlexable(at)
                return at + 1
            at = _jsx(text, at, out)
        else:
            raise Unlexable(at if at < len(text) else start)
