"""Tokens of YAML texts, with the block structure that indentation carries written as brackets.

``m(`` and ``m)`` stand around a block mapping, ``s(`` and ``s)`` around a block sequence; ``key`` stands before
each key and ``val`` for its colon, as in the token streams of the published YAML 1.1 specification. A token that
its surroundings forbid (a second colon, an item beside a value) has the kind ``?``, which no pair permits.
"""

from __future__ import annotations

import re

_blank = re.compile(r"[ \t]*(?:#[^\n\r]*)?")
_plain = re.compile(r"(?:[^\s:#]|:(?=[^\s])|(?<=[^\s])#)+")
_plain_flow = re.compile(r"(?:[^\s:#,\[\]{}]|:(?=[^\s,\[\]{}])|(?<=[^\s])#)+")
_name = re.compile(r"[\w-]+(?=[\s?:,\]}%@`]|$)", re.ASCII)
_tag = re.compile(r"!(?:<[^>\s]*>|[\w;/?:@&=+$.!~*'()%#-]*)(?=[\s,\]}]|$)", re.ASCII)
_single = re.compile(r"'(?:[^']|'')*'")
_double = re.compile(r"\"(?:[^\"\\]|\\(?:[0abt\tnvfre \"/\\N_LP\n]|\r\n|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*\"")
_edge = re.compile(r"^(?:---|\.\.\.)(?=\s|$)", re.M)
_block = re.compile(r"[|>](?:[+-]?[1-9]?|[1-9][+-])(?:[ \t]+#[^\n\r]*|[ \t]*)(?=[\r\n]|$)")
_unprintable = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\ud800-\udfff￾￿]")


class Bad(Exception):
    """The place of what starts no token."""


class Scanner:
    def __init__(self, text: str):
        self.text, self.at = text, 1 if text.startswith("﻿") else 0
        self.kinds: list[str] = []
        self.places: list[int] = []
        self.ends: list[int] = []  # of scalars: where they end
        self.levels: list[tuple[int, str]] = []  # column and kind (m, s, or i: a sequence at the column of its mapping)
        self.flow: list[bool] = []  # per open bracket: whether its present entry has a colon
        self.keys: dict[int, tuple[int, int, int, bool]] = {}  # per flow depth: token, place, column, required
        self.allow = True  # a key may start here
        self.line = self.at  # where the line begins

    def emit(self, kind: str, where: int, at: int | None = None) -> None:
        at = len(self.kinds) if at is None else at
        self.kinds.insert(at, kind)
        self.places.insert(at, where)
        self.ends.insert(at, where)

    @property
    def column(self) -> int:
        return self.at - self.line

    def indent(self) -> int:
        return self.levels[-1][0] if self.levels else -1

    def unwind(self, column: int, item: bool = False) -> None:
        while self.levels and (self.levels[-1][0] > column or self.levels[-1] == (column, "i") and not item):
            self.emit("m)" if self.levels.pop()[1] == "m" else "s)", self.at)

    def roll(self, column: int, kind: str, where: int, at: int | None = None) -> None:
        if not self.flow and self.indent() < column:
            self.levels.append((column, kind))
            self.emit(f"{kind}(", where, at)

    def forget(self) -> None:
        key = self.keys.pop(len(self.flow), None)
        if key and key[3]:
            raise Bad(key[1])

    def stale(self) -> None:
        """A key ends on the line on which it began."""
        for depth, (_, place, _, required) in list(self.keys.items()):
            if place < self.line:
                if required:
                    raise Bad(place)
                del self.keys[depth]

    def may_be_key(self) -> None:
        if self.allow:
            self.forget()
            self.keys[len(self.flow)] = (len(self.kinds), self.at, self.column, not self.flow and self.indent() == self.column)

    def skip(self) -> None:
        """To the next token; each line break lets a key begin in block context."""
        text = self.text
        while True:
            m = _blank.match(text, self.at)
            tab = text.find("\t", self.at, m.end())
            if tab >= 0 and not self.flow and self.allow and not text[self.at : tab].strip(" ") and m.end() < len(text) and text[m.end()] not in "\r\n" and text[self.line : self.at].strip() == "":
                raise Bad(tab)
            self.at = m.end()
            if not text.startswith(("\n", "\r"), self.at):
                return
            self.at += 2 if text.startswith("\r\n", self.at) else 1
            self.line = self.at
            if not self.flow:
                self.allow = True

    def blank_after(self, n: int = 1) -> bool:
        return self.text[self.at + n : self.at + n + 1] in ("", " ", "\t", "\n", "\r")

    def run(self) -> None:
        text = self.text
        if m := _unprintable.search(text):
            raise Bad(m.start())
        while True:
            self.skip()
            self.stale()
            c = text[self.at : self.at + 1]
            item = c == "-" and self.blank_after()
            if not self.flow:
                self.unwind(self.column, item)
            if not c:
                self.forget()
                if not self.flow:
                    self.unwind(-1)
                self.emit("eof", self.at)
                return
            if self.column == 0 and (c == "%" or text.startswith(("---", "..."), self.at) and self.blank_after(3)):
                self.forget()
                self.unwind(-1)
                self.allow = False
                self.emit("dir" if c == "%" else "doc" if c == "-" else "end", self.at)
                self.at = (e if (e := text.find("\n", self.at)) >= 0 else len(text)) if c == "%" else self.at + 3
            elif c in "[{":
                self.may_be_key()
                self.flow.append(False)
                self.allow = True
                self.emit(c, self.at)
                self.at += 1
            elif c in "]}":
                self.forget()
                if self.flow:
                    self.flow.pop()
                self.allow = False
                self.emit(c, self.at)
                self.at += 1
            elif c == "," and self.flow:
                self.forget()
                self.flow[-1] = False
                self.allow = True
                self.emit(c, self.at)
                self.at += 1
            elif item:
                self.item()
            elif c == "?" and (self.flow or self.blank_after()):
                if not self.flow:
                    if not self.allow:
                        raise Bad(self.at)
                    self.roll(self.column, "m", self.at)
                self.forget()
                self.allow = not self.flow
                self.emit("key", self.at)
                self.at += 1
            elif c == ":" and (self.flow or self.blank_after()):
                self.value()
            else:
                self.scalar(c)

    def item(self) -> None:
        if self.flow:
            self.emit("?", self.at)
        else:
            if not self.allow:
                raise Bad(self.at)
            if self.levels and self.levels[-1] == (self.column, "m"):
                if self.kinds[-1] in ("val", "key", "anchor", "tag"):
                    self.levels.append((self.column, "i"))
                    self.emit("s(", self.at)
                else:
                    self.emit("?", self.at)
            self.roll(self.column, "s", self.at)
            self.emit("item", self.at)
        self.forget()
        self.allow = True
        self.at += 1

    def value(self) -> None:
        key = self.keys.pop(len(self.flow), None)
        if key:
            number, place, column, _ = key
            self.emit("key", place, number)
            self.roll(column, "m", place, number)
            self.allow = False
        else:
            if not self.flow:
                if not self.allow:
                    raise Bad(self.at)
                self.roll(self.column, "m", self.at)
            self.allow = not self.flow
        if self.flow:
            if self.flow[-1]:
                self.emit("?", self.at)
            self.flow[-1] = True
        self.emit("val", self.at)
        self.at += 1

    def scalar(self, c: str) -> None:
        text = self.text
        if c in "|>" and not self.flow:
            return self.block()
        self.may_be_key()
        self.allow = False
        if c in "*&":
            m = _name.match(text, self.at + 1)
            kind = "alias" if c == "*" else "anchor"
        elif c == "!":
            m, kind = _tag.match(text, self.at), "tag"
        elif c in "'\"":
            m, kind = (_single if c == "'" else _double).match(text, self.at), "scalar"
            if m and _edge.search(text, self.at, m.end()):
                raise Bad(self.at)
        elif c in ",[]{}#%@`|>" or c in "-?:" and (self.blank_after() or self.flow and c != "-"):
            raise Bad(self.at)
        else:
            return self.plain()
        if m is None:
            raise Bad(self.at)
        self.emit(kind, self.at)
        self.ends[-1] = m.end()
        self.move(m.end())

    def move(self, end: int) -> None:
        """Go to ``end``; lines may lie between."""
        at = max(self.text.rfind("\n", self.at, end), self.text.rfind("\r", self.at, end))
        if at >= 0:
            self.line = at + 1
        self.at = end

    def plain(self) -> None:
        """Words of one line and of further ones that are indented more than the level."""
        text, start, floor = self.text, self.at, self.indent() + 1
        word = (_plain_flow if self.flow else _plain).match
        end, several = start, False
        at, line = start, self.line
        while True:
            m = word(text, at)
            if m is None:
                break
            end, self.line = m.end(), line
            at = end
            while True:  # blanks and line breaks up to the next word
                while text.startswith((" ", "\t"), at):
                    if text[at] == "\t" and line > self.line and at - line < floor:
                        raise Bad(at)
                    at += 1
                if not text.startswith(("\n", "\r"), at):
                    break
                at += 2 if text.startswith("\r\n", at) else 1
                line = at
            if line > self.line:
                if not self.flow and at - line < floor or _edge.match(text, line) and at == line:
                    several = True
                    break
                several = True
            if text.startswith("#", at):
                break
        self.emit("scalar", start)
        self.at = self.ends[-1] = end
        if several and not self.flow:
            self.allow = True

    def block(self) -> None:
        """A literal or folded text: all following lines that are indented more than the level."""
        text = self.text
        m = _block.match(text, self.at)
        if m is None:
            raise Bad(self.at)
        self.forget()
        self.emit("scalar", self.at)
        given = next((int(x) for x in m.group() if x.isdigit()), 0) if "#" not in m.group() else next((int(x) for x in m.group().partition("#")[0] if x.isdigit()), 0)
        floor = max(self.indent(), 0) + given if given else 0
        at = m.end()
        least = self.indent() + 1
        while at < len(text):
            at += 2 if text.startswith("\r\n", at) else 1
            line = at
            while text.startswith(" ", at) and (not floor or at - line < floor):
                at += 1
            if text.startswith(("\n", "\r"), at) or at >= len(text):
                if at >= len(text):
                    self.line = line
                continue
            if not floor:
                if text.startswith("\t", at) and at - line < max(least, 1) and text[at:].split("\n", 1)[0].strip():
                    raise Bad(at)
                floor = max(at - line, least, 1) if at - line >= max(least, 1) or least <= 0 and at - line >= 1 else max(least, 1)
                if least <= 0 and at == line and not _edge.match(text, line):
                    floor = -1  # a text at the left edge of a document
            if floor > 0 and at - line < floor or floor < 0 and _edge.match(text, line):
                at = line
                break
            e = min((x for x in (text.find("\n", at), text.find("\r", at)) if x >= 0), default=len(text))
            at = e
        self.line = max(text.rfind("\n", 0, at), text.rfind("\r", 0, at)) + 1
        self.at = self.ends[-1] = at
        self.allow = True


def scan(text: str) -> tuple[list[str], list[int], int]:
    """(kinds, places, place of what starts no token or -1)."""
    s = Scanner(text)
    try:
        s.run()
        return s.kinds, s.places, -1
    except Bad as e:
        s.emit("eof", len(text))
        return s.kinds, s.places, e.args[0]
