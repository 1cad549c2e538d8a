"""Configuration formats read into key paths with the places of their values.

Each reader takes a text and gives, in order, ``(path, start, end, quoted)``: the names from the outermost key to the
value's own (items of a list have the name ``[]``), and where the value stands, without its quotes. Readers go on
behind what they can't read, so that broken files give what is in order; none of them nests calls.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from .yaml_tokens import Bad, Scanner

Entry = tuple[tuple[str, ...], int, int, bool]

_json = re.compile(r'"(?:[^"\\\n]|\\.)*"|-?\d[\d.eE+-]*|[{}\[\]:,]|//[^\n]*|/\*[\s\S]*?\*/|\w+')
_line = re.compile(r"[^\n]*(?:\n|$)")
_toml_key = re.compile(r"[ \t]*((?:[\w-]+|\"(?:[^\"\\\n]|\\.)*\"|'[^'\n]*')(?:[ \t]*\.[ \t]*(?:[\w-]+|\"(?:[^\"\\\n]|\\.)*\"|'[^'\n]*'))*)[ \t]*=[ \t]*")
_toml_part = re.compile(r"[\w-]+|\"(?:[^\"\\\n]|\\.)*\"|'[^'\n]*'")
_toml_value = re.compile(r"\"\"\"((?:[^\\]|\\[\s\S])*?)\"\"\"|'''([\s\S]*?)'''|\"((?:[^\"\\\n]|\\.)*)\"|'([^'\n]*)'|([^\s,\]}#=\[{]+)")
_toml_gap = re.compile(r"(?:\s|#[^\n]*)*")
_section = re.compile(r"[ \t]*\[+[ \t]*([^\]\n]+?)[ \t]*\]+[ \t\r]*(?:[#;][^\n]*)?$")
_setting = re.compile(r"[ \t]*(?:export[ \t]+)?(?P<key>(?:[^\s=:#;!\"'\[\]\\]|\\.)(?:[^=:\n\\]|\\.)*?)[ \t]*(?P<op>[=:])[ \t]*")
_quoted = re.compile(r"\"((?:[^\"\\]|\\[\s\S])*)\"|'([^']*)'")
_tag = re.compile(r"<!--[\s\S]*?-->|<!\[CDATA\[([\s\S]*?)\]\]>|<[?!][^>]*>|<(/?)([\w:.-]+)((?:\s+[\w:.-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*(/?)>|([^<]+)")
_attribute = re.compile(r"([\w:.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")

# Extensions of the formats; names of environment files begin with .env or end in one of theirs.
FORMATS = {"json": "json", "json5": "json", "jsonc": "json", "map": "json", "webmanifest": "json", "yml": "yaml", "yaml": "yaml", "toml": "toml", "ini": "ini", "cfg": "ini", "conf": "ini", "npmrc": "ini", "properties": "properties", "env": "env", "envrc": "env", "production": "env", "local": "env", "development": "env", "staging": "env", "example": "env", "xml": "xml", "plist": "xml", "config": "xml", "csproj": "xml"}


def format_of(path: str) -> str | None:
    name = path.rpartition("/")[2].lower()
    return "env" if name.startswith(".env") else FORMATS.get(name.rpartition(".")[2])


def _spelled(raw: str) -> str:
    """A quoted JSON or TOML name without its quotes and escapes."""
    if raw[:1] == "'":
        return raw[1:-1]
    try:
        return json.loads(raw, strict=False) if raw[:1] == '"' else raw
    except ValueError:
        return raw.strip('"')


def read_json(text: str) -> Iterator[Entry]:
    """Strings, numbers and words by their keys; comments and bare names are allowed."""
    stack: list[str | None] = []  # per open bracket: the key at hand, or None in a list
    last: tuple[str, int, int] | None = None

    def value():
        if last:
            quoted = last[0][0] in "\"'"
            yield tuple("[]" if k is None else k for k in stack), last[1] + quoted, last[2] - quoted, quoted

    for m in _json.finditer(text):
        k = m.group()
        if k[:2] in ("//", "/*"):
            continue
        if k == ":" and last and stack and stack[-1] is not None:
            stack[-1], last = _spelled(last[0]), None
        elif k in "{}[],":
            yield from value()
            last = None
            if k in "{[":
                stack.append("" if k == "{" else None)
            elif k in "}]" and stack:
                stack.pop()
        elif k != ":":
            yield from value() if last and stack and stack[-1] is None else ()
            last = (k, m.start(), m.end())
    yield from value()


def read_yaml(text: str) -> Iterator[Entry]:
    """Scalars by their keys, as far as the text can be scanned. A block text has its place without the indicator."""
    s = Scanner(text)
    try:
        s.run()
    except Bad:
        pass
    stack: list[str | None] = []  # per open collection: the key at hand, or None in a list
    single: list[int] = []  # collections that are a pair without brackets, an item of a list
    keyed = False
    for n, kind in enumerate(s.kinds):
        if kind in (",", "]", "}") and single and single[-1] == len(stack):
            single.pop()
            stack.pop()
        if kind in ("m(", "{", "s(", "["):
            stack.append("" if kind in ("m(", "{") else None)
        elif kind in ("m)", "}", "s)", "]"):
            if stack:
                stack.pop()
        elif kind == "key":
            keyed = True
            if stack and stack[-1] is None:
                stack.append("")
                single.append(len(stack))
        elif kind == "val":
            keyed = False
        elif kind == "scalar":
            at, end, quoted = s.places[n], s.ends[n], text[s.places[n]] in "'\""
            if keyed:
                if stack:
                    raw = text[at:end]
                    stack[-1] = raw[1:-1].replace("''", "'") if raw[:1] == "'" else _spelled(raw) if raw[:1] == '"' else raw
                continue
            if text[at] in "|>" and not quoted:
                at = text.find("\n", at, end) + 1 or end
                at += len(text[at:end]) - len(text[at:end].lstrip())
                end = at + len(text[at:end].rstrip())
            yield tuple("[]" if k is None else k for k in stack), at + quoted, end - quoted, quoted


def read_toml(text: str) -> Iterator[Entry]:
    """Values by section and key, in lists and inline tables as well."""
    section: tuple[str, ...] = ()
    at = 0
    while at < len(text):
        at = _toml_gap.match(text, at).end()
        stop = e if (e := text.find("\n", at)) >= 0 else len(text)
        if m := _section.match(text, at, stop):
            section = tuple(_spelled(p) for p in _toml_part.findall(m.group(1)))
        elif m := _toml_key.match(text, at):
            stack: list[tuple[str, ...] | None] = [tuple(_spelled(p) for p in _toml_part.findall(m.group(1)))]
            at = m.end()
            while stack:  # until the value and all that it opened are over
                c = text[at : at + 1]
                if c == "[":
                    stack.append(None)
                    at = _toml_gap.match(text, at + 1).end()
                elif c == "{":
                    stack.append(())
                    at = k.end() if (k := _toml_key.match(text, _toml_gap.match(text, at + 1).end())) else at + 1
                    if k:
                        stack[-1] = tuple(_spelled(p) for p in _toml_part.findall(k.group(1)))
                elif v := _toml_value.match(text, at):
                    g = next(i for i in range(1, 6) if v.group(i) is not None)
                    yield section + tuple(x for k in stack for x in (("[]",) if k is None else k)), v.start(g), v.end(g), g < 5
                    at = v.end()
                elif len(stack) == 1:
                    break
                if len(stack) == 1 and c not in ("[", "{"):
                    break
                if c in ("[", "{"):
                    continue
                at = _toml_gap.match(text, at).end()
                c = text[at : at + 1]
                while c and c in "]}" and len(stack) > 1:
                    stack.pop()
                    at = _toml_gap.match(text, at + 1).end() if len(stack) > 1 else at + 1
                    c = text[at : at + 1]
                if len(stack) == 1:
                    break
                if c == ",":
                    at = _toml_gap.match(text, at + 1).end()
                    if stack[-1] is not None and (k := _toml_key.match(text, at)):
                        stack[-1], at = tuple(_spelled(p) for p in _toml_part.findall(k.group(1))), k.end()
                elif not _toml_value.match(text, at) and c not in ("[", "{"):
                    break
            continue
        at = stop + 1


def read_settings(text: str, kind: str) -> Iterator[Entry]:
    """Lines ``key = value`` of INI, properties and environment files. In INI files a section comes before the key;
    in properties a backslash carries a line on; in environment files a quoted value may span lines."""
    section: tuple[str, ...] = ()
    at = 0
    while at < len(text):
        m = _line.match(text, at)
        begin, stop = at, m.end()
        at = max(stop, begin + 1)
        line = text[begin:stop].rstrip("\r\n")
        if kind == "ini" and (m := _section.match(line)):
            section = tuple(p.strip("\"' ") for p in re.split(r"[.\s]+", m.group(1)) if p.strip("\"' "))
            continue
        while kind == "properties" and line.endswith("\\") and not line.endswith("\\\\") and at < len(text):
            m = _line.match(text, at)
            at = max(m.end(), at + 1)
            line = text[begin:at].rstrip("\r\n")
        m = _setting.match(line)
        if m is None or line.lstrip()[:1] in ("#", ";", "!") or kind == "env" and (m.group("op") == ":" or not re.fullmatch(r"[\w.-]+", m.group("key"))):
            continue
        name = re.sub(r"\\(.)", r"\1", m.group("key"))
        path = section + tuple(p for p in name.split(".") if p)
        start = begin + m.end()
        if q := _quoted.match(text, start):
            g = 1 if q.group(1) is not None else 2
            if kind == "env" or "\n" not in q.group():
                yield path, q.start(g), q.end(g), True
                at = max(at, q.end())
                continue
        value = line[m.end() :]
        if kind != "properties":
            value = re.split(r"\s+[#;]", value, maxsplit=1)[0]
        value = value.rstrip()
        yield path, start, start + len(value), False


def read_xml(text: str) -> Iterator[Entry]:
    """Texts of elements and values of attributes; an attribute ``value`` beside a ``name`` or ``key`` has its name."""
    stack: list[str] = []
    for m in _tag.finditer(text):
        if m.group(3):
            if m.group(2):
                while stack and stack.pop() != m.group(3):
                    pass
                continue
            attributes = [(a, 2 if a.group(2) is not None else 3) for a in _attribute.finditer(text, m.start(4), m.end(4))]
            named = next((a.group(g) for a, g in attributes if a.group(1).lower() in ("name", "key", "id")), None)
            for a, g in attributes:
                own = (named,) if named and a.group(1).lower() == "value" else (a.group(1),)
                yield (*stack, m.group(3), *own), a.start(g), a.end(g), True
            if not m.group(5):
                stack.append(m.group(3))
        else:
            g = 1 if m.group(1) is not None else 6
            if m.group(g) and (v := m.group(g).strip()):
                at = m.start(g) + m.group(g).index(v)
                yield tuple(stack), at, at + len(v), False


def entries(text: str, kind: str) -> Iterator[Entry]:
    """All values of a text of one of the FORMATS."""
    if kind in ("ini", "properties", "env"):
        return read_settings(text, kind)
    return {"json": read_json, "yaml": read_yaml, "toml": read_toml, "xml": read_xml}[kind](text)
