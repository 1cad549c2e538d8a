"""Facts of TypeScript and JavaScript sources from their tokens: imports, exports, symbols, calls, routes, signals.

Declarations and static imports are read at nesting depth 0; ``require``, ``import()``, calls, routes and signals are
looked for among all tokens, bodies included. What can't be read is left out, never an error.
"""

from __future__ import annotations

import re

from .script_tokens import CONTEXTUAL, RESERVED, Tokens, lex

_word = re.compile(r"[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*")
_string = re.compile(r"\"((?:[^\"\\\n\r]|\\[\s\S])*)\"|'((?:[^'\\\n\r]|\\[\s\S])*)'|`((?:[^`\\$]|\\[\s\S]|\$(?!\{))*)`")
_escape = re.compile(r"\\(u\{[\da-fA-F]+\}|u[\da-fA-F]{4}|x[\da-fA-F]{2}|\r\n|[\s\S])")
# Fixed values.
ROUTE_METHODS = frozenset("get post put patch delete options head all use".split())
ROUTE_OWNER = re.compile(r"^(?:app|router|server|api|routes?|fastify|instance|handler|controller)$|(?:Router|App|Server|Api)$", re.I)
HTTP_DECORATORS = frozenset("Get Post Put Patch Delete Options Head All Controller Route".split())
CALL_SIGNALS = {
    "describe": "test:suite", "it": "test:suite", "test": "test:suite", "beforeEach": "test:suite", "afterEach": "test:suite", "EventEmitter": "event:emitter", "Queue": "queue:usage", "Job": "queue:usage", "Worker": "worker:usage",
    "setInterval": "schedule:usage", "setTimeout": "schedule:usage", "cron": "schedule:usage", "schedule": "schedule:usage", "emit": "event:emitter", "publish": "event:emitter", "dispatch": "event:emitter", "subscribe": "event:emitter", "listen": "http:framework",
}
OWNER_SIGNALS = {"console": "console:usage", "window": "browser:api", "document": "browser:api"}
KINDS = {"class": "class", "interface": "interface", "enum": "enum", "namespace": "namespace", "module": "namespace", "type": "type", "function": "function"}
NAMES = CONTEXTUAL | {"id"}


def _unescape(m: re.Match) -> str:
    e = m.group(1)
    if e[0] in "ux" and len(e) > 1:
        return chr(min(int(e[1:].strip("{}"), 16), 0x10FFFF))
    return {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": ""}.get(e, e)


class Reader:
    def __init__(self, text: str, tokens: Tokens):
        self.text, self.k, self.at, self.i = text, tokens.kinds, tokens.places, 0
        self.lines: list[int] | None = None
        self.partner: dict[int, int] = {}
        self.depth = [0] * len(self.k)
        stack: list[int] = []
        for i, k in enumerate(self.k):
            if k in ("(", "[", "{", "th", "jx(", "jx{"):
                self.depth[i] = len(stack)
                stack.append(i)
            elif k in (")", "]", "}", "tt", "jx)", "jx}"):
                if stack:
                    self.partner[stack.pop()] = i
                self.depth[i] = len(stack)
            else:
                self.depth[i] = len(stack)
        self.open = stack
        self.imports, self.exports, self.symbols, self.calls, self.routes, self.signals = [], [], [], [], [], set()
        self.esm = self.cjs = False

    def kind(self, i: int) -> str:
        return self.k[i] if i < len(self.k) else "eof"

    def word(self, i: int) -> str:
        m = _word.match(self.text, self.at[i]) if i < len(self.at) else None
        return m.group() if m else ""

    def literal(self, i: int) -> str | None:
        if self.kind(i) not in ("str", "tpl"):
            return None
        m = _string.match(self.text, self.at[i])
        return _escape.sub(_unescape, next(g for g in m.groups() if g is not None)) if m else None

    def line(self, i: int) -> int:
        if self.lines is None:
            self.lines = [0]
            n, p = 1, 0
            self._line_of = {}
            for j, a in enumerate(self.at):
                n += self.text.count("\n", p, a)
                p = a
                self._line_of[j] = n
        return self._line_of.get(i, 1)

    def end_of(self, i: int) -> int:
        """After the bracket pair that opens at i."""
        return self.partner.get(i, len(self.k) - 1) + 1

    def add_import(self, i: int, specifier: str | None, syntax: str, names=(), default=None, namespace=None, type_only=False) -> None:
        if specifier is not None:
            self.imports.append({"specifier": specifier, "syntax": syntax, "names": list(names), "default_import": default, "namespace_import": namespace, "line": self.line(i), "type_only": type_only})
            if syntax in ("require", "import-equals"):
                self.cjs = True
            elif not type_only:
                self.esm = True

    def braced(self, i: int) -> tuple[list[tuple[str, str]], int]:
        """((name, name it gets) of ``{a, b as c, type D}``, index after it)."""
        out, j, end = [], i + 1, self.end_of(i) - 1
        while j < end:
            if self.kind(j) == "type" and self.kind(j + 1) not in (",", "}", "as"):
                j += 1
            name = self.literal(j) if self.kind(j) == "str" else self.word(j)
            alias = name
            if self.kind(j + 1) == "as" and j + 2 <= end:
                alias = self.literal(j + 2) if self.kind(j + 2) == "str" else self.word(j + 2)
                j += 2
            if name:
                out.append((name, alias or name))
            while j < end and self.kind(j) != ",":
                j += 1
            j += 1
        return out, end + 1

    def import_(self, i: int) -> int:
        j = i + 1
        if self.kind(j) == "(":
            self.add_import(i, self.literal(j + 1), "dynamic")
            return j
        if self.kind(j) == ".":
            return j
        if self.kind(j) == "str":
            self.add_import(i, self.literal(j), "side-effect")
            return j + 1
        type_only = self.kind(j) == "type" and (self.kind(j + 1) in ("{", "*") or self.kind(j + 1) in NAMES and self.kind(j + 2) in ("from", ","))
        j += type_only
        names, default, namespace = [], None, None
        while self.kind(j) not in ("eof", "str", ";"):
            k = self.kind(j)
            if k == "{":
                found, j = self.braced(j)
                names += [n for n, _ in found]
            elif k == "*" and self.kind(j + 1) == "as":
                namespace = self.word(j + 2)
                j += 3
            elif k == "=":
                if self.kind(j + 1) == "require" and self.kind(j + 2) == "(":
                    self.add_import(i, self.literal(j + 3), "import-equals", type_only=type_only)
                return j + 1
            elif k == "from" and self.kind(j + 1) in ("str", "tpl"):
                j += 1
            elif k in NAMES and default is None:
                default = self.word(j)
                j += 1
            elif k in RESERVED or j > i + 400:
                return j
            else:
                j += 1
        self.add_import(i, self.literal(j), "type-only" if type_only else "static", names, default, namespace, type_only)
        return j + 1

    def export(self, i: int) -> int:
        j, line = i + 1, self.line(i)

        def out(name: str, kind: str, default=False, source=None, type_only=False):
            self.exports.append({"name": name, "kind": kind, "is_default": default, "line": line, "from_specifier": source, "type_only": type_only})

        if self.kind(j) == "default":
            if self.kind(j + 1) in ("class", "interface", "function", "enum", "type") or self.kind(j + 1) in ("async", "abstract", "declare") and self.kind(j + 2) in ("function", "class"):
                out("default", "unknown", True)
                return self.declaration(j + 1, True, True)
            out("default", "unknown", True)
            return j + 1
        type_only = self.kind(j) == "type" and self.kind(j + 1) in ("{", "*")
        j += type_only
        if self.kind(j) == "{":
            found, after = self.braced(j)
            source = self.literal(after + 1) if self.kind(after) == "from" else None
            if source is not None:
                self.add_import(i, source, "reexport", [n for n, _ in found], type_only=type_only)
                self.esm = True
            for _, alias in found:
                out(alias, "reexport" if source is not None else "unknown", False, source, type_only)
            return after
        if self.kind(j) == "*":
            namespace = self.word(j + 2) if self.kind(j + 1) == "as" else None
            after = j + (3 if namespace else 1)
            source = self.literal(after + 1) if self.kind(after) == "from" else None
            if source is not None:
                self.add_import(i, source, "reexport", [], namespace=namespace, type_only=type_only)
                self.esm = True
                out(namespace or "*", "reexport" if namespace else "star", False, source, type_only)
            return after + 1
        if self.kind(j) == "=":
            out("export=", "unknown")
            self.cjs = True
            return j + 1
        if self.kind(j) == "import":
            return self.import_(j)
        return self.declaration(j, True, False)

    def symbol(self, i: int, kind: str, exported: bool, default: bool, extends=(), implements=()) -> None:
        name = self.word(i)
        if name:
            self.symbols.append({"name": name, "kind": kind, "exported": exported, "is_default": default, "extends": list(extends), "implements": list(implements), "line": self.line(i)})

    def declaration(self, i: int, exported: bool, default: bool) -> int:
        while self.kind(i) in ("declare", "abstract", "async") and self.kind(i + 1) in (*KINDS, "const", "let", "var", "abstract", "async"):
            i += 1
        k = self.kind(i)
        if k in ("class", "interface", "enum", "namespace", "module"):
            if self.kind(i + 1) not in NAMES and self.kind(i + 1) != "str":
                return i + 1
            heritage, mode, j, angle = {"extends": [], "implements": []}, None, i + 2, 0
            while self.kind(j) not in ("{", ";", "=", "eof"):
                if self.kind(j) in heritage:
                    mode = self.kind(j)
                elif self.kind(j) == "<":
                    angle += 1
                elif self.kind(j) == ">":
                    angle -= 1
                elif self.kind(j) in ("(", "["):
                    j = self.end_of(j)
                    continue
                elif mode and not angle and self.kind(j) in NAMES and self.kind(j - 1) != ".":
                    heritage[mode].append(self.word(j))
                j += 1
            if self.kind(i + 1) in NAMES:
                self.symbol(i + 1, KINDS[k], exported, default, heritage["extends"], heritage["implements"])
                if "Error" in heritage["extends"]:
                    self.signals.add("error:custom-class")
            return j
        if k == "function":
            j = i + 1 + (self.kind(i + 1) == "*")
            if self.kind(j) in NAMES:
                self.symbol(j, "function", exported, default)
                j += 1
            return j
        if k == "type" and self.kind(i + 1) in NAMES:
            self.symbol(i + 1, "type", exported, default)
            return i + 2
        if k == "const" and self.kind(i + 1) == "enum":
            return self.declaration(i + 1, exported, default)
        if k in ("const", "let", "var"):
            depth, j, expect, angle = self.depth[i], i + 1, True, 0
            while self.kind(j) != "eof":
                kj = self.kind(j)
                if self.depth[j] == depth:
                    if expect:
                        if kj in NAMES:
                            self.symbol(j, self.value_kind(j + 1, "const" if k == "const" else "variable"), exported, default)
                        expect = False
                    elif kj == "<":
                        angle += 1
                    elif kj == ">" and angle:
                        angle -= 1
                    elif kj == ";":
                        break
                    elif kj == "," and not angle:
                        expect = True
                    elif kj in ("import", "export", "const", "let", "var", "function", "class") and j > i + 1 and self.kind(j - 1) not in ("=", "=>", "(", ",", "async", "new", "return", ":", "?"):
                        break
                j += 1
            return i + 1
        return i + 1

    def value_kind(self, i: int, otherwise: str) -> str:
        depth, j = self.depth[i] if i < len(self.depth) else 0, i
        while self.kind(j) not in ("=", ";", ",", "eof") or self.depth[j] > depth:
            j += 1
        if self.kind(j) != "=":
            return otherwise
        j += 1 + (self.kind(j + 1) == "async")
        if self.kind(j) in ("function", "class"):
            return self.kind(j)
        if self.kind(j) == "(" and self.kind(self.end_of(j)) in ("=>", ":"):
            return "function" if self.kind(self.end_of(j)) == "=>" or "=>" in self.k[self.end_of(j) : self.end_of(j) + 40] else otherwise
        return "function" if self.kind(j) in NAMES and self.kind(j + 1) == "=>" else otherwise

    def run(self) -> Reader:
        n = len(self.k) - 1
        i = 0
        while i < n:  # declarations and static imports
            k = self.k[i]
            if self.depth[i]:
                i += 1
            elif k == "import" and self.kind(i - 1 if i else n) != ".":
                i = max(self.import_(i), i + 1)
            elif k == "export":
                i = max(self.export(i), i + 1)
            elif k in ("class", "interface", "enum", "namespace", "module", "function", "type", "const", "let", "var", "declare", "abstract", "async") and (i == 0 or self.kind(i - 1) not in (".", "=", "(", ",", ":", "=>", "new", "return")):
                i = max(self.declaration(i, False, False), i + 1)
            else:
                i += 1
        for i in range(n):  # everything else, wherever it stands
            k, nxt = self.k[i], self.k[i + 1]
            if k == "import" and nxt == "(" and self.depth[i]:
                self.add_import(i, self.literal(i + 2), "dynamic")
            elif k == "require" and nxt == "(" and (not i or self.k[i - 1] != "="or self.k[max(0, i - 3)] != "import"):
                self.add_import(i, self.literal(i + 2), "require")
            elif k == "new" and nxt in NAMES:
                self.calls.append({"name": self.word(i + 1), "line": self.line(i)})
            elif k == "@" and nxt in NAMES:
                name = self.word(i + 1)
                self.signals |= {"decorators:present", f"decorator:{name}"}
                if name in HTTP_DECORATORS:
                    self.signals.add("http:route")
                if name == "Controller":
                    self.signals.add("http:framework")
            if k not in NAMES or nxt not in ("(", "."):
                continue
            name = self.word(i)
            if nxt == "(":
                if name in CALL_SIGNALS:
                    self.signals.add(CALL_SIGNALS[name])
                if name[:1].isupper() and k == "id" and (not i or self.k[i - 1] not in ("new", ".", "function", "class")):
                    self.calls.append({"name": name, "line": self.line(i)})
            else:
                member = self.word(i + 2)
                if name == "process" and member == "env":
                    self.signals.add("env:access")
                if name in OWNER_SIGNALS:
                    self.signals.add(OWNER_SIGNALS[name])
                if member in ROUTE_METHODS and self.kind(i + 3) == "(" and ROUTE_OWNER.search(name) and (route := self.literal(i + 4)) and route.startswith("/"):
                    self.routes.append({"method": member.upper(), "path": route, "line": self.line(i)})
                    self.signals.add("http:route")
        self.imports.sort(key=lambda r: r["line"])
        return self


def read_script(text: str, jsx: bool) -> dict:
    """The facts as a dictionary; ``status`` is partial where tokens or brackets don't fit together."""
    tokens = lex(text, jsx)
    r = Reader(text, tokens).run()
    if jsx and "jx(" in tokens.kinds:
        r.signals.add("jsx:present")
    if r.esm:
        r.signals.add("module:esm")
    elif r.cjs:
        r.signals.add("module:commonjs")
    status = "partial" if tokens.bad >= 0 or r.open else "ok"
    return {"status": status, "imports": r.imports, "exports": r.exports, "symbols": r.symbols, "calls": r.calls, "routes": r.routes, "signals": sorted(r.signals), "metadata": {"module_format": "esm" if r.esm else "commonjs" if r.cjs else "unknown"}}
