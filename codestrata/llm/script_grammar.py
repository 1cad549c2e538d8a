"""The grammar of TypeScript and JavaScript modules over token kinds.

``Module(tokens, typed, jsx).check()`` says whether the tokens are a module, or where they stop being one.
Statements and members are windows of tokens between line starts at one nesting depth; a window that was
once reduced to a whole production is known by its kinds from then on (``_known``) and costs one look-up.
"""

from __future__ import annotations

import sys

from ..sources.script_tokens import CONTEXTUAL, Tokens

NAMES = CONTEXTUAL | {"id"}
MODIFIERS = frozenset("public private protected readonly static abstract override declare async accessor".split())
ASSIGN = frozenset("= += -= *= /= %= **= <<= &= |= ^= &&= ||= ??=".split())
BINARY = frozenset("|| && ?? | ^ & == != === !== < <= instanceof in << + - * / % **".split())
PREFIX = frozenset("! ~ + - typeof void delete".split())
OPEN = {"(": ")", "[": "]", "{": "}", "th": "tt", "jx(": "jx)", "jx{": "jx}"}
CLOSE = frozenset(OPEN.values())
#: Kinds that can begin an expression.
STARTS = NAMES | PREFIX | frozenset("num str tpl th re priv ( [ { function class new this super null true false import ++ -- jx( < @ /".split())
TYPE_WORDS = frozenset("keyof unique readonly infer".split())
#: Longest window that is remembered, and how many are (a matter of memory only).
WINDOW, KEPT = 80, 300_000
_known: dict[tuple, int] = {}
#: Frames of the parser that a token can add, at most.
FRAMES = 40


class Bad(Exception):
    """Where the grammar is left, as the number of a token."""


def matches(kinds: list[str]) -> tuple[list[int], list[int], int]:
    """(partner of each bracket, nesting depth of each token, first token whose nesting is wrong or -1)."""
    partner, depth, stack = [0] * len(kinds), [0] * len(kinds), []
    for i, k in enumerate(kinds):
        if k in OPEN:
            depth[i] = len(stack)
            stack.append(i)
        elif k in CLOSE:
            if not stack or OPEN[kinds[stack[-1]]] != k:
                return partner, depth, i
            j = stack.pop()
            partner[i], partner[j] = j, i
            depth[i] = len(stack)
        else:
            depth[i] = len(stack)
    return partner, depth, stack[-1] if stack else -1


class Module:
    def __init__(self, tokens: Tokens, typed: bool):
        self.k, self.nl, self.near = tokens.kinds, tokens.lines, tokens.near
        self.typed = typed
        self.i = 0
        self.ambient = False
        self.cover = -1  # an initialiser of a shorthand member, good in a pattern only
        self.in_async, self.in_function, self.in_generator = True, False, False

    def check(self) -> int:
        """-1 for a module, else the number of the token at which it stops being one."""
        self.partner, self.depth, wrong = matches(self.k)
        if wrong >= 0:
            return wrong
        # next token at the same depth that begins a line and closes nothing
        n = len(self.k)
        self.next_line = [n - 1] * n
        last: dict[int, int] = {}
        for i in range(n - 1, -1, -1):
            d = self.depth[i]
            self.next_line[i] = last.get(d, -1)
            if self.k[i] in CLOSE:
                last[d + 1] = i
            elif self.nl[i]:
                last[d] = i
        try:
            return self.module()
        except RecursionError:  # once more, as deep as so many tokens can be nested; Python frames are on the heap
            limit = sys.getrecursionlimit()
            self.i, self.ambient, self.cover = 0, False, -1
            self.in_async, self.in_function, self.in_generator = True, False, False
            sys.setrecursionlimit(limit + FRAMES * n)
            try:
                return self.module()
            finally:
                sys.setrecursionlimit(limit)

    def module(self) -> int:
        try:
            while self.k[self.i] != "eof":
                self.statement(True)
            return -1
        except Bad as e:
            return e.args[0]
        except IndexError:
            return len(self.k) - 1

    # helpers
    def fail(self):
        raise Bad(self.i)

    def eat(self, kind: str) -> None:
        if self.k[self.i] != kind:
            raise Bad(self.i)
        self.i += 1

    def has(self, kind: str) -> bool:
        if self.k[self.i] == kind:
            self.i += 1
            return True
        return False

    def name(self) -> None:
        if self.k[self.i] not in NAMES:
            raise Bad(self.i)
        self.i += 1

    def semicolon(self) -> None:
        k = self.k[self.i]
        if k == ";":
            self.i += 1
        elif k != "}" and not self.nl[self.i]:
            raise Bad(self.i)

    def window(self, context: str):
        """The key of the window from here to the next line at this depth; None if it is too long or cut."""
        i = self.i
        j = self.next_line[i]
        if j < 0 or j - i > WINDOW:
            return None, j
        kinds = tuple(self.k[i : j + 1])
        return (context, self.typed, self.ambient, self.in_async, self.in_function, self.in_generator, kinds, tuple(self.nl[i + 1 : j + 1]), tuple(self.near[i + 1 : j + 1]) if ">" in kinds else ()), j

    def remembered(self, context: str, parse) -> None:
        key, j = self.window(context)
        if key is not None and key in _known:
            self.i = j
            return
        parse()
        if key is not None and self.i == j:
            if len(_known) > KEPT:
                _known.clear()
            _known[key] = 1

    def attempt(self, parse) -> bool:
        """Parse, or stay where it was."""
        at, cover = self.i, self.cover
        try:
            if parse() is False:
                raise Bad(at)
            return True
        except Bad:
            self.i, self.cover = at, cover
            return False

    # statements
    def block(self) -> None:
        self.eat("{")
        while self.k[self.i] != "}":
            self.statement(False)
        self.i += 1

    def statement(self, top: bool) -> None:
        self.remembered("module" if top else "block", lambda: self._statement(top))

    def _statement(self, top: bool) -> None:
        k, nxt = self.k[self.i], self.k[self.i + 1]
        method = _STATEMENTS.get(k)
        if method:
            return method(self)
        if k in ("import", "export"):
            if k == "import" and nxt in ("(", "."):
                return self.expression_statement()
            if not top:
                self.fail()
            return self.import_() if k == "import" else self.export()
        if k == "async" and nxt == "function" and not self.nl[self.i + 1]:
            self.i += 1
            return self.function(True, True)
        if k == "@":
            self.decorators()
            if self.k[self.i] == "export":
                return self.export()
            if self.typed and self.k[self.i] == "abstract":
                self.i += 1
            if self.k[self.i] != "class":
                self.fail()
            return self.class_(True)
        if k in ("let", "using") and (nxt in NAMES or (k == "let" and nxt in ("[", "{"))) and nxt != "of":
            self.i += 1
            return self.variables()
        if k == "await" and nxt == "using" and self.k[self.i + 2] in NAMES:
            self.i += 2
            return self.variables()
        if self.typed and k in _TYPED and self.declaration():
            return None
        if k in NAMES and nxt == ":":
            self.i += 2
            return self.statement(False)
        return self.expression_statement()

    def expression_statement(self) -> None:
        if self.k[self.i] in ("{", "function", "class"):
            self.fail()
        self.expression()
        self.semicolon()

    def empty(self) -> None:
        self.i += 1

    def variables(self, in_for: bool = False, constant: bool = False) -> None:
        """After the keyword."""
        while True:
            pattern = self.k[self.i] in ("[", "{")
            self.binding()
            if self.typed:
                if self.k[self.i] == "!":
                    self.i += 1
                if self.has(":"):
                    self.type()
            if self.has("="):
                self.assign(in_for)
            elif (pattern or constant) and not in_for and not self.ambient:
                self.fail()
            if not self.has(","):
                break
        if not in_for:
            self.settled()
            self.semicolon()

    def const(self) -> None:
        self.i += 1
        if self.typed and self.k[self.i] == "enum":
            return self.enum()
        return self.variables(constant=True)

    def var(self) -> None:
        self.i += 1
        self.variables()

    def function_statement(self) -> None:
        self.function(False, True)

    def function(self, is_async: bool, named: bool) -> None:
        """At ``function``; ``named``: a declaration, which has a name and in typed code may lack a body."""
        self.eat("function")
        star = self.has("*")
        if named or self.k[self.i] in NAMES:
            self.name()
        self.rest_of_function(is_async, star, named)

    def rest_of_function(self, is_async: bool, star: bool, bodiless: bool) -> None:
        """From the type parameters or parameters to the body."""
        if self.typed and self.k[self.i] == "<":
            self.type_parameters()
        was = self.in_async, self.in_function, self.in_generator
        self.in_async, self.in_function, self.in_generator = is_async, True, star
        self.parameters()
        if self.typed and self.has(":"):
            self.type()
        if self.k[self.i] == "{":
            self.block()
        elif self.typed and bodiless:
            self.semicolon()
        else:
            self.fail()
        self.in_async, self.in_function, self.in_generator = was

    def parameters(self) -> None:
        self.eat("(")
        while self.k[self.i] != ")":
            while self.k[self.i] == "@":
                self.decorators()
            if self.typed:
                while self.k[self.i] in MODIFIERS and self.k[self.i + 1] not in (",", ")", ":", "=", "?"):
                    self.i += 1
            rest = self.has("...")
            if self.typed and self.k[self.i] == "this":
                self.i += 1
            else:
                self.binding()
            if self.typed:
                self.has("?")
                if self.has(":"):
                    self.type()
            if not rest and self.has("="):
                self.assign()
                self.settled()
            if self.k[self.i] != ")":
                if rest:
                    self.fail()
                self.eat(",")
        self.i += 1

    def binding(self) -> None:
        k = self.k[self.i]
        if k in NAMES:
            self.i += 1
        elif k == "[":
            self.i += 1
            while self.k[self.i] != "]":
                if self.has(","):
                    continue
                rest = self.has("...")
                self.binding()
                if not rest and self.has("="):
                    self.assign()
                    self.settled()
                if self.k[self.i] != "]":
                    if rest:
                        self.fail()
                    self.eat(",")
            self.i += 1
        elif k == "{":
            self.i += 1
            while self.k[self.i] != "}":
                if self.has("..."):
                    self.name()
                    break
                plain = self.k[self.i] in NAMES
                self.property_name()
                if self.has(":"):
                    self.binding()
                elif not plain:
                    self.fail()
                if self.has("="):
                    self.assign()
                    self.settled()
                if self.k[self.i] != "}":
                    self.eat(",")
            self.eat("}")
        else:
            self.fail()

    def property_name(self) -> None:
        k = self.k[self.i]
        if k == "[":
            self.i += 1
            self.assign()
            self.eat("]")
        elif k in ("str", "num") or k.isidentifier() and k not in _CLASSES:
            self.i += 1
        else:
            self.fail()

    def condition(self) -> None:
        self.eat("(")
        self.expression()
        self.eat(")")

    def if_(self) -> None:
        self.i += 1
        self.condition()
        self.statement(False)
        if self.has("else"):
            self.statement(False)

    def for_(self) -> None:
        self.i += 1
        if self.k[self.i] == "await":
            if not self.in_async:
                self.fail()
            self.i += 1
        self.eat("(")
        k = self.k[self.i]
        if k == ";":
            pass
        elif k in ("var", "const") or k in ("let", "using") and (self.k[self.i + 1] in NAMES - {"of"} or self.k[self.i + 1] in ("[", "{")):
            self.i += 1
            self.variables(True)
        else:
            self.expression(True)
        if self.has("of"):
            self.cover = -1
            self.assign()
            self.settled()
        elif self.has("in"):
            self.cover = -1
            self.expression()
        else:
            self.settled()
            self.eat(";")
            if self.k[self.i] != ";":
                self.expression()
            self.eat(";")
            if self.k[self.i] != ")":
                self.expression()
        self.eat(")")
        self.statement(False)

    def while_(self) -> None:
        self.i += 1
        self.condition()
        self.statement(False)

    def do(self) -> None:
        self.i += 1
        self.statement(False)
        self.eat("while")
        self.condition()
        self.has(";")

    def return_(self) -> None:
        if not self.in_function:
            self.fail()
        self.i += 1
        if self.k[self.i] not in (";", "}", "eof") and not self.nl[self.i]:
            self.expression()
        self.semicolon()

    def jump(self) -> None:
        self.i += 1
        if self.k[self.i] in NAMES and not self.nl[self.i]:
            self.i += 1
        self.semicolon()

    def throw(self) -> None:
        self.i += 1
        if self.nl[self.i]:
            self.fail()
        self.expression()
        self.semicolon()

    def try_(self) -> None:
        self.i += 1
        self.block()
        caught = self.has("catch")
        if caught:
            if self.has("("):
                self.binding()
                if self.typed and self.has(":"):
                    self.type()
                self.eat(")")
            self.block()
        if self.has("finally"):
            self.block()
        elif not caught:
            self.fail()

    def switch(self) -> None:
        self.i += 1
        self.condition()
        self.eat("{")
        default = False
        while self.k[self.i] != "}":
            if self.has("case"):
                self.expression()
            else:
                self.eat("default")
                if default:
                    self.fail()
                default = True
            self.eat(":")
            while self.k[self.i] not in ("case", "default", "}"):
                self.statement(False)
        self.i += 1

    def debugger(self) -> None:
        self.i += 1
        self.semicolon()

    # modules
    def export_name(self) -> None:
        k = self.k[self.i]
        if k == "str" or k.isidentifier() and k not in _CLASSES:
            self.i += 1
        else:
            self.fail()

    def specifiers(self, imported: bool) -> None:
        self.eat("{")
        while self.k[self.i] != "}":
            if self.typed and self.k[self.i] == "type" and self.k[self.i + 1] not in (",", "}", "as"):
                self.i += 1
            elif self.typed and self.k[self.i] == "type" and self.k[self.i + 1] == "as" and self.k[self.i + 2] in ("as",):
                self.i += 1
            binds = self.k[self.i] in NAMES
            self.export_name()
            if self.has("as"):
                if imported:
                    self.name()
                else:
                    self.export_name()
            elif imported and not binds:
                self.fail()
            if self.k[self.i] != "}":
                self.eat(",")
        self.i += 1

    def attributes(self) -> None:
        if self.k[self.i] == "with" or self.k[self.i] == "assert" and not self.nl[self.i]:
            self.i += 1
            self.eat("{")
            while self.k[self.i] != "}":
                self.export_name()
                self.eat(":")
                self.eat("str")
                if self.k[self.i] != "}":
                    self.eat(",")
            self.i += 1

    def import_(self) -> None:
        self.i += 1
        if self.has("str"):
            self.attributes()
            return self.semicolon()
        if self.typed and self.k[self.i] == "type" and (self.k[self.i + 1] in ("{", "*") or self.k[self.i + 1] in NAMES and (self.k[self.i + 1] != "from" or self.k[self.i + 2] == "from")):
            self.i += 1
        if self.k[self.i] in NAMES:
            self.i += 1
            if self.typed and self.has("="):
                if self.k[self.i] == "require":
                    self.i += 1
                    self.eat("(")
                    self.eat("str")
                    self.eat(")")
                else:
                    self.entity()
                return self.semicolon()
            if self.k[self.i] != "from":
                self.eat(",")
                self.import_rest()
        else:
            self.import_rest()
        self.eat("from")
        self.eat("str")
        self.attributes()
        return self.semicolon()

    def import_rest(self) -> None:
        if self.has("*"):
            self.eat("as")
            self.name()
        else:
            self.specifiers(True)

    def export(self) -> None:
        self.i += 1
        k, nxt = self.k[self.i], self.k[self.i + 1]
        if k == "default":
            self.i += 1
            k, nxt = self.k[self.i], self.k[self.i + 1]
            if k == "function" or k == "async" and nxt == "function":
                if k == "async":
                    self.i += 1
                self.i += 1
                star = self.has("*")
                if self.k[self.i] in NAMES:
                    self.i += 1
                return self.rest_of_function(k == "async", star, True)
            if k == "@":
                self.decorators()
                k = self.k[self.i]
            if k == "class" or self.typed and k == "abstract" and nxt == "class":
                if k == "abstract":
                    self.i += 1
                return self.class_(False)
            if self.typed and k == "interface" and nxt in NAMES:
                return self.interface()
            self.assign()
            self.settled()
            return self.semicolon()
        if k == "*":
            self.i += 1
            if self.has("as"):
                self.export_name()
            self.eat("from")
            self.eat("str")
            self.attributes()
            return self.semicolon()
        if self.typed and k == "type" and nxt in ("{", "*"):
            self.i += 1
            k = self.k[self.i]
            if k == "*":
                self.i -= 0
                self.i += 1
                if self.has("as"):
                    self.export_name()
                self.eat("from")
                self.eat("str")
                return self.semicolon()
        if k == "{":
            self.specifiers(False)
            if self.has("from"):
                self.eat("str")
                self.attributes()
            return self.semicolon()
        if self.typed and k == "=":
            self.i += 1
            self.expression()
            return self.semicolon()
        if self.typed and k == "as" and nxt == "namespace":
            self.i += 2
            self.name()
            return self.semicolon()
        if self.typed and k == "import":
            return self.import_()
        if k in ("var", "const", "function", "class", "@") or k == "let" or k == "async" and nxt == "function":
            return self._statement(True)
        if self.typed and k in _TYPED and self.declaration():
            return None
        return self.fail()

    # classes
    def decorators(self) -> None:
        while self.has("@"):
            if self.k[self.i] == "(":
                self.condition()
            else:
                self.name()
                while self.has("."):
                    self.i += 1
                if self.k[self.i] == "<" and self.typed:
                    self.attempt(self.type_arguments)
                if self.k[self.i] == "(":
                    self.arguments()

    def class_statement(self) -> None:
        self.class_(True)

    def class_(self, named: bool) -> None:
        self.eat("class")
        if named or self.k[self.i] in NAMES and self.k[self.i] != "implements":
            self.name()
        if self.typed and self.k[self.i] == "<":
            self.type_parameters()
        if self.has("extends"):
            self.subscripts(self.primary(), True)
            if self.typed and self.k[self.i] == "<":
                self.type_arguments()
        if self.typed and self.has("implements"):
            self.type()
            while self.has(","):
                self.type()
        self.eat("{")
        was = self.in_async, self.in_function, self.in_generator
        self.in_async, self.in_function, self.in_generator = False, False, False
        while self.k[self.i] != "}":
            self.remembered("class", self.member)
        self.in_async, self.in_function, self.in_generator = was
        self.i += 1

    def member(self) -> None:
        if self.has(";"):
            return
        if self.k[self.i] == "@":
            self.decorators()
        is_async = star = False
        ends = ("(", "=", ";", "}", ":", "?", "!", "<", ",")
        if self.k[self.i] == "static" and self.k[self.i + 1] == "{":
            self.i += 1
            return self.block()
        while (self.k[self.i] in MODIFIERS if self.typed else self.k[self.i] in ("static", "async", "accessor")) and self.k[self.i + 1] not in ends and not (self.nl[self.i + 1] and self.k[self.i] in ("async", "accessor")):
            is_async |= self.k[self.i] == "async"
            self.i += 1
        if self.k[self.i] in ("get", "set") and self.k[self.i + 1] not in ends and not (self.nl[self.i + 1] and self.k[self.i + 1] != "["):
            self.i += 1
        star = self.has("*")
        if self.typed and self.k[self.i] == "[" and self.k[self.i + 1] in NAMES and self.k[self.i + 2] == ":":
            self.index_signature()
            return self.semicolon()
        if self.k[self.i] == "priv":
            self.i += 1
        else:
            self.property_name()
        if self.typed and not self.has("?"):
            if self.k[self.i] == "!":
                self.i += 1
        if self.k[self.i] in ("(", "<"):
            return self.rest_of_function(is_async, star, True)
        if star:
            self.fail()
        if self.typed and self.has(":"):
            self.type()
        if self.has("="):
            self.assign()
            self.settled()
        return self.semicolon()

    # typed declarations
    def declaration(self) -> bool:
        k, nxt, line = self.k[self.i], self.k[self.i + 1], self.nl[self.i + 1]
        if line:
            return False
        if k == "interface" and nxt in NAMES:
            self.interface()
        elif k == "type" and nxt in NAMES:
            self.i += 1
            self.name()
            if self.k[self.i] == "<":
                self.type_parameters()
            self.eat("=")
            self.type()
            self.semicolon()
        elif k == "enum":
            self.enum()
        elif k == "abstract" and nxt == "class":
            self.i += 1
            self.class_(True)
        elif k in ("namespace", "module") and (nxt in NAMES or nxt == "str"):
            self.i += 2
            while self.has("."):
                self.name()
            if self.k[self.i] == "{":
                self.scope()
            else:
                self.semicolon()
        elif k == "global" and nxt == "{":
            self.i += 1
            self.scope()
        elif k == "declare" and (nxt in NAMES or nxt in ("var", "const", "let", "function", "class", "enum")):
            self.i += 1
            was, self.ambient = self.ambient, True
            self._statement(True)
            self.ambient = was
        else:
            return False
        return True

    def scope(self) -> None:
        self.eat("{")
        while self.k[self.i] != "}":
            self._statement(True)
        self.i += 1

    def interface(self) -> None:
        self.i += 1
        self.name()
        if self.k[self.i] == "<":
            self.type_parameters()
        if self.has("extends"):
            self.type()
            while self.has(","):
                self.type()
        self.members()

    def enum(self) -> None:
        self.eat("enum")
        self.name()
        self.eat("{")
        while self.k[self.i] != "}":
            if self.k[self.i] == "[":
                self.fail()
            self.property_name()
            if self.has("="):
                self.assign()
            if self.k[self.i] != "}":
                self.eat(",")
        self.i += 1

    def members(self) -> None:
        """The braces of an interface or an object type."""
        self.eat("{")
        while self.k[self.i] != "}":
            self.remembered("type", self.type_member)
        self.i += 1

    def type_member(self) -> None:
        ends = ("(", ";", "}", ":", "?", "<", ",")
        k = self.k[self.i]
        if k == "new" and self.k[self.i + 1] in ("(", "<"):
            self.i += 1
            self.signature()
        elif k in ("(", "<"):
            self.signature()
        else:
            while self.k[self.i] in ("readonly", "+", "-") and self.k[self.i + 1] not in ends:
                self.i += 1
            if self.k[self.i] in ("get", "set") and self.k[self.i + 1] not in ends:
                self.i += 1
            if self.k[self.i] == "[" and self.k[self.i + 1] in NAMES and self.k[self.i + 2] == ":":
                self.index_signature()
            elif self.k[self.i] == "[" and self.k[self.i + 1] in NAMES and self.k[self.i + 2] == "in":
                self.i += 1
                self.name()
                self.eat("in")
                self.type()
                if self.has("as"):
                    self.type()
                self.eat("]")
                if self.k[self.i] in ("+", "-"):
                    self.i += 1
                self.has("?")
                if self.has(":"):
                    self.type()
            else:
                self.property_name()
                self.has("?")
                if self.k[self.i] in ("(", "<"):
                    self.signature()
                elif self.has(":"):
                    self.type()
        if not self.has(",") and not self.has(";") and self.k[self.i] != "}" and not self.nl[self.i]:
            self.fail()

    def signature(self) -> None:
        if self.k[self.i] == "<":
            self.type_parameters()
        self.parameters()
        if self.has(":"):
            self.type()

    def index_signature(self) -> None:
        self.eat("[")
        self.name()
        self.eat(":")
        self.type()
        self.eat("]")
        if self.has(":"):
            self.type()

    def type_parameters(self) -> None:
        self.eat("<")
        while self.k[self.i] != ">":
            while self.k[self.i] in ("const", "in", "out") and self.k[self.i + 1] in NAMES:
                self.i += 1
            self.name()
            if self.has("extends"):
                self.type()
            if self.has("="):
                self.type()
            if self.k[self.i] != ">":
                self.eat(",")
        self.i += 1

    def type_arguments(self) -> None:
        self.eat("<")
        self.type()
        while self.has(","):
            self.type()
        self.eat(">")

    def entity(self) -> None:
        self.name()
        while self.has("."):
            self.export_name()

    # types
    def type(self) -> None:
        k = self.k[self.i]
        if k == "asserts" and (self.k[self.i + 1] in NAMES or self.k[self.i + 1] == "this") and not self.nl[self.i + 1]:
            self.i += 2
            if self.has("is"):
                self.type()
            return
        if (k in NAMES or k == "this") and self.k[self.i + 1] == "is" and not self.nl[self.i + 1]:
            self.i += 2
            self.type()
            return
        if k == "<" or k == "new" or k == "abstract" and self.k[self.i + 1] == "new" or k == "(" and self.k[self.partner[self.i] + 1] == "=>":
            self.has("abstract")
            self.has("new")
            if self.k[self.i] == "<":
                self.type_parameters()
            self.parameters()
            self.eat("=>")
            self.type()
            return
        self.union()
        if self.k[self.i] == "extends" and not self.nl[self.i]:
            self.i += 1
            self.union()
            self.eat("?")
            self.type()
            self.eat(":")
            self.type()
        elif self.k[self.i] == "extends" and self.k[self.i - 1] != "}" and self._conditional():
            pass

    def _conditional(self) -> bool:
        def rest():
            self.eat("extends")
            self.union()
            self.eat("?")
            self.type()
            self.eat(":")
            self.type()

        return self.attempt(rest)

    def union(self) -> None:
        if self.k[self.i] in ("|", "&"):
            self.i += 1
        self.operand()
        while self.k[self.i] in ("|", "&"):
            self.i += 1
            self.operand()

    def operand(self) -> None:
        k = self.k[self.i]
        while k in TYPE_WORDS and (self.k[self.i + 1] in STARTS or self.k[self.i + 1] in ("typeof", "void")) and self.k[self.i + 1] != "<":
            self.i += 1
            k = self.k[self.i]
        if k in NAMES:
            self.i += 1
            while self.has("."):
                self.export_name()
            if self.k[self.i] == "<" and not self.nl[self.i]:
                self.type_arguments()
        elif k in ("this", "null", "true", "false", "void", "str", "num", "tpl", "const"):
            self.i += 1
        elif k == "-":
            self.i += 1
            self.eat("num")
        elif k == "th":
            self.i += 1
            self.type()
            while self.has("tm"):
                self.type()
            self.eat("tt")
        elif k == "{":
            self.members()
        elif k == "[":
            self.i += 1
            while self.k[self.i] != "]":
                self.has("...")
                if self.k[self.i].isidentifier() and self.k[self.i] not in _CLASSES - {"id"} and (self.k[self.i + 1] == ":" or self.k[self.i + 1] == "?" and self.k[self.i + 2] == ":"):
                    self.i += 1
                    self.has("?")
                    self.eat(":")
                self.type()
                self.has("?")
                if self.k[self.i] != "]":
                    self.eat(",")
            self.i += 1
        elif k == "(":
            if self.k[self.partner[self.i] + 1] == "=>":
                return self.type()
            self.i += 1
            self.type()
            self.eat(")")
        elif k in ("typeof", "import"):
            self.has("typeof")
            if self.has("import"):
                self.eat("(")
                self.type()
                if self.has(","):
                    self.assign()
                self.eat(")")
            elif self.k[self.i] == "this":
                self.i += 1
            else:
                self.name()
            while self.has("."):
                if not self.has("priv"):
                    self.export_name()
            if self.k[self.i] == "<" and not self.nl[self.i]:
                self.type_arguments()
        elif k == "new" or k == "<":
            return self.type()
        else:
            self.fail()
        while self.k[self.i] == "[" and not self.nl[self.i]:
            self.i += 1
            if self.k[self.i] != "]":
                self.type()
            self.eat("]")

    # expressions
    def settled(self) -> None:
        """No pattern-only initialiser may be left over."""
        if self.cover >= 0:
            raise Bad(self.cover)

    def expression(self, in_for: bool = False) -> None:
        self.assign(in_for)
        while self.has(","):
            self.assign(in_for)
        if not in_for:
            self.settled()

    def arrow_ahead(self) -> bool:
        """At ``(``: whether it is the parameters of an arrow function."""
        after = self.partner[self.i] + 1
        if self.k[after] == "=>":
            return not self.nl[after]
        return self.typed and self.k[after] == ":" and (self.k[self.i + 1] in (")", "{", "[", "...", "this") or self.k[self.i + 1] in NAMES)

    def arrow_rest(self, is_async: bool, in_for: bool) -> None:
        """After ``=>``."""
        was = self.in_async, self.in_function, self.in_generator
        if self.k[self.i] == "{":
            self.in_async, self.in_function, self.in_generator = is_async, True, False
            self.block()
        else:
            self.in_async = is_async
            self.assign(in_for)
        self.in_async, self.in_function, self.in_generator = was

    def typed_arrow(self, is_async: bool) -> None:
        was = self.in_async
        self.in_async = is_async
        try:
            if self.k[self.i] == "<":
                self.type_parameters()
            self.parameters()
            if self.typed and self.has(":"):
                self.type()
            if self.k[self.i] != "=>" or self.nl[self.i]:
                self.fail()
            self.i += 1
        finally:
            self.in_async = was

    def assign(self, in_for: bool = False) -> None:
        k, nxt = self.k[self.i], self.k[self.i + 1]
        if k == "yield" and self.in_generator:
            self.i += 1
            if self.has("*"):
                self.assign(in_for)
            elif not self.nl[self.i] and self.k[self.i] in STARTS:
                self.assign(in_for)
            return
        if k in NAMES and nxt == "=>":
            if self.nl[self.i + 1]:
                self.fail()
            self.i += 2
            return self.arrow_rest(False, in_for)
        is_async = k == "async" and not self.nl[self.i + 1] and (nxt in NAMES or nxt in ("(", "<"))
        if is_async and nxt in NAMES and self.k[self.i + 2] == "=>":
            self.i += 3
            return self.arrow_rest(True, in_for)
        at = self.i + is_async
        if self.k[at] == "(" or self.typed and self.k[at] == "<":
            here = self.i
            self.i = at
            if self.k[at] == "<" or self.arrow_ahead():
                if self.attempt(lambda: self.typed_arrow(is_async)):
                    return self.arrow_rest(is_async, in_for)
                if self.k[at] == "(" and self.k[self.partner[at] + 1] == "=>":
                    self.typed_arrow(is_async)  # fails where it went wrong
            self.i = here
        before, self.cover = self.cover, -1
        target = self.binary(in_for)
        k = self.k[self.i]
        if k in ASSIGN:
            if k == "=" and target == 2:
                self.cover = -1
            elif target != 1:
                self.fail()
            self.i += 1
            self.assign(in_for)
        elif k == ">" and self.shift_assign():
            if target != 1:
                self.fail()
            self.assign(in_for)
        elif k == "?":
            self.i += 1
            self.assign()
            self.eat(":")
            self.assign(in_for)
        if before >= 0:
            self.cover = before

    def shift_assign(self) -> bool:
        j = self.i + 1
        while self.k[j] == ">" and self.near[j] and j - self.i < 3:
            j += 1
        if j - self.i >= 2 and self.k[j] == "=" and self.near[j]:
            self.i = j + 1
            return True
        return False

    def operator(self, in_for: bool) -> bool:
        """Step over a binary operator."""
        k = self.k[self.i]
        if k in BINARY:
            if k == "in" and in_for:
                return False
            self.i += 1
            return True
        if k == ">":
            j = self.i + 1
            while self.k[j] == ">" and self.near[j] and j - self.i < 3:
                j += 1
            if self.k[j] == "=" and self.near[j]:
                if j - self.i > 1:
                    return False
                j += 1
            self.i = j
            return True
        return False

    def binary(self, in_for: bool) -> int:
        """1: a simple target of assignments, 2: a pattern, 0: neither."""
        target = self.unary()
        mixed = ""
        while True:
            k = self.k[self.i]
            if self.typed and k in ("as", "satisfies") and not self.nl[self.i]:
                self.i += 1
                self.type()
                target = 0
                continue
            if not self.operator(in_for):
                return target
            if k in ("??", "||", "&&"):
                if mixed and (mixed == "??") != (k == "??"):
                    self.fail()
                mixed = k
            target = 0
            self.unary()

    def unary(self) -> int:
        k = self.k[self.i]
        if k in PREFIX:
            self.i += 1
            self.unary()
            if self.k[self.i] == "**":
                self.fail()
            return 0
        if k in ("++", "--"):
            self.i += 1
            if self.unary() != 1:
                self.fail()
            return 0
        if k == "await":  # a reserved word in modules
            if not self.in_async:
                self.fail()
            self.i += 1
            self.unary()
            if self.k[self.i] == "**":
                self.fail()
            return 0
        if k == "<" and self.typed:
            self.i += 1
            self.type()
            self.eat(">")
            self.unary()
            return 0
        target = self.subscripts(self.primary(), False)
        if self.k[self.i] in ("++", "--") and not self.nl[self.i]:
            if target != 1:
                self.fail()
            self.i += 1
            return 0
        return target

    def arguments(self) -> None:
        self.eat("(")
        while self.k[self.i] != ")":
            self.has("...")
            self.assign()
            self.settled()
            if self.k[self.i] != ")":
                self.eat(",")
        self.i += 1

    def call_types(self) -> bool:
        self.type_arguments()
        k = self.k[self.i]
        return k in ("(", "tpl", "th", ")", "]", "}", ",", ";", ":", "?", ".", "?.", "eof", "=", "==", "===", "!=", "!==", "&&", "||", "??") or self.nl[self.i]

    def subscripts(self, target: int, heritage: bool) -> int:
        optional = False
        while True:
            k = self.k[self.i]
            if k == ".":
                self.i += 1
                if not self.has("priv"):
                    self.export_word()
                target = 0 if optional else 1
            elif k == "?.":
                self.i += 1
                optional = True
                if self.k[self.i] == "(":
                    self.arguments()
                elif self.has("["):
                    self.expression()
                    self.eat("]")
                elif self.typed and self.k[self.i] == "<":
                    self.type_arguments()
                    self.arguments()
                elif not self.has("priv"):
                    self.export_word()
                target = 0
            elif k == "[":
                self.i += 1
                self.expression()
                self.eat("]")
                target = 0 if optional else 1
            elif k == "(":
                self.arguments()
                target = 0
            elif k == "tpl" or k == "th":
                if optional:
                    self.fail()
                self.primary()
                target = 0
            elif self.typed and k == "!" and not self.nl[self.i]:
                self.i += 1
                target = max(target, 0)
            elif self.typed and k == "<" and not heritage:
                if not self.attempt(self.call_types):
                    return target
                target = 0
            else:
                return target

    def export_word(self) -> None:
        if not self.k[self.i].isidentifier() or self.k[self.i] in _CLASSES - {"id"}:
            self.fail()
        self.i += 1

    def primary(self) -> int:
        k = self.k[self.i]
        if k in NAMES:
            if k == "async" and self.k[self.i + 1] == "function" and not self.nl[self.i + 1]:
                self.i += 1
                self.function(True, False)
                return 0
            self.i += 1
            return 1
        if k in ("num", "str", "tpl", "re", "null", "true", "false", "this"):
            self.i += 1
            return 0
        if k == "(":
            self.i += 1
            self.assign()
            # parentheses around a name or member keep it assignable
            simple = self.k[self.i] == ")" and self.k[self.i - 1] in NAMES | {"]"}
            while self.has(","):
                self.assign()
                simple = False
            self.settled()
            self.eat(")")
            return 1 if simple else 0
        if k == "{":
            self.object()
            return 2
        if k == "[":
            self.i += 1
            while self.k[self.i] != "]":
                if self.has(","):
                    continue
                self.has("...")
                self.assign()
                if self.k[self.i] != "]":
                    self.eat(",")
            self.i += 1
            return 2
        if k == "th":
            self.i += 1
            self.expression()
            while self.has("tm"):
                self.expression()
            self.eat("tt")
            return 0
        if k == "function":
            self.function(False, False)
            return 0
        if k == "class":
            self.class_(False)
            return 0
        if k == "new":
            self.i += 1
            if self.has("."):
                self.export_word()
                return 0
            if self.k[self.i] == "import":
                self.fail()
            self.new_target()
            return 0
        if k == "super":
            self.i += 1
            if self.k[self.i] not in (".", "(", "["):
                self.fail()
            return 0
        if k == "import":
            self.i += 1
            if self.has("."):
                self.export_word()
                return 0
            if self.k[self.i] != "(":
                self.fail()
            self.arguments()
            return 0
        if k == "jx(":
            self.i += 1
            while not self.has("jx)"):
                if self.k[self.i] == "jx(":
                    self.primary()
                    continue
                self.eat("jx{")
                if self.k[self.i] != "jx}":
                    self.has("...")
                    self.expression()
                self.eat("jx}")
            return 0
        if k == "priv" and self.k[self.i + 1] == "in":
            self.i += 1
            return 0
        if k == "@":
            self.decorators()
            self.class_(False)
            return 0
        return self.fail()

    def new_target(self) -> None:
        if self.k[self.i] == "new":
            self.i += 1
            self.new_target()
        else:
            self.primary()
        while True:
            k = self.k[self.i]
            if k == ".":
                self.i += 1
                if not self.has("priv"):
                    self.export_word()
            elif k == "[":
                self.i += 1
                self.expression()
                self.eat("]")
            elif k in ("tpl", "th"):
                self.primary()
            elif self.typed and k == "!" and not self.nl[self.i]:
                self.i += 1
            else:
                break
        if self.typed and self.k[self.i] == "<":
            self.attempt(self.type_arguments)
        if self.k[self.i] == "(":
            self.arguments()

    def object(self) -> None:
        self.eat("{")
        while self.k[self.i] != "}":
            self.property()
            if self.k[self.i] != "}":
                self.eat(",")
        self.i += 1

    def property(self) -> None:
        if self.has("..."):
            return self.assign()
        ends = ("(", ",", ":", "}", "=", "<")
        is_async = star = accessor = False
        if self.k[self.i] == "async" and self.k[self.i + 1] not in ends and not self.nl[self.i + 1]:
            self.i += 1
            is_async = True
        if self.has("*"):
            star = True
        elif self.k[self.i] in ("get", "set") and self.k[self.i + 1] not in ends:
            self.i += 1
            accessor = True
        plain = self.k[self.i] in NAMES
        self.property_name()
        if self.k[self.i] in ("(", "<"):
            return self.rest_of_function(is_async, star, False)
        if is_async or star or accessor:
            return self.fail()
        if self.has(":"):
            return self.assign()
        if not plain:
            return self.fail()
        if self.k[self.i] == "=":
            self.cover = self.i
            self.i += 1
            inner = self.cover
            self.assign()
            self.cover = inner
        return None


_CLASSES = frozenset(("str", "num", "tpl", "th", "tm", "tt", "re", "priv", "eof"))
_TYPED = frozenset(("interface", "type", "enum", "abstract", "namespace", "module", "declare", "global"))
_STATEMENTS = {
    "{": Module.block, ";": Module.empty, "var": Module.var, "const": Module.const, "function": Module.function_statement, "class": Module.class_statement, "if": Module.if_, "for": Module.for_, "while": Module.while_,
    "do": Module.do, "return": Module.return_, "break": Module.jump, "continue": Module.jump, "throw": Module.throw, "try": Module.try_, "switch": Module.switch, "debugger": Module.debugger,
}
