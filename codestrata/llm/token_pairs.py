"""Pairs of neighbouring tokens that a grammar permits, derived from its productions.

A production is written ``name: alternative | alternative``; words in quotes are tokens, ``x?`` may be left out,
``x*`` and ``x+`` repeat. A pair (a, b) is permitted if somewhere in a production a symbol that can end in a is
followed by one that can begin with b.
"""

from __future__ import annotations

# The grammar of JSON; 'name' is a string with the colon after it, ',n' a comma before one.
JSON = """
value: object | array | 'str' | 'num' | 'word'
object: '{' members? '}'
members: member next_member*
next_member: ',n' member
member: 'name' value
array: '[' values? ']'
values: value next_value*
next_value: ',' value
top: 'start' value 'eof'
"""

# YAML, with block structure as brackets.
YAML = """
top: 'start' ends? bare? explicit* 'eof'
ends: 'end'+
bare: node ends?
explicit: 'dir'* 'doc' node? ends? | ends node ends?
node: props? content | props | 'alias'
props: 'anchor' | 'tag' | 'anchor' 'tag' | 'tag' 'anchor'
content: 'scalar' | map | seq | flow_map | flow_seq
map: 'm(' pair+ 'm)'
pair: 'key' node? value? | value
value: 'val' node?
seq: 's(' entry+ 's)'
entry: 'item' node?
flow_seq: '[' flow_list? ']'
flow_map: '{' flow_list? '}'
flow_list: flow_entry next_entry* ','?
next_entry: ',' flow_entry
flow_entry: node | pair
"""

# Module scripts, generous (every token sequence of a module fits, some others do too). 'name' is any
# name or contextual word, 'op' a binary operator, 'as' as a separator of renamed parts, 'set' an assignment.
SCRIPT = """
top: 'start' item* 'eof'
item: statement
block: '{' item* '}'
end: ';'
statement: block | ';' | declaration | control | simple end?
simple: expression | 'var' bindings | 'const' bindings | 'return' expression? | 'throw' expression | 'break' 'name'? | 'continue' 'name'? | 'debugger' | import | export
bindings: declarator more_declarators*
more_declarators: ',' declarator
declarator: target '!'? typing? value?
value: '=' assigned
target: 'name' | '[' elements? ']' | '{' elements? '}'
elements: element next_element*
element: '...'? member
next_element: ',' element?
control: 'if' group statement otherwise? | 'for' 'name'? '(' heading ')' statement | 'while' group statement | 'do' statement 'while' group ';'? | 'try' block catch? finally? | 'switch' group '{' case* '}' | 'name' ':' statement
heading: 'var' bindings | 'const' bindings | expression | ';' | heading ';' | heading ';' expression | heading 'in' expression | heading 'name' expression
otherwise: 'else' statement
catch: 'catch' catch_name? block
catch_name: '(' target typing? ')'
finally: 'finally' block
case: 'case' expression ':' item* | 'default' ':' item*
declaration: decorator* modifiers function | decorator* modifiers class | modifiers 'enum' 'name' '{' elements? '}' | modifiers 'const' 'enum' 'name' '{' elements? '}' | modifiers 'name' 'name' generic? '=' type end? | modifiers 'name' 'name' generic? heritage* type_body | modifiers 'name' module_name module_body?
module_name: 'name' | 'str' | module_name '.' 'name'
module_body: block | ';'
modifiers: 'name'* | 'export' 'default'? 'name'*
function: 'function' '*'? 'name'? signature body
signature: generic? '(' parameters? ')' typing?
body: block | ';'?
parameters: parameter next_parameter*
next_parameter: ',' parameter?
parameter: decorator* 'name'* '...'? bound '?'? typing? value?
bound: target | 'this'
class: 'class' 'name'? generic? heritage* '{' class_member* '}'
heritage: 'extends' operand | 'name' type | heritage ',' type
class_member: ';' | decorator* 'name'* '*'? key mark? rest_of_member | 'name' block
mark: '?' | '!'
rest_of_member: signature body | typing? value? ';'?
key: anyword | 'str' | 'num' | 'priv' | '[' expression typing? ']' | '[' 'name' 'in' type ']'
anyword: 'name' | word
word: 'break' | 'case' | 'catch' | 'class' | 'const' | 'continue' | 'debugger' | 'default' | 'delete' | 'do' | 'else' | 'enum' | 'export' | 'extends' | 'false' | 'finally' | 'for' | 'function' | 'if' | 'import' | 'in' | 'instanceof' | 'new' | 'null' | 'return' | 'super' | 'switch' | 'this' | 'throw' | 'true' | 'try' | 'typeof' | 'var' | 'void' | 'while' | 'with'
decorator: '@' operand
import: 'import' 'name'? import_clause? | 'import' 'name'? 'name' '=' operand
import_clause: 'str' attributes? | import_what 'name' 'str' attributes?
import_what: 'name' | import_many | 'name' ',' import_many
import_many: '*' 'name' anyword | '{' specifiers? '}'
specifiers: specifier next_specifier*
next_specifier: ',' specifier?
specifier: anyword rename* | 'str' rename*
rename: anyword | 'str'
attributes: 'with' '{' elements? '}' | 'name' '{' elements? '}'
export: 'export' 'name'? import_many from? | 'export' '*' from | 'export' 'default' assigned | 'export' '=' expression | 'export' 'name' 'name' 'name' | 'export' import | 'export' simple
from: 'name' 'str' attributes?
group: '(' expression ')'
expression: assigned next_assigned*
next_assigned: ',' assigned
assigned: choice | operand assign assigned | arrow | 'name' '*'? assigned?
assign: '=' | 'set' | '>' '=' | '>' assign
arrow: 'name'? 'name' '=>' arrow_body | 'name'? signature '=>' arrow_body
arrow_body: block | assigned
choice: binary | binary '?' assigned ':' assigned
binary: unary next_unary*
next_unary: operator unary | 'name' type
operator: 'op' | '+' | '-' | '*' | '<' | '>' | '>' operator | '>' '=' | 'in' | 'instanceof' | '|' | '&'
unary: prefix* postfix
prefix: '!' | '~' | '+' | '-' | 'typeof' | 'void' | 'delete' | '++' | '--' | 'name' | '<' type '>'
postfix: operand step?
step: '++' | '--'
operand: primary | operand '.' anyword | operand '.' 'priv' | operand '?.' anyword | operand '?.' arguments | operand '?.' '[' expression ']' | operand '?.' 'priv' | operand '?.' types arguments | operand '[' expression ']' | operand arguments | operand types arguments? | operand template | operand '!'
arguments: '(' list? ')'
list: list_item next_item*
list_item: '...'? assigned
next_item: ',' list_item?
types: '<' type_list '>'
type_list: type next_type*
next_type: ',' type?
template: 'tpl' | 'th' filled 'tt'
filled: expression more_filled* | type
more_filled: 'tm' expression | 'tm' type
primary: 'name' | 'num' | 'str' | 're' | 'this' | 'super' | 'null' | 'true' | 'false' | 'priv' | template | '(' expression ')' | '[' holes? ']' | '{' object? '}' | 'name'? function_value | decorator* class | 'new' operand | 'new' '.' 'name' | 'import' arguments | 'import' '.' 'name' | jsx
holes: hole | holes hole
hole: list_item | ','
object: member | object ',' member?
function_value: 'function' '*'? 'name'? signature block
member: '...' assigned | 'name'* '*'? key after_key?
after_key: ':' assigned | ':' target value? | value | signature block
jsx: 'jx(' jsx_part* 'jx)'
jsx_part: 'jx{' inner? 'jx}' | jsx
inner: '...'? expression
typing: ':' type
type: type_union | type_union 'extends' type_union '?' type ':' type | 'name' 'name' type | 'name' 'this' 'name' type | 'this' 'name' type | function_type
function_type: 'name'? 'new'? generic? '(' parameters? ')' '=>' type
type_union: sign? type_part next_part*
next_part: sign type_part
sign: '|' | '&'
type_part: 'name'* type_primary brackets*
brackets: '[' type? ']'
type_primary: type_name types? | 'this' | 'null' | 'true' | 'false' | 'void' | 'str' | 'num' | '-' 'num' | template | type_body | '[' tuple? ']' | '(' type ')' | 'typeof' type_name types? | 'typeof' 'import' arguments | 'import' '(' type ')' | 'const' | function_type
type_name: 'name' | 'this' | type_name '.' anyword | type_name '.' 'priv' | 'import' '(' type ')' '.' anyword
tuple: tuple_item | tuple ',' tuple_item?
tuple_item: '...'? label? type '?'?
label: anyword '?'? ':'
type_body: '{' type_member* '}'
type_member: readonly* type_key after_type_key? separator?
readonly: 'name' | '+' | '-'
type_key: key sign_mark? | 'new'
sign_mark: '?' | '+' '?' | '-' '?'
after_type_key: typing | signature
separator: ';' | ','
generic: '<' generic_list '>'
generic_list: generic_item | generic_list ',' generic_item?
generic_item: variance* 'name' bound_type? default_type?
variance: 'const' | 'in' | 'name'
bound_type: 'extends' type
default_type: '=' type
call_member: signature separator?
type_member_call: '{' call_member | call_member '}' | type_member call_member | call_member type_member
"""


# Python, generous. 'nl' ends a logical line, 'in(' and 'in)' are indentation, 'soft' the words match,
# case and type, which are names as well, 'op' a binary operator, 'set' an assignment with an operator.
PYTHON = """
top: 'start' statement* 'eof'
statement: line | compound | 'nl'
line: simple next_simple* ';'? 'nl'
next_simple: ';' simple
simple: list | list annotation | list given | list annotation given | list 'set' right | 'return' list? | 'raise' expression? | 'raise' expression 'from' expression | 'pass' | 'break' | 'continue' | 'global' names | 'nonlocal' names | 'del' list | 'assert' list | 'soft' 'name' generic? given | 'soft' 'soft' generic? given | import
annotation: ':' expression
given: assigned+
assigned: '=' right
right: list
names: any next_name*
next_name: ',' any
any: 'name' | 'soft'
import: 'import' modules | 'from' origin 'import' what
modules: module next_module*
next_module: ',' module
module: dotted renamed?
renamed: 'as' any
dotted: any next_dotted*
next_dotted: '.' any
origin: dots | dots dotted | dotted
dots: dot+
dot: '.' | '...'
what: '*' | parts | '(' parts ','? ')'
parts: part next_part*
next_part: ',' part
part: any renamed?
compound: decorator* 'async'? 'def' any generic? '(' parameters? ')' result? suite | decorator* 'class' any generic? call? suite | 'if' condition suite | 'elif' condition suite | 'else' suite | 'while' condition suite | 'async'? 'for' list 'in' list suite | 'try' suite | 'except' caught? suite | 'finally' suite | 'async'? 'with' managers suite | 'soft' list ':' 'nl' 'in(' case+ 'in)'
case: 'soft' patterns guard? suite
guard: 'if' condition
patterns: list | list renamed
condition: expression
caught: '*'? list renamed?
managers: list | manager next_manager* | '(' manager next_manager* ','? ')'
manager: expression renamed?
next_manager: ',' manager
suite: ':' block
block: 'nl' 'in(' statement+ 'in)' | line
decorator: '@' expression 'nl'
result: '->' expression
generic: '[' variables ','? ']'
variables: variable next_variable*
next_variable: ',' variable
variable: star? any annotation? default?
default: '=' expression
parameters: parameter next_parameter* ','?
next_parameter: ',' parameter
parameter: star? any parameter_type? default? | '/' | '*'
parameter_type: ':' star? expression
star: '*' | '**'
list: item next_item* ','?
next_item: ',' item
item: star? expression | 'yield' list? | 'yield' 'from' expression
expression: choice | 'lambda' bare_parameters? ':' expression | any ':=' expression | pattern_as
pattern_as: choice 'as' any
bare_parameters: bare_parameter next_bare* ','?
next_bare: ',' bare_parameter
bare_parameter: star? any default? | '/' | '*'
choice: binary | binary 'if' binary 'else' expression
binary: unary next_unary*
next_unary: operator unary
operator: 'op' | '*' | '**' | '/' | '@' | '-' | '+' | 'in' | 'not' 'in' | 'is' | 'is' 'not' | 'and' | 'or'
unary: prefix* primary
prefix: 'not' | '-' | '+' | '~' | 'await'
primary: atom | primary '.' any | primary call | primary '[' subscripts ']'
call: '(' arguments? ')'
arguments: argument next_argument* ','?
next_argument: ',' argument
argument: item | any '=' expression | expression comprehension
comprehension: comprehension_for comprehension_part*
comprehension_for: 'async'? 'for' list 'in' binary
comprehension_part: comprehension_for | 'if' binary
subscripts: subscript next_subscript* ','?
next_subscript: ',' subscript
subscript: item | slice
slice: expression? ':' expression? step?
step: ':' expression?
atom: any | 'num' | strings | '...' | 'none' | '(' ')' | '(' list ')' | '(' expression comprehension ')' | '[' ']' | '[' list ']' | '[' expression comprehension ']' | '{' '}' | '{' entries '}' | '{' list '}' | '{' expression comprehension '}' | '{' pair comprehension '}'
entries: entry next_entry* ','?
next_entry: ',' entry
entry: pair | '**' binary
pair: expression ':' expression
strings: string+
string: 'str' | 'f(' filled* 'f)'
filled: 'fm' | '{' list '='? conversion? format? '}'
conversion: '!' any
format: ':' filled*
"""


def _rules(grammar: str) -> dict[str, list[list[tuple[str, bool, bool]]]]:
    """Alternatives of each rule: (symbol, may be left out, may repeat)."""
    rules: dict[str, list[list[tuple[str, bool, bool]]]] = {}
    for line in grammar.strip().splitlines():
        name, _, body = line.partition(": ")
        for alternative in body.split(" | "):
            symbols = []
            for s in alternative.split():
                mark = s[-1] if s[-1] in "?*+" and s.count("'") in (0, 2) else ""
                symbols.append((s[:-1] if mark else s, mark in ("?", "*") and bool(mark), mark in ("*", "+") and bool(mark)))
            rules.setdefault(name, []).append(symbols)
    return rules


def within(grammar: str, opening: dict[str, str]) -> set[tuple[str, str, str]]:
    """(bracket, a, b): the pairs that may stand directly inside a bracket of that kind; '' is outside all."""
    rules = _rules(grammar)
    empty: set[str] = set()
    first: dict[str, set[str]] = {n: set() for n in rules}
    last: dict[str, set[str]] = {n: set() for n in rules}
    inside: dict[str, set[str]] = {n: set() for n in rules}  # brackets that a rule's symbols may stand in
    inside["top"].add("")

    def ends(symbol: str, table: dict[str, set[str]]) -> set[str]:
        return {symbol.strip("'")} if symbol[0] == "'" else table[symbol]

    def skippable(s) -> bool:
        return s[1] or s[0] in empty

    def size() -> int:
        return len(empty) + sum(len(x) for t in (first, last, inside) for x in t.values())

    def around(symbols, outer: str) -> list[str]:
        """The bracket that is open after each symbol."""
        stack, out = [outer], []
        for s, *_ in symbols:
            token = s.strip("'") if s[0] == "'" else None
            if token in opening:
                stack.append(token)
            elif token in opening.values() and len(stack) > 1:
                stack.pop()
            out.append(stack[-1])
        return out

    before = -1
    while before != size():
        before = size()
        for name, alternatives in rules.items():
            for symbols in alternatives:
                for seq, table in ((symbols, first), (symbols[::-1], last)):
                    for s in seq:
                        table[name] |= ends(s[0], table)
                        if not skippable(s):
                            break
                    else:
                        empty.add(name)
                for outer in list(inside[name]):
                    for s, bracket in zip(symbols, around(symbols, outer)):
                        if s[0][0] != "'":
                            inside[s[0]].add(bracket)
    out: set[tuple[str, str, str]] = set()
    for name, alternatives in rules.items():
        for outer in inside[name]:
            for symbols in alternatives:
                places = around(symbols, outer)
                for i, s in enumerate(symbols):
                    if s[2]:
                        out |= {(places[i], a, b) for a in ends(s[0], last) for b in ends(s[0], first)}
                    for t in symbols[i + 1 :]:
                        out |= {(places[i], a, b) for a in ends(s[0], last) for b in ends(t[0], first)}
                        if not skippable(t):
                            break
    return out


def permitted(grammar: str) -> set[tuple[str, str]]:
    """All pairs (a, b) of tokens that may stand side by side."""
    return {(a, b) for _, a, b in within(grammar, {})}
