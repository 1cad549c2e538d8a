"""Credentials embedded in source code and configuration, and texts with them redacted.

A text is taken as bytes. Configuration formats are read into key paths with byte offsets (``config_paths``), and of
each value the names on its path and its own shape decide. In code, comments and prose, and in what of a configuration
file can't be read, expressions find assignments on the lines that a multi-word automaton picks out. A finding needs a
name that asks for a credential and a value whose shape is one, or a value of a shape that speaks for itself (issued
tokens, logins in addresses, headers, private keys). Redactions are spliced into the original bytes; nothing else
changes.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread
from .config_paths import entries, format_of

MASK = "[REDACTED]"

# Last words of names that ask for a credential; those of the second list only with a value that
# looks drawn at random.
SURE = {
    "password", "passwd", "pwd", "pass", "pw", "passphrase", "passcode", "secret", "token", "apikey", "credential", "credentials", "bearer", "motdepasse", "passwort", "kennwort", "contrasena", "contraseña", "senha", "clave", "auth", "apitoken", "authtoken", "accesstoken",
    "secretkey", "privatekey", "signingkey", "masterkey", "accesskey", "encryptionkey", "clientsecret",
}
MAYBE = {"key", "keys", "authorization", "cookie", "session", "salt", "hmac", "jwt", "sig", "signature", "login", "dsn", "part", "seed", "pin"}
PAIRS = {("api", "key"), ("access", "key"), ("secret", "key"), ("private", "key"), ("signing", "key"), ("master", "key"), ("encryption", "key"), ("auth", "key"), ("de", "passe"), ("pass", "word"), ("pass", "phrase"), ("service", "key"), ("account", "key"), ("shared", "key")}
# Names of things about credentials, which are none.
ABOUT = {
    "field", "label", "name", "url", "uri", "ref", "policy", "count", "pattern", "regex", "hash", "sha", "id", "path", "file", "size", "limit", "public", "type", "expiry", "expires", "header", "placeholder", "input", "prefix", "suffix", "endpoint", "length", "version", "checksum", "digest", "integrity", "fingerprint", "hint", "help", "title", "message", "description", "index", "format", "env", "var", "rule", "rules", "min", "max", "reset", "test",
}
FAKE = re.compile(r"(?i)your[_-]|<|>|\*{3,}|x{4,}|\.{3}|redacted|change.?me|placeholder|example|replace.?me|fill.?me|dummy|todo|insert.?|sample.?(key|token|pass)|not.?a.?real|enter |set in|here$|^(none|null|undefined|true|false|nil|yes|no|test|password|passwd|secret|token|string|str|required|optional|unset|empty|default|hidden|masked|n/?a)$")
REFERENCE = re.compile(r"\$\{|\$\(|\{\{|^\$\w|^%\w+%$|^@\w+|^env[:.]|^vault:|^secret[s]?[:/.]|^arn:|process\.env|os\.environ|^ref\+|^op://|^ssm:|^!\w|^\w+://[^:@]*$|^\w+(?:[./]\w[\w-]*){2,}$")
ISSUED = re.compile(r"(?<![A-Za-z0-9_])(?:sk-[A-Za-z0-9_-]{16,}|AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{20,}|glpat-[\w-]{16,}|xox[abeprs]-[A-Za-z0-9-]{20,}|AIza[\w-]{28,}|eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{10,}|[a-z][a-z0-9]*_(?:live|prod|pk|sk|test)_[A-Za-z0-9]{20,}|npm_[A-Za-z0-9]{30,}|SG\.[\w-]{16,}\.[\w-]{16,})")
URL_LOGIN = re.compile(r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]*://([^\s:/@'\"`]*):([^\s/@'\"`]+)@[\w\[]")
URL_PARAM = re.compile(r"(?i)[?&](?:sig|signature|api[_-]?key|access[_-]?token|auth[_-]?token|token|key|secret|client[_-]?secret|password|passwd|auth)=([\w%.~+/=-]{12,})")
HEADER = re.compile(r"(?:Bearer|Token|Basic|Bot|ApiKey|Digest)\s+([A-Za-z0-9+/=._~-]{16,})")
CALL = re.compile(r"(?i)(?:login|authenticate|authorize|sign_?in|connect|auth|credentials?|setpassword|basicauth)\(\s*(?:(['\"`])(?:(?!\1).)*\1\s*,\s*)?(['\"`])((?:(?!\2).)+)\2\s*[,)]")
JOINED = re.compile(r"(['\"])([A-Za-z0-9+/=_.-]{6,})\1\s*\+\s*(['\"])([A-Za-z0-9+/=_.-]{6,})\3")
PROSE = re.compile(r"(?i)\b(?:pass(?:word|phrase|code|wd)?|pwd|\w*pw|secret|token|api.?key|key|credentials?|mot de passe|passwort|kennwort|contraseña|senha|clave)\b\s*(?:is|was|:|=|→|est|ist|es)\s*([`'\"]?)([^\s`'\"]{6,})")
SLASHED = re.compile(r"(?i)(?:login|creds?|credentials?|account|user(?:name)?)\s*[:=]\s*[\w.@-]+\s*/\s*(\S{8,})")
COMMAND = re.compile(r"\b(?:(mysql|mysqldump|mysqladmin|mariadb|mongo|mongosh|redis-cli|sshpass)|curl)\b")
OPTION = re.compile(r"(?=\s(?:-p ?|-a |--pass(?:word)?[= ])(['\"]?)([^\s'\"]{6,}))")
CURL_OPTION = re.compile(r"(?=\s(?:-u|--user)[ =]['\"]?[\w.@-]+:(['\"]?)([^\s'\"]{6,}))")
SEPARATOR = re.compile(r"[|;&]")
WEAK = re.compile(r"[a-z]{6,}(?:19|20)\d\d|[A-Z][a-z]+[^A-Za-z0-9]\d{2,}[^A-Za-z0-9][a-z]+")
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PEM_BODY = re.compile(r"[\s\"'`,+\\nr]*(?:(?:Proc-Type|DEK-Info|Version|Comment)[^\n]*[\s\"'`,+\\nr]*)*[A-Za-z0-9+/=]{16,}")
ASSIGN = re.compile(r"(?<![\w.$\xc2-\xf4\x80-\xbf-])(?P<k>[\"']?[A-Za-z_$\xc2-\xf4\x80-\xbf][\w.$\xc2-\xf4\x80-\xbf-]*[\"']?\]?)\s*(?P<op>\?\?=|\|\|=|=>|:=|=(?![=>~])|:(?![:/]))\s*")
LITERAL = re.compile(r"(?:[rbuf]|rb)?(\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\\n]|\\.)*`)")
TYPED = re.compile(r"[\w.]+(?:<[\w., |\[\]]*>)?(?:\[\])*(?:\s*\|\s*[\w.]+(?:\[\])*)*\s*=(?![=>])\s*")
FALLBACK = re.compile(r"(?:\|\||\?\?|\bor\b|,)\s*((?:\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\\n]|\\.)*`))")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z\xc2-\xf4\x80-\xbf]+|\d+")
BARE_FORMATS = {"env", "ini", "properties", "cfg", "conf", "sh", "bash", "yml", "yaml", "toml", "md", "txt", "example", "production", "local", "development", "staging", "envrc", "rc"}


# Words that let a line be looked at (lower case): the names, and of each expression above what one of its alternatives
# can't do without. JOINED has no such word, QUOTED_PLUS stands for it.
TRIGGERS = tuple(sorted(
    {w for w in SURE | MAYBE if w.isascii()}
    | {"contrase", "cred", "passe", "passw", "mot de passe"}
    | {"sk-", "akia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "aiza", "eyj", "_live_", "_prod_", "_pk_", "_sk_", "_test_", "npm_", "sg."}  # ISSUED
    | {"://", "sig=", "signature=", "key=", "token=", "secret=", "password=", "passwd=", "auth="}  # URL_LOGIN, URL_PARAM
    | {"bearer", "token", "basic", "bot", "apikey", "digest"}  # HEADER
    | {"login", "authenticate", "authorize", "signin", "sign_in", "connect", "auth", "credential", "setpassword"}  # CALL
    | {"account", "user"}  # SLASHED
    | {"mysql", "mariadb", "mongo", "redis-cli", "sshpass", "curl"}  # COMMAND
    | {"-----begin"}  # PEM
))
QUOTED_PLUS = re.compile(r"['\"][^\S\n]*\+[^\S\n]*['\"]")


@dataclass(frozen=True)
class Finding:
    line_no: int
    start: int  # byte offsets of the value
    end: int
    kind: str
    key_path: str


@lru_cache(1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in TRIGGERS:
        a.add_word(w, len(w))
    a.make_automaton()
    return a


@lru_cache(100_000)
def key_rank(name: str) -> int:
    """2: the name asks for a credential, 1: it may, 0: it doesn't."""
    name = name.strip("\"'[] ")
    try:
        name = name.encode("latin-1").decode()
    except (UnicodeDecodeError, UnicodeEncodeError):
        pass
    name = name.rpartition(".")[2] if not name.startswith(".") else name
    words = [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-ZÀ-Þ]?[a-zß-ÿ]+", name)]
    while words and words[-1] in {"value", "default", "raw", "current", "old", "new", "prod", "dev", "staging", "local", "plain", "text"}:
        words.pop()
    if not words or words[-1] in ABOUT:
        return 0
    if words[-1] in SURE or "".join(words[-2:]) in SURE or "".join(words[-3:]) in SURE or tuple(words[-2:]) in PAIRS:
        return 0 if len(words) > 1 and words[0] == "public" or "public" in words[-2:] else 2
    return 1 if words[-1] in MAYBE and "public" not in words else 0


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values())


def drawn(value: str) -> bool:
    """Whether a value looks drawn at random: no words, no dictionary path, many different characters."""
    if len(value) < 12 or " " in value:
        return False
    if re.fullmatch(r"[0-9a-fA-F]{32,}|[0-9a-f]{16,}", value):
        return len(set(value)) > 5 and not value.isdigit()
    if re.fullmatch(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", value):
        return False
    if not re.fullmatch(r"[A-Za-z0-9+/=_.~!@#$%^&*-]+", value):
        return False
    kinds = sum(bool(re.search(k, value)) for k in ("[a-z]", "[A-Z]", "[0-9]"))
    return kinds >= 2 and len(set(value)) >= 9 and entropy(value) > 3.1 and bool(re.search(r"[0-9]", value) or kinds == 2 and re.search(r"[a-z][A-Z][a-z]?[A-Z]|[A-Z]{2}[a-z][A-Z]", value))


def shaped(value: str, rank: int, quoted: bool, rank_of_environment: bool = False) -> bool:
    """Whether a value is a literal credential under a key of that rank."""
    if len(value) < 6 or FAKE.search(value) or REFERENCE.search(value) or len(set(value)) < 4:
        return False
    if ISSUED.match(value):
        return True
    if rank == 1:
        return drawn(value) or rank_of_environment and bool(WEAK.fullmatch(value))
    if " " in value or "\t" in value:
        return False
    if drawn(value):
        return True
    if value.isdigit():
        return quoted and len(value) >= 6
    if re.search(r"[(){}\[\];,]|=>|::", value) and not quoted:
        return False
    digit, letter, other = re.search(r"\d", value), re.search(r"[A-Za-z]", value), re.search(r"[^A-Za-z0-9_.\-/]", value)
    mixed = re.search(r"[a-z][A-Z]|[A-Z]{2}[a-z]", value) and len(value) >= 10 and entropy(value) > 3.2 and not re.search(r"[a-z]{4}", value)
    return bool(letter and (digit or other) or mixed) and not re.fullmatch(r"[\d.]+(?:ms|s|m|h|d|kb|mb)?", value)


def _commands(line: str) -> Iterator[re.Match]:
    """The option that holds a password of each command: the first before the next separator."""
    words = list(COMMAND.finditer(line))
    if not words:
        return
    stops = [m.start() for m in SEPARATOR.finditer(line)] + [len(line)]
    options = [(m, [m.start() for m in m]) for m in (list(OPTION.finditer(line)), list(CURL_OPTION.finditer(line)))]
    for w in words:
        of, places = options[w.group(1) is None]
        n = bisect_left(places, w.end())
        if n < len(of) and places[n] < stops[bisect_left(stops, w.end())]:
            yield of[n]


# Names that say nothing of their own, so that the name above them counts, and names of collections
# whose members may be credentials whatever they are called.
PLAIN = {"[]", "value", "default", "raw", "current", "old", "new", "prod", "production", "dev", "development", "staging", "local", "plain", "text", "data", "content", "literal", "primary", "secondary", "main"}
COLLECTIONS = {"secrets", "credentials", "tokens", "passwords", "passphrases", "apikeys"}
EMBEDDED = re.compile(r"(?<![\w.$-])([A-Za-z_][\w.-]*)\s*=\s*([^;&\s,'\"]+)")


def path_rank(path: tuple[str, ...]) -> int:
    """As ``key_rank``, of a whole key path: names that say nothing leave it to the one above, members of a collection
    of credentials may be some."""
    names = list(path)
    while len(names) > 1 and (names[-1].lower() in PLAIN or names[-1].isdigit()):
        names.pop()
    if not names or re.search(r"[/*@]", names[-1]):
        return 0
    rank = 2 if names[-1].lower() in COLLECTIONS and len(names) < len(path) else key_rank(names[-1])
    if not rank and len(names) > 1 and any(re.sub(r"[^a-z]", "", n.lower()) in COLLECTIONS for n in names[:-1]):
        words = re.findall(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+", names[-1])
        rank = 0 if not words or words[-1].lower() in ABOUT | {"user", "username", "owner", "email"} else 1
    return rank


def in_formats(data: bytes, kind: str) -> list[tuple[int, int, bool, tuple[str, ...]]]:
    """(first byte, end, quoted, key path) of each value of a configuration text."""
    text = data.decode("utf-8", "replace") if not data.isascii() else data.decode("ascii")
    found = list(entries(text, kind))
    if data.isascii():
        return [(a, b, q, p) for p, a, b, q in found]
    at, size, of = 0, 0, {}
    for place in sorted({x for _, a, b, _ in found for x in (a, b)}):
        size += len(text[at:place].encode())
        at = place
        of[place] = size
    return [(of[a], of[b], q, p) for p, a, b, q in found]


def _phrase(name: str, value: str, quoted: bool) -> bool:
    """Whether a value is a password of letters only, or of words, which only the names of passwords allow."""
    words = [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name)]
    if not words or not quoted or FAKE.search(value) or REFERENCE.search(value) or len(set(value)) < 6:
        return False
    if words[-1] == "passphrase":
        return len(value) >= 12 and bool(re.fullmatch(r"[\w'-]+(?: [\w'-]+)*", value))
    return words[-1] in ("password", "passwd", "pwd") and bool(re.fullmatch(r"[A-Za-z]{8,}", value))


def scan_formats(data: bytes, kind: str) -> list[tuple[int, int, str, str]]:
    """(first byte, end, kind of finding, key path), and with an empty kind the values that aren't credentials."""
    plain, out = data.decode("latin-1"), []
    for a, b, quoted, path in in_formats(data, kind):
        value, name = plain[a:b], ".".join(path)
        rank = path_rank(path)
        if rank and (shaped(value, rank, quoted, path[-1].isupper()) or rank == 2 and _phrase(path[-1], value, quoted)):
            out.append((a, b, "assigned", name))
            continue
        if "\n" in value:
            continue
        out.append((a, b, "", name))
        if "=" in value:
            for m in EMBEDDED.finditer(value):
                if (r := key_rank(m.group(1))) and shaped(m.group(2), r, False, m.group(1).isupper()):
                    out.append((a + m.start(2), a + m.end(2), "assigned", f"{name}.{m.group(1)}"))
    return out


def scan(data: bytes, path: str = "", patterns: tuple = ()) -> list[Finding]:
    """All credentials in the bytes of a text, in order; no two overlap. ``patterns``: compiled expressions of
    one's own; what they match is taken if its value has the shape of a credential."""
    plain = data.decode("latin-1")
    hits = [end for end, _ in _automaton().iter(data.lower().decode("latin-1"))]
    if "+" in plain and (joins := [m.start() for m in QUOTED_PLUS.finditer(plain)]):
        hits = sorted(hits + joins)
    kind = format_of(path)
    if not hits and not (kind and "\\" in plain):
        return []
    parsed = scan_formats(data, kind) if kind else []
    decided = sorted((a, b) for a, b, _, _ in parsed)
    lines = plain.split("\n")
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x) + 1)
    suffix = path.rpartition("/")[2].rpartition(".")[2].lower()
    bare_file = suffix in BARE_FORMATS or path.rpartition("/")[2].startswith(".env")
    found: list[tuple[int, int, str, str]] = [(a, b, k, p.encode().decode("latin-1")) for a, b, k, p in parsed if k]
    numbers, last, until = [], -1, -1
    for h in hits:
        if h >= until:
            last = bisect_right(starts, h) - 1
            until = starts[last + 1]
            numbers.append(last)
    for n in numbers:
        line = lines[n]
        base = starts[n]
        add = lambda a, b, kind, key="", base=base: found.append((base + a, base + b, kind, key))
        if "-----BEGIN" in line:
            for m in PEM.finditer(line):
                at = base + m.start()
                body = PEM_BODY.match(plain, base + m.end())
                if body:
                    end = PEM_END.search(plain, base + m.end())
                    stop = end.start() if end else body.end()
                    found.append((at, stop, "private-key", ""))
        for m in ISSUED.finditer(line):
            if not FAKE.search(m.group()):
                add(m.start(), m.end(), "issued-token")
        if "@" in line:
            for m in URL_LOGIN.finditer(line):
                p = m.group(2)
                if not FAKE.search(p) and not REFERENCE.search(p) and len(set(p)) > 2 and "{" not in p and not p.startswith("$") and not p.startswith("%"):
                    add(m.start(2), m.end(2), "address-login")
        if "=" in line:
            for m in URL_PARAM.finditer(line):
                if drawn(m.group(1)) and not FAKE.search(m.group(1)):
                    add(m.start(1), m.end(1), "address-parameter")
        for m in HEADER.finditer(line):
            if drawn(m.group(1)) and not FAKE.search(m.group(1)) and not REFERENCE.search(m.group(1)):
                add(m.start(1), m.end(1), "header")
        if "(" in line:
            for m in CALL.finditer(line):
                if shaped(m.group(3), 2, True):
                    add(m.start(3), m.end(3), "call")
        if "+" in line:
            for m in JOINED.finditer(line):
                whole = m.group(2) + m.group(4)
                if (ISSUED.fullmatch(whole) or drawn(whole)) and not re.search(r"(?i)sha|digest|integrity|checksum|icon|image|font", line[: m.start()]):
                    add(m.start(2), m.end(4), "joined")
        for m in PROSE.finditer(line):
            v = m.group(2).rstrip(".,;)")
            if (m.group(1) and shaped(v, 2, True)) or drawn(v) and not FAKE.search(v) and not REFERENCE.search(v) and not re.search(r"[(){}\[\]]", v):
                add(m.start(2), m.start(2) + len(v), "prose")
        for m in _commands(line):
            if shaped(m.group(2), 2, True) or drawn(m.group(2)) or re.fullmatch(r"(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9]{10,}", m.group(2)) and not REFERENCE.search(m.group(2)):
                add(m.start(2), m.end(2), "command")
        for m in SLASHED.finditer(line):
            if shaped(m.group(1), 2, False):
                add(m.start(1), m.end(1), "prose")
        comment_about = re.search(r"(?:#|//|/\*)\s*(?:checksum|sha|git commit|commit|request id|trace id|build|etag|digest)", line)
        for m in ASSIGN.finditer(line):
            rank = key_rank(m.group("k"))
            if not rank and not m.group("k").isidentifier():
                continue
            at = m.end()
            if decided and (d := bisect_right(decided, (base + at + 1, len(plain)))) and decided[d - 1][1] >= base + at:
                continue  # a value that was read with its path
            lit = LITERAL.match(line, at)
            if not lit and rank and m.group("op") == ":" and (typed := TYPED.match(line, at)):  # name: type = value
                lit = LITERAL.match(line, typed.end())
            if lit:
                if rank and not (comment_about and rank == 1):
                    v = lit.group(1)[1:-1]
                    if shaped(v, rank, True, m.group("k").rpartition(".")[2].strip("\"'").isupper()):
                        add(lit.start(1) + 1, lit.end(1) - 1, "assigned", m.group("k").strip("\"'"))
                continue
            rest = line[at:]
            if re.match(r"(?:Buffer\.from|atob|b64decode|base64\.b64decode|bytes|SecretStr|new TextEncoder\(\)\.encode)\(", rest):
                if (lit := LITERAL.search(line, at)) and (rank or re.search(r"(?i)(?:signing|secret|private|api|encryption|auth)[ _-]?key|secret|password|credential", rest)):
                    v = lit.group(1)[1:-1]
                    if drawn(v):
                        add(lit.start(1) + 1, lit.end(1) - 1, "assigned", m.group("k"))
                continue
            named = rank or max((key_rank(x) for x in re.findall(r"[A-Za-z_]\w*(?:\.\w+)*", rest.split("||")[0].split("??")[0].split(",")[0])), default=0) if re.search(r"env|config|settings|secrets|getenv", rest) else rank
            if named and re.search(r"\|\||\?\?|\bor\b|env", rest):
                for f in FALLBACK.finditer(rest):
                    v = f.group(1)[1:-1]
                    if shaped(v, named, True):
                        add(at + f.start(1) + 1, at + f.end(1) - 1, "fallback", m.group("k"))
                if re.match(r"process\.env|os\.|env\b|\$", rest):
                    continue
            if rank == 0:
                continue
            if rest.strip() in ("|", ">", "|-", ">-", "|+", ">+") and n + 1 < len(lines):
                v = lines[n + 1].strip()
                if shaped(v, rank, True):
                    s = starts[n + 1] + lines[n + 1].index(v)
                    found.append((s, s + len(v), "assigned", m.group("k").strip("\"'")))
                continue
            if bare_file or suffix == "" or rank == 2 and re.search(r"//|#|/?\*", line[: m.start()]) or re.match(r"\s*(?:export\s+|ENV\s+|-\s+)?$", line[: m.start()]) and m.group("op") == "=" and m.group("k").isupper():
                v = re.split(r"\s+#|\s*[;,]\s*$|\s", rest.strip(), maxsplit=1)[0] if rest.strip() else ""
                if v and v[0] not in "\"'`" and shaped(v, rank, False):
                    s = at + rest.index(v)
                    add(s, s + len(v), "assigned", m.group("k").strip("\"'"))
        for p in patterns:
            for m in p.finditer(line):
                quoted = re.search(r"[=:]\s*['\"]([^'\"]+)['\"]$", m.group())
                if quoted and max((key_rank(x) for x in re.findall(r"[\w.-]+", line[: m.start() + quoted.start()] + m.group()[: quoted.start()])[-1:]), default=0) == 2 and shaped(quoted.group(1), 2, True):
                    add(m.start() + quoted.start(1), m.start() + quoted.end(1), "pattern")
    out: list[Finding] = []
    for a, b, kind, key in sorted(found, key=lambda f: (f[0], -f[1])):
        if out and a < out[-1].end:
            continue
        out.append(Finding(bisect_right(starts, a), a, b, kind, key))
    return out


def redacted(data: bytes, findings: list[Finding], mask: str = MASK) -> bytes:
    """The bytes with each value replaced; of a private key the BEGIN and END lines stay."""
    out, at = [], 0
    for f in findings:
        start = f.start
        if f.kind == "private-key":
            start = data.index(b"-----", f.start + 5) + 5
            gap = re.match(rb"(?:\\r|\\n|\s)*", data[start : f.end]).end()
            tail = re.search(rb"(?:\\r|\\n|\s|[\"'`,+])*$", data[start + gap : f.end]).start()
            out += [data[at : start + gap], mask.encode()]
            at = start + gap + tail
        else:
            out += [data[at:start], mask.encode()]
            at = f.end
    return b"".join([*out, data[at:]])


def compiled(rows: list) -> tuple:
    """The expressions of a pattern table (a fixed few rows); those Python can't read are left out."""
    out = []
    for r in rows:
        try:
            out.append(re.compile(r["regex"], re.I if "i" in (r["flags"] or "") else 0))
        except (re.error, TypeError):
            pass
    return tuple(out)


FOUND = T.StructType([T.StructField("line_no", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("key_path", T.StringType())])


def find(documents: DataFrame, patterns: tuple = (), key: str = "doc_id") -> DataFrame:
    """``key, line_no, start, end, kind, key_path`` of each credential; offsets are bytes of the UTF-8 text.

    Null and empty texts have none; a null path is taken as a file without a known format. Repeated rows are
    searched each; further columns are ignored. One narrow stage over whole texts; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = [], []
            for i, (p, t) in enumerate(zip(batch.column(1), batch.column(2))):
                if t.is_valid:
                    for f in scan(t.as_buffer().to_pybytes(), p.as_py() or "", patterns):
                        rows.append(f)
                        at.append(i)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array([f.line_no for f in rows], pa.int64()), pa.array([f.start for f in rows], pa.int64()), pa.array([f.end for f in rows], pa.int64()), pa.array([f.kind for f in rows], pa.string()), pa.array([f.key_path.encode("latin-1").decode("utf-8", "replace") for f in rows], pa.string())],
                names=[key, *FOUND.names],
            )

    rows = spread(documents.select(key, "path", "text"))
    return rows.mapInArrow(run, T.StructType([rows.schema[key], *FOUND.fields]))


def redact(documents: DataFrame, policies: DataFrame, patterns: tuple = (), key: str = "doc_id") -> DataFrame:
    """``key, text, credentials`` with the credentials replaced where the policy of the repository's owner (the
    part of ``repo`` before the slash) asks for it. An owner without a policy, and a null ``redact_secrets``,
    count as asking for it. Null texts stay null. Policies have one row per owner and are joined by AQE's choice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for p, t, wanted in zip(batch.column(1), batch.column(2), batch.column(3)):
                if not t.is_valid:
                    texts.append(None)
                    counts.append(0)
                    continue
                data = t.as_buffer().to_pybytes()
                found = scan(data, p.as_py() or "", patterns)
                counts.append(len(found))
                texts.append(redacted(data, found) if found and wanted.as_py() else data)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], names=[key, "text", "credentials"])

    owner = policies.groupBy("org").agg(F.min(F.coalesce("redact_secrets", F.lit(True))).alias("no")).select(F.col("org").alias("_org"), F.col("no").alias("_wanted"))
    rows = spread(documents.select(key, "path", "text", "repo")).withColumn("_org", F.substring_index("repo", "/", 1)).join(owner, "_org", "left")
    rows = rows.select(key, "path", "text", F.coalesce("_wanted", F.lit(True)).alias("_wanted"))
    return rows.mapInArrow(run, T.StructType([rows.schema[key], T.StructField("text", T.StringType()), T.StructField("credentials", T.LongType())]))
