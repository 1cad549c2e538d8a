"""Words of identifiers and texts as Column expressions; search analysis."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that queries leave out.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "how", "in", "into", "is", "it", "its", "of", "on", "or", "that", "the",
    "their", "then", "there", "these", "this", "to", "was", "were", "what", "when", "where", "which", "who", "why", "will", "with",
]

# Related words of a query word.
SYNONYMS = {
    "auth": ["authentication", "authorization", "login", "token"],
    "authentication": ["auth", "login", "token"],
    "authorization": ["auth", "permission", "policy", "acl"],
    "payment": ["payments", "billing", "charge", "invoice", "stripe", "checkout"],
    "payments": ["payment", "billing", "charge", "invoice", "stripe"],
    "billing": ["payment", "invoice", "subscription"],
    "user": ["users", "account", "profile", "identity"],
    "users": ["user", "account", "identity"],
    "db": ["database", "repository", "persistence", "sql", "query"],
    "database": ["db", "repository", "persistence", "sql", "migration"],
    "repository": ["db", "database", "persistence", "store"],
    "api": ["endpoint", "route", "controller", "http", "rest"],
    "endpoint": ["api", "route", "controller"],
    "route": ["api", "endpoint", "router", "controller"],
    "event": ["events", "bus", "publisher", "subscriber", "message", "domain-event"],
    "events": ["event", "bus", "messaging", "publisher"],
    "queue": ["job", "worker", "consumer", "producer", "broker"],
    "job": ["queue", "worker", "cron", "scheduler"],
    "worker": ["job", "queue", "background"],
    "cache": ["caching", "redis", "memo"],
    "config": ["configuration", "settings", "env", "environment"],
    "configuration": ["config", "settings", "env"],
    "error": ["errors", "exception", "failure"],
    "test": ["tests", "spec", "testing"],
    "tests": ["test", "spec", "suite"],
    "build": ["compile", "bundler", "toolchain"],
    "cli": ["command", "bin", "argument"],
    "log": ["logging", "logger", "telemetry"],
    "logging": ["log", "logger"],
    "security": ["auth", "secret", "credential", "permission"],
    "idempotent": ["idempotency", "retry", "duplicate"],
    "idempotency": ["idempotent", "retry", "duplicate"],
    "invariant": ["invariants", "constraint", "must", "never"],
    "invariant_s": ["invariants", "constraint"],
    "style": ["convention", "format", "lint"],
    "convention": ["conventions", "style", "rule", "pattern"],
    "architecture": ["structure", "layer", "module", "design"],
    "module": ["package", "component", "service"],
    "dependency": ["dependencies", "import", "requires"],
    "contract": ["interface", "port", "boundary"],
    "boundary": ["contract", "interface", "port"],
}
SYNONYM_WEIGHT = 0.45
#: White space of Unicode, written so that Java and RE2 read it alike.
SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"

# Endings that stemming takes off, in the order they are tried.
ENDINGS = ((r"ies$", "y"), (r"(ss|us|is)es$", "$1"), (r"([^s])s$", "$1"), (r"ing$", ""), (r"edly$", ""), (r"ed$", ""), (r"ally$", "al"))


def split_identifier(text: Column) -> Column:
    """Lower-case words: parted at a change of case, ``_ - .`` and white space; no other mark parts words."""
    spaced = F.regexp_replace(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(spaced, r"[_\-.]+", " ")), SPACE), lambda w: w != "")


def identifier_case(name: Column) -> Column:
    return (
        F.when(name.rlike(r"^[A-Z][A-Za-z0-9]*$") & name.rlike("[a-z]"), "PascalCase")
        .when(name.rlike(r"^[a-z][A-Za-z0-9]*$"), "camelCase")
        .when(name.rlike(r"^[a-z0-9]+(-[a-z0-9]+)+$"), "kebab-case")
        .when(name.rlike(r"^[a-z0-9]+(_[a-z0-9]+)+$"), "snake_case")
        .when(name.rlike(r"^[A-Z0-9]+(_[A-Z0-9]+)+$"), "SCREAMING_SNAKE_CASE")
        .when(name.isNotNull(), "other")
    )


def stem(word: Column) -> Column:
    """The first ending that fits and leaves three letters comes off; words of up to three stay."""
    out = word
    for pattern, by in reversed(ENDINGS):
        cut = F.regexp_replace(word, pattern, by)
        out = F.when(word.rlike(pattern) & (F.length(cut) >= 3), cut).otherwise(out)
    return F.when(F.length(word) <= 3, word).otherwise(out)


def analyze(text: Column, keep_stop_words: bool = False) -> Column:
    """Distinct words of two letters or more that aren't numbers, each with its stem."""
    words = F.filter(split_identifier(text), lambda w: (F.length(w) >= 2) & ~w.rlike(r"^\d+$"))
    if not keep_stop_words:
        words = F.filter(words, lambda w: ~w.isin(STOP_WORDS))
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.array(w, stem(w)))))


def path_words(path: Column) -> Column:
    """Words of all segments of a path, of two letters or more."""
    return F.filter(F.flatten(F.transform(F.split(path, "/"), split_identifier)), lambda w: F.length(w) > 1)


def query_weights(text: str) -> dict[str, float]:
    """The terms of a query with their weights: its own words 1, related ones less. (A query is one short text
    of the caller, so this runs on the driver, by the same rules as ``analyze``.)"""
    import re

    def cut(word: str) -> str:
        if len(word) > 3:
            for pattern, by in ENDINGS:
                if re.search(pattern, word) and len(c := re.sub(pattern, by.replace("$1", r"\1"), word)) >= 3:
                    return c
        return word

    def terms(s: str, stops: bool) -> list[str]:
        s = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", s))
        out = []
        for w in re.sub(r"[_\-.]+", " ", s).lower().split():
            if len(w) >= 2 and not w.isdigit() and (stops or w not in STOP_WORDS):
                out += [t for t in (w, cut(w)) if t not in out]
        return out

    weights: dict[str, float] = {}
    for t in terms(text, False):
        weights[t] = 1.0
        for related in SYNONYMS.get(t) or SYNONYMS.get(cut(t)) or []:
            for r in terms(related, True):
                weights[r] = max(weights.get(r, 0.0), SYNONYM_WEIGHT)
    return weights


def truncate(text: Column, most: int) -> Column:
    """White space in one line; longer texts end in an ellipsis."""
    one = F.trim(F.regexp_replace(text, SPACE, " "))
    return F.when(F.length(one) <= most, one).otherwise(F.concat(F.rtrim(F.substring(one, 1, max(0, most - 1))), F.lit("…")))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def plural(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {many or one + 's'}"))


def indent(text: Column, by: str) -> Column:
    return F.regexp_replace(text, r"(?m)^(?=.*\S)", by)


def confidence(x: Column) -> Column:
    return F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.0), x)), 2)


def day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 8)
