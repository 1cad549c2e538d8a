"""Settings of a scan, checked before any plan is built, and policies that may only tighten them."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields, replace

from .errors import ConfigError
from .operators.activity import ARCHITECTURE
from .operators.files import EXCLUDE, INCLUDE, LARGEST

VERSION = 1


@dataclass(frozen=True)
class Config:
    include: tuple[str, ...] = tuple(INCLUDE)
    exclude: tuple[str, ...] = tuple(EXCLUDE)
    ignore: tuple[str, ...] = ()
    languages: tuple[str, ...] = ("typescript", "javascript")
    module_depth: int = 2
    largest: int = LARGEST
    follow_symlinks: bool = False
    conventions: bool = True
    decisions: bool = True
    git: bool = True
    window_days: int = 180
    most_commits: int = 5000
    recent_days: int = 30
    architecture_patterns: tuple[str, ...] = ARCHITECTURE
    allow_sensitive: bool = False
    redact_secrets: bool = True
    extra_sensitive: tuple[str, ...] = ()
    read_only: bool = False

    _RANGES = {"module_depth": (1, 10), "largest": (1, 1 << 31), "window_days": (0, 36500), "most_commits": (1, 10_000_000), "recent_days": (1, 36500)}

    def __post_init__(self):
        for f in fields(self):
            value, want = getattr(self, f.name), f.type
            if want.startswith("tuple"):
                if isinstance(value, str) or not all(isinstance(x, str) for x in value):
                    raise ConfigError(f"{f.name} must be a list of strings")
                object.__setattr__(self, f.name, tuple(value))
            elif want == "bool" and not isinstance(value, bool) or want == "int" and (isinstance(value, bool) or not isinstance(value, int)):
                raise ConfigError(f"{f.name} must be of type {want}")
            low, high = self._RANGES.get(f.name, (None, None))
            if low is not None and not low <= value <= high:
                raise ConfigError(f"{f.name} must lie between {low} and {high}")

    @classmethod
    def read(cls, text: str, **overrides) -> tuple[Config, list[str]]:
        """(settings, warnings) from a JSON text; unknown keys warn, wrong types raise."""
        try:
            raw = json.loads(text) if text.strip() else {}
        except ValueError as e:
            raise ConfigError(f"the configuration is not JSON: {e}") from e
        if not isinstance(raw, dict):
            raise ConfigError("the configuration must be an object")
        known = {f.name for f in fields(cls)}
        warnings = [f"unknown setting {k!r}" for k in raw if k not in known and k != "version"]
        return cls(**{k: v for k, v in {**raw, **overrides}.items() if k in known}), warnings

    def hash(self, tool_version: str) -> str:
        """Identity of settings and tool: facts made under another one are not reused."""
        return hashlib.sha256(json.dumps({**asdict(self), "_tool": tool_version}, sort_keys=True).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Policy:
    """What an owner asks for; applied to settings it can only make them stricter."""

    exclude: tuple[str, ...] = ()
    extra_sensitive: tuple[str, ...] = ()
    largest: int | None = None
    read_only: bool = False
    redact_secrets: bool = True
    forbid_sensitive: bool = True
    notes: dict = field(default_factory=dict)

    def apply(self, c: Config) -> Config:
        union = lambda a, b: tuple(dict.fromkeys((*a, *b)))
        return replace(
            c, exclude=union(c.exclude, self.exclude), extra_sensitive=union(c.extra_sensitive, self.extra_sensitive), largest=min(c.largest, self.largest or c.largest),
            read_only=c.read_only or self.read_only, redact_secrets=c.redact_secrets or self.redact_secrets, allow_sensitive=c.allow_sensitive and not self.forbid_sensitive)
