"""Errors that callers can tell apart."""


class CodestrataError(Exception):
    """Base of all errors of the library; ``hint`` says what to do."""

    def __init__(self, message: str, hint: str = ""):
        super().__init__(message)
        self.hint = hint


class ConfigError(CodestrataError):
    """A setting has the wrong type or an impossible value."""


class AnalysisError(CodestrataError):
    """A root is missing, or a target fits nothing."""


class StateError(CodestrataError):
    """Stored tables are missing or of another version."""


class SourceUnavailable(CodestrataError):
    """A source (such as a version history) can't be read here."""


class ReadOnlyError(CodestrataError):
    """Writing was asked of an engine that may only read."""
