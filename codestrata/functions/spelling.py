"""One spelling for paths and content hashes that arrive in several."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_path(path: Column) -> Column:
    """With ``/`` for every backslash and without any leading ``./``; null stays null."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./+)+", "")


def plain_hash(value: Column) -> Column:
    """Lower-case hex without an algorithm prefix or spaces; empty and null stay as they are."""
    return F.regexp_replace(F.lower(F.trim(value)), r"^sha-?256[:=]", "")
