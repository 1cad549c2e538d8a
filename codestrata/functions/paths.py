"""Functions on repository paths as Column expressions (no UDF). Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DRIVE = r"^[A-Za-z]:[/\\]"


def to_posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def _parts(path: Column) -> Column:
    return F.filter(F.split(to_posix(path), "/"), lambda s: (s != "") & (s != "."))


def collapse(path: Column) -> Column:
    """``struct<segments, escaped>``: without ``.`` and empty segments, ``..`` taking one segment away; escaped
    if a ``..`` had none to take."""
    start = F.struct(F.array().cast("array<string>").alias("segments"), F.lit(False).alias("escaped"))

    def step(acc, s):
        up, n = s == "..", F.size(acc["segments"])
        left = F.when(up, F.slice(acc["segments"], 1, F.greatest(n - 1, F.lit(0)))).otherwise(F.concat(acc["segments"], F.array(s)))
        return F.struct(left.alias("segments"), (acc["escaped"] | (up & (n == 0))).alias("escaped"))

    return F.aggregate(_parts(path), start, step)


def normalize(path: Column) -> Column:
    return F.array_join(collapse(path)["segments"], "/")


def is_absolute(path: Column) -> Column:
    return to_posix(path).startswith("/") | path.rlike(_DRIVE)


def escapes_root(path: Column) -> Column:
    """Absolute, or climbing above the root somewhere on the way."""
    return is_absolute(path) | collapse(path)["escaped"]


def segments(path: Column) -> Column:
    return collapse(path)["segments"]


def depth(path: Column) -> Column:
    return F.size(segments(path))


def dirname(path: Column) -> Column:
    """Of a normalized path; '' at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extname(path: Column) -> Column:
    """From the last dot of the name; '' without one, and for names that begin with their only dot."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    name = basename(path)
    return F.when(extname(path) == "", name).otherwise(F.regexp_extract(name, r"^(.+)\.[^.]*$", 1))


def join(*parts: Column) -> Column:
    """One path of all parts that aren't null or empty, not yet collapsed."""
    return F.array_join(F.filter(F.array(*(to_posix(p) for p in parts)), lambda p: p.isNotNull() & (p != "")), "/")


def join_strict(*parts: Column) -> Column:
    """``struct<path, escaped, absolute>`` of the joined parts."""
    whole = collapse(join(*parts))
    absolute = F.exists(F.array(*parts), lambda p: F.coalesce(is_absolute(p), F.lit(False)))
    return F.struct(F.array_join(whole["segments"], "/").alias("path"), whole["escaped"].alias("escaped"), absolute.alias("absolute"))


def is_inside(parent: Column, child: Column) -> Column:
    """Both normalized. The empty parent holds everything."""
    return (parent == "") | (child == parent) | child.startswith(F.concat(parent, F.lit("/")))


def relative_to(parent: Column, child: Column) -> Column:
    """Null where the child lies outside."""
    rest = F.when(child == parent, "").otherwise(F.substr(child, F.length(parent) + 2))
    return F.when(parent == "", child).when(is_inside(parent, child), rest)


def ancestors(path: Column) -> Column:
    """Directories above a normalized path, shallowest first, without the root."""
    parts = F.split(path, "/")
    n = F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def common_prefix(first: Column, last: Column) -> Column:
    """Directories that two normalized paths share; of a group, of its least and its greatest path."""
    a, b = F.split(first, "/"), F.split(last, "/")
    n = F.least(F.size(a), F.size(b))
    same = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda k, i: F.when((k == i - 1) & (F.get(a, i - 1) == F.get(b, i - 1)), i).otherwise(k))
    return F.array_join(F.slice(a, 1, same), "/")


def module_id(path: Column, source_roots: tuple[str, ...] = ()) -> Column:
    """A directory without the longest of the source roots that it lies in."""
    out = path
    for root in sorted(filter(None, source_roots), key=len):
        out = F.when(path.startswith(root + "/"), F.substr(path, F.lit(len(root) + 2))).otherwise(out)
    return out
