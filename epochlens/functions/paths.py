"""Path keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    """Last component for either kind of slash."""
    return F.regexp_extract(path, r"([^/\\]+)$", 1)


def path_key(path: Column, match: str = "basename") -> Column:
    if match == "full":
        return F.lower(path)
    if match == "basename":
        return F.lower(basename(path))
    raise ValueError(f"unknown path match {match!r}")


def _slashes(path: Column) -> Column:
    rooted = F.concat(F.lit("/"), F.replace(path, F.lit("\\"), F.lit("/")))
    return F.regexp_replace(rooted, "/+", "/")


def nt_path(path: Column) -> Column:
    """Forward slashes, one leading slash, no doubled slashes."""
    return _slashes(path)


def nt_path_key(path: Column) -> Column:
    """Comparison form of an NT path: as :func:`nt_path`, without an alternate-stream suffix and in
    lower case; empty for blank input."""
    trimmed = F.trim(F.coalesce(path, F.lit("")))
    bare = F.substring_index(_slashes(trimmed), ":", 1)
    return F.when(trimmed == "", F.lit("")).otherwise(F.lower(bare))


def posix_norm(path: Column) -> Column:
    """Resolve ``.``, ``..`` and repeated slashes, then turn backslashes into slashes. Paths that
    have none of these, which is nearly all, skip the segment walk."""
    untidy = path.rlike(r"(^|/)\.{1,2}(/|$)|//|./$|^$")
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(untidy, _resolve(path)).otherwise(plain)


def _resolve(path: Column) -> Column:
    absolute = F.startswith(path, F.lit("/"))
    empty = F.array().cast("array<string>")
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    stack = F.aggregate(
        parts, empty,
        lambda acc, p: F.when(
            (p == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."),
            F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
        ).when((p == "..") & absolute & (F.size(acc) == 0), acc)
        .otherwise(F.concat(acc, F.array(p))),
    )
    joined = F.concat(F.when(absolute, "/").otherwise(""), F.array_join(stack, "/"))
    return F.replace(
        F.when(joined == "", F.lit(".")).otherwise(joined), F.lit("\\"), F.lit("/")
    )


def extension(path: Column) -> Column:
    """Lower-case extension without its dot; dot files have none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./\\]*)$", 1))
