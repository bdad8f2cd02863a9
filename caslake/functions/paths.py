"""Functions of paths, as columns. Paths are compared by bytes."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STORE_MARK = "/priv/data/store/"


def fold(c: Column) -> Column:
    """Lower case of ASCII letters only, as a case-insensitive LIKE has it."""
    return F.translate(c, UPPER, LOWER)


def trailing_slash(c: Column) -> Column:
    return F.when(c.endswith("/"), c).otherwise(F.concat(c, F.lit("/")))


def under(path: Column, root: str | Column, ignore_case: bool = False) -> Column:
    """The path is the root or below it. With a literal root, both conditions are pushed down to the files."""
    if isinstance(root, str):
        prefix = root if root.endswith("/") else root + "/"
        if not ignore_case:
            return (path == root) | path.startswith(prefix)
        return (path == root) | fold(path).startswith(prefix.translate(str.maketrans(UPPER, LOWER)))
    prefix = trailing_slash(root)
    return (path == root) | (fold(path).startswith(fold(prefix)) if ignore_case else path.startswith(prefix))


def inside_any(path: Column, prefixes: list[str]) -> Column:
    """The path is one of the prefixes or inside of one; null paths aren't."""
    out = F.lit(False)
    for p in prefixes:
        out = out | (path == p) | path.startswith(p + "/")
    return F.coalesce(out, F.lit(False))


def admission(path: Column, prefixes: list[str]) -> Column:
    """'internal_path' for what lies in the engine's own folders, 'contains_internal_path' for what holds one, else 'ok'."""
    holds = F.lit(False)
    for p in prefixes:
        holds = holds | F.lit(p).startswith(trailing_slash(path))
    return F.when(inside_any(path, prefixes), "internal_path").when(holds, "contains_internal_path").otherwise("ok")


def in_store(path: Column) -> Column:
    return path.contains(STORE_MARK)


def real_prefixes(folder: str) -> list[str]:
    """A folder as it is given and as it is without links."""
    given = os.path.abspath(os.path.expanduser(folder))
    return list(dict.fromkeys([given, os.path.realpath(given)]))


def like_escaped(c: Column) -> Column:
    r"""The text with \, _ and % escaped, for a LIKE with the escape character \."""
    for x in ("\\", "_", "%"):
        c = F.replace(c, F.lit(x), F.lit("\\" + x))
    return c


def matches_term(path: Column, term: str) -> Column:
    """path LIKE '%term%' by ASCII letters of either case; _ and % in the term are wildcards, a backslash is plain."""
    folded = term.translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\")
    return fold(path).like(f"%{folded}%")


def relative_to(path: Column, root: Column | str) -> Column:
    """The path below the root, '' for the root itself, null if it isn't under the root."""
    root = F.lit(root) if isinstance(root, str) else root
    prefix = trailing_slash(root)
    return F.when(path == root, F.lit("")).when(path.startswith(prefix), F.substring(path, F.length(prefix) + 1, F.length(path)))


def shown_below(path: Column, root: Column) -> Column:
    """For display: below the root without it, the root as its last segment, others unchanged."""
    prefix = trailing_slash(root)
    return F.when(path == root, last_segment(root)).when(path.startswith(prefix), F.substring(path, F.length(prefix) + 1, F.length(path))).otherwise(path)


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)


def normalized(path: Column) -> Column:
    """Without /private before /tmp and /var, at the boundaries of folders."""
    return F.regexp_replace(path, r"\A/private(?=/(tmp|var)(/|\z))", "")


def ancestors(path: Column) -> Column:
    """The path and all folders above it, the root folder included, longest first."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.array_distinct(F.transform(above, lambda p: F.when(p == "", F.lit("/")).otherwise(p)))
