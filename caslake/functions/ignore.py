r"""Ignore patterns: globs compiled on the driver to two Java regexes, matched as a column.

A pattern without an inner slash names a segment anywhere; a leading **/ is dropped first. Others are anchored at the
root and take what is below them along. ** is any text, * and ? stay within a segment. The regexes keep to Unix line
ends, so that a dot excludes nothing but a newline; ? is one character.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
DEFAULT_PATTERNS = [
    ".git", ".hg", ".svn", ".DS_Store", "Thumbs.db", ".idea", ".vscode", ".cursor", "node_modules", ".next", ".nuxt", ".turbo", "dist", "build", ".cache",
    "__pycache__", ".venv", "venv", ".pytest_cache", ".mypy_cache", "target", "_build", "deps", ".elixir_ls", ".Trash", ".npm", ".yarn", "*.log", "*.tmp", "*.swp",
]


def _glob(pattern: str) -> str:
    special = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "".join(special.get(t) or re.sub(r"([^\w\s/])", r"\\\1", t, flags=re.A) for t in re.findall(r"\*\*|\*|\?|[^*?]+", pattern))


@dataclass(frozen=True)
class Matcher:
    segment: str | None
    full: str | None

    @property
    def regexes(self) -> list[str]:
        return [x for x in (self.segment, self.full) if x]

    def column(self, path: Column) -> Column:
        """The relative path is ignored; null paths (outside of the root) aren't."""
        out = F.lit(False)
        for x in self.regexes:
            out = out | path.rlike(x)
        return F.coalesce(out, F.lit(False))

    def matches(self, path: str) -> bool:
        """The same on the driver, for scans that prune folders."""
        return any(re.search(x.replace("(?d)", "").replace(r"\z", r"\Z"), path) for x in self.regexes)


def compile_patterns(patterns: list[str]) -> Matcher:
    segments, fulls = [], []
    for raw in patterns:
        p = raw.strip()
        if not p or p.startswith("#"):
            continue
        anchored = p.startswith("/")
        p = p.removeprefix("/") if anchored else p.removeprefix("**/")
        p = p.rstrip("/")
        (fulls if anchored or "/" in p else segments).append(_glob(p))
    segment = rf"(?d)(?:\A|/)(?:{'|'.join(segments)})(?:/|\z)" if segments else None
    return Matcher(segment, rf"(?d)\A(?:{'|'.join(fulls)})(?:/.*)?\z" if fulls else None)


def ignored(path: Column, patterns: list[str]) -> Column:
    return compile_patterns(patterns).column(path)
