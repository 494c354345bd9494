"""Path rules of the indexing job, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories never indexed.
SKIP_DIRECTORIES = [
    "vendor", ".git", ".terraform", "node_modules", "target", "build", "dist",
    "out", "bin", "obj", ".venv", "venv", "__pycache__", ".pytest_cache",
    ".gradle", ".m2", ".idea", "coverage", ".cache",
]

# File extensions never indexed.
SKIP_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".pdf", ".webp", ".lock", ".zip", ".svg",
    ".exe", ".dll", ".xml", ".sum", ".mod", ".sql",
]

# Extension to language name.
LANGUAGES = {
    ".sh": "shell",
    ".py": "python",
    ".go": "go",
    ".md": "markdown",
    ".tf": "terraform",
    ".js": "javascript",
    ".ts": "typescript",
    ".java": "java",
    ".rb": "ruby",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".json": "json",
}

SKIP_PATTERN = "/(?:" + "|".join(re.escape(d) for d in SKIP_DIRECTORIES) + ")/"


def extension(path: Column) -> Column:
    """From the last dot of the last path element on, or ``''``."""
    return F.regexp_extract(path, r"\.[^./]*\z", 0)


def should_skip(path: Column) -> Column:
    """True for files the index leaves out; looks at the whole walked path."""
    lowered = F.lower(path)
    return lowered.rlike(SKIP_PATTERN) | extension(lowered).isin(SKIP_EXTENSIONS)


def guess_lang(path: Column) -> Column:
    """Language name from the extension; unknown extensions name themselves."""
    ext = F.lower(extension(path))
    named = F.lit(None).cast("string")
    for suffix, name in reversed(LANGUAGES.items()):
        named = F.when(ext == suffix, name).otherwise(named)
    return F.coalesce(named, F.substring(ext, 2, 2**31 - 1))


def _elements(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda e: (e != "") & (e != "."))


def rel_path(root: Column, path: Column) -> Column:
    """``path`` as seen from ``root``.

    A mix of one absolute and one relative path has no answer and keeps
    ``path``. Most paths lie below their root, where cutting the prefix is
    enough; only the others pay for the element-wise comparison.
    """
    prefix = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    base, target = _elements(root), _elements(path)
    same = F.zip_with(base, target, lambda a, b: F.coalesce(a == b, F.lit(False)))
    differs = F.array_position(same, False).cast("int")
    common = F.when(differs == 0, F.size(same)).otherwise(differs - 1)
    steps = F.concat(
        F.array_repeat(F.lit(".."), F.size(base) - common),
        F.slice(target, common + 1, F.size(target) - common),
    )
    walked = F.when(F.size(steps) == 0, ".").otherwise(F.array_join(steps, "/"))
    clean = ~path.rlike(r"//|(?:^|/)\.\.?(?:/|\z)|/\z")
    return (
        F.when(root.startswith("/") != path.startswith("/"), path)
        .when(path.startswith(prefix) & clean, F.substr(path, F.length(prefix) + 1))
        .otherwise(walked)
    )


def default_ref(root: Column) -> Column:
    """Ref of a local tree: the last element of its root."""
    return F.element_at(F.split(F.rtrim(root, F.lit("/")), "/"), -1)
