"""Ignore patterns: wildcard lines as in ignore files, translated to regular expressions, the last match wins."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is ignored by default.
DEFAULT_IGNORES = [
    "__pycache__/", "*.py[cod]", "*$py.class", ".git/", ".pytest_cache/", ".coverage", "htmlcov/", ".tox/", ".nox/", ".hypothesis/", ".mypy_cache/",
    ".ruff_cache/", "dist/", "build/", "*.so", "*.egg", "*.egg-info/", ".env/", "venv/", ".venv/", "env/", "ENV/", "node_modules/",
]
#: Regular expressions of paths that are not tracked.
DEFAULT_EXCLUDES = [
    r"^node_modules/", r"^\.venv/", r"^venv/", r"^env/", r"^__pycache__/", r"^\.mypy_cache/", r"^\.pytest_cache/", r"^\.ruff_cache/", r"^dist/", r"^build/",
    r"^\.git/", r"^typings/", r"\.pyc$", r"\.pyo$", r"\.so$", r"\.dll$", r"\.lib$", r"\.a$", r"\.o$", r"\.class$", r"\.jar$",
]


def combined(own: list[str], default: list[str]) -> list[str]:
    """own, then those defaults that are not in it."""
    return [*own, *(p for p in default if p not in own)]


def to_regex(line: str) -> tuple[str, bool] | None:
    """(regular expression over a relative path, negated) of an ignore line; None for blank lines and comments."""
    text = re.sub(r"(?<!\\)\s+$", "", line)
    if not text or text.startswith("#"):
        return None
    negated = text.startswith("!")
    text = text[1:] if negated else text
    only_dirs = text.endswith("/")
    text = text.rstrip("/")
    rooted = "/" in text
    out, i = "", 0
    text = text.lstrip("/")
    while i < len(text):
        c = text[i]
        if text.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif text.startswith("/**", i) and i + 3 == len(text):
            out, i = out + "/.*", i + 3
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := text.find("]", i + 2)) > 0:
            body = text[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        elif c == "\\" and i + 1 < len(text):
            out, i = out + re.escape(text[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return ("^" if rooted else "^(?:.*/)?") + out + ("/.*$|" + ("^" if rooted else "^(?:.*/)?") + out + "/$" if only_dirs else "(?:/.*)?$"), negated


def ignored(path: Column, lines: list[str]) -> Column:
    """Whether the last line that matches a relative path (directories with a trailing slash) ignores it."""
    verdict = F.lit(False)
    for found in filter(None, map(to_regex, lines)):
        verdict = F.when(path.rlike(found[0]), F.lit(not found[1])).otherwise(verdict)
    return verdict


def kept_paths(paths: DataFrame, lines: list[str], defaults: bool = True) -> DataFrame:
    """Rows of paths (path, is_dir, optional outside) that no line ignores; directories also go with an ignored ancestor, paths outside the root stay."""
    rules = combined(lines, DEFAULT_IGNORES) if defaults else lines
    outside = F.coalesce(F.col("outside"), F.lit(False)) if "outside" in paths.columns else F.lit(False)
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    under = F.when(F.size(parts) > 1, F.exists(ancestors, lambda p: ignored(p, rules))).otherwise(False)
    own = ignored(F.when(F.col("is_dir"), F.concat("path", F.lit("/"))).otherwise(F.col("path")), rules)
    return paths.filter(outside | (~own & ~(F.col("is_dir") & under)))


def tracked(files: DataFrame, own: list[str], path_col: str = "file_path") -> DataFrame:
    """Files that no exclusion pattern matches (searched): own ones and DEFAULT_EXCLUDES."""
    return files.filter(~F.col(path_col).rlike("|".join(f"(?:{p})" for p in combined(own, DEFAULT_EXCLUDES))))
