"""Text expressions: lines, token estimates, names, escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines(text: Column) -> Column:
    """Lines of a text: one trailing line end is dropped, then split at \\r\\n, \\n or \\r. An empty text has none; other separators don't split."""
    body = F.regexp_replace(text, r"(\r\n|\n|\r)\z", "")
    return F.when(F.length(text) > 0, F.split(body, r"\r\n|\n|\r", -1)).otherwise(F.array().cast("array<string>"))


def line_slice(text: Column, start: Column, end: Column) -> Column:
    """Lines start .. end (from 1), joined; null unless 0 <= start - 1 < end <= number of lines."""
    own = lines(text)
    valid = (start >= 1) & (start - 1 < end) & (end <= F.size(own))
    return F.when(valid, F.array_join(F.slice(own, F.greatest(start, F.lit(1)), F.greatest(end - start + 1, F.lit(0))), "\n"))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def token_count(text: Column) -> Column:
    """Runs of characters other than white space; an unreadable (null) text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def content_hash(text: Column) -> Column:
    """Hash of a text's UTF-8, in hex."""
    return F.sha2(text.cast("binary"), 256)


def safe_branch(branch: Column) -> Column:
    """A branch name as a directory name of at most 50 characters from [A-Za-z0-9_.-]."""
    plain = F.regexp_replace(F.translate(branch, "/\\", "__"), r"[^a-zA-Z0-9_.-]", "")
    short = F.substring(plain, 1, 50)
    return F.when(F.coalesce(branch, F.lit("")) == "", "unnamed_branch").when(plain.rlike(r"^\.*$"), "invalid_branch_name_after_sanitize").otherwise(short)


def collection_name(path: Column, branch: Column, prefix: str = "sparkloom_") -> Column:
    """Name of an index: prefix, 16 digits of the path's hash, the branch with other characters than [A-Za-z0-9_-] as _."""
    return F.concat(F.lit(prefix), F.substring(content_hash(path), 1, 16), F.lit("_"), F.regexp_replace(branch, "[^a-zA-Z0-9_-]", "_"))


def diagram_label(label: Column) -> Column:
    """A label without brackets and quotes that a diagram would read as its own."""
    return F.replace(F.translate(label, "[]{}", "()()"), F.lit('"'), F.lit("#quot;"))


def diagram_id(path: Column, line: Column, name: Column) -> Column:
    """path_line_name with everything but letters and numbers as _."""
    joined = F.concat_ws("_", F.coalesce(path, F.lit("unknown")), F.coalesce(line.cast("string"), F.lit("0")), F.coalesce(name, F.lit("unknown")))
    return F.regexp_replace(joined, r"[^\p{L}\p{N}]", "_")


def anchor(path: Column) -> Column:
    """Markdown anchor of a path: letters and digits of its file name in lower case, after its last directory."""
    parts = F.split(path, "/")
    name = F.lower(F.regexp_replace(F.element_at(parts, -1), r"[^\p{L}\p{N}]", ""))
    folder = F.lower(F.regexp_replace(F.get(parts, F.size(parts) - 2), r"[^\p{L}\p{N}]", ""))
    return F.when(F.size(parts) > 1, F.concat_ws("-", folder, name)).otherwise(name)


def clean_message(text: Column) -> Column:
    """Three or more line ends become two; white space around goes."""
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def repository_slug(url: Column) -> Column:
    """owner/name of a GitHub remote; null if the URL is none."""
    found = F.regexp_extract(url, r"github\.com[:/]([^/]+/[^/]+?)(?:\.git)?/?$", 1)
    return F.when(found != "", found)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory(path: Column) -> Column:
    """Everything before the last slash; empty without one."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def extension(path: Column) -> Column:
    """Suffix of the file name with its dot; empty without one and for names that only begin with a dot."""
    return F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1)


def relative_path(path: Column, root: str) -> Column:
    """Path below root with single slashes; unchanged outside of it."""
    plain = F.regexp_replace(F.regexp_replace(path, r"/+", "/"), r"(^|/)\./", "$1")
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(plain, F.lit(base)), F.substring(plain, len(base) + 1, 2**31 - 1)).when(plain == base[:-1], ".").otherwise(plain)


#: Extensions of the languages that are parsed.
LANGUAGES = {"python": [".py", ".pyi"], "javascript": [".js", ".jsx", ".mjs", ".cjs"], "typescript": [".ts", ".tsx"]}


def language_of(path: Column) -> Column:
    """Language by extension (case counts), null if unknown."""
    found = None
    for name, suffixes in LANGUAGES.items():
        hit = extension(path).isin(suffixes)
        found = F.when(hit, name) if found is None else found.when(hit, name)
    return found


def file_info(path: Column) -> Column:
    """struct(extension without dot, directory, module): the module is the directory after src, or tests."""
    folder = directory(path)
    module = F.when(folder.rlike(r"(^|/)src/[^/]+"), F.regexp_extract(folder, r"(?:^|/)src/([^/]+)", 1)).when(folder.rlike(r"(^|/)tests(/|$)"), F.lit("tests"))
    return F.struct(F.regexp_replace(extension(path), r"^\.", "").alias("extension"), folder.alias("directory"), module.alias("module"))


def is_binary(content: Column) -> Column:
    """Of binary content: over 10 MiB, a NUL among the first 1024 characters, or no UTF-8."""
    text = F.make_valid_utf8(content.cast("string"))
    nul = F.instr(F.substring(text, 1, 1024), "\0") > 0
    return (F.length(content) > 10 * 1024 * 1024) | nul | ~F.is_valid_utf8(content.cast("string"))


def decoded(content: Column) -> Column:
    """Binary content as text, bad bytes as U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))
