"""Commit messages: parse, lint, format, summarise for pull requests; branch names."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Allowed types, and limits of the effective rule set.
TYPES = ["feat", "fix", "docs", "style", "refactor", "perf", "test", "build", "ci", "chore"]
HEADER_MAX, LINE_MAX = 72, 100
#: The header of a message, a footer line, and lines that look like footers.
HEADER = r"(?dsmi)\A([a-zA-Z]+)(\(([a-zA-Z0-9\-_]*(?:/[a-zA-Z0-9\-_]*)?)\))?(!)?: (.+?)(?:\r?\n\r?\n(.*))?$"
FOOTER = r"^((?:BREAKING[ -]CHANGE)|(?:[A-Z][A-Z0-9\-]+))(: | #)(.*)"
FOOTER_LIKE = r"^([A-Za-z][A-Za-z0-9\-]+|(?i:breaking[ -]change))(: | #)"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def _found(c: Column) -> Column:
    return F.when(c != "", c)


def parsed(message: Column) -> Column:
    """struct(ok, type, scope, breaking, description, rest): scope is null without parentheses, rest is what follows the header's blank line."""
    m = strip(message)
    part = lambda i: F.regexp_extract(m, HEADER, i)
    ok = m.rlike(HEADER)
    return F.struct(
        ok.alias("ok"),
        _found(part(1)).alias("type"),
        F.when(part(2) != "", part(3)).alias("scope"),
        (part(4) == "!").alias("breaking"),
        _found(strip(part(5))).alias("description"),
        _found(part(6)).alias("rest"),
    )


def body_and_footers(rest: Column) -> Column:
    """struct(body, footers): footers are the trailing blocks in which every line is a token or its continuation and one is a token."""
    blocks = F.split(rest, r"(?<=\S)\r?\n\r?\n(?=\S)")
    token = F.lit(FOOTER_LIKE)

    def footer_block(block: Column) -> Column:
        lines = F.filter(T.lines(strip(block)), lambda x: F.trim(x) != "")
        return F.forall(lines, lambda x: F.regexp_like(F.trim(x), token) | F.regexp_like(x, F.lit(r"^[ \t]"))) & F.exists(lines, lambda x: F.regexp_like(F.trim(x), token))

    flags = F.reverse(F.transform(blocks, footer_block))
    first_other = F.array_position(flags, F.lit(False)).cast("int")
    n = F.when(first_other > 0, first_other - 1).otherwise(F.size(blocks))
    body = F.array_join(F.slice(blocks, 1, F.greatest(F.size(blocks) - n, F.lit(0))), "\n\n")
    foot = F.when(n > 0, F.array_join(F.slice(blocks, F.size(blocks) - n + 1, n), "\n\n")).otherwise("")
    return F.struct(_found(strip(body)).alias("body"), _found(strip(foot)).alias("footers"))


def footers(text: Column) -> Column:
    """array<struct<token, separator, value>>: multi-line values continue; what only looks like a footer is kept as it is, on one line."""
    zero = F.array().cast("array<struct<token:string,separator:string,value:string,closed:boolean>>")

    def item(token: Column, separator: Column, value: Column, closed: Column) -> Column:
        return F.struct(token.alias("token"), separator.alias("separator"), value.alias("value"), closed.alias("closed"))

    def step(done: Column, line: Column) -> Column:
        bare = F.trim(F.regexp_replace(line, r"\t", " "))
        last = F.get(done, F.size(done) - 1)
        is_open = F.coalesce(~last["closed"], F.lit(False))
        strict = F.regexp_like(bare, F.lit(FOOTER))
        starts = strict & (~is_open | ~F.regexp_like(line, F.lit(r"^[ \t]")))
        colon = F.contains(bare, F.lit(":"))
        like = ~strict & ((colon & (F.trim(F.substring_index(bare, ":", 1)) != "")) | (~colon & F.contains(bare, F.lit(" #")) & (F.trim(F.substring_index(bare, " #", 1)) != "")))
        new = item(F.regexp_extract(bare, FOOTER, 1), F.regexp_extract(bare, FOOTER, 2), F.regexp_extract(bare, FOOTER, 3), F.lit(False))
        cut = F.when(colon, F.lit(":")).otherwise(F.lit(" #"))
        at = F.locate(":", bare)
        loose_value = F.when(colon, F.substring(bare, at + 1, F.lit(2**31 - 1))).otherwise(F.substring(bare, F.locate(" #", bare) + 2, F.lit(2**31 - 1)))
        loose_token = F.when(colon, F.substring_index(bare, ":", 1)).otherwise(F.substring_index(bare, " #", 1))
        loose = item(F.trim(loose_token), F.when(cut == ":", ": ").otherwise(" #"), F.trim(loose_value), F.lit(True))
        more = item(last["token"], last["separator"], F.concat(last["value"], F.lit("\n"), F.when(bare == "", "").otherwise(line)), F.lit(False))
        grown = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(more))
        return F.when((bare != "") & starts, F.concat(done, F.array(new))).when((bare != "") & like, F.concat(done, F.array(loose))).when(is_open, grown).otherwise(done)

    found = F.aggregate(T.lines(F.coalesce(text, F.lit(""))), zero, step)
    return F.transform(found, lambda x: F.struct(x["token"].alias("token"), x["separator"].alias("separator"), strip(x["value"]).alias("value")))


_UPPER = r"^\p{Lu}"
CASES = {
    "lower-case": lambda s: F.lower(s) == s,
    "upper-case": lambda s: F.upper(s) == s,
    "camel-case": lambda s: s.rlike(r"^\p{Ll}") & ~s.rlike("[ _-]"),
    "kebab-case": lambda s: (F.lower(s) == s) & s.rlike("-") & ~s.rlike("[ _]"),
    "pascal-case": lambda s: s.rlike(_UPPER) & ~s.rlike("[ _-]"),
    "sentence-case": lambda s: s.rlike(_UPPER) & (F.lower(F.substring(s, 2, 2**31 - 1)) == F.substring(s, 2, 2**31 - 1)),
    "snake-case": lambda s: (F.lower(s) == s) & s.rlike("_") & ~s.rlike("[ -]"),
    "start-case": lambda s: ~s.rlike(r"(^|\s)[^\s\p{Lu}]"),
}


def has_case(text: Column, *formats: str) -> Column:
    """Whether a text has any of the case formats; unknown formats allow everything."""
    return reduce(or_, [CASES[f](text) if f in CASES else F.lit(True) for f in formats])


def valid_footer_token(token: Column) -> Column:
    breaking = F.lower(token).rlike("^breaking[ -]change$")
    return F.when(breaking, token.isin("BREAKING CHANGE", "BREAKING-CHANGE")).otherwise(token.rlike(r"^[A-Z][A-Z0-9\-]+$"))


def linted(message: Column) -> Column:
    """struct(is_valid, messages) under the effective rules: errors (header, type, scope, subject), then warnings (prefixed), then those of body and footers."""
    p = parsed(message)
    rest = body_and_footers(p["rest"])
    return _verdict(message, p, rest, footers(rest["footers"]))


def with_lint(rows: DataFrame, message: str, out: str = "lint") -> DataFrame:
    """rows with `linted` of a message column; its parts are columns of steps in between, so that each is worked out once."""
    p, rest, items, parts = (f"{out}_{x}" for x in ("parsed", "rest", "items", "parts"))
    df = rows.withColumn(p, parsed(F.col(message)))
    df = df.withColumn(rest, body_and_footers(F.col(p)["rest"]))
    df = df.withColumn(items, footers(F.col(rest)["footers"]))
    df = df.withColumn(parts, _said(F.col(message), F.col(p), F.col(rest), F.col(items)))
    return df.withColumn(out, _summed(F.col(message), F.col(p), F.col(parts))).drop(p, rest, items, parts)


def _verdict(message: Column, p: Column, rest: Column, items: Column) -> Column:
    return _summed(message, p, _said(message, p, rest, items))


def _header(message: Column) -> Column:
    return F.element_at(F.split(message, r"\r\n|\n|\r"), 1)


def _said(message: Column, p: Column, rest: Column, items: Column) -> Column:
    """struct(bad, warned) of a message whose header could be parsed."""
    header, body, foot = _header(message), rest["body"], rest["footers"]
    say = lambda bad, text: F.when(bad, text)
    size = F.length(header).cast("string")
    subject = p["description"]
    errors = [
        say(F.length(header) > HEADER_MAX, F.concat(F.lit(f"Header line exceeds {HEADER_MAX} characters (found "), size, F.lit(")."))),
        say(F.endswith(header, F.lit(".")), F.lit("Header must not end with '.'.")),
        say(header != strip(header), F.lit("Header must not have leading or trailing whitespace.")),
        say(~F.lower(p["type"]).isin(TYPES), F.concat(F.lit("Invalid type '"), p["type"], F.lit(f"'. Must be one of: {', '.join(sorted(TYPES))} (case-insensitive)."))),
        say(~has_case(p["type"], "lower-case"), F.lit("Type must be in case format: lower-case.")),
        say(p["scope"] == "", F.lit("Scope cannot be empty when parentheses are used.")),
        say(~has_case(p["scope"], "lower-case"), F.lit("Scope must be in case format: lower-case.")),
        say(has_case(subject, "sentence-case", "start-case", "pascal-case", "upper-case"), F.lit("Subject must be in one of these case formats: sentence-case, start-case, pascal-case, upper-case.")),
        say(F.endswith(subject, F.lit(".")), F.lit("Subject must not end with '.'.")),
    ]
    second = F.get(T.lines(message), F.lit(1))
    warnings = [say(F.coalesce(F.trim(second) != "", F.lit(False)), F.lit("[WARN] Body must begin with a blank line after the description."))]

    def long_lines(text: Column, name: str) -> Column:
        lines = T.lines(F.coalesce(text, F.lit("")))
        said = F.transform(lines, lambda x, i: F.when(F.length(x) > LINE_MAX, F.concat(F.lit(f"[WARN] {name} line "), (i + 1).cast("string"), F.lit(f" exceeds {LINE_MAX} characters (found "), F.length(x).cast("string"), F.lit(")."))))
        return F.array_compact(said)

    several = (F.size(items) > 0) & (F.size(T.lines(F.coalesce(foot, F.lit("")))) > 1)
    blank = F.array_compact(F.array(say(several, F.lit("[WARN] Footer section must begin with a blank line."))))

    def token_says(x: Column) -> Column:
        t = x["token"]
        quoted = lambda a, b: F.concat(F.lit(a), t, F.lit(b))
        return (
            F.when(valid_footer_token(t), F.lit(None).cast("string"))
            .when(F.lower(t).rlike("^breaking[ -]change$"), quoted("[WARN] Footer token '", "' MUST be uppercase ('BREAKING CHANGE' or 'BREAKING-CHANGE')."))
            .when(F.contains(t, F.lit(" ")), quoted("[WARN] Invalid footer token format: '", "'. Use hyphens (-) for spaces."))
            .when(t.rlike(r"[^\x00-\x7F]"), quoted("Footer token '", "' must use ASCII characters only."))
            .when(t.rlike(r"""[!@#$%^&*()+={}\[\]|\\:;"'<>,./]"""), quoted("Footer token '", "' must not contain special characters."))
            .otherwise(quoted("[WARN] Footer token '", "' must be UPPERCASE."))
        )

    tokens = F.array_compact(F.transform(items, token_says))
    bad = F.concat(F.array_compact(F.array(*errors)), F.filter(tokens, lambda x: ~F.startswith(x, F.lit("[WARN]"))))
    warned = F.concat(F.array_compact(F.array(*warnings)), long_lines(body, "Body"), blank, long_lines(foot, "Footer"), F.filter(tokens, lambda x: F.startswith(x, F.lit("[WARN]"))))
    return F.struct(bad.alias("bad"), warned.alias("warned"))


def _summed(message: Column, p: Column, parts: Column) -> Column:
    header, bad, warned = _header(message), parts["bad"], parts["warned"]
    broken = F.when(~F.contains(header, F.lit(":")), "Invalid header format: Missing ':' after type/scope.").when(~header.rlike(r"^[^:]*: "), "Invalid header format: Missing space after ':'.").otherwise("Invalid header format: Does not match '<type>(<scope>)!: <description>'. Check type/scope syntax.")
    empty = strip(F.coalesce(message, F.lit(""))) == ""
    messages = F.when(empty, F.array(F.lit("Commit message cannot be empty."))).when(~p["ok"], F.array(broken)).otherwise(F.concat(bad, warned))
    return F.struct((~empty & p["ok"] & (F.size(bad) == 0)).alias("is_valid"), messages.alias("messages"))


def formatted(type_: Column, scope: Column, breaking: Column, description: Column, body: Column, types: list[str] | None = None) -> Column:
    """The message of a commit struct: unknown types become feat, fix or the first; a repeated type prefix in the description goes."""
    types = TYPES if types is None else types
    own = F.trim(F.lower(type_))
    kind = own if not types else F.when(own.isin(types), own).otherwise(F.lit("feat" if "feat" in types else "fix" if "fix" in types else types[0]))
    text = strip(description)
    text = F.when(F.lower(text).rlike("^(?:" + "|".join(types) + "):"), strip(F.regexp_replace(text, "^[^:]*:", ""))).otherwise(text) if types else text
    where = F.trim(F.lower(scope))
    header = F.concat(kind, F.when(F.coalesce(where, F.lit("")) != "", F.concat(F.lit("("), where, F.lit(")"))).otherwise(""), F.when(F.coalesce(breaking, F.lit(False)), "!").otherwise(""), F.lit(": "), text)
    return F.when(strip(F.coalesce(body, F.lit(""))) != "", F.concat(header, F.lit("\n\n"), strip(body))).otherwise(header)


def commit_type(files: Column) -> Column:
    """test, docs or chore by the files' names, tests first."""
    return F.when(F.exists(files, lambda f: F.regexp_like(f, F.lit(r"^tests/|_test\.|test_"))), "test").when(F.exists(files, lambda f: F.regexp_like(f, F.lit(r"^docs/|\.md$"))), "docs").otherwise("chore")


def common_directory(files: Column) -> Column:
    """Longest common path of all files, compared by parts; empty if none."""
    low, high = F.split(F.array_min(files), "/"), F.split(F.array_max(files), "/")
    first_other = F.array_position(F.zip_with(low, high, lambda a, b: F.coalesce(a == b, F.lit(False))), F.lit(False)).cast("int")
    return F.array_join(F.slice(low, 1, F.when(first_other > 0, first_other - 1).otherwise(F.size(low))), "/")


def chunk_description(kind: Column, files: Column) -> Column:
    folder = common_directory(files)
    return F.when(F.size(files) == 1, F.concat(kind, F.lit(": update "), F.get(files, F.lit(0)))).when((F.size(files) > 1) & (folder != ""), F.concat(kind, F.lit(": update files in "), folder)).otherwise(F.concat(kind, F.lit(": update "), F.size(files).cast("string"), F.lit(" related files")))


def fallback_message(files: Column, content: Column, description: Column) -> Column:
    """A message without any model: type by the first telling path, fix if the text speaks of fix or bug, description unless it is a placeholder."""
    first = F.get(F.filter(files, lambda f: F.regexp_like(f, F.lit(r"^tests/|^docs/|\.md$"))), F.lit(0))
    kind = F.when(first.rlike("^tests/"), "test").when(first.isNotNull(), "docs").otherwise("chore")
    kind = F.when(F.lower(F.coalesce(content, F.lit(""))).rlike("fix|bug"), "fix").otherwise(kind)
    told = (F.coalesce(description, F.lit("")) != "") & ~F.lower(F.coalesce(description, F.lit(""))).rlike("update files|changes in|hunk in|new file:")
    typed = F.lower(description).rlike(r"^(?:feat|fix|refactor|docs|test|chore|style|perf|ci|build)[^:]*:")
    folder = common_directory(files)
    plain = F.when(F.size(files) == 1, F.concat(F.lit("update "), F.get(files, F.lit(0)))).when((F.size(files) > 1) & (folder != ""), F.concat(F.lit("update files in "), folder)).when(F.size(files) > 1, F.concat(F.lit("update "), F.size(files).cast("string"), F.lit(" files"))).otherwise("update files")
    own_type = F.lower(F.trim(F.substring_index(F.substring_index(description, ":", 1), "(", 1)))
    return F.when(told & typed, F.concat_ws(": ", own_type, F.trim(F.regexp_replace(description, "^[^:]*:", "")))).when(told, F.concat_ws(": ", kind, description)).otherwise(F.concat_ws(": ", kind, plain))


#: Sections of a pull request's description, in order: title, prefix of the commits, and the check box.
SECTIONS = [("Features", "feat"), ("Fixes", "fix"), ("Documentation", "docs"), ("Refactors", "refactor"), ("Optimizations", "perf"), ("Other", None)]
BOXES = [("Refactor", "refactor"), ("Feature", "feat"), ("Bug Fix", "fix"), ("Optimization", "perf"), ("Documentation Update", "docs")]
#: The sections that end a description.
_TAIL = """## Related Tickets & Documents

- Related Issue #
- Closes #

## Added/updated tests?

- [ ] Yes
- [ ] No, and this is why: _please replace this line with details on why tests have not been included_
- [ ] I need help with writing tests
"""


def bucket(message: Column) -> Column:
    """feat, fix, docs, refactor, perf by what a message starts with, else other."""
    out = F.lit("other")
    for _, prefix in reversed(SECTIONS[:-1]):
        out = F.when(F.startswith(message, F.lit(prefix)), prefix).otherwise(out)
    return out


def pr_title(first_commit: Column) -> Column:
    names = F.create_map(*[F.lit(x) for x in ("feat", "Feature:", "fix", "Fix:", "docs", "Docs:", "refactor", "Refactor:", "perf", "Optimize:")])
    kind = F.regexp_extract(first_commit, r"^([a-z]+)(\([^)]+\))?:", 1)
    title = F.regexp_replace(first_commit, r"^[a-z]+(\([^)]+\))?:\s*", "")
    return F.when(first_commit.isNull(), "Update branch").when(kind == "", first_commit).otherwise(F.concat(F.coalesce(F.try_element_at(names, kind), F.lit("Update:")), F.lit(" "), F.upper(F.substring(title, 1, 1)), F.substring(title, 2, 2**31 - 1)))


def _listed(kind: str, prefix: str) -> Column:
    """The messages of one bucket of `c` as a list, without their prefix."""
    own = F.filter("c", lambda x: x["bucket"] == kind)
    return F.array_join(F.transform(own, lambda x: F.concat(F.lit("- "), F.regexp_replace(x["message"], prefix, ""), F.lit("\n"))), "")


def pr_summary(commits: DataFrame, keys: list[str]) -> DataFrame:
    """keys, title, description, n_commits for each group of commits (keys, ord, message)."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "message", bucket(F.col("message")).alias("bucket"))))
    g = commits.groupBy(*keys).agg(ordered.alias("c"))
    has = lambda b: F.exists("c", lambda x: x["bucket"] == b)
    parts = [F.lit("## What type of PR is this? (check all applicable)\n\n")]
    parts += [F.concat(F.when(has(b), "- [x] ").otherwise("- [ ] "), F.lit(f"{name}\n")) for name, b in BOXES]
    parts += [F.lit("\n## Description\n\n")]
    for title, prefix in SECTIONS:
        kind = prefix or "other"
        strip_off = rf"^{prefix}(\([^)]+\))?:\s*" if prefix else r"^(style|test|build|ci|chore|revert)(\([^)]+\))?:\s*"
        said = _listed(kind, strip_off)
        parts.append(F.when(has(kind), F.concat(F.lit(f"### {title}\n\n"), said, F.lit("\n"))).otherwise(""))
    return g.select(*keys, pr_title(F.col("c")[0]["message"]).alias("title"), F.concat(*parts, F.lit(_TAIL)).alias("description"), F.size("c").alias("n_commits"))


def preview(commits: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """keys and the first commits as a list, with how many more there are."""
    g = commits.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "message"))), lambda x: F.concat(F.lit("- "), x["message"])).alias("c"))
    more = F.when(F.size("c") > most, F.concat(F.lit("\n- ... and "), (F.size("c") - most).cast("string"), F.lit(" more commits"))).otherwise("")
    return g.select(*keys, F.concat(F.array_join(F.slice("c", 1, most), "\n"), more).alias("description"))


#: Branch prefixes of each workflow, in the order they are tried.
PREFIXES = {
    "github-flow": [("feature", "")],
    "gitflow": [("feature", "feature/"), ("release", "release/"), ("hotfix", "hotfix/"), ("bugfix", "bugfix/")],
    "trunk-based": [("feature", "user/"), ("bugfix", "user/")],
}


def branch_type(branch: Column, workflow: str = "github-flow") -> Column:
    out = F.lit("feature")
    for name, prefix in reversed(PREFIXES[workflow]):
        out = F.when(F.startswith(branch, F.lit(prefix)), name).otherwise(out)
    return out


def valid_branch(branch: Column) -> Column:
    return F.coalesce(branch.rlike(r"^[a-zA-Z0-9_.-]+$"), F.lit(False))


def suggested_branch(message: Column, workflow: str) -> Column:
    """A branch name from a message: its type by first match, then the words of the description with hyphens."""
    kind = F.when(message.rlike(r"(?i)^\s*fix|bug|hotfix"), "bugfix" if workflow == "github-flow" else "hotfix").when(message.rlike(r"(?i)^\s*doc|docs"), "docs").when(message.rlike(r"(?i)^\s*feat|feature"), "feature").when(message.rlike(r"(?i)^\s*release"), "release").otherwise("feature")
    rest = F.regexp_replace(F.regexp_replace(message, r"(?i)^\s*(?:fix|bug|hotfix|feat|feature|doc|docs|release).*?:\s*", ""), r"[^\w\s-]", "")
    words = F.regexp_replace(F.lower(F.trim(rest)), r"\s+", "-")
    prefix = F.lit("user/") if workflow == "trunk-based" else F.concat(kind, F.lit("/"))
    return F.concat(prefix, words)


def title_without_commits(branch: Column, kind: Column) -> Column:
    clean = F.translate(F.replace(branch, F.concat(kind, F.lit("/")), F.lit("")), "-_", "  ")
    cap = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2**31 - 1)))
    return F.when(kind == "release", F.concat(F.lit("Release "), F.replace(branch, F.lit("release/"), F.lit("")))).otherwise(F.concat(cap(kind), F.lit(": "), cap(clean)))


def branches_by_type(branches: DataFrame, workflow: str = "github-flow") -> DataFrame:
    """(type, branches): distinct branch names of each type in order, HEAD left out."""
    b = branches.filter("branch <> 'HEAD'").select(F.regexp_replace("branch", "^origin/", "").alias("branch")).distinct()
    return b.groupBy(branch_type(F.col("branch"), workflow).alias("type")).agg(F.array_sort(F.collect_set("branch")).alias("branches"))


def filled_template(template: str, values: dict[str, Column]) -> Column:
    """A template with {name} fields replaced."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out
